"""Queries of the training-data operators and their DuckDB SQL."""

from factloom.llm import ann_tree, byte_bpe, jaccard_join, license_scan, merkle, mixing, periodic_runs, quality_pu, quality_rules, suffix_dedup, token_orc, toxicity, url_reputation

QUERIES = {
    "op1_token_orc": token_orc.op1_token_orc,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_url_reputation": url_reputation.op7_url_reputation,
    "op8_quality_pu": quality_pu.op8_quality_pu,
    "op9_ann_tree": ann_tree.op9_ann_tree,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES = {
    "op4_mix_sources": mixing.OP4_SQL,
    "op5_quality_rules": quality_rules.OP5_SQL,
    "op7_url_reputation": url_reputation.OP7_SQL,
    "op12_suffix_dedup": suffix_dedup.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
