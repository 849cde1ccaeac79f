"""The pipeline's stages against their operators, and the whole run."""

import corpus_pipeline
from factloom.llm import byte_bpe, jaccard_join, mixing, quality_pu, toxicity
from tests.llm.helpers import documents

SF = "/root/testdata/sf0.01"


def test_stages_keep_what_their_operators_say(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    good = corpus_pipeline.quality(spark, docs, SF)
    assert ids(good) == ids(quality_pu.score(docs, quality_pu.train(docs, labels)).where("predicted = 1"))
    clean = corpus_pipeline.clean(spark, good, SF)
    assert ids(clean) == ids(toxicity.score(good, toxicity.train(good, labels)).where("predicted = 0"))
    one = corpus_pipeline.distinct(spark, clean, SF)
    assert ids(one) == sorted({r.component_id for r in jaccard_join.join(clean).collect()})
    mixed = corpus_pipeline.mix(spark, one, SF)
    assert all(df.columns == docs.columns for df in (good, clean, one, mixed))
    taken = sum(r.taken for r in mixing.mix(one).collect())
    assert taken == sum(r.size for r in mixing.mix(mixed).collect())
    assert corpus_pipeline.encode(spark, mixed, SF).count() == mixed.count()


def test_run_is_the_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (documents(spark), documents(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).count()


def test_encoding_round_trip(spark):
    import hashlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    import public_tokenizers

    rows = byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in rows)
