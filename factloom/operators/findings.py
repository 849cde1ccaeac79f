"""Findings: recoding of variants, deduplication, filters and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Variants of bug types and the type each counts as.
VARIANTS = {
    "FULL_SSRF": "SSRF", "PARTIAL_SSRF": "SSRF", "REFLECTED_XSS": "XSS", "STORED_XSS": "XSS", "DOM_XSS": "XSS", "TARSLIP": "PATH_INJECTION",
    "ZIPSLIP": "PATH_INJECTION", "UNVALIDATED_REDIRECT": "URL_REDIRECT", "WEAK_SENSITIVE_DATA_HASHING": "WEAK_CRYPTO", "BROKEN_CRYPTO_ALGORITHM": "WEAK_CRYPTO",
}
#: Call chains that a deduplicated finding keeps.
CHAINS = 5


def lookup(key: Column, table: dict) -> Column:
    """The value of a small fixed table, null where it has none."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key) if table else F.lit(None)


def consolidate_variants(findings: DataFrame) -> DataFrame:
    """Recode bug_type to its canonical type; original_bug_type is set where that changed it."""
    old = F.coalesce("bug_type", F.lit("UNKNOWN"))
    new = F.coalesce(lookup(old, VARIANTS), old)
    return findings.withColumns({"original_bug_type": F.when(new != old, old), "bug_type": new})


def filter_by_confidence(findings: DataFrame, least: float = 0.5) -> DataFrame:
    """Findings at or above a confidence; a missing one counts as 0."""
    return findings.where(F.coalesce("confidence", F.lit(0.0)) >= least)


def _location(columns: list[str]) -> Column:
    return F.coalesce(*(F.col(c) for c in ("crash_location", "location", "crash_function") if c in columns), F.lit("unknown"))


def deduplicate(findings: DataFrame) -> DataFrame:
    """One row for each (bug_type, location): the most confident finding, the first in input order (seq) among equals.

    It keeps the count, up to CHAINS distinct call chains in input order, all sources sorted, and the range of confidence.
    Chains are first reduced to one row each, so no list grows with the group.
    """
    rows = findings.select(
        "seq", F.coalesce("bug_type", F.lit("UNKNOWN")).alias("bug_type"), _location(findings.columns).alias("location"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "call_chain", "tainted_sources",
    )
    keys = ["bug_type", "location"]
    stats = rows.groupBy(*keys).agg(
        F.min_by("seq", F.struct(-F.col("confidence"), F.col("seq"))).alias("seq"),
        F.max("confidence").alias("confidence"),
        F.count("*").alias("occurrences"),
        F.min("confidence").alias("min_confidence"),
        F.avg("confidence").alias("mean_confidence"),
    )
    from pyspark.sql import Window

    once = rows.where(F.size("call_chain") > 0).groupBy(*keys, "call_chain").agg(F.min("seq").alias("at"))
    first = once.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).where(F.col("n") <= CHAINS)
    chains = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "call_chain"))), lambda x: x["call_chain"]).alias("example_call_chains"))
    sources = rows.select(*keys, F.explode("tainted_sources").alias("s")).groupBy(*keys).agg(F.array_sort(F.collect_set("s")).alias("all_tainted_sources"))
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t)).alias(c)
    joined = stats.join(chains, keys, "left").join(sources, keys, "left")
    return joined.select(*stats.columns, empty("example_call_chains", "array<array<string>>"), empty("all_tainted_sources", "array<string>"))


def findings_by_type(findings: DataFrame) -> DataFrame:
    """Count by bug type."""
    return findings.groupBy("bug_type").agg(F.count("*").alias("n"))


def scan_metadata(findings: DataFrame, consolidate: bool = True) -> DataFrame:
    """One row: original and deduplicated counts, and the share that is retained."""
    rows = consolidate_variants(findings) if consolidate else findings
    groups = rows.groupBy("bug_type", _location(rows.columns).alias("location")).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("original_count"), F.count("*").alias("deduplicated_count")).withColumn(
        "retained_ratio", F.coalesce(F.try_divide("deduplicated_count", "original_count"), F.lit(0.0))
    )


def top_findings(findings: DataFrame, n: int) -> DataFrame:
    """The n most confident, in input order among equals."""
    return findings.orderBy(F.desc("confidence"), "seq").limit(n)
