"""Baselines of scan results: fingerprints, what is new and fixed, acceptance, comparison of scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(rule="rule", qualname="qualname", uri="uri") -> Column:
    """rule::qualname::uri; a missing rule is unknown, other missing parts are empty."""
    return F.concat_ws("::", F.coalesce(F.col(rule), F.lit("unknown")), F.coalesce(F.col(qualname), F.lit("")), F.coalesce(F.col(uri), F.lit("")))


def by_fingerprint(results: DataFrame) -> DataFrame:
    """One row a fingerprint: the last result (greatest seq) wins."""
    rest = [c for c in results.columns if c not in ("seq", "fp")]
    return results.withColumn("fp", fingerprint()).groupBy("fp").agg(F.max_by(F.struct("seq", *rest), "seq").alias("r")).select("fp", "r.*")


def new_results(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Results whose fingerprint the baseline does not hold."""
    return by_fingerprint(current).join(baseline.select("fp").distinct(), "fp", "left_anti")


def fixed_fingerprints(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline fingerprints that no current result has."""
    return baseline.select("fp").distinct().join(current.select(fingerprint().alias("fp")).distinct(), "fp", "left_anti")


def accept(current: DataFrame) -> DataFrame:
    """The new baseline is the current scan: acceptance replaces, it does not merge."""
    return by_fingerprint(current)


def prune(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """The baseline without what is fixed."""
    return baseline.join(current.select(fingerprint().alias("fp")).distinct(), "fp", "left_semi")


def ratchet(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: new results, fixed and kept fingerprints, and whether the scan passes, which it does without new results."""
    now = current.select(fingerprint().alias("fp")).distinct().withColumn("now", F.lit(True))
    then = baseline.select("fp").distinct().withColumn("then", F.lit(True))
    n, t = F.col("now").isNotNull(), F.col("then").isNotNull()
    return now.join(then, "fp", "full_outer").agg(F.count_if(n & ~t).alias("new"), F.count_if(~n & t).alias("fixed"), F.count_if(n & t).alias("kept"), (F.count_if(n & ~t) == 0).alias("passes"))


def set_compare(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys of both scans, of the new alone, of the old alone; null keys equal each other."""
    a = new.select(*keys).distinct().withColumn("in_new", F.lit(True)).alias("a")
    b = old.select(*keys).distinct().withColumn("in_old", F.lit(True)).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.join(b, same, "full_outer")
    x, y = F.col("in_new").isNotNull(), F.col("in_old").isNotNull()
    return both.agg(F.count_if(x & y).alias("common"), F.count_if(x & ~y).alias("new_only"), F.count_if(~x & y).alias("baseline_only"))
