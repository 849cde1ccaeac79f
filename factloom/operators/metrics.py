"""Evaluation of tools: confusion counts and rates, cross-tabs, head-to-head, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIGS = ["TRUE_POSITIVE", "FALSE_NEGATIVE", "FALSE_POSITIVE", "BOTH_BUG", "ERROR"]


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def counts() -> list[Column]:
    """Confusion counts of verdicts(expected, predicted)."""
    e, p = F.col("expected"), F.col("predicted")
    hit = lambda x, y, name: F.count_if((e == x) & (p == y)).alias(name)
    return [
        hit("BUG", "BUG", "tp"), hit("SAFE", "SAFE", "tn"), hit("SAFE", "BUG", "fp"), hit("BUG", "SAFE", "fn"), hit("BUG", "UNKNOWN", "unknown_on_bug"),
        F.count_if((e != "BUG") & (p == "UNKNOWN")).alias("unknown_on_safe"), F.count_if(p == "ERROR").alias("errors"), F.count("*").alias("total"),
    ]


def rates(table: DataFrame) -> DataFrame:
    """The rates of rows with confusion counts, rounded to 4 places; accuracy over all cases and over decided ones."""
    c = F.col
    p = ratio(c("tp"), c("tp") + c("fp"))
    strict, lenient = ratio(c("tp"), c("tp") + c("fn") + c("unknown_on_bug")), ratio(c("tp"), c("tp") + c("fn"))
    right, decided = c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")
    made = {
        "decided": decided, "precision": p, "recall_strict": strict, "recall_lenient": lenient, "f1_strict": ratio(2 * p * strict, p + strict), "f1_lenient": ratio(2 * p * lenient, p + lenient),
        "accuracy": ratio(right, c("total")), "decided_accuracy": ratio(right, decided), "unknown_rate": ratio(c("unknown_on_bug") + c("unknown_on_safe"), c("total")),
    }
    return table.select("*", *((v if k == "decided" else F.round(v, 4)).alias(k) for k, v in made.items()))


def confusion(verdicts: DataFrame, *keys: str) -> DataFrame:
    """Counts and rates by keys."""
    return rates(verdicts.groupBy(*keys).agg(*counts()))


def confusion_two_levels(verdicts: DataFrame) -> DataFrame:
    """By tool, and by tool and bug type, in one pass; bug_type ALL is the overall row."""
    both = verdicts.groupingSets([["tool"], ["tool", "bug_type"]], "tool", "bug_type")
    return rates(both.agg(F.grouping("bug_type").alias("g"), *counts()).withColumn("bug_type", F.when(F.col("g") == 1, "ALL").otherwise(F.col("bug_type"))).drop("g"))


def runtimes(verdicts: DataFrame) -> DataFrame:
    """Total, mean and geometric mean runtime (floor 1e-6) by tool."""
    return verdicts.groupBy("tool").agg(
        F.round(F.sum("runtime"), 4).alias("total_runtime"), F.round(F.avg("runtime"), 4).alias("avg_runtime"), F.round(F.exp(F.avg(F.log(F.greatest(F.col("runtime"), F.lit(1e-6))))), 4).alias("geomean_runtime")
    )


def head_to_head(verdicts: DataFrame, a: str, b: str) -> DataFrame:
    """One row: cases that both, either alone, or neither of two tools got right."""
    right = lambda t: F.max(F.when(F.col("tool") == t, (F.col("predicted") == F.col("expected")).cast("int")))
    per = verdicts.where(F.col("tool").isin(a, b)).groupBy("case_id").agg(right(a).alias("a"), right(b).alias("b")).where("a is not null and b is not null")
    x, y = F.col("a") == 1, F.col("b") == 1
    return per.agg(F.count_if(x & y).alias("both_right"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("both_wrong"))


def disagreements(verdicts: DataFrame, a: str, b: str, most: int = 50) -> DataFrame:
    """The first cases where two tools differ."""
    said = lambda t: F.max(F.when(F.col("tool") == t, F.col("predicted")))
    per = verdicts.where(F.col("tool").isin(a, b)).groupBy("case_id", "expected").agg(said(a).alias("said_a"), said(b).alias("said_b"))
    return per.where("said_a <> said_b").orderBy("case_id").limit(most)


def cross_tab(rows: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    """Counts of fixed values of a column, by another, with the total."""
    return rows.groupBy(by).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values), F.count("*").alias("total"))


def best(table: DataFrame, score: str) -> DataFrame:
    """Rows by falling score; ties for the best are marked."""
    most = table.agg(F.max(score).alias("_most"))  # one row
    return table.join(F.broadcast(most)).withColumn("is_best", F.col(score).eqNullSafe(F.col("_most"))).drop("_most")


def type_statistics(findings: DataFrame) -> DataFrame:
    """By bug type: total, true and false positives, false-positive rate, of findings(bug_type, is_true)."""
    return findings.groupBy("bug_type").agg(F.count("*").alias("total"), F.count_if("is_true").alias("tp"), F.count_if(~F.col("is_true")).alias("fp")).withColumn("fp_rate", F.round(ratio(F.col("fp"), F.col("total")), 4))
