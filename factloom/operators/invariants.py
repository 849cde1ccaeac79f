"""Invariants learned from counts over a code base."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def guard_patterns(operations: DataFrame, support: int = 5) -> DataFrame:
    """(op, pattern, confidence, support): operations guarded in 95 % of cases or more, or in 5 % or fewer.  operations(op, guarded)."""
    per = operations.groupBy("op").agg(F.count("*").alias("support"), (F.count_if("guarded") / F.count("*")).alias("share")).where(F.col("support") >= support)
    pattern = F.when(F.col("share") >= 0.95, "always_guarded").when(F.col("share") <= 0.05, "never_guarded")
    return per.select("op", pattern.alias("pattern"), F.round(F.when(F.col("share") >= 0.95, F.col("share")).otherwise(1 - F.col("share")), 6).alias("confidence"), "support").where("pattern is not null")


def never_null(returns: DataFrame, most: float = 0.01, support: int = 10) -> DataFrame:
    """(func, confidence, support): functions that hardly ever return null.  returns(func, is_null)."""
    per = returns.groupBy("func").agg(F.count("*").alias("support"), (F.count_if("is_null") / F.count("*")).alias("share"))
    return per.where((F.col("share") <= most) & (F.col("support") >= support)).select("func", F.round(1 - F.col("share"), 6).alias("confidence"), "support")


def likely_invariants(observations: DataFrame) -> DataFrame:
    """(var, prop, confidence): share of a variable's observations with a property.  observations(var, prop)."""
    per = observations.groupBy("var", "prop").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("var"))
    return per.select("var", "prop", F.round(F.col("n") / total, 6).alias("confidence"))


def nearby_guard(instructions: DataFrame, distance: int = 10) -> DataFrame:
    """instructions(func, idx, is_guard) with near_guard: one of the previous instructions is a guard."""
    w = Window.partitionBy("func").orderBy("idx").rowsBetween(-distance, -1)
    return instructions.withColumn("near_guard", F.coalesce(F.max(F.col("is_guard").cast("int")).over(w), F.lit(0)) == 1)
