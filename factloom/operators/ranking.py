"""Ranking functions: whether linear measures, one or several in order, show that loops end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear(level: Column, state: Column) -> Column:
    """The value of level(constant, weights) at a state: the constant and the weighted sum of the state's variables.

    A variable that the state does not hold makes the value unknown.
    """
    terms = F.transform(F.map_entries(level["weights"]), lambda e: e["value"] * F.try_element_at(state, e["key"]))
    return F.reduce(terms, level["constant"].cast("double"), lambda acc, x: acc + x)


def verdicts(measures: DataFrame, transitions: DataFrame) -> DataFrame:
    """(loop, terminates, bounded, decreasing, n, unbounded_at, not_decreasing_at) of every measured loop.

    measures(loop, level, constant, weights) are the levels of a lexicographic measure, the outermost first; transitions(loop, id, before,
    after) are states, maps of variables, at the two ends of a back edge.  A measure is bounded if no level is below 0 where a turn begins,
    and decreases if on every turn the first level that changes falls.  Unknown values show neither.  The last two columns are the least id of a turn
    that shows the contrary.  A loop without a turn ends.
    """
    levels = _levels(measures)
    turns = transitions.select("loop", "id", "before", "after").join(levels, "loop")
    value = lambda at: F.transform("levels", lambda x: linear(x, F.col(at)))
    turns = turns.withColumns({"v": value("before"), "w": value("after")})
    bounded = F.forall("v", lambda x: F.coalesce(x >= 0, F.lit(False)))
    pairs = F.arrays_zip("v", "w")
    changed = F.get(F.filter(pairs, lambda p: ~p["v"].eqNullSafe(p["w"]) | p["v"].isNull()), F.lit(0))
    falls = F.coalesce(changed["w"] < changed["v"], F.lit(False))
    seen = turns.select("loop", "id", bounded.alias("b"), falls.alias("d"))
    at = lambda ok: F.min(F.when(~F.col(ok), F.col("id")))
    per = seen.groupBy("loop").agg(F.every("b").alias("bounded"), F.every("d").alias("decreasing"), F.count("*").alias("n"), at("b").alias("unbounded_at"), at("d").alias("not_decreasing_at"))
    yes = lambda c: F.coalesce(c, F.lit(True)).alias(c)
    out = levels.select("loop").join(per, "loop", "left").select("loop", yes("bounded"), yes("decreasing"), F.coalesce("n", F.lit(0)).alias("n"), "unbounded_at", "not_decreasing_at")
    return out.select("loop", (F.col("bounded") & F.col("decreasing")).alias("terminates"), "bounded", "decreasing", "n", "unbounded_at", "not_decreasing_at")


def _levels(measures: DataFrame) -> DataFrame:
    """One row a loop with its levels in order; maps cannot be sorted, so they travel as entries."""
    entries = F.transform(F.map_entries("weights"), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("double").alias("value")))
    per = measures.groupBy("loop").agg(F.array_sort(F.collect_list(F.struct("level", "constant", entries.alias("w")))).alias("l"))  # the levels of one measure
    return per.select("loop", F.transform("l", lambda x: F.struct(x["constant"].alias("constant"), F.map_from_entries(x["w"]).alias("weights"))).alias("levels"))
