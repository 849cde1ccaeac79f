"""Cheap proofs that a reported bug cannot happen, tried in order: types, habits of the code base, intervals, ownership, chance.

Each proof is a table (bug, confidence) that it computes from facts by joins on the function, and `cascade` takes the first that is sure enough.
bugs(bug, bug_type, var, func, name) are reports on a variable of a function of some name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a refinement's predicate is worth for a type of bug; null where it rules a proof out.
PREDICATES = (
    ("DIV_ZERO", "positive", 1.0), ("DIV_ZERO", "nonzero", 1.0), ("DIV_ZERO", "nonnegative", 0.8),
    ("NULL_PTR", "nonnull", 1.0), ("NULL_PTR", "nonempty", 1.0), ("NULL_PTR", "nonempty_string", 1.0), ("NULL_PTR", "nonempty_list", 1.0), ("NULL_PTR", "nullable", None),
    ("BOUNDS", "inbounds", 0.9), ("BOUNDS", "nonnegative", 0.9),
    ("VALUE_ERROR", "positive", 0.85), ("VALUE_ERROR", "nonnegative", 0.85), ("VALUE_ERROR", "inbounds", 0.85), ("VALUE_ERROR", "nonempty", 0.85),
)
# The property that rules a type of bug out where it holds often enough, and how often; and how many observations it takes.
HABITS = (("DIV_ZERO", "nonzero", 0.90), ("NULL_PTR", "nonnull", 0.95))
HABIT_SUPPORT = 5
# The guard that fits a type of bug, and its worth; the worth of another guard, of a guarded type, and of none.
GUARDS = (("DIV_ZERO", "ZERO_CHECK", 0.95), ("NULL_PTR", "NONE_CHECK", 0.95), ("BOUNDS", "BOUNDS_CHECK", 0.90))
OTHER_GUARD, GUARDED_TYPE, NO_GUARD = 0.75, 0.85, 0.40
# Parts of names of sizes, and beginnings of names of objects, with the chance that they are safe, the first that fits counts.
SIZE_NAMES = (("size", 0.80), ("length", 0.80), ("len", 0.75), ("count", 0.80), ("num_", 0.75), ("n_", 0.70), ("total", 0.70), ("width", 0.75), ("height", 0.75), ("capacity", 0.75), ("limit", 0.70))
OBJECT_NAMES = (("result", 0.75), ("output", 0.70), ("instance", 0.80), ("obj", 0.75), ("self", 0.95), ("cls", 0.90))
PLAIN_NAMES, PLAIN_NAME, ANY_NAME, NO_NAME = ("x", "y", "z", "i", "j", "k", "value", "val"), 0.50, 0.55, 0.50
# Marks of tests in names of functions, special methods, beginnings of accessors, and the chances of these and of others.
TEST_MARKS, TEST_CODE = ("test_", "_test", "mock_", "_mock", "debug_", "example_", "demo_"), 0.90
SPECIAL = (("__init__", 0.85), ("__len__", 0.90), ("__getitem__", 0.65), ("__setitem__", 0.65), ("__str__", 0.80), ("__repr__", 0.80))
OTHER_SPECIAL, PRIVATE, ACCESSORS, ACCESSOR, PROPERTIES, PROPERTY, ANY_FUNCTION = 0.75, 0.80, ("get_", "_get_", "set_", "_set_"), 0.70, ("@property", ".property"), 0.75, 0.60
# The chance that a report of a type is wrong.
TYPE_CHANCES = (
    ("VALUE_ERROR", 0.70), ("RUNTIME_ERROR", 0.65), ("TYPE_ERROR", 0.75), ("ATTRIBUTE_ERROR", 0.60), ("KEY_ERROR", 0.55), ("INDEX_ERROR", 0.55), ("DIV_ZERO", 0.65), ("NULL_PTR", 0.60), ("BOUNDS", 0.55),
)
ANY_TYPE = 0.60
# What a handler, a raise and a loop add to an even chance; the weights of guard, name, function, type and traits; the prior.
TRAITS, EVEN = (("handles", 0.15), ("raises", 0.10), ("loops", 0.05)), 0.50
WEIGHTS, PRIOR = (0.30, 0.20, 0.25, 0.15, 0.10), 0.70
# The order of the proofs, and the confidence that each must exceed.
ORDER = (("refinement_types", 0.80), ("likely_invariants", 0.85), ("interval_analysis", None), ("separation_logic", None), ("stochastic_barriers", 0.70))


def first_match(rules: list[tuple[Column, Column | float]], otherwise: float) -> Column:
    """The value of the first rule that holds."""
    out = F.lit(None).cast("double")
    for holds, value in reversed(rules):
        out = F.when(holds, value).otherwise(out)
    return F.coalesce(out, F.lit(otherwise))


def _table(df: DataFrame, rows: tuple, names: str) -> DataFrame:
    """A table of fixed values."""
    return F.broadcast(df.sparkSession.createDataFrame(list(rows), names))


def by_refinement(bugs: DataFrame, refinements: DataFrame) -> DataFrame:
    """refinements(func, ordinal, var, predicate, strength): the first on the variable, or on the parameter of that name, which bears on the type decides."""
    bearing = refinements.join(_table(bugs, PREDICATES, "bug_type string, predicate string, factor double"), "predicate")
    named = bearing.select("func", "bug_type", F.explode(F.array("var", F.concat(F.lit("param_"), "var"))).alias("var"), "ordinal", (F.col("strength") * F.col("factor")).alias("confidence"))
    first = bugs.join(named, ["func", "bug_type", "var"]).groupBy("bug").agg(F.min_by(F.struct("confidence"), "ordinal").alias("f"))
    return first.select("bug", "f.confidence").where("confidence is not null")


def habits(observations: DataFrame) -> DataFrame:
    """(var, prop, confidence, support): the share of a variable's observations with a property.  observations(var, prop)."""
    per = observations.groupBy("var", "prop").agg(F.count("*").alias("support"))
    return per.select("var", "prop", (F.col("support") / F.sum("support").over(Window.partitionBy("var"))).alias("confidence"), "support")


def by_habit(bugs: DataFrame, observed: DataFrame) -> DataFrame:
    """observed: habits() of a code base."""
    wanted = bugs.join(_table(bugs, HABITS, "bug_type string, prop string, least double"), "bug_type")
    return wanted.join(observed, ["var", "prop"]).where((F.col("confidence") >= F.col("least")) & (F.col("support") >= HABIT_SUPPORT)).select("bug", "confidence")


def by_interval(bugs: DataFrame, intervals: DataFrame) -> DataFrame:
    """intervals(func, var, lo, hi), a null side unbounded: divisors apart from zero, indexes from zero on."""
    apart = (F.col("bug_type") == "DIV_ZERO") & ((F.col("lo") > 0) | (F.col("hi") < 0))
    from_zero = (F.col("bug_type") == "BOUNDS") & (F.col("lo") >= 0)
    worth = F.when(apart, F.lit(1.0)).when(from_zero, F.lit(0.90))
    return bugs.join(intervals, ["func", "var"]).select("bug", worth.alias("confidence")).where("confidence is not null")


def by_ownership(bugs: DataFrame, owned: DataFrame, guards: DataFrame) -> DataFrame:
    """owned(func, var) were made in the function and so are not none; guards(func, var, guard) may have looked."""
    null = bugs.where("bug_type = 'NULL_PTR'")
    made = null.join(owned.select("func", "var").distinct(), ["func", "var"]).select("bug", F.lit(1.0).alias("confidence"))
    seen = null.join(guards.where("guard = 'NONE_CHECK'").select("func", "var").distinct(), ["func", "var"]).select("bug", F.lit(0.95).alias("confidence"))
    return made.union(seen).groupBy("bug").agg(F.max("confidence").alias("confidence"))


def chances(bugs: DataFrame, guards: DataFrame, guarded: DataFrame, traits: DataFrame) -> DataFrame:
    """(bug, confidence): the chance that a bug is none, from five weighted signs and the prior.

    guards(func, var, guard), guarded(func, bug_type), traits(func, handles, raises, loops); a function without traits has an even chance.
    """
    kind, var, name = F.col("bug_type"), F.lower("var"), F.lower("name")
    fitting = F.bool_or(F.col("guard") == F.col("fits")).alias("exact")
    of_var = bugs.join(guards, ["func", "var"]).join(_table(bugs, GUARDS, "bug_type string, fits string, worth double"), "bug_type", "left").groupBy("bug").agg(fitting, F.max("worth").alias("worth"))
    rows = bugs.join(of_var, "bug", "left").join(guarded.select("func", "bug_type").distinct().withColumn("typed", F.lit(True)), ["func", "bug_type"], "left").join(traits, "func", "left")
    has_guards = F.col("exact").isNotNull() | F.col("worth").isNotNull()
    any_guard = rows.join(guards.select("func", "var").distinct().withColumn("some", F.lit(True)), ["func", "var"], "left")
    guard = first_match([(F.coalesce("exact", F.lit(False)), F.col("worth")), (has_guards | F.col("some").isNotNull(), F.lit(OTHER_GUARD)), (F.col("typed").isNotNull(), F.lit(GUARDED_TYPE))], NO_GUARD)
    sizes = [(kind.isin("DIV_ZERO", "BOUNDS") & var.contains(p), F.lit(v)) for p, v in SIZE_NAMES]
    objects = [((kind == "NULL_PTR") & ((var == p) | var.startswith(f"{p}_")), F.lit(v)) for p, v in OBJECT_NAMES]
    naming = first_match([(F.coalesce(var, F.lit("")) == "", F.lit(NO_NAME)), *sizes, *objects, (var.isin(*PLAIN_NAMES), F.lit(PLAIN_NAME))], ANY_NAME)
    dunder = name.startswith("__") & name.endswith("__")
    context = first_match(
        [
            *((name.contains(m), F.lit(TEST_CODE)) for m in TEST_MARKS), (name.startswith("_") & ~name.startswith("__"), F.lit(PRIVATE)), *((dunder & name.contains(m), F.lit(v)) for m, v in SPECIAL),
            (dunder, F.lit(OTHER_SPECIAL)), *((name.startswith(p), F.lit(ACCESSOR)) for p in ACCESSORS), *((name.contains(p), F.lit(PROPERTY)) for p in PROPERTIES),
        ],
        ANY_FUNCTION,
    )
    of_type = first_match([(kind == t, F.lit(v)) for t, v in TYPE_CHANCES], ANY_TYPE)
    code = F.lit(EVEN)
    for trait, more in TRAITS:
        code = code + F.when(F.coalesce(trait, F.lit(False)), more).otherwise(0.0)
    signs = F.lit(0.0)
    for sign, weight in zip((guard, naming, context, of_type, F.least(code, F.lit(0.95))), WEIGHTS, strict=True):
        signs = signs + sign * weight
    share = signs / sum(WEIGHTS)
    return any_guard.select("bug", (share * PRIOR / (share * PRIOR + (1 - share) * (1 - PRIOR))).alias("confidence"))


def cascade(bugs: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """(bug, technique, confidence): the first proof in ORDER that exceeds what it must; none and 0 where none does.  found: proofs by name."""
    tried = None
    for ordinal, (name, least) in enumerate(ORDER):
        if name in found:
            sure = found[name] if least is None else found[name].where(F.col("confidence") > least)
            one = sure.select("bug", F.lit(ordinal).alias("ordinal"), F.lit(name).alias("technique"), "confidence")
            tried = one if tried is None else tried.union(one)
    best = tried.groupBy("bug").agg(F.min_by(F.struct("technique", "confidence"), F.struct("ordinal", -F.col("confidence"))).alias("p"))
    return bugs.select("bug").join(best, "bug", "left").select("bug", F.coalesce("p.technique", F.lit("none")).alias("technique"), F.coalesce("p.confidence", F.lit(0.0)).alias("confidence"))
