"""Operator 4: mix sources to target weights.

Sizes are word counts.  Targets follow from the weights: each source's share of all words, at most `cap` times its own
size, the excess shared again by weight.  Every document gets a hash-random key; the keys' leading digits deal each
source out in ranges, one sum a range gives the words before it, and a window inside the range gives the words before a
document.  A source with target T and size S is taken T div S times as a whole, and then in key order up to its exact
remaining budget, so the document at the cut is taken in part.  Rows are shuffled once, by range; what is known of the ranges
is told to all tasks up to PLAN_ROWS rows and joined beyond.  The operator shuffles ids, sources and sizes alone.

Null texts have size 0; a null source is a source of its own and comes last.  Sources of size 0 have target 0 and take
nothing.  Rows with equal ids count each; they are ordered by size.  A null id's key comes from its text.  An empty table gives
no rows.  Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import common

#: Hexadecimal digits of the key that make a range: 4096 ranges of each source.
RANGE_DIGITS = 3
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix"
#: Most ranges, of all sources together, whose starts are told to all tasks: some 50 MB.
PLAN_ROWS = 200_000
_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """The hash-random key of a document."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.md5(F.concat(F.lit(seed), own).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources are ranked by size over weight.  The level is found at the first rank whose source does not reach its cap
    when all before it stop at theirs; a source beyond that takes its weight's part of what the capped ones leave.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % n + 1).cast("int")).cast("long")
    )
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = ranked.select(
        "source",
        "source_size",
        "weight",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))).alias("rest"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weights"),
        F.row_number().over(by_ratio).alias("rank"),
    )
    fits = F.col("rest") * F.col("weight") <= cap * F.col("source_size") * F.col("weights")
    level = left.withColumn("cut", F.min(F.when(fits, F.col("rank"))).over(everything)).withColumns(
        {
            "level_rest": F.max(F.when(F.col("rank") == F.col("cut"), F.col("rest"))).over(everything),
            "level_weights": F.max(F.when(F.col("rank") == F.col("cut"), F.col("weights"))).over(everything),
        }
    )
    free = (F.col("level_rest") * F.col("weight")).cast("double") / F.col("level_weights").cast("double")
    return level.select(
        "source", "source_size", F.when(F.col("rank") < F.col("cut"), (cap * F.col("source_size")).cast("double")).otherwise(free).alias("target")
    )


def taken(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """rows(doc_id, key, source, size, ...) with source_size, target and taken, without the key."""
    keyed = rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    goal = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("source", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("range_start"))
    plan = starts.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.*", "source_size", "target")
    plan = common.table(plan, "ranges")
    plan = F.broadcast(plan) if plan.count() <= PLAN_ROWS else plan
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.alias("d").join(
        plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.range") == F.col("p.range"))
    )
    budget = F.floor(F.col("target")).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - (F.col("range_start") + F.col("before"))))
    return joined.select("d.*", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken")).drop("key", "range", "before")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document."""
    doc_id = F.col("doc_id").cast("long")
    return taken(docs.select(doc_id.alias("doc_id"), key_of(doc_id, F.col("text"), seed).alias("key"), "source", size_of(F.col("text")).alias("size")), weights, cap)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The documents of the mix, with the columns of docs: whole copies, and at each source's cut the words in budget.

    Documents the mix does not take are left out, except those without words, which are in it once.
    """
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), doc_id.alias("doc_id"), key_of(doc_id, F.col("text"), seed).alias("key"), "source", size_of(F.col("text")).alias("size"))
    took = taken(rows, weights, cap)
    text = F.col("row.text")
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    words = (F.col("taken") - copies * F.col("size")).cast("int")
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))  # each word with the space before it
    cut = F.array_join(F.slice(pieces, 1, words), "")
    parts = F.concat(F.array_repeat(text, copies), F.when((F.col("size") > 0) & (words > 0), F.array(cut)).otherwise(F.array().cast("array<string>")))
    return took.withColumn("mixed", F.explode(parts)).select(*(F.col("mixed").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight FROM s
), l AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weights,
         row_number() OVER (ORDER BY source_size / weight, place) AS rank
  FROM w WINDOW o AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT min(rank) AS cut FROM l WHERE rest * weight <= 3 * source_size * weights
), v AS (
  SELECT cut, rest AS level_rest, weights AS level_weights FROM c JOIN l ON rank = cut
), t AS (
  SELECT source, source_size,
         CASE WHEN rank < cut THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(level_rest * weight AS DOUBLE) / CAST(level_weights AS DOUBLE) END AS target
  FROM l CROSS JOIN v
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + least(size, greatest(0, floor(target) - whole * source_size - before)) AS BIGINT) AS taken
FROM p
"""
