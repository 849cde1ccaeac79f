"""Operator 5: quality rules with risk-controlled thresholds.  DataFrame functions only.

Base signals of a text: words, their characters, symbols, repeated lines, and words in three-word windows that come
twice.  Four rates are made of them, per mille.  LEVELS are cutoffs of all four rates, each level stricter than the one
before.  In every stratum (band of lengths) the levels are tested in that fixed order on the labelled good documents: a level is
safe if an exact binomial test rejects the hypothesis that it rejects more than ALPHA of them.  Testing stops at the first
level that is not safe, so the order itself corrects for the number of levels; over strata the error DELTA is split in
proportion to their labelled good documents (weighted Bonferroni).  With probability 1 - DELTA no stratum loses more than
ALPHA of its good documents.  A stratum whose labels do not bear out the first level is judged by the base rule alone.

Windows are compared in the row: 64-bit hashes with positions are sorted, and only windows whose hash comes twice are
compared as text.  Null and empty texts have zeros and fail the base rule.  Null ids are judged as others, but have no
label; repeated rows are judged each.  Labels with nulls are left out, repeated ones take the better.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import common

#: Greatest share of good documents that a stratum may lose, and the chance that some stratum loses more.
ALPHA, DELTA = 0.03, 0.05
#: Lengths in words where a new stratum begins.
BANDS = (100, 300, 1000, 3000)
RATES = ("symbol_rate", "line_rate", "repeat_rate", "length_rate")
#: Cutoffs of the rates, per mille, from the loosest level to the strictest.
LEVELS = (
    (400, 300, 500, 20000),
    (300, 200, 400, 12000),
    (200, 150, 300, 10000),
    (150, 100, 250, 9000),
    (100, 75, 200, 8000),
    (75, 50, 175, 7500),
    (50, 40, 150, 7000),
    (30, 30, 120, 6750),
)
SYMBOLS = "#*$%&|<>"
_LOW31 = 0x7FFFFFFF


def signals(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every row."""
    space = common.WORD_SPACE
    bare = lambda c: F.length(F.translate(c, space, ""))
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    cut = first.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: bare(x) > 0).alias("lines"),
        bare(F.col("text")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    hashed = cut.select(
        "doc_id", "w", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"sort_array(if(size(w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(w) - 3), i -> (xxhash64(w[i], w[i + 1], w[i + 2]) & ~{_LOW31}L) | i)))").alias("h"),
    )
    top = "shiftrightunsigned({}, 31)"
    near = f"(i > 0 and {top.format('h[i - 1]')} = {top.format('x')}) or (i < size(h) - 1 and {top.format('h[i + 1]')} = {top.format('x')})"
    twice = hashed.select("doc_id", "w", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(f"filter(h, (x, i) -> {near})").alias("c"))
    spelled = twice.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.expr(f"array_sort(transform(transform(c, x -> cast(x & {_LOW31}L as int)), p -> struct(concat_ws(' ', w[p], w[p + 1], w[p + 2]) as t, p as p)))").alias("t"),
    )
    same = "(i > 0 and t[i - 1].t = x.t) or (i < size(t) - 1 and t[i + 1].t = x.t)"
    places = spelled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(f"sort_array(transform(filter(t, (x, i) -> {same}), x -> x.p))").alias("p"))
    covered = "aggregate(transform(p, (x, i) -> if(i = 0, 3, least(3, x - p[i - 1]))), 0L, (a, x) -> a + x)"
    return places.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.expr(covered).alias("n_repeat_words"))


def rated(rows: DataFrame) -> DataFrame:
    """rows with base_failed, stratum and the four rates."""
    n = F.col("n_words")
    per = lambda a, b: F.floor(F.coalesce(F.try_divide(1000 * a, b), F.lit(0)))
    band = sum((F.when(n >= b, 1).otherwise(0) for b in BANDS), F.lit(0))
    return rows.select(
        "*",
        ((n < 50) | (100 * F.col("n_repeat_words") > 50 * n)).alias("base_failed"),
        band.alias("stratum"),
        per(F.col("n_symbols"), F.col("word_chars")).alias("symbol_rate"),
        per(F.col("n_dup_lines"), n).alias("line_rate"),
        per(F.col("n_repeat_words"), n).alias("repeat_rate"),
        per(F.col("word_chars"), n).alias("length_rate"),
    )


def tail(n: str, k: str, p: float) -> str:
    """SQL of the exact chance of at most k in n at rate p; terms are carried as logarithms."""
    step = f"a.term + if(j = 0, 0D, ln(({n} - j + 1) / j) + ln({p}D / (1 - {p}D)))"
    return f"aggregate(sequence(0L, {k}), struct({n} * ln(1 - {p}D) as term, 0D as sum), (a, j) -> struct({step} as term, a.sum + exp({step}) as sum), a -> a.sum)"


def rejects(level: tuple[int, ...]) -> Column:
    """A row with some rate at or above its cutoff."""
    return reduce(Column.__or__, (F.col(r) >= c for r, c in zip(RATES, level, strict=True)))


def cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, good, level): the labelled good documents of a stratum and the number of levels that are safe in it.

    At most len(BANDS) + 1 rows; a stratum without labels has none.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").select("doc_id")
    held = rows.where("not base_failed").join(good, "doc_id")
    lost = held.groupBy("stratum").agg(F.count("*").alias("good"), *(F.count_if(rejects(x)).alias(f"k{i}") for i, x in enumerate(LEVELS)))
    budget = lost.withColumn("error", delta * F.col("good") / F.sum("good").over(Window.partitionBy()))
    safe = F.array(*((F.col(f"k{i}") < alpha * F.col("good")) & (F.expr(tail("good", f"k{i}", alpha)) <= F.col("error")) for i in range(len(LEVELS))))
    first = F.array_position(safe, False)
    return budget.select("stratum", "good", F.when(first == 0, len(LEVELS)).otherwise(first - 1).cast("int").alias("level"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base signals, base_failed, kept, and the level that holds in the row's stratum (0: none)."""
    rows = rated(common.table(signals(docs), "signals"))
    found = rows.join(F.broadcast(cutoffs(rows, labels)), "stratum", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    over = reduce(Column.__or__, ((F.col("level") == i + 1) & rejects(x) for i, x in enumerate(LEVELS)))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~over).alias("kept"), "level")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all documents."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_LEVEL_ROWS = ", ".join(f"({i + 1}, {', '.join(map(str, x))})" for i, x in enumerate(LEVELS))
_BAND = " + ".join(f"CASE WHEN n_words >= {b} THEN 1 ELSE 0 END" for b in BANDS)
OP5_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)
), f AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM g) WHERE c > 1
), c AS (
  SELECT r, sum(least(3, coalesce(i - before, 3))) AS n_repeat_words FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM f) GROUP BY r
), s AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_BAND} AS stratum,
         CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbol_rate, CASE WHEN n_words > 0 THEN 1000 * n_dup_lines // n_words ELSE 0 END AS line_rate,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_rate, CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS length_rate
  FROM s
), l AS (
  SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1
), v(level, sy, li, re, le) AS (VALUES {_LEVEL_ROWS}),
q AS (
  SELECT stratum, level, count(*) AS n, count(*) FILTER (symbol_rate >= sy OR line_rate >= li OR repeat_rate >= re OR length_rate >= le) AS k
  FROM b JOIN l USING (doc_id) CROSS JOIN v WHERE NOT base_failed GROUP BY stratum, level
), e AS (
  SELECT stratum, level, n, k, {DELTA} * n / (SELECT sum(n) FROM q WHERE level = 1) AS error FROM q
), p AS (
  SELECT stratum, level, any_value(error) AS error, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA}))) AS chance
  FROM (SELECT *, unnest(generate_series(0, k::BIGINT)) AS j FROM e WHERE k < {ALPHA} * n) GROUP BY stratum, level
), z AS (
  SELECT s.stratum, s.level, x.sy, x.li, x.re, x.le FROM (
    SELECT stratum, max(level) AS level FROM p o WHERE level = (SELECT count(*) FROM p i WHERE i.stratum = o.stratum AND i.level <= o.level AND i.chance <= i.error) GROUP BY stratum) s
  JOIN v x ON x.level = s.level
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(symbol_rate >= sy OR line_rate >= li OR repeat_rate >= re OR length_rate >= le, false) AS kept, coalesce(level, 0) AS level
FROM b LEFT JOIN z USING (stratum)
"""
