"""Operations on plain records: validation, transforms, lookups, chunks, slices, ranks, sums.

Where order matters, an explicit column says so (seq).  Empty groups give null, not an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(schema: dict[str, str]) -> Column:
    """All fields present and of their type."""
    out = F.lit(True)
    for f, t in schema.items():
        out = out & F.col(f).isNotNull() & (F.typeof(f) == t)
    return out


def in_range(c: Column, low, high) -> Column:
    return c.between(low, high)


def short_enough(c: Column, most: int) -> Column:
    """A null is short enough."""
    return F.coalesce(F.length(c) <= most, F.lit(True))


def tidy(df: DataFrame) -> DataFrame:
    """Every string field trimmed and lower-cased."""
    return df.select(*(F.lower(F.trim(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def process_batch(df: DataFrame, schema: dict[str, str], transforms=()) -> DataFrame:
    """Valid records, transformed one step after the other."""
    df = df.where(valid(schema))
    for f in transforms:
        df = df.transform(f)
    return df


def field(path: str) -> Column:
    """A field of nested records by its dotted path."""
    return F.col(path)


def split_by_key(df: DataFrame, key: str) -> DataFrame:
    """Rows of each key as a list, null a key of its own."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias("rows"))


def merge_records(df: DataFrame) -> DataFrame:
    """(key, value): the last value (by seq) of each key."""
    return df.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


#: Ranges of the order column that a table without groups is numbered in.
RANGES = 256


#: Parts that the rows of one frequent value of the order column are dealt into.
TIES = 64


def _numbered(df: DataFrame, order: str, by: list[str]) -> DataFrame:
    """Rows with their place _n from 0, within groups or over the whole table.

    A whole table is cut into ranges of its numeric order column, numbered inside each, and shifted by the rows of the ranges
    before; no task sees all rows.  A value that fills a range begins it, and its rows, whose order among
    themselves is free, are dealt into TIES parts of that range.
    """
    if by:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    cuts = df.stat.approxQuantile(order, [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES)
    bounds, heavy = sorted(set(cuts)), sorted({x for x in cuts if cuts.count(x) > 2})
    where = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>")
    tie = F.when(F.col(order).isin(*heavy), F.pmod(F.xxhash64(*df.columns), F.lit(TIES))).otherwise(TIES) if heavy else F.lit(TIES)
    ranged = df.withColumn("_range", F.size(F.filter(where, lambda x: x <= F.col(order)))).withColumn("_tie", tie.cast("int"))
    sizes = ranged.groupBy("_range", "_tie").agg(F.count("*").alias("_rows"))
    upto = Window.orderBy("_range", "_tie").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES x TIES rows
    before = sizes.select("_range", "_tie", F.coalesce(F.sum("_rows").over(upto), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range", "_tie").orderBy(order)) - 1
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), ["_range", "_tie"]).withColumn("_n", F.col("_inside") + F.col("_before")).drop("_range", "_tie", "_inside", "_before")


def _total(df: DataFrame, by: list[str]) -> Column:
    return F.count("*").over(Window.partitionBy(*by)) if by else F.lit(df.count())


def chunks(df: DataFrame, size: int, order: str = "seq", by: list[str] | None = None) -> DataFrame:
    """Rows with the number of their full chunk; a remainder is dropped."""
    by = by or []
    rows = _numbered(df, order, by).withColumn("chunk", F.floor(F.col("_n") / size))
    full = F.count("*").over(Window.partitionBy(*by, "chunk")) == size
    return rows.withColumn("_full", full).where("_full").drop("_n", "_full")


def split_evenly(df: DataFrame, parts: int, order: str = "seq", by: list[str] | None = None) -> DataFrame:
    """Rows with the number of their chunk of n div parts rows; a remainder makes chunks of its own; groups too small are dropped."""
    by = by or []
    total = _total(df, by)
    rows = _numbered(df, order, by).withColumn("_size", F.floor(total / parts)).where("_size > 0")
    return rows.withColumn("chunk", F.floor(F.col("_n") / F.col("_size"))).drop("_n", "_size")


def batch(df: DataFrame, index: int, size: int, order: str = "seq", by: list[str] | None = None) -> DataFrame:
    """Rows [index * size, (index + 1) * size) in order."""
    return _numbered(df, order, by or []).where((F.col("_n") >= index * size) & (F.col("_n") < (index + 1) * size)).drop("_n")


def split_train_test(df: DataFrame, ratio: float, order: str = "seq", by: list[str] | None = None) -> DataFrame:
    """Rows with is_train: the first int(n * ratio) of them."""
    by = by or []
    total = _total(df, by)
    return _numbered(df, order, by).withColumn("is_train", F.col("_n") < F.floor(total * ratio)).drop("_n")


def ranked(df: DataFrame, score: str, order: str = "seq", by: list[str] | None = None) -> DataFrame:
    """Rows with their place from 0 by falling score, input order among equals."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(F.desc(score), order)) - 1)


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    """A repeatable shuffle: rows by the hash of a key."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def gather(df: DataFrame, indices: list[int], order: str = "seq") -> DataFrame:
    """Rows at given places, repeats kept."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(indices)), "pos int, _n int")
    return _numbered(df, order, []).join(wanted, "_n").drop("_n")


def trapezoid(points: DataFrame, by: list[str], x: str = "fpr", y: str = "tpr", order: str = "idx") -> DataFrame:
    """Area under consecutive points by group."""
    w = Window.partitionBy(*by).orderBy(order)
    step = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return points.select(*by, step.alias("a")).groupBy(*by).agg(F.round(F.coalesce(F.sum("a"), F.lit(0.0)), 6).alias("auc"))


def learning_rate(base: float, decay: float, epoch: Column) -> Column:
    """Decay by epoch."""
    return F.lit(base) * F.pow(F.lit(decay), epoch)


def discount(price: Column, percent: Column) -> Column:
    return price * (1 - percent / 100)


def coupon_total(cart: DataFrame, coupons: DataFrame) -> DataFrame:
    """(cart_id, total): the sum less its coupon; an unknown coupon takes nothing off."""
    sums = cart.groupBy("cart_id", "code").agg(F.sum(F.col("price") * F.col("qty")).alias("sum"))
    return sums.join(coupons, "code", "left").select("cart_id", F.round(F.col("sum") * (1 - F.coalesce("rate", F.lit(0.0))), 4).alias("total"))


def collisions(players: DataFrame) -> DataFrame:
    """(a, b): every player that shares a place with others, beside the first of that place.

    A place of n players gives n - 1 rows, from which all their pairs follow: two players collide if they are named with the
    same first one.
    """
    first = players.groupBy("x", "y").agg(F.min("id").alias("a"))
    return players.join(first, ["x", "y"]).where("id > a").select("a", F.col("id").alias("b"))


@dataclass(frozen=True)
class Selection:
    """What to take from a table: some columns (all if none are named), rows that pass every test, an order, a number of rows.

    Tests and order are SQL expressions or columns.  A number of 0 or less stands for no limit.  The plan is Spark's own:
    of() says what is wanted, and filters and columns reach the scan.
    """

    columns: tuple[str | Column, ...] = ()
    tests: tuple[str | Column, ...] = ()
    order: tuple[str | Column, ...] = ()
    rows: int = 0

    def of(self, table: DataFrame) -> DataFrame:
        kept = reduce(DataFrame.where, self.tests, table)
        kept = kept.orderBy(*self.order) if self.order else kept
        kept = kept.select(*self.columns) if self.columns else kept
        return kept.limit(self.rows) if self.rows > 0 else kept


def equal_to(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column has a value, such as a category or a status; null is a value of its own."""
    return df.where(F.col(column).eqNullSafe(F.lit(value)))


def holding(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose text holds a part, whatever the case; no character of it is a wildcard.  A null text holds nothing."""
    return df.where(F.contains(F.lower(column), F.lit(part.lower())))


def flagged(df: DataFrame, flag: str, *columns: str) -> DataFrame:
    """Rows whose flag is true, with some of their columns (all if none are named)."""
    kept = df.where(F.col(flag))
    return kept.select(*columns) if columns else kept


def element(values: Column, index: int) -> Column:
    """The index-th element from 0 of an array, or null."""
    return F.get(values, F.lit(index))


def normalized(values: Column, most: Column) -> Column:
    """Every element of an array over the greatest value; null where that is 0."""
    return F.transform(values, lambda x: F.try_divide(x, most))


def tax(subtotal: Column, rate: Column) -> Column:
    return subtotal * rate


def lookup(df: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows that a table of keys asks for; keys without a row are left out."""
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def first_dependency(tasks: DataFrame) -> DataFrame:
    """tasks(task, deps array) -> (task, needs, found): the first dependency and whether it is a task; null if there is none."""
    known = tasks.select(F.col("task").alias("needs"), F.lit(True).alias("found")).distinct()
    return tasks.select("task", F.get("deps", F.lit(0)).alias("needs")).join(known, "needs", "left").select("task", "needs", F.coalesce("found", F.lit(False)).alias("found"))


def first_failure(results: DataFrame, *by: str) -> DataFrame:
    """The first row, by seq, of each group whose success is false; groups without one have no row."""
    failed = results.where(~F.col("success"))
    return failed.groupBy(*by).agg(F.min_by(F.struct(*(c for c in results.columns if c not in by)), "seq").alias("r")).select(*by, "r.*")


def where_part(clause: Column, index: int) -> Column:
    """The index-th test of a clause, from the end if negative; null if there is none."""
    return F.try_element_at(F.split(clause, " AND "), F.lit(index + 1 if index >= 0 else index))
