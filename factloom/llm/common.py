"""Shared helpers of the training-data operators: scratch tables, Arrow text access, samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.storage import release, scratch  # noqa: F401  release is for callers

#: The white space that separates words in the text contracts (fixed value: space, tab to carriage return).
WORD_SPACE = " \t\n\x0b\f\r"

#: Held-out remainder of crc32(doc_id as text) mod 4; labels of these rows are never learned from.
HELD_OUT_REMAINDER = 2


#: Most texts in an Arrow batch between Spark and a Python worker; batches of numbers may be larger.
TEXTS_A_BATCH, NUMBERS_A_BATCH = 1_000, 4_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small in this session: they are held by the JVM and by the worker at once."""
    if not 0 < int(spark.conf.get(_BATCH)) <= TEXTS_A_BATCH:
        spark.conf.set(_BATCH, str(TEXTS_A_BATCH))


_holder: dict = {}


def claim(name: str, release: Callable[[], None]) -> None:
    """Called where a task of an operator starts: what another operator remembered in this worker is let go."""
    if _holder.get("name") not in (None, name):
        _holder["release"]()
    _holder.update(name=name, release=release)


def table(df: DataFrame, what: str, numbers: bool = False) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.  Survives lost executors.

    numbers: rows that go through Python are narrow, so batches may be larger while this is written.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    was = spark.conf.get(_BATCH)
    if numbers:
        spark.conf.set(_BATCH, str(NUMBERS_A_BATCH))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, was)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The strings of a column; null becomes empty."""
    return [x or "" for x in column.to_pylist()]


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 4 is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT_REMAINDER


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label): labels that may be learned from.  Null ids and labels are left out, repeats take the largest."""
    return (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def bounded_sample(docs: DataFrame, chosen: DataFrame, bound: int, seed: int, extra: list[str]) -> DataFrame:
    """At most `bound` documents whose doc_id is in `chosen`, picked by hash, with distinct ids and texts, as a scratch table."""
    ids = chosen.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(bound)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    least = lambda *rest: F.min(F.struct(*rest)).alias("r")  # noqa: E731  not any row, so that reruns agree
    by_text = rows.groupBy("text").agg(least("doc_id", *extra)).select("text", "r.*")
    by_id = by_text.groupBy("doc_id").agg(least("text", *extra)).select("doc_id", "r.*")
    return table(by_id.select("doc_id", "text", *extra), "sample")


def int_lists(values: np.ndarray, lengths: list[int]) -> pa.Array:
    """A list<int> column from its flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def blocks(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `limit` bytes of text, so that memory stays bounded."""
    data = batch.column(column)
    sizes = np.nan_to_num(np.array(pc.binary_length(data).to_numpy(zero_copy_only=False), float))
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0.0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
