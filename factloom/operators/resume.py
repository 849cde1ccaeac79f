"""Long scans that can be taken up again: results are kept by path and content, in batches that count only once they are whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.storage import delete

#: The file that Spark's writer leaves when a write is complete.
DONE = "_SUCCESS"
KEYS = ["path", "content"]


def _folders(spark: SparkSession, store: str) -> tuple[list[str], list[str]]:
    """Batches that are whole, and those that are not."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return [], []
    whole, broken = [], []
    for status in fs.listStatus(where):
        path = status.getPath()
        done = fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, DONE))
        (whole if done else broken).append(path.toString())
    return sorted(whole), broken


def results(spark: SparkSession, store: str) -> DataFrame | None:
    """The results of all whole batches; None before the first."""
    whole, _ = _folders(spark, store)
    return spark.read.parquet(*whole) if whole else None


def keyed(files: DataFrame) -> DataFrame:
    """files(path, text, ...) with content, the hash of the text; a null text is a file that is missing, and has no content."""
    return files.withColumn("content", F.sha2("text", 256))


def scan(files: DataFrame, analyse: Callable[[DataFrame], DataFrame], store: str, batches: int = 8) -> DataFrame:
    """The results of analyse for every row of files(revision, path, text).

    analyse takes (path, content, text) and returns rows with path and content, at least one for each.  Each content of a path is analysed once,
    whatever the revisions that hold it.  What `store` has of earlier runs is not analysed again; the rest is dealt by hash into batches,
    each of which is written on its own.  A run that is stopped loses its last batch, which the next run deletes.  One run at a time
    writes to a store.  Rows of missing files come without results.
    """
    spark = files.sparkSession
    _, broken = _folders(spark, store)
    for path in broken:
        delete(spark, path)
    rows = keyed(files)
    todo = rows.where("content is not null").select(*KEYS, "text").dropDuplicates(KEYS)
    known = results(spark, store)
    if known is not None:
        todo = todo.join(known.select(*KEYS).distinct(), KEYS, "left_anti")
    for i in range(batches):
        part = todo.where(F.pmod(F.xxhash64(*KEYS), F.lit(batches)) == i)
        analyse(part).write.parquet(f"{store.rstrip('/')}/batch-{i}-{uuid.uuid4().hex}")
    found = results(spark, store)
    return rows.drop("text").join(found, KEYS, "left")
