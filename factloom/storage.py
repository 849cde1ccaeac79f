"""Scratch tables in the folder that all executors share, which cut the lineage of loops and of long plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_own: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where that is unset a session on one machine gets a temporary folder of its own; on a cluster this raises, since executors
    would not see each other's files.  The session's settings are left as they are.
    """
    where = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"{_SETTING} is not set: name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="factloom-"))
    return _own[0]


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder.  What this process made goes when it ends, or earlier by release()."""
    if not _made:
        atexit.register(_sweep)
    _made.append(f"{shared_dir(spark)}/factloom/{what}-{uuid.uuid4().hex}")
    return _made[-1]


def cut(df: DataFrame, what: str = "round") -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.  One job; a lost executor costs a reread."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return _read(df, path)


#: Scratch tables of more bytes are joined by merging.  Spark takes the size of the files for that of the rows, which are several times as large.
BROADCAST_BYTES = 256 << 10


def _read(df: DataFrame, path: str) -> DataFrame:
    """The table that df was written to.  A large one has the hint to be joined by merging: broadcasts go through the driver, in every round of a loop."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    found = spark.read.schema(df.schema).parquet(path)
    return found.hint("merge") if size > BROADCAST_BYTES else found


def cut_count(df: DataFrame, what: str = "round") -> tuple[DataFrame, int]:
    """cut() and the number of rows, counted while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")), what)
    return out, int(seen.get.get("rows") or 0)


class Latest:
    """The table of a loop's last round: put() writes the next and then deletes the one before, so a loop holds two tables at most.

    Only for loops whose rounds read nothing but the last table: what was made of an older one becomes unreadable.
    """

    def __init__(self, what: str = "round"):
        self.what, self.path = what, None

    def put(self, df: DataFrame) -> DataFrame:
        """cut() into the place of the last round."""
        spark, old = df.sparkSession, self.path
        self.path = scratch(spark, self.what)
        df.write.parquet(self.path)
        if old is not None:
            delete(spark, old)
            _made.remove(old)
        return _read(df, self.path)

    def put_count(self, df: DataFrame, test=None) -> tuple[DataFrame, int]:
        """put() and the number of rows, or of those where test holds."""
        seen = Observation()
        out = self.put(df.observe(seen, F.count_if(F.lit(True) if test is None else test).alias("rows")))
        return out, int(seen.get.get("rows") or 0)


#: Tasks a core that rows are dealt over before Python parses what is made of them.
TASKS_A_CORE = 4


def dealt(rows: DataFrame) -> DataFrame:
    """rows over all cores, before texts are made of them and parsed: a file of a few MB holds rows for minutes of parsing, and is read by one task or two."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism))


#: Bytes of input files for each part that rows are dealt into before they are grouped.
PART_BYTES = 8 << 20


def parts(*tables: DataFrame) -> int:
    """In how many parts to group rows of these tables: more for larger input files, so that the groups of one task stay as many; the session's number at least."""
    spark = tables[0].sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    size = 0
    for file in {f for t in tables for f in t.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        size += where.getFileSystem(conf).getFileStatus(where).getLen()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def parted(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys into `parts` parts."""
    return rows.repartition(parts(rows), *keys)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this process, on any store; results that were not saved become unreadable."""
    for path in _made:
        delete(spark, path)
    _made.clear()


def _sweep() -> None:
    for path in _made + _own:
        if (local := path.removeprefix("file://")).startswith("/"):
            shutil.rmtree(local, ignore_errors=True)
