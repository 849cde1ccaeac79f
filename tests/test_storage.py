"""Scratch tables: they can be read again, can be deleted, and leave the session's settings alone."""

import os

import pytest
from pyspark.sql import functions as F

from factloom import storage


def test_tables_survive_and_release_deletes(spark):
    was = spark.conf.get("spark.checkpoint.dir", None)
    df = storage.cut(spark.range(10).select((F.col("id") % 3).alias("k")))
    path = storage._made[-1].removeprefix("file://")
    assert df.count() == 10 and os.path.isdir(path) and spark.conf.get("spark.checkpoint.dir", None) == was
    kept, storage._made[:] = storage._made[:-1], storage._made[-1:]
    storage.release(spark)
    storage._made[:] = kept
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "yarn"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_large_tables_do_not_go_through_the_driver(spark):
    """Tables of a few MB, which Spark would broadcast in every round of a loop, are joined by merging; small ones as Spark sees fit."""
    from factloom.operators.graph import Seen

    rows = lambda n: spark.range(n).select("id", F.xxhash64("id").alias("x"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    large = storage.cut(rows(200_000))
    seen = Seen(large)
    seen.add(storage.cut(rows(10)))
    for one in (large, storage.Latest().put(rows(200_000)), storage.Latest().put_count(rows(200_000))[0], seen.all()):
        for how in ("inner", "left", "left_semi", "left_anti"):
            assert "BroadcastHashJoin" not in plan(rows(300_000).join(one.select("id"), "id", how)), how
    assert "BroadcastHashJoin" in plan(rows(300_000).join(storage.cut(rows(10)).select("id"), "id"))


def test_loose_matches_of_large_files_are_made_in_more_parts(spark, tmp_path, monkeypatch):
    from factloom.operators import matching

    spark.range(30_000).selectExpr("id div 10 as file", "cast(id % 10 * 4 as int) as line", "'X' as bug_type").write.parquet(str(tmp_path / "l"))
    spark.range(30_000).selectExpr("id div 10 as file", "cast(id % 10 * 4 + id div 10 % 5 as int) as line", "'X' as bug_type").write.parquet(str(tmp_path / "r"))
    monkeypatch.setattr(storage, "PART_BYTES", 2_000)
    left, right = spark.read.parquet(str(tmp_path / "l")), spark.read.parquet(str(tmp_path / "r"))
    found = matching.loose_match(left, right)
    assert found.rdd.getNumPartitions() == storage.parts(left, right) > 4
    # files are shifted by 0 to 4: by 0 and 4 lines are equal, but for the first or last by 4, which are 40 lines apart
    near = found.groupBy((F.col("file") % 5).alias("shift")).agg(F.count("*").alias("n"), F.min(F.col("right_line") - F.col("line")).alias("lo"), F.max(F.col("right_line") - F.col("line")).alias("hi"))
    assert {r["shift"]: (r.n, r.lo, r.hi) for r in near.collect()} == {1: (6000, -3, 1), 2: (6000, -2, 2), 3: (6000, -1, 3)}


def test_rounds_follow_what_was_found(spark):
    """A frontier that is small against all that was found takes several steps, at any size; rows that later ones replace do not pile up."""
    from factloom.operators import graph

    assert graph.steps(2_000_000, 40_000_000) == graph.STEPS and graph.steps(2_000_000, 20_000_000) == 1
    row = lambda v: storage.cut(spark.range(1).select("id", F.lit(v).alias("v")))
    seen = graph.Seen(row(0), most=2, merge=lambda df: df.groupBy("id").agg(F.max("v").alias("v")))
    for v in (1, 2):
        seen.add(row(v))
    assert [tuple(r) for r in seen.all().collect()] == [(0, 2)]
