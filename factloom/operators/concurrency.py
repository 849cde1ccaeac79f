"""Races and deadlocks from access logs and lock orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unlocked_locations(accesses: DataFrame) -> DataFrame:
    """(location): two threads or more, a write, and no lock held by all accesses.  accesses(id, location, thread, is_write, locks)."""
    per = accesses.groupBy("location").agg(F.count("*").alias("n"), F.countDistinct("thread").alias("threads"), F.some("is_write").alias("writes"))
    locks = accesses.select("location", "id", F.explode(F.array_distinct("locks")).alias("lock")).groupBy("location", "lock").agg(F.count("*").alias("held"))
    common = locks.join(per.select("location", "n"), "location").where("held = n").select("location").distinct()
    return per.where("threads >= 2 and writes").select("location").join(common, "location", "left_anti")


def race_candidates(accesses: DataFrame, before: DataFrame) -> DataFrame:
    """(location, a, b): accesses of two threads to an unlocked location, one a write, that no direct edge orders.

    Pairs are made of a write and any other access.  before(a, b) lists ordered accesses; order is a lookup, not a path.
    """
    rows = accesses.join(unlocked_locations(accesses), "location", "left_semi").select("location", "id", "thread", "is_write")
    w, o = rows.where("is_write").alias("w"), rows.alias("o")
    pairs = w.join(o, (F.col("w.location") == F.col("o.location")) & (F.col("w.thread") != F.col("o.thread"))).select(F.col("w.location").alias("location"), F.least("w.id", "o.id").alias("a"), F.greatest("w.id", "o.id").alias("b")).distinct()
    ordered = before.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(ordered, ["a", "b"], "left_anti").select("location", "a", "b")


def race_counts(accesses: DataFrame, before: DataFrame) -> DataFrame:
    """(location, t1, t2, n): how many pairs race_candidates has for two threads t1 < t2 of a location, without making them.

    Pairs are counted by products of accesses; those that before(a, b) orders are looked up by id and taken off.  Ids are unique.
    """
    rows = accesses.join(unlocked_locations(accesses), "location", "left_semi").select("location", "id", "thread", "is_write")
    per = rows.groupBy("location", "thread").agg(F.count("*").alias("all"), F.count_if("is_write").alias("writes"))
    x, y = per.toDF("location", "t1", "n1", "w1"), per.toDF("location", "t2", "n2", "w2")
    made = x.join(y, "location").where("t1 < t2").select("location", "t1", "t2", F.expr("w1 * n2 + n1 * w2 - w1 * w2").alias("n"))
    ordered = before.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a = rows.select(F.col("id").alias("a"), "location", F.col("thread").alias("ta"), F.col("is_write").alias("wa"))
    b = rows.select(F.col("id").alias("b"), F.col("location").alias("lb"), F.col("thread").alias("tb"), F.col("is_write").alias("wb"))
    off = ordered.join(a, "a").join(b, "b").where("location = lb and ta <> tb and (wa or wb)")
    off = off.select("location", F.least("ta", "tb").alias("t1"), F.greatest("ta", "tb").alias("t2"), F.lit(-1).cast("long").alias("n"))
    return made.union(off).groupBy("location", "t1", "t2").agg(F.sum("n").alias("n")).where("n > 0")


def lock_order_violations(orders: DataFrame) -> DataFrame:
    """(a, b): locks taken in both orders.  orders(thread, locks)."""
    later = lambda lock, i: F.transform(F.slice("locks", i + 2, F.size("locks")), lambda other: F.struct(lock.alias("a"), other.alias("b")))
    pairs = F.array_distinct(F.flatten(F.transform("locks", later)))  # of one thread, in its row
    first = orders.select(F.explode(pairs).alias("p")).select("p.a", "p.b").where("a <> b").distinct()
    return first.intersect(first.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a < b")


def all_blocked(threads: DataFrame, waits: DataFrame) -> DataFrame:
    """One row: no thread runs and the waits-for relation has a cycle.  threads(thread, state), waits(src, dst)."""
    from factloom.operators.graph import has_cycle

    still = threads.agg(F.coalesce(F.every(F.col("state") != "running"), F.lit(False)).alias("stopped"))
    return still.crossJoin(F.broadcast(has_cycle(waits))).select((F.col("stopped") & F.col("has_cycle")).alias("deadlock"))
