"""Bug history: events between successive scans of a file, and lifetimes of bugs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def file_events(scans: DataFrame) -> DataFrame:
    """scans(file, seq, verdict, bug_types) -> the event of each scan against the one before it, with new and fixed types."""
    w = Window.partitionBy("file").orderBy("seq")
    none = F.array().cast("array<string>")
    before = F.coalesce(F.lag("verdict").over(w), F.lit("MISSING"))
    types = F.coalesce(F.lag("bug_types").over(w), none)
    was, is_ = F.col("before") == "BUG", F.col("verdict") == "BUG"
    event = F.when(~was & is_, "BUG_INTRODUCED").when(was & ~is_, "BUG_FIXED").when(was & is_, "PERSISTS").otherwise("CLEAN")
    rows = scans.select("*", before.alias("before"), types.alias("types_before"))
    return rows.select("file", "seq", event.alias("event"), F.array_sort(F.array_except("bug_types", "types_before")).alias("new_types"), F.array_sort(F.array_except("types_before", "bug_types")).alias("fixed_types"))


def lifetimes(events: DataFrame) -> DataFrame:
    """(file, bug_type, introduced, fixed): each introduction with the next fix in time.

    fixed is null for a bug still present, introduced is null for one that was there before the first scan.
    """
    mark = lambda c, kind: events.select("file", "seq", F.explode(c).alias("bug_type"), F.lit(kind).alias("kind"))
    marks = mark("new_types", "new").union(mark("fixed_types", "fixed"))
    w = Window.partitionBy("file", "bug_type").orderBy("seq")
    seen = marks.select("*", F.lead("kind").over(w).alias("next_kind"), F.lead("seq").over(w).alias("next_seq"), F.lag("kind").over(w).alias("last_kind"))
    opened = seen.where("kind = 'new'").select("file", "bug_type", F.col("seq").alias("introduced"), F.when(F.col("next_kind") == "fixed", F.col("next_seq")).alias("fixed"))
    earlier = seen.where("kind = 'fixed' and (last_kind is null or last_kind = 'fixed')").select("file", "bug_type", F.lit(None).cast("long").alias("introduced"), F.col("seq").alias("fixed"))
    return opened.union(earlier)


def event_counts(events: DataFrame) -> DataFrame:
    """Count by event."""
    return events.groupBy("event").agg(F.count("*").alias("n"))
