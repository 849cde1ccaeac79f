"""Findings as a stream: deduplication within a watermark, counts by window, and open bugs by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """stream(ts, bug_type, location, ...): the first finding of each (bug_type, location) within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["bug_type", "location"])


def counts(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Findings by bug type and window of time."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "bug_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "bug_type", "n")


def state_changes(stream: DataFrame) -> DataFrame:
    """stream(file, seq, verdict) -> (file, seq, event) where a file's verdict changes; each file's last verdict is kept as state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        was = state.get[0] if state.exists else "MISSING"
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, verdict in zip(rows.seq, rows.verdict, strict=True):
            if (verdict == "BUG") != (was == "BUG"):
                out.append((key[0], seq, "BUG_INTRODUCED" if verdict == "BUG" else "BUG_FIXED"))
            was = verdict
        state.update((was,))
        yield pd.DataFrame(out, columns=["file", "seq", "event"])

    return stream.select("file", "seq", "verdict").groupBy("file").applyInPandasWithState(run, "file long, seq long, event string", "verdict string", "append", GroupStateTimeout.NoTimeout)
