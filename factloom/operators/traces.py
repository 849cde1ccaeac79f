"""Witness traces, and cascades of proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trace_features(traces: DataFrame) -> DataFrame:
    """traces(id, lines) -> (id, pos, kind, value): imports by name, exceptions whole, opcodes after the last colon."""
    rows = traces.select("id", F.posexplode("lines").alias("pos", "line"))
    last = F.trim(F.substring_index("line", ":", -1))
    opcode = F.when(F.col("line").contains(":") & (last != ""), F.substring_index(last, " ", 1))
    words = F.filter(F.split("line", r"\s+"), lambda x: x != "")
    kind = F.when(F.col("line").contains("IMPORT_NAME"), "import").when(F.col("line").contains("EXCEPTION:"), "exception").otherwise("opcode")
    value = F.when(F.col("kind") == "import", F.when(F.size(words) >= 3, F.element_at(words, -1))).when(F.col("kind") == "exception", F.trim("line")).otherwise(opcode)
    return rows.withColumn("kind", kind).select("id", "pos", "kind", value.alias("value")).where("value is not null")


def last_exception(traces: DataFrame) -> DataFrame:
    """(id, exception): the type in the last exception line, else Unknown."""
    found = F.filter("lines", lambda x: x.contains("EXCEPTION:"))
    last = F.trim(F.substring_index(F.try_element_at(found, F.lit(-1)), ":", -1))
    return traces.select("id", F.coalesce(F.when(last != "", F.substring_index(last, " ", 1)), F.lit("Unknown")).alias("exception"))


def first_proof(attempts: DataFrame, least: float = 0.60) -> DataFrame:
    """attempts(bug, ordinal, barrier, confidence): the first in order that is sure enough."""
    return attempts.where(F.col("confidence") >= least).groupBy("bug").agg(F.min_by(F.struct("barrier", "confidence"), "ordinal").alias("p")).select("bug", "p.barrier", "p.confidence")


def proof_counts(proofs: DataFrame, kinds: DataFrame) -> DataFrame:
    """(barrier, n): proofs of each kind, kinds without any too."""
    return kinds.select("barrier").join(proofs.groupBy("barrier").agg(F.count("*").alias("n")), "barrier", "left").select("barrier", F.coalesce("n", F.lit(0)).alias("n"))


def statistical_proof(likely: DataFrame, bugs: DataFrame) -> DataFrame:
    """bugs(bug, bug_type, var) proved safe by likely invariants(var, prop, confidence): nonzero from 0.90, nonnull from 0.95."""
    need = F.when(F.col("bug_type") == "DIV_ZERO", F.struct(F.lit("nonzero").alias("prop"), F.lit(0.90).alias("least"))).when(F.col("bug_type") == "NULL_PTR", F.struct(F.lit("nonnull").alias("prop"), F.lit(0.95).alias("least")))
    wanted = bugs.withColumn("need", need).select("bug", "var", F.col("need.prop").alias("prop"), F.col("need.least").alias("least"))
    return wanted.join(likely, ["var", "prop"]).where("confidence >= least").select("bug", "confidence")
