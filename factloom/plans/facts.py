"""Fact tables over the driver's tables, each with the SQL of the same mapping.

Findings come from events, verdicts from documents and labels, baselines and line hits from orders and lineitem, taint
labels and intervals from lineitem, graphs from part and events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.registry import load
from factloom.storage import parted

#: Bug types that stand in for the event types; two of them are variants of a third.
EVENT_BUGS = {"view": "SSRF", "click": "FULL_SSRF", "error": "DIV_ZERO", "purchase": "REFLECTED_XSS", "signup": "DOM_XSS"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_BUGS.items()) + " ELSE 'UNKNOWN' END"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, bug_type, location, confidence, call_chain, tainted_sources)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.expr(_CASE).alias("bug_type"),
        F.col("user_id").cast("string").alias("location"),
        F.least(F.col("value") / 600, F.lit(1.0)).alias("confidence"),
        F.array(F.col("user_id").cast("string"), (k % 5).cast("string")).alias("call_chain"),
        F.array(F.concat(F.lit("s"), k.cast("string"))).alias("tainted_sources"),
    )


FINDINGS = f"""findings AS (
  SELECT event_id AS seq, {_CASE} AS bug_type, CAST(user_id AS VARCHAR) AS location, least(value / 600, 1.0) AS confidence,
         CAST(user_id AS VARCHAR) || '>' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 5 AS VARCHAR) AS chain,
         's' || json_extract_string(props, '$.k') AS source
  FROM events)"""


def sarif_rows(spark: SparkSession, sf_dir: str, current: bool) -> DataFrame:
    """(seq, rule, qualname, uri): scan results of orders, before or after a cut date."""
    later = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")
    return load(spark, sf_dir, "orders").where(later if current else ~later).select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("rule"), F.col("o_orderstatus").alias("qualname"), F.col("o_custkey").cast("string").alias("uri")
    )


def _sarif_sql(name: str, test: str) -> str:
    return f"""{name} AS (SELECT o_orderkey AS seq, o_orderpriority AS rule, o_orderstatus AS qualname, CAST(o_custkey AS VARCHAR) AS uri,
  o_orderpriority || '::' || o_orderstatus || '::' || CAST(o_custkey AS VARCHAR) AS fp FROM orders WHERE o_orderdate {test} TIMESTAMP '1998-01-01')"""


CURRENT, BASELINE = _sarif_sql("current_", ">="), _sarif_sql("baseline", "<")


def line_hits(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """(file, line, bug_type): distinct hits of one of two tools."""
    rows = load(spark, sf_dir, "lineitem").where(F.col("l_suppkey") % 2 == side)
    rows = rows.select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") * 2).alias("line"), F.col("l_returnflag").alias("bug_type"))
    return parted(rows, "file", "line", "bug_type").distinct()


def _hits_sql(name: str, side: int) -> str:
    return f"{name} AS (SELECT DISTINCT l_orderkey AS file, l_linenumber * 2 AS line, l_returnflag AS bug_type FROM lineitem WHERE l_suppkey % 2 = {side})"


LEFT_HITS, RIGHT_HITS = _hits_sql("lhs", 0), _hits_sql("rhs", 1)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, bug_type, expected, tool, predicted, runtime): three simple tools over labelled documents."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(load(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    size = F.col("n_chars")
    tools = F.array(
        F.struct(F.lit("short").alias("tool"), F.when(size < 900, "BUG").when(size > 9000, "ERROR").otherwise("SAFE").alias("predicted")),
        F.struct(F.lit("long").alias("tool"), F.when(size > 3000, "BUG").when(size < 200, "UNKNOWN").otherwise("SAFE").alias("predicted")),
        F.struct(F.lit("odd").alias("tool"), F.when(size % 2 == 1, "BUG").when(size % 10 == 0, "UNKNOWN").otherwise("SAFE").alias("predicted")),
    )
    rows = docs.where(F.col("toxic").isNotNull() & size.isNotNull()).select("doc_id", F.col("lang").alias("bug_type"), F.when(F.col("toxic") == 1, "BUG").otherwise("SAFE").alias("expected"), size.alias("n"), F.explode(tools).alias("t"))
    return rows.select(F.col("doc_id").alias("case_id"), "bug_type", "expected", "t.tool", "t.predicted", ((F.col("n") % 97) / 10).alias("runtime"))


VERDICTS = """verdicts AS (
  SELECT doc_id AS case_id, lang AS bug_type, CASE WHEN toxic = 1 THEN 'BUG' ELSE 'SAFE' END AS expected, tool, (n_chars % 97) / 10 AS runtime,
         CASE tool WHEN 'short' THEN CASE WHEN n_chars < 900 THEN 'BUG' WHEN n_chars > 9000 THEN 'ERROR' ELSE 'SAFE' END
                   WHEN 'long' THEN CASE WHEN n_chars > 3000 THEN 'BUG' WHEN n_chars < 200 THEN 'UNKNOWN' ELSE 'SAFE' END
                   ELSE CASE WHEN n_chars % 2 = 1 THEN 'BUG' WHEN n_chars % 10 = 0 THEN 'UNKNOWN' ELSE 'SAFE' END END AS predicted
  FROM documents JOIN labels USING (doc_id) CROSS JOIN (VALUES ('short'), ('long'), ('odd')) AS t(tool) WHERE toxic IS NOT NULL AND n_chars IS NOT NULL)"""


def taint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tau, kappa, sigma, sink, source) of line items."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.expr("shiftleft(1L, cast(l_partkey % 9 as int))").alias("tau"),
        F.pmod(F.col("l_orderkey") * 2654435761, F.lit(4294967296)).alias("kappa"),
        F.expr("shiftleft(1L, cast(9 + l_suppkey % 7 as int))").alias("sigma"),
        (F.col("l_linenumber") * 4 % 32).cast("int").alias("sink"),
        F.col("l_suppkey").alias("source"),
    )


TAINT = """taint AS (
  SELECT l_orderkey AS id, CAST(1 AS BIGINT) << CAST(l_partkey % 9 AS INT) AS tau, (l_orderkey * 2654435761) % 4294967296 AS kappa,
         CAST(1 AS BIGINT) << CAST(9 + l_suppkey % 7 AS INT) AS sigma, CAST(l_linenumber * 4 % 32 AS INT) AS sink, l_suppkey AS source FROM lineitem)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, alo, ahi, blo, bhi): two intervals of each order; the second may hold 0."""
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.min("l_quantity").alias("alo"), F.max("l_quantity").alias("ahi"), F.min(F.round(F.col("l_discount") - 0.02, 4)).alias("blo"), F.max(F.round(F.col("l_discount") - 0.02, 4)).alias("bhi")
    )


INTERVALS = """intervals AS (
  SELECT l_orderkey AS id, min(l_quantity) AS alo, max(l_quantity) AS ahi, min(round(l_discount - 0.02, 4)) AS blo, max(round(l_discount - 0.02, 4)) AS bhi
  FROM lineitem GROUP BY l_orderkey)"""


def part_edges(spark: SparkSession, sf_dir: str, most: int = 200) -> DataFrame:
    """(src, dst): a functional graph with cycles over all parts, in modules of `most`; calls stay within a module."""
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(k.alias("src"), (k - k % most + (k * 3 + F.col("p_size")) % most).alias("dst"))


EDGES = "edges AS (SELECT p_partkey AS src, p_partkey - p_partkey % 200 + (p_partkey * 3 + p_size) % 200 AS dst FROM part)"


def file_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, seq, verdict, bug_types): states of a file in order of time."""
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type").isin("error", "signup"), "BUG").otherwise("SAFE").alias("verdict"),
        F.expr("case event_type when 'error' then array('DIV_ZERO') when 'signup' then array('DIV_ZERO', 'NULL_PTR') else cast(array() as array<string>) end").alias("bug_types"),
    )


SCANS = """scans AS (SELECT user_id AS file, event_id AS seq, CASE WHEN event_type IN ('error', 'signup') THEN 'BUG' ELSE 'SAFE' END AS verdict,
  CASE event_type WHEN 'error' THEN ['DIV_ZERO'] WHEN 'signup' THEN ['DIV_ZERO', 'NULL_PTR'] ELSE CAST([] AS VARCHAR[]) END AS bug_types FROM events)"""
