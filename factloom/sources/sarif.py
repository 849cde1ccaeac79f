"""SARIF results: reading, building from findings, writing; baselines as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "version string, runs array<struct<tool:struct<driver:struct<name:string,rules:array<struct<id:string>>>>,results:array<struct<ruleId:string,ruleIndex:int,level:string,message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string,uriBaseId:string>,region:struct<startLine:int,snippet:struct<text:string>>>,"
    "logicalLocations:array<struct<fullyQualifiedName:string,kind:string>>>>,properties:struct<dseConfirmed:boolean,bugType:string,qualifiedName:string,counterexample:map<string,string>>>>>>"
)
BASELINE = "version int, findings map<string,struct<ruleId:string,qualifiedName:string,message:string>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a result: (seq, rule, qualname, uri, line, message); a malformed file fails."""
    runs = spark.read.schema(SCHEMA).json(path, multiLine=True, mode="FAILFAST").select(F.posexplode("runs").alias("run", "r"))
    rows = runs.select("run", F.posexplode("r.results").alias("pos", "x"))
    first = F.try_element_at("x.locations", F.lit(1))
    return rows.select(
        (F.col("run") * 1_000_000_000 + F.col("pos")).cast("long").alias("seq"), F.col("x.ruleId").alias("rule"),
        F.coalesce(F.col("x.properties.qualifiedName"), F.try_element_at(first["logicalLocations"], F.lit(1))["fullyQualifiedName"]).alias("qualname"),
        first["physicalLocation"]["artifactLocation"]["uri"].alias("uri"), first["physicalLocation"]["region"]["startLine"].alias("line"), F.col("x.message.text").alias("message"),
    )


def rules(results: DataFrame) -> DataFrame:
    """(rule, rule_index): distinct rules in order from 0."""
    from pyspark.sql import Window

    return results.select("rule").distinct().withColumn("rule_index", F.row_number().over(Window.orderBy("rule")) - 1)


def suppress_proven(confirmed: DataFrame, others: DataFrame, by: str = "qualname") -> DataFrame:
    """Confirmed results first, and others of functions without any confirmed one."""
    rest = others.join(confirmed.select(by).distinct(), by, "left_anti")
    return confirmed.withColumn("confirmed", F.lit(True)).unionByName(rest.withColumn("confirmed", F.lit(False)))


def _result(rule: Column, index: Column, qualname: Column, uri: Column, line: Column) -> Column:
    """A SARIF result object."""
    place = F.struct(
        F.struct(F.struct(uri.alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), F.struct(line.alias("startLine")).alias("region")).alias("physicalLocation"),
        F.array(F.struct(qualname.alias("fullyQualifiedName"), F.lit("function").alias("kind"))).alias("logicalLocations"),
    )
    return F.struct(
        rule.alias("ruleId"), index.alias("ruleIndex"), F.lit("error").alias("level"), F.struct(F.concat_ws(" in ", rule, qualname).alias("text")).alias("message"),
        F.array(place).alias("locations"), F.struct(qualname.alias("qualifiedName")).alias("properties"),
    )


def build(results: DataFrame) -> DataFrame:
    """(seq, ruleId, json): one SARIF result object a row, with the index of its rule among all.  Written as text, they are JSON lines."""
    c = F.col
    named = results.join(rules(results), "rule")
    return named.select("seq", c("rule").alias("ruleId"), F.to_json(_result(c("rule"), c("rule_index"), c("qualname"), c("uri"), F.coalesce("line", F.lit(1)))).alias("json"))


#: Most results, or accepted findings, of one document about.
A_DOCUMENT = 10_000


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows with `part`: documents of about A_DOCUMENT rows, so that none is made of all."""
    parts = max(1, -(-rows.count() // A_DOCUMENT))
    return rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))


def write(results: DataFrame, path: str, name: str = "factloom") -> None:
    """SARIF documents of about A_DOCUMENT results each, one below each folder part=N; read() takes them all."""
    of_one = _dealt(results.withColumn("line", F.coalesce("line", F.lit(1))), "seq").groupBy("part").agg(
        F.array_sort(F.collect_list(F.struct("seq", "rule", "qualname", "uri", "line"))).alias("rows"), F.array_sort(F.collect_set("rule")).alias("ids")
    )
    index = lambda rule: (F.array_position("ids", rule) - 1).cast("int")
    found = F.transform("rows", lambda x: _result(x["rule"], index(x["rule"]), x["qualname"], x["uri"], x["line"]))
    driver = F.struct(F.lit(name).alias("name"), F.transform("ids", lambda x: F.struct(x.alias("id"))).alias("rules"))
    runs = F.array(F.struct(F.struct(driver.alias("driver")).alias("tool"), found.alias("results")))
    of_one.select("part", F.to_json(F.struct(F.lit("2.1.0").alias("version"), runs.alias("runs"))).alias("value")).write.mode("overwrite").partitionBy("part").text(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(fp, rule, qualname, message) of a baseline file; no file is an empty baseline."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.schema(BASELINE).json(path, multiLine=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], BASELINE)
    return raw.select(F.explode("findings").alias("fp", "f")).select("fp", F.col("f.ruleId").alias("rule"), F.col("f.qualifiedName").alias("qualname"), F.col("f.message").alias("message"))


def write_baseline(accepted: DataFrame, path: str) -> None:
    """accepted(fp, rule, qualname, message) as JSON documents of about A_DOCUMENT findings, keys in order; read_baseline() takes them all."""
    entry = F.struct("fp", F.struct(F.col("rule").alias("ruleId"), F.col("qualname").alias("qualifiedName"), F.col("message")).alias("v"))
    doc = _dealt(accepted, "fp").groupBy("part").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("findings"))
    doc.select("part", F.to_json(F.struct(F.lit(1).alias("version"), "findings")).alias("value")).write.mode("overwrite").partitionBy("part").text(path)


def parse_verdict(text: Column) -> Column:
    """struct(verdict, confidence, rationale) of a reply.

    The JSON is what stands in a fenced block, or the reply itself if it begins with a brace, or else the first braces without
    braces inside.  A missing verdict is FP and a missing confidence 0.5; whatever is not TP in capitals or not is FP.  A
    reply that cannot be read counts as TP with 0.5, so that nothing is lost unseen.
    """
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    fenced = F.regexp_extract(whole, r"(?s)```(?:json)?\s*\n(.*?)```", 1)
    unfenced = F.regexp_replace(F.regexp_replace(whole, r"^```[^\n]*\n?", ""), r"\n```\s*$", "")
    body = F.regexp_replace(F.when(fenced != "", fenced).otherwise(unfenced), r"^\s+|\s+$", "")
    inner = F.regexp_extract(body, r"\{[^{}]*\}", 0)
    json = F.when(body.startswith("{") | (inner == ""), body).otherwise(inner)
    got = F.from_json(json, "verdict string, confidence string, rationale string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    odd = got["confidence"].isNotNull() & got["confidence"].try_cast("double").isNull()
    readable = json.startswith("{") & got["_corrupt"].isNull() & ~odd
    said = F.struct(
        F.when(F.upper(F.coalesce(got["verdict"], F.lit("FP"))) == "TP", "TP").otherwise("FP").alias("verdict"),
        F.coalesce(got["confidence"].try_cast("double"), F.lit(0.5)).alias("confidence"),
        F.coalesce(got["rationale"], F.lit("")).alias("rationale"),
    )
    lost = F.struct(F.lit("TP").alias("verdict"), F.lit(0.5).alias("confidence"), F.concat(F.lit("unreadable reply: "), F.substring(F.coalesce(json, F.lit("")), 1, 200)).alias("rationale"))
    return F.when(readable, said).otherwise(lost)


def triage(results: DataFrame, verdicts: DataFrame, least: float) -> DataFrame:
    """Results judged true with enough confidence, in their order.  verdicts(seq, verdict, confidence)."""
    return results.join(verdicts.where((F.col("verdict") == "TP") & (F.col("confidence") >= least)).select("seq"), "seq", "left_semi").orderBy("seq")


def report(judged: DataFrame, project: str, model: str, least: float) -> DataFrame:
    """(seq, markdown): the report of true findings, one block a finding and a head with seq null.  Written as text in order, they are the document.

    judged(seq, rule, qualname, uri, line, verdict, confidence, rationale, context).
    """
    c = F.col
    kept = judged.where((c("verdict") == "TP") & (c("confidence") >= least))
    percent = lambda x: F.concat(F.round(x * 100).cast("int").cast("string"), F.lit("%"))
    short = F.substring_index("qualname", ".", -2)
    place = F.when(c("uri") != "", F.concat(F.lit("| **Location** | `"), "uri", F.lit("`"), F.when(c("line") > 0, F.concat(F.lit(" line "), c("line").cast("string"))).otherwise(""), F.lit(" |")))
    context = F.when((c("context") != "") & ~c("context").startswith("("), F.concat(F.lit("### Source Context\n\n"), "context", F.lit("\n")))
    block = F.concat_ws(
        "\n", F.concat(F.lit("## `"), "rule", F.lit("` in `"), short, F.lit("`\n")), F.lit("| Field | Value |\n|-------|-------|"), F.concat(F.lit("| **Bug Type** | `"), "rule", F.lit("` |")),
        F.concat(F.lit("| **Function** | `"), "qualname", F.lit("` |")), place, F.concat(F.lit("| **Confidence** | "), percent(c("confidence")), F.lit(" |\n")), F.concat(F.lit("### Justification\n\n"), F.coalesce("rationale", F.lit("")), F.lit("\n")), context, F.lit("---\n"),
    )
    # The headings and fields of a report, here and in the blocks above.
    lines = ("# True Positive Findings\n", "**Project:** `%s`  ", "**Confirmed true positives:** %d  ", "**Model:** `%s`  ", "**Min confidence threshold:** %s\n", "---\n")
    intro = F.format_string("\n".join(lines), F.lit(project), F.count("*"), F.lit(model), percent(F.lit(least)))
    head = kept.agg(intro.alias("markdown")).select(F.lit(None).cast("long").alias("seq"), "markdown")
    return head.union(kept.select("seq", block.alias("markdown")))
