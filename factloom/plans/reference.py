"""Queries of the analysis operators over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import intent, pynum, scoring, taint
from factloom.functions import intervals as iv
from factloom.operators import baseline, concurrency, contracts, dataflow, findings, graph, history, invariants, matching, metrics, records, summaries, traces
from factloom.plans import facts as ft
from factloom.plans.registry import load, query
from factloom.sources import python_source, sarif, text

_VARIANT_SQL = "CASE bug_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in findings.VARIANTS.items()) + " ELSE bug_type END"

# findings ---------------------------------------------------------------------------------------------------------


@query(f"""WITH {ft.FINDINGS}, v AS (SELECT seq, {_VARIANT_SQL} AS bug_type, location, confidence, chain, source FROM findings),
c AS (SELECT bug_type, location, string_agg(chain, '|' ORDER BY first_seq) AS chains FROM (
  SELECT bug_type, location, chain, first_seq, row_number() OVER (PARTITION BY bug_type, location ORDER BY first_seq) AS n
  FROM (SELECT bug_type, location, chain, min(seq) AS first_seq FROM v GROUP BY ALL)) WHERE n <= 5 GROUP BY ALL),
s AS (SELECT bug_type, location, string_agg(source, ',' ORDER BY source) AS sources FROM (SELECT DISTINCT bug_type, location, source FROM v) GROUP BY ALL)
SELECT bug_type, location, arg_min(seq, (-confidence, seq)) AS seq, max(confidence) AS confidence, count(*) AS occurrences, min(confidence) AS min_confidence,
       round(avg(confidence), 9) AS mean_confidence, any_value(chains) AS chains, any_value(sources) AS sources
FROM v JOIN c USING (bug_type, location) JOIN s USING (bug_type, location) GROUP BY bug_type, location""")
def dedup_findings(spark, sf_dir):
    """Variants recoded, then one finding a type and place."""
    d = findings.deduplicate(findings.consolidate_variants(ft.findings(spark, sf_dir)))
    return d.select(
        "bug_type", "location", "seq", "confidence", "occurrences", "min_confidence", F.round("mean_confidence", 9).alias("mean_confidence"),
        F.array_join(F.transform("example_call_chains", lambda x: F.array_join(x, ">")), "|").alias("chains"), F.array_join("all_tainted_sources", ",").alias("sources"),
    )


@query(f"WITH {ft.FINDINGS} SELECT seq, {_VARIANT_SQL} AS bug_type, CASE WHEN {_VARIANT_SQL} <> bug_type THEN bug_type END AS original_bug_type FROM findings")
def consolidate_variants(spark, sf_dir):
    return findings.consolidate_variants(ft.findings(spark, sf_dir)).select("seq", "bug_type", "original_bug_type")


@query(f"WITH {ft.FINDINGS} SELECT seq, bug_type, confidence FROM findings WHERE coalesce(confidence, 0) >= 0.5")
def filter_confidence(spark, sf_dir):
    return findings.filter_by_confidence(ft.findings(spark, sf_dir)).select("seq", "bug_type", "confidence")


@query(f"WITH {ft.FINDINGS} SELECT {_VARIANT_SQL} AS bug_type, count(*) AS n FROM findings GROUP BY 1")
def findings_by_type(spark, sf_dir):
    return findings.findings_by_type(findings.consolidate_variants(ft.findings(spark, sf_dir)))


@query(f"""WITH {ft.FINDINGS}, g AS (SELECT {_VARIANT_SQL} AS t, location, count(*) AS n FROM findings GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS original_count, count(*) AS deduplicated_count, count(*) / sum(n) AS retained_ratio FROM g""")
def scan_metadata(spark, sf_dir):
    return findings.scan_metadata(ft.findings(spark, sf_dir))


@query(f"WITH {ft.FINDINGS} SELECT seq, bug_type, confidence FROM findings ORDER BY confidence DESC, seq LIMIT 20")
def top_n(spark, sf_dir):
    return findings.top_findings(ft.findings(spark, sf_dir), 20).select("seq", "bug_type", "confidence")


# baseline ---------------------------------------------------------------------------------------------------------

_LAST = "(SELECT fp, arg_max(seq, seq) AS seq FROM current_ GROUP BY fp)"


def _baseline(spark, sf_dir):
    return ft.sarif_rows(spark, sf_dir, False).select(baseline.fingerprint().alias("fp"))


@query(f"WITH {ft.CURRENT}, {ft.BASELINE} SELECT fp, seq FROM {_LAST} WHERE fp NOT IN (SELECT fp FROM baseline)")
def baseline_new(spark, sf_dir):
    return baseline.new_results(ft.sarif_rows(spark, sf_dir, True), _baseline(spark, sf_dir)).select("fp", "seq")


@query(f"WITH {ft.CURRENT}, {ft.BASELINE} SELECT DISTINCT fp FROM baseline WHERE fp NOT IN (SELECT fp FROM current_)")
def baseline_fixed(spark, sf_dir):
    return baseline.fixed_fingerprints(ft.sarif_rows(spark, sf_dir, True), _baseline(spark, sf_dir))


@query(f"WITH {ft.CURRENT} SELECT fp, seq FROM {_LAST}")
def baseline_accept(spark, sf_dir):
    return baseline.accept(ft.sarif_rows(spark, sf_dir, True)).select("fp", "seq")


@query(f"WITH {ft.CURRENT}, {ft.BASELINE} SELECT DISTINCT fp FROM baseline WHERE fp IN (SELECT fp FROM current_)")
def baseline_prune(spark, sf_dir):
    return baseline.prune(ft.sarif_rows(spark, sf_dir, True), _baseline(spark, sf_dir)).distinct()


@query(f"""WITH {ft.CURRENT}, {ft.BASELINE}, a AS (SELECT DISTINCT rule, qualname, uri FROM current_), b AS (SELECT DISTINCT rule, qualname, uri FROM baseline)
SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS common, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS new_only, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS baseline_only""")
def set_compare(spark, sf_dir):
    return baseline.set_compare(ft.sarif_rows(spark, sf_dir, True), ft.sarif_rows(spark, sf_dir, False), ["rule", "qualname", "uri"])


# matching ---------------------------------------------------------------------------------------------------------


@query(f"WITH {ft.LEFT_HITS}, {ft.RIGHT_HITS} FROM lhs INTERSECT FROM rhs")
def exact_match(spark, sf_dir):
    return matching.exact_match(ft.line_hits(spark, sf_dir, 0), ft.line_hits(spark, sf_dir, 1))


@query(f"""WITH {ft.LEFT_HITS}, {ft.RIGHT_HITS}, l AS (FROM lhs EXCEPT FROM rhs), r AS (FROM rhs EXCEPT FROM lhs)
SELECT l.file, l.line, l.bug_type, min(r.line) AS right_line FROM l JOIN r ON l.file = r.file AND l.bug_type = r.bug_type AND abs(l.line - r.line) <= 3 GROUP BY ALL""")
def loose_match_3(spark, sf_dir):
    return matching.loose_match(ft.line_hits(spark, sf_dir, 0), ft.line_hits(spark, sf_dir, 1)).select("file", "line", "bug_type", "right_line")


@query(f"""WITH {ft.LEFT_HITS}, {ft.RIGHT_HITS} SELECT * FROM lhs l WHERE EXISTS (SELECT 1 FROM rhs r WHERE r.bug_type = 'R' AND r.file = l.file AND abs(r.line - l.line) <= 3)""")
def near_changed_lines(spark, sf_dir):
    return matching.near_lines(ft.line_hits(spark, sf_dir, 0), ft.line_hits(spark, sf_dir, 1).where("bug_type = 'R'").select("file", "line"))


_DIFF = """b AS (SELECT l_orderkey AS case_id, list(DISTINCT l_returnflag) AS t FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1),
f AS (SELECT l_orderkey AS case_id, list(DISTINCT l_returnflag) AS t FROM lineitem WHERE l_linenumber > 3 GROUP BY 1),
c AS (SELECT DISTINCT o_orderkey AS case_id, o_orderstatus = 'P' AND o_orderkey % 7 = 0 AS any_error FROM orders),
x AS (SELECT case_id, any_error, coalesce(b.t, []) AS b, coalesce(f.t, []) AS f FROM c LEFT JOIN b USING (case_id) LEFT JOIN f USING (case_id))"""


@query(f"""WITH {_DIFF} SELECT case_id, CASE WHEN any_error THEN 'ERROR' WHEN len(list_filter(b, lambda t: NOT list_contains(f, t))) > 0 THEN 'TRUE_POSITIVE'
  WHEN len(f) > 0 AND len(b) = 0 THEN 'FALSE_POSITIVE' WHEN len(list_intersect(b, f)) > 0 THEN 'BOTH_BUG' ELSE 'FALSE_NEGATIVE' END AS classification FROM x""")
def classify_differential(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("bug_type"), (F.col("l_linenumber") <= 3).alias("early"))
    cases = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), ((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 7 == 0)).alias("any_error")).distinct()
    return matching.classify_near(rows.where("early"), rows.where("not early"), cases).select("case_id", "classification")


_SIDES = """s AS (SELECT l_orderkey AS case_id, CASE WHEN l_linenumber <= 3 THEN 'buggy' ELSE 'fixed' END AS side,
  CASE l_returnflag WHEN 'R' THEN 'BUG' WHEN 'A' THEN 'SAFE' ELSE 'ERROR' END AS verdict, CASE WHEN l_returnflag = 'R' THEN l_suppkey % 3 END AS sig FROM lineitem),
g AS (SELECT case_id, max(CASE WHEN side = 'buggy' AND verdict = 'BUG' THEN 1 ELSE 0 END) AS b, max(CASE WHEN side = 'fixed' AND verdict = 'BUG' THEN 1 ELSE 0 END) AS f,
  coalesce(min(CASE WHEN side = 'buggy' THEN CASE WHEN verdict = 'ERROR' THEN 1 ELSE 0 END END), 1) AS be, coalesce(min(CASE WHEN side = 'fixed' THEN CASE WHEN verdict = 'ERROR' THEN 1 ELSE 0 END END), 1) AS fe,
  list(DISTINCT sig) FILTER (side = 'buggy' AND sig IS NOT NULL) AS bs, list(DISTINCT sig) FILTER (side = 'fixed' AND sig IS NOT NULL) AS fs FROM s GROUP BY 1)"""


@query(f"""WITH {_SIDES} SELECT case_id, CASE WHEN be = 1 AND fe = 1 THEN 'ERROR' WHEN b = 1 AND f = 0 THEN 'TRUE_POSITIVE' WHEN b = 0 AND f = 0 THEN 'FALSE_NEGATIVE' WHEN b = 0 THEN 'FALSE_POSITIVE'
  WHEN len(list_filter(bs, lambda t: NOT list_contains(fs, t))) > 0 THEN 'TRUE_POSITIVE' ELSE 'BOTH_BUG' END AS classification FROM g""")
def classify_signatures(spark, sf_dir):
    flag = F.col("l_returnflag")
    rows = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.when(F.col("l_linenumber") <= 3, "buggy").otherwise("fixed").alias("side"), F.when(flag == "R", "BUG").when(flag == "A", "SAFE").otherwise("ERROR").alias("verdict"),
        F.when(flag == "R", "T").alias("bug_type"), F.when(flag == "R", F.col("l_suppkey") % 3).alias("line"),
    )
    return matching.classify_signatures(rows)


_CALLS = """calls AS (SELECT DISTINCT c_custkey % 500 AS src, CASE c_custkey % 4 WHEN 0 THEN 'm' || CAST(c_nationkey AS VARCHAR) || '.f' || CAST(c_custkey % 50 AS VARCHAR)
  WHEN 1 THEN 'f' || CAST(c_custkey % 50 AS VARCHAR) WHEN 2 THEN 'pkg.m' || CAST(c_nationkey AS VARCHAR) || '.f' || CAST(c_custkey % 50 AS VARCHAR) ELSE 'x.none' || CAST(c_custkey % 9 AS VARCHAR) END AS name FROM customer),
funcs AS (SELECT DISTINCT 'pkg.m' || CAST(s_nationkey AS VARCHAR) || '.f' || CAST(s_suppkey % 50 AS VARCHAR) AS qname FROM supplier)"""


@query(f"""WITH {_CALLS}, n AS (SELECT DISTINCT name, string_split(name, '.')[-1] AS simple FROM calls), f AS (SELECT qname, string_split(qname, '.')[-1] AS simple FROM funcs),
u AS (SELECT simple, min(qname) AS q FROM f GROUP BY 1 HAVING count(*) = 1),
t AS (SELECT name, coalesce((SELECT min(qname) FROM f WHERE qname = name), CASE WHEN contains(name, '.') THEN (SELECT min(qname) FROM f WHERE ends_with(qname, '.' || name)) END,
  CASE WHEN NOT contains(name, '.') THEN (SELECT q FROM u WHERE u.simple = n.simple) END) AS target FROM n)
SELECT src, name, target FROM calls JOIN t USING (name)""")
def resolve_calls(spark, sf_dir):
    c, n, k = F.col("c_custkey"), F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 50).cast("string")
    name = F.when(c % 4 == 0, F.concat(F.lit("m"), n, F.lit(".f"), k)).when(c % 4 == 1, F.concat(F.lit("f"), k)).when(c % 4 == 2, F.concat(F.lit("pkg.m"), n, F.lit(".f"), k)).otherwise(F.concat(F.lit("x.none"), (c % 9).cast("string")))
    calls = load(spark, sf_dir, "customer").select((c % 500).alias("src"), name.alias("name")).distinct()
    funcs = load(spark, sf_dir, "supplier").select(F.concat(F.lit("pkg.m"), F.col("s_nationkey").cast("string"), F.lit(".f"), (F.col("s_suppkey") % 50).cast("string")).alias("qname")).distinct()
    return matching.resolve_calls(calls, funcs).select("src", "name", "target")


# metrics ----------------------------------------------------------------------------------------------------------

_COUNTS = """count(*) FILTER (expected = 'BUG' AND predicted = 'BUG') AS tp, count(*) FILTER (expected = 'SAFE' AND predicted = 'SAFE') AS tn, count(*) FILTER (expected = 'SAFE' AND predicted = 'BUG') AS fp,
count(*) FILTER (expected = 'BUG' AND predicted = 'SAFE') AS fn, count(*) FILTER (expected = 'BUG' AND predicted = 'UNKNOWN') AS unknown_on_bug, count(*) FILTER (expected <> 'BUG' AND predicted = 'UNKNOWN') AS unknown_on_safe,
count(*) FILTER (predicted = 'ERROR') AS errors, count(*) AS total"""


def _rates(keys: str) -> str:
    safe = lambda a, b: f"coalesce(CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / ({b}) END, 0)"
    p, rs, rl = safe("tp", "tp + fp"), safe("tp", "tp + fn + unknown_on_bug"), safe("tp", "tp + fn")
    return f"""SELECT {keys}, tp, tn, fp, fn, unknown_on_bug, unknown_on_safe, errors, total, tp + tn + fp + fn AS decided, round({p}, 4) AS precision, round({rs}, 4) AS recall_strict, round({rl}, 4) AS recall_lenient,
round({safe(f"2 * {p} * {rs}", f"{p} + {rs}")}, 4) AS f1_strict, round({safe(f"2 * {p} * {rl}", f"{p} + {rl}")}, 4) AS f1_lenient, round({safe("(tp + tn)", "total")}, 4) AS accuracy,
round({safe("(tp + tn)", "tp + tn + fp + fn")}, 4) AS decided_accuracy, round({safe("(unknown_on_bug + unknown_on_safe)", "total")}, 4) AS unknown_rate"""


@query(f"WITH {ft.VERDICTS}, c AS (SELECT tool, {_COUNTS} FROM verdicts GROUP BY tool) {_rates('tool')} FROM c")
def confusion_metrics(spark, sf_dir):
    return metrics.confusion(ft.verdicts(spark, sf_dir), "tool")


@query(f"""WITH {ft.VERDICTS}, c AS (SELECT tool, CASE WHEN grouping(bug_type) = 1 THEN 'ALL' ELSE bug_type END AS bug_type, {_COUNTS} FROM verdicts GROUP BY GROUPING SETS ((tool), (tool, bug_type)))
{_rates('tool, bug_type')} FROM c""")
def confusion_by_type_rollup(spark, sf_dir):
    return metrics.confusion_two_levels(ft.verdicts(spark, sf_dir))


@query(f"""WITH {ft.VERDICTS}, p AS (SELECT case_id, max(CASE WHEN tool = 'short' THEN CASE WHEN predicted = expected THEN 1 ELSE 0 END END) AS a, max(CASE WHEN tool = 'long' THEN CASE WHEN predicted = expected THEN 1 ELSE 0 END END) AS b
FROM verdicts GROUP BY 1) SELECT count(*) FILTER (a = 1 AND b = 1) AS both_right, count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b, count(*) FILTER (a = 0 AND b = 0) AS both_wrong FROM p""")
def head_to_head(spark, sf_dir):
    return metrics.head_to_head(ft.verdicts(spark, sf_dir), "short", "long")


@query(f"""WITH {ft.VERDICTS}, p AS (SELECT case_id, expected, max(predicted) FILTER (tool = 'short') AS said_a, max(predicted) FILTER (tool = 'long') AS said_b FROM verdicts GROUP BY ALL)
SELECT * FROM p WHERE said_a <> said_b ORDER BY case_id LIMIT 50""")
def disagreements(spark, sf_dir):
    return metrics.disagreements(ft.verdicts(spark, sf_dir), "short", "long")


@query(f"""WITH {ft.VERDICTS} SELECT tool, round(sum(runtime), 4) AS total_runtime, round(avg(runtime), 4) AS avg_runtime, round(exp(avg(ln(greatest(runtime, 1e-6)))), 4) AS geomean_runtime FROM verdicts GROUP BY tool""")
def geomean_runtime(spark, sf_dir):
    return metrics.runtimes(ft.verdicts(spark, sf_dir))


@query(f"""WITH {ft.VERDICTS} SELECT bug_type, {', '.join(f"count(*) FILTER (predicted = '{v}') AS {v}" for v in ('BUG', 'SAFE', 'UNKNOWN', 'ERROR'))}, count(*) AS total FROM verdicts GROUP BY 1""")
def classification_pivot(spark, sf_dir):
    return metrics.cross_tab(ft.verdicts(spark, sf_dir), "bug_type", "predicted", ["BUG", "SAFE", "UNKNOWN", "ERROR"])


@query(f"""WITH {ft.VERDICTS} SELECT bug_type, count(*) AS total, count(*) FILTER (expected = 'BUG') AS tp, count(*) FILTER (expected <> 'BUG') AS fp, round(count(*) FILTER (expected <> 'BUG') / count(*), 4) AS fp_rate
FROM verdicts WHERE predicted = 'BUG' GROUP BY 1""")
def fp_stats_by_type(spark, sf_dir):
    return metrics.type_statistics(ft.verdicts(spark, sf_dir).where("predicted = 'BUG'").withColumn("is_true", F.col("expected") == "BUG"))


@query(f"WITH {ft.VERDICTS}, c AS (SELECT tool, {_COUNTS} FROM verdicts GROUP BY tool), r AS ({_rates('tool')} FROM c) SELECT tool, f1_strict, rank() OVER (ORDER BY f1_strict DESC) = 1 AS is_best FROM r")
def best_tool(spark, sf_dir):
    return metrics.best(metrics.confusion(ft.verdicts(spark, sf_dir), "tool"), "f1_strict").select("tool", "f1_strict", "is_best")


# learned invariants -------------------------------------------------------------------------------------------------


@query("""WITH g AS (SELECT user_id % 50 AS op, count(*) AS support, count(*) FILTER (event_id % 31 <> 0) / count(*) AS share FROM events GROUP BY 1 HAVING count(*) >= 5)
SELECT op, CASE WHEN share >= 0.95 THEN 'always_guarded' ELSE 'never_guarded' END AS pattern, round(CASE WHEN share >= 0.95 THEN share ELSE 1 - share END, 6) AS confidence, support FROM g WHERE share >= 0.95 OR share <= 0.05""")
def learned_invariants(spark, sf_dir):
    return invariants.guard_patterns(load(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("op"), (F.col("event_id") % 31 != 0).alias("guarded")))


@query("""WITH g AS (SELECT l_suppkey AS func, count(*) AS support, count(*) FILTER (l_discount = 0 AND l_linenumber = 7) / count(*) AS share FROM lineitem GROUP BY 1)
SELECT func, round(1 - share, 6) AS confidence, support FROM g WHERE share <= 0.01 AND support >= 10""")
def never_null_returns(spark, sf_dir):
    return invariants.never_null(load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("func"), ((F.col("l_discount") == 0) & (F.col("l_linenumber") == 7)).alias("is_null")))


@query("SELECT var, prop, round(n / sum(n) OVER (PARTITION BY var), 6) AS confidence FROM (SELECT user_id AS var, event_type AS prop, count(*) AS n FROM events GROUP BY ALL)")
def likely_invariants(spark, sf_dir):
    return invariants.likely_invariants(load(spark, sf_dir, "events").select(F.col("user_id").alias("var"), F.col("event_type").alias("prop")))


@query("""SELECT user_id AS func, event_id AS idx, coalesce(max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) = 1 AS near_guard FROM events""")
def nearby_guard(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("func"), F.col("event_id").alias("idx"), (F.col("event_type") == "click").alias("is_guard"))
    return invariants.nearby_guard(rows, 3).select("func", "idx", "near_guard")


# scores -----------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT l_orderkey AS id, l_quantity / 60 AS strength, l_discount AS inverse FROM lineitem),
o AS (SELECT id, ln(0.6 / 0.4) + coalesce(sum(CASE WHEN inverse > 0 AND strength > 0 THEN ln(strength / inverse) END), 0) AS lo FROM s GROUP BY 1) SELECT id, round(1 / (1 + exp(-lo)), 6) AS posterior FROM o""")
def bayes_posterior(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_quantity") / 60).alias("strength"), F.col("l_discount").alias("inverse"))
    return scoring.posterior_safe(rows, "id")


_SCORE_IN = """t AS (SELECT *, source % 2 = 0 AS guarded, source % 3 = 0 AS handler, source % 5 = 0 AS framework, CAST(1 + source % 10 AS INT) AS chain, CAST(id % 3 AS INT) AS n_ids FROM taint),
h AS (SELECT *, bit_count(tau & 147) AS high, bit_count(tau & 300) AS medium, sink = 10 AS deser, (kappa >> sink) & 1 = 1 AS done FROM t),
p AS (SELECT *, done OR CASE WHEN deser THEN tau = 0 AND sigma = 0 WHEN sink <= 17 THEN tau = 0 ELSE sigma = 0 END AS safe,
  greatest(CASE WHEN tau = 0 THEN 0.0 WHEN high >= 2 THEN 0.95 WHEN high = 1 THEN 0.85 WHEN medium >= 1 THEN 0.70 ELSE 0.50 END, CASE WHEN sigma = 0 THEN 0.0 WHEN bit_count(sigma) >= 2 THEN 0.90 ELSE 0.85 END) AS s0 FROM h),
q AS (SELECT *, CASE WHEN tau = 0 AND sigma = 0 THEN 0.0 WHEN n_ids > 0 THEN least(1.0, s0 + 0.05) ELSE s0 END AS src,
  CASE WHEN chain <= 1 THEN 0.95 WHEN chain <= 2 THEN 0.85 WHEN chain <= 4 THEN 0.70 ELSE 0.50 END AS snk,
  CASE WHEN safe THEN 0.0 WHEN kappa = 0 THEN 0.95 WHEN bit_count(kappa) <= 3 THEN 0.85 ELSE 0.70 END AS san,
  greatest(0.0, least(1.0, 0.80 - CASE WHEN guarded THEN 0.40 ELSE 0 END - CASE WHEN handler THEN 0.20 ELSE 0 END + CASE WHEN framework THEN 0.10 ELSE 0 END)) AS sem,
  CASE WHEN chain <= 1 THEN 1.0 WHEN chain <= 2 THEN 0.90 WHEN chain <= 4 THEN 0.75 WHEN chain <= 8 THEN 0.60 ELSE 0.40 END AS chn FROM p)"""


def _scored(spark, sf_dir):
    s = F.col("source")
    return ft.taint_rows(spark, sf_dir).select("*", (s % 2 == 0).alias("guarded"), (s % 3 == 0).alias("handler"), (s % 5 == 0).alias("framework"), (1 + s % 10).cast("int").alias("chain"), (F.col("id") % 3).cast("int").alias("n_ids"))


@query(f"WITH {ft.TAINT}, {_SCORE_IN} SELECT id, sink, round(CASE WHEN src = 0 OR san = 0 THEN 0 ELSE CAST(src * 0.30 + snk * 0.25 + san * 0.20 + sem * 0.15 + chn * 0.10 AS DOUBLE) END, 6) AS score FROM q")
def security_score(spark, sf_dir):
    return scoring.security_score(_scored(spark, sf_dir)).select("id", "sink", "score")


@query(f"""WITH {ft.TAINT}, {_SCORE_IN}, c AS (SELECT id, sink, sem, chn, framework, guarded, handler, CASE source % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.80 WHEN 2 THEN 0.60 WHEN 3 THEN 0.40 ELSE 0.50 END AS c0, n_ids FROM q),
d AS (SELECT *, CASE WHEN n_ids > 0 THEN least(1.0, c0 + 0.05) ELSE c0 END AS c1, greatest(0.0, 0.80 - CASE WHEN guarded THEN 0.40 ELSE 0 END - CASE WHEN handler THEN 0.20 ELSE 0 END) AS sem0 FROM c)
SELECT id, sink, round(CAST(c1 * 0.40 + sem0 * 0.40 + chn * 0.20 AS DOUBLE), 6) AS score FROM d""")
def error_score(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["DEFINITE", "LIKELY", "POSSIBLE", "UNKNOWN", "OTHER"]))
    rows = _scored(spark, sf_dir).withColumn("certainty", F.element_at(kinds, (F.col("source") % 5 + 1).cast("int"))).withColumn("n_params", F.col("n_ids"))
    return scoring.error_score(rows).select("id", "sink", "score")


_PRE = ["NOT_ZERO", *scoring.RISKS, "OTHER"]


@query(f"""WITH r AS (SELECT p_partkey AS id, p_partkey % 12 AS k, CASE WHEN p_size % 4 <> 0 THEN p_size - 5 END AS ub, p_size % 3 = 0 AS neg FROM part)
SELECT id, round(CASE WHEN k = 0 THEN least(1.0, 1.0 / greatest(1, CASE WHEN neg THEN 2 * greatest(0, coalesce(ub, 9)) + 1 ELSE greatest(0, coalesce(ub, 9)) + 1 END))
  {' '.join(f"WHEN k = {i} THEN {scoring.RISKS[p]}" for i, p in enumerate(_PRE) if p in scoring.RISKS)} END, 6) AS risk FROM r""")
def risk_interval(spark, sf_dir):
    c = F.col
    rows = load(spark, sf_dir, "part").select(c("p_partkey").alias("id"), F.element_at(F.array(*map(F.lit, _PRE)), (c("p_partkey") % 12 + 1).cast("int")).alias("pre"), F.when(c("p_size") % 4 != 0, c("p_size") - 5).alias("ub"), (c("p_size") % 3 == 0).alias("neg"))
    return rows.select("id", F.round(scoring.risk_upper(c("pre"), c("ub"), c("neg")), 6).alias("risk"))


@query("""SELECT event_id AS id, least(value / 600, 1.0) * CAST(least(CASE WHEN event_id % 2 = 0 THEN 0.25 ELSE 1.0 END, CASE WHEN event_id % 3 = 0 THEN 0.15 ELSE 1.0 END, CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE 1.0 END) AS DOUBLE) AS adjusted FROM events""")
def context_adjustment(spark, sf_dir):
    """The least factor of the matched contexts counts."""
    e = F.col("event_id")
    contexts = F.array_compact(F.array(F.when(e % 2 == 0, "CLI_TOOL"), F.when(e % 3 == 0, "TEST_FILE"), F.when(e % 5 == 0, "INTERNAL_API")))
    return load(spark, sf_dir, "events").select(e.alias("id"), (F.least(F.col("value") / 600, F.lit(1.0)) * scoring.context_multiplier(contexts)).alias("adjusted"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, round((1 - l_discount) * (1 - l_tax), 6) AS unintentional FROM lineitem""")
def unintentional_confidence(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round(scoring.unintentional(F.array("l_discount", "l_tax")), 6).alias("unintentional"))


# taint ------------------------------------------------------------------------------------------------------------


@query(f"WITH {ft.TAINT} SELECT id, bit_or(tau) AS tau, bit_and(kappa) AS kappa, bit_or(sigma) AS sigma, string_agg(DISTINCT CAST(source AS VARCHAR), ',' ORDER BY CAST(source AS VARCHAR)) AS provenance FROM taint GROUP BY id")
def taint_join(spark, sf_dir):
    rows = ft.taint_rows(spark, sf_dir).withColumn("source", F.col("source").cast("string"))
    return taint.join_labels(rows, "id", provenance="source").withColumn("provenance", F.array_join("provenance", ","))


_SAFE = "((kappa >> sink) & 1 = 1 OR CASE WHEN sink = 10 THEN tau = 0 AND sigma = 0 WHEN sink <= 17 THEN tau = 0 ELSE sigma = 0 END)"


@query(f"WITH {ft.TAINT} SELECT id, sink, source, {_SAFE} AS safe FROM taint")
def sink_safety(spark, sf_dir):
    c = F.col
    return ft.taint_rows(spark, sf_dir).select("id", "sink", "source", taint.is_safe(c("tau"), c("kappa"), c("sigma"), c("sink")).alias("safe"))


@query(f"WITH {ft.TAINT} SELECT id, sink, source, CASE WHEN sink = 10 THEN 'both' WHEN sink <= 17 THEN 'untrusted' ELSE 'sensitive' END AS kind FROM taint WHERE NOT {_SAFE}")
def sink_violations(spark, sf_dir):
    return taint.violations(ft.taint_rows(spark, sf_dir)).select("id", "sink", "source", "kind")


@query(f"""WITH {ft.TAINT} SELECT id, sink, source, kappa | CASE source % 3 WHEN 0 THEN {taint.mask('HTML_ESCAPE')} WHEN 1 THEN {taint.mask('ENCRYPTION')} ELSE 0 END AS kappa FROM taint""")
def taint_sanitize(spark, sf_dir):
    s = F.element_at(F.array(F.lit("HTML_ESCAPE"), F.lit("ENCRYPTION"), F.lit("NOTHING")), (F.col("source") % 3 + 1).cast("int"))
    return ft.taint_rows(spark, sf_dir).select("id", "sink", "source", taint.sanitize(F.col("kappa"), s).alias("kappa"))


@query(f"WITH {ft.TAINT} SELECT id, sink, source, tau | CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS tau, CASE WHEN id % 2 = 0 THEN 0 ELSE kappa END AS kappa, sigma | 512 AS sigma FROM taint")
def taint_under_control(spark, sf_dir):
    c = F.col
    return ft.taint_rows(spark, sf_dir).select("id", "sink", "source", *taint.under_control(c("tau"), c("kappa"), c("sigma"), F.when(c("id") % 2 == 0, 1).otherwise(0).cast("long"), F.lit(512).cast("long")))


@query(f"""WITH {ft.TAINT}, f AS (SELECT id, bit_or(tau) AS tau, bit_and(kappa) AS kappa, bit_or(sigma) AS sigma FROM taint WHERE source % 4 <> 0 GROUP BY 1)
SELECT DISTINCT id AS call, coalesce(f.tau, 0) AS tau, coalesce(f.kappa, 4294967295) AS kappa, coalesce(f.sigma, 0) AS sigma FROM (SELECT DISTINCT id FROM taint) LEFT JOIN f USING (id)""")
def taint_summary_apply(spark, sf_dir):
    args = ft.taint_rows(spark, sf_dir).select(F.col("id").alias("call"), F.lit("f").alias("func"), (F.col("source") % 4).alias("pos"), "tau", "kappa", "sigma")
    return taint.apply_summary(args, spark.createDataFrame([("f", 1), ("f", 2), ("f", 3)], "func string, pos long"))


# intervals and numbers ----------------------------------------------------------------------------------------------


@query(f"""WITH {ft.INTERVALS}, m AS (SELECT *, [alo * blo, alo * bhi, ahi * blo, ahi * bhi] AS p, blo = 0 AND bhi = 0 AS z, blo <= 0 AND bhi >= 0 AS around FROM intervals)
SELECT id, round(alo + blo, 4) AS add_lo, round(ahi + bhi, 4) AS add_hi, round(alo - bhi, 4) AS sub_lo, round(ahi - blo, 4) AS sub_hi, round(list_min(p), 4) AS mul_lo, round(list_max(p), 4) AS mul_hi,
  CASE WHEN z THEN 1.0 WHEN around THEN -1e300 WHEN blo > 0 THEN round(alo / bhi, 4) ELSE round(ahi / bhi, 4) END AS div_lo, CASE WHEN z THEN 0.0 WHEN around THEN 1e300 WHEN blo > 0 THEN round(ahi / blo, 4) ELSE round(alo / blo, 4) END AS div_hi FROM m""")
def interval_arith(spark, sf_dir):
    """Infinite ends are shown as 1e300."""
    a, b = (F.col("alo"), F.col("ahi")), (F.col("blo"), F.col("bhi"))
    shown = lambda c: F.when(c == float("inf"), 1e300).when(c == float("-inf"), -1e300).otherwise(F.round(c, 4))
    ops = {"add": iv.add(a, b), "sub": iv.subtract(a, b), "mul": iv.multiply(a, b), "div": iv.divide(a, b)}
    return ft.intervals(spark, sf_dir).select("id", *(shown(p[i]).alias(f"{k}_{s}") for k, p in ops.items() for i, s in enumerate(("lo", "hi"))))


@query(f"""WITH {ft.INTERVALS} SELECT a.id AS a, b.id AS b FROM intervals a JOIN intervals b ON a.id // 10 = b.id // 10 AND a.id < b.id AND a.alo <= b.ahi AND b.alo <= a.ahi""")
def interval_overlap_join(spark, sf_dir):
    x, y = ft.intervals(spark, sf_dir).alias("x"), ft.intervals(spark, sf_dir).alias("y")
    near = F.floor(F.col("x.id") / 10) == F.floor(F.col("y.id") / 10)
    return x.join(y, near & (F.col("x.id") < F.col("y.id")) & iv.overlap((F.col("x.alo"), F.col("x.ahi")), (F.col("y.alo"), F.col("y.ahi")))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


@query("""WITH r AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey - 700 AS a, l_suppkey % 7 - 3 AS b FROM lineitem)
SELECT id, line, a, b, CASE WHEN b <> 0 THEN CAST(floor(CAST(a AS DOUBLE) / b) AS BIGINT) END AS div, CASE WHEN b <> 0 THEN a - b * CAST(floor(CAST(a AS DOUBLE) / b) AS BIGINT) END AS mod FROM r""")
def python_division(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") - 700).alias("a"), (F.col("l_suppkey") % 7 - 3).alias("b"))
    return rows.select("*", pynum.floor_div(F.col("a"), F.col("b")).alias("div"), pynum.floor_mod(F.col("a"), F.col("b")).alias("mod"))


# history ----------------------------------------------------------------------------------------------------------

_EV = f"""{ft.SCANS}, w AS (SELECT *, coalesce(lag(verdict) OVER o, 'MISSING') AS was, coalesce(lag(bug_types) OVER o, []) AS before FROM scans WINDOW o AS (PARTITION BY file ORDER BY seq)),
ev AS (SELECT file, seq, CASE WHEN was <> 'BUG' AND verdict = 'BUG' THEN 'BUG_INTRODUCED' WHEN was = 'BUG' AND verdict <> 'BUG' THEN 'BUG_FIXED' WHEN was = 'BUG' THEN 'PERSISTS' ELSE 'CLEAN' END AS event,
  list_sort(list_filter(bug_types, lambda t: NOT list_contains(before, t))) AS new_types, list_sort(list_filter(before, lambda t: NOT list_contains(bug_types, t))) AS fixed_types FROM w)"""


@query(f"WITH {_EV} SELECT file, seq, event, array_to_string(new_types, ',') AS new_types, array_to_string(fixed_types, ',') AS fixed_types FROM ev")
def file_events(spark, sf_dir):
    e = history.file_events(ft.file_scans(spark, sf_dir))
    return e.select("file", "seq", "event", F.array_join("new_types", ",").alias("new_types"), F.array_join("fixed_types", ",").alias("fixed_types"))


@query(f"""WITH {_EV}, m AS (SELECT file, seq, unnest(new_types) AS bug_type, 'new' AS kind FROM ev UNION ALL SELECT file, seq, unnest(fixed_types), 'fixed' FROM ev),
n AS (SELECT *, lead(kind) OVER o AS nk, lead(seq) OVER o AS ns, lag(kind) OVER o AS lk FROM m WINDOW o AS (PARTITION BY file, bug_type ORDER BY seq))
SELECT file, bug_type, seq AS introduced, CASE WHEN nk = 'fixed' THEN ns END AS fixed FROM n WHERE kind = 'new' UNION ALL SELECT file, bug_type, NULL, seq FROM n WHERE kind = 'fixed' AND (lk IS NULL OR lk = 'fixed')""")
def bug_lifetimes(spark, sf_dir):
    return history.lifetimes(history.file_events(ft.file_scans(spark, sf_dir)))


@query(f"WITH {_EV} SELECT event, count(*) AS n FROM ev GROUP BY 1")
def event_counts(spark, sf_dir):
    return history.event_counts(history.file_events(ft.file_scans(spark, sf_dir)))


# records ----------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s AS (SELECT user_id, (i - lag(i) OVER o) * (value + lag(value) OVER o) / 2 AS a FROM p WINDOW o AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, round(coalesce(sum(a), 0), 6) AS auc FROM s GROUP BY 1""")
def auc_trapezoid(spark, sf_dir):
    from pyspark.sql import Window

    rows = load(spark, sf_dir, "events").select("user_id", "event_id", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("i"))
    return records.trapezoid(rows, ["user_id"], "i", "value", "event_id")


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), "value")


@query("""WITH n AS (SELECT user_id, event_id AS seq, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 7 AS chunk FROM events)
SELECT user_id, seq, chunk FROM n QUALIFY count(*) OVER (PARTITION BY user_id, chunk) = 7""")
def chunks(spark, sf_dir):
    return records.chunks(_events(spark, sf_dir), 7, by=["user_id"]).select("user_id", "seq", "chunk")


@query("""WITH n AS (SELECT user_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) // 4 AS size FROM events)
SELECT user_id, seq, i // size AS chunk FROM n WHERE size > 0""")
def split_order(spark, sf_dir):
    return records.split_evenly(_events(spark, sf_dir), 4, by=["user_id"]).select("user_id", "seq", "chunk")


@query("SELECT user_id, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 BETWEEN 20 AND 29")
def batch_slice(spark, sf_dir):
    return records.batch(_events(spark, sf_dir), 2, 10, by=["user_id"]).select("user_id", "seq")


@query("SELECT user_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 < floor(count(*) OVER (PARTITION BY user_id) * 0.8) AS is_train FROM events")
def split_train_test(spark, sf_dir):
    return records.split_train_test(_events(spark, sf_dir), 0.8, by=["user_id"]).select("user_id", "seq", "is_train")


@query("SELECT user_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS place FROM events")
def leaderboard_rank(spark, sf_dir):
    return records.ranked(_events(spark, sf_dir), "value", by=["user_id"]).select("user_id", "seq", "place")


@query("SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS dearest, arg_min(p_partkey, (p_retailprice, p_partkey)) AS cheapest FROM part GROUP BY 1")
def argmax_per_group(spark, sf_dir):
    p, k = F.col("p_retailprice"), F.col("p_partkey")
    return load(spark, sf_dir, "part").groupBy("p_brand").agg(F.max_by(k, F.struct(p, -k)).alias("dearest"), F.min_by(k, F.struct(p, k)).alias("cheapest"))


@query("SELECT c_mktsegment, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, count(*) AS n, round(sqrt(avg(pow(c_acctbal - 5000, 2))), 4) AS rmse, count(*) FILTER (c_acctbal < 0) / count(*) AS error_rate FROM customer GROUP BY 1")
def record_sums(spark, sf_dir):
    """Sum, mean, root mean square error and error rate of records."""
    c = F.col("c_acctbal")
    return load(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.round(F.sum(c), 2).alias("total"), F.round(F.avg(c), 4).alias("mean"), F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(c - 5000, F.lit(2)))), 4).alias("rmse"), (F.count_if(c < 0) / F.count("*")).alias("error_rate")
    )


@query("SELECT c_nationkey AS key, arg_max(c_name, c_custkey) AS value FROM customer GROUP BY 1")
def merge_records(spark, sf_dir):
    return records.merge_records(load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("value"), F.col("c_custkey").alias("seq")))


@query("SELECT o_orderkey AS id, lower(trim(o_orderpriority)) AS priority, o_totalprice * CAST(0.85 AS DOUBLE) AS price FROM orders WHERE o_totalprice BETWEEN 1000 AND 300000 AND length(o_orderpriority) <= 8")
def process_batch(spark, sf_dir):
    """Valid records only, tidied and discounted."""
    rows = load(spark, sf_dir, "orders").where(records.in_range(F.col("o_totalprice"), 1000, 300000) & records.short_enough(F.col("o_orderpriority"), 8))
    out = records.process_batch(rows, {"o_orderkey": "bigint", "o_orderpriority": "string"}, [records.tidy])
    return out.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), records.discount(F.col("o_totalprice"), F.lit(15)).alias("price"))


@query("""SELECT l_orderkey AS cart_id, round(sum(l_extendedprice * l_quantity) * (1 - coalesce(any_value(rate), 0)), 4) AS total FROM lineitem LEFT JOIN (VALUES ('A', 0.1), ('R', 0.25)) AS c(code, rate) ON code = CASE l_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'R' ELSE 'X' END GROUP BY l_orderkey""")
def coupon_total(spark, sf_dir):
    code = F.element_at(F.array(F.lit("A"), F.lit("R"), F.lit("X")), (F.col("l_orderkey") % 3 + 1).cast("int"))
    cart = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cart_id"), code.alias("code"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"))
    return records.coupon_total(cart, spark.createDataFrame([("A", 0.1), ("R", 0.25)], "code string, rate double"))


@query("WITH f AS (SELECT s_nationkey AS x, s_suppkey % 10 AS y, min(s_suppkey) AS a FROM supplier GROUP BY ALL) SELECT a, s_suppkey AS b FROM supplier JOIN f ON s_nationkey = x AND s_suppkey % 10 = y WHERE s_suppkey > a")
def collisions(spark, sf_dir):
    return records.collisions(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("x"), (F.col("s_suppkey") % 10).alias("y")))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') AND p_size > 10 ORDER BY p_partkey LIMIT 25")
def query_builder(spark, sf_dir):
    """The first 25 parts that pass two tests: a limit is a part of what a query may ask for."""
    wanted = records.Selection(columns=("p_partkey", "p_name"), tests=("contains(lower(p_name), 'ring')", F.col("p_size") > 10), order=("p_partkey",), rows=25)
    return wanted.of(load(spark, sf_dir, "part"))


# graphs -----------------------------------------------------------------------------------------------------------


@query(f"WITH {ft.EDGES} SELECT DISTINCT dst AS node FROM edges WHERE src = 7")
def callees(spark, sf_dir):
    return graph.callees(ft.part_edges(spark, sf_dir), 7)


@query(f"WITH {ft.EDGES} SELECT DISTINCT src AS node FROM edges WHERE dst = 7")
def callers(spark, sf_dir):
    return graph.callers(ft.part_edges(spark, sf_dir), 7)


_REACH = "r AS (SELECT src AS node FROM edges WHERE src IN (3, 50, 111) UNION SELECT dst FROM edges JOIN r ON src = node)"


@query(f"WITH RECURSIVE {ft.EDGES}, {_REACH} SELECT node FROM r")
def reachable(spark, sf_dir):
    e = ft.part_edges(spark, sf_dir)
    return graph.reachable(e, e.where(F.col("src").isin(3, 50, 111)).select(F.col("src").alias("node")))


_CLOSE = "c AS (SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM c JOIN edges e ON c.dst = e.src)"


@query(f"WITH RECURSIVE {ft.EDGES}, {_CLOSE} SELECT src, dst FROM c")
def closure(spark, sf_dir):
    return graph.closure(ft.part_edges(spark, sf_dir))


_SCC = f"""{_CLOSE}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), m AS (SELECT a.src AS node, min(a.dst) AS low FROM c a JOIN c b ON a.dst = b.src AND b.dst = a.src GROUP BY 1),
scc AS (SELECT node, least(node, coalesce(low, node)) AS scc FROM n LEFT JOIN m USING (node))"""


def _nodes(e):
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


def _components(spark, sf_dir):
    e = ft.part_edges(spark, sf_dir)
    return e, graph.strong_components(e, _nodes(e))


@query(f"WITH RECURSIVE {ft.EDGES}, {_SCC} SELECT node, scc FROM scc")
def scc_labels(spark, sf_dir):
    return _components(spark, sf_dir)[1]


@query(f"WITH RECURSIVE {ft.EDGES}, {_CLOSE} SELECT src AS node FROM c WHERE src = dst")
def recursive_functions(spark, sf_dir):
    return graph.recursive_nodes(*_components(spark, sf_dir))


_LEVELS = """d AS (SELECT DISTINCT a.scc AS a, b.scc AS b FROM edges JOIN scc a ON a.node = src JOIN scc b ON b.node = dst WHERE a.scc <> b.scc),
l AS (SELECT DISTINCT scc, 0 AS level FROM scc UNION SELECT a, level + 1 FROM d JOIN l ON l.scc = d.b) SELECT scc, max(level) AS level FROM l GROUP BY 1"""


@query(f"WITH RECURSIVE {ft.EDGES}, {_SCC}, {_LEVELS}")
def bottom_up_levels(spark, sf_dir):
    return graph.bottom_up_levels(*_components(spark, sf_dir))


@query(f"WITH RECURSIVE {ft.EDGES}, {_CLOSE} SELECT count(*) > 0 AS has_cycle FROM c WHERE src = dst")
def cycle_exists(spark, sf_dir):
    return graph.has_cycle(ft.part_edges(spark, sf_dir))


# dataflow: all parts as blocks, in functions of 60 with branches ahead and back ------------------------------------

_FLOW = """p AS (SELECT p_partkey + p_partkey // 60 * 3 AS block, p_partkey % 60 AS pos, p_size FROM part),
succ AS (SELECT block AS src, block + 1 + p_size % 3 AS dst FROM p UNION SELECT block, block + 1 FROM p UNION SELECT block, block - 1 - p_size % 6 FROM p WHERE pos >= 8 AND p_size % 7 = 0),
gen AS (SELECT block, 'g' || CAST(p_size % 5 AS VARCHAR) AS guard FROM p WHERE p_size % 2 = 0)"""


def _functions(spark, sf_dir, most: int = 60):
    """(block, pos, p_size): parts as blocks of functions of `most`; after each function three numbers are left for its exits."""
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select((k + F.floor(k / most) * 3).alias("block"), (k % most).alias("pos"), "p_size")


def _flow(p, most: int = 60):
    """Blocks with those behind the last ones, edges ahead and, in long functions, back, and guards."""
    k, s = F.col("block"), F.col("p_size")
    back = p.where("pos >= 8 and p_size % 7 = 0").select(k, k - 1 - s % 6)
    succ = p.select(k.alias("src"), (k + 1 + s % 3).alias("dst")).union(p.select(k, k + 1)).union(back).distinct()
    exits = succ.select(F.col("dst").alias("block"), F.lit(False).alias("is_entry")).join(p.select("block"), "block", "left_anti")
    blocks = p.select(k, (F.col("pos") == 0).alias("is_entry")).union(exits).distinct().withColumn("func", F.floor(k / (most + 3)))
    gen = p.where("p_size % 2 = 0").select(k, F.concat(F.lit("g"), (s % 5).cast("string")).alias("guard"))
    return blocks, succ, gen


@query(f"""WITH RECURSIVE {_FLOW}, g AS (SELECT DISTINCT guard FROM gen), free AS (SELECT block, guard FROM p CROSS JOIN g WHERE pos = 0 UNION
  SELECT dst, f.guard FROM free f JOIN succ ON src = f.block WHERE NOT EXISTS (SELECT 1 FROM gen WHERE gen.block = f.block AND gen.guard = f.guard)),
n AS (SELECT block FROM p WHERE pos = 0 UNION SELECT dst FROM n JOIN succ ON src = n.block)
SELECT block, guard FROM n CROSS JOIN g WHERE NOT EXISTS (SELECT 1 FROM free f WHERE f.block = n.block AND f.guard = g.guard) AND block NOT IN (SELECT block FROM p WHERE pos = 0)""")
def must_guards(spark, sf_dir):
    """The oracle finds the paths from the entries that miss a guard."""
    return dataflow.must_guards(*_flow(_functions(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_FLOW}, d AS (SELECT block, 'v' || CAST(p_size % 4 AS VARCHAR) AS var FROM p),
r AS (SELECT dst AS block, var, d.block AS def_block FROM d JOIN succ ON src = d.block UNION
  SELECT dst, r.var, r.def_block FROM r JOIN succ ON src = r.block WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.block = r.block AND d.var = r.var)) SELECT block, var, def_block FROM r""")
def reaching_defs(spark, sf_dir):
    p = _functions(spark, sf_dir)
    blocks, succ, _ = _flow(p)
    defs = p.select("block", F.concat(F.lit("v"), (F.col("p_size") % 4).cast("string")).alias("var"), F.col("p_size").alias("offset"))
    return dataflow.reaching_definitions(blocks, succ, defs).select("block", "var", "def_block")


@query("SELECT o_custkey AS k, CASE WHEN count(lo) = count(*) THEN min(lo) END AS lo, CASE WHEN count(hi) = count(*) THEN max(hi) END AS hi FROM (SELECT o_custkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS lo, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey + 5 END AS hi FROM orders) GROUP BY 1")
def bounds_hull(spark, sf_dir):
    o = F.col("o_orderkey")
    return dataflow.bounds_hull(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.when(o % 11 != 0, o).alias("lo"), F.when(o % 13 != 0, o + 5).alias("hi")), "k")


@query("SELECT l_orderkey AS block, bool_and(l_discount > 0.01) AS on_all, bool_or(l_discount > 0.01) AS on_any FROM lineitem GROUP BY 1")
def all_paths_guarded(spark, sf_dir):
    return dataflow.guarded_paths(load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block"), (F.col("l_discount") > 0.01).alias("guarded")))


# concurrency ------------------------------------------------------------------------------------------------------

_ACC = """acc AS (SELECT event_id AS id, user_id AS location, event_id % 5 AS thread, event_type = 'purchase' AS is_write,
  CASE WHEN user_id % 3 = 0 THEN ['m'] WHEN event_id % 2 = 0 THEN ['a'] ELSE ['b'] END AS locks FROM events),
unlocked AS (SELECT location FROM acc GROUP BY 1 HAVING count(DISTINCT thread) >= 2 AND bool_or(is_write) AND location NOT IN (
  SELECT location FROM (SELECT location, lock, count(*) AS n FROM (SELECT location, unnest(locks) AS lock FROM acc) GROUP BY ALL) JOIN (SELECT location, count(*) AS m FROM acc GROUP BY 1) USING (location) WHERE n = m))"""


def _accesses(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    locks = F.when(u % 3 == 0, F.array(F.lit("m"))).when(e % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("b")))
    return load(spark, sf_dir, "events").select(e.alias("id"), u.alias("location"), (e % 5).alias("thread"), (F.col("event_type") == "purchase").alias("is_write"), locks.alias("locks"))


@query(f"WITH {_ACC} SELECT location FROM unlocked")
def unlocked_locations(spark, sf_dir):
    return concurrency.unlocked_locations(_accesses(spark, sf_dir))


@query(f"""WITH {_ACC} SELECT x.location, x.thread AS t1, y.thread AS t2, count(*) AS n FROM acc x JOIN acc y ON x.location = y.location AND x.thread < y.thread AND (x.is_write OR y.is_write)
WHERE x.location IN (SELECT location FROM unlocked) AND abs(y.id - x.id) <> 7 GROUP BY ALL""")
def race_candidates(spark, sf_dir):
    """Pairs of racing accesses, counted for each location and two threads: a hot location has too many to list."""
    acc = _accesses(spark, sf_dir)
    return concurrency.race_counts(acc, acc.select(F.col("id").alias("a"), (F.col("id") + 7).alias("b")))


@query("""WITH o AS (SELECT l_orderkey AS t, l_suppkey % 40 AS lock, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem),
f AS (SELECT DISTINCT x.lock AS a, y.lock AS b FROM o x JOIN o y ON x.t = y.t AND x.pos < y.pos AND x.lock <> y.lock) SELECT f.a, f.b FROM f JOIN f g ON f.a = g.b AND f.b = g.a WHERE f.a < f.b""")
def lock_order_violations(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    rows = lines.groupBy(F.col("l_orderkey").alias("thread")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("r"))
    return concurrency.lock_order_violations(rows.select("thread", F.transform("r", lambda x: x["l_suppkey"] % 40).alias("locks")))


# text sources -----------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, line, value FROM l WHERE regexp_matches(value, '(?i)licen[sc]e')""")
def grep_lines(spark, sf_dir):
    return text.grep(load(spark, sf_dir, "documents").where("text is not null"), "(?i)licen[sc]e", key="doc_id")


@query("""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS v, CAST(5 AS INT) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, line, greatest(1, line - 3) AS first, least(len(v), line + 3) AS last, array_to_string(v[greatest(1, line - 3):least(len(v), line + 3)], chr(10)) AS snippet FROM s WHERE line <= len(v)""")
def source_snippets(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").where("text is not null")
    return text.snippets(docs, docs.select("doc_id", F.lit(5).alias("line")), key="doc_id")


@query("SELECT p_partkey AS id, upper(replace(p_name, ' ', '_')) AS bug_type FROM part")
def alert_types(spark, sf_dir):
    """Names outside the table are put in capitals."""
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alert_type(F.col("p_name")).alias("bug_type"))


@query(f"""WITH {ft.CURRENT}, u AS (SELECT rule, dense_rank() OVER (ORDER BY rule) - 1 AS rule_index FROM (SELECT DISTINCT rule FROM current_)) SELECT seq, rule, CAST(rule_index AS INT) AS rule_index FROM current_ JOIN u USING (rule)""")
def sarif_rule_index(spark, sf_dir):
    """Results as SARIF objects, read back from their JSON."""
    built = sarif.build(ft.sarif_rows(spark, sf_dir, True).withColumn("line", F.lit(1)))
    return built.select("seq", F.get_json_object("json", "$.ruleId").alias("rule"), F.get_json_object("json", "$.ruleIndex").cast("int").alias("rule_index"))


@query(f"WITH {ft.CURRENT} SELECT seq, qualname, rule LIKE '1%' AS confirmed FROM current_ WHERE rule LIKE '1%' OR uri NOT IN (SELECT uri FROM current_ WHERE rule LIKE '1%')")
def suppress_proven(spark, sf_dir):
    rows = ft.sarif_rows(spark, sf_dir, True)
    return sarif.suppress_proven(rows.where("rule like '1%'"), rows.where("rule not like '1%'"), "uri").select("seq", "qualname", "confirmed")


@query()
def python_facts(spark, sf_dir):
    """Functions and calls of source texts made from the parts' names; parsing has no SQL."""
    names = load(spark, sf_dir, "part").select(F.concat(F.lit("pkg/m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("def f"), F.col("p_partkey").cast("string"), F.lit("(x):\n    if x:\n        return g("), F.col("p_size").cast("string"), F.lit(") + f"), (F.col("p_partkey") % 17).cast("string"), F.lit("(x)\n")).alias("text"))
    return python_source.facts(names)


# contracts, intent, traces ----------------------------------------------------------------------------------------

_NAMES = ["os.system", "app.requests.get", "tar.open", "db.cur.execute", "get", "x.nothing", "my.subprocess.run", "logging.info"]
_KEYS = ["os.system", "requests.get", None, "cursor.execute", None, None, "subprocess.run", "logging.info"]


@query(f"""WITH n AS (SELECT p_partkey AS id, p_partkey % 8 AS k FROM part) SELECT id, CASE k {' '.join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_NAMES))} END AS name,
  CASE k {' '.join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_KEYS) if v)} END AS key FROM n""")
def contract_match(spark, sf_dir):
    calls = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % 8 + 1).cast("int")).alias("name"))
    return calls.join(contracts.match(calls, contracts.sinks(spark)), "name").select("id", "name", "key")


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS call, l_suppkey % 2 AS arg, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS tau, CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS kappa, l_orderkey % 2 = 0 AS sys FROM lineitem)
SELECT call, min(arg) AS arg FROM c WHERE arg = 0 AND tau = 1 AND (sys OR kappa = 0) GROUP BY call, sys""")
def contract_violations(spark, sf_dir):
    """Shell and SQL calls with tainted first arguments; SQL arguments may be sanitised."""
    c = F.col
    bit = lambda x: F.when(x, 1).otherwise(0).cast("long")
    calls = load(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("call"), F.when(c("l_orderkey") % 2 == 0, "os.system").otherwise("cursor.execute").alias("name"), (c("l_suppkey") % 2).cast("int").alias("arg"),
        bit(c("l_partkey") % 3 == 0).alias("tau"), bit(c("l_partkey") % 5 == 0).alias("kappa"), F.lit(0).cast("long").alias("sigma"), F.lit(None).cast("boolean").alias("shell"),
    )
    return contracts.violations(calls, contracts.sinks(spark)).select("call", F.col("arg").cast("long").alias("arg"))


_PATHS = ["src/app.py", "tests/a.py", "pkg/tests/test_x.py", "pkg/examples/run.py", "pkg/settings.py", "pkg/migrations/m1.py", "src/conftest.py", "demo.py"]
_SIGNALS = ["", "", "test", "example", "config", "migration", "test", ""]


@query(f"""SELECT event_id AS id, CASE event_id % 8 {' '.join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_SIGNALS))} END || CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 8 IN (0, 1, 7) THEN '' ELSE ',' END || 'self' ELSE '' END AS kinds,
  event_id % 8 IN (1, 2, 6) AS is_test FROM events""")
def intent_signals(spark, sf_dir):
    e = F.col("event_id")
    rows = load(spark, sf_dir, "events").select(e.alias("id"), F.element_at(F.array(*map(F.lit, _PATHS)), (e % 8 + 1).cast("int")).alias("path"), F.when(e % 3 == 0, "self").otherwise("x").alias("var"))
    found = intent.signals(F.col("path"), F.lit("NULL_PTR"), F.col("var"), F.lit("f"))
    return rows.select("id", F.array_join(F.transform(found, lambda s: s["kind"]), ",").alias("kinds"), intent.is_test_path(F.col("path")).alias("is_test"))


_TRACE = """t AS (SELECT user_id AS id, event_id, event_type, 'line ' || CAST(event_id AS VARCHAR) || ': ' || upper(event_type) || ' ' || CAST(user_id AS VARCHAR) AS op FROM events)"""


def _traces(spark, sf_dir):
    e = F.col("event_type")
    line = F.when(e == "error", F.concat(F.lit("UNHANDLED EXCEPTION: E"), (F.col("event_id") % 7).cast("string"), F.lit(" at top"))).when(e == "view", F.concat(F.lit("0 IMPORT_NAME m"), (F.col("event_id") % 5).cast("string")))
    line = F.coalesce(line, F.concat(F.lit("line "), F.col("event_id").cast("string"), F.lit(": "), F.upper(e), F.lit(" "), F.col("user_id").cast("string")))
    return load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("l")).select("id", F.transform("l", lambda x: x["line"]).alias("lines"))


@query("""SELECT kind, value, count(*) AS n FROM (SELECT CASE event_type WHEN 'error' THEN 'exception' WHEN 'view' THEN 'import' ELSE 'opcode' END AS kind,
  CASE event_type WHEN 'error' THEN 'UNHANDLED EXCEPTION: E' || CAST(event_id % 7 AS VARCHAR) || ' at top' WHEN 'view' THEN 'm' || CAST(event_id % 5 AS VARCHAR) ELSE upper(event_type) END AS value FROM events) GROUP BY ALL""")
def trace_patterns(spark, sf_dir):
    return traces.trace_features(_traces(spark, sf_dir)).groupBy("kind", "value").agg(F.count("*").alias("n"))


@query("""SELECT user_id AS id, coalesce('E' || CAST(max(event_id) FILTER (event_type = 'error') % 7 AS VARCHAR), 'Unknown') AS exception FROM events GROUP BY 1""")
def exception_types(spark, sf_dir):
    return traces.last_exception(_traces(spark, sf_dir))


@query("""WITH a AS (SELECT l_orderkey AS bug, l_linenumber * 1000000 + l_partkey * 1000 + l_suppkey AS o, l_returnflag AS barrier, l_discount * 10 AS c FROM lineitem),
p AS (SELECT bug, arg_min(barrier, o) AS barrier FROM a WHERE c >= 0.6 GROUP BY 1) SELECT k.barrier, count(p.bug) AS n FROM (VALUES ('A'), ('N'), ('R'), ('Z')) AS k(barrier) LEFT JOIN p USING (barrier) GROUP BY 1""")
def barrier_counts(spark, sf_dir):
    """First proof of each bug, counted by kind; a kind without any counts 0."""
    c = F.col
    attempts = load(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("bug"), (c("l_linenumber") * 1000000 + c("l_partkey") * 1000 + c("l_suppkey")).alias("ordinal"), c("l_returnflag").alias("barrier"), (c("l_discount") * 10).alias("confidence"))
    return traces.proof_counts(traces.first_proof(attempts), spark.createDataFrame([("A",), ("N",), ("R",), ("Z",)], "barrier string"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS t, list_sort(list_distinct(list(l_returnflag))) AS a, list_sort(list_distinct(list(l_linestatus))) AS b FROM lineitem GROUP BY 1)
SELECT t, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS joined, array_to_string(list_sort(list_intersect(a, b)), ',') AS met, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS below FROM s""")
def set_lattice(spark, sf_dir):
    from factloom.functions import sets

    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("t")).agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("t", F.array_join(sets.join(a, b), ",").alias("joined"), F.array_join(sets.meet(a, b), ",").alias("met"), sets.below(a, b).alias("below"))


@query("""WITH RECURSIVE i AS (SELECT p_partkey AS pred, p_partkey - p_partkey % 60 + (p_partkey * 3 + p_size) % 60 AS needs FROM part),
r AS (SELECT p_partkey AS pred FROM part WHERE p_size % 10 = 0 UNION SELECT pred FROM i WHERE needs NOT IN (SELECT p_partkey FROM part) UNION SELECT i.pred FROM i JOIN r ON i.needs = r.pred)
SELECT p_partkey AS pred FROM part WHERE p_partkey NOT IN (SELECT pred FROM r)""")
def houdini(spark, sf_dir):
    """Predicates in groups of 60; those of the last group may rest on some that are no candidates."""
    k, p = F.col("p_partkey"), load(spark, sf_dir, "part")
    needs = k - k % 60 + (k * 3 + F.col("p_size")) % 60
    return dataflow.houdini(p.select(k.alias("pred")), p.select(k.alias("pred"), needs.alias("needs")), p.where("p_size % 10 = 0").select(k.alias("pred")))


# loops, paths, summaries ------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_FLOW}, back AS (SELECT block AS src, block - p_size % 9 AS header FROM p WHERE pos >= 10 AND p_size % 4 = 0),
l AS (SELECT header, src AS block FROM back UNION SELECT l.header, s.src FROM l JOIN succ s ON s.dst = l.block WHERE l.block <> l.header)
SELECT header, block FROM l UNION SELECT header, header FROM back""")
def natural_loops(spark, sf_dir):
    p, k, s = _functions(spark, sf_dir), F.col("block"), F.col("p_size")
    return dataflow.natural_loops(_flow(p)[1], p.where("pos >= 10 and p_size % 4 = 0").select(k.alias("src"), (k - s % 9).alias("header")))


@query(f"""WITH RECURSIVE {_FLOW}, g AS (SELECT block, bool_or(guard = 'g0') AS g0, bool_or(guard = 'g2') AS g2 FROM gen GROUP BY 1),
st AS (SELECT block, false AS a, false AS b FROM p WHERE pos = 0 UNION SELECT s.dst, st.a OR coalesce(g.g0, false), st.b OR coalesce(g.g2, false) FROM st LEFT JOIN g USING (block) JOIN succ s ON s.src = st.block)
SELECT block, bool_and(a) AS on_all, bool_or(a) AS on_any FROM st GROUP BY 1""")
def guarded_on_paths(spark, sf_dir):
    """Paths with two kinds of guards; the first is asked for."""
    blocks, succ, gen = _flow(_functions(spark, sf_dir))
    return dataflow.guarded_on_paths(dataflow.path_states(blocks, succ, gen.where("guard in ('g0', 'g2')"), None), "g0")


_SUM = """call AS (SELECT p_partkey AS func, p_size, p_partkey - p_partkey % 120 + (p_partkey * 3 + p_size) % 120 AS callee FROM part),
direct AS (SELECT func, func % 3 AS param, CASE WHEN p_size % 3 = 0 THEN -1 ELSE p_size % 7 END AS target FROM call WHERE p_size % 2 = 0),
pass AS (SELECT func, p_size % 3 AS param, callee, func % 3 AS arg FROM call),
ret AS (SELECT func, callee FROM call WHERE func % 2 = 0),
f AS (SELECT func, param, target FROM direct UNION SELECT p.func, p.param, f.target FROM f JOIN pass p ON p.callee = f.func AND p.arg = f.param
  WHERE f.target <> -1 OR EXISTS (SELECT 1 FROM ret r WHERE r.func = p.func AND r.callee = p.callee))"""


def _summaries(p):
    k, s = F.col("p_partkey"), F.col("p_size")
    direct = p.where("p_size % 2 = 0").select(k.alias("func"), (k % 3).alias("param"), F.when(s % 3 == 0, -1).otherwise(s % 7).alias("target"))
    passes = p.select(k.alias("func"), (s % 3).cast("long").alias("param"), _callee().alias("callee"), (k % 3).alias("arg"))
    return summaries.flows(direct, passes, p.where("p_partkey % 2 = 0").select(k.alias("func"), _callee().alias("callee")))


def _callee():
    """The part that a part calls, in modules of 120."""
    k = F.col("p_partkey")
    return k - k % 120 + (k * 3 + F.col("p_size")) % 120


@query(f"WITH RECURSIVE {_SUM} SELECT func, param, target FROM f")
def taint_summaries(spark, sf_dir):
    return _summaries(load(spark, sf_dir, "part"))


@query(f"""WITH RECURSIVE {_SUM}, live AS (SELECT func AS node FROM call WHERE p_size <= 5 UNION SELECT callee FROM live JOIN call ON func = node)
SELECT DISTINCT l_orderkey AS call, func, target FROM lineitem JOIN f ON func = l_partkey AND param = l_suppkey % 3 WHERE target <> -1 AND l_returnflag = 'R' AND l_partkey IN (SELECT node FROM live)""")
def security_bugs(spark, sf_dir):
    """Calls of any part; reachable is what parts of size 5 or less call, directly or not, and these parts."""
    c = F.col
    p = load(spark, sf_dir, "part")
    live = graph.reachable(p.select(c("p_partkey").alias("src"), _callee().alias("dst")), p.where("p_size <= 5").select(c("p_partkey").alias("node")), p.select(c("p_partkey").alias("node")))
    calls = load(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("call"), c("l_partkey").alias("caller"), c("l_partkey").alias("func"), (c("l_suppkey") % 3).alias("arg"), (c("l_returnflag") == "R").alias("tainted"))
    return summaries.security_bugs(live, calls, _summaries(p))
