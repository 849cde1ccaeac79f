"""Queries of the text formats, on texts made from the driver's tables.  The SQL of each is what it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import intent
from factloom.plans.registry import load, query
from factloom.sources import python_source, sarif, text
from factloom.storage import dealt


def _k():
    return F.col("p_partkey")


def _parts(spark, sf_dir):
    """The parts, dealt over all cores for what Python parses."""
    return dealt(load(spark, sf_dir, "part"))


def _text(*parts):
    """A column of text from columns and strings."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, line, value FROM l WHERE regexp_matches(value, '^[A-Z].*\\.$')""")
def grep_anchored(spark, sf_dir):
    """Lines from a capital to a full stop: both ends are those of a line."""
    return text.grep(load(spark, sf_dir, "documents").where("text is not null"), r"^[A-Z].*\.$", key="doc_id")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, line, value FROM l WHERE line BETWEEN 2 AND 3""")
def file_lines(spark, sf_dir):
    return text.read_lines(load(spark, sf_dir, "documents").where("text is not null"), 2, 3, key="doc_id")


@query("""WITH p AS (SELECT 'd' || CAST(p_size AS VARCHAR) AS d, 'f' || CAST(p_partkey AS VARCHAR) || '.py' AS f FROM part) SELECT '' AS folder, 'src' AS entry UNION SELECT 'src', d FROM p UNION SELECT 'src/' || d, f FROM p""")
def folder_entries(spark, sf_dir):
    return text.folders(load(spark, sf_dir, "part").select(_text("src/d", F.col("p_size"), "/f", _k(), ".py").alias("path")))


@query("""SELECT p_partkey AS id, 'name' AS name, p_name AS value FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) || '=x' FROM part""")
def key_values(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(_k().alias("id"), _text('name="', F.col("p_name"), '"\n# a comment\n size = ', F.col("p_size"), "=x\n").alias("text"))
    return text.key_values(rows, "id")


@query("""SELECT o_orderkey AS idx, 'sha' || CAST(o_custkey AS VARCHAR) AS sha, 's' || CAST(o_custkey AS VARCHAR) AS short, o_orderpriority AS date, substr('fix ' || repeat('x', CAST(o_orderkey % 90 AS INT)), 1, 72) AS msg, 'A|B' AS author
FROM orders WHERE o_orderkey % 10 <> 3""")
def git_log(spark, sf_dir):
    """A log line of each order, every tenth broken."""
    k = F.col("o_orderkey")
    line = _text("sha", F.col("o_custkey"), "|s", F.col("o_custkey"), "|", F.col("o_orderpriority"), "|fix ", F.repeat(F.lit("x"), (k % 90).cast("int")), "|A|B")
    return text.git_log(load(spark, sf_dir, "orders").select(k.alias("idx"), F.when(k % 10 == 3, "broken").otherwise(line).alias("value")))


@query("""SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN 'SSRF' WHEN 1 THEN 'NULL_PTR' WHEN 2 THEN 'DIV_ZERO' WHEN 3 THEN 'BOUNDS' WHEN 4 THEN 'KEY_ERROR' ELSE 'XSS' END AS bug_type, p_size AS line,
  CASE WHEN p_partkey % 7 = 0 THEN 0.75::DOUBLE ELSE 0::DOUBLE END AS confidence FROM part WHERE p_partkey % 7 < 6""")
def tool_findings(spark, sf_dir):
    """The forms of a finding in a tool's output, and a line that is none."""
    n = F.col("p_size")
    forms = [_text("[BUG] SSRF (line ", n, ", confidence 0.75)"), _text("bug: null_ptr seen at line ", n), _text("Found bug: DIV_ZERO in f on line ", n), _text("  BOUNDS: line ", n), _text("possible key_error near line ", n), _text("[bug] xss (line ", n, ")")]
    line = F.coalesce(*(F.when(_k() % 7 == i, f) for i, f in enumerate(forms)), F.lit("no findings here"))
    return text.parse_findings(load(spark, sf_dir, "part").select(_k().alias("id"), F.concat(F.lit("scan\n"), line, F.lit("\ndone")).alias("text")), "id").select("id", "bug_type", "line", "confidence")


@query("""SELECT 'p' || CAST(p_partkey AS VARCHAR) AS patch, 'src/f' || CAST(p_size AS VARCHAR) || '.py' AS file, 'a' || chr(10) || 'old' || chr(10) || 'z' AS buggy, 'a' || chr(10) || p_name || chr(10) || 'more' || chr(10) || 'z' AS fixed,
  CAST(p_size + 1 AS VARCHAR) AS buggy_lines, CAST(p_size + 1 AS VARCHAR) || ',' || CAST(p_size + 2 AS VARCHAR) AS fixed_lines FROM part""")
def patches(spark, sf_dir):
    n = F.col("p_size")
    diff = _text("diff --git a/src/f", n, ".py b/src/f", n, ".py\nindex 1..2 100644\n--- a/src/f", n, ".py\n+++ b/src/f", n, ".py\n@@ -", n, ",3 +", n, ",4 @@ def f():\n a\n-old\n+", F.col("p_name"), "\n+more\n z\n")
    got = text.parse_patches(_parts(spark, sf_dir).select(_text("p", _k()).alias("patch"), diff.alias("text")))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return got.select("patch", "file", "buggy", "fixed", joined("buggy_lines"), joined("fixed_lines"))


_REPLIES = (
    ('{"verdict": "TP", "confidence": 0.9, "rationale": "r"}', "TP", 0.9),
    ('so: {"verdict":"tp","confidence":0.8} ok', "TP", 0.8),
    ("```json\n{\"verdict\": \"FP\", \"rationale\": \"dict {a} is safe\"}\n```", "FP", 0.5),
    ("{}", "FP", 0.5),
    ("no json at all", "TP", 0.5),
    ('{"verdict": "maybe", "confidence": 1}', "FP", 1.0),
    ('{"verdict": "TP", "confidence": "high"}', "TP", 0.5),
    ('{"verdict": "FP", "confidence": 0.3', "TP", 0.5),
)
_VERDICT = lambda i: " ".join(f"WHEN {k} THEN {r[i]!r}" for k, r in enumerate(_REPLIES))


@query(f"SELECT event_id AS seq, CASE event_id % 8 {_VERDICT(1)} END AS verdict, CASE event_id % 8 {_VERDICT(2)} END::DOUBLE AS confidence FROM events")
def llm_verdicts(spark, sf_dir):
    """Replies as they come: plain, in a sentence, fenced with braces inside, empty, unreadable."""
    k = F.col("event_id")
    replies = F.array(*(F.lit(r[0]) for r in _REPLIES))
    said = load(spark, sf_dir, "events").select(k.alias("seq"), sarif.parse_verdict(F.get(replies, (k % 8).cast("int"))).alias("v"))
    return said.select("seq", "v.verdict", "v.confidence")


@query(f"SELECT event_id AS seq FROM events WHERE CASE event_id % 8 {_VERDICT(1)} END = 'TP' AND CASE event_id % 8 {_VERDICT(2)} END >= 0.6")
def triaged(spark, sf_dir):
    """Results whose reply holds them true with enough confidence."""
    return sarif.triage(load(spark, sf_dir, "events").select(F.col("event_id").alias("seq")), llm_verdicts(spark, sf_dir), 0.6)


@query("""WITH t AS (SELECT user_id, event_id, event_type, value FROM events WHERE event_type IN ('error', 'signup') AND value / 600 >= 0.5)
SELECT event_id AS seq, '## `' || event_type || '` in `m' || CAST(user_id AS VARCHAR) || '.f`' AS title FROM t UNION ALL SELECT NULL, '**Confirmed true positives:** ' || CAST(count(*) AS VARCHAR) || '  ' FROM t""")
def true_positive_report(spark, sf_dir):
    """The first line of each block of the report, and the count in its head."""
    c, e = F.col, F.col("event_type")
    rows = load(spark, sf_dir, "events").select(
        c("event_id").alias("seq"), e.alias("rule"), _text("pkg.m", c("user_id"), ".f").alias("qualname"), F.lit("a.py").alias("uri"), F.lit(3).alias("line"), F.when(e.isin("error", "signup"), "TP").otherwise("FP").alias("verdict"),
        (c("value") / 600).alias("confidence"), F.lit("why").alias("rationale"), F.lit("(none)").alias("context"),
    )
    got = sarif.report(rows, "p", "m", 0.5)
    return got.select("seq", F.get(F.split("markdown", "\n"), F.when(c("seq").isNull(), 3).otherwise(0)).alias("title"))


@query("""WITH p AS (SELECT 'pkg/m' || CAST(p_partkey AS VARCHAR) || '.py' AS path, 'pkg.m' || CAST(p_partkey AS VARCHAR) AS m, p_partkey % 3 AS k, p_partkey FROM part)
SELECT m || '.f' AS node, 'decorator' AS reason FROM p WHERE k = 0 UNION ALL SELECT m || '.main', 'name' FROM p WHERE k = 1 UNION ALL SELECT m, 'module' FROM p WHERE k < 2 OR p_partkey % 2 = 0""")
def entry_points(spark, sf_dir):
    """Modules with a route, with a main function, and with code of their own half the time."""
    code = F.when(_k() % 3 == 0, "@app.route('/')\ndef f(*args, **kw):\n    return g()\n").when(_k() % 3 == 1, "def main():\n    return 1\n").otherwise("def h():\n    return 2\n")
    extra = F.when((_k() % 3 < 2) | (_k() % 2 == 1), "").otherwise("x = 1\n")
    return python_source.entry_points(python_source.facts(_parts(spark, sf_dir).select(_text("pkg/m", _k(), ".py").alias("path"), F.concat(code, extra).alias("text"))))


@query("""SELECT 'm' || CAST(p_partkey AS VARCHAR) || '.py' AS path, CASE p_partkey % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'h' WHEN 2 THEN 'i' ELSE NULL END AS called, p_partkey % 4 = 3 AS failed FROM part""")
def repaired_calls(spark, sf_dir):
    """Code out of its place: indented, a block without a body, pieces of a diff, and text that is no code."""
    texts = F.array(*map(F.lit, ("    x = g(1)\n    return x\n", "for a in b:\nh(a)\n", "# @@ hunk @@\n    i(2)\n# @@ hunk @@\nelse_ = 3\nreturn else_\n", "not code at (")))
    rows = _parts(spark, sf_dir).select(_text("m", _k(), ".py").alias("path"), F.get(texts, (_k() % 4).cast("int")).alias("text"))
    found = python_source.facts(rows, repair=True).where("kind in ('call', 'error')")
    return found.groupBy("path").agg(F.max(F.when(F.col("kind") == "call", F.col("name"))).alias("called"), F.some(F.col("kind") == "error").alias("failed"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS n FROM part)
SELECT 'src/f' || CAST(k AS VARCHAR) || '.py' AS path, 'buggy' AS side, 'opened' AS called, n + 1 AS changed, false AS failed FROM p
UNION ALL SELECT 'src/f' || CAST(k AS VARCHAR) || '.py', 'fixed', CASE k % 3 WHEN 0 THEN 'checked' ELSE 'fresh' || CAST(n AS VARCHAR) END, n + 1, false FROM p""")
def patched_calls(spark, sf_dir):
    """From patches to facts: what the two sides of each file call first, whose hunks parse alone or only together, and the first changed line.

    Each patch also touches a test and a file of text, which are left aside, and has lines that look like headers of files.
    """
    n, c = F.col("p_size"), F.concat
    head = lambda f: c(F.lit("--- a/"), f, F.lit("\n+++ b/"), f, F.lit("\n"))
    path = _text("src/f", _k(), ".py")
    new = F.when(_k() % 3 == 0, "checked").otherwise(_text("fresh", n))
    whole = c(_text("@@ -", n, ",3 +", n, ",3 @@\n     value = 1\n-"), F.lit("    a = opened(value)\n+    a = "), new, F.lit("(value)\n     return value\n"))
    first = c(_text("@@ -", n, ",2 +", n, ",2 @@\n     keep = [\n-"), F.lit("        opened(1),\n+        "), new, F.lit("(1),\n"))  # ends inside of a bracket
    second = F.lit("@@ -90,2 +90,2 @@\n         2,\n     ]\n")
    noted = F.lit("@@ -120,2 +120,2 @@\n--- old comment\n+++ new comment\n-x = 1\n+x = 2\n")
    code = F.when(_k() % 2 == 0, whole).otherwise(c(first, second))
    diff = c(head(path), code, head(F.lit("tests/test_a.py")), F.lit("@@ -1 +1 @@\n-a()\n+b()\n"), head(F.lit("notes.txt")), noted)
    found = text.parse_patches(_parts(spark, sf_dir).select(_text("p", _k()).alias("patch"), diff.alias("text")), only_source=True, marks=True)
    sides = found.select("file", F.explode(F.array(F.struct(F.lit("buggy").alias("side"), F.col("buggy").alias("text"), F.col("buggy_lines").alias("at")), F.struct(F.lit("fixed").alias("side"), F.col("fixed").alias("text"), F.col("fixed_lines").alias("at")))).alias("s"))
    named = sides.select(c(F.col("s.side"), F.lit(":"), F.col("file")).alias("path"), "s.text", F.get("s.at", F.lit(0)).alias("changed"))
    facts = python_source.facts(named, repair=True).where("kind in ('call', 'error')")
    calls = facts.groupBy("path").agg(F.min_by("name", F.struct("line", "col")).alias("called"), F.some(F.col("kind") == "error").alias("failed"))
    split = F.split("path", ":", 2)
    return named.select("path", "changed").join(calls, "path", "left").select(F.get(split, F.lit(1)).alias("path"), F.get(split, F.lit(0)).alias("side"), "called", "changed", "failed")


# Source files of the parts: imports, a helper whose name parts of one size share, and a method that imports late.
_MODULES = """m AS (SELECT p_partkey AS k, p_size AS n, 'src/d' || CAST(p_size AS VARCHAR) || '/m' || CAST(p_partkey AS VARCHAR) || '.py' AS path FROM part)"""


def _modules(spark, sf_dir):
    n = F.col("p_size")
    code = _text("import os, re as r", n, "\nfrom .a", _k(), " import (b as c,\n  d)\n\ndef helper", n, "(x):\n    return x or ", _k(), "\n\nclass C:\n    def run(self):\n        import late\n        return helper", n, "(self)\n")
    return _parts(spark, sf_dir).select(_text("src/d", n, "/m", _k(), ".py").alias("path"), code.alias("text"), _k().alias("k"), n.alias("n"))


@query(f"""WITH {_MODULES} SELECT path, 1 AS line, 'import os' AS statement FROM m UNION ALL SELECT path, 1, 'import re as r' || CAST(n AS VARCHAR) FROM m UNION ALL SELECT path, 2, 'from .a' || CAST(k AS VARCHAR) || ' import b as c, d' FROM m""")
def file_imports(spark, sf_dir):
    """Imports at the top level; those inside of functions are not among them."""
    return python_source.imports(python_source.facts(_modules(spark, sf_dir)))


@query(f"""WITH {_MODULES}, r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY path) AS any_file FROM m)
SELECT 'x.helper' || CAST(n AS VARCHAR) AS name, NULL::VARCHAR AS in_file, path, 5 AS first, 6 AS last, '   5 | def helper' || CAST(n AS VARCHAR) || '(x):' || chr(10) || '   6 |     return x or ' || CAST(k AS VARCHAR) AS source FROM r WHERE any_file <= 3
UNION ALL SELECT 'run', path, path, 9, 11, '   9 |     def run(self):' || chr(10) || '  10 |         import late' || chr(10) || '  11 |         return helper' || CAST(n AS VARCHAR) || '(self)' FROM m""")
def function_lookups(spark, sf_dir):
    """The helper of each size wherever it is, which gives three, and the method of each file."""
    files = _modules(spark, sf_dir)
    wanted = files.select(_text("x.helper", F.col("n")).alias("name"), F.lit(None).cast("string").alias("in_file")).union(files.select(F.lit("run"), "path")).union(spark.range(1).select(F.lit("nowhere"), F.lit(None)))
    return python_source.function_sources(files, python_source.facts(files), wanted).select("name", "in_file", "path", "first", "last", "source")


_KINDS = ("DIV_ZERO", "VALUE_ERROR", "IMPORT_ERROR", "FILE_NOT_FOUND", "BOUNDS", "NULL_PTR")


@query(f"""WITH p AS (SELECT p_partkey AS id, {list(_KINDS)}[p_partkey % 6 + 1] AS bug, 'def other(a=' || CAST(p_size % 4 AS VARCHAR) || '):' || chr(10) || '    return a or 1' || chr(10) AS head,
  'def f(request):' || chr(10) || CASE p_size % 5 WHEN 0 THEN '    x = request or ' || CAST(p_size AS VARCHAR) WHEN 1 THEN '    raise ValueError(1)' WHEN 2 THEN '    try:' || chr(10) || '        import y' || chr(10) || '    except ImportError:' || chr(10) || '        y = 1'
    WHEN 3 THEN '    x = 1 if request else 2' ELSE '    x = request' END AS body, CASE WHEN p_size % 2 = 0 THEN 'request.name' ELSE 'in_path' END AS var, 4 + p_size % 9 AS line, p_partkey % 7 = 0 AS lost FROM part),
t AS (SELECT *, head || body || chr(10) || CASE WHEN lost THEN 'x = (' ELSE '' END AS code FROM p), b AS (SELECT *, string_split(code, chr(10)) AS v, CASE WHEN lost THEN code ELSE body END AS searched FROM t),
s AS (SELECT *, array_to_string(v[greatest(1, line - 9):line], chr(10)) AS near FROM b),
c AS (SELECT id, (CASE WHEN bug = 'NULL_PTR' AND var = 'request.name' THEN 1 - 0.95::DOUBLE ELSE 1 END) * (CASE WHEN bug <> 'BOUNDS' AND regexp_matches(searched, '\\bor\\s+\\d+|if\\s+\\w+\\s+else\\s+') THEN 1 - 0.7::DOUBLE ELSE 1 END)
  * (CASE WHEN bug = 'VALUE_ERROR' AND contains(code, 'raise ValueError') THEN 1 - 0.9::DOUBLE ELSE 1 END) * (CASE WHEN bug = 'IMPORT_ERROR' THEN 0.5::DOUBLE * CASE WHEN contains(code, 'except ImportError') THEN 1 - 0.95::DOUBLE ELSE 1 END ELSE 1 END)
  * (CASE WHEN bug = 'DIV_ZERO' AND regexp_matches(code, 'def\\s+\\w+\\([^)]*=\\s*[1-9][^,)]*\\)') THEN 1 - 0.6::DOUBLE ELSE 1 END) * (CASE WHEN line <= len(v) AND contains(near, 'except') AND contains(near, 'try') THEN 1 - 0.7::DOUBLE ELSE 1 END)
  * (CASE WHEN bug = 'FILE_NOT_FOUND' AND var <> 'in_path' THEN 1 - 0.3::DOUBLE ELSE 1 END) AS left_ FROM s)
SELECT id, round(left_, 6) AS adjusted, left_ >= 0.5 AS keep FROM c""")
def bugs_in_code(spark, sf_dir):
    """Findings judged with the code of their functions; the file has a guarded function besides, and does not parse every seventh time."""
    n = F.col("p_size")
    ways = [_text("    x = request or ", n), F.lit("    raise ValueError(1)"), F.lit("    try:\n        import y\n    except ImportError:\n        y = 1"), F.lit("    x = 1 if request else 2"), F.lit("    x = request")]
    body = F.concat(F.lit("def f(request):\n"), F.get(F.array(*ways), (n % 5).cast("int")), F.lit("\n"))
    code = F.concat(_text("def other(a=", n % 4, "):\n    return a or 1\n"), body, F.when(_k() % 7 == 0, "x = (").otherwise(""))
    part = _parts(spark, sf_dir).withColumn("path", _text("src/p", _k(), ".py"))
    texts = part.select("path", code.alias("text"))
    bug = F.get(F.array(*map(F.lit, _KINDS)), (_k() % 6).cast("int"))
    rows = part.select(_k().alias("id"), "path", bug.alias("bug"), F.lit("m.f").alias("function"), F.when(n % 2 == 0, "request.name").otherwise("in_path").alias("variable"), (4 + n % 9).cast("int").alias("line"))
    c = F.col
    got = python_source.bodies(texts, python_source.facts(texts), rows)
    got = got.select("id", intent.judged(c("path"), c("bug"), c("variable"), c("function"), F.lit(1.0), 0.5, c("code"), c("line"), c("body")).alias("j"))
    return got.select("id", F.round("j.adjusted", 6).alias("adjusted"), "j.keep")
