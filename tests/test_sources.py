"""Sources, sinks and streams."""

import json

from pyspark.sql import functions as F

from factloom.sources import python_source, sarif, text
from factloom.streaming import findings as stream

CODE = '''
import os
from .util import helper as h

class Runner:
    def go(self, x):
        if x is None:
            return helper(x)
        return self.stop(os.path.join("a", x))

    def stop(self, x):
        return x

def main():
    Runner().go(1)

if __name__ == "__main__":
    main()
'''


def test_python_facts_and_graph(spark):
    files = spark.createDataFrame([("pkg/run.py", CODE), ("pkg/util.py", "def helper(x):\n    return 1 / x\n"), ("bad.py", "def (:"), ("empty.py", "")], "path string, text string")
    found = python_source.facts(files).cache()
    assert {r.qname for r in python_source.functions(found).collect()} == {"pkg.run.Runner.go", "pkg.run.Runner.stop", "pkg.run.main", "pkg.util.helper"}
    assert [r.path for r in found.where("kind = 'error'").collect()] == ["bad.py"]
    assert {(r.src, r.dst) for r in python_source.call_graph(found).collect()} >= {("pkg.run.Runner.go", "pkg.run.Runner.stop"), ("pkg.run.Runner.go", "pkg.util.helper"), ("pkg.run", "pkg.run.main")}
    assert {(r.node, r.reason) for r in python_source.entry_points(found).collect()} == {("pkg.run", "main"), ("pkg.run", "module"), ("pkg.run.main", "name")}
    assert found.where("kind = 'guard'").count() == 2


def test_lookups_by_function_and_imports(spark):
    files = spark.createDataFrame([("pkg/run.py", CODE), ("a.py", "import x.y as z, w\nfrom ..q import *\ndef go():\n    import late\n"), ("bad.py", "def go(:"), (None, None)], "path string, text string")
    found = python_source.facts(files).cache()
    assert {tuple(r) for r in python_source.imports(found).where("path = 'a.py'").collect()} == {("a.py", 1, "import x.y as z"), ("a.py", 1, "import w"), ("a.py", 2, "from ..q import *")}
    ask = lambda *rows: spark.createDataFrame(list(rows), "name string, in_file string")
    got = {(r.name, r.in_file): (r.path, r.source) for r in python_source.function_sources(files, found, ask(("Runner.go", "pkg/"), ("go", "a.py"), ("none", None), (None, None))).collect()}
    assert set(got) == {("Runner.go", "pkg/"), ("go", "a.py")} and got["go", "a.py"] == ("a.py", "   3 | def go():\n   4 |     import late")
    assert python_source.function_sources(files, found, ask(("go", None)), 1).count() == 1 and python_source.function_sources(files, found, ask(("go", None))).count() == 2
    spots = spark.createDataFrame([(1, "a.py", "m.go", 3), (2, "a.py", "gone", 2), (3, "bad.py", "go", 1), (4, "a.py", None, 1), (5, "no.py", "go", None)], "id int, path string, function string, line int")
    bodies = {r.id: r.body for r in python_source.bodies(files, found, spots).collect()}
    assert bodies[1] == "def go():\n    import late" and bodies[2].startswith("import x.y") and bodies[3] is None and bodies[4] is None and bodies[5] is None


def test_files_and_discovery(spark, tmp_path):
    for name in ("a.py", "sub/b.py", "tests/test_c.py", "venv/d.py", "note.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    got = {r.path.split("/")[-1]: r.text for r in text.files(spark, str(tmp_path), exclude=["/venv/"]).collect()}
    assert set(got) == {"a.py", "b.py", "test_c.py"} and got["a.py"] == "# a.py\n"
    assert [r.path.split("/")[-1] for r in text.discover(spark, str(tmp_path), 2, tests=False).collect()] == ["a.py", "b.py"]
    assert text.files(spark, str(tmp_path), exclude=["*/sub/*"]).count() == 3
    (tmp_path / "odd.py").write_bytes(b"x = '\xff'\n")
    odd = [r.text for r in text.files(spark, str(tmp_path)).collect() if r.path.endswith("odd.py")]
    assert odd == ["x = '\ufffd'\n"]


def test_lines_windows_and_grep(spark):
    t = spark.createDataFrame([("f", "l1\nl2\nl3\nl4\nl5"), ("g", None)], "path string, text string")
    spots = spark.createDataFrame([("f", 1), ("f", 4), ("f", 9), ("g", 1)], "path string, line int")
    got = {(r.path, r.line): (r.first, r.last, r.snippet) for r in text.snippets(t, spots, 1).collect()}
    assert got == {("f", 1): (1, 2, "l1\nl2"), ("f", 4): (3, 5, "l3\nl4\nl5"), ("g", 1): (1, 1, "")}
    assert [(r.line, r.value) for r in text.grep(t, "l[24]", 5).collect()] == [(2, "l2"), (4, "l4")]
    assert [r.value for r in text.read_lines(t, 2, 3).collect() if r] == ["l2", "l3"]
    code = spark.createDataFrame([("a", "x = 1\nimport os"), ("b", "import re"), ("c", "y\n import z\nx")], "path string, text string")
    assert [(r.path, r.line) for r in text.grep(code, "^import").collect()] == [("a", 2), ("b", 1)]
    assert [(r.path, r.line) for r in text.grep(code, "(x|z)$").collect()] == [("c", 2), ("c", 3)]


def test_small_formats(spark):
    kv = text.key_values(spark.createDataFrame([("f", 'a="1"\nb = x=y\nnone')], "path string, text string"))
    assert {r.name: r.value for r in kv.collect()} == {"a": "1", "b": "x=y"}
    log = text.git_log(spark.createDataFrame([(0, "s1|s|2024|fix it|Ann|Lee"), (1, "broken")], "idx int, value string")).collect()
    assert [(r.sha, r.msg, r.author) for r in log] == [("s1", "fix it", "Ann|Lee")]
    said = "[BUG] SSRF (line 12, confidence 0.9)\nBUG: DIV_ZERO in f at line 4\nFound bug: bounds here on line 5\n  XYZ: line 7\nsome KEY_ERROR before line 9\nnothing here\nXYZ: line 8"
    out = text.parse_findings(spark.createDataFrame([("f", said)], "path string, text string"))
    assert sorted((r.line, r.bug_type, r.confidence) for r in out.collect()) == [(4, "DIV_ZERO", 0.0), (5, "BOUNDS", 0.0), (7, "XYZ", 0.0), (9, "KEY_ERROR", 0.0), (12, "SSRF", 0.9)]
    folders = {(r.folder, r.entry) for r in text.folders(spark.createDataFrame([("a/b/c.py",), ("a/d.py",)], "path string")).collect()}
    assert folders == {("", "a"), ("a", "b"), ("a/b", "c.py"), ("a", "d.py")}


def test_patches(spark):
    p = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n a\n-b\n+c\n d\n"
    r = text.parse_patches(spark.createDataFrame([("p", p), ("q", None)], "patch string, text string")).collect()
    assert len(r) == 1 and (r[0].file, r[0].buggy, r[0].fixed, r[0].buggy_lines, r[0].fixed_lines) == ("x.py", "a\nb\nd", "a\nc\nd", [2], [2])


def test_patch_lines_are_counted_not_guessed(spark):
    p = "--- a/q.py\n+++ b/q.py\n@@ -1,4 +1,4 @@\n a\n--- old comment\n+++ plus line\n-b\n+c\n\n\\ No newline at end of file\n@@ -9 +9,2 @@\n-x\n+y\n+z\ndiff --git a/t.md b/t.md\n--- a/t.md\n+++ b/t.md\n@@ -1 +1 @@\n-1\n+2\n"
    df = spark.createDataFrame([("p", p)], "patch string, text string")
    r = {x.file: x for x in text.parse_patches(df).collect()}
    assert set(r) == {"q.py", "t.md"}
    q = r["q.py"]
    assert (q.buggy, q.fixed) == ("a\n-- old comment\nb\n\nx", "a\n++ plus line\nc\n\ny\nz")
    assert (q.buggy_lines, q.fixed_lines) == ([2, 3, 9], [2, 3, 9, 10])
    marked = text.parse_patches(df, only_source=True, marks=True).collect()
    assert [x.file for x in marked] == ["q.py"] and marked[0].fixed.count(text.HUNK_MARK) == 2
    assert text.parse_patches(spark.createDataFrame([("p", "+++ b/x.py\n@@ -1,9 +1,9 @@\n a\n")], "patch string, text string")).first().buggy == "a"


def test_pieces_that_parse_only_together(spark):
    mark = text.HUNK_MARK
    code = f"{mark}\n    a = f(\n        1,\n{mark}\n        g(2))\n{mark}\n)) nothing\n{mark}\n  h(3)\n"
    found = python_source.facts(spark.createDataFrame([("x.py", code)], "path string, text string"), repair=True).where("kind in ('call', 'error')").collect()
    assert sorted(r.name for r in found) == ["f", "g", "h"]
    tried = []
    python_source._readable_groups(["("] * 30, lambda x: tried.append(x) or False)
    assert len(tried) <= 30 * python_source.PIECES_TOGETHER


def test_alerts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Code injection,d,error,m,/src/a.py,12\n"Odd name",d,warning,"m, with comma",b.py,x\nshort,row\n')
    got = sorted((r.file, r.line, r.bug_type) for r in text.alerts(spark, str(tmp_path / "a.csv")).collect())
    assert got == [("b.py", 0, "ODD_NAME"), ("src/a.py", 12, "CODE_INJECTION")]


def test_sarif_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sarif, "A_DOCUMENT", 5)
    rows = spark.createDataFrame([(i, "DIV_ZERO" if i % 3 else "BOUNDS", f"m.f{i}", "m.py", i if i % 2 else None) for i in range(23)], "seq long, rule string, qualname string, uri string, line int")
    sarif.write(rows, str(tmp_path / "out"))
    docs = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("part=*/part-*")]
    assert 1 < len(docs) <= 5 and all(d["version"] == "2.1.0" for d in docs)
    for run in (r for d in docs for r in d["runs"]):
        ids = [r["id"] for r in run["tool"]["driver"]["rules"]]
        assert ids == sorted(ids) and all(ids[r["ruleIndex"]] == r["ruleId"] for r in run["results"])
    back = sorted((r.rule, r.qualname, r.uri, r.line) for r in sarif.read(spark, str(tmp_path / "out")).collect())
    assert back == sorted((r.rule, r.qualname, r.uri, r.line or 1) for r in rows.collect())


def test_baseline_file(spark, tmp_path):
    rows = spark.createDataFrame([("b", "R", "q", "m"), ("a", "S", None, None)], "fp string, rule string, qualname string, message string")
    sarif.write_baseline(rows, str(tmp_path / "base"))
    assert sorted(r.fp for r in sarif.read_baseline(spark, str(tmp_path / "base")).collect()) == ["a", "b"]
    assert sarif.read_baseline(spark, str(tmp_path / "missing")).count() == 0


def test_verdicts_and_triage(spark):
    said = ['x {"verdict":"TP","confidence":0.9} y', '{"confidence":0.7}', "no json", '{"verdict":"FP"}', '{"verdict":"tp"}', "{}", '{"verdict":"FP","rationale":"dict {a} is safe"}', "```\n{\"verdict\": \"TP\", \"confidence\": 1}\n```", "  ", None]
    t = spark.createDataFrame(list(enumerate(said)), "seq long, reply string")
    v = t.select("seq", sarif.parse_verdict(F.col("reply")).alias("v")).select("seq", "v.*")
    assert [(r.verdict, r.confidence) for r in v.orderBy("seq").collect()] == [("TP", 0.9), ("FP", 0.7), ("TP", 0.5), ("FP", 0.5), ("TP", 0.5), ("FP", 0.5), ("FP", 0.5), ("TP", 1.0), ("TP", 0.5), ("TP", 0.5)]
    assert [r.seq for r in sarif.triage(t, v, 0.6).collect()] == [0, 7]


def test_texts_that_no_parser_takes(spark):
    """Deep nesting gives error rows, and the other texts their facts."""
    deep = {"dots": "x" + ".a" * 5000, "minus": "-" * 6000 + "1", "plus": "+".join(["1"] * 6000), "index": "x" + "[0]" * 5000, "fine": "def f(a, *b, c=1, **d):\n    return g()\ndef h():\n    pass\n", "none": None}
    found = python_source.facts(spark.createDataFrame(list(deep.items()), "path string, text string")).cache()
    assert {r.path for r in found.where("kind = 'error'").collect()} <= {"dots", "minus", "plus", "index"}
    assert {r.qname: r.params for r in python_source.functions(found).collect()} == {"fine.f": ["a", "*b", "c", "**d"], "fine.h": []}
    long = "if " + " and ".join(f"x{i}" for i in range(200)) + ":\n    pass\n"
    guard = python_source.facts(spark.createDataFrame([("g", long)], "path string, text string")).where("kind = 'guard'").first()
    assert len(guard.name) > 1000


def test_repair_of_partial_code(spark):
    texts = {"in": "    x = g(1)\n    return x", "body": "if a:\nh(2)", "hunks": "index 1a..2b 100644\n# @@ hunk @@\n    i(1)\n# @@ hunk @@\n        j(2)\n", "no": "def ((("}
    df = spark.createDataFrame(list(texts.items()), "path string, text string")
    calls = {(r.path, r.name) for r in python_source.facts(df, repair=True).where("kind = 'call'").collect()}
    assert calls == {("in", "g"), ("body", "h"), ("hunks", "i"), ("hunks", "j")}
    assert python_source.facts(df).where("kind = 'error'").count() == 4


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "A", "l", 1, 1, "SAFE"), ("2024-01-01 00:10:00", "A", "l", 1, 2, "BUG"), ("2024-01-01 00:20:00", "B", "l", 1, 3, "SAFE")], "t string, bug_type string, location string, file long, seq long, verdict string")
    rows.withColumn("ts", F.to_timestamp("t")).drop("t").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))

    def drain(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert sorted(r.bug_type for r in drain(stream.deduplicated(source), "s1", "append")) == ["A", "B"]
    assert sorted((r.bug_type, r.n) for r in drain(stream.counts(source), "s2", "complete")) == [("A", 2), ("B", 1)]
    assert [(r.seq, r.event) for r in sorted(drain(stream.state_changes(source), "s3", "append"), key=lambda r: r.seq)] == [(2, "BUG_INTRODUCED"), (3, "BUG_FIXED")]
