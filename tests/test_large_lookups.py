"""Lookups and parsers that must not pair everything, read a text once, and use all cores."""

import random

from factloom.plans import catalog, registry  # noqa: F401
from factloom.sources import python_source

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_function_sources_by_pieces(spark):
    """Every kind of piece: whole paths, parts that several files share, parts that stand twice, none; against all pairs."""
    random.seed(7)
    files = [(f"{d}/{d}/m{i}.py", "def run():\n    return 1\n\ndef other():\n    return 2\n") for i, d in enumerate(["a", "b", "ab", "é"] * 5)]
    asked = [("run", p) for p, _ in files[:6]] + [("x.run", "a/"), ("run", "é"), ("other", None), ("y.other", ""), ("run", "zz"), ("run", "b" * 99), (None, "a"), ("none", None)]
    asked += [("other", p[i : i + random.randint(1, 5)]) for p, _ in files for i in [random.randrange(4)]]
    want = set()
    for name, piece in set(asked):
        hits = sorted(p for p, _ in files if name and name.split(".")[-1] in ("run", "other") and (piece or "") in p)[:3]
        want |= {(name, piece, p, 1 if name.endswith("run") else 4) for p in hits}
    texts = spark.createDataFrame(files, "path string, text string")
    found = python_source.function_sources(texts, python_source.facts(texts), spark.createDataFrame(asked, "name string, in_file string"))
    got = [tuple(r) for r in found.select("name", "in_file", "path", "first").collect()]
    assert len(got) == len(want) and set(got) == want
    assert "contains(" not in _plan(found).lower()  # a condition on pairs of one name would be quadratic


def test_entry_points_parse_once(spark):
    texts = spark.createDataFrame([("pkg/m.py", "def main():\n    return 1\n")], "path string, text string")
    found = python_source.entry_points(python_source.facts(texts))
    assert _plan(found).count("MapInArrow") == 0 and {tuple(r) for r in found.collect()} == {("pkg.m.main", "name"), ("pkg.m", "module")}


def test_parsing_uses_all_cores(spark):
    for name in ("file_imports", "patches"):
        assert registry.QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert "RoundRobin" in _plan(registry.QUERIES["patched_calls"](spark, SF))


def test_a_conjunction_writes_only_what_fails(spark):
    """Samples times predicates are not shuffled as a whole: what holds is neither written nor made distinct."""
    from factloom.operators import dataflow

    written = []
    was = dataflow.cut, dataflow.cut_count
    count = lambda df: written.append(df.count()) or was[0](df)
    rows = spark.range(4000).selectExpr("id % 40 as pred", "id div 40 as sample", "CASE WHEN id div 40 % 2 = 0 THEN 'positive' ELSE 'negative' END AS kind", "id % 40 <> id div 40 as holds")
    dataflow.cut = count
    try:
        got = {(r.pred, r.consistent) for r in dataflow.ice_conjunction(rows.union(rows)).collect()}
    finally:
        dataflow.cut = was[0]
    assert max(written) == 80 and got == {(p, False) for p in range(1, 40, 2)}
