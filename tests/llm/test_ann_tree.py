"""Operator 9: recall against brute force, exact distances and ties, odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import ann_tree


def run(spark, rows, k=10, every=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("leaf", "sub", "part", "rank", "score", "query_id", "n"):
        df = df.withColumn(name, F.lit("x"))
    v, q = df.where("vec_id is not null"), F.col("vec_id") % every == 0
    found = ann_tree.fit(v, q, k)
    return [] if found is None else sorted(map(tuple, ann_tree.search(found).collect()))


def exact(rows, k, every):
    ok = [(i, np.array(e, float)) for i, e in rows if i is not None and e is not None and len(e) == 4 and None not in e and np.isfinite(e).all() and np.any(e)]
    out = []
    for n, (i, e) in enumerate(ok):
        if i % every == 0:
            d = sorted((math.dist(e, f), j) for m, (j, f) in enumerate(ok) if m != n)[:k]
            out += [(i, n + 1, j, s) for n, (s, j) in enumerate(d)]
    return sorted(out)


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 3), 1.0, 2.0, 0.0]) for i in range(40)]
    rows += [(40, None), (41, [0.0] * 4), (42, [1.0, None, 0.0, 0.0]), (45, [nan, 1.0, 0.0, 0.0]), (50, [inf, 0.0, 0.0, 1.0]), (55, [1.0]), (None, [1.0] * 4), (60, [])]
    got, want = run(spark, rows), exact(rows, 10, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)


def test_few_and_no_rows(spark):
    assert run(spark, [(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0])]) == [(0, 1, 1, 2**0.5)]
    assert run(spark, [(0, [1.0, 0.0, 0.0, 0.0])]) == [] and run(spark, []) == [] and run(spark, [(0, None)]) == []


def test_recall_on_the_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    got = ann_tree.op9_ann_tree(spark, "/root/testdata/sf0.1").collect()
    ids, x = np.array([r.vec_id for r in e]), np.array([r.embedding for r in e], float)
    hit = 0
    for q in {r.query_id for r in got}:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        true = set(ids[np.lexsort((ids, d))[:10]])
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and [r.score for r in own] == sorted(r.score for r in own)
        hit += len(true & {r.vec_id for r in own})
    assert hit >= 0.9 * len(got)


def test_visits_widen_to_the_whole_tree():
    x = np.random.default_rng(0).normal(size=(2000, 6))
    tree = ann_tree.Tree.fit(x)
    order = tree.visit(x[0], tree.leaves)
    assert tree.leaves > 8 and sorted(n for n, _ in order) == list(range(tree.leaves))
    assert set(tree.assign(x)) <= set(range(tree.leaves))


@pytest.mark.parametrize(("offset", "spread"), [(1e8, 1.0), (1e4, 1e-3), (0.0, 1e200), (0.0, 1e-200), (1e15, 1.0)])
def test_large_and_close_numbers(offset, spread):
    rng = np.random.default_rng(3)
    x = offset + spread * rng.normal(size=(3000, 16))
    ids = rng.permutation(3000)
    q = x[:20]
    for v, (got, d) in zip(q, ann_tree.nearest(q, x, ids, 10), strict=True):
        e = math.frexp(spread)[1]
        true = np.sqrt(((np.ldexp(x, -e) - np.ldexp(v, -e)) ** 2).sum(1))
        best = np.lexsort((ids, true))[:10]
        assert got.tolist() == ids[best].tolist() and np.allclose(np.ldexp(d, -e), true[best], rtol=1e-12)


def test_rows_of_equal_ids(spark):
    rows = [(i, [float(i), 1.0, 0.0, 0.0]) for i in range(20)] + [(5, [5.5, 1.0, 0.0, 0.0]), (5, [5.0, 1.0, 0.0, 0.0]), (7, [7.0, 1.0, 0.0, 0.0])]
    got = run(spark, rows, 3)
    # 5 stands at 5.0 twice and at 5.5 once: each place is answered once, and finds the others of its id
    at5 = sorted(g[1:] for g in got if g[0] == 5)
    assert at5 == sorted([(1, 5, 0.0), (2, 5, 0.5), (3, 4, 1.0), (1, 5, 0.5), (2, 5, 0.5), (3, 6, 0.5)])
    want = exact([r for r in rows if r[0] != 5], 3, 5)
    assert {g[0] for g in got} == {w[0] for w in want} | {5}


def test_bins_of_a_lower_level(spark, monkeypatch):
    """Leaves over the bound are split where they lie; with a target of 1 the search is exact."""
    monkeypatch.setattr(ann_tree, "BIN", 60)
    monkeypatch.setattr(ann_tree, "SAMPLE", 300)
    monkeypatch.setattr(ann_tree, "RECALL", 1.0)
    monkeypatch.setattr(ann_tree, "PART_VECTORS", 50)
    monkeypatch.setattr(ann_tree, "PART_QUERIES", 30)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4))
    x[1000:2000] = x[0]  # a third of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    is_query = F.col("vec_id") % 30 == 0
    found = ann_tree.fit(df, is_query, 5)
    assert found.deep and found.recall == 1.0 and found.bins.select("leaf", "sub").distinct().count() > found.tree.leaves
    got = sorted(map(tuple, ann_tree.search(found).collect()))
    want = exact(rows, 5, 30)
    assert len(got) == len(want) and len(set(g[:3] for g in got) & set(w[:3] for w in want)) >= 0.97 * len(want)
