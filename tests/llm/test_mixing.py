"""Operator 4: targets by plain iteration, budgets met exactly, odd inputs."""

import random
import re

import duckdb

from factloom.llm import mixing
from tests.llm.helpers import DOCS, documents


def targets_by_hand(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(cap * sizes[s] for s in capped)
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > cap * sizes[s]}
        if not over:
            return t | {s: float(cap * sizes[s]) for s in capped}
        capped |= over


def test_targets_match_iteration(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = {(None if i == 4 else f"s{i}"): rng.choice([0, 1, 3, 50, 700, 9000]) for i in range(rng.randint(1, 9))}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = targets_by_hand(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_budgets_are_exact_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mixing.mix(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    for own in by.values():
        assert sum(r.taken for r in own) == int(own[0].target)
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect())) == sorted(map(tuple, rows))


def test_odd_rows(spark):
    docs = documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    words = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect())
    assert sorted(r.size for r in rows) == words
    assert mixing.mix(docs.limit(0)).count() == 0
    blank = mixing.mix(documents(spark, [None, "", " "]).where("doc_id < 3")).collect()
    assert all(r.taken == 0 and r.target == 0 for r in blank)


def test_mixed_documents_hold_what_was_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    took = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    got = {}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert {k: v for k, v in took.items() if v} == {k: v for k, v in got.items() if v}
    assert mixing.mixed_documents(documents(spark)).count() > 0


def test_repeated_ids_and_very_many_sources(spark, tmp_path):
    """One id and one text of null ids thousands of times, and thousands of sources, against the SQL."""
    rows = [(7, "same words here", "en", "hot", 0)] * 4_000 + [(None, "no id at all", "en", "hot", 0)] * 3_000 + [(10_000 + i, f"text of {i}", "en", f"s{i % 2_000}", 0) for i in range(4_000)]
    spark.createDataFrame(rows, DOCS).repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(mixing.OP4_SQL)
    got = mixing.op4_mix_sources(spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
