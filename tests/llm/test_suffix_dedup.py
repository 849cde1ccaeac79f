"""Operator 12 against a dictionary of all windows."""

import hashlib
import random

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import suffix_dedup as sd
from tests.llm.helpers import DOCS, documents


def brute(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha) of rows (doc_id, text); rows of one id by the hash that the operator orders them by."""
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def ordered(spark, docs):
    from pyspark.sql import functions as F

    return [(r.doc_id, r.text) for r in docs.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).select("doc_id", "text").collect()]


def result(spark, docs, tmp_path, name="d"):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / name / "documents.parquet"))
    return sorted((tuple(r) for r in sd.op12_suffix_dedup(spark, str(tmp_path / name)).collect()), key=repr)


def test_odd_rows(spark, tmp_path):
    docs = documents(spark)
    assert result(spark, docs, tmp_path) == brute(ordered(spark, docs))


def _passages(seed, n=120):
    """Texts with shared passages, near copies, copies, repeats inside, short strings and long runs of a letter."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 7)))
    say = lambda k: " ".join(word() for _ in range(k))
    shared = [say(k) for k in (20, 24, 30, 60, 200)]
    texts = []
    for i in range(n):
        kind = i % 8
        if kind == 0 and texts:
            texts.append(rnd.choice(texts))
        elif kind == 1 and texts:
            t = list(rnd.choice(texts))
            for _ in range(2):
                if t:
                    t[rnd.randrange(len(t))] = "X"
            texts.append("".join(t))
        elif kind == 2:
            texts.append("a" * rnd.randint(90, 400) + "ab" * rnd.randint(0, 150))
        elif kind == 3:
            texts.append((say(12) + "\n") * rnd.randint(1, 5))
        else:
            texts.append(say(rnd.randint(0, 50)) + rnd.choice(shared)[rnd.randint(0, 30) :] + say(rnd.randint(0, 60)))
    return texts


def test_passages_copies_and_periods(spark, tmp_path):
    docs = spark.createDataFrame([(i * 2, t, "en", "s", 0) for i, t in enumerate(_passages(1))], DOCS).repartition(7)
    assert result(spark, docs, tmp_path) == brute(ordered(spark, docs))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/documents.parquet/*.parquet'")
    assert sorted(con.sql(sd.OP12_SQL).fetchall(), key=repr) == brute(ordered(spark, docs))


def test_hot_anchors_are_dealt_out_without_a_change(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(_passages(2, 200))], DOCS).repartition(5)
    flat = lambda df: sorted((r.doc_id, bytes(r.kept), [tuple(x) for x in r.spans]) for r in df.collect())
    want = flat(sd.deduplicated(docs))
    assert flat(sd.deduplicated(docs, hot=3)) == want
    assert [(i, hashlib.sha256(k).hexdigest()) for i, k, _ in want] == sorted((x[0], x[4]) for x in brute(ordered(spark, docs)))


def test_equal_rows_and_rows_of_one_id(spark, tmp_path):
    a, b = _passages(3, 5)[4] + "q" * 10, "z" * 150
    docs = spark.createDataFrame([(1, a, "en", "s", 0)] * 40 + [(1, b, "en", "s", 0)] * 3 + [(None, a, None, None, None)] * 2 + [(2, "short", "en", "s", 0)] * 3, DOCS)
    assert result(spark, docs, tmp_path) == brute(ordered(spark, docs))


def test_empty_table(spark):
    assert sd.deduplicated(spark.createDataFrame([], DOCS)).count() == 0


def test_small_blocks_and_other_lengths(spark, monkeypatch):
    monkeypatch.setattr(sd, "SORT_PIECES", 50)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(_passages(4, 60))], DOCS)
    for length in (40, 64, 100):
        got = sorted((r.doc_id, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in sd.deduplicated(docs, length).collect())
        assert got == sorted((x[0], x[4]) for x in brute(ordered(spark, docs), length))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=3, max_size=3), min_size=1, max_size=40), st.sampled_from([0, 8]))
def test_blind_trie_and_shallow_sort_give_equal_classes(strings, shallow):
    trie = sd.BlindTrie(strings[0], 0)
    for i, s in enumerate(strings[1:], 1):
        trie.add(s, i)
    leaves = list(trie.leaves())
    assert [strings[x[0]] for x in leaves] == sorted(set(strings))
    assert all({strings[i] for i in x} == {strings[x[0]]} for x in leaves)
    buf = b"".join(strings)
    n = len(strings)
    got = sd.deep_shallow(buf, np.arange(n) * 3, np.full(n, 3), np.zeros(n, np.int64), shallow)
    assert sorted(sorted(c) for c in got) == sorted(c for s in set(strings) if len(c := [i for i, x in enumerate(strings) if x == s]) > 1)


def test_long_texts_are_cut_into_segments(monkeypatch):
    monkeypatch.setattr(sd, "SEGMENT", 150)
    text = " ".join(str(i * i) for i in range(300)).encode()
    windows = {}
    for _, _, start, _, size, anchor, lead in sd.cut([text], 100):
        for s, n, h, j in zip(start.tolist(), size.tolist(), anchor.tolist(), lead.tolist(), strict=True):
            windows |= {s + o: (h, j - o) for o in range(n - 99)}
    assert sorted(windows) == list(range(len(text) - 99))
    monkeypatch.setattr(sd, "SEGMENT", 8 << 20)
    for _, _, start, _, size, anchor, lead in sd.cut([text], 100):
        for s, n, h, j in zip(start.tolist(), size.tolist(), anchor.tolist(), lead.tolist(), strict=True):
            assert all(windows[s + o] == (h, j - o) for o in range(n - 99))
