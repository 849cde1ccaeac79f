"""Operator 11 against all stretches tried one by one."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import periodic_runs
from tests.llm.helpers import documents


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def brute(words):
    """Every period: stretches in which words that far apart agree, grown as far as they go."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and smallest_period(words[i : i + length]) == q:
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines), sha(kept))


words = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(words, max_size=4))
def test_small_alphabets(texts):
    assert periodic_runs.runs_of(texts) == [brute(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b"]), min_size=1, max_size=5), st.integers(1, 9)), max_size=6))
def test_powers_beside_each_other(pieces):
    text = [w for piece, times in pieces for w in piece * times]
    assert periodic_runs.runs_of([text]) == [brute(text)]


def test_long_texts_and_nested_periods():
    rnd = random.Random(3)
    word = lambda: rnd.choice([b"x", b"y", b"z", b"w"])
    inner = [b"p"] * 9 + [b"q"]
    texts = [[b"a"] * 3000, inner * 6 + [b"r"] + inner * 5, [word() for _ in range(800)], [b"a", b"b"] * 400 + [b"c"] + [b"b", b"a"] * 300, [b"u%d" % i for i in range(900)] * 4]
    assert periodic_runs.runs_of(texts) == [brute(t) for t in texts]
    assert periodic_runs.runs_of([texts[-1]])[0] == [(0, 3600, 900)]


def test_query_on_odd_rows(spark, tmp_path):
    docs = documents(spark)
    more = [(i, " ".join(random.Random(i).choices(["la", "le", "lo"], k=40)), "en", "s", 0) for i in range(100, 180)]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = periodic_runs.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = [r for r in docs.collect() if len(r.text or "") < 20_000]
    want = sorted(repr(plain(r.doc_id, r.text)) for r in short)
    long_ids = {r.doc_id for r in docs.collect() if len(r.text or "") >= 20_000}
    assert sorted(repr(tuple(r)) for r in got.collect() if r.doc_id not in long_ids) == want


def test_real_texts_with_planted_periods(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 4000")
    got = periodic_runs.digests(periodic_runs.find(periodic_runs.with_planted_periods(docs))).collect()
    assert sum(r.n_runs > 0 for r in got) > 5
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr(plain(r.doc_id, r.text)) for r in docs.collect())


def test_operator_keeps_other_columns_apart_and_empty_tables(spark):
    found = periodic_runs.find(documents(spark)).collect()
    fox = next(r for r in found if r.n_words == 12_000)
    assert [tuple(r) for r in fox.runs] == [(0, 12_000, 4)] and fox.collapsed == "the quick brown fox"
    assert periodic_runs.find(spark.createDataFrame([], "doc_id long, text string, runs string")).count() == 0
