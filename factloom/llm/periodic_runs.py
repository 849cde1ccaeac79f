"""Operator 11: periodic runs of words by maximal pairs, and texts with repeated periods taken out.

A run of period q and length n is the maximal pair of its words at a distance of q: the n - q words at its start stand again q
words later, and neither the words before the two places nor those behind them agree.  For n >= max(6, 4 q) the pair is at least
three times as long as its distance.  So the runs of a text are its maximal pairs of that kind, and nothing is extended:

* suffixes of the words are sorted by prefix doubling, and the common prefixes of neighbours follow from the ranks kept;
* the tree of LCP intervals is walked from below, with the places of an interval in order and the word left of each as its
  class; where two children meet at their common length, the places of the smaller list look for their nearest neighbours in
  the larger one, since the next occurrence of so long a string is a smallest period away;
* a pair of neighbours with different classes is maximal, and it is kept if its distance fits its length.  Of pairs that give
  the same stretch the least distance is the period.

Texts are handled in blocks; those without a repeated string of five words hold no run and are not sorted.  Nothing is shuffled.
Null and empty texts have no words and no runs; rows keep ids and repeats; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common

#: A run has at least LEAST words and REPEATS times its period.
LEAST, REPEATS = 6, 4
#: Words that stand twice in any text with a run.
SHORTEST = LEAST - 1
#: Bytes of text in a block.
BLOCK_BYTES = 1 << 20

Run = tuple[int, int, int]
_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _repeats(codes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Which documents hold a string of SHORTEST words twice, or may: hashes of words and document are compared."""
    n = len(codes) - SHORTEST + 1
    if n < 2:
        return np.zeros(n_docs, bool)
    inside = doc[:n] == doc[SHORTEST - 1 :]
    h = doc[:n].astype(np.uint64) + np.uint64(1)
    for k in range(SHORTEST):
        h = (h ^ codes[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(inside)
    h = h[at]
    order = np.argsort(h)
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    found = np.zeros(n_docs, bool)
    found[doc[at[order[same]]]] = True
    return found


def suffix_order(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes, which end with their document, and the words that each shares with the one before it.

    Ranks are the places where groups start, so those that stand alone keep theirs and only the others are sorted again.
    """
    n = len(codes)
    order = np.lexsort((codes, doc))
    fresh = np.ones(n, bool)
    fresh[1:] = (codes[order[1:]] != codes[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[n] = -1
    levels, length = [rank.copy()], 1
    last = np.append(doc, -1)
    size = np.bincount(rank[:n], minlength=n)
    active = np.flatnonzero(size[rank[:n]] > 1)
    while len(active):
        ahead = np.minimum(active + length, n)
        second = np.where(last[ahead] == doc[active], rank[ahead], -1)  # a suffix that ends here comes first
        by = np.lexsort((second, rank[active]))
        at, first, second = active[by], rank[active][by], second[by]
        opens = np.ones(len(at), bool)
        opens[1:] = first[1:] != first[:-1]
        parts = opens.copy()
        parts[1:] |= second[1:] != second[:-1]
        here = np.arange(len(at))
        begin, part = np.maximum.accumulate(np.where(opens, here, 0)), np.maximum.accumulate(np.where(parts, here, 0))
        rank[at] = first + part - begin
        length *= 2
        levels.append(rank.copy())
        sizes = np.bincount(np.cumsum(parts) - 1)
        active = at[np.repeat(sizes, sizes) > 1]
    suffixes = np.empty(n, np.int64)
    suffixes[rank[:n]] = np.arange(n)
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    shared = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        equal = levels[k][a] == levels[k][b]
        step = np.where(equal, 1 << k, 0)
        shared += step
        a, b = np.minimum(a + step, n), np.minimum(b + step, n)
    return suffixes, np.concatenate([[0], shared])


def _meet(many: list[int], few: list[int], shared: int, left: list[int], found: dict[tuple[int, int], int]) -> list[int]:
    """Join the places of two children of an interval of `shared` words, and keep the pairs of neighbours that are runs."""
    if len(many) < len(few):
        many, few = few, many
    most = shared // (REPEATS - 1)
    for x in few:
        k = bisect(many, x)
        for a, b in ((many[k - 1], x) if k else (x, x), (x, many[k]) if k < len(many) else (x, x)):
            period = b - a
            if 0 < period <= most and left[a] != left[b]:
                end = b + shared
                if found.get((a, end), period) >= period:
                    found[a, end] = period
    if len(few) == 1:
        insort(many, few[0])
    else:
        many += few
        many.sort()
    return many


def _pairs(places: list[int], shared: list[int], left: list[int], found: dict[tuple[int, int], int]) -> None:
    """The runs among suffixes in order that share SHORTEST words or more with their neighbours; shared[k] is of k - 1 and k."""
    stack: list[tuple[int, list[int]]] = []
    node = [places[0]]
    for k in range(1, len(places)):
        length = shared[k]
        while stack and stack[-1][0] > length:
            at, held = stack.pop()
            node = _meet(held, node, at, left, found)
        if stack and stack[-1][0] == length:
            stack[-1] = (length, _meet(stack[-1][1], node, length, left, found))
        else:
            stack.append((length, node))
        node = [places[k]]
    while stack:
        at, held = stack.pop()
        node = _meet(held, node, at, left, found)


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """(start, length, period) of the runs of each list of words, by start and period."""
    out: list[list[Run]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = [w for t in texts for w in t]
    if len(flat) < LEAST:
        return out
    codes = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    keep = _repeats(codes, doc, len(texts))[doc]
    if not keep.any():
        return out
    codes, doc = codes[keep], doc[keep]
    starts = np.searchsorted(doc, np.arange(len(texts)))
    suffixes, shared = suffix_order(codes, doc)
    classes = np.concatenate([[-1], codes[:-1]])
    classes[np.flatnonzero(np.diff(doc, prepend=-1))] = -1  # no word stands left of a first word
    left = classes.tolist()
    near = shared >= SHORTEST
    opens = np.flatnonzero(near & ~np.concatenate([[False], near[:-1]]))
    ends = np.flatnonzero(near & ~np.concatenate([near[1:], [False]])) + 1
    found: dict[tuple[int, int], int] = {}
    for a, b in zip((opens - 1).tolist(), ends.tolist(), strict=True):
        _pairs(suffixes[a:b].tolist(), shared[a:b].tolist(), left, found)
    for (start, end), period in found.items():
        if end - start >= LEAST:
            d = doc[start]
            out[d].append((start - int(starts[d]), end - start, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds behind its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document: its runs by start and period, and its words without repeated periods."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for whole in batches:
            for b in common.blocks(whole, 1, BLOCK_BYTES):
                words = [t.split() for t in common.text_bytes(b.column(1))]
                found = runs_of(words)
                rest = [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, found, strict=True)]
                named = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(named, kinds), pa.array(rest, pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by crc32 of its id repeats a piece from some word on; the others are as they are.

    A null id counts as the empty text.
    """
    common.bound_batches(docs.sparkSession)

    def plant(doc_id: int | None, text: str | None) -> str | None:
        h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        words = (text or "").encode().split() if h % 10 == 0 else []
        if not words:
            return text
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        piece = words[a : a + p]
        return b" ".join(words[:a] + (piece * (-(-(n - a) // p)))[: n - a]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [plant(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")


def digests(found: DataFrame) -> DataFrame:
    """The runs of find() as counts, the run of the greatest exponent and hashes."""
    runs = F.col("runs")
    higher = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.reduce(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, r: F.when(higher(best, r), r).otherwise(best))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(runs, line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, with periods planted in a tenth of them."""
    return digests(find(with_planted_periods(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
