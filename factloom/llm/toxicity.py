"""Operator 2: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon (learned from labelled texts, plus a short fixed list), closeness of its
words to the second person, capitals, punctuation, and obfuscated spellings.  Lexicon and trees are fitted on a bounded
sample of labelled documents, three quarters of it; the last quarter calibrates margins by isotonic regression.
Scoring is one pass over all whole texts without a shuffle.

Null and empty texts are scored like any other text: all their densities are 0.  A null id is in no held-out part of
the labels and counts as the empty id.  Repeated rows are scored each.  Without labels, or with one class, the
score is the share of label 1 (0 without labels).  No input column but the text is used.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common

#: Most labelled documents the model is fitted on.
SAMPLE = 12_000
#: Most words of the learned lexicon, least share of toxic sample texts that hold one, least log odds ratio.
LEXICON_WORDS, LEXICON_SHARE, LEXICON_ODDS = 5_000, 0.01, 2.5
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
THRESHOLD = 0.3
BLOCK_BYTES = 4 << 20

# Common insults of English, and the second person in four languages.
INSULTS = "idiot moron stupid dumb loser trash scum worthless pathetic disgusting clown fool jerk garbage".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split()

_TO_WORDS = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_PLAIN = bytes.maketrans(b"013457@$", b"oieastas")
_LEET_WORDS = bytes(_PLAIN[c] if chr(_PLAIN[c]).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_LOUD = b"!?"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "!?")
_SECOND = frozenset(w.encode() for w in SECOND_PERSON)

NAMES = (
    "weight_density", "hit_density", "log_hits", "distinct_hits", "largest_weight", "near_second_person", "second_person_density",
    "capitals", "capital_words", "loud_marks", "other_marks", "obfuscated_density", "digits_in_words", "log_words",
)


def words_of(text: str) -> list[bytes]:
    """Lower-case words of letters and digits."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def features(text: str, lexicon: dict[bytes, float]) -> list[float]:
    """The dense features of a text, in the order of NAMES."""
    raw = text.encode("utf-8", "surrogatepass")
    low = text.lower().encode("utf-8", "surrogatepass")
    words = low.translate(_TO_WORDS).split()
    n = max(1, len(words))
    found = [lexicon.get(w, 0.0) for w in words] if not lexicon.keys().isdisjoint(words) else []
    hits = [i for i, x in enumerate(found) if x]
    second = sum(map(_SECOND.__contains__, words)) if not _SECOND.isdisjoint(words) else 0
    near = sum(1 for i in hits if not _SECOND.isdisjoint(words[max(0, i - 5) : i + 6])) if second else 0
    marked = len(low) - len(low.translate(None, b"0123456789@$"))
    plain = low.translate(_LEET_WORDS).split() if marked else []
    hidden = sum(map(lexicon.__contains__, plain)) - len(hits) if plain else 0
    mixed = sum(1 for w in words if not w.isalpha() and not w.isdigit() and w.isascii()) if marked else 0
    upper = len(raw) - len(raw.translate(None, _UPPER))
    lower = len(raw) - len(raw.translate(None, _LOWER))
    size = max(1, len(raw))
    return [
        sum(found) / n,
        len(hits) / n,
        math.log1p(len(hits)),
        float(len({words[i] for i in hits})),
        max(found, default=0.0),
        near / max(1, len(hits)),
        second / n,
        upper / max(1, upper + lower),
        sum(map(bytes.isupper, raw.split())) / n if upper > lower / 4 else 0.0,
        (len(raw) - len(raw.translate(None, _LOUD))) / size,
        (len(raw) - len(raw.translate(None, _MARKS))) / size,
        max(0, hidden) / n,
        mixed / n,
        math.log1p(len(words)),
    ]


@dataclass
class Trees:
    """Boosted regression trees of one depth for the log loss; every tree is complete, its nodes stored by level."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        out = np.full(len(x), self.base)
        for which, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), which[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> Trees:
        """Fit by histograms of quantile bins."""
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        model = Trees(float(np.log(share / (1 - share))))
        cuts = [np.unique(np.quantile(c[c != 0] if (c != 0).any() else c, np.linspace(0, 1, BINS))) for c in x.T]
        cuts = [np.unique(np.concatenate([[0.0], c]))[:-1] if len(c) else c for c in cuts]
        cuts = [c if len(c) else np.array([np.inf]) for c in cuts]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], 1)
        width = max(len(c) for c in cuts) + 1
        margin = np.full(len(y), model.base)
        inner, leaves = 2**DEPTH - 1, 2**DEPTH
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            which, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, width)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    if len(rows) < 10:
                        continue
                    best = 1e-6
                    for f in range(x.shape[1]):
                        gs = np.bincount(binned[rows, f], g[rows], width).cumsum()
                        hs = np.bincount(binned[rows, f], h[rows], width).cumsum()
                        ns = np.bincount(binned[rows, f], minlength=width).cumsum()
                        gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                        gain[(ns < 5) | (ns[-1] - ns < 5)] = 0
                        j = int(gain[: len(cuts[f])].argmax())
                        if gain[j] > best:
                            best, which[k], cut[k], at[k] = gain[j], f, cuts[f][j], j
                node = 2 * node + 1 + (binned[np.arange(len(y)), which[node]] > at[node])
            end = node - inner
            gs, hs = np.bincount(end, g, leaves), np.bincount(end, h, leaves)
            leaf = RATE * gs / (hs + 1)
            model.trees.append((which, cut, leaf))
            margin += leaf[end]
        return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit (pooled adjacent violators) of y on the margin."""
    at, place = np.unique(margin, return_inverse=True)  # rows of one margin are one point from the start
    pools: list[list[float]] = []  # sum, count, lowest and highest margin
    for m, total, n in zip(at, np.bincount(place, y), np.bincount(place), strict=True):
        pools.append([float(total), float(n), float(m), float(m)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, c, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += c
            pools[-1][3] = hi
    xs = [v for p in pools for v in (p[2], p[3])]
    ys = [p[0] / p[1] for p in pools for _ in range(2)]
    return np.array(xs), np.array(ys)


@dataclass
class Model:
    """Lexicon, trees and calibration; without trees, a constant."""

    constant: float = 0.0
    lexicon: dict[bytes, float] = field(default_factory=dict)
    trees: Trees | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores from 0 to 1; one part in a thousand follows the margin, so that calibrated ties stay ordered."""
        if self.trees is None:
            return np.full(len(texts), self.constant)
        margin = self.trees.margin(np.array([features(t, self.lexicon) for t in texts], float).reshape(len(texts), len(NAMES)))
        return 0.999 * np.interp(margin, *self.knots) + 0.001 / (1 + np.exp(-margin))


def learn_lexicon(sample: DataFrame) -> dict[bytes, float]:
    """Words much commoner in texts with label 1: word -> log odds ratio, from document frequencies."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for t, y in zip(common.texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                seen[1 if y else 0].update(set(words_of(t)))
        for y, c in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array([n if y else 0 for n in c.values()], pa.int64()), pa.array([0 if y else n for n in c.values()], pa.int64())], ["word", "toxic", "clean"])

    total = sample.groupBy("label").count().collect()
    n1, n0 = (sum(r["count"] for r in total if bool(r["label"]) is y) for y in (True, False))
    least = max(3, math.ceil(LEXICON_SHARE * n1))
    rows = (
        sample.select("text", "label").mapInArrow(count, "word binary, toxic long, clean long")
        .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= least)
        .withColumn("odds", F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1)))
        .where(F.col("odds") >= LEXICON_ODDS)
        .orderBy(F.desc("odds"), "word").limit(LEXICON_WORDS).collect()
    )
    return {w.encode(): LEXICON_ODDS for w in INSULTS} | {bytes(r["word"]): float(r["odds"]) for r in rows}


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """Fit on at most `bound` labelled documents."""
    common.bound_batches(docs.sparkSession)
    sample = common.bounded_sample(docs, common.labelled(labels, "toxic"), bound, 2, ["label"])
    part = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4)) == 0
    lexicon = learn_lexicon(sample.where(~part))
    width = len(NAMES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([features(t, lexicon) for t in common.texts(b.column(0))], float).reshape(b.num_rows, width)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), width).cast(pa.list_(pa.float64()))], ["label", "part", "x"])

    got = sample.select("text", F.col("label").cast("int").alias("label"), part.alias("part")).mapInArrow(measure, "label int, part boolean, x array<double>").collect()
    got.sort(key=repr)
    y = np.array([1.0 if r["label"] else 0.0 for r in got])
    held = np.array([bool(r["part"]) for r in got], bool)
    if len(got) < 20 or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 0.0)
    x = np.array([r["x"] for r in got], float)
    if y[~held].min() == y[~held].max() or not held.any():
        held[:] = False
    trees = Trees.fit(x[~held], y[~held])
    at = held if held.any() and y[held].min() < y[held].max() else ~held
    return Model(lexicon=lexicon, trees=trees, knots=isotonic(trees.margin(x[at]), y[at]))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score, predicted."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("toxicity", lambda: None)
        for whole in batches:
            for b in common.blocks(whole, 1, BLOCK_BYTES):
                s = model.score(common.texts(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", common.held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents below the threshold, with their columns, in one pass."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("toxicity", lambda: None)
        for whole in batches:
            for b in common.blocks(whole, at, BLOCK_BYTES):
                yield b.filter(pa.array(model.score(common.texts(b.column(at))) < THRESHOLD))

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
