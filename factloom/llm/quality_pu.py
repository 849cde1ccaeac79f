"""Operator 8: quality by positive-unlabelled learning.

Trusted positives are documents labelled 1; unlabelled ones are a sample of the web text itself.  Labels 0 are never
learned from.  A first network that tells positives from unlabelled texts gives the class prior: the least ratio of
unlabelled to positive mass over the upper tails of its score, on rows it was not fitted on.  A second one minimises the
non-negative unbiased risk  pi E_P[l(z)] + max(0, E_U[l(-z)] - pi E_P[l(-z)])  with the logistic loss, so its
sigmoid estimates the probability of quality.  Fitting takes bounded samples; scoring is one pass over whole texts.

Null and empty texts are scored like other texts, with all features 0.  A null id counts as the empty id and is not
learned from.  Repeated rows are scored each.  Without positives or without unlabelled texts the score is 1: nothing is rejected unlearned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common

#: Most trusted positives and most unlabelled documents that the model is fitted on: parameters of train(), and with the
#: width of the features the bound of what the driver holds.
POSITIVES, UNLABELLED = 8_000, 8_000
HIDDEN, EPOCHS, RATE, DECAY = 16, 500, 0.02, 1e-4
THRESHOLD = 0.7
BLOCK_BYTES = 4 << 20

NAMES = (
    "log_words", "distinct_words", "repeats_next", "commonest_bigram_repeats", "symbols", "loud", "capitals", "repeated_lines",
    "word_length", "marks", "digits", "words_a_line", "bars",
)
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_SYMBOLS = b"#*$%&<>"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def features(raw: bytes) -> list[float]:
    """Dense features of a UTF-8 text, in the order of NAMES; all rates lie in 0 to 1 but for logarithms."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    size = len(raw)
    count = lambda s: size - len(raw.translate(None, s))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower = count(_UPPER), count(_LOWER)
    triples = max(1, n - 2)
    return [
        math.log1p(n),
        len(set(words)) / n,
        sum(map(eq, words, islice(words, 1, None))) / n,
        1 - len(set(zip(words, islice(words, 1, None), islice(words, 2, None)))) / triples if n > 2 else 0.0,
        min(1.0, count(_SYMBOLS) / n),
        min(1.0, count(b"!?") / n),
        upper / max(1, upper + lower),
        1 - len(set(lines)) / len(lines),
        math.log1p((size - n) / n),
        min(1.0, count(_MARKS) / n),
        min(1.0, count(_DIGITS) / n),
        math.log1p(n / len(lines)),
        min(1.0, raw.count(b"|") / n),
    ]


@dataclass
class Network:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: np.ndarray

    @staticmethod
    def start(x: np.ndarray, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        return Network(x.mean(0), x.std(0) + 1e-3, rng.normal(0, 1 / math.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1))

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w + self.b)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.v + self.c

    def fit(self, x: np.ndarray, slope) -> Network:
        """Adam on a full batch; slope(z) gives the derivative of the risk by each row's margin."""
        z0 = np.clip((x - self.mean) / self.scale, -8, 8)
        params = [self.w, self.b, self.v, self.c]
        m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, EPOCHS + 1):
            h = np.tanh(z0 @ self.w + self.b)
            dz = slope(h @ self.v + self.c)
            dh = np.outer(dz, self.v) * (1 - h * h)
            grads = [z0.T @ dh + DECAY * self.w, dh.sum(0), h.T @ dz + DECAY * self.v, np.array([dz.sum()])]
            for i, (p, g) in enumerate(zip(params, grads, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g * g
                p -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
        return self


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among the unlabelled: fitted on even rows, read from the upper tails on odd ones, and back."""
    found = []
    for turn in (0, 1):
        fp, fu, tp, tu = p[turn::2], u[turn::2], p[1 - turn :: 2], u[1 - turn :: 2]
        if min(map(len, (fp, fu, tp, tu))) < 10:
            return 0.9
        x, y = np.vstack([fp, fu]), np.r_[np.ones(len(fp)), np.zeros(len(fu))]
        weight = np.r_[np.full(len(fp), 0.5 / len(fp)), np.full(len(fu), 0.5 / len(fu))]
        net = Network.start(x, 7).fit(x, lambda z, y=y, weight=weight: weight * (sigmoid(z) - y))
        sp, su = np.sort(net.margin(tp)), np.sort(net.margin(tu))
        cuts = sp[: max(1, int(0.9 * len(sp)))]  # tails that hold a tenth of the positives at least
        in_p = 1 - np.searchsorted(sp, cuts, side="left") / len(sp)
        in_u = 1 - np.searchsorted(su, cuts, side="left") / len(su)
        slack = math.sqrt(math.log(40) / (2 * len(su))) + math.sqrt(math.log(40) / (2 * len(sp)))
        i = int(np.argmin((in_u + slack) / in_p))
        found.append(in_u[i] / in_p[i])
    return float(np.clip(np.mean(found), 0.05, 0.98))


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float) -> Network:
    """Minimise the non-negative risk; where its second part is negative, step back up on that part alone."""
    x, np_, nu = np.vstack([p, u]), len(p), len(u)

    def slope(z: np.ndarray) -> np.ndarray:
        zp, zu = z[:np_], z[np_:]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        down = np.r_[-prior * sigmoid(zp) / np_, sigmoid(zu) / nu]
        up = np.r_[-prior * sigmoid(-zp) / np_, np.zeros(nu)]
        return up + down if negative >= 0 else -down

    return Network.start(x, 11).fit(x, slope)


@dataclass
class Model:
    network: Network | None = None
    prior: float = 1.0

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Estimated probability of quality."""
        if self.network is None:
            return np.ones(len(texts))
        return sigmoid(self.network.margin(np.array([features(t) for t in texts], float).reshape(len(texts), len(NAMES))))


def _samples(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """(doc_id, trusted, web, text): at most `positives` and `unlabelled` documents picked by hash of the id, one row an id.

    Of rows with one id the least text counts, so reruns agree.  Documents without an id are not picked.
    """
    first = lambda ids, seed, most: ids.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(most)
    trusted = first(common.labelled(labels, "quality").where("label = 1").select(F.col("doc_id").cast("long").alias("doc_id")), 8, positives)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id")))
    web = first(ids, 88, unlabelled)
    both = trusted.withColumn("trusted", F.lit(True)).withColumn("web", F.lit(False)).unionByName(web.withColumn("trusted", F.lit(False)).withColumn("web", F.lit(True)))
    chosen = both.groupBy("doc_id").agg(F.max("trusted").alias("trusted"), F.max("web").alias("web"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return common.table(rows.groupBy("doc_id", "trusted", "web").agg(F.min("text").alias("text")), "sample")


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on bounded samples: positives by label, unlabelled ones from all documents not held out."""
    common.bound_batches(docs.sparkSession)
    width = len(NAMES)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in common.text_bytes(b.column(0))], float).reshape(b.num_rows, width)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64()))], ["trusted", "web", "x"])

    rows = _samples(docs, labels, positives, unlabelled).select("text", "trusted", "web")
    got = rows.mapInArrow(measure, "trusted boolean, web boolean, x array<double>").collect()
    p = sorted(r["x"] for r in got if r["trusted"])
    u = sorted(r["x"] for r in got if r["web"])
    if len(p) < 10 or len(u) < 10:
        return Model()
    rng = np.random.default_rng(3)
    pa_, ua = np.array(p, float)[rng.permutation(len(p))], np.array(u, float)[rng.permutation(len(u))]
    prior = estimate_prior(pa_, ua)
    return Model(fit_nnpu(pa_, ua, prior), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score, predicted."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("quality_pu", lambda: None)
        for whole in batches:
            for b in common.blocks(whole, 1, BLOCK_BYTES):
                s = model.score(common.text_bytes(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", common.held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents at or above the threshold, with their columns, in one pass."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("quality_pu", lambda: None)
        for whole in batches:
            for b in common.blocks(whole, at, BLOCK_BYTES):
                yield b.filter(pa.array(model.score(common.text_bytes(b.column(at))) >= THRESHOLD))

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)


def op8_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
