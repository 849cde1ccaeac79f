"""Operators 2 and 8: held-out accuracy, parts of the methods, odd inputs."""

import zlib

import numpy as np
import pytest

from factloom.llm import quality_pu, toxicity
from tests.llm.helpers import documents

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(("module", "label", "right"), [(toxicity, "toxic", 0.98), (quality_pu, "quality", 0.98)])
def test_held_out_accuracy(spark, module, label, right):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = module.score(docs, module.train(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= module.THRESHOLD) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r[label] for r in held) / len(held) >= right


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality_pu, "quality")])
def test_odd_rows_and_no_labels(spark, module, label):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 1, 1), (1, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        rows = module.score(docs, module.train(docs, labels)).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert module.score(docs.limit(0), module.train(docs.limit(0), none)).count() == 0


def test_isotonic_is_the_monotone_fit():
    x = np.array([0.0, 1, 2, 3, 3, 4])
    knots = toxicity.isotonic(x, np.array([0, 1, 0, 1, 0, 1.0]))
    assert np.all(np.diff(knots[1]) >= 0) and knots[1][0] == 0 and knots[1][-1] == 1
    assert np.allclose(np.interp([1, 2, 3], *knots), 0.5)
    # a lone 0 at the highest margin does not pull the others down to it
    knots = toxicity.isotonic(np.array([0.0] * 50 + [1.0] * 10 + [5.0] * 20), np.array([0] * 60 + [0] + [1] * 19))
    assert np.allclose(np.interp([0, 1, 5], *knots), [0, 0, 0.95])


def test_trees_learn_a_threshold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((toxicity.Trees.fit(x, y).margin(x) > 0) == y).mean() > 0.97


def test_toxic_features():
    lexicon = {b"idiot": 3.0}
    f = dict(zip(toxicity.NAMES, toxicity.features("You IDIOT, 1d10t!", lexicon), strict=True))
    assert f["hit_density"] > 0 and f["near_second_person"] == 1 and f["obfuscated_density"] > 0 and f["capitals"] > 0
    assert not any(toxicity.features("", lexicon))


def test_prior_and_risk():
    rng = np.random.default_rng(1)
    p = rng.normal(1.5, 1, (3000, 2))
    u = np.vstack([rng.normal(1.5, 1, (2100, 2)), rng.normal(-2, 1, (900, 2))])[rng.permutation(3000)]
    prior = quality_pu.estimate_prior(p, u)
    assert abs(prior - 0.7) < 0.06
    net = quality_pu.fit_nnpu(p, u, prior)
    assert quality_pu.sigmoid(net.margin(rng.normal(1.5, 1, (500, 2)))).mean() > 0.9
    assert quality_pu.sigmoid(net.margin(rng.normal(-2, 1, (500, 2)))).mean() < 0.1


def test_quality_features_by_their_definitions():
    """Every feature counted the plain way."""
    import math
    import re

    texts = ["", "  \n ", "One two two THREE!\nOne two two THREE!\n\n#a | b", "a b c a b c a b", "é É x" * 9, "1 2 3 $5\n|x|", "w"]
    for t in texts:
        raw = t.encode()
        words, lines, size = raw.split(), [x for x in raw.split(b"\n") if x.strip()], len(raw)
        n = len(words)
        f = dict(zip(quality_pu.NAMES, quality_pu.features(raw), strict=True))
        if not n:
            assert not any(f.values())
            continue
        of = lambda pattern: len(re.findall(pattern, raw))
        triples = [tuple(words[i : i + 3]) for i in range(n - 2)]
        upper, lower = of(rb"[A-Z]"), of(rb"[a-z]")
        want = {
            "log_words": math.log1p(n), "distinct_words": len(set(words)) / n, "repeats_next": sum(words[i] == words[i + 1] for i in range(n - 1)) / n,
            "commonest_bigram_repeats": 1 - len(set(triples)) / len(triples) if triples else 0.0, "symbols": min(1, of(rb"[#*$%&<>]") / n), "loud": min(1, of(rb"[!?]") / n),
            "capitals": upper / max(1, upper + lower), "repeated_lines": 1 - len(set(lines)) / len(lines), "word_length": math.log1p((size - n) / n),
            "marks": min(1, of(rb"[!-/:-@\[-`{-~]") / n), "digits": min(1, of(rb"[0-9]") / n), "words_a_line": math.log1p(n / len(lines)), "bars": min(1, of(rb"\|") / n),
        }
        assert {k: round(v, 12) for k, v in f.items()} == {k: round(float(v), 12) for k, v in want.items()}


def test_the_risk_that_is_minimised():
    """The slope against differences of the non-negative risk, where its second part is positive, and of that part where it is not."""
    rng = np.random.default_rng(2)
    p, u, prior = rng.normal(1, 1, (40, 2)), rng.normal(0, 1, (50, 2)), 0.6
    seen = []

    class Spy(quality_pu.Network):
        def fit(self, x, slope):
            seen.append(slope)
            return self

    start = quality_pu.Network.start
    try:
        quality_pu.Network.start = staticmethod(lambda x, seed: Spy(*vars(start(x, seed)).values()))
        quality_pu.fit_nnpu(p, u, prior)
    finally:
        quality_pu.Network.start = staticmethod(start)
    loss = lambda z: np.logaddexp(0, -z)
    second = lambda z: loss(-z[40:]).mean() - prior * loss(-z[:40]).mean()
    whole = lambda z: prior * loss(z[:40]).mean() + second(z)
    for z in (rng.normal(0, 1, 90), np.r_[np.full(40, 4.0), np.full(50, -4.0)]):
        f = whole if second(z) >= 0 else (lambda z: -second(z))
        numeric = np.array([(f(z + d) - f(z - d)) / 2e-6 for d in np.eye(90) * 1e-6])
        assert np.allclose(seen[0](z), numeric, atol=1e-6)


def test_samples_of_repeated_ids_repeat(spark):
    """Ids that stand for several texts give one row, the same whatever the partitions."""
    docs = spark.createDataFrame([(i % 50, f"text {i} of many") for i in range(400)] + [(None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    one, two = (sorted(map(tuple, quality_pu._samples(docs.repartition(n), labels, 12, 9).collect())) for n in (1, 6))
    assert one == two and len({r[0] for r in one}) == len(one) <= 21
    assert sum(r[1] for r in one) == 12 and 0 < sum(r[2] for r in one) <= 9


def test_toxicity_score_against_plain_arithmetic(spark):
    """Scores of a fitted model, tree by tree and knot by knot."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for r in docs.limit(40).collect():
        x, margin = toxicity.features(r.text or "", model.lexicon), model.trees.base
        for which, cut, leaf in model.trees.trees:
            node = 0
            for _ in range(toxicity.DEPTH):
                node = 2 * node + (2 if x[which[node]] > cut[node] else 1)
            margin += leaf[node - (2**toxicity.DEPTH - 1)]
        xs, ys = model.knots
        at = np.searchsorted(xs, margin)
        want = ys[0] if at == 0 else ys[-1] if at == len(xs) else ys[at - 1] + (ys[at] - ys[at - 1]) * (margin - xs[at - 1]) / (xs[at] - xs[at - 1])
        assert abs(got[r.doc_id] - 0.999 * want - 0.001 / (1 + np.exp(-margin))) < 1e-9
