"""Operator 3 against a scan of every block with every template."""

import random
import re

from factloom.llm import license_scan as ls
from tests.llm.helpers import documents

NOTICE = "intro words here\n" + ls.TEMPLATES[0][1] + "\nand more"


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def brute(text):
    words, base = words_of(text), []
    for phrase, label in ls.PHRASES:
        p = [w.encode() for w in phrase.split()]
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    best, labels = 0.0, {x for _, x in base}
    half = ls.BLOCK // 2
    for b in range(max(1, -(-len(words) // half))):
        block = set(words[b * half : b * half + ls.BLOCK])
        for label, t in ls.TEMPLATES:
            own = set(words_of(t))
            if len(own & block) >= ls.CONTAINED * len(own) - 1e-9:
                labels.add(label)
                best = max(best, len(own & block) / len(own))
    at = [i for i, _ in base]
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 if base else best


def texts():
    rng = random.Random(2)
    out = ["Under the MIT License. under THE mit-license", "cc-by-nc 4 Apache License, Version 2.0", NOTICE, "under the the mit license under the mit license"]
    for _, t in ls.TEMPLATES:
        for _ in range(4):
            w = [x for x in t.split() if rng.random() > 0.15]
            out.append(" ".join(["filler"] * rng.choice([0, 50, 200]) + w + ["more"] * rng.choice([0, 90])))
    return out


def test_blocks_and_phrases(spark):
    from tests.llm.helpers import ODD_TEXTS

    docs = documents(spark, ODD_TEXTS + texts())
    got = sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))) for r in ls.scan(docs).collect())
    want = sorted(repr((r.doc_id, *(round(x, 9) if isinstance(x, float) else x for x in brute(r.text)))) for r in docs.collect())
    assert got == want
    assert any("mit" in g for g in got)
    assert ls.scan(docs.limit(0)).count() == 0


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in ls.scan(docs).collect()}
    for r in docs.collect():
        want = brute(r.text)
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels, g.labels) == want[:6]


def test_blocks_of_long_templates(spark):
    """Every block against every template, with one template longer than the usual block and texts that hold it anywhere."""
    rng = random.Random(7)
    long = " ".join(f"w{rng.randrange(10**6)}x" for _ in range(150))
    templates = (("long", long), *ls.TEMPLATES[:3])
    texts_ = []
    for before in (0, 1, 77, 149, 151, 290, 700):
        kept = [w for w in long.split() if rng.random() > 0.1]
        texts_.append(" ".join(["filler"] * before + kept + ["more"] * rng.choice([0, 5, 400])))
    docs = documents(spark, [*texts_, NOTICE, None, ""], extra=True)
    got = sorted(repr((r.doc_id, r.label, r.template, r.first_word, r.n_words, round(r.containment, 9))) for r in ls.scan_blocks(docs, templates).collect())
    want, step = [], 150
    for r in docs.collect():
        words = words_of(r.text)
        for b in [0, *(b for b in range(1, len(words)) if (b + 1) * step < len(words))]:
            block = words[b * step : (b + 2) * step]
            for k, (label, t) in enumerate(templates):
                own = set(words_of(t))
                share = len(own & set(block)) / len(own)
                if len(own & set(block)) >= ls.CONTAINED * len(own) - 1e-9 and block:
                    want.append(repr((r.doc_id, label, k, b * step, len(block), round(share, 9))))
    assert got == sorted(want)
    labels = {r.doc_id: r.labels for r in ls.scan(docs, templates).collect()}
    assert all(labels[i] == "long" for i in range(len(texts_)))
