"""Operator 13 against a plain tree, at several steps, and against its SQL."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest

from factloom.llm import merkle
from tests.llm.helpers import DOCS, documents


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"] if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(nodes):
    """The root, and of each node its siblings by level as (side, hash)."""
    ways, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i, k in enumerate(at):
            other = k ^ 1
            ways[i].append((other < k, level[other]) if other < len(level) else None)
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        at = [k // 2 for k in at]
    return level[0], ways


def brute(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {x: tree_of([y[2] for y in sorted(trees[x], key=lambda y: y[:3])]) for x in langs}
    root, upper = tree_of([made[x][0] for x in langs])
    out = []
    for lang, up in zip(langs, upper, strict=True):
        for (*_, leaf, r), way in zip(sorted(trees[lang], key=lambda y: y[:3]), made[lang][1], strict=True):
            now = leaf_of(r, 1) if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 == 0 else leaf
            for s in way + up:
                now = sha(now if s is None else s[1] + now if s[0] else now + s[1])
            proof = sha("".join(s[1] for s in way + up if s))
            out.append((r["doc_id"], leaf, made[lang][0], root, proof, now, now == root))
    return sorted(out, key=repr)


def same(spark, rows, step):
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((tuple(r) for r in merkle.prove_all(df, step).collect()), key=repr)
    assert got == brute([r.asDict() for r in df.collect()])
    return got


@pytest.mark.parametrize("n,step", [(1, 10), (2, 1), (7, 2), (33, 2), (70, 3), (70, 10)])
def test_trees_of_any_size(spark, n, step):
    rows = [(i * 3, f"text {i}", [None, "de", "en", "en", "en"][i % 5], "s", i if i % 3 else None) for i in range(n)]
    got = same(spark, rows, step)
    tampered = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None]
    assert sum(not x[-1] for x in got) == len(tampered)


def test_many_trees_and_uneven_ones(spark):
    rows = [(i, "x", f"l{i % 23}" if i % 2 else "big", None, i) for i in range(150)]
    same(spark, rows, 2)


def test_odd_rows(spark):
    docs = documents(spark)
    got = sorted((tuple(r) for r in merkle.prove_all(docs, 2).collect()), key=repr)
    assert got == brute([r.asDict() for r in docs.collect()])


def test_rows_of_one_id_are_spread(spark):
    rows = spark.range(5_000).selectExpr("cast(7 as long) doc_id", "'same' text", "'en' lang", "'s' source", "cast(9223372036854775807 as long) n_chars")
    got = merkle.prove_all(rows, 4).collect()
    assert len(got) == 5_000 and len({r.root for r in got}) == 1
    assert len({r.proof_sha256 for r in got}) > 1
    leaves = merkle.numbered(merkle.common.table(merkle.leaves(rows), "t"), "doc_id", "h")
    assert sorted(r.idx for r in leaves.collect()) == list(range(5_000))


def test_an_empty_table_has_no_rows(spark):
    assert merkle.prove_all(spark.createDataFrame([], DOCS)).count() == 0


def test_only_every_few_levels_are_stored(spark):
    rows = spark.createDataFrame([(i, "x", "en", "s", i) for i in range(100)], DOCS)
    langs, _ = merkle.manifest_of(rows, 3)
    assert [x.count() for x in langs.levels] == [100, 13, 2, 1]


def test_sql(spark, tmp_path):
    docs = documents(spark)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(merkle.OP13_SQL)
    got = merkle.op13_merkle(spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
