"""Operator 13: a Merkle manifest of a dataset that keeps only every few levels of its trees and recomputes the others.

Each lang has a tree over its rows, and a forest tree stands over the roots of the langs.  `build` numbers the leaves of
every tree and climbs STEP levels a round: the nodes of a round are written, the levels between are not.  `proofs` comes down
again: each aligned subtree of at most 2 ** STEP stored nodes is one group, which recomputes its missing levels from them,
gives each of its nodes the siblings on its way up and lets the levels go.  Subtrees have a bounded size whatever the share of
one lang, and only stored nodes and the ways of their parents are shuffled.

Definitions for odd rows: null fields are `-`; a null lang is a tree of its own that comes first; rows with a null id come
first in their tree; rows of one id are ordered by their leaf, and equal rows are leaves of their own; a null id counts as
the empty text for the choice of tampered rows.  An empty table has no rows.  Columns that are not named here are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import common

#: Levels between two stored ones, and so 2 ** STEP stored nodes at most in a subtree.
STEP = 10
#: The fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose crc32 of the decimal id this divides are tampered with.
TAMPERED = 7

_NODE = "tree string, n long, idx long, h string"
_PATHS = "tree string, idx long, path array<string>"


def field(value: Column) -> Column:
    """A value as it is hashed: `-` for null, else its number of UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**other: Column) -> Column:
    """The hash of a row; a field may be given another value."""
    return F.sha2(F.concat(*(field(other.get(c, F.col(c))) for c in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, lang, h, tampered) of each row; tampered is the hash after n_chars + 1 where the row is tampered with."""
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % TAMPERED == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")  # no overflow at the largest number
    tree = F.coalesce(F.concat(F.lit("-"), F.col("lang")), F.lit("+"))  # null sorts first
    return docs.select(tree.alias("tree"), "doc_id", "lang", leaf().alias("h"), F.when(chosen, leaf(n_chars=more)).alias("tampered"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows(tree, ...) with idx, the place in their tree, and n, the size of the tree.

    Ranges of rows in order, cut by all of the order and the place in the written input, so that many equal rows do not meet in one
    range; places count from the starts of a tree in its ranges, of which there is one a range and tree.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange(n, "tree", *order, "tie").sortWithinPartitions("tree", *order, "tie").drop("tie")
    at = common.table(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    spans = at.groupBy("tree", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    of_tree = Window.partitionBy("tree")
    before = of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select("tree", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(of_tree).alias("n"))
    joined = at.withColumn("part", F.shiftright("at", 33)).join(starts, ["tree", "part"])
    return joined.select(*rows.columns, (F.col("before") + F.col("at") - F.col("first")).alias("idx"), "n")


def parent(children: list[str]) -> str:
    """The hash of one or two children."""
    return hashlib.sha256("".join(children).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    return (n - 1).bit_length()


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the levels above them."""
    found = [nodes]
    for _ in range(levels):
        below = found[-1]
        found.append([parent(below[i : i + 2]) for i in range(0, len(below), 2)])
    return found


def ways(nodes: list[str], levels: int) -> list[list[str]]:
    """For each node its siblings from below: `l` or `r` and the hash of the left or right one, empty where there is none."""
    found = climb(nodes, levels)
    side = lambda i, level: ("l" if i & 1 else "r") + level[i ^ 1] if i ^ 1 < len(level) else ""
    return [[side(i >> k, found[k]) for k in range(levels)] for i in range(len(nodes))]


def fold(start: str, way: list[str]) -> str:
    """The root that a node and the siblings on its way give."""
    for s in way:
        start = parent([start] if not s else [s[1:], start] if s[0] == "l" else [start, s[1:]])
    return start


@dataclass
class Manifest:
    """Stored levels from below, (tree, n, idx, h) each with n nodes in the tree at that level, and the roots (tree, h)."""

    levels: list[DataFrame]
    roots: DataFrame
    step: int = STEP


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("idx")


def build(nodes: DataFrame, step: int = STEP) -> Manifest:
    """The manifest of nodes(tree, n, idx, h); other columns are kept in its lowest level.

    A round climbs `step` levels in every tree that has more than one node left.
    """

    def top(key, table):
        table = _sorted(table)
        n = table["n"][0].as_py()
        levels = min(step, height(n))
        root = climb(table["h"].to_pylist(), levels)[-1][0]
        return pa.table({"tree": [table["tree"][0].as_py()], "n": [-(-n >> levels)], "idx": [table["idx"][0].as_py() >> levels], "h": [root]})

    levels, roots = [nodes], None
    while True:
        last = levels[-1]
        done = last.where("n = 1").select("tree", "h")
        roots = done if roots is None else roots.union(done)
        open_ = last.where("n > 1").select("tree", "n", "idx", "h")
        up = common.table(open_.groupBy("tree", F.shiftright("idx", step).alias("sub")).applyInArrow(top, _NODE), "level")
        if up.isEmpty():
            return Manifest(levels, roots, step)
        levels.append(up)


def _with_parents(level: DataFrame, above: DataFrame, step: int):
    """Subtrees of a level beside the ways of the nodes over them."""
    left = level.groupBy("tree", F.shiftright("idx", step).alias("sub"))
    return left.cogroup(above.groupBy("tree", F.col("idx").alias("sub")))


def _found(table: pa.Table, upper: pa.Table, step: int) -> tuple[pa.Table, list[list[str]]]:
    """The nodes of a subtree in order, and the whole way of each."""
    if not table.num_rows:
        return table, []
    table = _sorted(table)
    rest = upper["path"][0].as_py()
    return table, [w + rest for w in ways(table["h"].to_pylist(), min(step, height(table["n"][0].as_py())))]


def _parents(level: DataFrame, known: DataFrame | None, above: DataFrame) -> DataFrame:
    """(tree, idx, path): the ways of the nodes over a level's subtrees; a node that is its tree's root goes the way of its tree."""
    roots = above.join(level.where("n = 1").select("tree"), "tree", "left_semi").select("tree", F.lit(0).cast("long").alias("idx"), "path")
    return roots if known is None else known.union(roots)


def paths(levels: list[DataFrame], above: DataFrame, step: int = STEP) -> DataFrame | None:
    """(tree, idx, path): the siblings of each node of the lowest of some stored levels, up to the root; None without levels.

    above(tree, path): the way of a tree's root in the tree above it.
    """

    def down(key, table, upper):
        table, found = _found(table, upper, step)
        return pa.table({"tree": table["tree"], "idx": table["idx"], "path": pa.array(found, pa.list_(pa.string()))})

    known = None
    for level in reversed(levels):
        known = common.table(_with_parents(level, _parents(level, known, above), step).applyInArrow(down, _PATHS), "paths")
    return known


def proofs(manifest: Manifest, above: DataFrame, root: str | None) -> DataFrame:
    """The proof of every leaf, and the root that it gives for the row as it is now: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    step, lowest = manifest.step, manifest.levels[0]

    def prove(key, table, upper):
        table, found = _found(table, upper, step)
        h, now = table["h"].to_pylist(), table["tampered"].to_pylist()
        proof = [hashlib.sha256("".join([s[1:] for s in w]).encode()).hexdigest() for w in found]
        folded = [fold(t or x, w) for x, t, w in zip(h, now, found, strict=True)]
        given = {"doc_id": table["doc_id"].cast(pa.int64()), "leaf": table["h"], "tree": table["tree"]}
        return pa.table(given | {"proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string())})

    known = paths(manifest.levels[1:], above, step)
    rows = _with_parents(lowest, _parents(lowest, known, above), step).applyInArrow(prove, "doc_id long, leaf string, tree string, proof_sha256 string, folded_root string")
    named = rows.join(manifest.roots.select("tree", F.col("h").alias("subroot")), "tree")
    of_all = F.lit(root).cast("string")
    return named.select("doc_id", "leaf", "subroot", of_all.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == of_all).alias("verified"))


def manifest_of(docs: DataFrame, step: int = STEP) -> tuple[Manifest, Manifest]:
    """The manifest of all langs and that of the forest over their roots."""
    common.bound_batches(docs.sparkSession)
    rows = numbered(common.table(leaves(docs), "leaves"), "doc_id", "h")
    langs = build(common.table(rows, "leaves"), step)
    subroots = common.table(langs.roots, "subroots")
    langs.roots = subroots
    forest_rows = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "h"), "name")
    return langs, build(common.table(forest_rows, "forest"), step)


def prove_all(docs: DataFrame, step: int = STEP) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    langs, forest = manifest_of(docs, step)
    top = docs.sparkSession.createDataFrame([("", [])], "tree string, path array<string>")
    above = paths(forest.levels, top, step).join(forest.levels[0].select("idx", "name"), "idx").select(F.col("name").alias("tree"), "path")
    root = forest.roots.head()  # one row at most
    return proofs(langs, common.table(above, "above"), root["h"] if root else None)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents and a proof of each."""
    return prove_all(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: crc32 of a text of ASCII characters (a macro would be needed to name it).
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(list_filter(string_split({0}, ''), lambda x: x <> ''), lambda x: ascii(x)::UBIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT)"""
_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256({0} || {1} || {2} || {3} || {4})"


def _leaf_sql(n_chars: str) -> str:
    return _LEAF.format(*(_FIELD.format(n_chars if c == "n_chars" else c) for c in FIELDS))


OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('-' || lang, '+') AS tree, {_leaf_sql('n_chars')} AS leaf,
         CASE WHEN {_CRC.format("coalesce(CAST(doc_id AS VARCHAR), '')")} % {TAMPERED} = 0 THEN {_leaf_sql('(CAST(n_chars AS HUGEINT) + 1)')} END AS tampered FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d
), t AS (
  SELECT 0 AS level, tree, idx, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM l UNION ALL
  SELECT level + 1, tree, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY level, tree, idx // 2, n
), s AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS idx FROM t WHERE n = 1
), f AS (
  SELECT 0 AS level, idx, subroot AS h, count(*) OVER () AS n FROM s UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM f WHERE n > 1 GROUP BY level, idx // 2, n
), r AS (
  SELECT h AS root FROM f WHERE n = 1
), w AS (
  SELECT l.tree, l.idx, t.level, xor(l.idx >> t.level, 1) < (l.idx >> t.level) AS left_, x.h FROM l JOIN t ON t.tree = l.tree AND t.n > 1 AND t.idx = l.idx >> t.level
    LEFT JOIN t x ON x.tree = l.tree AND x.level = t.level AND x.idx = xor(l.idx >> t.level, 1)
  UNION ALL
  SELECT l.tree, l.idx, 1000 + f.level, xor(s.idx >> f.level, 1) < (s.idx >> f.level), x.h FROM l JOIN s ON s.tree = l.tree JOIN f ON f.n > 1 AND f.idx = s.idx >> f.level
    LEFT JOIN f x ON x.level = f.level AND x.idx = xor(s.idx >> f.level, 1)
), p AS (
  SELECT tree, idx, list(struct_pack(left_ := left_, h := h) ORDER BY level) AS way, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof FROM w GROUP BY 1, 2
), o AS (
  SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256,
         list_reduce(list_concat([struct_pack(left_ := false, h := coalesce(tampered, leaf))], coalesce(way, [])),
           lambda a, b: struct_pack(left_ := false, h := sha256(CASE WHEN b.h IS NULL THEN a.h WHEN b.left_ THEN b.h || a.h ELSE a.h || b.h END))).h AS folded_root
  FROM l JOIN s USING (tree) CROSS JOIN r LEFT JOIN p ON p.tree = l.tree AND p.idx = l.idx
)
SELECT *, folded_root = root AS verified FROM o
"""
