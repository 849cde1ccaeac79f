"""Operator 9: approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

The upper tree is fitted on a bounded sample and goes to every task.  Each of its leaves that holds more than BIN vectors gets a
tree of its own, fitted on a bounded sample of that leaf where the leaf lies, so that the bins, which are the leaves of both
levels, grow in number with the vectors and not in size.  A query walks the upper tree, and then the lower trees it came to,
through a priority queue of nodes by distance to their centres; the bins it found are taken in order of that distance over
all trees.  How many it visits is calibrated: for a sample of queries the true neighbours are found by brute force over
all vectors, and visits widen until the sample's recall reaches the target (all bins if need be, which is exact).

Bins and the queries that visit them meet in groups of bounded size on either side, by hashes of their ids, so a bin that many
rows or many queries share is many tasks.  Equal vectors of a batch are kept by their k + 1 least ids, as no query can return
others.  Distances are Euclidean, in double precision on original vectors; a matrix product of vectors less their mean only
says which can be among the nearest, with a bound of its rounding error.

Vectors that are null, zero, of another length than the commonest, or hold null or non-finite components take no part,
nor do null ids.  Ties go to the smaller id.  Rows of equal ids are each a candidate, but for the query's own row; queries of equal
ids and vectors are answered once, those of equal ids and other vectors each.  A query of fewer candidates than k returns
all of them.  Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import common

#: Most vectors the tree is fitted on, branches of a node, most sample vectors of a leaf, rounds of k-means.
SAMPLE, BRANCHES, LEAF, ITERATIONS = 20_000, 8, 64, 8
#: Most queries of the calibration and the recall they must reach.
CALIBRATION, RECALL = 200, 0.97
#: Most vectors of a bin about, and the most vectors and queries about that one group compares.
BIN, PART_VECTORS, PART_QUERIES = 4_000, 4_000, 4_000
#: Bins that the calibration looks at first; it looks at four times as many until they are enough.
FIRST_VISITS = 64


@dataclass
class Tree:
    """Nodes by number: centre, children; leaves have a number of their own."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    @staticmethod
    def fit(x: np.ndarray) -> Tree:
        tree = Tree()

        def grow(rows: np.ndarray) -> int:
            node = len(tree.centres)
            tree.centres.append(rows.mean(0) if len(rows) else np.zeros(x.shape[1]))
            tree.children.append([])
            tree.leaf.append(-1)
            groups = split(rows) if len(rows) > LEAF else []
            if len(groups) < 2:
                tree.leaf[node] = tree.leaves
                tree.leaves += 1
            else:
                tree.children[node] = [grow(g) for g in groups]
            return node

        def split(rows: np.ndarray) -> list[np.ndarray]:
            rng = np.random.default_rng(len(rows))
            centres = rows[rng.choice(len(rows), min(BRANCHES, len(rows)), replace=False)]
            near = np.zeros(len(rows), np.int64)
            for _ in range(ITERATIONS):
                near = ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)
                centres = np.stack([rows[near == k].mean(0) if (near == k).any() else centres[k] for k in range(len(centres))])
            return [rows[near == k] for k in range(len(centres)) if (near == k).any()]

        grow(x)
        return tree

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf each row descends to."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                kids = self.children[node]
                c = np.stack([self.centres[k] for k in kids])
                near = ((c**2).sum(1) - 2 * x[rows] @ c.T).argmin(1)
                todo += [(k, rows[near == i]) for i, k in enumerate(kids)]
        return out

    def visit(self, q: np.ndarray, most: int) -> list[tuple[int, float]]:
        """The first `most` leaves and their squared distances, best bin first."""
        queue, order = [(0.0, 0)], []
        while queue and len(order) < most:
            far, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                order.append((self.leaf[node], far))
            for k in self.children[node]:
                heapq.heappush(queue, (float(((self.centres[k] - q) ** 2).sum()), k))
        return order


def vectors_of(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors in double precision)."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(sizes == d)
    if not len(right) or not d:
        return np.zeros(0, np.int64), np.zeros((0, d))
    flat = pc.list_flatten(column.take(pa.array(right)))
    x = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False).reshape(len(right), d)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return right[ok], x[ok]


_EPS = np.finfo(float).eps


def _exponent(*arrays: np.ndarray) -> int:
    """The power of two to divide by so that squares neither overflow nor vanish; 0 for numbers of usual size.  Exact."""
    most = max((float(np.abs(x).max()) for x in arrays if x.size), default=0.0)
    return math.frexp(most)[1] if most and not 1e-140 < most < 1e140 else 0


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to one vector."""
    e = _exponent(q, x)
    if e:
        return np.ldexp(np.sqrt(((np.ldexp(x, -e) - np.ldexp(q, -e)) ** 2).sum(1)), e)
    return np.sqrt(((x - q) ** 2).sum(1))


def nearest(q: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vector ids, distances) of the k nearest of each query, ties to the smaller id.

    Squared distances come from a matrix product of vectors less their mean.  Each lies within `slack` of the true one, so
    those whose least value is above the k-th greatest value cannot be among the nearest; the others are measured directly.
    """
    e = _exponent(q, x)
    scaled = lambda v: np.ldexp(v, -e) if e else v
    centre = scaled(x).mean(0)
    y = scaled(x) - centre
    norms = (y**2).sum(1)
    for s in range(0, len(q), 256):
        part = scaled(q[s : s + 256]) - centre
        own = (part**2).sum(1)[:, None]
        square = own + norms - 2 * part @ y.T
        slack = 8 * _EPS * (x.shape[1] + 8) * (own + norms)
        for i in range(len(part)):
            near = np.arange(len(x))
            if len(x) > k:
                edge = np.partition(square[i] + slack[i], k - 1)[k - 1]
                near = np.flatnonzero(square[i] - slack[i] <= edge)
            exact = distances(q[s + i], x[near])
            best = np.lexsort((xid[near], exact))[:k]
            yield xid[near][best], exact[best]


FOUND = "query_id long, query_key long, vec_id long, score double"


def _batch(qid: np.ndarray, key: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    sizes = [len(f[0]) for f in found]
    cat = lambda i, t: np.concatenate([f[i] for f in found]).astype(t) if found else np.zeros(0, t)
    columns = [np.repeat(qid, sizes).astype(np.int64), np.repeat(key, sizes).astype(np.int64), cat(0, np.int64), cat(1, float)]
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), [x.split()[0] for x in FOUND.split(", ")])


def _top(found: DataFrame, k: int) -> DataFrame:
    """(query_id, query_key, rank, vec_id, score): the k nearest of found rows that hold the query's own, which goes.

    Its own row is one of those with its id at distance 0; where a row equals it in both, one of them goes.
    """
    query = Window.partitionBy("query_id", "query_key")
    near = found.withColumn("n", F.row_number().over(query.orderBy("score", "vec_id"))).where(F.col("n") <= k + 1)
    own = near.withColumn("own", F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0), F.col("n"))).over(query))
    rank = F.col("n") - F.coalesce((F.col("n") > F.col("own")).cast("int"), F.lit(0))
    rest = own.where(F.col("own").isNull() | (F.col("n") != F.col("own")))
    return rest.select("query_id", "query_key", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def brute_force(vectors: DataFrame, queries: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, dimension: int) -> DataFrame:
    """The exact nearest of a bounded set of queries (ids, keys, vectors) among all vectors: every distance, measured directly."""
    qid, key, q = queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = vectors_of(b.column(1), dimension)
            ids, found = b.column(0).to_numpy(zero_copy_only=False)[rows], []
            for v in q if len(x) else ():
                d = distances(v, x)
                near = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k + 1 else np.arange(len(d))
                best = near[np.lexsort((ids[near], d[near]))[: k + 1]]
                found.append((ids[best], d[best]))
            yield _batch(qid, key, found) if found else _batch(qid[:0], key[:0], [])

    return _top(vectors.select("vec_id", "embedding").mapInArrow(run, FOUND), k)


@dataclass
class Search:
    """The fitted trees over a table of bins, and the calibrated number of visits."""

    tree: Tree
    dimension: int
    k: int
    queries: DataFrame  # (vec_id, query_key, embedding)
    bins: DataFrame  # (leaf, sub, vec_id, embedding): every vector that takes part
    subtrees: DataFrame | None  # (leaf, tree): lower trees of the leaves that need one
    deep: frozenset[int]  # these leaves
    visits: int = 0
    recall: float = 1.0


def _commonest_length(vectors: DataFrame) -> int:
    size = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return int(size[0]["d"]) if size else 0


def _assigned(vectors: DataFrame, tree: Tree, d: int, k: int) -> DataFrame:
    """(leaf, vec_id, embedding as double) of the vectors that take part; of equal ones in a batch the k + 1 least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = vectors_of(b.column(1), d)
            ids = b.column(0).to_numpy(zero_copy_only=False)[rows]
            order = np.lexsort((ids, *x.T[::-1])) if len(x) else rows
            x, ids = x[order], ids[order]
            first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]).any(1)]) if len(x) else rows
            place = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)]))
            x, ids = x[place <= k], ids[place <= k]
            yield pa.RecordBatch.from_arrays([pa.array(tree.assign(x)), pa.array(ids.astype(np.int64)), common.int_lists(x.ravel(), [d] * len(x))], ["leaf", "vec_id", "embedding"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "leaf long, vec_id long, embedding array<double>")


def _fit_lower(placed: DataFrame, sizes: dict[int, int], d: int) -> DataFrame:
    """(leaf, tree): a tree on about SAMPLE vectors, by hash, of each leaf in sizes."""
    rate = F.element_at(F.create_map(*(F.lit(x) for leaf, n in sizes.items() for x in (leaf, min(1.0, SAMPLE / n)))), F.col("leaf"))
    chosen = placed.where(F.col("leaf").isin(*sizes)).where(F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(1 << 20)) < rate * (1 << 20))

    def fit(rows: pa.Table) -> pa.Table:
        x = vectors_of(rows.column("embedding").combine_chunks(), d)[1]
        return pa.table({"leaf": pa.array([rows.column("leaf")[0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps(Tree.fit(x))], pa.binary())})

    return common.table(chosen.groupBy("leaf").applyInArrow(fit, "leaf long, tree binary"), "subtrees")


def _salted(rows: DataFrame, sizes: DataFrame, trees: DataFrame, hashed: str, most: int) -> tuple[DataFrame, DataFrame]:
    """rows and trees with `salt`, so that a leaf's rows meet its tree in groups of about `most`.  sizes(leaf, n)."""
    parts = sizes.select("leaf", F.ceil(F.col("n") / most).alias("salts"))
    dealt = rows.join(parts, "leaf").withColumn("salt", F.pmod(F.xxhash64(hashed), F.col("salts"))).drop("salts")
    copies = trees.join(parts, "leaf").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return dealt, copies


def _refined(placed: DataFrame, trees: DataFrame, sizes: dict[int, int], d: int) -> DataFrame:
    """(leaf, sub, vec_id, embedding) of the leaves in sizes by their lower trees."""
    of_leaf = placed.sparkSession.createDataFrame(list(sizes.items()), "leaf long, n long")
    rows, copies = _salted(placed.where(F.col("leaf").isin(*sizes)), of_leaf, trees, "vec_id", PART_VECTORS)

    def assign(vectors: pa.Table, tree: pa.Table) -> pa.Table:
        x = vectors_of(vectors.column("embedding").combine_chunks(), d)[1]
        sub = pickle.loads(tree.column("tree")[0].as_py()).assign(x) if len(tree) else np.zeros(len(x), np.int64)
        return pa.table({"leaf": vectors.column("leaf"), "sub": pa.array(sub), "vec_id": vectors.column("vec_id"), "embedding": vectors.column("embedding")})

    return rows.groupBy("leaf", "salt").cogroup(copies.groupBy("leaf", "salt")).applyInArrow(assign, "leaf long, sub long, vec_id long, embedding array<double>")


def _routed(queries: DataFrame, found: Search, visits: int) -> DataFrame:
    """(query_id, query_key, leaf, sub, n): the first bins of queries(vec_id, query_key, embedding), best bin first from 1."""
    tree, d, deep = found.tree, found.dimension, found.deep

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = vectors_of(b.column(2), d)
            seen = [tree.visit(v, visits) for v in x]
            at = np.repeat(np.arange(len(x)), [len(o) for o in seen])
            leaf = np.array([n for o in seen for n, _ in o], np.int64)
            far = np.array([f for o in seen for _, f in o], float)
            lower = np.isin(leaf, list(deep))
            sizes = np.where(lower, d, 0)
            flat = np.repeat(x[at], lower.astype(int), axis=0).ravel()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(leaf), pa.array(np.zeros(len(at), np.int64)), pa.array(far), pa.array(lower), common.int_lists(flat, sizes.tolist())],
                ["query_id", "query_key", "leaf", "sub", "far", "lower", "v"],
            )

    first = queries.select("vec_id", "query_key", "embedding").mapInArrow(walk, "query_id long, query_key long, leaf long, sub long, far double, lower boolean, v array<double>")
    keys = ["query_id", "query_key", "leaf", "sub", "far"]
    if not deep:
        met = first.select(*keys)
    else:
        first = common.table(first, "walks")
        rows = first.where("lower").select("query_id", "query_key", "leaf", "v")
        rows, copies = _salted(rows, rows.groupBy("leaf").agg(F.count("*").alias("n")), found.subtrees, "query_id", PART_QUERIES)

        def descend(asked: pa.Table, lower: pa.Table) -> pa.Table:
            x = vectors_of(asked.column("v").combine_chunks(), d)[1]
            below = pickle.loads(lower.column("tree")[0].as_py()) if len(x) else None
            seen = [below.visit(v, visits) for v in x]
            at = pa.array(np.repeat(np.arange(len(x)), [len(o) for o in seen]))
            flat = [r for o in seen for r in o]
            return pa.table({**{c: asked.column(c).take(at) for c in ("query_id", "query_key", "leaf")}, "sub": pa.array([r[0] for r in flat], pa.int64()), "far": pa.array([r[1] for r in flat], pa.float64())})

        below = rows.groupBy("leaf", "salt").cogroup(copies.groupBy("leaf", "salt")).applyInArrow(descend, "query_id long, query_key long, leaf long, sub long, far double")
        met = first.where("not lower").select(*keys).union(below.select(*keys))
    order = Window.partitionBy("query_id", "query_key").orderBy("far", "leaf", "sub")
    return met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= visits).select("query_id", "query_key", "leaf", "sub", "n")


def _queries(vectors: DataFrame, is_query, d: int) -> DataFrame:
    """(vec_id, query_key, embedding as double): the query rows that take part, those of equal ids and vectors once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = vectors_of(b.column(1), d)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), common.int_lists(x.ravel(), [d] * len(rows))], ["vec_id", "embedding"])

    clean = vectors.where(is_query).select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>")
    return clean.select("vec_id", F.xxhash64("embedding").alias("query_key"), "embedding").dropDuplicates(["vec_id", "query_key"])


def fit(vectors: DataFrame, is_query, k: int) -> Search | None:
    """Fit the trees, place all vectors(vec_id, embedding) and calibrate; None if no vector takes part."""
    d = _commonest_length(vectors)
    if not d:
        return None
    by_hash = F.xxhash64(F.lit(9), "vec_id")
    sample = vectors.select("vec_id", "embedding").orderBy(by_hash, "vec_id").limit(SAMPLE).toArrow().combine_chunks()
    _, x = vectors_of(sample.column("embedding").combine_chunks(), d)
    if not len(x):
        x = vectors_of(vectors.where(F.exists("embedding", lambda v: v != 0)).limit(SAMPLE).toArrow().column("embedding").combine_chunks(), d)[1]
    if not len(x):
        return None
    tree = Tree.fit(x)
    placed = common.table(_assigned(vectors, tree, d, k), "leaves", numbers=True)
    sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().where(F.col("count") > BIN).collect()}  # as many rows as leaves at most
    bins, trees = placed.select("leaf", F.lit(0).cast("long").alias("sub"), "vec_id", "embedding"), None
    if sizes:
        trees = _fit_lower(placed, sizes, d)
        bins = common.table(bins.where(~F.col("leaf").isin(*sizes)).unionByName(_refined(placed, trees, sizes, d)), "bins", numbers=True)
    queries = common.table(_queries(vectors, is_query, d), "queries", numbers=True)
    return _calibrated(Search(tree, d, k, queries, bins, trees, frozenset(sizes)), vectors)


def _calibrated(found: Search, vectors: DataFrame) -> Search:
    """found with the visits that bring RECALL of the true neighbours of at most CALIBRATION queries."""
    asked = found.queries.orderBy(F.xxhash64(F.lit(9), "vec_id"), "vec_id", "query_key").limit(CALIBRATION)
    some = asked.toArrow().combine_chunks()
    if not len(some):
        found.visits = 1
        return found
    qid, key = (some.column(c).to_numpy() for c in ("vec_id", "query_key"))
    q = vectors_of(some.column("embedding").combine_chunks(), found.dimension)[1]
    true = common.table(brute_force(vectors, (qid, key, q), found.k, found.dimension).select("query_id", "query_key", "vec_id"), "true")
    where = found.bins.select("vec_id", "leaf", "sub").join(F.broadcast(true.select("vec_id").distinct()), "vec_id")  # at most CALIBRATION * k ids
    wanted = common.table(true.join(where, "vec_id").dropDuplicates(["query_id", "query_key", "vec_id"]), "true-bins")
    queries = found.bins.sparkSession.createDataFrame([(int(i), int(h), v.tolist()) for i, h, v in zip(qid, key, q, strict=True)], "vec_id long, query_key long, embedding array<double>")
    total, visits = wanted.count(), FIRST_VISITS
    bins = found.tree.leaves if not found.deep else found.bins.select("leaf", "sub").distinct().count()
    while True:
        met = _routed(queries, found, visits).join(wanted, ["query_id", "query_key", "leaf", "sub"]).select("n").collect()
        places = np.sort(np.array([r["n"] for r in met] or [0]))
        if len(places) >= RECALL * total or visits >= bins:
            break
        visits *= 4
    need = math.ceil(RECALL * total)
    found.visits = int(places[min(len(places), max(1, need)) - 1]) if total else 1
    found.recall = float((places <= found.visits).sum() / total) if total else 1.0
    return found


def search(found: Search) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query row."""
    d, k, queries = found.dimension, found.k, found.queries
    routed = common.table(_routed(queries, found, found.visits), "routes")
    count = lambda df, name, most: df.groupBy("leaf", "sub").agg(F.ceil(F.count("*") / most).alias(name))
    shape = count(found.bins, "parts", PART_VECTORS).join(count(routed, "groups", PART_QUERIES), ["leaf", "sub"])
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    at = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    of_vectors = found.bins.join(shape, ["leaf", "sub"]).select("leaf", "sub", at("vec_id", "parts").alias("part"), each("groups").alias("g"), "vec_id", "embedding")
    of_queries = routed.join(shape, ["leaf", "sub"]).select("leaf", "sub", each("parts").alias("part"), at("query_id", "groups").alias("g"), "query_id", "query_key")
    of_queries = of_queries.join(queries.withColumnRenamed("vec_id", "query_id"), ["query_id", "query_key"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.Table.from_batches([_batch(np.zeros(0, np.int64), np.zeros(0, np.int64), [])])
        x, q = (vectors_of(t.column("embedding").combine_chunks(), d)[1] for t in (left, right))
        got = list(nearest(q, x, left.column("vec_id").to_numpy(), k + 1))
        return pa.Table.from_batches([_batch(right.column("query_id").to_numpy(), right.column("query_key").to_numpy(), got)])

    keys = ["leaf", "sub", "part", "g"]
    met = of_vectors.groupBy(*keys).cogroup(of_queries.groupBy(*keys)).applyInArrow(compare, FOUND)
    return _top(met, k).select("query_id", "rank", "vec_id", "score")


def op9_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    is_query = F.col("vec_id") % 100 == 0
    found = fit(vectors, is_query, 10)
    return search(found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
