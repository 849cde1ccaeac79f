"""Graphs of calls and value flow: reach, closure, components, cycles, condensation order.

Loops are semi-naive: each round joins the frontier only, and every round's result is written to the shared folder, so
lineage stays short.  A round is one job: what tells whether it was the last is observed while it is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.storage import Latest, cut, cut_count


class Seen:
    """What a loop has found: a few written tables, made one from time to time, so that no round rewrites them all.

    merge makes one row of those that later ones have replaced, where they do.
    """

    def __init__(self, first: DataFrame, most: int = 8, merge: Callable[[DataFrame], DataFrame] | None = None):
        self.parts, self.most, self.merge = [first], most, merge or (lambda df: df)

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > self.most:
            self.parts = [cut(self.merge(self.all()))]

    def all(self) -> DataFrame:
        return self.parts[0] if len(self.parts) == 1 else reduce(DataFrame.union, self.parts).hint("merge")  # a union loses the hints of its parts


def callees(edges: DataFrame, node) -> DataFrame:
    """One hop out."""
    return edges.where(F.col("src") == node).select(F.col("dst").alias("node")).distinct()


def callers(edges: DataFrame, node) -> DataFrame:
    """One hop in."""
    return edges.where(F.col("dst") == node).select(F.col("src").alias("node")).distinct()


def reverse(edges: DataFrame) -> DataFrame:
    """Edges the other way."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


#: A frontier of at most FEW rows, or of one row in SHARE of those found, takes STEPS steps in one round: a round, which reads all that was found, costs more than the steps do.
FEW, STEPS, SHARE = 100_000, 4, 16


def steps(rows: int, found: int) -> int:
    """How many steps a frontier takes in one round."""
    return STEPS if rows <= max(FEW, found // SHARE) else 1


def spread(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """start and all that step makes of it, over and over, each row once.  step gives rows with the columns of its argument."""
    keys = start.columns
    frontier, rows = cut_count(start.distinct())
    seen, found = Seen(frontier), rows
    while rows:
        ahead, made = frontier, []
        for _ in range(steps(rows, found)):
            ahead = step(ahead).select(*keys).distinct()
            made.append(ahead)
        frontier, rows = cut_count(reduce(DataFrame.union, made).distinct().join(seen.all(), keys, "left_anti"))
        found += rows
        if rows:
            seen.add(frontier)
    return seen.all()


def reachable(edges: DataFrame, seeds: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node): what the seeds reach, themselves included; seeds that are not in nodes are dropped."""
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    start = seeds.select("node")
    start = start.join(nodes.select("node"), "node", "left_semi") if nodes is not None else start
    return spread(start, lambda f: f.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")))


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst): pairs joined by a path of one edge or more; paths double in length each round.

    Only paths that are new are joined, on either side, with what is known.  The result has a row for every pair: ask `reachable` for few sources.
    """
    new, rows = cut_count(edges.select("src", "dst").distinct())
    seen = Seen(new)
    joined = lambda a, b: a.alias("a").join(b.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src"), F.col("b.dst"))
    while rows:
        step = joined(new, seen.all()).union(joined(seen.all(), new)).distinct()
        new, rows = cut_count(step.join(seen.all(), ["src", "dst"], "left_anti"))
        if rows:
            seen.add(new)
    return seen.all()


#: Trimming stops when a round takes less than one edge of so many: what is left of long chains goes by classes, in far fewer rounds.
TRIM_SHARE = 10


def trim(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges (and their number) that are left when nodes without a way in or out go, for as long as many of them do."""
    table = Latest()
    e, size = table.put_count(edges.select("src", "dst").distinct())
    while size:
        into, out = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
        e, now = table.put_count(e.join(into, "src", "left_semi").join(out, "dst", "left_semi"))
        if (size - now) * TRIM_SHARE < size:
            return e, now
        size = now
    return e, size


def least_source(edges: DataFrame) -> DataFrame:
    """(node, least): the least node that reaches each node of the edges, itself included.

    Labels move along the edges, and a node also takes the label of its label, so that rounds grow with the logarithm of a chain.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    table = Latest()
    label, lower = table.put(nodes.select("node", F.col("node").alias("least"))), 1
    while lower:
        moved = edges.join(label, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("least").alias("in"))
        low = label.join(moved, "node", "left").select("node", F.least("least", F.coalesce("in", "least")).alias("least"), F.col("least").alias("was"))
        far = label.select(F.col("node").alias("least"), F.col("least").alias("far"))
        turn = low.join(far, "least", "left").select("node", F.least("least", F.coalesce("far", "least")).alias("least"), "was")
        label, lower = table.put_count(turn, F.col("least") < F.col("was"))
        label = label.select("node", "least")
    return label


def _turns(edges: DataFrame) -> Iterator[tuple[DataFrame, int]]:
    """Components, some each turn: (node, scc) and the number of nodes that are not their own component's least.

    The nodes that one node is the least to reach form a class; those of them that reach it inside the class are its component.  Nodes of one
    component agree in the least node that reaches them and in the least that they reach inside the class, so other edges go.
    """
    e, size = trim(edges)
    while size:
        ahead = least_source(e)
        inside = cut(e.join(ahead.toDF("src", "c1"), "src").join(ahead.toDF("dst", "c2"), "dst").where("c1 = c2").select("src", "dst"))
        back = least_source(reverse(inside))
        seen = Latest()
        yield seen.put_count(ahead.join(back.toDF("node", "scc"), "node").where("least = scc").select("node", "scc"), F.col("node") != F.col("scc"))
        alike = inside.join(back.toDF("src", "c1"), "src").join(back.toDF("dst", "c2"), "dst").where("c1 = c2")
        rest = alike.join(ahead.toDF("src", "first"), "src").where("first <> c1")  # where both agree the component is named
        e, size = trim(rest.select("src", "dst"))


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, scc): strongly connected components named by their least node.

    Edges outside any cycle are trimmed first; the others go by classes, see `_turns`.
    """
    all_ = nodes.select("node").distinct()
    e = edges.select("src", "dst").where("src <> dst").distinct()
    e = e.join(all_.withColumnRenamed("node", "src"), "src", "left_semi").join(all_.withColumnRenamed("node", "dst"), "dst", "left_semi")
    found = reduce(DataFrame.union, [named for named, _ in _turns(e)] or [all_.select("node", F.col("node").alias("scc")).limit(0)])
    return all_.join(found, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))


def recursive_nodes(edges: DataFrame, components: DataFrame) -> DataFrame:
    """Nodes in a component of two or more, or with an edge to themselves."""
    big = components.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1").select("scc")
    loops = edges.where("src = dst").select(F.col("src").alias("node"))
    return components.join(big, "scc", "left_semi").select("node").union(loops).distinct()


def chain_ends(hops: DataFrame) -> DataFrame:
    """(node, end, far): where hops(node, end, far) lead, one a node and without cycles, when each is followed as far as it goes.

    Every hop takes over the hop of its end, so that rounds grow with the logarithm of the longest chain.
    """
    table = Latest()
    hops, moved = table.put(hops.select("node", "end", "far")), 1
    while moved:
        then = hops.toDF("end", "end2", "far2")
        ahead = hops.join(then, "end", "left").select("node", F.coalesce("end2", "end").alias("end"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), "end2")
        hops, moved = table.put_count(ahead, F.col("end2").isNotNull())
        hops = hops.select("node", "end", "far")
    return hops


def longest_ways(edges: DataFrame) -> DataFrame:
    """(node, level): the greatest weight of a way from each node of edges(src, dst, weight), which have no cycle; 0 where no edge leaves.

    Nodes with one successor are taken out, their chains followed by doubling; what is left has fewer branches, more of which then lead to one
    end, and so on while that takes out a quarter of the branching nodes.  Only the rest goes step by step, and only with levels that rise.
    """
    from factloom.operators.lattice import Lattice, fixpoint, only

    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    e, passes, before = cut(edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))), [], None
    while True:
        single = F.col("n") == 1
        ways = cut(e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("end"), F.max("weight").alias("far")))
        ones, more = ways.agg(F.count_if(single), F.count_if(~single)).head()
        if not ones or (before is not None and 4 * ones < before):
            break
        passes.append(chain_ends(ways.where(single)))
        ends, branching = passes[-1].toDF("dst", "end", "far"), ways.where(~single).select(F.col("node").alias("src"))
        led = e.join(branching, "src", "left_semi").join(ends, "dst", "left")
        led = led.select("src", F.coalesce("end", "dst").alias("dst"), (F.col("weight") + F.coalesce("far", F.lit(0))).alias("weight"))
        e, before = cut(led.groupBy("src", "dst").agg(F.max("weight").alias("weight"))), more
    left = reduce(lambda n, hops: n.join(hops, "node", "left_anti"), passes, nodes)
    start = left.join(e.select(F.col("src").alias("node")), "node", "left_anti").select("node", F.lit(0).cast("long").alias("level"))
    rise = lambda f: f.join(e, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), (F.col("level") + F.col("weight")).alias("level"))
    level = cut(fixpoint(start, rise, Lattice((("level", only(F.max)),)), "node"))
    for hops in reversed(passes):
        level = cut(level.union(hops.join(level.toDF("end", "level"), "end").select("node", F.col("level") + F.col("far"))))
    return level


def bottom_up_levels(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(scc, level): 0 for components that call no other, else one more than the highest they call."""
    c = components
    between = edges.join(c.toDF("src", "a"), "src").join(c.toDF("dst", "b"), "dst").where("a <> b").select("a", "b").distinct()
    level = longest_ways(between.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).cast("long").alias("weight")))
    return c.select("scc").distinct().join(level.toDF("scc", "level"), "scc", "left").select("scc", F.coalesce("level", F.lit(0)).cast("int").alias("level"))


def has_cycle(edges: DataFrame) -> DataFrame:
    """One row: whether a node reaches itself.  Ends with the first component of two or more."""
    loops = edges.where("src = dst").select("src")
    ring = any(others for _, others in _turns(edges.where("src <> dst")))
    return loops.agg(((F.count("*") > 0) | F.lit(ring)).alias("has_cycle"))


def guard_propagates(flow: DataFrame, source, target, strict: bool = True) -> DataFrame:
    """One row: a direct edge that preserves guards, or a path; strict paths must preserve guards throughout."""
    edges = flow.where("preserves") if strict else flow
    there = reachable(edges, flow.sparkSession.createDataFrame([(source,)], ["node"])).where(F.col("node") == target)
    return there.agg((F.count("*") > 0).alias("propagates"))
