"""Lattices, dominators, loops, refinement on edges and widening against brute force on graphs with cycles."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import dataflow, lattice


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def graph(spark, edges, entries=(0,), func=lambda b: 0):
    nodes = sorted({n for e in edges for n in e} | set(entries))
    blocks = spark.createDataFrame([(func(n), n, n in entries) for n in nodes], "func long, block long, is_entry boolean")
    return blocks, spark.createDataFrame(list(edges), "src long, dst long")


def reach(edges, seeds, without=None):
    seen, todo = set(), [s for s in seeds if s != without]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo += [d for s, d in edges if s == n and d != without]
    return seen


def dominated(edges, entries=(0,)):
    live = reach(edges, entries)
    return {b: {d for d in live if b not in reach(edges, entries, d)} for b in live}


NESTED = [(0, 1), (1, 2), (2, 3), (3, 2), (3, 4), (4, 1), (4, 5)]
SHARED = [(0, 1), (1, 2), (2, 1), (1, 3), (3, 1), (3, 4), (4, 4)]
TWO_ENTRIES = [(0, 1), (0, 2), (1, 2), (2, 1), (1, 3), (9, 3)]


def random_graph(seed, n=40):
    rnd = random.Random(seed)
    edges = {(i, i + 1) for i in range(n - 1) if rnd.random() < 0.9} | {(rnd.randrange(n), rnd.randrange(n)) for _ in range(n // 2)}
    return [(a, b) for a, b in edges if b != 0]


def test_dominators_and_loops(spark):
    """Nested loops, loops of one header, a loop with two entries, and others, each as a function of its own."""
    graphs = [NESTED, SHARED, TWO_ENTRIES, random_graph(1), random_graph(2)]
    edges = [(a + 100 * f, b + 100 * f) for f, es in enumerate(graphs) for a, b in es]
    entries = [100 * f for f in range(len(graphs))]
    blocks, succ = graph(spark, edges, entries, lambda b: b // 100)
    found = dataflow.Dominators(blocks, succ)
    dom = dominated(edges, entries)
    idom = {b: max(ds - {b}, key=lambda d: len(dom[d]), default=None) for b, ds in dom.items()}
    assert rows(found.immediate()) == sorted(((b, idom[b], len(ds)) for b, ds in dom.items()), key=repr)
    back = {(s, d) for s, d in edges if s in dom and d in dom[s]}
    assert rows(found.back_edges()) == sorted(back, key=repr)
    want = []
    for h in {d for _, d in back}:
        body = {h} | {s for s, d in back if d == h}
        while more := {s for s, d in edges if d in body - {h}} - body:
            body |= more
        sources = {s for s, d in back if d == h}
        modified = {f"v{b % 5}" for b in sources if b % 2} or {f"v{b % 5}" for b in body if b % 2}
        want.append((h, len(sources), len(body), sorted(modified), [f"c{h % 3}"]))
    nodes = blocks.select("block")
    stores = nodes.where("block % 2 = 1").select("block", F.concat(F.lit("v"), (F.col("block") % 5).cast("string")).alias("var"))
    compares = nodes.select("block", F.concat(F.lit("c"), (F.col("block") % 3).cast("string")).alias("var"))
    assert rows(dataflow.loops(found, stores, compares)) == sorted(want, key=repr)


def test_functions_of_more_than_64_blocks_beside_each_other(spark):
    one = [(i, i + 1 + i % 13) for i in range(150)] + [(i, i + 1) for i in range(0, 150, 7)] + [(140, 70)]
    edges = one + [(s + 1000, d + 1000) for s, d in SHARED]
    found = dataflow.Dominators(*graph(spark, edges, (0, 1000), lambda b: b // 1000))
    dom = dominated(edges, (0, 1000))
    assert {r.block: r.depth for r in found.immediate().collect()} == {b: len(d) for b, d in dom.items()}


def test_guards_as_bits_agree_with_guards_as_rows(spark):
    rnd = random.Random(4)
    edges = random_graph(3)
    blocks, succ = graph(spark, edges)
    gen = spark.createDataFrame([(rnd.randrange(40), f"g{rnd.randrange(80)}") for _ in range(160)], "block long, guard string")
    assert rows(dataflow.must_guards(blocks, succ, gen)) == rows(dataflow.must_guards(blocks.drop("func"), succ, gen))


@pytest.mark.parametrize("which", [lattice.SOME, lattice.EVERY, lattice.INTERVAL, lattice.ROWS])
def test_laws_of_lattices(spark, which):
    """Joins do not depend on order or repeats, or on being made in steps, and grow."""
    rnd = random.Random(7)
    value = lambda c: rnd.choice([None, 1, 2, 5]) if c in ("lo", "hi") else rnd.randrange(16)
    data = [(k % 7, k, *(value(c) for c in which.columns)) for k in range(60)]
    types = "key long, part long" + "".join(f", {c} long" for c in which.columns)
    df = spark.createDataFrame(data, types)
    once = rows(which.joined(df, "key"))
    assert once == rows(which.joined(df.union(df).repartition(5), "key"))
    assert once == rows(which.joined(which.joined(df.withColumn("part", F.col("part") % 3), "key", "part"), "key"))
    again = which.joined(df, "key")
    assert rows(which.joined(again.union(df.select(*again.columns)), "key")) == once


def loop(spark, bound, start=0, step=1, back=True):
    """i := start; while i < bound: i += step.  Blocks: 0 sets, 1 tests, 2 counts, 3 is behind the loop."""
    edges = [(0, 1), (1, 2), (1, 3)] + ([(2, 1)] if back else [])
    blocks, succ = graph(spark, edges)
    init = spark.createDataFrame([(0, "i", start, start)], "block long, var string, lo long, hi long")
    add = spark.createDataFrame([(2, "i", step)], "block long, var string, delta long")
    tests = spark.createDataFrame([(1, 2, "i", None, bound - 1), (1, 3, "i", bound, None)] if bound is not None else [], "src long, dst long, var string, lo long, hi long")
    return blocks, succ, init, add, tests


def test_a_counter_ends_at_its_guard(spark):
    blocks, succ, init, add, tests = loop(spark, 1_000_000)
    headers = dataflow.changed_in_loops(dataflow.Dominators(blocks, succ), add)
    assert rows(dataflow.bounds(blocks, succ, init, add, 2, tests, headers, narrow=3)) == [(1, "i", 0, 1_000_000), (2, "i", 0, 999_999), (3, "i", 1_000_000, 1_000_000)]
    assert rows(dataflow.bounds(blocks, succ, init, add, 2, tests, headers, thresholds=(10, 2_000_000))) == [(1, "i", 0, 2_000_000), (2, "i", 0, 999_999), (3, "i", 1_000_000, 2_000_000)]


def test_growth_without_end_is_cut(spark):
    blocks, succ, init, add, tests = loop(spark, None)
    headers = dataflow.changed_in_loops(dataflow.Dominators(blocks, succ), add)
    assert rows(dataflow.bounds(blocks, succ, init, add, 2, None, headers, narrow=3)) == [(b, "i", 0, None) for b in (1, 2, 3)]
    blocks, succ = graph(spark, TWO_ENTRIES)  # a loop that is entered twice has no header
    add = spark.createDataFrame([(1, "i", -1)], "block long, var string, delta long")
    none = spark.createDataFrame([], "block long, var string")
    got = rows(dataflow.bounds(blocks, succ, init, add, 1, None, none))
    assert got == [(1, "i", None, 0), (2, "i", None, 0), (3, "i", None, -1)]


def test_branches_that_cannot_be_taken_hand_nothing_on(spark):
    blocks, succ, init, add, tests = loop(spark, -5)
    assert rows(dataflow.bounds(blocks, succ, init, add, 4, tests)) == [(1, "i", 0, 0), (3, "i", 0, 0)]


def test_both_branches_of_a_test_differ(spark):
    blocks, succ = graph(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 0)])
    stores = spark.createDataFrame([(3, "y", 1, "int", False)], "block long, var string, offset int, type string, is_none boolean")
    stores = stores.union(spark.createDataFrame([(0, "x", 1, "str", None)], stores.schema))
    tests = spark.createDataFrame([(0, 1, "x", "none", None, True), (0, 2, "x", "none", None, False)], "src long, dst long, var string, test string, name string, holds boolean")
    got = {(r.block, r.var): (r.possible_types, r.is_none) for r in dataflow.type_states(blocks, succ, stores, tests).collect()}
    assert got[1, "x"] == (["str"], True) and got[2, "x"] == (["str"], False) and got[3, "x"] == (["str"], None)
    assert dataflow.type_states(blocks, succ, stores).where("block = 1 and var = 'x'").first().is_none is None


CASES = [
    (("none", None, True), ("int", False), None), (("none", None, False), (None, None), (None, False)), (("type", "int", True), (None, None), ("int", False)),
    (("type", "int", True), ("str", None), None), (("type", "int", False), ("int", None), ("int", True)), (("type", "int", False), ("int", False), None),
    (("type", "int", False), ("str", False), ("str", False)), (("truth", None, True), ("str", True), None), (("truth", None, True), ("str", None), ("str", False)),
    (("truth", None, False), ("str", False), ("str", False)), ((None, None, None), ("str", None), ("str", None)), (("type", "int", True), ("int", True), None),
]


def test_refinement(spark):
    df = spark.createDataFrame([(i, *asked, *value) for i, (asked, value, _) in enumerate(CASES)], "i int, test string, name string, holds boolean, type string, none boolean")
    possible, type_, none = dataflow.refined(*map(F.col, df.columns[1:]))
    assert rows(df.where(possible).select("i", type_, none)) == sorted(((i, *want) for i, (*_, want) in enumerate(CASES) if want), key=repr)


def test_least_sets_of_paths(spark):
    """A diamond in a loop: one arm has a, the other a and b, so the second path is left aside; c comes behind."""
    blocks, succ = graph(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 0), (3, 5)])
    gen = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (4, "c")], "block long, guard string")
    got = {r.block: r.sets for r in dataflow.least_path_sets(blocks, succ, gen).collect()}
    assert got == {0: [[]], 1: [[]], 2: [[]], 3: [["a"]], 4: [["a"]], 5: [["a"]]}
    asked = spark.createDataFrame([("b", ["b"]), ("ab", ["a", "b"]), ("c", ["c"])], "ask string, guards array<string>")
    flags = {(r.block, r.ask): (r.on_all, r.on_any) for r in dataflow.guarded_by_any(blocks, succ, gen, asked).collect()}
    assert flags[5, "b"] == (False, True) and flags[5, "ab"] == (True, True) and flags[5, "c"] == (False, True) and flags[0, "ab"] == (False, True)


def test_labels_of_instructions(spark):
    from factloom.functions.taint import KAPPA_ALL
    from factloom.operators import summaries

    made = spark.createDataFrame([("s", "binary"), ("t", "store_subscript"), ("u", "call"), ("v", "import"), ("w", "build_string"), ("x", "binary")], "value string, op string")
    uses = [("s", "left", "a"), ("s", "right", "b"), ("t", "index", "a"), ("t", "value", "c"), ("u", "callee", "a"), ("u", "argument", "s"), ("v", "name", "a"), ("w", "part", "u"), ("w", "part", "x"), ("x", "left", "w"), ("x", "right", "c")]
    known = spark.createDataFrame([("a", 1, KAPPA_ALL - 1, 0), ("b", 2, KAPPA_ALL - 2, 4)], "value string, tau long, kappa long, sigma long")
    got = rows(summaries.transferred(made, spark.createDataFrame(uses, "value string, role string, of string"), known))
    both = (3, KAPPA_ALL - 3, 4)
    assert got == [("s", *both), ("t", 0, KAPPA_ALL, 0), ("u", *both), ("v", 0, KAPPA_ALL, 0), ("w", *both), ("x", *both)]


def test_a_step_of_types_is_one_join(spark, monkeypatch, capsys):
    """Stores, edges and tests of a block are one row, so what a round moves is shuffled once a step."""
    from factloom.storage import cut

    plans = []

    def looked_at(start, step, *rest, **more):
        capsys.readouterr()
        step(cut(start)).explain()
        plans.append(capsys.readouterr().out)
        return start

    monkeypatch.setattr(dataflow, "fixpoint", looked_at)
    blocks, succ = spark.createDataFrame([(0, True), (1, False)], "block int, is_entry boolean"), spark.createDataFrame([(0, 1)], "src int, dst int")
    stores = spark.createDataFrame([(0, "x", 1, "t", False)], "block int, var string, offset int, type string, is_none boolean")
    tests = spark.createDataFrame([(0, 1, "x", "none", "t", False)], "src int, dst int, var string, test string, name string, holds boolean")
    dataflow.type_states(blocks, succ, stores, tests)
    assert [p.count("Join") for p in plans] == [1]
