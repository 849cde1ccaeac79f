"""Graph and dataflow queries against brute force, on tables of more than one module, function or chain."""

import pytest

from factloom.plans import catalog, registry  # noqa: F401


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Two modules of 200 parts and a half, and lines on them."""
    where = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(SIZES.items()), "p_partkey long, p_size long").coalesce(1).write.parquet(f"{where}/part.parquet")
    spark.createDataFrame(LINES, "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string").coalesce(1).write.parquet(f"{where}/lineitem.parquet")
    return where


SIZES = {k: (k * k + k // 7) % 50 + 1 for k in range(500)}
#: (order, part, supplier, flag)
LINES = [(i // 3, i * 37 % 500, i % 5, "RNA"[i // 5 % 3]) for i in range(1500)]


def reached(out):
    """{node: what it reaches by one edge or more}."""
    found = {}
    for k in out:
        seen, todo = set(), list(out[k])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += out.get(n, ())
        found[k] = seen
    return found


def test_graphs_hold_every_part(spark, sf):
    out = {k: [k - k % 200 + (k * 3 + s) % 200] for k, s in SIZES.items()}
    far = reached(out)
    run = lambda name: rows(registry.QUERIES[name](spark, sf).select(*cols))
    cols = ["src", "dst"]
    assert run("closure") == sorted((a, b) for a in far for b in far[a])
    nodes = {*out, *(d for ds in out.values() for d in ds)}
    scc = {n: min([n, *(m for m in far.get(n, ()) if n in far.get(m, ()))]) for n in nodes}
    cols = ["node", "scc"]
    assert run("scc_labels") == sorted(scc.items())
    cols = ["node"]
    assert run("recursive_functions") == sorted((n,) for n in far if n in far[n])

    def level(c):
        return max((1 + level(scc[d]) for n in nodes if scc[n] == c for d in out.get(n, ()) if scc[d] != c), default=0)

    cols = ["scc", "level"]
    assert run("bottom_up_levels") == sorted((c, level(c)) for c in set(scc.values()))


def test_edges_hold_every_part(spark, sf):
    from factloom.plans import facts

    assert rows(facts.part_edges(spark, sf).select("src")) == [(k,) for k in range(500)]


# dataflow: functions of 60 blocks, three numbers left for exits

ID = {k: k + k // 60 * 3 for k in SIZES}
SUCC = {(ID[k], ID[k] + d) for k, s in SIZES.items() for d in (1, 1 + s % 3)} | {(ID[k], ID[k] - 1 - s % 6) for k, s in SIZES.items() if k % 60 >= 8 and s % 7 == 0}
GEN = {ID[k]: {f"g{s % 5}"} for k, s in SIZES.items() if s % 2 == 0}


def states(kinds):
    """{block: sets of guards gathered on some path from its function's entry}."""
    seen = todo = {(ID[k], frozenset()) for k in SIZES if k % 60 == 0}
    while todo:
        todo = {(d, g | (GEN.get(b, set()) & kinds)) for b, g in todo for s, d in SUCC if s == b} - seen
        seen = seen | todo
    out = {}
    for b, g in seen:
        out.setdefault(b, []).append(g)
    return out


def test_guards_of_every_function(spark, sf):
    kinds = set().union(*GEN.values())
    entries = {ID[k] for k in SIZES if k % 60 == 0}
    want = sorted((b, g) for b, gs in states(kinds).items() if b not in entries for g in frozenset.intersection(*gs))
    assert rows(registry.QUERIES["must_guards"](spark, sf)) == want
    want = sorted((b, all("g0" in g for g in gs), any("g0" in g for g in gs)) for b, gs in states({"g0", "g2"}).items())
    assert rows(registry.QUERIES["guarded_on_paths"](spark, sf)) == want


def test_truncated_states_are_not_answered(spark):
    from factloom.operators import dataflow

    blocks = spark.createDataFrame([(i, i == 0) for i in range(4)], "block int, is_entry boolean")
    succ = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src int, dst int")
    gen = spark.createDataFrame([(2, "g")], "block int, guard string")
    with pytest.raises(Exception, match="truncated"):
        dataflow.guarded_on_paths(dataflow.path_states(blocks, succ, gen, 1), "g").collect()
    got = rows(dataflow.guarded_on_paths(dataflow.path_states(blocks, succ, gen, None), "g"))
    assert got == [(0, False, False), (1, False, False), (2, False, False), (3, True, True)]


def test_definitions_and_loops_of_every_function(spark, sf):
    var = {ID[k]: f"v{s % 4}" for k, s in SIZES.items()}
    seen = todo = {(d, var[s], s) for s, d in SUCC}
    while todo:
        todo = {(d, v, at) for b, v, at in todo if var.get(b) != v for s, d in SUCC if s == b} - seen
        seen = seen | todo
    assert rows(registry.QUERIES["reaching_defs"](spark, sf).select("block", "var", "def_block")) == sorted(seen)
    back = {(ID[k] - s % 9, ID[k]) for k, s in SIZES.items() if k % 60 >= 10 and s % 4 == 0}
    seen = todo = back | {(h, h) for h, _ in back}
    while todo:
        todo = {(h, s) for h, b in todo if b != h for s, d in SUCC if d == b} - seen
        seen = seen | todo
    assert rows(registry.QUERIES["natural_loops"](spark, sf).select("header", "block")) == sorted(seen)


def test_predicates_and_summaries_of_every_part(spark, sf):
    held = {k for k, s in SIZES.items() if s % 10}
    while lost := {k for k in held if k - k % 60 + (k * 3 + SIZES[k]) % 60 not in held}:
        held -= lost
    assert rows(registry.QUERIES["houdini"](spark, sf)) == sorted((k,) for k in held)
    callee = {k: k - k % 120 + (k * 3 + s) % 120 for k, s in SIZES.items()}
    flows = {(k, k % 3, -1 if s % 3 == 0 else s % 7) for k, s in SIZES.items() if s % 2 == 0}
    size = 0
    while len(flows) > size:
        size = len(flows)
        flows |= {(k, s % 3, t) for k, s in SIZES.items() for f, a, t in flows if f == callee[k] and a == k % 3 and (t != -1 or k % 2 == 0)}
    assert rows(registry.QUERIES["taint_summaries"](spark, sf)) == sorted(flows)
    live = todo = {k for k, s in SIZES.items() if s <= 5}
    while todo:
        todo = {callee[k] for k in todo} - live
        live = live | {k for k in todo}
        todo &= set(SIZES)
    bugs = {(o, p, t) for o, p, a, r in LINES if r == "R" and p in live for f, x, t in flows if f == p and x == a % 3 and t != -1}
    assert any(p % 120 >= 60 for _, p, _ in bugs) and any(p >= 120 for _, p, _ in bugs)
    assert rows(registry.QUERIES["security_bugs"](spark, sf)) == sorted(bugs)


def test_late_accesses_and_orders_count(spark, tmp_path):
    """A lock broken, and taken the other way round, only in rows behind the prefixes of the SQL."""
    events = [(i, 3, "purchase") for i in (0, 2, 5000, 5001)] + [(i, 4, "view") for i in (1, 5002, 5003)] + [(6000, 6, "purchase"), (6001, 6, "purchase"), (7000, 4, "purchase"), (7007, 4, "view")]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    lines = [(1, 1, 5), (1, 2, 6), (900, 1, 6), (900, 2, 5), (1, 3, 7)]
    spark.createDataFrame([(o, n, 0, s) for o, n, s in lines], "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: rows(registry.QUERIES[name](spark, str(tmp_path)))
    assert run("unlocked_locations") == [(4,)]
    acc = [(e, e % 5, t == "purchase") for e, u, t in events if u == 4]
    pairs = [tuple(sorted((x[1], y[1]))) for i, x in enumerate(acc) for y in acc[i + 1 :] if x[1] != y[1] and (x[2] or y[2]) and abs(x[0] - y[0]) != 7]
    assert run("race_candidates") == sorted((4, *p, pairs.count(p)) for p in set(pairs))
    assert run("lock_order_violations") == [(5, 6)]
