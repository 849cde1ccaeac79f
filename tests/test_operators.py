"""Analysis operators on small literal tables."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import intervals as iv
from factloom.functions import pynum, scoring, sets, taint
from factloom.operators import baseline, concurrency, contracts, dataflow, findings, graph, history, invariants, matching, metrics, records

FIND = "seq long, bug_type string, crash_location string, crash_function string, confidence double, call_chain array<string>, tainted_sources array<string>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def find(spark, data):
    return spark.createDataFrame(data, FIND)


# findings


def test_three_findings_of_one_place_become_one(spark):
    d = findings.deduplicate(find(spark, [(0, "SSRF", "a:1", None, 0.9, ["f"], ["x"]), (1, "SSRF", "a:1", None, 0.85, ["g"], ["y", "x"]), (2, "SSRF", "a:1", None, 0.95, ["f"], [])])).collect()
    assert len(d) == 1
    r = d[0]
    assert (r.seq, r.confidence, r.occurrences, r.min_confidence) == (2, 0.95, 3, 0.85)
    assert abs(r.mean_confidence - 0.9) < 1e-12 and r.example_call_chains == [["f"], ["g"]] and r.all_tainted_sources == ["x", "y"]


def test_places_types_ties_and_missing_keys(spark):
    d = findings.deduplicate(find(spark, [(0, None, None, None, None, None, None), (1, "A", None, "fn", 0.5, [], None), (2, "A", "fn", None, 0.5, ["c"], ["s"]), (3, "B", "fn", None, 0.1, None, None)]))
    got = {(r.bug_type, r.location): (r.seq, r.occurrences, r.confidence) for r in d.collect()}
    assert got == {("UNKNOWN", "unknown"): (0, 1, 0.0), ("A", "fn"): (1, 2, 0.5), ("B", "fn"): (3, 1, 0.1)}
    assert findings.deduplicate(find(spark, [])).count() == 0


def test_only_five_chains_are_kept(spark):
    d = findings.deduplicate(find(spark, [(i, "A", "l", None, 0.1, [f"c{i % 7}"], []) for i in range(14)])).first()
    assert d.example_call_chains == [[f"c{i}"] for i in range(5)]


def test_variants_filter_and_retained_ratio(spark):
    f = find(spark, [(0, "FULL_SSRF", "a", None, 0.4, [], []), (1, "SSRF", "a", None, None, [], []), (2, "TARSLIP", "b", None, 0.5, [], [])])
    got = {r.seq: (r.bug_type, r.original_bug_type) for r in findings.consolidate_variants(f).collect()}
    assert got == {0: ("SSRF", "FULL_SSRF"), 1: ("SSRF", None), 2: ("PATH_INJECTION", "TARSLIP")}
    assert [r.seq for r in findings.filter_by_confidence(f, 0.5).collect()] == [2]
    m = findings.scan_metadata(f).first()
    assert (m.original_count, m.deduplicated_count) == (3, 2) and abs(m.retained_ratio - 2 / 3) < 1e-12
    assert findings.scan_metadata(find(spark, [])).first().retained_ratio == 0.0


# baseline


def test_baseline_last_result_wins_and_accept_replaces(spark):
    cur = spark.createDataFrame([(0, "R", "q", "u", "old"), (1, "R", "q", "u", "new"), (2, None, None, "v", "x")], "seq long, rule string, qualname string, uri string, message string")
    base = spark.createDataFrame([("R::q::u",), ("gone::a::b",)], "fp string")
    assert [r.fp for r in baseline.new_results(cur, base).collect()] == ["unknown::::v"]
    assert [r.fp for r in baseline.fixed_fingerprints(cur, base).collect()] == ["gone::a::b"]
    assert {r.fp: r.message for r in baseline.accept(cur).collect()} == {"R::q::u": "new", "unknown::::v": "x"}
    assert [r.fp for r in baseline.prune(cur, base).collect()] == ["R::q::u"]
    assert baseline.new_results(cur.limit(0), base.limit(0)).count() == 0


def test_set_compare_takes_nulls_as_equal(spark):
    a = spark.createDataFrame([("A", None), ("B", "f"), ("B", "f")], "t string, f string")
    b = spark.createDataFrame([("A", None), ("C", "g")], "t string, f string")
    assert tuple(baseline.set_compare(a, b, ["t", "f"]).first()) == (1, 1, 1)


# matching

HIT = "file string, line int, bug_type string"


def test_exact_and_loose_matches(spark):
    a = spark.createDataFrame([("f", 10, "X"), ("f", 20, "X"), ("f", 31, "CLEARTEXT_LOGGING"), ("g", 10, "X")], HIT)
    b = spark.createDataFrame([("f", 10, "X"), ("f", 23, "X"), ("f", 18, "X"), ("f", 30, "LOG_INJECTION"), ("g", 14, "X")], HIT)
    assert rows(matching.exact_match(a, b)) == [("f", 10, "X")]
    assert rows(matching.loose_match(a, b)) == [("f", 20, "X", 18, "X"), ("f", 31, "CLEARTEXT_LOGGING", 30, "LOG_INJECTION")]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("fg"), st.integers(0, 40), st.sampled_from("XY")), min_size=1, max_size=15), st.lists(st.tuples(st.sampled_from("fg"), st.integers(0, 40), st.sampled_from("XY")), min_size=1, max_size=15))
def test_loose_match_is_the_smallest_near_line(spark, a, b):
    a, b = set(a), set(b)
    la, lb = a - b, b - a
    want = sorted((f, x, t, min(y for g, y, u in lb if g == f and u == t and abs(x - y) <= 3)) for f, x, t in la if any(g == f and u == t and abs(x - y) <= 3 for g, y, u in lb))
    got = matching.loose_match(spark.createDataFrame(list(a), HIT), spark.createDataFrame(list(b), HIT)).select("file", "line", "bug_type", "right_line")
    assert rows(got) == sorted(want, key=repr)


def test_near_lines(spark):
    f = spark.createDataFrame([("a", 5, "X"), ("a", 9, "X"), ("b", 5, "X")], HIT)
    c = spark.createDataFrame([("a", 8), ("a", 2)], "file string, line int")
    assert rows(matching.near_lines(f, c).select("file", "line")) == [("a", 5), ("a", 9)]
    assert matching.near_lines(f, c.limit(0)).count() == 0


def test_differential_classes(spark):
    cases = spark.createDataFrame([(1, False), (2, False), (3, False), (4, False), (5, True)], "case_id int, any_error boolean")
    buggy = spark.createDataFrame([(1, "X"), (2, "X"), (5, "X")], "case_id int, bug_type string")
    fixed = spark.createDataFrame([(2, "X"), (3, "Y")], "case_id int, bug_type string")
    got = {r.case_id: r.classification for r in matching.classify_near(buggy, fixed, cases).collect()}
    assert got == {1: "TRUE_POSITIVE", 2: "BOTH_BUG", 3: "FALSE_POSITIVE", 4: "FALSE_NEGATIVE", 5: "ERROR"}


def test_signature_classes_and_error_policy(spark):
    s = spark.createDataFrame(
        [(1, "buggy", "BUG", "X", 1), (1, "fixed", "SAFE", None, None), (2, "buggy", "BUG", "X", 1), (2, "fixed", "BUG", "X", 1), (3, "buggy", "BUG", "X", 1), (3, "buggy", "BUG", "X", 2), (3, "fixed", "BUG", "X", 1), (4, "buggy", "ERROR", None, None), (4, "buggy", "BUG", "X", 1), (4, "fixed", "SAFE", None, None), (5, "buggy", "ERROR", None, None)],
        "case_id int, side string, verdict string, bug_type string, line int",
    )
    strict = {r.case_id: r.classification for r in matching.classify_signatures(s).collect()}
    assert strict == {1: "TRUE_POSITIVE", 2: "BOTH_BUG", 3: "TRUE_POSITIVE", 4: "TRUE_POSITIVE", 5: "ERROR"}
    assert {r.case_id: r.classification for r in matching.classify_signatures(s, "any").collect()}[4] == "ERROR"


def test_calls_resolve_by_name_suffix_and_class(spark):
    f = spark.createDataFrame([("p.m.f",), ("q.m.f",), ("p.only",), ("p.C.run",), ("p.C.go",)], "qname string")
    e = spark.createDataFrame([("s", "p.m.f"), ("s", "m.f"), ("s", "only"), ("s", "f"), ("s", "x.only"), ("p.C.run", "self.go"), ("p.C.run", "self.no")], "src string, name string")
    got = {r.name: r.target for r in matching.resolve_calls(e, f).collect()}
    assert (got["p.m.f"], got["m.f"], got["only"], got["f"], got["x.only"]) == ("p.m.f", "p.m.f", "p.only", None, None)
    assert {r.name: r.target for r in matching.resolve_self_calls(e, f).collect()} == {"self.go": "p.C.go", "self.no": None}


# metrics


def test_rates_with_zero_denominators(spark):
    v = spark.createDataFrame([("t", "BUG", "BUG"), ("t", "BUG", "UNKNOWN"), ("t", "SAFE", "BUG"), ("t", "SAFE", "ERROR"), ("u", "BUG", "UNKNOWN")], "tool string, expected string, predicted string")
    got = {r.tool: r for r in metrics.confusion(v, "tool").collect()}
    t, u = got["t"], got["u"]
    assert (t.tp, t.fp, t.unknown_on_bug, t.errors, t.precision, t.recall_strict, t.recall_lenient, t.accuracy, t.decided_accuracy) == (1, 1, 1, 1, 0.5, 0.5, 1.0, 0.25, 0.5)
    assert (u.precision, u.f1_strict, u.unknown_rate) == (0.0, 0.0, 1.0)


# history


def test_events_and_lifetimes_run_forward_in_time(spark):
    s = spark.createDataFrame([("f", 1, "SAFE", []), ("f", 2, "BUG", ["A"]), ("f", 3, "BUG", ["A", "B"]), ("f", 4, "SAFE", []), ("f", 5, "BUG", ["A"])], "file string, seq int, verdict string, bug_types array<string>")
    e = history.file_events(s)
    assert [r.event for r in e.orderBy("seq").collect()] == ["CLEAN", "BUG_INTRODUCED", "PERSISTS", "BUG_FIXED", "BUG_INTRODUCED"]
    assert rows(history.lifetimes(e)) == sorted([("f", "A", 2, 4), ("f", "B", 3, 4), ("f", "A", 5, None)], key=repr)


def test_a_fix_without_introduction(spark):
    e = spark.createDataFrame([("f", 1, "BUG_FIXED", [], ["A"])], "file string, seq int, event string, new_types array<string>, fixed_types array<string>")
    assert rows(history.lifetimes(e)) == [("f", "A", None, 1)]


# graphs


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src int, dst int")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node int")


def test_reach_components_levels_cycles(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 2), (3, 4), (5, 5), (6, 1), (7, 8)])
    n = nodes(spark, range(1, 10))
    assert rows(graph.reachable(e, nodes(spark, [1, 99]), n)) == [(1,), (2,), (3,), (4,)]
    scc = graph.strong_components(e, n)
    assert dict(scc.collect()) == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}
    assert rows(graph.recursive_nodes(e, scc)) == [(2,), (3,), (5,)]
    assert dict(graph.bottom_up_levels(e, scc).collect()) == {1: 2, 2: 1, 4: 0, 5: 0, 6: 3, 7: 1, 8: 0, 9: 0}
    assert graph.has_cycle(e).first()[0] and not graph.has_cycle(edges(spark, [(1, 2), (2, 3), (1, 3)])).first()[0]
    assert rows(graph.callees(e, 3)) == [(2,), (4,)] and rows(graph.callers(e, 2)) == [(1,), (3,)]


def test_components_of_nested_cycles(spark):
    ring = [(i, (i + 1) % 7) for i in range(7)] + [(10, 11), (11, 12), (12, 10), (0, 10)]
    got = dict(graph.strong_components(edges(spark, ring), nodes(spark, [*range(7), 10, 11, 12])).collect())
    assert got == {**{i: 0 for i in range(7)}, 10: 10, 11: 10, 12: 10}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """Chains in any order, one with diamonds, one with a cycle at its end: levels and components."""
    import random

    from factloom import storage

    made, plain = [], storage.scratch
    monkeypatch.setattr(storage, "scratch", lambda *a: made.append(a) or plain(*a))
    n = 5_000
    name = random.Random(7).sample(range(10 * n), n)
    chain = [(name[i], name[i + 1]) for i in range(n - 1)]
    diamonds = [(name[i], name[i + 2]) for i in range(0, n - 2, 2)]
    one = spark.createDataFrame([(a, a) for a in name], "node int, scc int")
    levels = dict(map(tuple, graph.bottom_up_levels(edges(spark, chain + diamonds), one).collect()))
    assert levels == {a: n - 1 - i for i, a in enumerate(name)}
    assert len(made) < 80
    made.clear()
    name = name[:500]
    ring = edges(spark, [*chain[:499], (name[-1], name[-3])])
    got = dict(map(tuple, graph.strong_components(ring, nodes(spark, name)).collect()))
    assert got == {**{a: a for a in name}, **{a: min(name[-3:]) for a in name[-3:]}}
    assert len(made) < 200


def test_levels_against_brute_force(spark):
    import random

    for seed in range(3):
        r = random.Random(seed)
        pairs = sorted({(a, b) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(40 + 40 * seed)) if a > b})
        out = {}
        for a, b in pairs:
            out.setdefault(a, []).append(b)
        level = {}
        for a in range(60):
            level[a] = max((1 + level[b] for b in out.get(a, ())), default=0)
        one = spark.createDataFrame([(a, a) for a in range(60)], "node int, scc int")
        assert dict(map(tuple, graph.bottom_up_levels(edges(spark, pairs), one).collect())) == level


def test_guards_propagate(spark):
    f = spark.createDataFrame([(1, 2, True), (2, 3, False)], "src int, dst int, preserves boolean")
    assert graph.guard_propagates(f, 1, 2).first()[0] and not graph.guard_propagates(f, 1, 3).first()[0] and graph.guard_propagates(f, 1, 3, strict=False).first()[0]


# dataflow


def flow(spark, succ, gen, n):
    return spark.createDataFrame([(i, i == 0) for i in range(n)], "block int, is_entry boolean"), spark.createDataFrame(succ, "src int, dst int"), spark.createDataFrame(gen, "block int, guard string")


def test_guards_hold_on_all_paths_and_in_loops(spark):
    b, s, g = flow(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 3), (4, 5), (8, 5)], [(0, "g"), (1, "h"), (1, "k"), (2, "k")], 9)
    assert rows(dataflow.must_guards(b, s, g)) == sorted([(1, "g"), (2, "g"), (3, "g"), (3, "k"), (4, "g"), (4, "k"), (5, "g"), (5, "k")], key=repr)
    assert (3, "g") not in rows(dataflow.must_guards(b, s, g, compat=True))


def test_definitions_are_killed(spark):
    b, s, _ = flow(spark, [(0, 1), (1, 2), (2, 1)], [(0, "g")], 3)
    d = spark.createDataFrame([("x", 0, 1), ("x", 2, 5), ("y", 0, 2)], "var string, block int, offset int")
    assert rows(dataflow.reaching_definitions(b, s, d).select("block", "var", "def_block")) == sorted([(1, "x", 0), (1, "y", 0), (1, "x", 2), (2, "x", 0), (2, "x", 2), (2, "y", 0)], key=repr)


def test_bounds_widen(spark):
    b, s, _ = flow(spark, [(0, 1), (1, 1), (1, 2)], [(0, "g")], 3)
    init = spark.createDataFrame([(0, "i", 0, 0)], "block int, var string, lo int, hi int")
    add = spark.createDataFrame([(1, "i", 1)], "block int, var string, delta int")
    got = {r.block: (r.lo, r.hi) for r in dataflow.bounds(b, s, init, add, 3).collect()}
    assert got[1] == (0, None) and got[2][1] is None


def test_houdini_and_conjunctions(spark):
    c = spark.createDataFrame([("a",), ("b",), ("c",)], "pred string")
    i = spark.createDataFrame([("a", "b"), ("b", "c")], "pred string, needs string")
    assert dataflow.houdini(c, i, spark.createDataFrame([("c",)], "pred string")).count() == 0
    assert rows(dataflow.houdini(c, i, spark.createDataFrame([("a",)], "pred string"))) == [("b",), ("c",)]
    p = spark.createDataFrame([("p", 1, "positive", True), ("q", 1, "positive", False), ("p", 2, "negative", False), ("q", 2, "negative", True)], "pred string, sample int, kind string, holds boolean")
    assert rows(dataflow.ice_conjunction(p)) == [("p", True)]


def test_ice_verdict_without_predicates(spark):
    both = spark.createDataFrame([("p", 1, "positive", False), ("p", 2, "negative", False)], "pred string, sample int, kind string, holds boolean")
    assert rows(dataflow.ice_conjunction(both)) == [(None, False)]
    assert rows(dataflow.ice_conjunction(both.where("kind = 'positive'"))) == [(None, True)]


def test_ice_query_at_full_size(spark):
    from factloom.plans import catalog, registry  # noqa: F401

    sf = "/root/testdata/sf0.01"
    parts = [(r.p_partkey, r.p_size) for r in registry.load(spark, sf, "part").select("p_partkey", "p_size").collect()]
    fails = lambda p, k, s: s == p or k % 11 != 0 and (60 <= p <= 64 and k % 13 in (0, 12) or p >= 65 and s % 20 == p * 7 % 20)
    failed = {k: {p for p in range(70) if fails(p, k, s)} for k, s in parts}
    kept = set(range(70)) - set().union(*(failed[k] for k in failed if k % 11 == 0))
    while lost := kept & set().union(*(failed[k + 1] for k in failed if k % 13 != 11 and k % 11 != 0 and not failed[k] & kept and k + 1 in failed)):
        kept -= lost
    consistent = all(failed[k] & kept for k in failed if k % 13 == 0 and k % 11 != 0)
    assert 0 < len(kept) < 70
    assert rows(registry.QUERIES["ice_conjunction"](spark, sf)) == sorted((p, consistent) for p in kept)


def test_one_name_of_very_many_functions_and_calls(spark):
    n = 100_000
    known = spark.range(n).selectExpr("concat('pkg.m', id, '.get') as qname")
    calls = spark.range(n).selectExpr("concat('f', id) as src", "concat('m', id, '.get') as name").union(spark.range(n).selectExpr("concat('g', id) as src", "'get' as name"))
    found = matching.resolve_calls(calls, known)
    assert found.where("target = concat('pkg.', name)").count() == n and found.where("target is null").count() == n


def test_type_states(spark):
    t = spark.createDataFrame([(1, ["int"], True, True), (1, ["str"], None, True), (2, ["int"], False, False)], "k int, possible_types array<string>, is_none boolean, initialized boolean")
    assert rows(dataflow.merge_types(t, "k")) == [(1, ["int", "str"], None, True), (2, ["int"], False, False)]


# concurrency

ACC = "id int, location string, thread int, is_write boolean, locks array<string>"


def test_races(spark):
    a = spark.createDataFrame([(1, "x", 1, True, []), (2, "x", 2, False, ["l"]), (3, "y", 1, True, ["l"]), (4, "y", 2, True, ["l"]), (5, "z", 1, True, []), (6, "z", 1, True, [])], ACC)
    none = spark.createDataFrame([], "a int, b int")
    assert rows(concurrency.race_candidates(a, none)) == [("x", 1, 2)]
    assert concurrency.race_candidates(a, spark.createDataFrame([(2, 1)], "a int, b int")).count() == 0


def test_lock_orders_and_deadlock(spark):
    o = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c", "a"]), (3, ["c", "b"])], "thread int, locks array<string>")
    assert rows(concurrency.lock_order_violations(o)) == [("a", "b"), ("b", "c")]
    t = spark.createDataFrame([(1, "blocked"), (2, "blocked")], "thread int, state string")
    w = spark.createDataFrame([(1, 2), (2, 1)], "src int, dst int")
    assert concurrency.all_blocked(t, w).first()[0] and not concurrency.all_blocked(t, w.limit(1)).first()[0]


def test_learned_patterns(spark):
    o = spark.createDataFrame([("a", True)] * 5 + [("b", False)] * 5 + [("c", True)] * 4 + [("d", True), ("d", False)] * 3, "op string, guarded boolean")
    assert {r.op: r.pattern for r in invariants.guard_patterns(o).collect()} == {"a": "always_guarded", "b": "never_guarded"}


# scalars


def one(spark, **cols):
    return spark.range(1).select(*(v.alias(k) for k, v in cols.items())).first()


@settings(max_examples=60, deadline=None)
@given(st.integers(-(10**12), 10**12), st.integers(-1000, 1000))
def test_division_is_pythons(spark, a, b):
    r = one(spark, d=pynum.floor_div(F.lit(a), F.lit(b)), m=pynum.floor_mod(F.lit(a), F.lit(b)))
    assert (r.d, r.m) == ((None, None) if b == 0 else (a // b, a % b))


def test_slices_and_indices_are_pythons(spark):
    for i in range(-5, 6):
        assert one(spark, x=pynum.normalise_index(F.lit(i), F.lit(3))).x == (range(3)[i] if -3 <= i < 3 else None)
    for s, e in ((None, None), (-2, None), (1, -1), (5, 9), (2, 1)):
        r = one(spark, **dict(zip("ab", (c for c in pynum.clip_slice(F.lit(s).cast("int"), F.lit(e).cast("int"), F.lit(4))), strict=True)))
        assert list(range(4))[s:e] == list(range(r.a, max(r.a, r.b)))


ends = st.sampled_from([-3.0, -1.0, 0.0, 2.0, 5.0])


@settings(max_examples=25, deadline=None)
@given(ends, ends, ends, ends)
def test_intervals_hold_all_results(spark, a, b, c, d):
    x, y = (min(a, b), max(a, b)), (min(c, d), max(c, d))
    p, q = tuple(map(F.lit, x)), tuple(map(F.lit, y))
    cols = {}
    for k, f in (("add", iv.add), ("sub", iv.subtract), ("mul", iv.multiply), ("div", iv.divide), ("join", iv.join), ("meet", iv.meet)):
        cols[f"{k}_lo"], cols[f"{k}_hi"] = f(p, q)
    r = one(spark, **cols)
    for u in x:
        for v in y:
            assert r.add_lo <= u + v <= r.add_hi and r.sub_lo <= u - v <= r.sub_hi and r.mul_lo <= u * v <= r.mul_hi
            assert v == 0 or (y == (0.0, 0.0)) or r.div_lo <= u / v + 1e-12 and u / v - 1e-12 <= r.div_hi
            assert r.join_lo <= u <= r.join_hi and r.join_lo <= v <= r.join_hi
    assert (r.meet_lo > r.meet_hi) == (max(x[0], y[0]) > min(x[1], y[1]))
    if y == (0.0, 0.0):
        assert r.div_lo > r.div_hi


label = st.tuples(st.integers(0, 2**16 - 1), st.integers(0, 2**32 - 1), st.integers(0, 2**16 - 1))


@settings(max_examples=25, deadline=None)
@given(label, label, label)
def test_join_laws_of_labels(spark, a, b, c):
    def join(*labels):
        df = spark.createDataFrame([(1, *x) for x in labels], "id int, tau long, kappa long, sigma long")
        return tuple(taint.join_labels(df, "id").first())[1:]

    assert join(a, a) == a and join(a, b) == join(b, a) and join(join(a, b), c) == join(a, join(b, c)) == join(a, b, c)


@pytest.mark.parametrize(("tau", "kappa", "sigma", "sink", "safe"), [(0, 0, 0, 0, True), (1, 0, 0, 0, False), (1, 1, 0, 0, True), (0, 0, 512, 0, True), (0, 0, 512, 18, False), (1, 0, 0, 18, True), (0, 0, 512, 10, False), (1, 0, 0, 10, False), (1, 1 << 10, 1, 10, True), (1, 1 << 31, 512, 31, True), (1, 0, 0, 17, False)])
def test_safety_for_sinks(spark, tau, kappa, sigma, sink, safe):
    v = [F.lit(x).cast("long") for x in (tau, kappa, sigma)]
    assert one(spark, s=taint.is_safe(*v, F.lit(sink))).s is safe


def test_sanitizers_add_sinks(spark):
    r = one(spark, a=taint.sanitize(F.lit(0).cast("long"), F.lit("HTML_ESCAPE")), b=taint.sanitize(F.lit(5).cast("long"), F.lit("none")))
    assert (r.a, r.b) == (1 << 12 | 1 << 15, 5)


def test_scores(spark):
    base = dict(tau=1, kappa=0, sigma=0, sink=0, guarded=False, handler=False, framework=False, chain=1, n_ids=0)
    data = [base, base | {"tau": 0}, base | {"kappa": 1}, base | {"tau": 3, "n_ids": 2, "chain": 9, "guarded": True}]
    got = [r.score for r in scoring.security_score(spark.createDataFrame([tuple(d.values()) for d in data], "tau long, kappa long, sigma long, sink int, guarded boolean, handler boolean, framework boolean, chain int, n_ids int")).collect()]
    assert got == pytest.approx([0.85 * 0.3 + 0.95 * 0.25 + 0.95 * 0.2 + 0.8 * 0.15 + 0.1, 0, 0, 1.0 * 0.3 + 0.5 * 0.25 + 0.95 * 0.2 + 0.4 * 0.15 + 0.4 * 0.1], abs=1e-6)


def test_risk_context_and_intent(spark):
    r = one(spark, a=scoring.risk_upper(F.lit("NOT_ZERO"), F.lit(None).cast("int"), F.lit(None).cast("boolean")), b=scoring.risk_upper(F.lit("NOT_ZERO"), F.lit(4), F.lit(False)), c=scoring.risk_upper(F.lit("NOT_NONE"), F.lit(4), F.lit(False)), d=scoring.risk_upper(F.lit("?"), F.lit(4), F.lit(False)),
            e=scoring.context_multiplier(F.array(F.lit("CLI_TOOL"), F.lit("TEST_FILE"))), f=scoring.context_multiplier(F.array().cast("array<string>")), g=scoring.unintentional(F.array(F.lit(0.5), F.lit(0.2))))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (1 / 19, 1 / 5, 0.05, None, 0.15, 1.0) and abs(r.g - 0.4) < 1e-12


def test_posterior_ignores_bad_ratios(spark):
    s = spark.createDataFrame([(1, 0.75, 0.40), (1, 0.5, 0.0), (2, 0.0, 0.5)], "k int, strength double, inverse double")
    got = dict(scoring.posterior_safe(s, "k").collect())
    assert got[1] == pytest.approx(1.5 * 1.875 / (1 + 1.5 * 1.875), abs=1e-6) and got[2] == pytest.approx(0.6)


def test_set_lattice(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    r = one(spark, j=sets.join(a, b), m=sets.meet(a, b), l=sets.below(a, b), k=sets.below(sets.meet(a, b), a))
    assert (r.j, r.m, r.l, r.k) == (["x", "y", "z"], ["y"], False, True)


# records


def test_chunks_and_slices(spark):
    df = spark.createDataFrame([(i,) for i in range(7)], "seq int")
    assert rows(records.chunks(df, 3)) == [(i, i // 3) for i in range(6)]
    assert rows(records.split_evenly(df, 3)) == [(i, i // 2) for i in range(7)]
    assert records.split_evenly(df, 9).count() == 0
    assert rows(records.batch(df, 1, 5)) == [(5,), (6,)]
    assert [r.is_train for r in records.split_train_test(df, 0.5).orderBy("seq").collect()] == [True] * 3 + [False] * 4
    assert [r.seq for r in records.gather(df, [2, 2, 0, 99]).orderBy("pos").collect()] == [2, 2, 0]


def test_selections(spark):
    df = spark.createDataFrame([(i, i % 3, f"n{i}") for i in range(10)], "a int, b int, c string")
    some = records.Selection(columns=("a", "c"), tests=("a > 1", F.col("b") < 2), order=(F.desc("a"),), rows=2)
    assert [tuple(r) for r in some.of(df).collect()] == [(9, "n9"), (7, "n7")]
    assert records.Selection().of(df).collect() == df.collect()
    assert records.Selection(rows=0).of(df).count() == 10 and records.Selection(rows=3).of(df).count() == 3
    r = one(spark, a=records.where_part(F.lit("x AND y AND z"), -1), b=records.where_part(F.lit("x AND y"), 1), c=records.where_part(F.lit("x"), 4))
    assert (r.a, r.b, r.c) == ("z", "y", None)


def test_shuffles_repeat_and_keep_all(spark):
    df = spark.createDataFrame([(i,) for i in range(200)], "k int")
    first = [r.k for r in records.shuffled(df, 3, "k").collect()]
    assert first == [r.k for r in records.shuffled(df.repartition(5), 3, "k").collect()] and sorted(first) == list(range(200)) and first != sorted(first)
    assert first != [r.k for r in records.shuffled(df, 4, "k").collect()]


def test_places_with_a_frequent_value(spark):
    """A value that most rows have is numbered in parts, and places stay in order."""
    df = spark.createDataFrame([(min(i, 50), i) for i in range(3000)], "seq int, i int")
    got = records._numbered(df, "seq", []).collect()
    assert sorted(r._n for r in got) == list(range(3000)) and [r.seq for r in sorted(got, key=lambda r: r._n)] == [min(i, 50) for i in range(3000)]


def test_valid_and_tidy(spark):
    df = spark.createDataFrame([(" A ", 1), (None, 2)], "name string, n int")
    assert rows(records.process_batch(df, {"name": "string", "n": "int"}, [records.tidy])) == [("a", 1)]
    assert records.process_batch(df, {"name": "int"}).count() == 0


def test_area_and_leaders(spark):
    p = spark.createDataFrame([("m", 0, 0.0, 0.0), ("m", 1, 0.5, 1.0), ("m", 2, 1.0, 1.0), ("n", 0, 0.0, 0.0)], "m string, idx int, fpr double, tpr double")
    assert rows(records.trapezoid(p, ["m"])) == [("m", 0.75), ("n", 0.0)]


# loops, paths, summaries, traces, intent


def test_loops_and_paths(spark):
    s = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 1), (2, 2), (1, 4)], "src int, dst int")
    loops = dataflow.natural_loops(s, spark.createDataFrame([(3, 1), (2, 2)], "src int, header int"))
    assert rows(loops) == sorted([(1, 1), (1, 2), (1, 3), (2, 2)], key=repr)
    b, e, g = flow(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 1)], [(1, "g")], 4)
    states = dataflow.path_states(b, e, g)
    got = {r.block: (r.on_all, r.on_any) for r in dataflow.guarded_on_paths(states, "g").collect()}
    assert got == {0: (False, False), 1: (False, True), 2: (False, False), 3: (False, True)} and not states.first().truncated
    assert dataflow.path_states(b, e, g, rounds=1).first().truncated


def test_summaries_of_recursive_functions(spark):
    from factloom.operators import summaries

    direct = spark.createDataFrame([("leaf", 0, 3), ("id", 0, -1)], "func string, param int, target int")
    passes = spark.createDataFrame([("a", 1, "leaf", 0), ("b", 0, "a", 1), ("a", 1, "b", 0), ("wrap", 0, "id", 0), ("drop", 0, "id", 0)], "func string, param int, callee string, arg int")
    found = summaries.flows(direct, passes, spark.createDataFrame([("wrap", "id")], "func string, callee string"))
    assert rows(found) == sorted([("leaf", 0, 3), ("id", 0, -1), ("a", 1, 3), ("b", 0, 3), ("wrap", 0, -1)], key=repr)
    calls = spark.createDataFrame([(1, "main", "b", 0, True), (2, "main", "b", 0, False), (3, "dead", "b", 0, True), (4, "main", "wrap", 0, True)], "call int, caller string, func string, arg int, tainted boolean")
    assert rows(summaries.security_bugs(spark.createDataFrame([("main",)], "node string"), calls, found)) == [(1, "b", 3)]


def test_traces_and_proofs(spark):
    from factloom.operators import traces

    t = spark.createDataFrame([(1, ["0: LOAD_FAST x", "2 IMPORT_NAME os", "EXCEPTION: KeyError k", "UNHANDLED EXCEPTION: ValueError at 3"]), (2, []), (3, ["nothing", "5:"])], "id int, lines array<string>")
    assert [(r.kind, r.value) for r in traces.trace_features(t).orderBy("id", "pos").collect()] == [("opcode", "LOAD_FAST"), ("import", "os"), ("exception", "EXCEPTION: KeyError k"), ("exception", "UNHANDLED EXCEPTION: ValueError at 3")]
    assert dict(traces.last_exception(t).collect()) == {1: "ValueError", 2: "Unknown", 3: "Unknown"}
    a = spark.createDataFrame([(1, 1, "X", 0.5), (1, 2, "Y", 0.7), (1, 3, "X", 0.9), (2, 1, "X", 0.1)], "bug int, ordinal int, barrier string, confidence double")
    first = traces.first_proof(a)
    assert rows(first) == [(1, "Y", 0.7)]
    assert dict(traces.proof_counts(first, spark.createDataFrame([("X",), ("Y",)], "barrier string")).collect()) == {"X": 0, "Y": 1}
    likely = spark.createDataFrame([("v", "nonzero", 0.9), ("w", "nonnull", 0.94)], "var string, prop string, confidence double")
    bugs = spark.createDataFrame([(1, "DIV_ZERO", "v"), (2, "NULL_PTR", "w"), (3, "OTHER", "v")], "bug int, bug_type string, var string")
    assert rows(traces.statistical_proof(likely, bugs)) == [(1, 0.9)]


def test_intent_and_contexts(spark):
    from factloom.functions import intent

    for path, want in (("tests/a.py", True), ("a/test_b.py", True), ("spec/x.py", True), ("a/latest.py", False), ("contest/b.py", False), ("a/conftest.py", True)):
        assert one(spark, t=intent.is_test_path(F.lit(path))).t is want, path
    got = one(spark, s=intent.signals(F.lit("p/examples/settings.py"), F.lit("NULL_PTR"), F.lit("self[0]"), F.lit("f"))).s
    assert [x.kind for x in got] == ["example", "config", "self"]
    assert one(spark, s=intent.signals(F.lit("a.py"), F.lit("NULL_PTR"), F.lit("self.x"), F.lit("f"))).s == []
    c = one(spark, c=intent.contexts(F.lit("tests/a.py"), F.array(F.lit("sys.argv[1]")), F.array(F.lit("sanitize_path")), F.lit("yaml.safe_load"))).c
    assert c == ["TEST_FILE", "CLI_TOOL", "SAFE_LOADER", "DEFENSE_IN_DEPTH"]
    assert one(spark, g=intent.is_guarded_text(F.lit("x = y or 1"))).g and not one(spark, g=intent.is_guarded_text(F.lit("x = y"))).g


# sources of false positives, scopes, cases, conjunctions


def test_conjunctions_with_implications(spark):
    """The largest set against all subsets, on predicates of small numbers."""
    from itertools import combinations

    preds = {"even": lambda x: x % 2 == 0, "small": lambda x: x < 6, "not3": lambda x: x != 3, "pos": lambda x: x > 0, "not8": lambda x: x != 8}
    positive, negative, implied = [2, 4], [3], [(4, 8), (2, 5)]
    samples = [(x, "positive") for x in positive] + [(x, "negative") for x in negative] + [(x, "state") for x in (8, 5)]
    rows_ = [(n, x, k, f(x)) for n, f in preds.items() for x, k in samples]
    got = dataflow.ice_conjunction(spark.createDataFrame(rows_, "pred string, sample int, kind string, holds boolean"), spark.createDataFrame(implied, "pre int, post int")).collect()
    holds = lambda c, x: all(preds[n](x) for n in c)
    fits = [set(c) for n in range(len(preds) + 1) for c in combinations(preds, n) if all(holds(c, x) for x in positive) and all(holds(c, b) or not holds(c, a) for a, b in implied)]
    assert {r.pred for r in got} == max(fits, key=len) and {r.consistent for r in got} == {True}


def test_cases_need_a_fallback(spark):
    types = "name string, ordinal int, low double, high double, add double, times double"
    known = spark.createDataFrame([("f", 0, None, None, 1.0, 1.0)], types)
    open_ = spark.createDataFrame([("g", 0, 0.0, None, 1.0, 1.0)], types)
    with pytest.raises(Exception, match="no fallback case: g"):
        contracts.register_cases(known, open_).collect()


def test_tiers_and_saved_scans(spark, tmp_path):
    from factloom.operators import scans

    repos = spark.createDataFrame([("a", 1), ("b", 2)], "repo string, tier int")
    assert rows(scans.of_tier(repos, 2)) == [("b", 2)]
    with pytest.raises(ValueError, match="no tier 4"):
        scans.of_tier(repos, 4)
    found = scans.by_repo(spark.createDataFrame([("a", "x", "BUG"), ("a", "y", "SAFE"), ("b", "z", "ERROR")], "repo string, path string, verdict string"))
    scans.save(found, str(tmp_path / "scans"))
    assert sorted(r.repo for r in spark.read.json(str(tmp_path / "scans")).collect()) == ["a", "b"]


def test_kinds_of_sources(spark):
    from factloom.functions import intent

    said = {"sys.argv[1]": "CLI", "ArgumentParser()": "CLI", "os.getenv('x')": "ENV", "d.get('x')": "HTTP", "open(p)": "FILE", "stdin": "USER_INPUT", "elsewhere": None}
    for text, kind in said.items():
        assert one(spark, k=intent.source_type(F.lit(text))).k == kind, text


def test_components_against_reach(spark):
    """Random graphs with chains, loops and separate parts."""
    import random

    rng = random.Random(9)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(75)} | {(i, i + 1) for i in range(100, 140)} | {(140, 120)}
    e = spark.createDataFrame(sorted(edges), "src int, dst int")
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    nodes = {x for p in edges for x in p}

    def far(n):
        seen, todo = set(), [n]
        while todo:
            for d in out.get(todo.pop(), ()):
                if d not in seen:
                    seen.add(d)
                    todo.append(d)
        return seen

    reach = {n: far(n) for n in nodes}
    want = {n: min([n, *(m for m in reach[n] if n in reach[m])]) for n in nodes}
    got = dict(map(tuple, graph.strong_components(e, e.select(F.col("src").alias("node")).union(e.select("dst"))).collect()))
    assert got == want
