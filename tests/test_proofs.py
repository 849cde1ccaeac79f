"""Cascades of proofs, ranking functions and scans that are taken up again."""

import os

import pytest
from pyspark.sql import functions as F

from factloom.operators import proofs, ranking, resume

BUG = "bug int, bug_type string, var string, func string, name string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_first_refinement_decides(spark):
    bugs = spark.createDataFrame([(1, "NULL_PTR", "a", "f", "f"), (2, "NULL_PTR", "param_b", "f", "f"), (3, "DIV_ZERO", "a", "f", "f"), (4, "NULL_PTR", "a", "g", "g")], BUG)
    facts = [("f", 0, "a", "nullable", 0.9), ("f", 1, "a", "nonnull", 0.9), ("f", 2, "b", "nonempty", 0.7), ("f", 3, "a", "nonnegative", 1.0)]
    assert rows(proofs.by_refinement(bugs, spark.createDataFrame(facts, "func string, ordinal int, var string, predicate string, strength double"))) == [(2, 0.7), (3, 0.8)]


def test_order_of_proofs(spark):
    bugs = spark.createDataFrame([(i, "BOUNDS", "v", "f", "f") for i in range(4)], BUG)
    made = lambda *found: spark.createDataFrame(list(found), "bug int, confidence double")
    found = {"interval_analysis": made((0, 0.5), (1, 0.9)), "refinement_types": made((0, 0.8), (1, 0.81)), "stochastic_barriers": made((0, 0.99), (2, 0.71), (3, 0.7))}
    assert rows(proofs.cascade(bugs, found)) == [(0, "interval_analysis", 0.5), (1, "refinement_types", 0.81), (2, "stochastic_barriers", 0.71), (3, "none", 0.0)]


def test_chances(spark):
    bugs = spark.createDataFrame([(1, "DIV_ZERO", "n_rows", "f", "test_it"), (2, "DIV_ZERO", "n_rows", "g", "run"), (3, "OTHER", None, "h", "run")], BUG)
    guards = spark.createDataFrame([("f", "n_rows", "ZERO_CHECK"), ("g", "n_rows", "TYPE_CHECK")], "func string, var string, guard string")
    traits = spark.createDataFrame([("f", True, True, True)], "func string, handles boolean, raises boolean, loops boolean")
    guarded = spark.createDataFrame([("h", "OTHER")], "func string, bug_type string")
    share = {1: 0.95 * 0.3 + 0.7 * 0.2 + 0.9 * 0.25 + 0.65 * 0.15 + 0.8 * 0.1, 2: 0.75 * 0.3 + 0.7 * 0.2 + 0.6 * 0.25 + 0.65 * 0.15 + 0.5 * 0.1, 3: 0.85 * 0.3 + 0.5 * 0.2 + 0.6 * 0.25 + 0.6 * 0.15 + 0.5 * 0.1}
    for bug, chance in rows(proofs.chances(bugs, guards, guarded, traits)):
        assert chance == pytest.approx(share[bug] * 0.7 / (share[bug] * 0.7 + (1 - share[bug]) * 0.3))


def test_measures_of_loops(spark):
    measures = [("one", 0, 10.0, {"i": -1.0}), ("two", 0, 0.0, {"i": 1.0}), ("two", 1, 0.0, {"j": 1.0}), ("up", 0, 0.0, {"i": 1.0}), ("still", 0, 0.0, {"i": 1.0}), ("gone", 0, 0.0, {"k": 1.0}), ("idle", 0, 0.0, {"i": 1.0})]
    turn = lambda loop, id_, a, b: (loop, id_, dict(zip("ij", a, strict=True)), dict(zip("ij", b, strict=True)))
    turns = [turn("one", 1, (0.0, 0.0), (1.0, 0.0)), turn("one", 2, (11.0, 0.0), (12.0, 0.0)), turn("two", 1, (3.0, 1.0), (2.0, 9.0)), turn("two", 2, (2.0, 9.0), (2.0, 8.0)), turn("up", 7, (1.0, 0.0), (2.0, 0.0)), turn("still", 4, (1.0, 0.0), (1.0, 0.0)), turn("gone", 5, (1.0, 1.0), (0.0, 0.0))]
    states = "loop string, id int, before map<string, double>, after map<string, double>"
    got = ranking.verdicts(spark.createDataFrame(measures, "loop string, level int, constant double, weights map<string, double>"), spark.createDataFrame(turns, states))
    assert {r.loop: (r.terminates, r.bounded, r.decreasing, r.unbounded_at, r.not_decreasing_at) for r in got.collect()} == {
        "one": (False, False, True, 2, None), "two": (True, True, True, None, None), "up": (False, True, False, None, 7), "still": (False, True, False, None, 4), "gone": (False, False, False, 5, 5), "idle": (True, True, True, None, None),
    }


def test_a_killed_scan_goes_on(spark, tmp_path):
    files = spark.createDataFrame([(r, f"f{i}", f"text {i if i % 3 else i + 100 * r}" if i != 5 else None) for r in (1, 2) for i in range(12)], "revision int, path string, text string")
    seen = spark.sparkContext.accumulator(0)

    def analyse(stop):
        def run(part):
            rest = part.collect()
            if stop and seen.value + len(rest) > 6:
                raise KeyboardInterrupt
            seen.add(len(rest))
            return part.select("path", "content", F.length("text").alias("size"))

        return run

    store = str(tmp_path / "scans")
    with pytest.raises(KeyboardInterrupt):
        resume.scan(files, analyse(True), store, 4)
    first = seen.value
    assert 0 < first <= 6
    os.makedirs(f"{store}/batch-9-half")  # a batch that was being written
    got = resume.scan(files, analyse(False), store, 4)
    contents = {(r.path, r.text) for r in files.collect() if r.text is not None}
    assert seen.value == len(contents)  # nothing twice
    assert not os.path.exists(f"{store}/batch-9-half")
    once = resume.scan(files, analyse(False), str(tmp_path / "other"), 4)
    assert rows(got) == rows(once) and got.count() == 24 and got.where("size is null").count() == 2
    before = seen.value
    resume.scan(files, analyse(False), store, 4)
    assert seen.value == before


def test_environments_do_not_depend_on_segments(spark):
    import random

    from factloom.operators import environments

    rnd = random.Random(5)
    kinds = ["const", "copy", "add", "subtract", "scale", "multiply", "check_division", "check_null", "check_index"]
    data = []
    for func in range(3):
        for pos in range(60):
            kind, lo = rnd.choice(kinds), float(rnd.randint(-3, 3))
            data.append((func, pos, kind, f"v{rnd.randrange(4)}", f"v{rnd.randrange(4)}", rnd.choice([None, "v0", "v1"]) if kind != "multiply" else "v2", lo, lo + rnd.randint(0, 2), rnd.choice(["no", "yes", "maybe"])))
    df = spark.createDataFrame(data, "func long, pos long, kind string, target string, left string, right string, lo double, hi double, none string")
    whole = rows(environments.tracked(df))
    assert len(whole) == 180 and rows(environments.tracked(df, 7)) == whole and rows(environments.tracked(df, 1)) == whole


def test_a_deferred_division(spark):
    """A result from -1 to 1, less 3, cannot be zero; twice a value from 0 to 2 may be an index of 5 places but not surely of 4."""
    from factloom.operators import environments

    data = [("const", "c", None, None, -1.0, 1.0), ("subtract", "d", "c", None, 3.0, 3.0), ("check_division", None, "d", None, None, None), ("check_division", None, "c", None, None, None), ("const", "i", None, None, 0.0, 2.0), ("scale", "i", "i", None, 2.0, None), ("check_index", None, "i", None, 5.0, None), ("check_index", None, "i", None, 4.0, None), ("subtract", "z", "i", "i", None, None), ("check_null", None, "gone", None, None, None)]
    df = spark.createDataFrame([(0, i, *x, None) for i, x in enumerate(data)], "func long, pos long, kind string, target string, left string, right string, lo double, hi double, none string")
    got = {r.pos: r for r in environments.tracked(df, 3).collect()}
    assert [got[i].verdict for i in (2, 3, 6, 7, 9)] == ["SAFE", "UNKNOWN", "SAFE", "UNKNOWN", "UNKNOWN"]
    assert (got[8].lo, got[8].hi, got[9].lo) == (-4.0, 4.0, None)
