"""Security contracts: matching of names, sources, sanitizers, violations."""

from factloom.operators import contracts


def test_names_match_exactly_by_suffix_and_by_method(spark):
    n = spark.createDataFrame([(x,) for x in ("os.system", "my.requests.get", "tar.open", "db.cur.execute", "get", "x.nothing", "builtins.open")], "name string")
    got = {r.name: r.key for r in contracts.match(n, contracts.sinks(spark)).collect()}
    assert got == {"os.system": "os.system", "my.requests.get": "requests.get", "tar.open": None, "db.cur.execute": "cursor.execute", "get": None, "x.nothing": None, "builtins.open": "builtins.open"}


def test_sources_sanitizers_and_sinks(spark):
    label = "call int, name string, arg int, tau long, kappa long, sigma long, shell boolean"
    c = spark.createDataFrame([(1, "request.GET.get", 0, 0, 0, 0, None), (2, "getpass.getpass", 0, 0, 0, 0, None), (3, "other", 0, 0, 7, 0, None)], label)
    got = {r.call: (r.tau, r.kappa, r.sigma) for r in contracts.apply_sources(c, contracts.sources(spark)).collect()}
    assert got == {1: (1, 0, 0), 2: (0, 0, 512), 3: (0, 7, 0)}
    c = spark.createDataFrame([(1, "html.escape", 0, 1, 0, 0, None), (2, "other", 0, 1, 0, 0, None)], label)
    got = {r.call: r.kappa for r in contracts.apply_sanitizers(c, contracts.sanitizers(spark)).collect()}
    assert got == {1: 1 << 12 | 1 << 15, 2: 0}
    rows = [(1, "os.system", 0, 1, 0, 0, None), (2, "subprocess.run", 0, 1, 0, 0, False), (3, "subprocess.run", 0, 1, 0, 0, True), (4, "subprocess.run", 0, 1, 0, 0, None), (5, "shutil.copy", 1, 1, 0, 0, None), (5, "shutil.copy", 0, 1, 0, 0, None), (6, "os.system", 1, 1, 0, 0, None), (7, "logging.info", 0, 1, 0, 0, None), (8, "pickle.loads", 0, 0, 0, 512, None)]
    bad = {r.call: r.arg for r in contracts.violations(spark.createDataFrame(rows, label), contracts.sinks(spark)).collect()}
    assert bad == {1: 0, 3: 0, 4: 0, 5: 0, 8: 0}


def test_default_contract(spark):
    k = spark.createDataFrame([("a.f",), ("*.g",)], "key string")
    got = {r.name: r.key for r in contracts.contract_or_havoc(spark.createDataFrame([("a.f",), ("b.g",), ("c.h",)], "name string"), k).collect()}
    assert got == {"a.f": "a.f", "b.g": "*.g", "c.h": "<havoc>"}


def test_calls_take_their_case_where_they_are(spark):
    """Calls are neither grouped nor shuffled; the case with the least ordinal counts, whatever the order of the rows."""
    cases = spark.createDataFrame([("f", 2, None, None, 7.0, 0.0), ("f", 0, None, 10.0, 0.0, 2.0), ("f", 1, 5.0, 20.0, 1.0, 1.0)], "name string, ordinal int, low double, high double, add double, times double")
    rows = [(1, "f", 10.0), (2, "f", 20.0), (3, "f", 21.0), (4, "g", 1.0), (5, "f", None), (6, None, 1.0), (1, "f", 10.0)]
    calls = spark.createDataFrame(rows, "call int, name string, value double").repartition(7)
    found = contracts.by_cases(calls, cases)
    assert sorted((r.call, r.ordinal, r.result) for r in found.collect()) == [(1, 0, 20.0), (1, 0, 20.0), (2, 1, 21.0), (3, 2, 7.0), (4, None, None), (5, None, None), (6, None, None)]
    assert found.rdd.getNumPartitions() == 7
