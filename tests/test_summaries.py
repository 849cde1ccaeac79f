"""Summaries by input against programs small enough to follow by hand."""

from factloom.operators import summaries


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_callee_called_clean_and_tainted(spark):
    """main taints x, calls f(x) and then f(y): only the first result is tainted, though both calls are the same function.

    f gives its parameter back, and calls itself; g cleans what it gets.
    """
    functions = spark.createDataFrame([("main", 0, 6, None), ("f", 10, 13, "r"), ("g", 20, 22, "q")], "func string, entry int, exit int, result string")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (10, 11), (11, 12), (12, 13), (11, 13), (20, 21), (21, 22)], "src int, dst int")
    statements = spark.createDataFrame([(0, "source", "x", "5"), (10, "copy", "r", "p"), (20, "clean", "q", None), (4, "clean", "x", None)], "node int, kind string, target string, value string")
    calls = spark.createDataFrame([(1, "f", "u"), (2, "f", "v"), (3, "g", "w"), (12, "f", "r")], "node int, callee string, target string")
    args = spark.createDataFrame([(1, "x", "p"), (2, "y", "p"), (3, "x", "q"), (12, "p", "p")], "node int, var string, param string")
    seeds = spark.createDataFrame([("main", "", 0)], "func string, var string, label int")
    found = summaries.tabulated(functions, edges, statements, calls, args, seeds).where("var <> ''")
    at = lambda node: {(i, v) for _, i, _, n, v, _ in rows(found) if n == node}
    assert at(2) == {("", "x"), ("", "u")} and at(3) == {("", "x"), ("", "u")}  # v is clean
    assert at(4) == {("", "x"), ("", "u")} and at(5) == {("", "u")}  # g and the statement kill
    assert at(13) == {("p", "p"), ("p", "r")}  # entered clean it gives nothing
    assert found.where("func = 'f'").select("in_label").distinct().collect()[0][0] == 5


def test_labels_of_large_files_are_grouped_in_more_parts(spark, tmp_path, monkeypatch):
    """What one task groups does not grow with the table: larger files are grouped in more parts."""
    from factloom import storage
    from factloom.functions import taint

    path = str(tmp_path / "args")
    spark.range(20_000).selectExpr("id div 4 as call", "'f' as func", "id % 4 as pos", "1L << cast(id % 4 as int) as tau", "15L - id % 4 as kappa", "id % 4 as sigma").write.parquet(path)
    monkeypatch.setattr(storage, "PART_BYTES", 2_000)
    args = spark.read.parquet(path)
    found = taint.apply_summary(args, spark.createDataFrame([("f", 1), ("f", 2), ("f", 2)], "func string, pos long"))
    assert found.rdd.getNumPartitions() == storage.parts(args) > 4
    assert {tuple(r)[1:] for r in found.collect()} == {(6, 14 & 13, 3)} and found.count() == 5_000


def test_rounds_read_all_facts_once(spark, monkeypatch):
    """A round looks for what is new among all facts, and for calls and results in tables of their own."""
    made = []

    class Counted(summaries.Seen):
        def __init__(self, *args, **more):
            super().__init__(*args, **more)
            self.read = self.added = 0
            made.append(self)

        def all(self):
            self.read += 1
            return super().all()

        def add(self, part):
            self.added += 1
            self.parts.append(part)

    monkeypatch.setattr(summaries, "Seen", Counted)
    functions = spark.createDataFrame([("m", 0, 2, None), ("f", 10, 11, "p")], "func string, entry int, exit int, result string")
    edges = spark.createDataFrame([(0, 1), (1, 2), (10, 11)], "src int, dst int")
    statements = spark.createDataFrame([(0, "source", "x", "5")], "node int, kind string, target string, value string")
    calls, args = spark.createDataFrame([(1, "f", "y")], "node int, callee string, target string"), spark.createDataFrame([(1, "x", "p")], "node int, var string, param string")
    found = summaries.tabulated(functions, edges, statements, calls, args, spark.createDataFrame([("m", "", 0)], "func string, var string, label int"))
    assert made[0].read <= made[0].added + 2
    assert {r["var"] for r in found.where("node = 2 and var <> ''").collect()} == {"x", "y"}
