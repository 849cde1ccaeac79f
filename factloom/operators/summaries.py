"""Taint summaries of functions over a call graph: which parameters reach which sinks or the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import taint
from factloom.operators.graph import Seen, reachable, recursive_nodes, spread, steps, strong_components
from factloom.operators.lattice import Lattice, fanout, fixpoint, only
from factloom.storage import cut, cut_count

RESULT = -1


def flows(direct: DataFrame, passes: DataFrame, returns: DataFrame) -> DataFrame:
    """(func, param, target): least fixpoint of parameter flows; target RESULT is the function's result.

    direct(func, param, target) holds inside a body, passes(func, param, callee, arg) hands a parameter on, and
    returns(func, callee) gives a callee's result as its own.  A callee's flow to a sink is its caller's; its flow to
    its result is its caller's where the caller returns it.  The change test looks at all flows, so recursion is exact.
    """
    keys = ["func", "param", "target"]
    given = cut(passes.select("func", "param", "callee", "arg").distinct())
    back = cut(returns.select("func", "callee").distinct())

    def callers(found: DataFrame) -> DataFrame:
        f = found.select(F.col("func").alias("callee"), F.col("param").alias("arg"), "target")
        sinks = given.join(f.where(F.col("target") != RESULT), ["callee", "arg"]).select(*keys)
        results = given.join(f.where(F.col("target") == RESULT), ["callee", "arg"]).join(back, ["func", "callee"], "left_semi").select(*keys)
        return sinks.union(results)

    return spread(direct.select(*keys), callers)


def security_bugs(reachable: DataFrame, calls: DataFrame, summary: DataFrame) -> DataFrame:
    """(call, func, target): reachable calls whose tainted argument flows to a sink.  calls(call, caller, func, arg, tainted)."""
    live = calls.where("tainted").join(reachable.select(F.col("node").alias("caller")), "caller", "left_semi")
    return live.join(summary.where(F.col("target") != RESULT), (live["func"] == summary["func"]) & (live["arg"] == summary["param"])).select("call", live["func"], "target").distinct()


def in_contexts(calls: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(func, context, label): labels that calls carry, each kept apart by the last k call sites it came through.

    calls(site, caller, callee), seeds(func, label) start in the empty context.  With k 0 all contexts are one.  Contexts are
    finite in number, so recursion ends.
    """
    none = F.array().cast("array<string>")
    edge = cut(calls.select(F.col("site").cast("string").alias("site"), "caller", "callee").distinct())
    longer = F.slice(F.array_append("context", F.col("site")), F.greatest(F.size("context") + 2 - k, F.lit(1)), F.lit(k)) if k else none
    step = lambda f: f.join(edge, F.col("func") == F.col("caller")).select(F.col("callee").alias("func"), longer.alias("context"), "label")
    return spread(seeds.select("func", none.alias("context"), "label"), step)


#: The fact that always holds, from which sources make others: no variable and no label.
ZERO = ("", 0)
_FACT = ["func", "in_var", "in_label", "node", "var", "label"]


def tabulated(functions: DataFrame, edges: DataFrame, statements: DataFrame, calls: DataFrame, args: DataFrame, seeds: DataFrame) -> DataFrame:
    """(func, in_var, in_label, node, var, label): the tainted variables at each node, for each input that a function is entered with.

    A function is looked at once for each tainted input, whoever hands it over, and what it returns for that input is used at all
    such calls: rows at its exit are its summary.  Only what some call hands over is looked at, from seeds(func, var, label) on; the fact ZERO, an
    empty variable with label 0, stands for no taint, and every seeded or called function is entered with it too.  Calls and returns
    match, so taint that one caller hands over does not come back to another, whatever the depth of calls or recursion.

    functions(func, entry, exit, result); edges(src, dst) lead from node to node inside a function, from a call to what follows it;
    statements(node, kind, target, value) with at most one row a node: `copy` gives the labels of the variable value to target, `source` the label
    value, `clean` none.  All kinds, and calls, kill what target had.  calls(node, callee, target), args(node, var, param).
    """
    flow = cut(edges.select("src", "dst").distinct())
    done = cut(statements.select(F.col("node").alias("src"), "kind", "target", F.col("value").cast("string").alias("value")))
    sites = cut(calls.select("node", "callee", "target").distinct())
    killed = cut(done.select(F.col("src").alias("node"), F.col("target").alias("var")).union(sites.select("node", "target").where("target is not null")))
    whole = functions.select("func", "entry", "exit", "result").distinct()
    # what a call hands over: (node, var) -> (callee, param), the fact ZERO as itself
    hand = args.select("node", "var", "param").union(sites.select("node", F.lit("").alias("var"), F.lit("").alias("param")))
    hand = cut(sites.join(hand, "node").join(whole.select(F.col("func").alias("callee"), "entry"), "callee").select("node", "var", "callee", "param", "entry", "target").distinct())
    # a row a node of what it kills and what follows it, as long as its program text, so that a step inside a function is one join
    after = flow.groupBy("src").agg(F.collect_set("dst").alias("next"))
    after = cut(after.join(killed.groupBy(F.col("node").alias("src")).agg(F.collect_set("var").alias("gone")), "src", "left").join(done, "src", "left").withColumnRenamed("src", "node"))
    ends = cut(whole.select(F.col("func").alias("callee"), F.col("exit").alias("node"), F.col("result").alias("var")))

    def inside(f: DataFrame) -> DataFrame:
        made = f.join(after, "node")
        fact = lambda var, label: F.struct(var.alias("var"), label.alias("label"))
        kept = F.when(~F.coalesce(F.array_contains("gone", F.col("var")), F.lit(False)), fact(F.col("var"), F.col("label")))
        copied = F.when((F.col("kind") == "copy") & (F.col("value") == F.col("var")), fact(F.col("target"), F.col("label")))
        sprung = F.when((F.col("kind") == "source") & (F.col("var") == ""), fact(F.col("target"), F.col("value").try_cast("long")))
        moved = made.select(*_FACT[:3], "next", F.explode(F.array_compact(F.array(kept, copied, sprung))).alias("fact"))
        return moved.select(*_FACT[:3], F.explode("next").alias("node"), "fact.var", "fact.label")

    def handed(f: DataFrame) -> DataFrame:
        return f.join(hand, ["node", "var"])

    def results(found: DataFrame) -> DataFrame:
        out = found.select(F.col("func").alias("callee"), F.col("in_var").alias("param"), F.col("in_label").alias("in_l"), "node", "var", F.col("label").alias("out"))
        return out.join(ends, ["callee", "node", "var"]).select("callee", "param", "in_l", "out").distinct()

    def returned(asking: DataFrame, out: DataFrame) -> DataFrame:
        met = asking.where("target is not null").withColumnRenamed("label", "in_l").join(out, ["callee", "param", "in_l"])
        back = met.select(*_FACT[:4], F.col("target").alias("var"), F.col("out").alias("label"))
        return back.join(flow, F.col("node") == F.col("src")).select(*_FACT[:3], F.col("dst").alias("node"), "var", "label")

    zero = F.lit(ZERO[0]).alias("var"), F.lit(ZERO[1]).cast("long").alias("label")
    first = seeds.select("func", "var", F.col("label").cast("long").alias("label")).union(seeds.select("func", *zero)).join(whole, "func")
    frontier, rows = cut_count(first.select("func", F.col("var").alias("in_var"), F.col("label").alias("in_label"), F.col("entry").alias("node"), "var", "label").distinct())
    seen, found = Seen(frontier), rows
    asking, given = None, None  # facts at calls and results of functions, each found once, so that rounds do not look for them among all facts
    while rows:
        calls_now, given_now = cut(handed(frontier)), cut(results(frontier))
        if asking is None:
            asking, given = Seen(calls_now), Seen(given_now)
        else:
            asking.add(calls_now)
            given.add(given_now)
        entered = calls_now.select(F.col("callee").alias("func"), F.col("param").alias("in_var"), F.col("label").alias("in_label"), F.col("entry").alias("node"), F.col("param").alias("var"), "label")
        made, ahead = entered.union(returned(calls_now, given.all())).union(returned(asking.all(), given_now)), frontier
        for _ in range(steps(rows, found)):
            ahead = inside(ahead)
            made = made.union(ahead)
        frontier, rows = cut_count(made.distinct().join(seen.all(), _FACT, "left_anti"))
        found += rows
        if rows:
            seen.add(frontier)
    return seen.all()


#: Labels under their join; the clean label is its least value.
LABELS = Lattice((("tau", only(F.bit_or)), ("kappa", only(F.bit_and)), ("sigma", only(F.bit_or))))


def transferred(instructions: DataFrame, operands: DataFrame, known: DataFrame) -> DataFrame:
    """(value, tau, kappa, sigma): the label of what each instruction makes, from those of its operands by the rules of taint.TRANSFERS.

    instructions(value, op), operands(value, role, of) name what a value is made of, known(value, tau, kappa, sigma) are the labels of
    sources; other values are clean, and so are the results of instructions without a rule.  Values may depend on each other in loops.
    """
    rules = F.broadcast(instructions.sparkSession.createDataFrame(list(taint.TRANSFERS), "op string, role string"))
    uses = cut(operands.join(instructions.select("value", "op"), "value").join(rules, ["op", "role"]).select("of", F.col("value").alias("to")).distinct())
    step = lambda f: f.join(uses, F.col("value") == F.col("of")).select(F.col("to").alias("value"), "tau", "kappa", "sigma")
    long = lambda c: F.col(c).cast("long").alias(c)
    found = fixpoint(known.select("value", *map(long, LABELS.columns)), step, LABELS, "value", most=fanout(uses, "of"))
    clean = lambda c, v: F.coalesce(c, F.lit(v).cast("long")).alias(c)
    return instructions.select("value").join(found, "value", "left").select("value", clean("tau", 0), clean("kappa", taint.KAPPA_ALL), clean("sigma", 0))


def project(calls: DataFrame, entries: DataFrame, direct: DataFrame, passes: DataFrame, returns: DataFrame, functions: DataFrame) -> DataFrame:
    """(func, is_entry, is_reachable, is_recursive, n_flows): what an analysis of a whole project knows of each function before it looks for bugs.

    calls(src, dst), entries(node), functions(func); the rest as in flows().
    """
    live = reachable(calls, entries.select("node"), functions.select(F.col("func").alias("node"))).withColumnRenamed("node", "func")
    again = recursive_nodes(calls, strong_components(calls, functions.select(F.col("func").alias("node")))).withColumnRenamed("node", "func")
    per = flows(direct, passes, returns).groupBy("func").agg(F.count("*").alias("n_flows"))
    flag = lambda df, name: df.select("func").distinct().withColumn(name, F.lit(True))
    out = functions.select("func").distinct()
    for df, name in ((entries.withColumnRenamed("node", "func"), "is_entry"), (live, "is_reachable"), (again, "is_recursive")):
        out = out.join(flag(df, name), "func", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.join(per, "func", "left").withColumn("n_flows", F.coalesce("n_flows", F.lit(0)))
