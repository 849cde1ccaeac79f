"""Queries of whole programs: composed analyses, contexts, locations, scans, verdicts.  The SQL of each is what it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import intent, scoring, taint
from factloom.operators import baseline, concurrency, contracts, dataflow, environments, graph, matching, proofs, ranking, resume, scans, summaries
from factloom.plans import facts as ft
from factloom.plans.reference import _ACC, _FLOW, _SUM, _accesses, _callee, _flow, _functions
from factloom.plans.registry import load, query
from factloom.storage import dealt, scratch

# composed analyses ------------------------------------------------------------------------------------------------

_DEFS = "d AS (SELECT block, 'v' || CAST(p_size % 4 AS VARCHAR) AS var, p_size % 7 AS kind FROM p)"
_REACH = """r AS (SELECT dst AS block, var, d.block AS def_block FROM d JOIN succ ON src = d.block UNION
  SELECT dst, r.var, r.def_block FROM r JOIN succ ON src = r.block WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.block = r.block AND d.var = r.var))"""
_UNSET = """e AS (SELECT block AS entry, block FROM p WHERE pos = 0 UNION SELECT entry, dst FROM e JOIN succ ON src = e.block),
u AS (SELECT DISTINCT entry AS block, var FROM e JOIN d USING (block) UNION SELECT dst, u.var FROM u JOIN succ ON src = u.block WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.block = u.block AND d.var = u.var))"""


def _stores(p):
    s = F.col("p_size")
    return p.select("block", F.concat(F.lit("v"), (s % 4).cast("string")).alias("var"), s.alias("offset"), F.concat(F.lit("t"), (s % 7).cast("string")).alias("type"), (s % 7 == 0).alias("is_none"))


@query(f"""WITH RECURSIVE {_FLOW}, {_DEFS}, {_REACH}, {_UNSET}, s AS (
  SELECT r.block, r.var, 't' || CAST(kind AS VARCHAR) AS t, kind = 0 AS none FROM r JOIN d ON d.block = r.def_block AND d.var = r.var UNION ALL SELECT block, var, NULL, NULL FROM u)
SELECT block, var, coalesce(string_agg(DISTINCT t, ',' ORDER BY t), '') AS types, CASE WHEN count(none) = count(*) AND bool_and(none) = bool_or(none) THEN bool_or(none) END AS is_none FROM s GROUP BY ALL""")
def type_states(spark, sf_dir):
    p = _functions(spark, sf_dir)
    blocks, succ, _ = _flow(p)
    return dataflow.type_states(blocks, succ, _stores(p)).select("block", "var", F.array_join("possible_types", ",").alias("types"), "is_none")


def _short_functions(spark, sf_dir):
    """Functions of 8 blocks, so that no bound grows long enough to be widened."""
    return _functions(spark, sf_dir, 8)


@query("""WITH RECURSIVE p AS (SELECT p_partkey + p_partkey // 8 * 3 AS block, p_partkey % 8 AS pos, p_size FROM part),
succ AS (SELECT block AS src, block + 1 + p_size % 3 AS dst FROM p UNION SELECT block, block + 1 FROM p),
v AS (SELECT s.dst AS block, p.p_size AS value FROM p JOIN succ s ON s.src = p.block WHERE pos = 0 UNION
  SELECT s.dst, v.value + p.p_size % 5 - 2 FROM v JOIN p USING (block) JOIN succ s ON s.src = p.block WHERE pos > 0)
SELECT block, min(value) AS lo, max(value) AS hi FROM v GROUP BY 1""")
def value_bounds(spark, sf_dir):
    """Each function's entry sets a number, and every block behind it adds to it."""
    p, s = _short_functions(spark, sf_dir), F.col("p_size")
    blocks, succ, _ = _flow(p, 8)
    init = p.where("pos = 0").select("block", F.lit("x").alias("var"), s.cast("long").alias("lo"), s.cast("long").alias("hi"))
    add = p.where("pos > 0").select("block", F.lit("x").alias("var"), (s % 5 - 2).cast("long").alias("delta"))
    return dataflow.bounds(blocks, succ, init, add, widen_after=16).select("block", "lo", "hi")


#: A function of each part, of six nodes: a source, a copy, a call, a kill or a copy, a sink, the exit; half a dozen branches by its size.
_PROGRAM = """fn AS (SELECT p_partkey AS func, p_size AS s, p_partkey * 8 AS base, CASE WHEN p_partkey % 12 + 1 + p_size % 4 < 12 AND p_partkey + 1 + p_size % 4 < (SELECT max(p_partkey) FROM part) THEN p_partkey + 1 + p_size % 4 END AS callee FROM part),
flow AS (SELECT base + k AS src, base + k + 1 AS dst FROM fn CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS v(k) UNION SELECT base + 1, base + 4 FROM fn WHERE s % 4 = 0 UNION SELECT base + 4, base + 1 FROM fn WHERE s % 6 = 0),
stm AS (SELECT base AS node, 'source' AS kind, 'b' AS target, CAST(1 + s % 3 AS VARCHAR) AS value FROM fn WHERE s % 5 = 0 UNION ALL SELECT base + 1, CASE WHEN s % 2 = 0 THEN 'copy' ELSE 'clean' END, 'c', 'a' FROM fn
  UNION ALL SELECT base + 3, CASE WHEN s % 7 = 0 THEN 'clean' ELSE 'copy' END, CASE WHEN s % 7 = 0 THEN 'r' ELSE 'c' END, 'b' FROM fn WHERE s % 7 < 2),
res AS (SELECT func, CASE WHEN s % 2 = 0 THEN 'r' ELSE 'c' END AS result, base + 5 AS exit_ FROM fn),
arg AS (SELECT base + 2 AS node, callee, ['b', 'c', 'a'][1 + s % 3] AS var FROM fn WHERE callee IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_PROGRAM}, st AS (
  SELECT [] :: STRUCT(func BIGINT, iv VARCHAR, il BIGINT, node BIGINT)[] AS stack, func, v.v AS iv, v.l AS il, base AS node, v.v AS var, v.l AS label FROM fn CROSS JOIN (VALUES ('', 0), ('a', 9)) AS v(v, l) WHERE s % 9 = 0 UNION
  (SELECT st.stack, st.func, iv, il, f.dst, st.var, st.label FROM st JOIN flow f ON f.src = st.node
     WHERE NOT EXISTS (SELECT 1 FROM stm WHERE stm.node = st.node AND stm.target = st.var) AND NOT (st.var = 'r' AND EXISTS (SELECT 1 FROM arg WHERE arg.node = st.node))
   UNION ALL SELECT st.stack, st.func, iv, il, f.dst, stm.target, CASE WHEN kind = 'source' THEN CAST(value AS BIGINT) ELSE st.label END FROM st JOIN stm ON stm.node = st.node JOIN flow f ON f.src = st.node
     WHERE (kind = 'copy' AND value = st.var) OR (kind = 'source' AND st.var = '')
   UNION ALL SELECT list_append(st.stack, struct_pack(func := st.func, iv := iv, il := il, node := st.node)), arg.callee, CASE WHEN st.var = '' THEN '' ELSE 'a' END, st.label, arg.callee * 8, CASE WHEN st.var = '' THEN '' ELSE 'a' END, st.label
     FROM st JOIN arg ON arg.node = st.node AND (st.var = '' OR arg.var = st.var)
   UNION ALL SELECT stack[:-2], stack[-1].func, stack[-1].iv, stack[-1].il, stack[-1].node + 1, 'r', st.label FROM st JOIN res ON res.func = st.func AND res.exit_ = st.node AND res.result = st.var WHERE len(stack) > 0))
SELECT DISTINCT func, iv AS in_var, il AS in_label, node, var, label FROM st WHERE var <> '' AND node % 8 = 4""")
def taint_by_input(spark, sf_dir):
    """Taint at the sink of every function, apart for each input that it is called with; the oracle runs every call with a stack of its own.

    Calls go down inside of modules of 12 functions.
    """
    c, f = F.col, F
    size = load(spark, sf_dir, "part").agg(F.max("p_partkey").alias("most"))  # one row
    k, s = c("p_partkey"), c("p_size")
    fits = (k % 12 + 1 + s % 4 < 12) & (k + 1 + s % 4 < c("most"))
    fn = load(spark, sf_dir, "part").join(F.broadcast(size)).select(k.alias("func"), s.alias("s"), (k * 8).alias("base"), F.when(fits, k + 1 + s % 4).alias("callee"))
    at, s = lambda i: c("base") + i, c("s")
    edges = fn.select(F.explode(F.array(*(F.struct(at(i).alias("src"), at(i + 1).alias("dst")) for i in range(5)))).alias("e")).select("e.*")
    edges = edges.union(fn.where("s % 4 = 0").select(at(1), at(4))).union(fn.where("s % 6 = 0").select(at(4), at(1)))
    clean = s % 7 == 0
    stm = fn.where("s % 5 = 0").select(at(0).alias("node"), f.lit("source").alias("kind"), f.lit("b").alias("target"), (1 + s % 3).cast("string").alias("value"))
    stm = stm.union(fn.select(at(1), F.when(s % 2 == 0, "copy").otherwise("clean"), f.lit("c"), f.lit("a")))
    stm = stm.union(fn.where("s % 7 < 2").select(at(3), F.when(clean, "clean").otherwise("copy"), F.when(clean, "r").otherwise("c"), f.lit("b")))
    functions = fn.select("func", at(0).alias("entry"), at(5).alias("exit"), F.when(s % 2 == 0, "r").otherwise("c").alias("result"))
    made = fn.where("callee is not null")
    calls = made.select(at(2).alias("node"), "callee", f.lit("r").alias("target"))
    args = made.select(at(2).alias("node"), F.get(F.array(*map(F.lit, "bca")), (s % 3).cast("int")).alias("var"), f.lit("a").alias("param"))
    seeds = fn.where("s % 9 = 0").select("func", f.lit("a").alias("var"), f.lit(9).alias("label"))
    return summaries.tabulated(functions, edges, stm, calls, args, seeds).where("var <> '' and node % 8 = 4")


# loops, refinement on edges, widening -----------------------------------------------------------------------------

_DOM = f"""{_FLOW}, nodes AS (SELECT block FROM p UNION SELECT dst FROM succ), start AS (SELECT block FROM p WHERE pos = 0),
live AS (SELECT block FROM start UNION SELECT dst FROM live JOIN succ ON src = block),
without AS (SELECT n.block AS d, s.block FROM nodes n JOIN start s ON s.block // 63 = n.block // 63 AND s.block <> n.block UNION
  SELECT w.d, s.dst FROM without w JOIN succ s ON s.src = w.block WHERE s.dst <> w.d),
dom AS (SELECT d.block AS d, b.block FROM live d JOIN live b ON d.block // 63 = b.block // 63 WHERE NOT EXISTS (SELECT 1 FROM without w WHERE w.d = d.block AND w.block = b.block)),
deep AS (SELECT block, count(*) AS depth FROM dom GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_DOM} SELECT e.block, max(d.d) FILTER (x.depth = e.depth - 1) AS idom, e.depth FROM deep e JOIN dom d ON d.block = e.block JOIN deep x ON x.block = d.d GROUP BY e.block, e.depth""")
def dominators(spark, sf_dir):
    """The immediate dominator of every block; the oracle takes blocks away and sees what is still reached."""
    blocks, succ, _ = _flow(_functions(spark, sf_dir))
    return dataflow.Dominators(blocks, succ).immediate()


@query(f"""WITH RECURSIVE {_DOM}, back AS (SELECT s.src, s.dst AS header FROM succ s JOIN dom ON d = s.dst AND block = s.src),
body AS (SELECT header, src AS block FROM back UNION SELECT header, header FROM back UNION SELECT b.header, s.src FROM body b JOIN succ s ON s.dst = b.block WHERE b.block <> b.header),
st AS (SELECT block, 'v' || CAST(p_size % 4 AS VARCHAR) AS var FROM p WHERE p_size % 3 <> 1), co AS (SELECT block, 'v' || CAST(p_size % 5 AS VARCHAR) AS var FROM p WHERE p_size % 2 = 0),
near AS (SELECT DISTINCT header, var FROM back JOIN st ON st.block = src),
m AS (SELECT * FROM near UNION SELECT header, var FROM body JOIN st USING (block) WHERE header NOT IN (SELECT header FROM near))
SELECT h.header, (SELECT count(*) FROM back b WHERE b.header = h.header) AS back_edges, (SELECT count(*) FROM body b WHERE b.header = h.header) AS blocks,
  coalesce((SELECT string_agg(var, ',' ORDER BY var) FROM m WHERE m.header = h.header), '') AS modified, coalesce((SELECT string_agg(var, ',') FROM co WHERE co.block = h.header), '') AS compared
FROM (SELECT DISTINCT header FROM back) h""")
def loops(spark, sf_dir):
    """Loops by the back edges that the dominators show; edges back to a block that does not dominate their source make none."""
    p, s = _functions(spark, sf_dir), F.col("p_size")
    blocks, succ, _ = _flow(p)
    var = lambda n: F.concat(F.lit("v"), (s % n).cast("string")).alias("var")
    found = dataflow.loops(dataflow.Dominators(blocks, succ), p.where("p_size % 3 <> 1").select("block", var(4)), p.where("p_size % 2 = 0").select("block", var(5)))
    return found.select("header", "back_edges", "blocks", F.array_join("modified", ",").alias("modified"), F.array_join("compared", ",").alias("compared"))


_TESTS = """tests AS (SELECT block AS src, block + 1 AS dst, true AS holds, 'v' || CAST(p_size % 4 AS VARCHAR) AS var, p_size // 3 % 4 AS kind, 't' || CAST(p_size % 5 AS VARCHAR) AS name FROM p WHERE p_size % 3 <> 0
  UNION ALL SELECT block, block + 1 + p_size % 3, false, 'v' || CAST(p_size % 4 AS VARCHAR), p_size // 3 % 4, 't' || CAST(p_size % 5 AS VARCHAR) FROM p WHERE p_size % 3 <> 0)"""
_ASKED = lambda out: f"""SELECT dst, var, CASE WHEN kind = 1 AND holds THEN name ELSE t END, CASE WHEN kind = 0 THEN holds WHEN kind = 1 AND holds THEN false WHEN kind = 1 AND t = name THEN true WHEN kind = 2 AND holds THEN false ELSE none END
  FROM ({out}) WHERE NOT coalesce((kind = 0 AND none <> holds) OR (kind = 1 AND holds AND (t <> name OR none)) OR (kind = 1 AND NOT holds AND t = name AND NOT none) OR (kind = 2 AND holds AND none), false)"""  # noqa: E731
_EDGE = lambda of, rest: f"SELECT s.dst, x.var, x.t, x.none, kind, holds, name FROM {of} x JOIN succ s ON s.src = x.block LEFT JOIN tests q ON q.src = s.src AND q.dst = s.dst AND q.var = x.var {rest}"


@query(f"""WITH RECURSIVE {_FLOW}, {_TESTS}, d AS (SELECT block, 'v' || CAST(p_size % 4 AS VARCHAR) AS var, 't' || CAST(p_size % 7 AS VARCHAR) AS t, CASE p_size % 3 WHEN 0 THEN p_size % 7 = 0 END AS none FROM p WHERE p_size % 5 < 3),
e AS (SELECT block AS entry, block FROM p WHERE pos = 0 UNION SELECT entry, dst FROM e JOIN succ ON src = e.block),
r(block, var, t, none) AS (SELECT DISTINCT entry, var, NULL::VARCHAR, NULL::BOOLEAN FROM e JOIN d USING (block) UNION {_ASKED(_EDGE('d', ''))} UNION
  {_ASKED(_EDGE('r', 'WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.block = x.block AND d.var = x.var)'))})
SELECT block, var, coalesce(string_agg(DISTINCT t, ',' ORDER BY t), '') AS types, CASE WHEN count(none) = count(*) AND bool_and(none) = bool_or(none) THEN bool_or(none) END AS is_none FROM r GROUP BY ALL""")
def refined_types(spark, sf_dir):
    """Types behind tests for none, for a type and for truth: what holds on one branch of a block does not on the other."""
    p, s = _functions(spark, sf_dir), F.col("p_size")
    blocks, succ, _ = _flow(p)
    text = lambda x, n: F.concat(F.lit(x), (s % n).cast("string"))
    stores = p.where("p_size % 5 < 3").select("block", text("v", 4).alias("var"), s.alias("offset"), text("t", 7).alias("type"), F.when(s % 3 == 0, s % 7 == 0).alias("is_none"))
    kind = F.get(F.array(*map(F.lit, ("none", "type", "truth"))), (F.floor(s / 3) % 4).cast("int"))
    edge = lambda far, holds: p.where("p_size % 3 <> 0").select(F.col("block").alias("src"), (F.col("block") + far).alias("dst"), text("v", 4).alias("var"), kind.alias("test"), text("t", 5).alias("name"), F.lit(holds).alias("holds"))
    tests = edge(F.lit(1), True).union(edge(1 + s % 3, False))
    return dataflow.type_states(blocks, succ, stores, tests).select("block", "var", F.array_join("possible_types", ",").alias("types"), "is_none")


#: Edges of the nested loops of a part, (from, to): 1 heads the loop over i, 3 that over j, 4 and 5 count, 6 is the exit.
_NEST = ((0, 1), (1, 2), (1, 6), (2, 3), (3, 4), (3, 5), (4, 3), (5, 1))


@query("""WITH RECURSIVE f AS (SELECT p_partkey * 8 AS base, p_size % 7 AS i0, p_size % 3 AS j0, CASE WHEN p_partkey % 2 = 0 THEN 8 + p_size % 10 ELSE 200 + p_size END AS n, CASE WHEN p_partkey % 2 = 0 THEN 3 + p_size % 6 ELSE 3 END AS m FROM part),
s AS (SELECT base, 1 AS here, i0 AS i, NULL::BIGINT AS j FROM f UNION
  SELECT s.base, CASE here WHEN 1 THEN CASE WHEN i < n THEN 2 ELSE 6 END WHEN 2 THEN 3 WHEN 3 THEN CASE WHEN j < m THEN 4 ELSE 5 END WHEN 4 THEN 3 ELSE 1 END, CASE here WHEN 5 THEN i + 1 ELSE i END, CASE here WHEN 2 THEN j0 WHEN 4 THEN j + 1 ELSE j END
  FROM s JOIN f USING (base) WHERE here < 6)
SELECT base + here AS block, var, min(v) AS lo, max(v) AS hi FROM (SELECT base, here, 'i' AS var, i AS v FROM s UNION ALL SELECT base, here, 'j', j FROM s) WHERE v IS NOT NULL GROUP BY ALL""")
def loop_bounds(spark, sf_dir):
    """Two counters in nested loops, each part's with its own bounds; the oracle runs the loops step by step.

    Loops of 200 turns and more are widened after two rounds, and the guards of the loops bring the bounds back.
    """
    k, s, c = F.col("p_partkey"), F.col("p_size"), F.col
    even = k % 2 == 0
    f = load(spark, sf_dir, "part").select((k * 8).alias("base"), (s % 7).cast("long").alias("i0"), (s % 3).cast("long").alias("j0"), F.when(even, 8 + s % 10).otherwise(200 + s).cast("long").alias("n"), F.when(even, 3 + s % 6).otherwise(3).cast("long").alias("m"))
    none = F.lit(None).cast("long")
    edge = lambda a, b, var, lo, hi: F.struct((c("base") + a).alias("src"), (c("base") + b).alias("dst"), F.lit(var).alias("var"), lo.alias("lo"), hi.alias("hi"))
    asked = F.array(edge(1, 2, "i", none, c("n") - 1), edge(1, 6, "i", c("n"), none), edge(3, 4, "j", none, c("m") - 1), edge(3, 5, "j", c("m"), none))
    succ = f.select(F.explode(F.array(*(F.struct((c("base") + a).alias("src"), (c("base") + b).alias("dst")) for a, b in _NEST))).alias("e")).select("e.*")
    blocks = f.select(F.floor(c("base") / 8).alias("func"), F.explode(F.sequence("base", c("base") + 6)).alias("block"), c("base")).select("func", "block", (c("block") == c("base")).alias("is_entry"))
    tests = f.select(F.explode(asked).alias("e")).select("e.*")
    init = f.select("base", F.lit("i").alias("var"), c("i0").alias("v")).union(f.select(c("base") + 2, F.lit("j"), "j0")).select(c("base").alias("block"), "var", c("v").alias("lo"), c("v").alias("hi"))
    add = f.select((c("base") + 4).alias("block"), F.lit("j").alias("var"), F.lit(1).alias("delta")).union(f.select(c("base") + 5, F.lit("i"), F.lit(1)))
    headers = dataflow.changed_in_loops(dataflow.Dominators(blocks, succ), init.select("block", "var").union(add.select("block", "var")))
    return dataflow.bounds(blocks, succ, init, add, widen_after=2, tests=tests, headers=headers, narrow=3)


@query(f"""WITH RECURSIVE {_FLOW}, {_DEFS}, {_REACH}, g AS (SELECT DISTINCT guard FROM gen), free AS (SELECT block, guard FROM p CROSS JOIN g WHERE pos = 0 UNION
  SELECT dst, f.guard FROM free f JOIN succ ON src = f.block WHERE NOT EXISTS (SELECT 1 FROM gen WHERE gen.block = f.block AND gen.guard = f.guard)),
m AS (SELECT b.block, count(*) AS n FROM (SELECT DISTINCT dst AS block FROM succ) b CROSS JOIN g WHERE NOT EXISTS (SELECT 1 FROM free f WHERE f.block = b.block AND f.guard = g.guard) GROUP BY 1),
n AS (SELECT block, count(*) AS n FROM r GROUP BY 1)
SELECT p.block, coalesce(m.n, 0) AS guards, coalesce(n.n, 0) AS definitions FROM p LEFT JOIN m USING (block) LEFT JOIN n USING (block)""")
def intraprocedural(spark, sf_dir):
    """The analyses of one function, for all functions: guards that must hold and definitions that may reach, by block."""
    p = _functions(spark, sf_dir)
    blocks, succ, gen = _flow(p)
    count = lambda df, name: df.groupBy("block").agg(F.count("*").alias(name))
    guards = count(dataflow.must_guards(blocks, succ, gen), "guards")
    defs = count(dataflow.reaching_definitions(blocks, succ, _stores(p).select("var", "block", "offset")), "definitions")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return p.select("block").join(guards, "block", "left").join(defs, "block", "left").select("block", none("guards"), none("definitions"))


@query(f"""WITH RECURSIVE {_SUM}, live AS (SELECT func FROM call WHERE p_size <= 5 UNION SELECT c.callee FROM live JOIN call c USING (func) WHERE c.callee IN (SELECT func FROM call)),
t AS (SELECT func AS src, callee AS dst FROM call UNION SELECT t.src, c.callee FROM t JOIN call c ON c.func = t.dst), n AS (SELECT func, count(*) AS n_flows FROM f GROUP BY 1)
SELECT func, p_size <= 5 AS is_entry, func IN (SELECT func FROM live) AS is_reachable, func IN (SELECT src FROM t WHERE src = dst) AS is_recursive, coalesce(n_flows, 0) AS n_flows FROM call LEFT JOIN n USING (func)""")
def project_context(spark, sf_dir):
    """Call graph, entry points, reachability, recursion and summaries of all functions in one table."""
    p = load(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    calls = p.select(k.alias("src"), _callee().alias("dst"))
    direct = p.where("p_size % 2 = 0").select(k.alias("func"), (k % 3).alias("param"), F.when(s % 3 == 0, -1).otherwise(s % 7).alias("target"))
    passes = p.select(k.alias("func"), (s % 3).cast("long").alias("param"), _callee().alias("callee"), (k % 3).alias("arg"))
    returns = p.where("p_partkey % 2 = 0").select(k.alias("func"), _callee().alias("callee"))
    return summaries.project(calls, p.where("p_size <= 5").select(k.alias("node")), direct, passes, returns, p.select(k.alias("func")))


@query("""WITH RECURSIVE call AS (SELECT 's' || CAST(p_partkey AS VARCHAR) AS site, p_partkey AS caller, p_partkey - p_partkey % 120 + (p_partkey * 3 + p_size) % 120 AS callee FROM part),
c AS (SELECT p_partkey AS func, CAST([] AS VARCHAR[]) AS context, p_size % 2 AS label FROM part WHERE p_size <= 3 UNION
  SELECT callee, list_slice(list_append(context, site), -2, -1), label FROM c JOIN call ON caller = func)
SELECT func, array_to_string(context, '>') AS context, label FROM c""")
def taint_in_contexts(spark, sf_dir):
    """Labels carried over calls, apart by the last two call sites."""
    k = F.col("p_partkey")
    p = load(spark, sf_dir, "part")
    calls = p.select(F.concat(F.lit("s"), k.cast("string")).alias("site"), k.alias("caller"), _callee().alias("callee"))
    seeds = p.where("p_size <= 3").select(k.alias("func"), (F.col("p_size") % 2).alias("label"))
    return summaries.in_contexts(calls, seeds, 2).select("func", F.array_join("context", ">").alias("context"), "label")


@query(f"""WITH {ft.TAINT}, a AS (SELECT id, id % 6 AS func, row_number() OVER (PARTITION BY id ORDER BY sink, source, tau, kappa, sigma) - 1 AS pos, tau, kappa, sigma FROM taint),
s AS (SELECT *, id % 6 AS f, least(pos, 2) AS place FROM a), m AS (SELECT *, CASE WHEN f = 5 THEN false ELSE place IN (0, 2) END AS flows FROM s)
SELECT id AS call, coalesce(bit_or(tau) FILTER (flows), 0) AS tau,
  coalesce(bit_and(kappa) FILTER (flows), {taint.KAPPA_ALL}) | CASE WHEN any_value(f) = 1 THEN {taint.mask('HTML_ESCAPE')} ELSE 0 END AS kappa,
  CASE WHEN any_value(f) = 1 THEN 0 ELSE coalesce(bit_or(sigma | CASE WHEN f = 2 AND place = 0 THEN 512 ELSE 0 END) FILTER (flows), 0) END AS sigma FROM m GROUP BY id""")
def call_results(spark, sf_dir):
    """Summaries with two parameters and a rest: one sanitizes and clears, one has a sensitive parameter, one is unknown."""
    rows = ft.taint_rows(spark, sf_dir)
    order = F.array_sort(F.collect_list(F.struct("sink", "source", "tau", "kappa", "sigma")))
    args = rows.groupBy("id").agg(order.alias("l")).select("id", F.posexplode("l").alias("pos", "x")).select(F.col("id").alias("call"), (F.col("id") % 6).alias("func"), "pos", "x.tau", "x.kappa", "x.sigma")
    known = [(i, 2, [0, 2], [0] if i == 2 else [], taint.mask("HTML_ESCAPE") if i == 1 else None, i == 1, 3) for i in range(5)]
    of = spark.createDataFrame(known, "func long, n_params int, to_return array<int>, sensitive array<int>, sanitizes long, clears boolean, introduces int")
    return taint.results_of_calls(args, of)


# graphs and threads -----------------------------------------------------------------------------------------------


@query(f"WITH {ft.EDGES} SELECT dst AS src, src AS dst FROM edges")
def reverse_edges(spark, sf_dir):
    return graph.reverse(ft.part_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {ft.EDGES}, k AS (SELECT src, dst FROM edges WHERE src % 5 <> 4), r AS (SELECT 3 AS node UNION SELECT dst FROM r JOIN k ON src = node)
SELECT count(*) > 0 AS propagates FROM r WHERE node = 12""")
def guard_flow(spark, sf_dir):
    e = ft.part_edges(spark, sf_dir).withColumn("preserves", F.col("src") % 5 != 4)
    return graph.guard_propagates(e, 3, 12)


@query(f"WITH RECURSIVE {ft.EDGES}, c AS (SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM c JOIN edges e ON c.dst = e.src) SELECT (SELECT count(*) FROM part WHERE p_size < 1) = 0 AND count(*) > 0 AS deadlock FROM c WHERE src = dst")
def deadlock(spark, sf_dir):
    """Parts as threads that wait for another; one of size 0 would run."""
    threads = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("thread"), F.when(F.col("p_size") < 1, "running").otherwise("blocked").alias("state"))
    return concurrency.all_blocked(threads, ft.part_edges(spark, sf_dir))


@query(f"""WITH {_ACC} SELECT location, id % 3 AS thread, count(*) AS n FROM acc WHERE location IN (SELECT location FROM unlocked) AND is_write GROUP BY ALL""")
def writes_at_races(spark, sf_dir):
    """Writes at unlocked locations by another dealing of threads."""
    acc = _accesses(spark, sf_dir)
    return acc.join(concurrency.unlocked_locations(acc), "location", "left_semi").where("is_write").groupBy("location", (F.col("id") % 3).alias("thread")).agg(F.count("*").alias("n"))


@query()
def ice_conjunction(spark, sf_dir):
    """Predicates about samples made of parts: some fail on positive samples, some only on negative ones, some where an implication leads.

    What must be dropped depends on all that is kept, which has no SQL; a test tries it at full size.
    """
    k, s = F.col("p_partkey"), F.col("p_size")
    p = load(spark, sf_dir, "part")
    kind = F.when(k % 11 == 0, "positive").when(k % 13 == 0, "negative").otherwise("state")
    rows = dealt(p.select(k.alias("k"), kind.alias("kind"), s.alias("s"))).select("*", F.explode(F.sequence(F.lit(0), F.lit(69))).alias("pred"))
    pred, own = F.col("pred"), F.col("k") % 11 != 0
    fails = (F.col("s") == pred) | (pred.between(60, 64) & F.pmod("k", F.lit(13)).isin(0, 12) & own) | ((pred >= 65) & (F.col("s") % 20 == pred * 7 % 20) & own)
    implied = p.where((k % 13 != 11) & (k % 11 != 0)).select(k.alias("pre"), (k + 1).alias("post"))
    return dataflow.ice_conjunction(rows.select("pred", F.col("k").alias("sample"), "kind", (~fails).alias("holds")), implied)


# calls, names, places ---------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT DISTINCT 'm' || CAST(p_size AS VARCHAR) || '.f' || CAST(p_partkey % 9 AS VARCHAR) AS name, p_partkey AS k FROM part)
SELECT 'pkg.' || name AS name, count(*) AS n FROM n WHERE k % 4 = 0 GROUP BY 1""")
def callers_of_names(spark, sf_dir):
    """How many functions call something of each simple name that is asked for."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("pkg.m"), F.col("p_size").cast("string"), F.lit(".f"), (k % 9).cast("string"))
    p = load(spark, sf_dir, "part")
    calls = p.where(k % 4 == 0).select(k.alias("src"), F.concat(F.lit("x."), F.translate(name, ".", "_")).alias("name"))
    found = matching.callers_of(calls, calls.select(F.element_at(F.split("name", r"\."), -1).alias("name")))
    back = F.regexp_replace(F.regexp_replace("name", "^pkg_", "pkg."), "_f", ".f")
    return found.groupBy(back.alias("name")).agg(F.count("*").alias("n"))


@query("""SELECT 'f' || CAST(p_size % 9 AS VARCHAR) AS name, 'm' || CAST(p_partkey AS VARCHAR) || '.f' || CAST(p_size % 9 AS VARCHAR) AS qname FROM part WHERE p_size % 9 IN (2, 5)""")
def definitions_of_names(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    last = (F.col("p_size") % 9).cast("string")
    functions = p.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit(".f"), last).alias("qname"))
    return matching.definitions_of(functions, spark.createDataFrame([("f2",), ("f5",), ("f99",)], "name string"))


@query("""SELECT 'C' || CAST(p_partkey AS VARCHAR) || '.go' AS src, 'self.m' || CAST(p_size % 3 AS VARCHAR) AS name, CASE WHEN p_size % 3 = 1 THEN 'C' || CAST(p_partkey AS VARCHAR) || '.m1' END AS target FROM part""")
def self_calls(spark, sf_dir):
    """Every class has a method m1 and calls one of three."""
    p = load(spark, sf_dir, "part")
    own = lambda m: F.concat(F.lit("C"), F.col("p_partkey").cast("string"), F.lit(m))
    calls = p.select(own(".go").alias("src"), F.concat(F.lit("self.m"), (F.col("p_size") % 3).cast("string")).alias("name"))
    return matching.resolve_self_calls(calls, p.select(own(".m1").alias("qname")))


@query("""WITH n AS (SELECT p_partkey AS k, p_partkey % 4 AS kind, 'a.b' || CAST(p_partkey AS VARCHAR) || '.C.f' AS name FROM part)
SELECT name, CASE kind WHEN 0 THEN 'src/x.py' WHEN 1 THEN 'a/b' || CAST(k AS VARCHAR) || '.py' WHEN 2 THEN 'a.py' ELSE 'a/b' || CAST(k AS VARCHAR) || '/C.py' END AS file, CASE kind WHEN 0 THEN k % 50 + 1 ELSE 1 END AS line FROM n""")
def function_places(spark, sf_dir):
    """By fact, by the longest module that is there, and by the parent module.  Module a is there for names of kind 2 alone."""
    k = F.col("p_partkey")
    p = load(spark, sf_dir, "part")
    text = k.cast("string")
    root = F.when(k % 4 == 2, "a").otherwise("z")
    name = F.concat(root, F.lit(".b"), text, F.lit(".C.f"))
    functions = p.where(k % 4 == 0).select(name.alias("qname"), F.lit("src/x.py").alias("file"), (k % 50 + 1).cast("int").alias("line"))
    files = p.where(k % 4 == 1).select(F.concat(F.lit("z/b"), text, F.lit(".py")).alias("file")).union(spark.createDataFrame([("a.py",)], "file string"))
    found = matching.locate(p.select(name.alias("name")), functions, files)
    shown = lambda c: F.regexp_replace(c, "^z", "a")
    return found.select(shown("name").alias("name"), shown("file").alias("file"), F.col("line").cast("long").alias("line"))


@query("""SELECT CASE k WHEN 0 THEN '/abs/r' || i WHEN 1 THEN 'own/r' || i WHEN 2 THEN 'Own/R' || i ELSE 'gone/r' || i END AS repo,
  CASE k WHEN 0 THEN '/abs/r' || i WHEN 1 THEN '/work/own__r' || i WHEN 2 THEN '/work/own__r' || i END AS path FROM (SELECT s_suppkey % 4 AS k, CAST(s_suppkey AS VARCHAR) AS i FROM supplier)""")
def clone_paths(spark, sf_dir):
    k, i = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    s = load(spark, sf_dir, "supplier")
    repo = F.when(k == 0, F.concat(F.lit("/abs/r"), i)).when(k == 1, F.concat(F.lit("own/r"), i)).when(k == 2, F.concat(F.lit("Own/R"), i)).otherwise(F.concat(F.lit("gone/r"), i))
    clones = s.where(k < 3).select(F.when(k == 0, F.concat(F.lit("/abs/r"), i)).otherwise(F.concat(F.lit("/work/own__r"), i)).alias("path"))
    return scans.clone_paths(s.select(repo.alias("repo")), clones, "/work/")


# scans and verdicts -----------------------------------------------------------------------------------------------


def _files(spark, sf_dir):
    """Events as scanned files of 40 repositories."""
    e = F.col("event_type")
    verdict = F.when(e == "error", "BUG").when(e == "signup", "UNKNOWN").when(e == "click", "ERROR").otherwise("SAFE")
    return load(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("repo"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), verdict.alias("verdict"))


_FILES = """files AS (SELECT user_id % 40 AS repo, 'f' || CAST(event_id AS VARCHAR) AS path, CASE event_type WHEN 'error' THEN 'BUG' WHEN 'signup' THEN 'UNKNOWN' WHEN 'click' THEN 'ERROR' ELSE 'SAFE' END AS verdict FROM events)"""
_BY_REPO = ", ".join(f"count(*) FILTER (verdict = '{v}') AS \"{v}\"" for v in scans.VERDICTS)


@query(f"WITH {_FILES} SELECT repo, count(*) AS files, {_BY_REPO} FROM files GROUP BY 1")
def repo_scans(spark, sf_dir):
    return scans.by_repo(_files(spark, sf_dir))


@query(f"""WITH {_FILES}, n AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS n FROM files) SELECT repo, count(*) AS files, {_BY_REPO} FROM n WHERE n <= 20 AND repo % 3 = 1 GROUP BY 1""")
def tier_scans(spark, sf_dir):
    """The first 20 files of each repository of the second tier, as the scan of a tier is told."""
    files = _files(spark, sf_dir)
    repos = files.select("repo", (F.col("repo") % 3 + 1).cast("int").alias("tier")).distinct()
    return scans.by_repo(files.join(scans.of_tier(repos, 2), "repo", "left_semi"), 20)


@query("""SELECT event_type AS bug_type, count(*) AS n FROM events WHERE event_id % 5 NOT IN (1, 2) AND event_id % 5 <> 4 GROUP BY 1""")
def project_bugs(spark, sf_dir):
    """Findings of a project outside of migrations and tests, in the parts that are asked for."""
    e = F.col("event_id") % 5
    path = F.when(e == 1, "app/migrations/0001.py").when(e == 2, "app/tests/t.py").when(e == 4, "lib/other.py").otherwise("app/core.py")
    rows = load(spark, sf_dir, "events").select(path.alias("path"), F.col("event_type").alias("bug_type"))
    return scans.bugs_of_project(rows, parts=("app/",))


_PATCHES = [
    ("", False, "no-patch", ""),
    ("diff --git a/tests/test_a.py b/tests/test_a.py\n+x = 1\n", False, "test-only", ""),
    ("+if x is not None:\n-    x.go()\n", True, "null-deref", "NULL_PTR"),
    ("+    if isinstance(x, int):\n+        y(x)\n", True, "type-check", "TYPE_CONFUSION"),
    ("+v = d.get(k)\n-v = d[k]\n", True, "key-error", "BOUNDS"),
    ("+    if i < len(xs):\n", True, "bounds-check", "BOUNDS"),
    ("+    raise ValueError(x)\n", True, "value-error", "ASSERT_FAIL"),
    ("+    if n == 0:\n+        return 0\n-    return a / n\n", True, "div-zero", "DIV_ZERO"),
    ("+except OSError:\n+    pass\n", True, "unhandled-oserror", "ASSERT_FAIL"),
    ("+f.close()\n-f = open(p)\n", True, "resource-leak", "MEMORY_LEAK"),
    ("+if it:\n-    it.step()\n", True, "missing-guard", "NULL_PTR"),
    ("+    return b\n-    return a\n", False, "logic-return", ""),
    ("+import b\n-import a\n", False, "import-reorg", ""),
    ("+y = 2\n+z = 3\n+w = 4\n+v = 5\n", False, "logic", ""),
]


def _case(values) -> str:
    return " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))


@query(f"""SELECT p_partkey AS patch, CASE p_partkey % {len(_PATCHES)} {_case(str(x[1]).lower() for x in _PATCHES)} END AS in_scope, CASE p_partkey % {len(_PATCHES)} {_case(f"'{x[2]}'" for x in _PATCHES)} END AS category,
  CASE p_partkey % {len(_PATCHES)} {_case(f"'{x[3]}'" for x in _PATCHES)} END AS bug_type FROM part""")
def fix_scopes(spark, sf_dir):
    """Patches of known kinds, one for each part; those with code change src.py."""
    head = "diff --git a/src.py b/src.py\n"
    texts = F.array(*(F.lit(t if not t or t.startswith("diff") else head + t) for t, *_ in _PATCHES))
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("patch"), F.get(texts, (F.col("p_partkey") % len(_PATCHES)).cast("int")).alias("text"))
    return scans.scope(rows).select("patch", "in_scope", "category", "bug_type")


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE event_id % 3 = 0 END AS suppressed FROM events""")
def likely_false_positives(spark, sf_dir):
    """Findings in tests, from the command line, without a context, and with a safe loader every third time."""
    e = F.col("event_id") % 4
    path = F.when(e == 0, "pkg/tests/test_a.py").otherwise("src/app.py")
    sources = F.when(e == 1, F.array(F.lit("sys.argv[1]"))).otherwise(F.array().cast("array<string>"))
    sink = F.when((e == 3) & (F.col("event_id") % 3 == 0), "yaml.safe_load").otherwise("cursor.execute")
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), intent.suppressed(path, sources, F.array().cast("array<string>"), sink).alias("suppressed"))


@query("""WITH f AS (SELECT event_id AS id, value / 600 AS c, (CASE WHEN event_id % 2 = 0 THEN 1::DOUBLE - 0.95::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN event_id % 3 = 0 THEN 1::DOUBLE - 0.99::DOUBLE ELSE 1.0::DOUBLE END) AS u FROM events)
SELECT id, round(c * u, 6) AS adjusted, c * u >= 0.25 AS keep FROM f""")
def intended_bugs(spark, sf_dir):
    """Null dereferences in tests half the time, and of self every third time."""
    e = F.col("event_id")
    path, var = F.when(e % 2 == 0, "pkg/tests/test_a.py").otherwise("src/app.py"), F.when(e % 3 == 0, "self").otherwise("x")
    got = load(spark, sf_dir, "events").select(e.alias("id"), intent.judged(path, F.lit("NULL_PTR"), var, F.lit("f"), F.col("value") / 600, 0.25).alias("j"))
    return got.select("id", F.round("j.adjusted", 6).alias("adjusted"), "j.keep")


@query(f"WITH {ft.CURRENT}, {ft.BASELINE}, c AS (SELECT DISTINCT fp FROM current_), b AS (SELECT DISTINCT fp FROM baseline), x AS (SELECT count(*) FILTER (b.fp IS NULL) AS new, count(*) FILTER (c.fp IS NULL) AS fixed, count(*) FILTER (b.fp IS NOT NULL AND c.fp IS NOT NULL) AS kept FROM c FULL JOIN b ON c.fp = b.fp) SELECT new, fixed, kept, new = 0 AS passes FROM x")
def baseline_ratchet(spark, sf_dir):
    old = ft.sarif_rows(spark, sf_dir, False)
    return baseline.ratchet(ft.sarif_rows(spark, sf_dir, True), old.select(baseline.fingerprint().alias("fp")))


# contracts --------------------------------------------------------------------------------------------------------

_SOURCED = ("input", "os.getenv", "getpass.getpass", "plain.call")


@query(f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_size | (1 << {taint.SOURCES.index('USER_INPUT')}) WHEN p_partkey % 4 = 1 THEN p_size | (1 << {taint.SOURCES.index('ENVIRONMENT')}) ELSE p_size END AS tau,
  CASE WHEN p_partkey % 4 = 2 THEN 1 << {taint.SOURCES.index('PASSWORD')} ELSE 0 END AS sigma, CASE WHEN p_partkey % 4 = 3 THEN 7 ELSE 0 END AS kappa FROM part""")
def source_taint(spark, sf_dir):
    """Calls of sources of both kinds and of a function that is none; the registry takes a source of ours."""
    k = F.col("p_partkey")
    calls = load(spark, sf_dir, "part").select(k.alias("id"), F.get(F.array(*map(F.lit, _SOURCED)), (k % 4).cast("int")).alias("name"), F.col("p_size").cast("long").alias("tau"), F.lit(7).cast("long").alias("kappa"), F.lit(0).cast("long").alias("sigma"))
    ours = [(n, taint.SOURCES.index(t), s) for n, t, s in (("input", "USER_INPUT", False), ("os.getenv", "ENVIRONMENT", False), ("getpass.getpass", "PASSWORD", True))]
    return contracts.apply_sources(calls, contracts.sources(spark, ours)).select("id", "tau", "sigma", "kappa")


@query(f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 1 THEN 0 ELSE p_size END AS tau, CASE p_partkey % 3 WHEN 0 THEN 1 | {taint.mask('HTML_ESCAPE')} WHEN 1 THEN 1 | {taint.mask('HASHING')} ELSE 1 END AS kappa,
  CASE WHEN p_partkey % 3 = 1 THEN 0 ELSE 5 END AS sigma FROM part""")
def sanitized_taint(spark, sf_dir):
    """An escape, a hash that clears both kinds of taint, and a function that is no sanitizer."""
    k = F.col("p_partkey")
    calls = load(spark, sf_dir, "part").select(k.alias("id"), F.get(F.array(F.lit("our.escape"), F.lit("our.hash"), F.lit("other")), (k % 3).cast("int")).alias("name"), F.col("p_size").cast("long").alias("tau"), F.lit(1).cast("long").alias("kappa"), F.lit(5).cast("long").alias("sigma"))
    ours = [("our.escape", "HTML_ESCAPE", False, False), ("our.hash", "HASHING", True, True)]
    return contracts.apply_sanitizers(calls, contracts.sanitizers(spark, ours)).select("id", "tau", "kappa", "sigma")


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'json.loads' WHEN 1 THEN '*.append' ELSE '<havoc>' END AS key FROM part""")
def contract_or_havoc(spark, sf_dir):
    k = F.col("p_partkey")
    calls = load(spark, sf_dir, "part").select(k.alias("id"), F.get(F.array(F.lit("json.loads"), F.lit("xs.append"), F.lit("what.ever")), (k % 3).cast("int")).alias("name"))
    known = spark.createDataFrame([("json.loads",), ("*.append",), ("*.loads",)], "key string")
    return calls.join(contracts.contract_or_havoc(calls, known), "name").select("id", "key")


@query("""SELECT event_id AS call, CASE WHEN event_id % 2 = 1 THEN NULL WHEN value < 100 THEN 0 WHEN value <= 300 THEN 1 ELSE 2 END AS ordinal, CASE WHEN event_id % 2 = 1 THEN NULL WHEN value < 100 THEN -value WHEN value <= 300 THEN value + 1 ELSE 0 END AS result FROM events""")
def case_summaries(spark, sf_dir):
    """A summary of three cases, whose last is the fallback; every second call is of a function without one."""
    calls = load(spark, sf_dir, "events").select(F.col("event_id").alias("call"), F.when(F.col("event_id") % 2 == 0, "clamp").otherwise("other").alias("name"), "value")
    types = "name string, ordinal int, low double, high double, add double, times double"
    old = spark.createDataFrame([("clamp", 0, None, None, 9.0, 9.0)], types)
    new = spark.createDataFrame([("clamp", 0, None, 99.999999, 0.0, -1.0), ("clamp", 1, 100.0, 300.0, 1.0, 1.0), ("clamp", 2, None, None, 0.0, 0.0)], types)
    return contracts.by_cases(calls, contracts.register_cases(old, new)).select("call", "ordinal", "result")


@query("""SELECT event_id AS id, least(1.0, greatest(0.0, CASE WHEN event_id % 3 = 0 THEN value / 400 - 0.1 ELSE value / 300 END)) AS confidence FROM events""")
def derived_confidence(spark, sf_dir):
    v = F.col("value")
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), scoring.derived_confidence(F.when(F.col("event_id") % 3 == 0, v / 400 - 0.1), v / 300).alias("confidence"))


@query("""WITH s AS (SELECT user_id AS k, bool_or(event_type = 'error') AS untrusted, bool_or(event_type = 'click') AS sensitive, list_sort(list(DISTINCT 'l' || CAST(event_id % 4 AS VARCHAR))) AS labels,
  count(DISTINCT event_id % 3) AS kinds, min(event_id % 3) AS least FROM events GROUP BY 1)
SELECT k, untrusted, sensitive, array_to_string(labels, ',') AS labels, CASE WHEN kinds = 1 THEN 'all,s' || CAST(least AS VARCHAR) ELSE 'all' END AS sanitizers FROM s""")
def merged_states(spark, sf_dir):
    e = F.col("event_id")
    text = lambda p, n: F.concat(F.lit(p), (e % n).cast("string"))
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("k"), (F.col("event_type") == "error").alias("untrusted"), (F.col("event_type") == "click").alias("sensitive"), F.array(text("l", 4)).alias("labels"), F.array(F.lit("all"), text("s", 3)).alias("sanitizers"))
    return taint.merge_states(rows, "k").select("k", "untrusted", "sensitive", F.array_join("labels", ",").alias("labels"), F.array_join("sanitizers", ",").alias("sanitizers"))


# cheap proofs -----------------------------------------------------------------------------------------------------

_VARS = ("batch_size", "n_items", "x", "result", "self", "handle", "count", "idx", "obj_ref", "total", "", "width")
_FUNCS = ("test_run", "_load", "__len__", "get_rows", "run", "__call__", "update", "fit", "demo_case", "solve")
_KINDS = ("DIV_ZERO", "NULL_PTR", "BOUNDS", "VALUE_ERROR", "KEY_ERROR", "RUNTIME_ERROR")
_PREDS = ("positive", "nonnegative", "nullable", "nonnull", "inbounds", "nonempty", "nonzero")
_PICK = lambda of, key: f"list_extract([{', '.join(repr(v) for v in of)}], CAST(({key}) % {len(of)} + 1 AS INT))"
_VALUES = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for r in rows)
_NAMED = lambda rows, test: " ".join(f"WHEN {test.format(p)} THEN {v}" for p, v in rows)


@query(f"""WITH b AS (SELECT event_id AS bug, user_id AS func, {_PICK(_KINDS, 'event_id // 7')} AS t, {_PICK(_VARS, 'event_id')} AS var, {_PICK(_FUNCS, 'user_id')} AS name FROM events),
u AS (SELECT DISTINCT user_id AS func FROM events),
re AS (SELECT func, 0 AS ord, {_PICK(_VARS, 'func')} AS var, {_PICK(_PREDS, 'func')} AS pred, 0.95 AS strength FROM u WHERE func % 3 = 0 UNION ALL SELECT func, 1, {_PICK(_VARS, 'func // 2')}, {_PICK(_PREDS, 'func // 5')}, 0.9 FROM u),
w(t, pred, factor) AS (VALUES {_VALUES(proofs.PREDICATES)}),
p1 AS (SELECT bug, arg_min(struct_pack(c := strength * factor), ord).c AS c FROM b JOIN re USING (func) JOIN w ON w.t = b.t AND w.pred = re.pred WHERE b.var = re.var OR b.var = 'param_' || re.var GROUP BY 1),
ob AS (SELECT {_PICK(_VARS, 'event_id')} AS var, CASE WHEN event_id % 12 IN (3, 4) THEN 'nonnull' WHEN value > 15 THEN 'nonzero' ELSE 'other' END AS prop FROM events),
h AS (SELECT var, prop, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY var) AS share FROM ob GROUP BY 1, 2),
p2 AS (SELECT bug, share AS c FROM b JOIN h USING (var) WHERE n >= 5 AND ((t = 'DIV_ZERO' AND prop = 'nonzero' AND share >= 0.9) OR (t = 'NULL_PTR' AND prop = 'nonnull' AND share >= 0.95))),
i AS (SELECT func, {_PICK(_VARS, 'func // 3')} AS var, CASE WHEN func % 5 <> 0 THEN func % 7 - 2 END AS lo, func % 7 + 4 AS hi FROM u),
p3 AS (SELECT bug, CASE WHEN t = 'DIV_ZERO' THEN 1.0 ELSE 0.9 END AS c FROM b JOIN i USING (func, var) WHERE (t = 'DIV_ZERO' AND (coalesce(lo > 0, false) OR hi < 0)) OR (t = 'BOUNDS' AND lo >= 0)),
g AS (SELECT func, {_PICK(_VARS, 'func // 4')} AS var, {_PICK(('NONE_CHECK', 'ZERO_CHECK', 'BOUNDS_CHECK', 'TYPE_CHECK'), 'func')} AS guard FROM u WHERE func % 2 = 0),
ow AS (SELECT func, {_PICK(_VARS, 'func // 6')} AS var FROM u WHERE func % 5 = 1),
p4 AS (SELECT bug, CASE WHEN EXISTS (SELECT 1 FROM ow WHERE ow.func = b.func AND ow.var = b.var) THEN 1.0 ELSE 0.95 END AS c FROM b WHERE t = 'NULL_PTR' AND
  (EXISTS (SELECT 1 FROM ow WHERE ow.func = b.func AND ow.var = b.var) OR EXISTS (SELECT 1 FROM g WHERE g.func = b.func AND g.var = b.var AND guard = 'NONE_CHECK'))),
s AS (SELECT bug, CASE WHEN (t, guard) IN (('DIV_ZERO', 'ZERO_CHECK'), ('NULL_PTR', 'NONE_CHECK')) THEN 0.95 WHEN (t, guard) = ('BOUNDS', 'BOUNDS_CHECK') THEN 0.9 WHEN guard IS NOT NULL THEN 0.75 WHEN b.func % 3 = 1 AND t = 'KEY_ERROR' THEN 0.85 ELSE 0.4 END * 0.30
  + CASE WHEN var = '' THEN 0.5 WHEN t IN ('DIV_ZERO', 'BOUNDS') THEN CASE {_NAMED(proofs.SIZE_NAMES, "contains(var, '{}')")} WHEN var = 'x' THEN 0.5 ELSE 0.55 END
    WHEN t = 'NULL_PTR' THEN CASE {_NAMED(proofs.OBJECT_NAMES, "regexp_matches(var, '^{}(_|$)')")} WHEN var = 'x' THEN 0.5 ELSE 0.55 END WHEN var = 'x' THEN 0.5 ELSE 0.55 END * 0.20
  + CASE name WHEN 'test_run' THEN 0.9 WHEN 'demo_case' THEN 0.9 WHEN '_load' THEN 0.8 WHEN '__len__' THEN 0.9 WHEN '__call__' THEN 0.75 WHEN 'get_rows' THEN 0.7 ELSE 0.6 END * 0.25
  + CASE t WHEN 'VALUE_ERROR' THEN 0.7 WHEN 'KEY_ERROR' THEN 0.55 WHEN 'BOUNDS' THEN 0.55 WHEN 'NULL_PTR' THEN 0.6 ELSE 0.65 END * 0.15
  + (0.5 + CASE WHEN b.func % 2 = 0 THEN 0.15 ELSE 0 END + CASE WHEN b.func % 3 = 0 THEN 0.1 ELSE 0 END + CASE WHEN b.func % 4 = 0 THEN 0.05 ELSE 0 END) * 0.10 AS q FROM b LEFT JOIN g USING (func, var)),
p5 AS (SELECT bug, q * 0.7 / (q * 0.7 + (1 - q) * 0.3) AS c FROM s),
a AS (SELECT bug, 1 AS o, 'refinement_types' AS k, c FROM p1 WHERE c > 0.8 UNION ALL SELECT bug, 2, 'likely_invariants', c FROM p2 WHERE c > 0.85 UNION ALL SELECT bug, 3, 'interval_analysis', c FROM p3
  UNION ALL SELECT bug, 4, 'separation_logic', c FROM p4 UNION ALL SELECT bug, 5, 'stochastic_barriers', c FROM p5 WHERE c > 0.7)
SELECT bug, coalesce(arg_min(k, o), 'none') AS technique, round(CAST(coalesce(arg_min(c, o), 0) AS DOUBLE), 6) AS confidence FROM b LEFT JOIN a USING (bug) GROUP BY 1""")
def proof_cascade(spark, sf_dir):
    """The first of five proofs for each event as a reported bug; every one of them decides some."""
    c = F.col
    pick = lambda of, key: F.element_at(F.array(*map(F.lit, of)), (key % len(of) + 1).cast("int"))
    part = lambda key, n: F.floor(key / n)
    events, e, f = load(spark, sf_dir, "events"), c("event_id"), c("func")
    bugs = events.select(e.alias("bug"), pick(_KINDS, part(e, 7)).alias("bug_type"), pick(_VARS, e).alias("var"), c("user_id").alias("func"), pick(_FUNCS, c("user_id")).alias("name"))
    funcs = events.select(c("user_id").alias("func")).distinct()
    refined = funcs.where(f % 3 == 0).select("func", F.lit(0).alias("ordinal"), pick(_VARS, f).alias("var"), pick(_PREDS, f).alias("predicate"), F.lit(0.95).alias("strength"))
    refined = refined.union(funcs.select("func", F.lit(1), pick(_VARS, part(f, 2)), pick(_PREDS, part(f, 5)), F.lit(0.9)))
    seen = events.select(pick(_VARS, e).alias("var"), F.when((e % 12).isin(3, 4), "nonnull").when(c("value") > 15, "nonzero").otherwise("other").alias("prop"))
    ranges = funcs.select("func", pick(_VARS, part(f, 3)).alias("var"), F.when(f % 5 != 0, f % 7 - 2).alias("lo"), (f % 7 + 4).alias("hi"))
    guards = funcs.where(f % 2 == 0).select("func", pick(_VARS, part(f, 4)).alias("var"), pick(("NONE_CHECK", "ZERO_CHECK", "BOUNDS_CHECK", "TYPE_CHECK"), f).alias("guard"))
    owned = funcs.where(f % 5 == 1).select("func", pick(_VARS, part(f, 6)).alias("var"))
    guarded = funcs.where(f % 3 == 1).select("func", F.lit("KEY_ERROR").alias("bug_type"))
    traits = funcs.select("func", (f % 2 == 0).alias("handles"), (f % 3 == 0).alias("raises"), (f % 4 == 0).alias("loops"))
    found = {
        "refinement_types": proofs.by_refinement(bugs, refined), "likely_invariants": proofs.by_habit(bugs, proofs.habits(seen)), "interval_analysis": proofs.by_interval(bugs, ranges),
        "separation_logic": proofs.by_ownership(bugs, owned, guards), "stochastic_barriers": proofs.chances(bugs, guards, guarded, traits),
    }
    return proofs.cascade(bugs, found).withColumn("confidence", F.round("confidence", 6))


# loops that end, scans that go on ---------------------------------------------------------------------------------


@query("""WITH t AS (SELECT l_partkey AS loop, l_orderkey * 10 + l_linenumber AS id, l_quantity - 3 AS i, l_linenumber AS j, l_partkey % 4 AS kind, l_suppkey FROM lineitem),
s AS (SELECT loop, id, i, j, CASE WHEN kind = 0 THEN i - 1 WHEN kind = 3 AND l_suppkey % 50 = 0 THEN i + 1 WHEN j > 1 THEN i ELSE i - 1 END AS i2, CASE WHEN kind = 0 THEN j + 1 WHEN j > 1 THEN j - 1 ELSE 7 END AS j2, kind FROM t),
m AS (SELECT loop, id, CASE WHEN kind = 1 THEN 2 * i + 2 * kind ELSE i + 2 * kind END AS a, CASE WHEN kind = 1 THEN 2 * i2 + 2 * kind ELSE i2 + 2 * kind END AS a2, CASE WHEN kind > 0 THEN j END AS b, CASE WHEN kind > 0 THEN j2 END AS b2 FROM s),
v AS (SELECT loop, id, a >= 0 AND coalesce(b >= 0, true) AS ok, CASE WHEN a2 <> a THEN a2 < a ELSE coalesce(b2 < b, false) END AS falls FROM m)
SELECT loop, bool_and(ok AND falls) AS terminates, bool_and(ok) AS bounded, bool_and(falls) AS decreasing, count(*) AS n, min(id) FILTER (NOT ok) AS unbounded_at, min(id) FILTER (NOT falls) AS not_decreasing_at FROM v GROUP BY 1""")
def ranking_verdicts(spark, sf_dir):
    """Turns of loops over one or two counters, made of lines; some loops turn the wrong way, some fall below zero."""
    c = F.col
    kind = c("l_partkey") % 4
    i, j = (c("l_quantity") - 3).cast("double"), c("l_linenumber").cast("double")
    i2 = F.when(kind == 0, i - 1).when((kind == 3) & (c("l_suppkey") % 50 == 0), i + 1).when(j > 1, i).otherwise(i - 1)
    j2 = F.when(kind == 0, j + 1).when(j > 1, j - 1).otherwise(F.lit(7.0))
    state = lambda a, b: F.create_map(F.lit("i"), a, F.lit("j"), b)
    lines = load(spark, sf_dir, "lineitem")
    turns = lines.select(c("l_partkey").alias("loop"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), state(i, j).alias("before"), state(i2, j2).alias("after"))
    loops = lines.select(c("l_partkey").alias("loop")).distinct().withColumn("kind", c("loop") % 4)
    outer = loops.select("loop", F.lit(0).alias("level"), (2 * c("kind")).cast("double").alias("constant"), F.create_map(F.lit("i"), F.when(c("kind") == 1, 2.0).otherwise(1.0)).alias("weights"))
    inner = loops.where("kind > 0").select("loop", F.lit(1), F.lit(0.0), F.create_map(F.lit("j"), F.lit(1.0)))
    return ranking.verdicts(outer.union(inner), turns)


@query("""WITH f AS (SELECT p_partkey AS k, r.r AS revision, 'm' || CAST(p_partkey AS VARCHAR) || '.py' AS path, CASE WHEN p_partkey % 10 = r.r THEN NULL WHEN r.r < p_size % 4 THEN p_name ELSE p_name || ' eval(x)' END AS text FROM part CROSS JOIN (VALUES (1), (2), (3)) AS r(r)),
n AS (SELECT path, text, min(revision) AS at FROM f WHERE text IS NOT NULL GROUP BY 1, 2)
SELECT f.revision, f.path, CASE WHEN contains(f.text, 'eval(') THEN 'BUG' WHEN f.text IS NOT NULL THEN 'SAFE' END AS verdict, CASE WHEN n.at <= 2 THEN 'first' WHEN n.at = 3 THEN 'second' END AS run FROM f LEFT JOIN n ON n.path = f.path AND n.text = f.text""")
def resumed_scans(spark, sf_dir):
    """Three revisions of each part's file, scanned in two runs: the second analyses only what the first had not seen."""
    k, s = F.col("p_partkey"), F.col("p_size")
    r = F.col("revision")
    files = load(spark, sf_dir, "part").withColumn("revision", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    text = F.when(k % 10 == r, F.lit(None)).when(r < s % 4, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" eval(x)")))
    files = files.select("revision", F.concat(F.lit("m"), k.cast("string"), F.lit(".py")).alias("path"), text.alias("text"))
    analyse = lambda run: lambda part: part.select("path", "content", F.when(F.col("text").contains("eval("), "BUG").otherwise("SAFE").alias("verdict"), F.lit(run).alias("run"))
    store = scratch(spark, "scans")
    resume.scan(files.where("revision < 3"), analyse("first"), store, 2)
    return resume.scan(files, analyse("second"), store, 2).select("revision", "path", "verdict", "run")


# sets of guards, instructions -------------------------------------------------------------------------------------

_ASKS = [(f"g{i}", [f"g{i}"]) for i in range(5)] + [("g0|g1", ["g0", "g1"]), ("g2|g3|g4", ["g2", "g3", "g4"])]


@query(f"""WITH RECURSIVE {_FLOW}, g AS (SELECT block, bit_or(1 << CAST(substr(guard, 2) AS INT)) AS own FROM gen GROUP BY 1),
st AS (SELECT block, 0 AS bits FROM p WHERE pos = 0 UNION SELECT s.dst, st.bits | coalesce(g.own, 0) FROM st LEFT JOIN g USING (block) JOIN succ s ON s.src = st.block),
a(ask, mask) AS (VALUES {', '.join(f"('{n}', {sum(1 << int(x[1]) for x in of)})" for n, of in _ASKS)})
SELECT block, ask, bool_and(bits & mask <> 0) AS on_all, bool_or(bits & mask <> 0) AS on_any FROM st CROSS JOIN a GROUP BY ALL""")
def guarded_by_any(spark, sf_dir):
    """All five guards, one by one and in two groups of which one is enough; the oracle follows all sets of guards."""
    blocks, succ, gen = _flow(_functions(spark, sf_dir))
    return dataflow.guarded_by_any(blocks, succ, gen, spark.createDataFrame(_ASKS, "ask string, guards array<string>"))


#: An instruction, and what its operands are: the value before, and the one before that.
_CODE = (
    ("binary", "left", "right"), ("subscript", "container", "index"), ("attribute", "object", "name"), ("call", "callee", "argument"), ("format", "value", "spec"), ("store_subscript", "index", "value"),
    ("compare", "left", "right"), ("call", "argument", "summary"), ("unpack", "sequence", "count"), ("import", "name", "level"), ("build_map", "key", "value"), ("nothing", "left", "right"),
)
_GIVES = [((op, a) in taint.TRANSFERS, (op, b) in taint.TRANSFERS) for op, a, b in _CODE]


@query(f"""WITH RECURSIVE v AS (SELECT p_partkey AS k, p_partkey // 40 AS g, p_partkey % 40 AS pos, p_size AS s FROM part),
r(op, one, two) AS (VALUES {', '.join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(_GIVES))}),
x AS (SELECT g, pos, CASE WHEN s % 9 = 0 THEN 1 << (s % 5) ELSE 0 END AS t0, CASE WHEN s % 9 = 0 THEN {taint.KAPPA_ALL} - (1 << (s % 7)) ELSE {taint.KAPPA_ALL} END AS k0, CASE WHEN s % 9 = 0 THEN 1 << (s % 3) ELSE 0 END AS s0, s % 9 = 0 AS known, one, two FROM v JOIN r ON r.op = s % 12),
f AS (SELECT g, pos, t0 AS t1, k0 AS k1, s0 AS s1, 0::BIGINT AS t2, {taint.KAPPA_ALL}::BIGINT AS k2, 0::BIGINT AS s2 FROM x WHERE pos = 0 UNION ALL
  SELECT x.g, x.pos, CASE WHEN known THEN t0 ELSE CASE WHEN one THEN t1 ELSE 0 END | CASE WHEN two THEN t2 ELSE 0 END END,
    CASE WHEN known THEN k0 ELSE CASE WHEN one THEN k1 ELSE {taint.KAPPA_ALL} END & CASE WHEN two THEN k2 ELSE {taint.KAPPA_ALL} END END,
    CASE WHEN known THEN s0 ELSE CASE WHEN one THEN s1 ELSE 0 END | CASE WHEN two THEN s2 ELSE 0 END END, t1, k1, s1 FROM f JOIN x ON x.g = f.g AND x.pos = f.pos + 1)
SELECT g * 40 + pos AS value, t1 AS tau, k1 AS kappa, s1 AS sigma FROM f""")
def instruction_labels(spark, sf_dir):
    """Each part is an instruction over the two before it, in bodies of 40; every ninth size is a source instead."""
    k, s = F.col("p_partkey"), F.col("p_size")
    p = load(spark, sf_dir, "part")
    code = F.element_at(F.array(*(F.struct(*map(F.lit, x)) for x in _CODE)), (s % 12 + 1).cast("int"))
    made = p.where("p_size % 9 <> 0").select(k.alias("value"), code.alias("c"))
    near = lambda role, far: made.where(F.col("value") % 40 >= far).select("value", F.col("c")[role].alias("role"), (F.col("value") - far).alias("of"))
    operands = near("col2", 1).union(near("col3", 2))
    bit = lambda n: F.expr(f"shiftleft(1L, cast(p_size % {n} as int))")
    known = p.where("p_size % 9 = 0").select(k.alias("value"), bit(5).alias("tau"), (F.lit(taint.KAPPA_ALL) - bit(7)).alias("kappa"), bit(3).alias("sigma"))
    instructions = p.select(k.alias("value"), F.when(s % 9 == 0, "source").otherwise(code["col1"]).alias("op"))
    return summaries.transferred(instructions, operands, known)


# environments -----------------------------------------------------------------------------------------------------

_STEPS = ("const", "add", "subtract", "add", "scale", "multiply", "check_division", "check_null", "check_index", "copy")
_OF = lambda name, var: f"{name}[{var} + 1]"


@query(f"""WITH RECURSIVE s AS (SELECT p_partkey // 40 AS func, p_partkey % 40 AS pos, (p_partkey + p_size) % 10 AS op, p_size % 4 AS t, p_size // 4 % 4 AS a, p_size // 16 % 4 AS b, p_size AS n,
  CASE (p_partkey + p_size) % 10 WHEN 3 THEN p_size % 3 - 1 WHEN 4 THEN p_size % 5 - 2 ELSE p_size % 7 - 3 END AS c, CASE (p_partkey + p_size) % 10 WHEN 3 THEN p_size % 3 ELSE p_size % 7 - 3 + p_size % 3 END AS d FROM part),
e AS (SELECT func, -1::BIGINT AS pos, ['-inf', '-inf', '-inf', '-inf']::DOUBLE[] AS l, ['inf', 'inf', 'inf', 'inf']::DOUBLE[] AS h, ['maybe', 'maybe', 'maybe', 'maybe'] AS o, 0::DOUBLE AS x, 0::DOUBLE AS y, '' AS z, -1::BIGINT AS op, 0::BIGINT AS n FROM s WHERE pos = 0 UNION ALL
  SELECT func, pos, list_transform([0, 1, 2, 3], lambda i: CASE WHEN i = t AND op NOT IN (6, 7, 8) THEN x ELSE {_OF('l', 'i')} END), list_transform([0, 1, 2, 3], lambda i: CASE WHEN i = t AND op NOT IN (6, 7, 8) THEN y ELSE {_OF('h', 'i')} END),
    list_transform([0, 1, 2, 3], lambda i: CASE WHEN i = t AND op NOT IN (6, 7, 8) THEN z ELSE {_OF('o', 'i')} END), x, y, z, op, n
  FROM (SELECT *, CASE op WHEN 0 THEN c WHEN 1 THEN la + lb WHEN 2 THEN la - hb WHEN 3 THEN la + c WHEN 4 THEN CASE WHEN c = 0 THEN 0 WHEN c > 0 THEN la * c ELSE ha * c END WHEN 5 THEN coalesce(list_min(ps), '-inf'::DOUBLE) ELSE la END AS x,
      CASE op WHEN 0 THEN d WHEN 1 THEN ha + hb WHEN 2 THEN ha - lb WHEN 3 THEN ha + d WHEN 4 THEN CASE WHEN c = 0 THEN 0 WHEN c > 0 THEN ha * c ELSE la * c END WHEN 5 THEN coalesce(list_max(ps), 'inf'::DOUBLE) ELSE ha END AS y,
      CASE WHEN op = 0 THEN CASE WHEN n % 11 = 0 THEN 'yes' WHEN n % 5 = 0 THEN 'maybe' ELSE 'no' END WHEN op IN (6, 7, 8, 9) THEN oa ELSE 'no' END AS z
    FROM (SELECT *, list_filter([la * lb, la * hb, ha * lb, ha * hb], lambda q: NOT isnan(q)) AS ps FROM (
      SELECT s.*, l, h, o, {_OF('l', 'a')} AS la, {_OF('h', 'a')} AS ha, {_OF('o', 'a')} AS oa, {_OF('l', 'b')} AS lb, {_OF('h', 'b')} AS hb FROM e JOIN s ON s.func = e.func AND s.pos = e.pos + 1))))
SELECT func, pos, {list(_STEPS)!r}[op + 1] AS kind, CASE WHEN x = 0 THEN 0 WHEN isfinite(x) THEN x END AS lo, CASE WHEN y = 0 THEN 0 WHEN isfinite(y) THEN y END AS hi, z AS none,
  CASE op WHEN 6 THEN CASE WHEN x > 0 OR y < 0 THEN 'SAFE' WHEN x = 0 AND y = 0 THEN 'UNSAFE' ELSE 'UNKNOWN' END WHEN 7 THEN CASE z WHEN 'no' THEN 'SAFE' WHEN 'yes' THEN 'UNSAFE' ELSE 'UNKNOWN' END
    WHEN 8 THEN CASE WHEN x >= 0 AND y <= n - 1 THEN 'SAFE' WHEN y < 0 OR x > n - 1 THEN 'UNSAFE' ELSE 'UNKNOWN' END END AS verdict FROM e WHERE pos >= 0""")
def tracked_values(spark, sf_dir):
    """Parts as statements over four variables, in functions of 40 that are cut into segments of 12; the oracle carries all variables along."""
    k, s = F.col("p_partkey"), F.col("p_size")
    op = (k + s) % 10
    var = lambda n: F.concat(F.lit("v"), (F.floor(s / n) % 4).cast("string"))
    kind = F.element_at(F.array(*map(F.lit, _STEPS)), (op + 1).cast("int"))
    lo = F.when(op == 3, s % 3 - 1).when(op == 4, s % 5 - 2).when(op == 8, s).otherwise(s % 7 - 3).cast("double")
    hi = F.when(op == 3, s % 3).otherwise(s % 7 - 3 + s % 3).cast("double")
    rows = load(spark, sf_dir, "part").select(
        F.floor(k / 40).alias("func"), (k % 40).alias("pos"), kind.alias("kind"), var(1).alias("target"), var(4).alias("left"), F.when(op != 3, var(16)).alias("right"), lo.alias("lo"), hi.alias("hi"),
        F.when(s % 11 == 0, "yes").when(s % 5 == 0, "maybe").otherwise("no").alias("none"),
    )
    return environments.tracked(rows, 12)
