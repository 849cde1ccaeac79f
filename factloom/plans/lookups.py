"""Queries of plain records: filters, lookups, places, groups.  The SQL of each is what it must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import intent
from factloom.operators import matching, records
from factloom.plans.registry import load, query


@query("""SELECT l_orderkey AS id, l_linenumber AS line, l_extendedprice AS price, l_extendedprice * (1 - CAST(15 AS DOUBLE) / 100) AS discounted, round(l_extendedprice * l_tax, 6) AS tax, l_discount / nullif(l_tax, 0) AS share, l_tax AS second,
  CASE WHEN l_linenumber % 2 = 0 THEN 'b=2' ELSE 'c=3' END AS test, round(0.1 * pow(0.5, l_linenumber), 9) AS rate FROM lineitem""")
def record_fields(spark, sf_dir):
    """A nested field, an element of an array, a normalised one, a discount, a tax, a test of a clause, a learning rate."""
    c = F.col
    rows = load(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), F.struct(F.struct(c("l_extendedprice").alias("price")).alias("item")).alias("r"), F.array("l_discount", "l_tax").alias("v"), c("l_tax"), F.lit("a=1 AND b=2 AND c=3").alias("clause")
    )
    price = records.field("r.item.price")
    return rows.select(
        "id", "line", price.alias("price"), records.discount(price, F.lit(15.0)).alias("discounted"), F.round(records.tax(price, c("l_tax")), 6).alias("tax"), records.element(records.normalized(c("v"), c("l_tax")), 0).alias("share"),
        records.element(c("v"), 1).alias("second"), F.when(c("line") % 2 == 0, records.where_part(c("clause"), 1)).otherwise(records.where_part(c("clause"), -1)).alias("test"), F.round(records.learning_rate(0.1, 0.5, c("line")), 9).alias("rate"),
    )


@query("""SELECT 'category' AS kind, p_partkey AS id FROM part WHERE p_brand = 'Brand#13' UNION ALL SELECT 'search', p_partkey FROM part WHERE contains(lower(p_name), 'ring') UNION ALL
SELECT 'status', o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'successful', l_orderkey FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT 'active', c_custkey FROM customer WHERE c_acctbal > 0""")
def record_filters(spark, sf_dir):
    """Products of a category and by keyword, orders by status, successful results, active users."""
    part, c = load(spark, sf_dir, "part"), F.col
    results = load(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("id"), (c("l_returnflag") != "R").alias("success"))
    users = load(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), (c("c_acctbal") > 0).alias("active"))
    found = {
        "category": records.equal_to(part, "p_brand", "Brand#13").select(c("p_partkey").alias("id")),
        "search": records.holding(part, "p_name", "RING").select(c("p_partkey").alias("id")),
        "status": records.equal_to(load(spark, sf_dir, "orders"), "o_orderstatus", "F").select(c("o_orderkey").alias("id")),
        "successful": records.flagged(results, "success", "id"),
        "active": records.flagged(users, "active", "id"),
    }
    out = None
    for kind, df in found.items():
        df = df.select(F.lit(kind).alias("kind"), "id")
        out = df if out is None else out.union(df)
    return out


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def find_by_id(spark, sf_dir):
    wanted = load(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return records.lookup(load(spark, sf_dir, "orders"), wanted, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("""SELECT p_partkey AS task, CASE WHEN p_size % 3 > 0 THEN p_partkey + p_size END AS needs, coalesce(p_partkey + p_size IN (SELECT p_partkey FROM part) AND p_size % 3 > 0, false) AS found FROM part""")
def first_dependencies(spark, sf_dir):
    """Parts as tasks that need one or two others; every third needs none."""
    k, s = F.col("p_partkey"), F.col("p_size")
    deps = F.when(s % 3 == 1, F.array(k + s)).when(s % 3 == 2, F.array(k + s, k + 1)).otherwise(F.array().cast("array<bigint>"))
    return records.first_dependency(load(spark, sf_dir, "part").select(k.alias("task"), deps.alias("deps")))


@query("""SELECT user_id, arg_min(event_id, event_id) AS seq, arg_min(value, event_id) AS value FROM events WHERE event_type = 'error' GROUP BY 1""")
def first_failures(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), "value", (F.col("event_type") != "error").alias("success"))
    return records.first_failure(rows, "user_id").select("user_id", "seq", "value")


@query("SELECT c_mktsegment, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last FROM (SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS c_mktsegment, c_custkey FROM customer) GROUP BY 1")
def split_by_key(spark, sf_dir):
    """Customers by segment, null a group of its own; each group is shown by its size and ends."""
    c = load(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), "c_custkey")
    rows = records.split_by_key(c, "c_mktsegment")
    at = lambda i: F.element_at("rows", i)["c_custkey"]
    return rows.select("c_mktsegment", F.size("rows").cast("long").alias("n"), at(1).alias("first"), at(-1).alias("last"))


@query("""WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events), i AS (SELECT unnest([0, 5, 5, 77, 150]) AS n, generate_subscripts([0, 5, 5, 77, 150], 1) - 1 AS pos)
SELECT pos, event_id AS seq FROM i JOIN n USING (n)""")
def gathered_rows(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("event_id").alias("seq"))
    return records.gather(rows, [0, 5, 5, 77, 150])


@query()
def shuffled_rows(spark, sf_dir):
    """A repeatable order by hash, which SQL does not have."""
    return records.shuffled(load(spark, sf_dir, "orders").select("o_orderkey"), 7, "o_orderkey")


@query("SELECT l_orderkey AS file, l_linenumber AS line, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS bug_types FROM lineitem GROUP BY ALL")
def lines_by_place(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("bug_type"))
    return matching.by_place(rows).select("file", "line", F.array_join("bug_types", ",").alias("bug_types"))


@query("""WITH r AS (SELECT doc_id AS file, n_chars % 2 = 1 AS found FROM documents), t AS (SELECT doc_id AS file, toxic = 1 AS is_bug FROM labels WHERE toxic IS NOT NULL)
SELECT count(*) FILTER (found AND is_bug) AS tp, count(*) FILTER (found AND NOT is_bug) AS fp, count(*) FILTER (NOT found AND is_bug) AS fn, count(*) FILTER (NOT found AND NOT is_bug) AS tn FROM r JOIN t USING (file)""")
def truth_counts(spark, sf_dir):
    results = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), (F.col("n_chars") % 2 == 1).alias("found"))
    truth = load(spark, sf_dir, "labels").where("toxic is not null").select(F.col("doc_id").alias("file"), (F.col("toxic") == 1).alias("is_bug"))
    return matching.against_truth(results, truth)


@query("""WITH o AS (SELECT o_orderkey AS b, o_orderstatus AS was FROM orders), n AS (SELECT l_orderkey AS b, min(l_linestatus) AS now FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1)
SELECT was, coalesce(now, 'MISSING') AS now, count(*) AS n FROM o LEFT JOIN n USING (b) GROUP BY ALL""")
def class_changes(spark, sf_dir):
    old = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bug_id"), F.col("o_orderstatus").alias("cls"))
    new = load(spark, sf_dir, "lineitem").where("l_orderkey % 3 > 0").groupBy(F.col("l_orderkey").alias("bug_id")).agg(F.min("l_linestatus").alias("cls"))
    return matching.changes(old, new)


@query("""SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'HTTP' WHEN 1 THEN 'CLI' WHEN 2 THEN 'ENV' WHEN 3 THEN 'USER_INPUT' WHEN 4 THEN 'FILE' END AS kind FROM events""")
def source_types(spark, sf_dir):
    texts = F.array(*map(F.lit, ("flask.request.args", "from sys.argv and open(x)", "os.environ['A']", "Input() of a user", "text of open(path)", "elsewhere")))
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), intent.source_type(F.get(texts, (F.col("event_id") % 6).cast("int"))).alias("kind"))
