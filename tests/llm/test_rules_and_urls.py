"""Operators 5 and 7: against plain code, and odd inputs."""

import math
import re

import duckdb
from pyspark.sql import functions as F

from factloom.llm import quality_rules, url_reputation
from tests.llm.helpers import documents


def signals_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(words) < 3000 else None
    return len(words), sum(map(len, words)), sum(c in quality_rules.SYMBOLS for c in text), len(lines) - len(set(lines)), None if covered is None else len(covered)


def test_signals(spark):
    extra = ["a b c a b c", "a a a a", "x y z\nx y z\n\n \nx y z", "#1 $2 |3", "a b a b a", "one two three four one two three"]
    from tests.llm.helpers import ODD_TEXTS

    docs = documents(spark, ODD_TEXTS + extra)
    got = sorted(map(repr, (tuple(r) for r in quality_rules.signals(docs).collect())))
    want = []
    for r in docs.collect():
        s = signals_by_hand(r.text)
        want.append(repr((r.doc_id, *s[:4], s[4] if s[4] is not None else s[0])))
    assert got == sorted(want)


def test_tail_is_exact(spark):
    for n, k, p in ((100, 2, 0.05), (4000, 11, 0.005), (300000, 1400, 0.005)):
        got = spark.range(1).select(F.expr(quality_rules.tail(f"{n}L", f"{k}L", p))).first()[0]
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
        assert abs(got - want) < 1e-6 * max(want, 1e-12) + 1e-12


def rated_rows(spark, n, junk_symbols):
    """n documents of 200 words, every second one junk with as many symbols of 1000 characters."""
    rows = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 1).alias("junk"))
    zero = F.lit(0).cast("long")
    symbols = F.when(F.col("junk"), junk_symbols).otherwise(F.col("doc_id") % 9).cast("long")
    return quality_rules.rated(rows.select("doc_id", F.lit(200).cast("long").alias("n_words"), F.lit(1000).cast("long").alias("word_chars"), symbols.alias("n_symbols"), zero.alias("n_dup_lines"), zero.alias("n_repeat_words")))


def test_levels_stop_where_good_documents_would_go(spark):
    rows = rated_rows(spark, 2000, 120)
    labels = lambda good: spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0 if good == "clean" else F.col("id") >= 0).cast("int").alias("quality"))
    clean = quality_rules.cutoffs(rows, labels("clean")).collect()
    assert [(r.stratum, r.good, r.level) for r in clean] == [(1, 1000, len(quality_rules.LEVELS))]
    # where half of the good documents have 120 symbols, no level with a cutoff of 120 or less is safe
    both = quality_rules.cutoffs(rows, labels("all")).collect()
    assert both[0].level == sum(level[0] > 120 for level in quality_rules.LEVELS)
    assert quality_rules.cutoffs(rows, labels("clean").limit(20)).collect()[0].level == 0
    assert quality_rules.cutoffs(rows, labels("clean").limit(0)).count() == 0


def test_levels_against_exact_bounds(spark):
    """The chain of tests, in plain arithmetic, on strata of different sizes."""
    rng = [(i, i % 3, (i * 7919) % 500) for i in range(3000)]
    rows = spark.createDataFrame([(i, 50 if b == 0 else 200 if b == 1 else 2000, s) for i, b, s in rng], "doc_id long, n_words long, n_symbols long")
    zero = F.lit(0).cast("long")
    rows = quality_rules.rated(rows.select("doc_id", "n_words", F.lit(1000).cast("long").alias("word_chars"), F.when(F.col("n_symbols") < 480, F.col("n_symbols") / 100).otherwise(F.col("n_symbols")).cast("long").alias("n_symbols"), zero.alias("n_dup_lines"), zero.alias("n_repeat_words")))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, 1).otherwise((F.col("id") % 30 == 2).cast("int")).alias("quality"))
    got = {r.stratum: (r.good, r.level) for r in quality_rules.cutoffs(rows, labels).collect()}
    good = {0: [], 1: [], 3: []}
    for i, b, s in rng:
        if b < 2 or i % 30 == 2:
            good[(0, 1, 3)[b]].append(s // 100 if s < 480 else s)
    total = sum(map(len, good.values()))
    for stratum, symbols in good.items():
        n, level = len(symbols), 0
        for cut in (x[0] for x in quality_rules.LEVELS):
            k = sum(s >= cut for s in symbols)
            chance = sum(math.comb(n, j) * quality_rules.ALPHA**j * (1 - quality_rules.ALPHA) ** (n - j) for j in range(k + 1))
            if k >= quality_rules.ALPHA * n or chance > quality_rules.DELTA * n / total:
                break
            level += 1
        assert got[stratum] == (n, level)


def test_levels_decide_on_the_driver_table(spark):
    """The method rejects documents that the base rule keeps, and few good ones."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_rules.op5_quality_rules(spark, sf).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("gone"), F.max("level").alias("level")).collect()
    at = {r.quality: r for r in rows}
    assert at[1].level > 0 and at[1].gone <= quality_rules.ALPHA * at[1].n and at[0].gone >= 0.5 * at[0].n


def test_rules_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 1)], "doc_id long, quality int")
    rows = quality_rules.judge(docs, labels).collect()
    assert len(rows) == docs.count() and all(not (r.base_failed and r.kept) for r in rows)
    assert quality_rules.judge(docs.limit(0), labels.limit(0)).count() == 0


URLS = [None, "", "no-scheme.com/x", "://", "http://", "HTTPS://WWW.Example.COM/en/", "https://example.com/en/9?x#y", "http://a.example.com/en/", "http://badexample.com/en/", "http://a.net/es/", "http://net/fr/x", "http://b.net/de/", "http://c.com", "http://c.com/?q=a://b/en/", "http://x.org/en/\nline"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(3, "http://a.net/es/", "h")], "page_id long, url string, host string")
    pages = pages.withColumn("mean", F.lit("x")).withColumn("r", F.lit(1)).withColumn("domain", F.lit(None).cast("string"))
    rows = {r.page_id: r for r in url_reputation.judge(pages, spark.createDataFrame([], "host string, bad int")).collect() if r.page_id != 3}
    assert [(rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) for i in (0, 1, 2, 4)] == [("", "", None, "allow")] * 4
    assert (rows[5].host, rows[5].path, rows[5].rule, rows[5].verdict) == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert (rows[6].path, rows[6].rule, rows[6].verdict) == ("/en/9", "example.com/en/", "block")
    assert [rows[i].rule for i in (7, 8, 9, 10, 11, 12, 13)] == ["example.com/en/", "com/", "net/es/", "net/fr/", None, None, "com/"]
    assert rows[14].path == "/en/\nline"
    assert url_reputation.judge(pages.limit(0), spark.createDataFrame([], "host string, bad int")).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    bad = [("spam.bad.org", 1)] * 60 + [("once.bad.org", 1)] + [("good.org", 0)] * 200 + [("fine.good.org", 0)] * 100 + [("new.xyz", 1)]
    pages = spark.createDataFrame([(i, f"http://{h}/de/") for i, h in enumerate(["spam.bad.org", "once.bad.org", "good.org", "new.xyz", "other.bad.org", "never.seen.dev"])], "page_id long, url string")
    rows = url_reputation.judge(pages, spark.createDataFrame(bad, "host string, bad int")).collect()
    verdict = {r.host: r.verdict for r in rows}
    assert verdict["spam.bad.org"] == "block" and verdict["good.org"] == "allow" and verdict["new.xyz"] == "allow" and verdict["never.seen.dev"] == "allow"


def test_domains_and_suffixes(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.example.com:8080": ("example.com", "com"), "u@example.com.": ("example.com", "com"), "10.0.0.1:80": ("10.0.0.1", ""), "localhost": ("localhost", "localhost"), "": ("", ""), "[::1]:80": ("[::1]", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r[0]: (r[1], r[2]) for r in df.select("host", *url_reputation.domain_and_suffix(F.col("host"))).collect()} == hosts


def test_host_domain_and_suffix_each_decide(spark):
    """One host among good ones of its domain, a domain among good ones of its suffix, a suffix among good ones."""
    bad = [("spam.fine.com", 1)] * 80 + [(f"h{i}.fine.com", 0) for i in range(40) for _ in range(10)]
    bad += [(f"h{i}.farm.org", 1) for i in range(30) for _ in range(10)] + [(f"w{i}.org", 0) for i in range(40) for _ in range(10)]
    bad += [(f"d{i}.zz", 1) for i in range(60) for _ in range(6)] + [(f"d{i}.yy", 0) for i in range(60) for _ in range(20)]
    asked = {"spam.fine.com": "block", "new.fine.com": "allow", "new.farm.org": "block", "new.org": "allow", "new.zz": "block", "a.new.zz": "block", "new.yy": "allow", "never.seen": "allow"}
    pages = spark.createDataFrame([(i, f"http://{h}/de/") for i, h in enumerate(asked)], "page_id long, url string")
    rows = url_reputation.judge(pages, spark.createDataFrame(bad, "host string, bad int"), rules=()).collect()
    assert {r.host: r.verdict for r in rows} == asked


def test_reputation_agrees_with_its_sql_where_hosts_matter(spark, tmp_path):
    """Outcomes that depend on hosts, as the driver's tables have none: a host, a domain and a suffix each block, and the SQL says the same."""
    seen = [("spam.fine.dev", 1)] * 80 + [(f"h{i}.fine.dev", 0) for i in range(40) for _ in range(10)]
    seen += [(f"h{i}.farm.org", 1) for i in range(30) for _ in range(10)] + [(f"w{i}.org", 0) for i in range(40) for _ in range(10)]
    seen += [(f"d{i}.zz", 1) for i in range(60) for _ in range(6)] + [(f"d{i}.yy", 0) for i in range(60) for _ in range(20)]
    asked = {"spam.fine.dev": "block", "new.fine.dev": "allow", "new.farm.org": "block", "new.org": "allow", "new.zz": "block", "a.new.zz": "block", "new.yy": "allow", "x.com": "allow"}
    pages = [(i, f"https://{h}/de/{i}.html") for i, (h, _) in enumerate(seen)] + [(10_000 + i, f"http://{h}/de/") for i, h in enumerate(asked)] + [(20_000, None), (20_001, "no url")]
    spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("clash")).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, 1 - b) for i, (_, b) in enumerate(seen)] + [(None, 0), (3, None)], "doc_id long, quality int").withColumn("url", F.lit("clash")).write.parquet(str(tmp_path / "labels.parquet"))
    got = url_reputation.op7_url_reputation(spark, str(tmp_path))
    assert {r.host: r.verdict for r in got.where("page_id between 10000 and 19999").collect()} == asked
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(url_reputation.OP7_SQL)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
