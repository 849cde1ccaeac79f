"""Operator 7: url filters, by rules and by an empirical-Bayes reputation of hosts.  DataFrame functions only.

Rules name a host and a path; a rule fits the host and its subdomains if the url's path starts with its own, and the
longest rule wins.  Where none fits, the host's reputation decides: outcomes of labelled pages are counted by host,
registered domain and suffix.  At each level a beta-binomial prior has the mean of the posterior one level up, without the
group's own pages, and a strength found by moments over the level's groups; a url is blocked if the lower bound of its host's
posterior, mean less Z standard deviations, exceeds LIMIT times the share of bad outcomes overall.  Hosts without labels inherit
their domain's, domains without labels their suffix's.

A suffix is the last label, or the last two where SUFFIXES lists them; the registered domain has one label more.  Ports, user
names and a closing dot do not count, and an address of numbers is a domain of its own.

A null url, or one without "://", has an empty host and path and is judged by the overall mean.  Repeated pages count
each.  Outcomes with a null label or key are left out; repeated keys take the worse outcome.  Empty tables give no rows, and
without outcomes nothing is blocked by reputation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import common

#: Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Standard deviations of the lower bound, and how many times the overall share of bad pages it must exceed.
Z, LIMIT = 1.645, 1.25
# Common public suffixes of two labels; others may be given to judge().
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "sch.uk",
    "com.au", "edu.au", "gov.au", "net.au", "org.au", "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz",
    "ac.jp", "ad.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "ac.kr", "co.kr", "go.kr", "or.kr",
    "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.hk", "com.tw", "com.sg", "com.my", "co.id", "co.th",
    "ac.in", "co.in", "gov.in", "net.in", "org.in", "ac.za", "co.za", "gov.za", "org.za", "co.il",
    "com.br", "edu.br", "gov.br", "net.br", "org.br", "com.ar", "com.mx", "com.co", "com.pe", "com.tr", "com.ua", "com.pl",
)
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """The lower-case host, or empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """The path, or empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered]
    return F.coalesce(*(F.when(c, s) for c, s in fits)) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(groups: DataFrame, overall: float) -> float:
    """The prior strength of a level, by moments of its groups (n, bad) around the overall mean."""
    p = F.col("bad") / F.col("n")
    r = groups.where("n > 0").agg(F.count("*").alias("groups"), F.sum("n").alias("pages"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("square"), F.sum(F.col("n") * (p - overall) * (p - overall)).alias("spread")).first()
    if not r.groups or r.pages - r.square <= 0:
        return STRONGEST
    within = overall * (1 - overall)
    between = (r.spread - (r.groups - 1) * within) / (r.pages - r.square)
    return max(WEAKEST, min(STRONGEST, within / between - 1)) if between > 0 else STRONGEST


def domain_and_suffix(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """The registered domain and the suffix of a host."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"\.$", "")
    last = lambda k: F.substring_index(bare, ".", -k)
    long, numbers = last(2).isin(*suffixes), bare.rlike(r"^(\[.*\]?|[0-9.]+)$")
    return F.when(numbers, bare).when(long, last(3)).otherwise(last(2)), F.when(numbers, "").when(long, last(2)).otherwise(last(1))


def reputation(hosts: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """hosts(host, n, bad) -> host, posterior mean, its lower bound, and the share of bad outcomes overall.

    Counts of domains and suffixes join by name; the overall counts and the three strengths are single numbers.
    """
    of_domain, of_suffix = domain_and_suffix(F.col("host"), suffixes)
    named = hosts.withColumn("domain", of_domain).withColumn("suffix", of_suffix)
    domains = named.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    overall = (total.bad + 0.5) / (total.n + 1)
    strength = {key: F.lit(_strength(groups, overall)) for key, groups in (("suffix", suffixes), ("domain", domains), ("host", named))}
    above = domains.toDF("domain", "suffix", "dn", "db").join(suffixes.toDF("suffix", "sn", "sb"), "suffix").drop("suffix")
    c = F.col
    post = lambda prior, key, n, bad: (strength[key] * prior + bad) / (strength[key] + n)
    around = (total.bad - c("sb") + 0.5) / (total.n - c("sn") + 1)
    suffix = post(around, "suffix", c("sn") - c("dn"), c("sb") - c("db"))
    domain = post(suffix, "domain", c("dn") - c("n"), c("db") - c("bad"))
    mean = post(domain, "host", c("n"), c("bad"))
    found = named.join(above, "domain").select("host", mean.alias("mean"), (strength["host"] + c("n")).alias("weight"))
    return found.select("host", "mean", (c("mean") - Z * F.sqrt(c("mean") * (1 - c("mean")) / (c("weight") + 1))).alias("lower"), F.lit(overall).alias("overall"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, suffixes=SUFFIXES) -> DataFrame:
    """pages(page_id, url) and outcomes(host, bad) of labelled pages -> page_id, host, path, rule, verdict, and the host's posterior and bound.

    Only the two columns of pages and of outcomes are read.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labelled = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = urls.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    hosts = hosts.unionByName(labelled.where("n > 0")).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = common.table(hosts, "hosts")
    judged = reputation(hosts, suffixes).select("host", "mean", "lower", F.when(F.col("lower") > LIMIT * F.col("overall"), "block").alias("by_host"))
    found = urls.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).join(judged, "host", "left")
    verdict = F.coalesce("r.verdict", "by_host", F.lit("allow"))
    return found.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.round("mean", 6).alias("posterior"), F.round("lower", 6).alias("bound"))


def outcomes_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of labelled pages: a page's url ends in the number of the document it shows, whose quality label is its outcome."""
    number = F.expr(r"try_cast(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*/(?:[^?#]*/)?([0-9]+)(?:\\.html)?/?(?:[?#].*)?$', 1), '') as bigint)")
    shown = pages.select(host_of(F.col("url")).alias("host"), number.alias("doc_id")).where("doc_id is not null")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    return shown.join(known, "doc_id").select("host", "bad")


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all pages."""
    pages, labels = spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(pages, outcomes_of(pages, labels))


def _strength_sql(name: str, groups: str) -> str:
    return f"""{name}_k AS (
  SELECT coalesce(CASE WHEN between_ > 0 THEN greatest(1.0, least(1000.0, within / between_ - 1)) ELSE 1000.0 END, 1000.0) AS k FROM (
    SELECT m * (1 - m) AS within, CASE WHEN pages - square > 0 THEN (spread - (g - 1) * m * (1 - m)) / (pages - square) END AS between_ FROM (
      SELECT count(*) AS g, sum(n) AS pages, sum(n * n) / sum(n) AS square, sum(n * pow(bad / n - overall, 2)) AS spread, any_value(overall) AS m
      FROM {groups}, o WHERE n > 0)))"""


OP7_SQL = rf"""
WITH u AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), s AS (
  SELECT host, try_cast(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*/(?:[^?#]*/)?([0-9]+)(?:\.html)?/?(?:[?#].*)?$', 1), '') AS BIGINT) AS doc_id FROM u
), h AS (
  SELECT host, CASE WHEN numbers THEN '' WHEN long THEN two ELSE p[-1] END AS suffix, CASE WHEN numbers THEN bare WHEN long THEN array_to_string(p[-3:], '.') ELSE two END AS domain, n, bad FROM (
    SELECT *, array_to_string(p[-2:], '.') AS two, array_to_string(p[-2:], '.') IN {SUFFIXES} AS long, regexp_matches(bare, '^(\[.*\]?|[0-9.]+)$') AS numbers FROM (
      SELECT *, string_split(bare, '.') AS p FROM (
        SELECT host, regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '\.$', '') AS bare, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad
        FROM (SELECT host, 0 AS n, 0 AS bad FROM u UNION ALL SELECT host, 1, bad FROM s JOIN l USING (doc_id)) GROUP BY host)))
), o AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS overall FROM h),
sg AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suffix),
dg AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain),
{_strength_sql("s", "sg")}, {_strength_sql("d", "dg")}, {_strength_sql("h", "h")},
tt AS (SELECT coalesce(sum(n), 0) AS tn, coalesce(sum(bad), 0) AS tb FROM h),
x AS (SELECT host, h.n, h.bad, dg.n AS dn, dg.bad AS db, sg.n AS sn, sg.bad AS sb, tn, tb, s_k.k AS ks, d_k.k AS kd, h_k.k AS kh
  FROM h JOIN dg USING (domain) JOIN sg ON sg.suffix = dg.suffix, tt, s_k, d_k, h_k),
x1 AS (SELECT *, (ks * (tb - sb + 0.5) / (tn - sn + 1) + sb - db) / (ks + sn - dn) AS m1 FROM x),
x2 AS (SELECT *, (kd * m1 + db - bad) / (kd + dn - n) AS m2 FROM x1),
hp AS (SELECT host, (kh * m2 + bad) / (kh + n) AS m, kh + n AS w FROM x2),
b AS (SELECT host, m, m - {Z} * sqrt(m * (1 - m) / (w + 1)) AS low, overall FROM hp, o)
SELECT page_id, u.host, path, rule, coalesce(CASE rule WHEN 'com/' THEN 'allow' WHEN 'www.example.com/en/' THEN 'allow' WHEN 'example.com/en/' THEN 'block'
         WHEN 'net/es/' THEN 'block' WHEN 'net/fr/' THEN 'block' END, CASE WHEN low > {LIMIT} * overall THEN 'block' ELSE 'allow' END) AS verdict, round(m, 6) AS posterior, round(low, 6) AS bound
FROM (SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM u) u JOIN b USING (host)
"""
