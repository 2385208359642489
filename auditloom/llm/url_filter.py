"""URL filtering by hashed host-suffix and path-prefix expressions.

A rule is (action, host, path). It fits its host and every subdomain when the
url's path starts with the rule's path; of several that fit, the longest
expression wins, and block wins over allow between equal ones. Every url is
expanded into all its expressions: each suffix of the host at a dot, with each
prefix of the path whose length some rule has, but no deeper than the deepest rule.
Expressions meet rules by an equi-join on the first four bytes of their SHA-256; the full
digest confirms. Each distinct host and path is looked up once, and hits of frequent ones
are sent to their rows, so that a url with a third of all rows is no single task's.

Edge cases: a null url or one without `://` has empty host and path, fits no
rule and gets the default verdict. Repeated urls are judged alike. An empty rule
table leaves every url with the default. Only the named columns are read, so
extra columns never clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_skewed, low, store, table

Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    return low(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Rules with digest; equal expressions keep one row, block before allow."""
    df = spark.createDataFrame([(a, h.lower(), p) for a, h, p in rules], "action string, rule_host string, rule_path string")
    df = df.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action"))
    return df.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("digest", F.sha2("rule", 256))


def judge(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """key, host, path, rule (null if none fits) and verdict for every row."""
    # Bounded by the longest path a rule has: a few numbers, whatever the rules' count.
    shapes = rules.agg(F.collect_set(F.length("rule_path")).alias("lengths"), F.max(F.size(F.split("rule_host", r"\."))).alias("depth")).first()
    lengths, depth = sorted(shapes["lengths"]) or [0], shapes["depth"] or 1
    u = F.col(url)
    parts = store(urls.select(F.col(key).alias("k"), host_of(u).alias("host"), path_of(u).alias("path")).withColumn("at", F.sha2(F.concat_ws("\n", "host", "path"), 256)), "urls")
    once = parts.filter("host != ''").groupBy("at").agg(F.count("*").alias("n"), F.first("host").alias("host"), F.first("path").alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.size(labels) - depth + 1, F.lit(1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, depth), "."))
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    prefixes = F.transform(fits, lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    looked = once.select("at", "n", F.explode(F.array_distinct(pairs)).alias("expression"))
    looked = looked.withColumn("seen", F.sha2("expression", 256)).withColumn("head", F.substring("seen", 1, 8))
    known = rules.select("rule", "action", "digest", F.substring("digest", 1, 8).alias("head"))
    met = looked.join(known, "head").filter("seen = digest").groupBy("at").agg(F.max(F.struct(F.length("rule"), F.col("action"), F.col("rule"))).alias("hit"))
    judged = store(once.select("at", "n").join(met, "at", "left").select("at", "n", "hit.rule", "hit.action"), "url-verdicts")
    hit = join_skewed(parts.filter("host != ''"), judged, "at", "n", keep=("rule", "action")).select("k", "host", "path", "rule", "action")
    none = parts.filter("host = ''").select("k", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    return hit.unionByName(none).select(F.col("k").alias(key), "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


RULES: list[Rule] = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') u FROM pages),
q AS (SELECT page_id,
  translate(regexp_extract(u, '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(u, '(?s)\A.*?://[^/?#]*([^?#]*)', 1) path FROM p),
r(action, h, t) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
m AS (SELECT q.*, r.action, r.h || r.t rule,
  row_number() OVER (PARTITION BY q.page_id, q.host, q.path ORDER BY length(r.h || r.t) DESC NULLS LAST) k
  FROM q LEFT JOIN r ON (q.host = r.h OR q.host LIKE '%.' || r.h) AND starts_with(q.path, r.t))
SELECT page_id, host, path, rule, coalesce(action, 'allow') verdict FROM m WHERE k = 1
"""
