"""URL filters: allow and block rules on host suffixes and path prefixes.

Method: every url becomes the expressions host suffix + path prefix that a rule could be (suffixes by label; prefixes
of the lengths that rules have). Expressions and rules meet in an equi-join on the first four bytes of their SHA-256; the full
digests are then compared, and the longest rule wins. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to which they are broadcast (about 100 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 200_000

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")), LETTERS, LETTERS.lower())


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages(page_id, url, ...), given rules(verdict, host, path).

    A rule fits its host and all subdomains where the path starts with the rule's. Of several, the longest wins (as
    host and path together, then the longer host; block before allow for one rule with both). Without any, rule is null
    and the verdict the default. Null urls and urls without :// have empty host and path and fit no rule. Rules
    with nulls or without a host fit nothing. Repeated rows give repeated results; null ids are kept.
    """
    rules = rules.where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
    rules = rules.groupBy(F.translate("host", LETTERS, LETTERS.lower()).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    # The lengths of paths that rules have, a scalar subquery: as many as a path has characters at most.
    lengths = F.coalesce(rules.agg(F.sort_array(F.collect_set(F.length("path")))).scalar(), F.array().cast("array<int>"))
    rules = rules.withColumn("digest", F.sha2(F.concat("host", "path"), 256)).groupBy(F.left("digest", F.lit(8)).alias("prefix")).agg(F.collect_list(F.struct("digest", "host", "path", "verdict")).alias("rules"))
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)

    # The input's task is part of the key below: repeated rows of different tasks stay apart, and every url is expanded where it was read.
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.spark_partition_id().alias("task"))
    rows = rows.select("task", "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), lengths.alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter("lengths", lambda n: n <= F.length("path"))
    tries = F.flatten(F.transform(suffixes, lambda h: F.transform(fitting, lambda n: F.struct(h.alias("h"), F.left("path", n).alias("p")))))
    tried = rows.select("task", "page_id", "url", "host", "path", F.posexplode_outer(F.when(F.col("host") != "", tries)).alias("i", "x"))
    tried = tried.withColumn("digest", F.sha2(F.concat("x.h", "x.p"), 256)).withColumn("prefix", F.left("digest", F.lit(8)))
    # Each expression meets the rules of its prefix once; full digests, then the text itself, decide.
    met = tried.join(rules, "prefix", "left")
    fits = F.filter("rules", lambda r: (r["digest"] == F.col("digest")) & (r["host"] == F.col("x.h")) & (r["path"] == F.col("x.p")))
    told = F.array_max(F.transform(fits, lambda r: F.struct(F.length(F.concat(r["host"], r["path"])).alias("n"), F.length(r["host"]).alias("h"), r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule"))))
    judged = met.withColumn("told", told).groupBy("task", "page_id", "url", "host", "path").agg(F.max("told").alias("best"), F.count_if(F.coalesce("i", F.lit(0)) == 0).alias("copies"))
    out = judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), "copies")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")


#: The rules of the registered query as (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

SQL = """
WITH r(v, h, p) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
u AS (SELECT page_id, url, row_number() OVER () AS k,
  coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT k, v, h || p AS rule, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS n
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (k)
"""
