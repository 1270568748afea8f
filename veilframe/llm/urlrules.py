"""URL rules by hashed host-suffix and path-prefix expressions.

Each URL is expanded into expressions: every suffix of its host at a label boundary, joined to every prefix of its path that
is as long as some rule's path. An expression equals a rule's own host and path exactly if the rule fits. Expressions meet
rules on a short prefix of their SHA-256 digest (an equi-join whose keys are few bytes), then full digests confirm, and of
the rules that fit the longest wins (ties: the longer host, then block before allow).

Scale: each host and path is judged once, however many pages have it; the join is on digest prefixes; which side is shipped is left to Spark, which broadcasts the rules only below its size
threshold and otherwise shuffles. Verdicts go back to pages by host and path, where Spark splits hot keys at run time. Expansions grow with
labels times distinct rule-path lengths, not with the rules.

Cases: a null url or one without :// has an empty host and path, fits no rule and is allowed; rows with equal page_id are
judged one by one; of several equal rules one row results; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table

#: Verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Hex digits of the digest that the join is on.
PREFIX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and what is left without its first labels, if that isn't empty: a rule without a host fits nothing."""
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.filter(let(F.split(host, r"\."), lambda labels: F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))), lambda h: h != ""))


def expressions(host: Column, path: Column, lengths: Column) -> Column:
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: path.substr(F.lit(1), n))
    return F.flatten(F.transform(suffixes(host), lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """pages (page_id, url), rules (verdict, host, path): page_id, host, path, rule, verdict."""
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).distinct()
    keyed = rules.select(
        F.sha2(F.concat("host", "path"), 256).alias("_digest"), F.concat("host", "path").alias("rule"),
        F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h"), (F.col("verdict") == "block").alias("blocks"), F.concat("host", "path").alias("rule"), "verdict").alias("_rank"),
    ).withColumn("_prefix", F.substring("_digest", 1, PREFIX))
    lengths = rules.groupBy().agg(F.sort_array(F.collect_set(F.length("path"))).alias("_lengths"))  # a row; distinct lengths, which a URL's length bounds
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    lengths = F.lit([r[0] for r in lengths.collect()][0] or []).cast("array<int>")
    found = (
        rows.select("host", "path").distinct()
        .withColumn("_text", F.explode(F.array_distinct(expressions(F.col("host"), F.col("path"), lengths))))
        .withColumn("_full", F.sha2("_text", 256)).drop("_text")
        .withColumn("_prefix", F.substring("_full", 1, PREFIX))
        .join(keyed, "_prefix")
        .where(F.col("_full") == F.col("_digest"))
        .groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(F.max("_rank").alias("_rank"))
    )
    out = rows.join(found, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return out.select("page_id", "host", "path", F.col("_rank.rule").alias("rule"), F.coalesce("_rank.verdict", F.lit(otherwise)).alias("verdict"))


def op6_url_filters(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP6_SQL = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
