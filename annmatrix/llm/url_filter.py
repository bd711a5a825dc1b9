"""URL rules by host-suffix and path-prefix expressions, matched on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import literal

#: Rules that are broadcast; a larger list is joined by shuffling the expressions.
BROADCAST_RULES = 50_000
#: Hex digits of the digest that expressions are joined on.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty for null or without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages.

    rules: (verdict, host, path).  A rule fits its host and all subdomains
    where the path starts with the rule's.  The longest rule wins (host and path
    together, then the longer host, then block before allow); without one the verdict is default
    and rule is null.

    A URL is expanded into its host suffixes, of as many labels as some rule's
    host has, each with its path prefixes, of as many characters as some rule's
    path has.  Expressions meet rules on the first hex digits of their digests;
    the whole digests confirm.  Best matches come from one aggregation, keyed
    by row, with partial sums before its shuffle, so common hosts don't meet in a task.

    Repeated rows give repeated results; null ids are kept; null or odd URLs have
    empty host and path, which only a rule without host and path would fit; an
    empty table gives an empty one; further columns, the page's text among them, are not read.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col).cast("string"))
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    labels = ",".join(map(str, sorted({r[1].count(".") + 1 for r in rules}))) or "1"
    prefixes = ",".join(map(str, sorted({len(r[2]) for r in rules}))) or "0"
    found = f"""transform(filter(array({labels}), k -> k <= size(split(host, '[.]', -1))), k -> substring_index(host, '.', -k))"""
    starts = f"transform(filter(array({prefixes}), n -> n <= char_length(path)), n -> substring(path, 1, n))"
    base = base.withColumn("suffixes", F.expr(found)).withColumn("starts", F.expr(starts))
    pairs = "flatten(transform(suffixes, h -> transform(starts, p -> concat(h, p))))"
    # the null expression stands for the row itself
    expressions = base.select("page_id", "host", "path", F.expr(f"explode(concat(array(cast(null as string)), {pairs})) as expression"))
    expressions = expressions.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    values = ", ".join(f"({literal(v)}, {literal(h + p)}, {len(h)})" for v, h, p in rules) or "('', cast(null as string), 0)"
    known = spark.sql(f"select verdict, rule, host_chars, sha2(rule, 256) as rule_digest, substring(sha2(rule, 256), 1, {SHORT}) as rule_short from values {values} as t(verdict, rule, host_chars)")
    if len(rules) <= BROADCAST_RULES:
        known = F.broadcast(known)
    met = expressions.join(known, F.col("short") == F.col("rule_short"), "left")
    rank = F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("chars"), "host_chars", (F.col("verdict") == "block").alias("block"), "rule", "verdict"))
    # a short prefix may fit by chance: the whole digest decides
    met = met.where("expression is null or digest = rule_digest")
    best = met.groupBy("page_id", "host", "path").agg(F.max(rank).alias("best"), F.count_if(F.col("expression").isNull()).cast("int").alias("n"))
    out = best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.array_repeat(F.lit(1), F.col("n"))).alias("copy"))
    return out.drop("copy")


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
m AS (SELECT page_id, host, path, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""
