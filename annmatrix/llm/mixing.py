"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, literal

#: Sources whose table of rates is broadcast.
BROADCAST_SOURCES = 20_000
#: The mean of one draw at most; higher rates are the sum of several draws, which is Poisson again.
LARGEST_MEAN = 500.0


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5, total: float = 1.0, source_col: str = "source") -> DataFrame:
    """source, documents, rate (mean copies of each document), draws (how many are added up) and cdf (of one draw).

    weights: the share of each source in the mix (any sum; sources without one get none).
    Without them a source's share is its number of documents to the power temper.  total: documents of the mix per document.
    """
    counted = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("documents"))
    if weights is None:
        share = F.pow(F.col("documents").cast("double"), F.lit(float(temper)))
    else:
        cases = " ".join(f"when {literal(k)} then {float(v)!r}D" for k, v in weights.items())
        share = F.expr(f"case source {cases} else 0.0D end") if cases else F.lit(0.0)
    counted = counted.withColumn("share", share)
    sums = counted.agg(F.sum("documents").alias("all_documents"), F.sum("share").alias("all_shares"))
    mixed = counted.crossJoin(F.broadcast(sums)).select("source", "documents", (F.lit(float(total)) * F.col("all_documents") * F.col("share") / F.col("all_shares") / F.col("documents")).alias("rate"))
    mixed = mixed.withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    mixed = mixed.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int")).withColumn("mean", F.col("rate") / F.col("draws"))
    steps = "sequence(1, cast(ceil(mean + 10 * sqrt(mean) + 20) as int))"
    start = "named_struct('p', exp(-mean), 'sum', exp(-mean), 'cdf', array(exp(-mean)))"
    cdf = f"aggregate({steps}, {start}, (a, k) -> named_struct('p', a.p * mean / k, 'sum', a.sum + a.p * mean / k, 'cdf', array_append(a.cdf, a.sum + a.p * mean / k)), a -> a.cdf)"
    return mixed.select("source", "documents", "rate", "draws", F.expr(cdf).alias("cdf"))


def uniform(key: str, seed: str) -> str:
    """SQL of a number in [0, 1) from the hash of a seed and a key: 52 bits of its MD5."""
    return f"cast(conv(substring(md5(concat({seed}, {key})), 1, 13), 16, 10) as double) / {1 << 52}D"


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5, total: float = 1.0, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", copy_col: str | None = "copy") -> DataFrame:
    """The columns of docs, each document as often as it is drawn, and copy_col (from 0) unless that is None.

    The copies of a document are Poisson with its source's rate as mean, by
    inversion of the distribution at a uniform number from the hash of seed and
    doc_id, so a rerun, another partitioning or a lost executor gives the same mix.  Rates above LARGEST_MEAN are
    split into equal draws, each with a seed of its own.  Documents drawn 0 times are absent, as sampling at a rate below 1 means.
    All copies are dealt to partitions, and ordered in them, by another hash, so no source
    and no document stays together.

    Texts aren't read, so null, empty and very long ones are copied like any other.  Rows with equal ids are drawn alike; rows
    without id are drawn by a hash of all their columns.  A null source is a source of its own (named by no weight).
    An empty table gives an empty one.  A column named as copy_col is replaced by the copy's number; other columns are
    carried along, whatever their names.
    """
    table = rates(docs, weights, temper, total, source_col).select(F.col("source").alias("known"), "draws", "cdf")
    table = table.persist()
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    columns = [c for c in docs.columns if c != copy_col]
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("#"), F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("string")))
    drawn = boxed(docs.select(*[F.col(f"`{c}`") for c in columns]), source=F.col(f"`{source_col}`"), key=key)
    drawn = drawn.join(table, F.col("source").eqNullSafe(F.col("known"))).withColumn("u", F.expr(uniform("key", f"'{seed}:'")))
    further = uniform("key", f"concat('{seed}.', i, ':')")
    more = f"aggregate(sequence(1, draws - 1), 0, (a, i) -> a + size(filter(cdf, c -> c <= {further})))"
    drawn = drawn.withColumn("n", F.expr(f"size(filter(cdf, c -> c <= u)) + if(draws > 1, {more}, 0)"))
    copies = drawn.where("n > 0").select("row", "key", F.expr("explode(sequence(0, n - 1)) as number"))
    copies = copies.withColumn("at", F.xxhash64(F.lit(seed), "key", "number"))
    dealt = copies.repartition(F.col("at")).sortWithinPartitions("at")
    return dealt.select("row.*", *([F.col("number").alias(copy_col)] if copy_col else []))


SQL = """
WITH n AS (SELECT source, count(*) AS documents FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(documents) FROM n) * sqrt(documents) / (SELECT sum(sqrt(documents)) FROM n) / documents AS rate FROM n),
c AS (SELECT source, list_transform(range(0, 60), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(-rate + i * ln(rate) - lgamma(i + 1))))) AS cdf FROM r),
u AS (SELECT d.*, CAST('0x' || substr(md5('7:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u, cdf
      FROM documents d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
k AS (SELECT doc_id, text, lang, source, n_chars, len(list_filter(cdf, lambda x: x <= u)) AS n FROM u)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy FROM (SELECT *, unnest(range(0, n)) AS copy FROM k)
"""
