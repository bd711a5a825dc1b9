"""A corpus pipeline: toxicity, line deduplication, near-duplicates, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from annmatrix.llm import common, line_dedup, mixing, near_dedup, packing, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learned from the folder's documents and labels."""
    grammar = toxicity.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, grammar, threshold=0.7)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of 50 words or more that an earlier document has."""
    return line_dedup.dedup_lines(docs, min_words=50)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of those with similarity 0.8 or more, on sets of shingles of five words.

    Candidates come from deletion-variant signatures: of SimHash fingerprints, by op1's search, and, as those miss most pairs at 0.8 (README), of bands of minima.
    """
    return near_dedup.drop_similar(docs, similarity=0.8, size=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for, in a shuffled order."""
    return mixing.mix(docs, copy_col=None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens."""
    return packing.pack(docs, "word_bpe_49k.json", 2048, 0)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", delete_repeated_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]
#: SQL can't express the fingerprints, the learned grammar or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, from the folder's documents; what a stage has written goes when the next one has read it."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            common.delete(spark, before)
        before = at
    return docs
