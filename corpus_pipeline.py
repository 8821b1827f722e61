"""A corpus pipeline: drop toxic documents, keep one of each group of near-duplicates, drop
documents that repeat benchmark passages, mix the sources to their target weights, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes every stage's result as Parquet under the folder that
``spark.checkpoint.dir`` names and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import catalog, decontaminate, hash_ring, mixing, ngram_join, toxicity
from ledgerlens.llm.common import documents, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; the lexicon is learned from ``labels``."""
    return toxicity.without_toxic(docs, catalog.toxic_lexicon(spark, sf_dir), threshold=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by Jaccard similarity >= 0.8 of 5-word shingles."""
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item."""
    return decontaminate.without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often (0 to 3 times) as the mix by source weights takes them."""
    return mixing.take_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to 23) and slot of every row of the mix."""
    return hash_ring.shard_rows(docs, shards=24)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Learned scores, similarity components and running sums: tested against brute force instead.
ORACLE_SQL = None
