"""Registered queries of the operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, filter_audit, hash_ring, importance_sampling, language_id, licences, merkle, mixing, ngram_join, oracle, quality_rules, secret_scan, toxicity, whitening
from ledgerlens.llm.common import documents, held_out


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of all documents and the weakly supervised quality verdict."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return quality_rules.quality_posteriors(documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("quality") >= 0.5)).alias("kept"),
        "quality",
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance resampling of all documents towards those labelled good (held-out labels are
    not used, and TARGET_TEXTS of the others at most); the sample has as large a share of the
    rows as good labels have of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").where(~held_out())
    by_hash = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    good = labels.where("quality = 1").select("doc_id").orderBy(*by_hash).limit(importance_sampling.TARGET_TEXTS)
    n = labels.agg(F.count("*").alias("n"), F.count(F.when(F.col("quality") == 1, 1)).alias("good")).first()
    share = n["good"] / n["n"] if n["n"] else 1.0
    return importance_sampling.resample(documents(spark, sf_dir), good, share).select("doc_id", held_out().alias("held_out"), "n_grams", "log_weight", "sample_key", "kept")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, Jaccard similarity of 0.9 or more, over all documents."""
    return ngram_join.jaccard_components(documents(spark, sf_dir), k=3, num=90, den=100)


def toxic_lexicon(spark: SparkSession, sf_dir: str) -> toxicity.Lexicon:
    """Learned from the labelled documents that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.learn(toxicity.training_sample(documents(spark, sf_dir), labels, ~held_out()))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.toxicity_scores(documents(spark, sf_dir), toxic_lexicon(spark, sf_dir)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "n_hits"
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts differ by one at most."""
    return hash_ring.shard_rows(documents(spark, sf_dir), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = documents(spark, sf_dir)
    model = language_id.learn(docs.where(~held_out()))
    return language_id.identify_languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    found = licences.scan_licences(documents(spark, sf_dir))
    return found.select("doc_id", "n_units", "n_matches", F.array_join("licences", ",").alias("licences"), "best", "dice")


def _joined(spans) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, by the base rules and more."""
    base = [r.kind for r in secret_scan.BASE_RULES]
    found = secret_scan.scan_secrets(documents(spark, sf_dir))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda x: x["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(_joined(of(*base)), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10-word windows of the benchmark in all documents."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.benchmark_overlaps(documents(spark, sf_dir), bench, window=10, k=5).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all sources by weights 5, 2, 1 within the budget of all words."""
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size")).alias("taken"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of all documents and of their edited texts."""
    return merkle.edit_audit(documents(spark, sf_dir))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 leading whitened components of all embeddings."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=32)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of five filters over all documents, by language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_audit.audit(filter_audit.failure_counts(documents(spark, sf_dir), labels))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_toxicity": op4_toxicity,
    "op5_sharding": op5_sharding,
    "op6_language_id": op6_language_id,
    "op7_licence_scan": op7_licence_scan,
    "op8_secret_scan": op8_secret_scan,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_mixing": op10_mixing,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_filter_audit": op13_filter_audit,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op11_document_fingerprints": oracle.MERKLE,
    "op13_filter_audit": oracle.FILTER_AUDIT,
}
