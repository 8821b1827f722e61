"""Data-quality checks over the star schema: ratios, referential integrity, uniqueness and
not-null. Each check is an aggregate or an anti-join that returns counts, never rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import defaults as D
from ledgerlens.operators.joins import broadcast_if_small, known_rows


def quality_ratios(view: DataFrame) -> DataFrame:
    """Transfer share, uncategorised share, largest non-Income category share (all in % of
    rows) and whether there are fewer merchants than transactions. The per-category counts are
    one row per category, so the second aggregate is tiny. A merchant has one category, so
    summing distinct merchants per category counts each merchant once."""
    per = view.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("merchant").alias("m"))
    agg = per.agg(
        F.sum("n").alias("rows"),
        F.sum("m").alias("merchants"),
        F.coalesce(F.sum(F.when(F.col("category") == "Transfers", F.col("n"))), F.lit(0)).alias("_tr"),
        F.coalesce(F.sum(F.when(F.col("category") == D.UNCATEGORISED, F.col("n"))), F.lit(0)).alias("_un"),
        F.coalesce(F.max(F.when(F.col("category") != D.INCOME_CATEGORY, F.col("n"))), F.lit(0)).alias("_top"),
    )
    den = F.greatest(F.col("rows"), F.lit(1))
    return agg.select(
        "rows", "merchants",
        (F.col("_tr") * 100.0 / den).alias("transfers_pct"),
        (F.col("_un") * 100.0 / den).alias("uncategorised_pct"),
        (F.col("_top") * 100.0 / den).alias("largest_category_pct"),
        (F.col("_tr") * 100.0 / den < 15).alias("transfers_ok"),
        (F.col("_un") * 100.0 / den < 10).alias("uncategorised_ok"),
        (F.col("_top") * 100.0 / den <= 30).alias("largest_category_ok"),
        (F.col("merchants") < F.col("rows")).alias("merchants_ok"),
    )


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def referential_check(transactions: DataFrame, merchants: DataFrame, categories: DataFrame,
                      codes: DataFrame) -> DataFrame:
    """Orphan counts: transaction -> merchant, merchant -> category, code -> category,
    transaction -> code (stored codes only)."""
    cats = categories.select(F.col("name").alias("category"))
    checks = [
        _count(transactions.join(merchants.select("merchant"), "merchant", "left_anti"), "transaction_merchant"),
        _count(merchants.join(broadcast_if_small(cats, rows=known_rows(categories)), "category", "left_anti"), "merchant_category"),
        _count(codes.join(broadcast_if_small(cats, rows=known_rows(categories)), "category", "left_anti"), "code_category"),
        _count(
            transactions.filter(F.col("transaction_code").isNotNull())
            .join(broadcast_if_small(codes.select(F.col("code").alias("transaction_code")), rows=known_rows(codes)), "transaction_code", "left_anti"),
            "transaction_code",
        ),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def _dupes(df: DataFrame, key: str, name: str) -> DataFrame:
    return (
        df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1")
        .agg(F.count("*").alias("duplicate_keys"))
        .select(F.lit(name).alias("check"), "duplicate_keys")
    )


def uniqueness_check(transactions: DataFrame, merchants: DataFrame, categories: DataFrame,
                     codes: DataFrame) -> DataFrame:
    parts = [
        _dupes(transactions, "transaction_hash", "transaction_hash"),
        _dupes(merchants, "merchant", "merchant_name"),
        _dupes(categories, "name", "category_name"),
        _dupes(codes, "code", "code"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def null_check(transactions: DataFrame, merchants: DataFrame) -> DataFrame:
    """Nulls in required columns: one row per (table, column)."""
    t_cols = ["transaction_hash", "transaction_date", "amount", "description", "merchant"]
    m_cols = ["merchant", "category"]
    t = transactions.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in t_cols])
    m = merchants.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in m_cols])
    t_long = t.unpivot([], t_cols, "column", "nulls").withColumn("table", F.lit("transactions"))
    m_long = m.unpivot([], m_cols, "column", "nulls").withColumn("table", F.lit("merchants"))
    return t_long.unionByName(m_long).select("table", "column", "nulls")
