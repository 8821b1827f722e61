"""Load summary and audit reports over the star schema (all set-based aggregates)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import defaults as D
from ledgerlens.operators.joins import broadcast_if_small, known_rows
from ledgerlens.functions.money import cents, idiv, mean_half_up

NO_CODE = "(none)"


def _money(c) -> F.Column:
    return F.round(c, 2).cast("double")


def category_summary(view: DataFrame) -> DataFrame:
    """Rows and total per category (total rounded to cents)."""
    return view.groupBy("category").agg(F.count("*").alias("n"), _money(F.sum("amount")).alias("total"))


def load_stats(view: DataFrame) -> DataFrame:
    """Rows, coded rows, distinct merchants and uncategorised rows, with floor percentages
    (denominator at least 1)."""
    agg = view.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("transaction_code").isNotNull()).alias("coded"),
        F.countDistinct("merchant").alias("merchants"),
        F.count_if(F.col("category") == D.UNCATEGORISED).alias("uncategorised"),
    )
    den = F.greatest(F.col("total"), F.lit(1))
    return agg.withColumns({
        "coded_pct": idiv(F.col("coded") * 100, den),
        "uncategorised_pct": idiv(F.col("uncategorised") * 100, den),
    })


def code_coverage(view: DataFrame) -> DataFrame:
    """Share of rows with a stored code, in percent."""
    return view.agg(
        (F.count_if(F.col("transaction_code").isNotNull()) / F.greatest(F.count("*"), F.lit(1)) * 100)
        .alias("coverage_pct"),
        F.count("*").alias("rows"),
    )


def by_code(view: DataFrame, category: str, with_avg: bool = False) -> DataFrame:
    """Rows of one category per stored code (null code is its own group)."""
    aggs = [F.count("*").alias("n"), _money(F.sum("amount")).alias("total")]
    if with_avg:
        aggs.append(mean_half_up(cents(F.sum("amount")), F.count("*")).alias("avg_amt"))
    out = view.filter(F.col("category") == category).groupBy("transaction_code").agg(*aggs)
    return out.withColumn("code_label", F.coalesce("transaction_code", F.lit(NO_CODE)))


def transfers_by_code(view: DataFrame, limit: int = 20) -> DataFrame:
    return by_code(view, "Transfers", with_avg=True).orderBy(
        F.desc("n"), F.asc_nulls_first("transaction_code")).limit(limit)


def transfers_preview(view: DataFrame, limit: int = 25) -> DataFrame:
    """Largest outgoing transfers: 40-char description preview, code, amount."""
    return (
        view.filter(F.col("category") == "Transfers")
        .select(
            F.substring("description", 1, 40).alias("desc_preview"),
            "transaction_code", F.col("amount").cast("double").alias("amount"), "transaction_hash",
        )
        .orderBy("amount", "transaction_hash")
        .limit(limit)
    )


def paynow_by_code(view: DataFrame) -> DataFrame:
    return by_code(view, D.OUTBOUND_CATEGORY)


def income_by_code(view: DataFrame) -> DataFrame:
    return by_code(view, D.INCOME_CATEGORY)


def uncategorised_patterns(view: DataFrame, limit: int = 30) -> DataFrame:
    """Uncategorised rows by code and 35-char description prefix, most frequent first."""
    return (
        view.filter(F.col("category") == D.UNCATEGORISED)
        .groupBy("transaction_code", F.substring("description", 1, 35).alias("desc_prefix"))
        .agg(F.count("*").alias("n"), _money(F.sum("amount")).alias("total"))
        .orderBy(F.desc("n"), F.asc("total"), F.asc_nulls_first("transaction_code"), F.asc("desc_prefix"))
        .limit(limit)
    )


def merchant_counts(merchants: DataFrame, transactions: DataFrame) -> DataFrame:
    """Every merchant with its number of transactions (0 when it has none). Transactions are
    counted per merchant first, so the join sees one row per merchant on both sides."""
    per = transactions.groupBy("merchant").agg(F.count("*").alias("txn_count"))
    return merchants.select("merchant").join(per, "merchant", "left").select(
        "merchant", F.coalesce("txn_count", F.lit(0)).alias("txn_count"))


def singleton_merchants(merchants: DataFrame, transactions: DataFrame, limit: int = 30) -> DataFrame:
    return merchant_counts(merchants, transactions).filter("txn_count = 1").orderBy("merchant").limit(limit)


def singleton_merchant_count(merchants: DataFrame, transactions: DataFrame) -> DataFrame:
    return merchant_counts(merchants, transactions).filter("txn_count = 1").agg(
        F.count("*").alias("n_singletons"))


def distinct_dates(transactions: DataFrame, limit: int = 10) -> DataFrame:
    return (
        transactions.select(F.date_format("transaction_date", "yyyy-MM-dd").alias("transaction_date"))
        .distinct().orderBy("transaction_date").limit(limit)
    )


def uncoded_by_category(view: DataFrame) -> DataFrame:
    return view.filter(F.col("transaction_code").isNull()).groupBy("category").agg(
        F.count("*").alias("no_code_count"))


def codes_per_category(codes: DataFrame, categories: DataFrame) -> DataFrame:
    """Codes per category name (codes joined to the category dimension)."""
    c = categories.select(F.col("name").alias("category"))
    return codes.join(broadcast_if_small(c, rows=known_rows(categories)), "category").groupBy("category").agg(F.count("*").alias("cnt"))


def code_listing(codes: DataFrame, categories: DataFrame, limit: int = 20) -> DataFrame:
    c = categories.select(F.col("name").alias("category"))
    return (
        codes.join(broadcast_if_small(c, rows=known_rows(categories)), "category")
        .select("code", "description", "category")
        .orderBy("category", "code")
        .limit(limit)
    )


def filter_options(view: DataFrame) -> DataFrame:
    """Choices of the filter widgets as (kind, value) rows: months and categories, from one pass
    (the distinct pairs first, one row per month and category)."""
    pairs = view.groupBy("month", "category").agg(F.count(F.lit(1)).alias("_n"))
    kinds = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("month", "category")]))
    return pairs.select(kinds).where("kind = 'month' or value is not null").distinct()


def category_names(categories: DataFrame) -> DataFrame:
    """All category names, sorted."""
    return categories.select("name").orderBy("name")
