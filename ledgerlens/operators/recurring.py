"""Recurring payments: series of one merchant and amount band whose gaps keep a rhythm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.money import cents

#: (name, days, tolerance in days, months to the next payment or 0 for ``days``).
CADENCES: tuple[tuple[str, int, int, int], ...] = (
    ("weekly", 7, 1, 0),
    ("fortnightly", 14, 2, 0),
    ("monthly", 30, 4, 1),
    ("quarterly", 91, 8, 3),
    ("yearly", 365, 15, 12),
)


def amount_band(amount: Column) -> Column:
    """Lower end of an amount's band in whole cents (decimal): its two leading digits, so a band is
    1 to 10 per cent wide; sign ignored."""
    text = F.abs(cents(amount)).cast("string")
    return F.concat(F.substring(text, 1, 2), F.repeat(F.lit("0"), F.greatest(F.length(text) - 2, F.lit(0)))).cast("decimal(38,0)")


def payment_series(expenses: DataFrame, min_days: int = 3, min_share: float = 0.8, cadences: Sequence[tuple[str, int, int, int]] = CADENCES) -> DataFrame:
    """One row per (merchant, amount band) paid on ``min_days`` days or more: first and last
    day, days, payments, spend, median gap in days, cadence (the first whose length the median gap
    keeps within its tolerance; null: none), the share of gaps that keep it, whether that is
    ``min_share`` or more (``recurring``), and the day the next payment is due (null if not
    recurring).

    Payments are first reduced to days (combined map-side), so a series is as long as its
    calendar, and a merchant with a third of all rows is split by band. A price that
    moves to another band starts a series of its own."""
    bands = expenses.select("merchant", "transaction_date", "amount", amount_band(F.col("amount")).alias("_band"))
    days = bands.groupBy("merchant", "_band", "transaction_date").agg(F.count("*").alias("_n"), F.sum("amount").alias("_sum"))
    order = W.partitionBy("merchant", "_band").orderBy("transaction_date")
    days = days.withColumn("_gap", F.datediff("transaction_date", F.lag("transaction_date").over(order)))
    series = days.groupBy("merchant", "_band").agg(
        F.count("*").alias("days"), F.sum("_n").alias("payments"), F.abs(F.sum("_sum")).alias("spent"),
        F.min("transaction_date").alias("first_date"), F.max("transaction_date").alias("last_date"),
        F.percentile("_gap", F.lit(0.5)).alias("median_gap"), F.collect_list("_gap").alias("_gaps"),
    ).where(F.col("days") >= min_days)
    cadence, length, slack, months = (F.lit(None).cast(t) for t in ("string", "int", "int", "int"))
    for name, d, tol, m in reversed(cadences):
        fits = F.abs(F.col("median_gap") - d) <= tol
        cadence, length = F.when(fits, name).otherwise(cadence), F.when(fits, d).otherwise(length)
        slack, months = F.when(fits, tol).otherwise(slack), F.when(fits, m).otherwise(months)
    series = series.withColumns({"cadence": cadence, "_days": length, "_slack": slack, "_months": months})
    kept = F.size(F.filter("_gaps", lambda g: F.abs(g - F.col("_days")) <= F.col("_slack")))
    share = F.when(F.col("cadence").isNotNull(), kept / F.size("_gaps")).otherwise(F.lit(0.0))
    series = series.withColumn("regular_share", share)
    due = F.when(F.col("_months") > 0, F.add_months("last_date", F.col("_months"))).otherwise(F.date_add("last_date", F.col("_days")))
    recurring = F.col("cadence").isNotNull() & (F.col("regular_share") >= min_share)
    return series.select(
        "merchant", (F.col("_band").cast("double") / 100.0).alias("band_from"), "days", "payments", "spent", "first_date", "last_date",
        "median_gap", "cadence", "regular_share", recurring.alias("recurring"), F.when(recurring, due).alias("next_due"),
    )
