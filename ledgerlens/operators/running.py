"""Running sums and statistics of earlier rows, in two levels.

No window runs over all rows of a month or of a merchant: rows are first summed per day (and per
slot of 256 within a day), which combines map-side; the sums are added up over the days, a few
thousand rows for each month or merchant at most, however many transactions it has; then each row gets its
day's sum of everything before by a join on (group, day), which a frequent group spreads over its days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.money import cents


def running_sum(df: DataFrame, value: str, out: str, group: str = "month", day: str = "transaction_date", tie: str = "transaction_hash") -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of ``group`` up to this one, by
    ``day``, then ``tie`` (a hex text). Rows that are equal in all three share no order; each
    gets a sum of its own."""
    keyed = df.withColumn("_slot", F.substring(tie, 1, 2))
    sums = keyed.groupBy(group, day, "_slot").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(group).orderBy(day, "_slot").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast(sums.schema["_sum"].dataType)
    sums = sums.select(group, day, "_slot", F.coalesce(F.sum("_sum").over(before), zero).alias("_before"))
    within = W.partitionBy(group, day, "_slot").orderBy(tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = keyed.join(sums, [group, day, "_slot"])
    return joined.withColumn(out, F.col("_before") + F.sum(value).over(within)).select(*df.columns, out)


def running_month_spend(expenses: DataFrame) -> DataFrame:
    """The month's spend so far at every expense row: by date, within a date by fingerprint."""
    rows = expenses.select("month", "transaction_date", "transaction_hash", (-F.col("amount")).alias("spent"))
    return running_sum(rows, "spent", "spent_so_far")


def running_day_spend(expenses: DataFrame) -> DataFrame:
    """The month's spend so far at the end of every day with an expense."""
    days = expenses.groupBy("month", "transaction_date").agg((-F.sum("amount")).alias("spent"))
    so_far = W.partitionBy("month").orderBy("transaction_date").rowsBetween(W.unboundedPreceding, W.currentRow)
    return days.withColumn("spent_so_far", F.sum("spent").over(so_far))


def unusual_amounts(view: DataFrame, min_history: int = 5, deviations: float = 3.0) -> DataFrame:
    """Every transaction beside its merchant's earlier amounts: prior_count, prior_mean and
    prior_std (population) over the rows of earlier days, and ``unusual``: more than
    ``deviations`` standard deviations from the mean, with ``min_history`` earlier rows or more.

    A statement has no time of day, so rows of one day are not earlier than each other. Days
    keep count, sum and sum of squares in whole cents (exact decimals that merge in any order); only the
    final mean and deviation are floating point. Without earlier rows mean and deviation are null."""
    rows = view.select("transaction_hash", "merchant", "transaction_date", "amount", cents(F.col("amount")).alias("_c"))
    days = rows.groupBy("merchant", "transaction_date").agg(
        F.count("*").alias("_n"), F.sum("_c").alias("_s"), F.sum((F.col("_c") * F.col("_c")).cast("decimal(38,0)")).alias("_q"),
    )
    before = W.partitionBy("merchant").orderBy("transaction_date").rowsBetween(W.unboundedPreceding, -1)
    prior = days.select(
        "merchant", "transaction_date", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("prior_count"),
        F.sum("_s").over(before).cast("double").alias("_s"), F.sum("_q").over(before).cast("double").alias("_q"),
    )
    n = F.when(F.col("prior_count") > 0, F.col("prior_count").cast("double"))
    mean = F.col("_s") / n
    spread = F.when(n.isNotNull(), F.sqrt(F.greatest(F.col("_q") / n - mean * mean, F.lit(0.0))))
    joined = rows.join(prior, ["merchant", "transaction_date"]).withColumns({"_mean": mean, "_std": spread})
    far = F.abs(F.col("_c").cast("double") - F.col("_mean")) > F.lit(float(deviations)) * F.col("_std")
    return joined.select(
        "transaction_hash", "merchant", "transaction_date", "amount", "prior_count",
        (F.col("_mean") / 100.0).alias("prior_mean"), (F.col("_std") / 100.0).alias("prior_std"),
        F.coalesce((F.col("prior_count") >= min_history) & far, F.lit(False)).alias("unusual"),
    )
