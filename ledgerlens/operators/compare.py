"""Comparison of two statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_statements(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changes from one cleaned statement to another, as (transaction_date, description,
    change, amount_before, amount_after, n). Repeated rows count: n is how many rows more
    (``added``) or fewer (``removed``) the second has. Where a day and description lose rows of
    one amount and gain rows of one other, as many as both are ``changed``.

    One shuffle of both statements by (day, description, amount), combined map-side, and one of the
    differences."""
    rows = before.select("transaction_date", "description", "amount", F.lit(-1).alias("_n")).unionByName(
        after.select("transaction_date", "description", "amount", F.lit(1).alias("_n")))
    diff = rows.groupBy("transaction_date", "description", "amount").agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)
    gone, new = F.col("_n") < 0, F.col("_n") > 0
    place = diff.groupBy("transaction_date", "description").agg(
        F.count_if(gone).alias("_gone"), F.count_if(new).alias("_new"),
        F.min(F.when(gone, F.col("amount"))).alias("_a"), F.min(F.when(new, F.col("amount"))).alias("_b"),
        F.sum(F.when(gone, -F.col("_n")).otherwise(0)).alias("_lost"), F.sum(F.when(new, F.col("_n")).otherwise(0)).alias("_won"),
    )
    place = place.withColumn("_pairs", F.when((F.col("_gone") == 1) & (F.col("_new") == 1), F.least("_lost", "_won")).otherwise(0))
    pairs = place.where("_pairs > 0").select("transaction_date", "description", F.lit("changed").alias("change"),
                                             F.col("_a").alias("amount_before"), F.col("_b").alias("amount_after"), F.col("_pairs").alias("n"))
    left = diff.join(place.select("transaction_date", "description", "_pairs"), ["transaction_date", "description"])
    left = left.withColumn("n", F.abs("_n") - F.col("_pairs")).where("n > 0")
    rest = left.select("transaction_date", "description", F.when(gone, "removed").otherwise("added").alias("change"),
                       F.when(gone, F.col("amount")).alias("amount_before"), F.when(new, F.col("amount")).alias("amount_after"), "n")
    return pairs.unionByName(rest)


def compare_categories(before: DataFrame, after: DataFrame) -> DataFrame:
    """Spend per category in two transaction views and its change (0 where a category is missing)."""
    def spent(view: DataFrame, name: str) -> DataFrame:
        return view.where("amount < 0").groupBy("category").agg(F.abs(F.sum("amount")).alias(name))

    both = spent(before, "spent_before").join(spent(after, "spent_after"), "category", "full_outer").na.fill(0, ["spent_before", "spent_after"])
    return both.withColumn("change", F.col("spent_after") - F.col("spent_before"))
