"""Dashboard roll-ups. All are partial+final hash aggregations; money is summed as decimal
and turned into double only in the output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import defaults as D
from ledgerlens.functions.money import cents, ratio_half_even


def _spent() -> F.Column:
    return F.abs(F.sum("amount"))


def spend_by_category(expenses: DataFrame) -> DataFrame:
    """(category, spent): absolute value of the summed amounts."""
    return expenses.groupBy("category").agg(_spent().cast("double").alias("spent"))


def monthly_trend(expenses: DataFrame) -> DataFrame:
    return expenses.groupBy("month", "category").agg(_spent().cast("double").alias("spent"))


def daily_spend(expenses: DataFrame) -> DataFrame:
    """Day of month x category; months are overlaid, not separated."""
    return expenses.groupBy("day", "category").agg(_spent().cast("double").alias("spent"))


def top_merchants(expenses: DataFrame, n: int = D.TOP_MERCHANTS_N) -> DataFrame:
    """Top ``n`` merchants by absolute total, ties by name (a per-partition top-n, then one
    small merge: no full sort)."""
    agg = expenses.groupBy("merchant", "category").agg(
        _spent().alias("_total"), F.count("amount").alias("txns")
    )
    return (
        agg.orderBy(F.desc("_total"), F.asc("merchant"))
        .limit(n)
        .select("merchant", "category", F.col("_total").cast("double").alias("total"), "txns")
    )


def category_share(expenses: DataFrame) -> DataFrame:
    """(category, spent, share_pct) with share rounded half-even to 0.1 from exact cents; 0 when
    nothing was spent. The total is a window over the per-category result, which has one row
    per category, so it is tiny whatever the data size."""
    per = expenses.groupBy("category").agg(_spent().alias("_spent"))
    total = F.sum(cents(F.col("_spent"))).over(Window.partitionBy())
    share = F.coalesce(ratio_half_even(cents(F.col("_spent")), total, 100, 1), F.lit(0.0))
    return per.select("category", F.col("_spent").cast("double").alias("spent"), share.alias("share_pct"))


def share_axis_bound(shares: DataFrame) -> DataFrame:
    """Upper bound of the share chart axis: largest share x 1.25."""
    return shares.agg((F.max("share_pct") * 1.25).alias("axis_max"))


def kpis(month_scope: DataFrame, is_expense: F.Column) -> DataFrame:
    """Income, spend and net flow of the month-scoped view, and the distinct merchants of its
    rows that satisfy ``is_expense`` (see ``views.expense_condition``). One pass: sums per
    merchant first, then one row."""
    amount = F.col("amount")
    per = month_scope.groupBy("merchant").agg(
        F.sum(F.when(amount > 0, amount)).alias("_in"),
        F.sum(F.when(amount < 0, amount)).alias("_out"),
        F.max(F.when(is_expense & F.col("merchant").isNotNull(), 1).otherwise(0)).alias("_seen"),
    )
    one = per.agg(
        F.coalesce(F.sum("_in"), F.lit(0)).alias("_in"), F.coalesce(F.sum("_out"), F.lit(0)).alias("_out"),
        F.coalesce(F.sum("_seen"), F.lit(0)).cast("long").alias("unique_merchants"),
    )
    return one.select(
        F.col("_in").cast("double").alias("total_income"),
        F.abs(F.col("_out")).cast("double").alias("total_spent"),
        (F.col("_in") + F.col("_out")).cast("double").alias("net_flow"),
        "unique_merchants",
    )


def income_vs_spend(month_scope: DataFrame) -> DataFrame:
    """Long form (month, value, type): income and spend per month, from one pass."""
    amount = F.col("amount")
    per = month_scope.groupBy("month").agg(
        F.sum(F.when(amount > 0, amount)).cast("double").alias("Income"),
        F.abs(F.sum(F.when(amount < 0, amount))).cast("double").alias("Spend"),
    )
    return per.unpivot("month", ["Income", "Spend"], "type", "value").where("value is not null").select("month", "value", "type")


def default_budgets(view: DataFrame, excluded: Sequence[str] = D.EXCLUDE_FROM_SPEND) -> DataFrame:
    """Budget table used when none is stored: every category seen, minus the excluded ones,
    with a zero limit."""
    return (
        view.select("category").distinct()
        .filter(~F.col("category").isin(*excluded))
        .withColumn("monthly_limit", F.lit(0.0))
    )


def budget_variance(expenses: DataFrame, budgets: DataFrame, months: int = 1) -> DataFrame:
    """Spend per category against the monthly limits: full outer join on category, missing
    values 0, rows with neither budget nor spend dropped, remaining = limit - spent and
    utilisation = spent / (limit, or 1 when the limit is 0) * 100. By default the monthly limit
    is compared with the spend over all selected months, as is; ``months=n`` scales the limit
    to an n-month selection."""
    # Keys are renamed on both sides: budgets may be derived from the same view as the spend.
    spent = spend_by_category(expenses).withColumnRenamed("category", "_s_cat")
    b = budgets.select(F.col("category").alias("_b_cat"),
                       (F.col("monthly_limit").cast("double") * months).alias("monthly_limit"))
    merged = b.join(spent, F.col("_b_cat").eqNullSafe(F.col("_s_cat")), "full_outer").select(
        F.coalesce(F.col("_b_cat"), F.col("_s_cat")).alias("category"),
        F.coalesce(F.col("monthly_limit"), F.lit(0.0)).alias("monthly_limit"),
        F.coalesce(F.col("spent"), F.lit(0.0)).alias("spent"),
    )
    merged = merged.filter((F.col("monthly_limit") > 0) | (F.col("spent") > 0))
    limit = F.when(F.col("monthly_limit") == 0, F.lit(1.0)).otherwise(F.col("monthly_limit"))
    return merged.withColumns({
        "remaining": F.col("monthly_limit") - F.col("spent"),
        "utilisation_pct": F.col("spent") / limit * 100,
    })


def budget_long(variance: DataFrame, labels: dict[str, str] = D.METRIC_LABELS) -> DataFrame:
    """Melt (spent, monthly_limit) to (category, Metric, Amount) with display labels."""
    long = variance.unpivot("category", ["spent", "monthly_limit"], "Metric", "Amount")
    label = F.coalesce(*[F.when(F.col("Metric") == k, F.lit(v)) for k, v in labels.items()])
    return long.withColumn("Metric", label)


def uncategorised_review(view: DataFrame) -> DataFrame:
    """Uncategorised rows per merchant: count and total."""
    return view.filter(F.col("category") == D.UNCATEGORISED).groupBy("merchant").agg(
        F.count("amount").alias("Count"), F.sum("amount").cast("double").alias("Total_SGD")
    )


def uncategorised_totals(view: DataFrame) -> DataFrame:
    return view.filter(F.col("category") == D.UNCATEGORISED).agg(
        F.count("*").alias("uncategorised_rows"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("uncategorised_total"),
    )
