"""The denormalised transaction view and the dashboard's filtered views."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import defaults as D
from ledgerlens.operators.joins import broadcast_if_small, known_rows

VIEW_COLUMNS = [
    "transaction_hash", "transaction_date", "amount", "description", "transaction_code",
    "code_description", "merchant", "category", "month", "day", "is_expense",
]


@dataclass(frozen=True)
class FilterState:
    """Every dashboard filter in one value. An empty list means "no filter"."""

    selected_months: Sequence[str] = ()
    selected_categories: Sequence[str] = ()
    show_transfers: bool = False
    show_income: bool = False


def transactions_view(
    transactions: DataFrame, merchants: DataFrame, categories: DataFrame, codes: DataFrame
) -> DataFrame:
    """Transactions joined to their merchant, the merchant's category and the code description,
    with month, day of month and an expense flag. A transaction's category is its merchant's.

    Categories and codes are small, bounded dimensions (broadcast after a size check). The
    merchant dimension grows with the data, so that join is left to the planner: a broadcast
    when AQE sees it is small at run time, a skew-aware sort-merge join otherwise.
    """
    t = transactions.drop("category").alias("t")  # the category comes through the merchant here
    m = merchants.select(F.col("merchant").alias("_m_name"), F.col("category").alias("_m_cat"))
    c = categories.select(F.col("name").alias("category"))
    k = codes.select(F.col("code").alias("_code"), F.col("description").alias("code_description"))
    df = (
        t.join(m, F.col("t.merchant") == F.col("_m_name"))
        .join(broadcast_if_small(c, rows=known_rows(categories)), F.col("_m_cat") == F.col("category"))
        .join(broadcast_if_small(k, rows=known_rows(codes)), F.col("t.transaction_code") == F.col("_code"), "left")
    )
    return df.select(
        "t.transaction_hash", "t.transaction_date", "t.amount", "t.description", "t.transaction_code",
        "code_description", "t.merchant", "category",
        F.col("t.year_month").alias("month"),  # = yyyy-MM of the date; the fact partition column
        F.dayofmonth("t.transaction_date").alias("day"),
        (F.col("t.amount") < 0).alias("is_expense"),
    )


def stored_transactions_view(transactions: DataFrame, categories: DataFrame, codes: DataFrame) -> DataFrame:
    """Same columns as :func:`transactions_view`, for fact rows that carry their merchant's
    category (the warehouse writes it at load time): only bounded dimensions are joined."""
    t = transactions.alias("t")
    c = categories.select(F.col("name").alias("_cat"))
    k = codes.select(F.col("code").alias("_code"), F.col("description").alias("code_description"))
    df = (
        t.join(broadcast_if_small(c, rows=known_rows(categories)), F.col("t.category") == F.col("_cat"))
        .join(broadcast_if_small(k, rows=known_rows(codes)), F.col("t.transaction_code") == F.col("_code"), "left")
    )
    return df.select(
        "t.transaction_hash", "t.transaction_date", "t.amount", "t.description", "t.transaction_code",
        "code_description", "t.merchant", "t.category",
        F.col("t.year_month").alias("month"),  # = yyyy-MM of the date; the fact partition column
        F.dayofmonth("t.transaction_date").alias("day"),
        (F.col("t.amount") < 0).alias("is_expense"),
    )


def _months(df: DataFrame, state: FilterState) -> DataFrame:
    return df.filter(F.col("month").isin(*state.selected_months)) if state.selected_months else df


def _categories(df: DataFrame, state: FilterState) -> DataFrame:
    return df.filter(F.col("category").isin(*state.selected_categories)) if state.selected_categories else df


def month_scoped(view: DataFrame, state: FilterState) -> DataFrame:
    """Selected months only (all when none selected); used for income and net-flow figures."""
    return _months(view, state)


def expense_condition(state: FilterState, transfer_categories: Sequence[str] = D.TRANSFER_TYPE_CATEGORIES) -> Column:
    """What the expense view asks of a row, beside its month."""
    keep = F.col("amount") < 0
    if state.selected_categories:
        keep = keep & F.col("category").isin(*state.selected_categories)
    if not state.show_transfers:
        keep = keep & ~F.col("category").isin(*transfer_categories)
    return keep


def expense_view(view: DataFrame, state: FilterState,
                 transfer_categories: Sequence[str] = D.TRANSFER_TYPE_CATEGORIES) -> DataFrame:
    """Months -> categories -> expenses only -> transfer-type categories dropped unless shown."""
    return _months(view, state).filter(expense_condition(state, transfer_categories))


def full_view(view: DataFrame, state: FilterState) -> DataFrame:
    """Months -> categories -> expenses only unless income is shown (the transaction log)."""
    df = _categories(_months(view, state), state)
    return df if state.show_income else df.filter(F.col("amount") < 0)


def search(df: DataFrame, query: str, regex: bool = False) -> DataFrame:
    """Rows whose merchant or description contains ``query``, ignoring case. With
    ``regex=True`` the query is a Java regular expression."""
    if not query:
        return df
    if regex:
        pattern = "(?i)" + query
        hit = lambda c: F.coalesce(F.col(c).rlike(pattern), F.lit(False))
    else:
        needle = F.lower(F.lit(query))
        hit = lambda c: F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False))
    return df.filter(hit("merchant") | hit("description"))


def display_log(df: DataFrame, columns: Sequence[tuple[str, str]] = D.LOG_COLUMNS) -> DataFrame:
    """Six display columns with display names; the date as ISO text, money as double."""
    out = []
    for src, name in columns:
        c = F.col(src)
        if src == "transaction_date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif src == "amount":
            c = c.cast("double")
        out.append(c.alias(name))
    return df.select(*out)


def export_csv(view: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write the transaction log of a (filtered) view as CSV files with the display columns,
    newest first across the files and within each; ``path`` is replaced only by a complete write.
    Quotes are doubled, and line breaks stay inside quotes."""
    order = [F.col("transaction_date").desc(), "transaction_hash"]
    shown = display_log(view.sort(*order))
    shown.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("maxRecordsPerFile", rows_per_file).csv(path)


def read_exported(spark, path: str) -> DataFrame:
    """The rows of an export, amounts as double."""
    names = [name for _, name in D.LOG_COLUMNS]
    text = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return text.select(*[F.col(n).cast("double").alias(n) if n.startswith("Amount") else F.col(n) for n in names])
