"""Declared schemas and column contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlens import defaults as D

# Raw statement file: every column is text; only the code column may be absent.
RAW_STATEMENT = T.StructType([T.StructField(name, T.StringType(), True) for name in D.STATEMENT_COLUMNS])
REQUIRED_HEADERS = ["Transaction Date", "Description", "Withdrawal Amount", "Deposit Amount"]

MONEY = T.DecimalType(28, 2)

CLEAN_COLUMNS = [
    "transaction_date", "year_month", "amount", "description",
    "transaction_code", "merchant_name", "transaction_hash",
]

CODES = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
])

CATEGORIES = T.StructType([
    T.StructField("category_id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
])

MERCHANTS = T.StructType([
    T.StructField("merchant", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
])

TRANSACTIONS = T.StructType([
    T.StructField("transaction_hash", T.StringType(), False),
    T.StructField("transaction_date", T.DateType(), False),
    T.StructField("year_month", T.StringType(), False),
    T.StructField("amount", MONEY, False),
    T.StructField("description", T.StringType(), False),
    T.StructField("merchant", T.StringType(), False),
    T.StructField("transaction_code", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
    # The merchant's category, written at load time. A merchant's category never changes after
    # the merchant is created, so this equals the join through the merchant table.
    T.StructField("category", T.StringType(), True),
])

# Categories that a user has set for a merchant; the highest version of a merchant holds.
OVERRIDES = T.StructType([
    T.StructField("merchant", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("version", T.LongType(), False),
])

BUDGETS = T.StructType([
    T.StructField("category", T.StringType(), False),
    T.StructField("monthly_limit", T.DoubleType(), False),
])


class MissingColumnsError(ValueError):
    """Raised when a statement lacks required columns; carries their names."""

    def __init__(self, missing: list[str]):
        super().__init__("statement is missing required column(s): " + ", ".join(missing))
        self.missing = missing


def check_required_columns(df: DataFrame, required: list[str] = REQUIRED_HEADERS) -> None:
    """Fail early with the names of the missing columns (before any renaming)."""
    missing = [c for c in required if c not in df.columns and D.STATEMENT_COLUMNS[c] not in df.columns]
    if missing:
        raise MissingColumnsError(missing)
