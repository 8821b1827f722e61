"""Dimension loading where the first writer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_writer_dimension(
    batch: DataFrame,
    key: str = "merchant_name",
    value: str = "row_category",
    order: str = "seq",
    existing: DataFrame | None = None,
    out_key: str = "merchant",
    out_value: str = "category",
) -> DataFrame:
    """New dimension rows: one per ``key`` of the batch, valued by its first row (lowest
    ``order``), minus the keys already in ``existing``. Existing rows are never changed, so a
    merchant's category is fixed by the first row ever seen for it.

    ``min_by`` aggregates map-side, so one very frequent merchant costs one row per map task.
    """
    new = batch.groupBy(F.col(key).alias(out_key)).agg(F.min_by(value, order).alias(out_value))
    if existing is not None:
        new = new.join(existing.select(out_key), out_key, "left_anti")
    return new


def first_writer_categories(
    batch: DataFrame,
    existing: DataFrame | None = None,
    key: str = "merchant_name",
    order: str = "seq",
    keywords=None,
) -> DataFrame:
    """New (merchant, category) rows where the category is the cascade applied to the merchant's
    first row. ``batch`` carries the raw code and its code-table category (see
    ``categorise.lookup_codes``).

    Only the first row of each new merchant is categorised, so the keyword matching costs one
    evaluation per merchant instead of one per transaction; the result is the same as
    categorising every row and keeping the first row's category, because a category is a
    function of its row. The keywords are matched with the literal-array form, whose generated
    code stays small even when the optimizer copies the category into a pushed-down filter.
    """
    from ledgerlens import defaults as D
    from ledgerlens.functions.rules import first_match_array
    from ledgerlens.operators.categorise import CODE_CATEGORY, cascade_with_keyword

    inputs = F.struct("transaction_code", CODE_CATEGORY, "description", "amount")
    first = batch.groupBy(F.col(key).alias("merchant")).agg(F.min_by(inputs, order).alias("_first"))
    if existing is not None:
        first = first.join(existing.select("merchant"), "merchant", "left_anti")
    staged = first.withColumn("_lc", F.lower("_first.description"))
    staged = staged.withColumn("_kw", first_match_array(F.col("_lc"), keywords or D.MERCHANT_KEYWORDS))
    category = cascade_with_keyword(
        F.col("_first.transaction_code"), F.col(f"_first.{CODE_CATEGORY}"), F.col("_kw"), F.col("_first.amount"),
    )
    return staged.select("merchant", category.alias("category"))
