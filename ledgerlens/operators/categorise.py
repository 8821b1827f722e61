"""Category assignment: code-list classification and the per-row category cascade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import defaults as D
from ledgerlens.functions.rules import first_group_match_array, first_match
from ledgerlens.operators.joins import broadcast_if_small, known_rows, with_known_rows

CODE_CATEGORY = "_code_category"


def classify_codes(
    codes: DataFrame, rules: Sequence[tuple[Sequence[str], str]] = D.CODE_RULES
) -> DataFrame:
    """(code, description) -> (code, description, category); codes upper-cased. Category = first
    rule group with a keyword in the lower-cased description, else Uncategorised."""
    cat = F.coalesce(first_group_match_array(F.col("_lc"), rules), F.lit(D.UNCATEGORISED))
    staged = codes.withColumn("_lc", F.lower("description"))
    out = staged.select(F.upper("code").alias("code"), "description", cat.alias("category"))
    return with_known_rows(out, known_rows(codes))  # one output row per input row


def keyword_category(description, keywords: Sequence[tuple[str, str]] = D.MERCHANT_KEYWORDS):
    """Merchant keyword category of a description, or null when no keyword occurs."""
    return first_match(F.lower(description), keywords)


def lookup_codes(batch: DataFrame, codes: DataFrame) -> DataFrame:
    """Add the category of each row's code (null when the code is not in the code table).
    The code table is broadcast after a size check."""
    lookup = codes.select(F.col("code").alias("_code"), F.col("category").alias(CODE_CATEGORY))
    small = broadcast_if_small(lookup, rows=known_rows(codes))
    return batch.join(small, batch["transaction_code"] == F.col("_code"), "left").drop("_code")


def stored_code(code: Column | None = None, code_cat: Column | None = None) -> Column:
    """The code as stored on the transaction: kept only when it is in the code table."""
    code = F.col("transaction_code") if code is None else code
    code_cat = F.col(CODE_CATEGORY) if code_cat is None else code_cat
    return F.when(code_cat.isNotNull(), code)


def cascade(
    code: Column,
    code_cat: Column,
    lowered_description: Column,
    amount: Column,
    keywords: Sequence[tuple[str, str]] = D.MERCHANT_KEYWORDS,
    generic: Sequence[str] = D.GENERIC_CODES,
    bidirectional: Sequence[str] = D.BIDIRECTIONAL_CODES,
    cash: Sequence[str] = D.CASH_CODES,
) -> Column:
    """The tiered category of one row: cash code; bidirectional code by sign; known non-generic
    code; merchant keyword; known (generic) code; Uncategorised. Pass the lower-cased
    description as a column reference (it is tested once per keyword)."""
    kw = first_match(lowered_description, keywords)
    return cascade_with_keyword(code, code_cat, kw, amount, generic, bidirectional, cash)


def cascade_with_keyword(
    code: Column,
    code_cat: Column,
    kw: Column,
    amount: Column,
    generic: Sequence[str] = D.GENERIC_CODES,
    bidirectional: Sequence[str] = D.BIDIRECTIONAL_CODES,
    cash: Sequence[str] = D.CASH_CODES,
) -> Column:
    """:func:`cascade` with the keyword category already computed (null = no keyword)."""
    known = code_cat.isNotNull()
    tiers = (
        F.when(code.isin(*cash), F.lit(D.CASH_CATEGORY))
        .when(code.isin(*bidirectional),
              F.when(amount > 0, F.lit(D.INCOME_CATEGORY)).otherwise(F.lit(D.OUTBOUND_CATEGORY)))
        .when(known & ~code.isin(*generic), code_cat)
        .when(kw.isNotNull(), kw)
        .when(known, code_cat)
        .otherwise(F.lit(D.UNCATEGORISED))
    )
    # Never null (the code-category branches require a known code). Saying so lets the
    # optimizer drop inferred not-null filters instead of copying this expression into them.
    return F.coalesce(tiers, F.lit(D.UNCATEGORISED))


def categorise_rows(
    batch: DataFrame, codes: DataFrame, keywords: Sequence[tuple[str, str]] = D.MERCHANT_KEYWORDS
) -> DataFrame:
    """Per-row form: add ``row_category`` and replace ``transaction_code`` by the stored code."""
    df = lookup_codes(batch, codes).withColumn("_lc", F.lower("description"))
    category = cascade(F.col("transaction_code"), F.col(CODE_CATEGORY), F.col("_lc"), F.col("amount"), keywords)
    return df.withColumns({
        "row_category": category,
        "transaction_code": stored_code(),
    }).drop(CODE_CATEGORY, "_lc")
