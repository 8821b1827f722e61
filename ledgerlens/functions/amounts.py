"""Money parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import strip_cell

#: Stored money (26 integer digits) and parsed numbers before rounding (28 integer digits).
MONEY_TYPE = "decimal(28,2)"
PARSED_TYPE = "decimal(38,10)"

# Plain decimal numbers with an optional sign and exponent. Everything else ("nan", "inf",
# "5d", "1,234.50", "(5.00)") is rejected and counts as 0.
NUMBER_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_number(c: Column, strip_thousands: bool = False) -> Column:
    """Text -> unrounded decimal; null when the text is blank, no plain number or too large."""
    return parse_number_text(number_text(c, strip_thousands))


def number_text(c: Column, strip_thousands: bool = False) -> Column:
    """The stripped text of a money cell."""
    text = strip_cell(c)
    return F.regexp_replace(text, r"(?<=\d),(?=\d{3}(\D|$))", "") if strip_thousands else text


def parse_number_text(text: Column) -> Column:
    """:func:`parse_number` of prepared text (see :func:`number_text`); pass a column reference so
    the text is computed once."""
    return F.when(text.rlike(NUMBER_RE), text.try_cast(PARSED_TYPE))


def parse_amount(c: Column, strip_thousands: bool = False) -> Column:
    """Text -> unrounded decimal; text that is not a plain number becomes 0."""
    return F.coalesce(parse_number(c, strip_thousands), F.lit(0).cast(PARSED_TYPE))


def to_money(value: Column) -> Column:
    """Unrounded decimal -> stored money, half-up to cents; null where it does not fit."""
    return value.try_cast(MONEY_TYPE)


def rejected(text: Column, parsed: Column) -> Column:
    """True for a cell that holds text (see :func:`number_text`) but no number that can be kept."""
    return parsed.isNull() & (text != "")
