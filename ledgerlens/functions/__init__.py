"""Column -> Column building blocks. Everything here is a built-in Spark expression,
so it stays inside whole-stage code generation; there is no Python UDF in this package."""

from ledgerlens.functions.amounts import parse_amount
from ledgerlens.functions.dates import parse_mixed_date
from ledgerlens.functions.hashing import transaction_hash
from ledgerlens.functions.merchant import normalise_merchant
from ledgerlens.functions.money import money_label, percent_label, ratio_half_even, mean_half_up
from ledgerlens.functions.rules import first_group_match, first_match, rule_groups
from ledgerlens.functions.text import blank_to_null, clean_upper, strip_cell, ustrip

__all__ = [
    "blank_to_null", "clean_upper", "first_group_match", "first_match", "mean_half_up",
    "money_label", "normalise_merchant", "parse_amount", "parse_mixed_date", "percent_label",
    "ratio_half_even", "rule_groups", "strip_cell", "transaction_hash", "ustrip",
]
