"""Merchant-name normalisation as one chain of built-in string expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens import defaults as D
from ledgerlens.functions.rules import first_match
from ledgerlens.functions.text import ustrip


def _re(pattern: str) -> str:
    return "(?U)" + pattern


def _when_contains(name: Column, literal: str, rewritten: Column) -> Column:
    return F.when(name.contains(literal), rewritten).otherwise(name)


def strip_noise(name: Column, tokens: Sequence[str] = D.NOISE_TOKENS) -> Column:
    for token in tokens:
        name = F.replace(name, F.lit(token), F.lit(""))
    return name


def merchant_base(
    description: Column,
    noise_tokens: Sequence[str] = D.NOISE_TOKENS,
    max_chars: int = D.MERCHANT_MAX_CHARS,
) -> Column:
    """Cleaning steps before the alias map: terminal suffix, wallet prefixes, country suffix,
    leading digits, reference tails, noise tokens, blank runs, length cut. Each step sees the
    output of the previous one, so an early step can hide a later alias."""
    # Each pattern below needs a literal that a cheap substring test finds first ("SGP", a
    # leading "GRAB*", "SG", a start other than A-Z, "*" or "#"); the regular expression only runs where it can match.
    name = F.upper(description)
    name = _when_contains(name, "SGP", F.regexp_replace(name, _re(D.TERMINAL_SUFFIX_RE), ""))
    name = F.when(name.startswith("GRAB*"),
                  F.regexp_replace(name, _re(D.GRAB_PREFIX_RE), D.GRAB_PREFIX_REPLACEMENT)).otherwise(name)
    for old, new in D.LITERAL_REWRITES:
        name = F.replace(name, F.lit(old), F.lit(new))
    name = _when_contains(name, "SG", F.regexp_replace(name, _re(D.COUNTRY_SUFFIX_RE), ""))
    name = F.when(F.substring(name, 1, 1).between("A", "Z"), name).otherwise(F.regexp_replace(name, _re(D.LEADING_DIGITS_RE), ""))
    name = F.when(name.contains("*") | name.contains("#"),
                  F.regexp_replace(name, _re(D.REFERENCE_TAIL_RE), "")).otherwise(name)
    name = strip_noise(name, noise_tokens)
    return F.substring(ustrip(F.regexp_replace(name, _re(D.WHITESPACE_RUN_RE), " ")), 1, max_chars)


def apply_aliases(name: Column, aliases: Sequence[tuple[str, str]] = D.MERCHANT_ALIASES) -> Column:
    """The first alias contained in ``name`` replaces the whole name. Pass a column reference:
    the name is tested once per alias."""
    if not aliases:
        return name
    return F.coalesce(first_match(name, aliases), name)


def normalise_merchant(
    description: Column,
    noise_tokens: Sequence[str] = D.NOISE_TOKENS,
    aliases: Sequence[tuple[str, str]] = D.MERCHANT_ALIASES,
    max_chars: int = D.MERCHANT_MAX_CHARS,
) -> Column:
    """Raw description -> canonical merchant name (single expression; inside DataFrame
    operators prefer staging :func:`merchant_base` as a column, then :func:`apply_aliases`)."""
    return apply_aliases(merchant_base(description, noise_tokens, max_chars), aliases)
