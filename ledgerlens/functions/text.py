"""Text helpers with Python-like whitespace semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point that Python's str.isspace() accepts (29 characters): tab, line breaks,
# file/group/record/unit separators, space, NEL, NBSP and the Unicode space separators.
# Built from the rule rather than listed. `F.trim` alone removes only ASCII blanks.
WHITESPACE = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


def ustrip(c: Column) -> Column:
    """Remove leading and trailing whitespace (character-set trim, no regular expression)."""
    return F.btrim(c, F.lit(WHITESPACE))


def strip_cell(c: Column) -> Column:
    """Same answer as :func:`ustrip`, for the cells of a statement: the trim looks the characters at both
    ends up in the whole set, so text that begins and ends with printable ASCII (once plain
    blanks are gone) is passed by, which comparing its first and last byte tells. The lambda keeps
    the trim, seldom needed, and the projection out of the stage's fused method. Pass a column reference."""
    text = F.trim(c)
    last = F.substring(text.cast("binary"), -1, 1)
    bare = c.isNull() | (text == "") | ((text >= "!") & (text < "\x7f") & (last >= F.lit(b"!")) & (last < F.lit(b"\x7f")))
    return F.when(bare, text).otherwise(let(text, ustrip))


def clean_upper(c: Column) -> Column:
    """Strip, then upper-case; pass a column reference (see :func:`strip_cell`)."""
    return F.upper(strip_cell(c))


def blank_to_null(c: Column) -> Column:
    """Map the empty string to null (``nullif`` would plan a projection of its own)."""
    return F.when(c != "", c)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable. Without it the
    optimizer may inline an expression referenced once inside a lambda, which then runs once
    per array element."""
    return F.get(F.transform(F.array(value), body), 0)
