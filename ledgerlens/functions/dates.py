"""Mixed-format, day-first date parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions.text import let, ustrip

_D = "[0-9]{1,2}"
_Y = "[0-9]{4}"
_YY = "[0-9]{2}"
_MON = "[A-Za-z]{3}"
_MONTH = "[A-Za-z]+"

# (pattern, shape) tried in order; the first pattern that parses the whole text wins. The forms
# that statements use most come first; among forms of one shape day-first ones come before
# month-first ones (so 01/25/2025 is 25 Jan). The shape is a cheap regular expression that every text the pattern accepts
# matches: a pattern is only attempted on texts of its shape, because a failed parse is costly.
DEFAULT_DATE_FORMATS: tuple[tuple[str, str], ...] = (
    ("yyyy-M-d", f"^{_Y}-{_D}-{_D}$"),
    ("d/M/yyyy", f"^{_D}/{_D}/{_Y}$"),
    ("d-M-yyyy", f"^{_D}-{_D}-{_Y}$"),
    ("d MMM yyyy", f"^{_D} {_MON} {_Y}$"),
    ("d.M.yyyy", rf"^{_D}\.{_D}\.{_Y}$"),
    ("yyyy/M/d", f"^{_Y}/{_D}/{_D}$"),
    ("yyyyMMdd", "^[0-9]{8}$"),
    ("d/M/yy", f"^{_D}/{_D}/{_YY}$"),
    ("d-M-yy", f"^{_D}-{_D}-{_YY}$"),
    ("d.M.yy", rf"^{_D}\.{_D}\.{_YY}$"),
    ("d-MMM-yyyy", f"^{_D}-{_MON}-{_Y}$"),
    ("d MMM yy", f"^{_D} {_MON} {_YY}$"),
    ("d-MMM-yy", f"^{_D}-{_MON}-{_YY}$"),
    ("d MMMM yyyy", f"^{_D} {_MONTH} {_Y}$"),
    ("MMM d, yyyy", f"^{_MON} {_D}, {_Y}$"),
    ("MMMM d, yyyy", f"^{_MONTH} {_D}, {_Y}$"),
    ("MMM d yyyy", f"^{_MON} {_D} {_Y}$"),
    ("MMMM d yyyy", f"^{_MONTH} {_D} {_Y}$"),
    ("M/d/yyyy", f"^{_D}/{_D}/{_Y}$"),
    ("M-d-yyyy", f"^{_D}-{_D}-{_Y}$"),
    ("M.d.yyyy", rf"^{_D}\.{_D}\.{_Y}$"),
    ("M/d/yy", f"^{_D}/{_D}/{_YY}$"),
    ("M-d-yy", f"^{_D}-{_D}-{_YY}$"),
)

# A trailing clock time ("2025-01-02 10:00", "02/01/2025 9:15:00 PM") is ignored, with or without
# a zone ("2025-01-02T10:00:00Z"): a statement's date is the date as written.
_TRAILING_TIME = r"(?U)(\s+|T)\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(\s*[AaPp][Mm])?(\s*(Z|[+-]\d{2}:?\d{2}))?$"


#: The forms that most statements use. No form outside this list that has the shape of one of them
#: comes before it, so these can be tried first.
OFTEN = ("yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "d MMM yyyy")


def date_text(c: Column) -> Column:
    """The date part of a raw date cell: stripped, trailing time removed (the regular
    expression only runs on text that has a colon)."""
    return without_time(ustrip(c))


def without_time(text: Column) -> Column:
    """Stripped text without a trailing time; pass a column reference so the text is computed once."""
    return F.when(text.contains(":"), F.regexp_replace(text, _TRAILING_TIME, "")).otherwise(text)


def parse_date_text(text: Column, formats: Sequence[tuple[str, str]] = DEFAULT_DATE_FORMATS) -> Column:
    """Parse prepared date text (see :func:`date_text`); pass a column reference so the text is
    computed once, not once per attempted pattern."""
    often = [f for f in formats if f[0] in OFTEN]
    seldom = [f for f in formats if f[0] not in OFTEN]

    def tried(t, forms):
        return [F.when(t.rlike(shape), _attempt(t, p)) for p, shape in forms]

    # The seldom forms are tried inside a lambda, which keeps the generated code of a stage small enough
    # for the JVM to compile it as one method.
    rest = [let(text, lambda t: F.coalesce(*tried(t, seldom)))] if seldom else []
    return F.coalesce(*tried(text, often), *rest)


# All-digit forms with a four-digit year: separator and places of year, month and day. Their parts are
# put in ISO order and cast, which costs a fraction of the pattern parser.
_DIGIT_FORMS = {
    "yyyy-M-d": ("-", "123"), "d/M/yyyy": ("/", "321"), "d-M-yyyy": ("-", "321"), "d.M.yyyy": (".", "321"),
}


def _attempt(text: Column, pattern: str) -> Column:
    if pattern in _DIGIT_FORMS:
        mark, places = _DIGIT_FORMS[pattern]
        if places == "123":
            return text.try_cast("date")
        split = F.concat_ws("-", *[F.split_part(text, F.lit(mark), F.lit(int(i))) for i in places])
        # Ten characters are two digits, two digits and four: their places are known without splitting.
        placed = F.concat(F.substring(text, 7, 4), F.lit("-"), F.substring(text, 4, 2), F.lit("-"), F.substring(text, 1, 2))
        return F.when(F.length(text) == 10, placed).otherwise(split).try_cast("date")
    date = F.try_to_timestamp(text, F.lit(pattern)).cast("date")
    if pattern.endswith("yyyy") or not pattern.endswith("yy"):
        return date
    # Two-digit years: 69 to 99 are 1969 to 1999, the others 2000 to 2068.
    return F.when(F.year(date) >= 2069, F.add_months(date, -1200)).otherwise(date)


def parse_mixed_date(c: Column, formats: Sequence[tuple[str, str]] = DEFAULT_DATE_FORMATS) -> Column:
    """Raw date cell -> DateType; unparseable text gives null."""
    return parse_date_text(date_text(c), formats)
