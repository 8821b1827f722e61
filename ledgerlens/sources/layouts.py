"""Statement layouts of different banks, brought to the default columns.

A :class:`Layout` says which header holds which part of a transaction, how its sign is written and
how its dates are. A file's layout is found from its header line; a file without one from the kinds of
the cells in its first line. What comes out has the default columns as text (see
``defaults.STATEMENT_COLUMNS``), so that cleaning, counters and loads are the same for all layouts.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import parse_mixed_date
from ledgerlens.functions.text import ustrip

#: Dates of layouts that write the month first.
MONTH_FIRST = (
    ("M/d/yyyy", "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"),
    ("M-d-yyyy", "^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"),
    ("M/d/yy", "^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}$"),
    ("yyyy-M-d", "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"),
)


@dataclass(frozen=True)
class Layout:
    """``columns`` maps parts (date, description, withdrawal, deposit, amount, marker, code) to
    headers; ``code`` may be absent from a file. ``order`` lists the parts of a file without header.
    Either withdrawal and deposit are given, or one amount: with a marker column (``debits`` and
    ``credits`` are its values, in lower case), or signed, money going out being negative unless
    ``out_is_positive``. ``dates`` replaces the default day-first date forms."""

    name: str
    columns: dict[str, str]
    order: tuple[str, ...] = ()
    out_is_positive: bool = False
    debits: tuple[str, ...] = ("dr", "d", "db", "debit")
    credits: tuple[str, ...] = ("cr", "c", "credit")
    dates: Sequence[tuple[str, str]] | None = None

    @property
    def required(self) -> list[str]:
        return [h for part, h in self.columns.items() if part != "code"]


DEFAULT_LAYOUT = Layout(
    "two columns",
    {"date": "Transaction Date", "description": "Description", "withdrawal": "Withdrawal Amount",
     "deposit": "Deposit Amount", "code": "Transaction Code"},
    order=("date", "code", "description", "withdrawal", "deposit"),
)
SIGNED_LAYOUT = Layout(
    "signed amount", {"date": "Date", "description": "Details", "amount": "Amount", "code": "Type"},
    order=("date", "description", "amount"),
)
MARKER_LAYOUT = Layout(
    "debit or credit marker", {"date": "Posting Date", "description": "Narrative", "amount": "Amount", "marker": "DR/CR"},
    order=("date", "description", "amount", "marker"), dates=MONTH_FIRST,
)
LAYOUTS = (DEFAULT_LAYOUT, SIGNED_LAYOUT, MARKER_LAYOUT)


class UnknownLayoutError(ValueError):
    """No layout fits a file; names the layout that fits best and the headers it misses."""

    def __init__(self, file: str, closest: Layout, missing: list[str]):
        super().__init__(f"{file}: no known statement layout; closest is '{closest.name}', missing: {', '.join(missing)}")
        self.file, self.closest, self.missing = file, closest.name, missing


def _cells(line: str) -> list[str]:
    return [c.strip() for c in next(csv.reader([line]), [])]


_DATE_CELL = re.compile(r"\d{1,4}[-/. ](\d{1,2}|[A-Za-z]{3,9})[-/. ]\d{2,4}|\d{8}|[A-Za-z]{3,9} \d{1,2},? \d{4}")
_MONEY_CELL = re.compile(r"[-+(]?\s*(\d[\d,]*\.?\d*|\.\d+)\s*[-)]?")


def _fits(part: str, cell: str, layout: Layout) -> bool:
    if part == "date":
        return bool(_DATE_CELL.match(cell))
    if part == "amount":
        return bool(_MONEY_CELL.fullmatch(cell))
    if part in ("withdrawal", "deposit"):
        return not cell or bool(_MONEY_CELL.fullmatch(cell))
    if part == "marker":
        return cell.lower() in (*layout.debits, *layout.credits)
    if part == "code":
        return bool(re.fullmatch(r"[A-Za-z0-9]{0,8}", cell))
    return not _MONEY_CELL.fullmatch(cell)


def detect(line: str, file: str = "", layouts: Sequence[Layout] = LAYOUTS) -> tuple[Layout, bool]:
    """The layout of a file with this first line, and whether the line is a header. Of several that
    fit the one with most matched headers is taken, then the first."""
    cells = _cells(line)
    names = {c.lower() for c in cells}
    missing = {lay.name: [h for h in lay.required if h.lower() not in names] for lay in layouts}
    fitting = [lay for lay in layouts if not missing[lay.name]]
    if fitting:
        return max(fitting, key=lambda lay: sum(h.lower() in names for h in lay.columns.values())), True
    for lay in layouts:
        if lay.order and len(cells) == len(lay.order) and all(_fits(p, c, lay) for p, c in zip(lay.order, cells)):
            return lay, False
    closest = min(layouts, key=lambda lay: len(missing[lay.name]) / len(lay.required))
    raise UnknownLayoutError(file, closest, missing[closest.name])


def _signed(text: Column) -> tuple[Column, Column]:
    """(negative, text without its sign) of a signed cell: -5, 5-, (5) or +5. Text that is not one
    sign and a number stays as it is and is rejected as an amount later."""
    negative = text.rlike(r"^-|-$|^\(.*\)$")
    bare = F.btrim(F.regexp_replace(text, r"^[-+(]|[-)]$", ""))
    return negative, F.when(bare.rlike(r"^[0-9.]"), bare).otherwise(text)


def to_default_columns(df: DataFrame, layout: Layout) -> DataFrame:
    """Rows of ``layout`` with the default statement columns; other columns are kept unless their
    names clash. A marker that is neither debit nor credit makes its amount unreadable (counted as
    rejected), and a date outside the layout's forms blank (counted as a bad date)."""
    by_name = {c.strip().lower(): c for c in df.columns}

    def cell(part: str) -> Column:
        name = by_name.get(layout.columns[part].lower()) if part in layout.columns else None
        return F.lit("") if name is None else F.coalesce(F.col(f"`{name}`"), F.lit(""))

    date = cell("date")
    if layout.dates is not None:
        date = F.coalesce(F.date_format(parse_mixed_date(date, layout.dates), "yyyy-MM-dd"), F.lit(""))
    if "amount" not in layout.columns:
        out, into = cell("withdrawal"), cell("deposit")
    elif "marker" in layout.columns:
        marker, amount = F.lower(ustrip(cell("marker"))), cell("amount")
        known = marker.isin(*layout.debits, *layout.credits)
        out = F.when(marker.isin(*layout.debits), amount).when(~known, F.concat(F.lit("? "), amount)).otherwise("")
        into = F.when(marker.isin(*layout.credits), amount).otherwise("")
    else:
        negative, bare = _signed(ustrip(cell("amount")))
        goes_out = ~negative if layout.out_is_positive else negative
        out, into = F.when(goes_out, bare).otherwise(""), F.when(~goes_out, bare).otherwise("")
    default = DEFAULT_LAYOUT.columns
    columns = {default["date"]: date, default["description"]: cell("description"), default["withdrawal"]: out,
               default["deposit"]: into, default["code"]: cell("code")}
    used = {h.lower() for h in (*layout.columns.values(), *columns)}
    others = [F.col(f"`{c}`") for c in df.columns if c.strip().lower() not in used]
    return df.select(*[c.alias(n) for n, c in columns.items()], *others)
