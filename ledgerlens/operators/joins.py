"""Join helpers with an explicit size check before any broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension is broadcast only when it has at most this many rows and its text and binary
# values, with 16 bytes for every other value, sum up to at most this many bytes.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20

_KNOWN_ROWS = "_ledgerlens_known_rows"


def with_known_rows(df: DataFrame, n: int | None) -> DataFrame:
    """Record the row count of a table whose size is fixed when it is built (a literal list),
    or carried over unchanged by a one-row-per-row projection."""
    if n is not None:
        setattr(df, _KNOWN_ROWS, n)
    return df


def known_rows(df: DataFrame) -> int | None:
    return getattr(df, _KNOWN_ROWS, None)


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """Broadcast hint for ``df`` if it has at most ``max_rows`` rows; otherwise leave the choice
    to the planner (sort-merge join, or a runtime broadcast by AQE when the shuffle turns out
    small). The row count is the recorded one when the table was built from a literal list,
    else one count of the dimension (small by assumption, capped at ``max_rows + 1``)."""
    n = rows if rows is not None else known_rows(df)
    if n is not None:
        return F.broadcast(df) if n <= max_rows else df
    size = sum((_bytes(f) for f in df.schema.fields), F.lit(0))
    got = df.select(size.alias("b")).limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return F.broadcast(df) if got["n"] <= max_rows and (got["b"] or 0) <= MAX_BROADCAST_BYTES else df


def _bytes(field) -> F.Column:
    c = F.col(f"`{field.name}`")
    kind = field.dataType.typeName()
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0))
    return F.coalesce(F.octet_length(c.cast("string")), F.lit(0)) + 16 if kind in ("array", "struct", "map") else F.lit(16)
