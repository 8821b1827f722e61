"""Row fingerprint used as the idempotency key of a load."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_HEX_CHARS = 16


def transaction_hash(date: Column, amount: Column, description: Column) -> Column:
    """First 16 hex chars of SHA-256 over ``yyyy-MM-dd|amount(2dp)|description``.

    ``amount`` must be decimal(_, 2): its text form is the two-decimal rendering.
    Code and merchant are deliberately not part of the key.
    """
    raw = F.concat_ws("|", date.cast("string"), amount.cast("string"), description)
    return F.substring(F.sha2(raw, 256), 1, HASH_HEX_CHARS)
