"""Statement cleaning: raw text columns -> typed, normalised, fingerprinted rows."""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens import defaults as D
from ledgerlens.functions import blank_to_null, clean_upper, strip_cell, transaction_hash
from ledgerlens.functions.amounts import MONEY_TYPE, PARSED_TYPE, number_text, parse_number_text, rejected, to_money
from ledgerlens.functions.dates import parse_date_text, without_time
from ledgerlens.functions.merchant import apply_aliases, merchant_base
from ledgerlens.schemas import CLEAN_COLUMNS, check_required_columns

PASS_THROUGH = ("account_id", "seq", "event_time")

#: What the fingerprint covers. The description comes first: rows sorted by these columns hold like
#: texts side by side, which shuffle blocks and column files store in less space.
IDENTITY = ("description", "transaction_date", "amount")


def conform_headers(raw: DataFrame) -> DataFrame:
    """Rename the known statement headers that are present; add a null code column if absent."""
    check_required_columns(raw)
    df = raw.withColumnsRenamed({k: v for k, v in D.STATEMENT_COLUMNS.items() if k in raw.columns})
    if "transaction_code" not in df.columns:
        df = df.withColumn("transaction_code", F.lit(None).cast("string"))
    return df


def parse_columns(raw: DataFrame, strip_thousands: bool = False) -> DataFrame:
    """Typed columns before any row is dropped (bad dates and zero amounts still present).

    ``_zero`` tells a zero amount before rounding (0.004 is none, though it shows as 0.00);
    ``_rejected`` a money cell with text that is no number that can be kept; it counts as 0."""
    df = conform_headers(raw)
    in_text, out_text = number_text(F.col("deposit"), strip_thousands), number_text(F.col("withdrawal"), strip_thousands)
    money_in, money_out = parse_number_text(in_text), parse_number_text(out_text)
    zero = F.lit(0).cast(PARSED_TYPE)
    net = F.try_subtract(F.coalesce(money_in, zero), F.coalesce(money_out, zero))
    bad_cell = rejected(in_text, money_in) | rejected(out_text, money_out) | net.isNull()
    description = clean_upper(F.col("description"))
    # One projection: expressions used by several branches are computed once in it, and nothing but
    # the date's text, which its many forms use, is staged as a column.
    df = df.withColumns({
        "_date_text": without_time(strip_cell(F.col("transaction_date"))),
        "transaction_code": blank_to_null(clean_upper(F.col("transaction_code"))),
        "amount": F.coalesce(to_money(net), to_money(F.lit(0))),
        "_zero": F.coalesce(net == 0, F.lit(True)),
        "_rejected": F.coalesce(bad_cell, F.lit(False)),
        "description": F.when(description == "", F.lit(D.UNKNOWN_PAYEE)).otherwise(description),
    })
    return df.withColumn("transaction_date", parse_date_text(F.col("_date_text"))).drop("_date_text")


def clean_statements(
    raw: DataFrame, strip_thousands: bool = False, observation: Observation | None = None
) -> DataFrame:
    """Typed, cleaned statement rows. Rows with an unparseable date or a zero amount are
    dropped and counted in the same pass, as are rows with a rejected money cell (dropped only if
    nothing else makes their amount non-zero); pass an :class:`Observation` to read the counts.
    """
    return with_derived(typed_rows(raw, strip_thousands, observation))


def typed_rows(
    raw: DataFrame, strip_thousands: bool = False, observation: Observation | None = None
) -> DataFrame:
    """The kept rows with the columns that cannot be derived from others (see
    :func:`clean_statements` for what is dropped and counted).

    The counting node also keeps the optimizer from copying the date and amount parsing into
    the row filter below it, so each is evaluated once per row.
    """
    df = parse_columns(raw, strip_thousands)
    dated = F.col("transaction_date").isNotNull()
    counters = (  # `count_if` would plan a projection of its own
        F.count(F.lit(1)).alias("raw_rows"),
        F.count(F.when(~dated, 1)).alias("bad_dates"),
        F.count(F.when(dated & F.col("_zero"), 1)).alias("zero_amounts"),
        F.count(F.when(dated & F.col("_rejected"), 1)).alias("rejected_amounts"),
    )
    df = df.observe(observation if observation is not None else f"clean_{uuid.uuid4().hex}", *counters)
    df = df.filter(dated & ~F.col("_zero"))
    extra = [c for c in PASS_THROUGH if c in df.columns]
    return df.select(*IDENTITY, "transaction_code", *extra)


def with_derived(df: DataFrame) -> DataFrame:
    """Typed rows with the month, merchant name and fingerprint of each."""
    df = df.withColumn("_merchant_base", merchant_base(F.col("description")))
    df = df.withColumns({
        "year_month": F.substring(F.col("transaction_date").cast("string"), 1, 7),
        "merchant_name": apply_aliases(F.col("_merchant_base")),
    })
    df = with_fingerprint(df)
    extra = [c for c in PASS_THROUGH if c in df.columns]
    return df.select(*CLEAN_COLUMNS, *extra)


def with_fingerprint(df: DataFrame) -> DataFrame:
    """Rows with the fingerprint of their date, amount and description."""
    return df.withColumn("transaction_hash", transaction_hash(F.col("transaction_date"), F.col("amount"), F.col("description")))


#: Parts of the number that :func:`packed_identity` sorts by: 16 bits of the description's beginning,
#: 23 of the day, 25 of the cents.
DAY_BITS, CENT_BITS = 23, 25
_DAY_ZERO = 1 << (DAY_BITS - 1)


def packed_identity() -> list[Column]:
    """:data:`IDENTITY` as four columns that are equal for two rows exactly if it is: a number of the
    description's first characters, the day and the low bits of the cents; the other bits of the
    cents; the description; the amount itself where it is too large for cents in 64 bits (else null).

    Sorts tell nearly all rows apart by the first number, where texts that begin alike and decimals
    of many digits had to be compared, and like texts still lie side by side."""
    cents = (F.col("amount").try_cast("decimal(15,2)") * 100).cast("long")
    low = F.coalesce(cents.bitwiseAND((1 << CENT_BITS) - 1), F.lit(0))
    begins = F.shiftleft(F.xxhash64(F.substring("description", 1, 8)), DAY_BITS + CENT_BITS)
    day = F.shiftleft(F.unix_date("transaction_date").cast("long") + _DAY_ZERO, CENT_BITS)
    number = begins.bitwiseOR(day).bitwiseOR(low)
    high = F.coalesce(F.shiftright(cents, CENT_BITS), F.when(F.col("amount").isNotNull(), 0).cast("long"))
    return [number.alias("_number"), high.alias("_high"),
            F.col("description"), F.when(cents.isNull(), F.col("amount")).alias("_large")]


def unpacked_identity() -> list[Column]:
    """:data:`IDENTITY` from the columns of :func:`packed_identity`."""
    number = F.col("_number")
    day = F.shiftright(number, CENT_BITS).bitwiseAND((1 << DAY_BITS) - 1) - _DAY_ZERO
    cents = F.shiftleft("_high", CENT_BITS).bitwiseOR(number.bitwiseAND((1 << CENT_BITS) - 1))
    amount = (cents.cast("decimal(15,0)") * F.lit(Decimal("0.01"))).cast(MONEY_TYPE)
    return [F.col("description"), F.date_from_unix_date(day.cast("int")).alias("transaction_date"),
            F.coalesce("_large", amount).alias("amount")]


def first_rows(typed: DataFrame, order: str = "seq") -> DataFrame:
    """The first row (lowest ``order``; by content without one) of every date, amount and
    description among :func:`typed_rows`: what :func:`dedup_first` keeps of the cleaned rows, with
    less to sort and shuffle, because a row carries its order once and no derived column."""
    others = [c for c in typed.columns if c not in IDENTITY and c != order]
    ranked = []
    if order in typed.columns:
        field = typed.schema[order]
        flat = isinstance(field.dataType, StructType) and not field.nullable
        parts = field.dataType.fieldNames() if flat else []
        ranked = [F.col(order)[p].alias(f"_order_{p}") for p in parts] or [F.col(order).isNull().alias("_last"), F.col(order)]
    first = typed.groupBy(*packed_identity()).agg(F.min(F.struct(*ranked, *others)).alias("_first"))
    first = first.select(*unpacked_identity(), "_first.*")
    if ranked and flat:
        first = first.withColumn(order, F.struct(*[F.col(f"_order_{p}").alias(p) for p in parts]))
    return first.select(*typed.columns)


def clean_first(raw: DataFrame, strip_thousands: bool = False, observation: Observation | None = None) -> DataFrame:
    """Cleaned rows, the first of every fingerprint. Merchant name and fingerprint are taken after
    the shuffle, once for every kept row."""
    return with_derived(first_rows(typed_rows(raw, strip_thousands, observation)))


def content_order(df: DataFrame) -> Column:
    """A deterministic row order from the content, for batches without a ``seq`` column."""
    return F.struct("transaction_date", "amount", "description", "transaction_code", "merchant_name")


def dedup_first(df: DataFrame, key: str = "transaction_hash", order: str = "seq") -> DataFrame:
    """Keep the first row (lowest ``order``) of every ``key``.

    An aggregate, not a window: ``min_by`` is combined map-side, so a key held by a third of
    all rows still leaves every map task with one row per key before the shuffle.
    """
    order_col = F.col(order) if order in df.columns else content_order(df)
    others = [c for c in df.columns if c != key]
    return (
        df.groupBy(key)
        .agg(F.min_by(F.struct(*others), order_col).alias("_first"))
        .select(key, "_first.*")
        .select(*df.columns)
    )
