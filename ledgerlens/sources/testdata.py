"""Statement-shaped inputs derived from the shared test tables.

The test tables hold no bank statements, so the raw statement batch is a projection of
``lineitem`` (every row, plus the first line of every order a second time as a re-import).
All derivations are plain SQL-expressible column expressions, so the DuckDB oracle in
``ledgerlens.plans.oracle`` builds exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.defaults import MERCHANT_ALIASES
from ledgerlens.sources.literal import literal_table
from ledgerlens.sources.parallelism import ensure_parallelism

# FIXED VALUES of the test fixture: description templates chosen by l_partkey % 16
# (each one exercises a cleaning step or a rule; template 15 is a blank description).
DESCRIPTION_TEMPLATES: list[str] = [
    "GRAB* GPC-3140FD79BA09",
    "SPOTIFY P1D2E3F4",
    "FP*FOOD PANDA SINGAPORE",
    "GOOGLE*YOUTUBEPREMIUM",
    "FAIRPRICE XTRA JURONG",
    "WATSONS SINGAPORE",
    "COMFORT TAXI",
    "SP GROUP",
    "00123456 KOPITIAM PTE LTD",
    "UNIQLO#REF991 ORCHARD",
    "ACME HOLDINGS",
    "SALARY CREDIT",
    "NETFLIX.COM SG",
    "GRAB* FOOD",
    "NUS BONUS",
    "",
]
CARD_TAIL = " 5264-7110-0000-0000"
TERMINAL = " SI SGP "

# Transaction code chosen by l_suppkey % 8 ("" = no code; BP is not in the code table).
CODE_CYCLE: list[str] = ["POS", "MST", "AWL", "IBG", "ICT", "ITR", "", "BP"]

# Code table of the fixture: (code, official description). Categories come from the
# code-description rules, as for a real code list.
FIXTURE_CODES: list[tuple[str, str]] = [
    ("POS", "Point-of-Sale Transaction or Proceeds"),
    ("MST", "Debit Card Transaction"),
    ("AWL", "Cash Withdrawal"),
    ("IBG", "Payments / Collections via GIRO"),
    ("ICT", "FAST or PayNow Payment / Receipt"),
    ("ITR", "Funds Transfer"),
    ("INT", "Interest Earned"),
]

# Budget limits of the fixture (a zero limit and a category without spend included).
FIXTURE_BUDGETS: list[tuple[str, float]] = [
    ("Transport", 500000.0),
    ("Food & Drink", 900000.0),
    ("Education", 0.0),
    ("Donations", 1000.0),
]

# Cut-off of the first of two loads in the incremental-load queries.
FIRST_LOAD_BEFORE = "1998-01-01"


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensure_parallelism(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_extendedprice", "l_returnflag", "l_shipdate",
    ))


#: Where the derived batch is damaged or odd, by l_linenumber and l_orderkey modulo a prime:
#: bad dates, odd date forms, zero, sub-cent and rejected amounts, rare and alias merchants.
ODD_DATES = ["MM-dd-yyyy", "MM.dd.yyyy", "MM/dd/yy", "MM-dd-yy", "d-MMM-yy", "d MMM yy", "MMM d yyyy", "MMMM d yyyy"]
ODD_AMOUNTS = ["0.00", "0.004", "1,234.50", "-0.006"]
BAD_DATE, IMPOSSIBLE_DATE = "n/a", "31/02/1997"
LETTERS = "ABCDEFGHIJ"
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def raw_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw statement rows (all text columns, CSV header names) plus ``account_id`` and ``seq``."""
    li = lineitem(spark, sf_dir).withColumn("_shipped", F.to_date("l_shipdate"))  # used many times, taken once
    d = F.col("_shipped")
    ln = F.col("l_linenumber")
    ok = F.col("l_orderkey")
    odd = F.lit(None).cast("string")
    for i, form in enumerate(ODD_DATES):
        odd = F.when(ok % 11 == i, F.date_format(d, form)).otherwise(odd)
    date_text = (
        F.when((ln == 2) & (ok % 41 == 7), F.lit(BAD_DATE))
        .when((ln == 2) & (ok % 41 == 8), F.lit(IMPOSSIBLE_DATE))
        .when((ln == 7) & (ok % 11 < len(ODD_DATES)), odd)
        .when(ln <= 3, d.cast("string"))
        .when(ln <= 5, F.date_format(d, "dd/MM/yyyy"))
        .when(ln == 6, F.date_format(d, "dd MMM yyyy"))
        .otherwise(F.date_format(d, "dd-MM-yyyy"))
    )
    aliases = F.array(*[F.lit(a) for a, _ in MERCHANT_ALIASES])
    rare = F.concat(F.lit("STALL "), F.translate(ok.cast("string"), "0123456789", LETTERS))
    template = F.element_at(F.array(*[F.lit(t) for t in DESCRIPTION_TEMPLATES]), (F.col("l_partkey") % 16 + 1).cast("int"))
    template = (
        F.when((ln == 3) & (ok % 61 == 5), rare)
        .when((ln == 3) & (ok % 61 == 6), F.element_at(aliases, (F.col("l_partkey") % len(MERCHANT_ALIASES) + 1).cast("int")))
        .otherwise(template)
    )
    months = F.array(*[F.lit(m) for m in MONTHS])
    description = F.when(F.col("l_partkey") % 16 == 15, F.lit("")).otherwise(
        F.concat(template, F.lit(TERMINAL), F.lpad(F.dayofmonth(d).cast("string"), 2, "0"), F.element_at(months, F.month(d)), F.lit(CARD_TAIL))
    )
    cost = F.col("l_extendedprice")
    # Two decimals by the decimal cast; the formatter (slow) writes what is null, negative or huge.
    price = F.when(cost.between(0.0, 1e12), cost.cast("decimal(15,2)").cast("string")).otherwise(F.format_string("%.2f", cost))
    price = F.when((ln == 4) & (ok % 37 < len(ODD_AMOUNTS)), F.element_at(F.array(*[F.lit(a) for a in ODD_AMOUNTS]), (ok % 37 + 1).cast("int"))).otherwise(price)
    returned = F.col("l_returnflag") == "R"
    code = F.element_at(F.array(*[F.lit(c) for c in CODE_CYCLE]), (F.col("l_suppkey") % 8 + 1).cast("int"))
    stmt = li.select(
        (F.col("l_orderkey") % 50).alias("account_id"),
        date_text.alias("Transaction Date"),
        description.alias("Description"),
        F.when(returned, F.lit("")).otherwise(price).alias("Withdrawal Amount"),
        F.when(returned, price).otherwise(F.lit("")).alias("Deposit Amount"),
        code.alias("Transaction Code"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
        # The first line of every order arrives twice, like an overlapping re-import
        # (one scan; the copy is generated next to the row, no union with a second scan).
        F.explode(F.when(ln == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return stmt.drop("_copy")


def fixture_codes(spark: SparkSession) -> DataFrame:
    return literal_table(spark, FIXTURE_CODES, "code string, description string")


def fixture_budgets(spark: SparkSession) -> DataFrame:
    return literal_table(spark, FIXTURE_BUDGETS, "category string, monthly_limit double")


def document_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, description) rows built from the documents table: a large free-text stand-in for a
    code list, used to run the code-description classifier over whole texts."""
    docs = ensure_parallelism(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("code"),
        F.col("text").alias("description"),
    )


def event_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw statement rows from the events table (for streaming): event time -> date,
    event type -> description, value -> withdrawal (deposit for sign-ups)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events_to_statements(ev)


def events_to_statements(ev: DataFrame) -> DataFrame:
    value = F.format_string("%.2f", F.col("value"))
    signup = F.col("event_type") == "signup"
    return ev.select(
        F.col("user_id").alias("account_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("Transaction Date"),
        # The user decides the merchant, so that the stream has many merchants and categories.
        F.concat_ws(" ", F.element_at(F.array(*[F.lit(t) for t in DESCRIPTION_TEMPLATES]), (F.col("user_id") % 16 + 1).cast("int")), F.upper("event_type")).alias("Description"),
        F.when(signup, F.lit("")).otherwise(value).alias("Withdrawal Amount"),
        F.when(signup, value).otherwise(F.lit("")).alias("Deposit Amount"),
        F.lit("").alias("Transaction Code"),
        F.struct("ts", "event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("event_time"),
    )
