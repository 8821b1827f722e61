"""Running spend streams: first rows fix categories, replays and late rows, closed days."""

import datetime as dt
import os

from pyspark.sql import functions as F

from ledgerlens.operators.categorise import classify_codes
from ledgerlens.operators.clean import clean_statements
from ledgerlens.sources.testdata import FIXTURE_CODES
from ledgerlens.streaming.ingest import run_available
from ledgerlens.streaming.spend import SpendLedger, daily_spend_stream

SCHEMA = "day string, description string, out string, code string, n bigint, event_time timestamp"


def raw(df):
    return clean_statements(df.select(
        F.col("day").alias("Transaction Date"), F.col("description").alias("Description"),
        F.col("out").alias("Withdrawal Amount"), F.lit("").alias("Deposit Amount"),
        F.col("code").alias("Transaction Code"), F.struct("n").alias("seq"), "event_time"))


def put(spark, folder, n, rows):
    """One file of (day, description, amount, code) rows, numbered and stamped at noon."""
    out = []
    for i, (day, text, amount, code) in enumerate(rows):
        out.append((day, text, amount, code, i, dt.datetime.fromisoformat(f"{day} 12:00:00")))
    spark.createDataFrame(out, SCHEMA).coalesce(1).write.mode("append").parquet(os.path.join(folder, f"f{n}"))


def stream(spark, folder):
    return raw(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(os.path.join(folder, "f*")))


def ledger(spark, workdir):
    codes = classify_codes(spark.createDataFrame(FIXTURE_CODES, "code string, description string"))
    return SpendLedger(spark, os.path.join(workdir, "ledger"), codes)


def spent(led):
    return {(r.month, r.category): (float(r.spent), r.txns) for r in led.spend().collect()}


FIRST = [
    ("2025-01-05", "CORNER HOUSE", "10.00", "AWL"),   # first row: cash fixes the merchant's category
    ("2025-01-06", "CORNER HOUSE", "5.00", ""),
    ("2025-01-06", "CORNER HOUSE", "5.00", ""),       # copy
    ("2025-01-07", "NETFLIX.COM", "15.00", ""),
]
SECOND = [
    ("2025-02-01", "CORNER HOUSE", "7.00", ""),       # stays with the first row's category
    ("2025-01-06", "CORNER HOUSE", "5.00", ""),       # stored already
    ("2025-01-02", "NETFLIX.COM", "1.50", "AWL"),     # late, and a code that comes too late to count
]


def test_ledger_follows_first_rows(spark, workdir):
    folder = os.path.join(workdir, "in")
    put(spark, folder, 1, FIRST)
    led = ledger(spark, workdir)
    led.start(stream(spark, folder)).awaitTermination()
    one = spent(led)
    cash, subs = sorted(one, key=lambda k: one[k][1], reverse=True)
    assert one[cash] == (15.0, 2) and one[subs] == (15.0, 1) and cash[1] != subs[1]
    # A restart from the checkpoint reads the new file only.
    put(spark, folder, 2, SECOND)
    led.start(stream(spark, folder)).awaitTermination()
    both = spent(led)
    assert both == {cash: (15.0, 2), subs: (16.5, 2), ("2025-02", cash[1]): (7.0, 1)}
    assert led.read("merchants").count() == 2


def test_ledger_replay_changes_nothing(spark, workdir):
    folder = os.path.join(workdir, "in")
    put(spark, folder, 1, FIRST)
    put(spark, folder, 2, SECOND)
    led = ledger(spark, workdir)
    one, two = (raw(spark.read.schema(SCHEMA).parquet(os.path.join(folder, f"f{n}"))) for n in (1, 2))
    led.apply(one, 0)
    led.apply(two, 1)
    before = spent(led)
    led.apply(two, 1)
    assert spent(led) == before and len(before) == 3


def test_ledger_empty_batch_and_hot_merchant(spark, workdir):
    led = ledger(spark, workdir)
    empty = raw(spark.createDataFrame([], SCHEMA))
    led.apply(empty, 0)
    assert spent(led) == {}
    hot = spark.range(6000).select(
        F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") % 28).cast("int")), "yyyy-MM-dd").alias("day"),
        F.when(F.col("id") % 3 == 0, F.lit("NETFLIX.COM")).otherwise(F.concat(F.lit("STALL "), F.translate(F.col("id").cast("string"), "0123456789", "ABCDEFGHIJ"))).alias("description"),
        F.format_string("%d.25", F.col("id") + 1).alias("out"), F.lit("").alias("code"), F.col("id").alias("n"),
        F.lit(None).cast("timestamp").alias("event_time"))
    led.apply(raw(hot), 1)
    assert sum(n for _, n in spent(led).values()) == 6000
    assert led.read("merchants").count() == 4001


def test_daily_emits_closed_days_once(spark, workdir):
    folder = os.path.join(workdir, "in")
    put(spark, folder, 1, [("2025-01-01", "KOPITIAM", "1.00", ""), ("2025-01-01", "KOPITIAM", "2.00", ""),
                           ("2025-01-01", "KOPITIAM", "2.00", ""), ("2025-01-05", "KOPITIAM", "4.00", "")])
    put(spark, folder, 2, [("2025-01-01", "KOPITIAM", "8.00", ""),   # its day closes with this micro-batch
                           ("2025-01-09", "KOPITIAM", "16.00", "")])
    put(spark, folder, 3, [("2025-01-01", "KOPITIAM", "32.00", ""),  # late: the day has been emitted
                           ("2025-01-20", "KOPITIAM", "64.00", "")])
    days = run_available(daily_spend_stream(stream(spark, folder)), spark, "daily")
    got = sorted((str(r.day), float(r.spent), r.txns) for r in days.collect())
    assert got == [("2025-01-01", 11.0, 3), ("2025-01-05", 4.0, 1), ("2025-01-09", 16.0, 1)]
