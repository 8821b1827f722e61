"""Cleaning stays cheap: compiled methods, nothing staged that can be derived; same dates as before."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import parse_mixed_date
from ledgerlens.operators.clean import typed_rows
from ledgerlens.plans.star import build_star

HEADERS = "`Transaction Date` string, Description string, `Withdrawal Amount` string, `Deposit Amount` string, `Transaction Code` string, account_id long, seq struct<n: long>"


def statements(spark):
    return spark.createDataFrame([("2024-03-05", "Uniqlo", "6.50", "", "POS", 1, (1,)), ("05/03/2024", "UNIQLO ", " 6.5", "", "", 1, (2,)), ("5 Mar 2024", "NETFLIX.COM SG", "", "7", None, 1, (3,))], HEADERS)


def test_methods_of_cleaning_are_compiled(spark):
    """The JVM interprets methods above 8,000 bytes; no session setting should be needed."""
    debug = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package")
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    try:
        stages = debug.codegenStringSeq(typed_rows(statements(spark))._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", before)
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert sizes and max(sizes) <= 8000


def test_batch_is_staged_without_fingerprints(spark):
    star = build_star(spark, "", statements(spark))
    rows = star.batch.select("transaction_hash", "merchant_name", "seq.n").collect()
    assert sorted((r.merchant_name, r.n) for r in rows) == [("NETFLIX.COM", 3), ("UNIQLO", 1)]
    assert sorted(r.transaction_hash for r in rows) == sorted(r.transaction_hash for r in star.first.collect())
    assert "transaction_hash" not in spark.read.parquet(*star.batch.inputFiles()).columns


@pytest.mark.parametrize(("text", "date"), [
    ("2024-2-9", dt.date(2024, 2, 9)), ("2024-02-30", None), ("29/2/2024", dt.date(2024, 2, 29)), ("29/2/2023", None),
    ("31/02/1997", None), ("01/25/2025", dt.date(2025, 1, 25)), ("1-25-2025", dt.date(2025, 1, 25)), ("25-1-2025", dt.date(2025, 1, 25)),
    ("1/1/99", dt.date(1999, 1, 1)), ("01.02.2024", dt.date(2024, 2, 1)), ("1.25.2024", dt.date(2024, 1, 25)), ("2 jan 2024", dt.date(2024, 1, 2)),
    ("0/1/2024", None), ("2024/3/5", dt.date(2024, 3, 5)), ("March 5, 2024", dt.date(2024, 3, 5)), ("20240305", dt.date(2024, 3, 5)),
    ("2024-03-05 10:00", dt.date(2024, 3, 5)), ("", None), (None, None),
])
def test_dates(spark, text, date):
    assert spark.createDataFrame([(text,)], "t string").select(parse_mixed_date(F.col("t"))).first()[0] == date
