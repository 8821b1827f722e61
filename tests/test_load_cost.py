"""What a load pays for each row, and that the cheaper forms give the same rows."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.functions import strip_cell
from ledgerlens.functions.text import WHITESPACE
from ledgerlens.operators.clean import first_rows, typed_rows

HEADERS = "`Transaction Date` string, Description string, `Withdrawal Amount` string, `Deposit Amount` string, `Transaction Code` string, account_id long, seq struct<n: long>"
TYPED = "description string, transaction_date date, amount decimal(28,2), transaction_code string, seq struct<n: long>"


def test_rows_with_any_day_and_amount_are_told_apart(spark):
    amounts = ["0.01", "-0.01", "335544.31", "335544.32", "-335544.32", "335544.33", "9999999999999.99", "-9999999999999.99",
               "10000000000000.00", "-10000000000000.00", "99999999999999999999999999.99", "-99999999999999999999999999.99"]
    days = [dt.date(1, 1, 1), dt.date(1969, 12, 31), dt.date(1970, 1, 1), dt.date(2024, 2, 29), dt.date(9999, 12, 31)]
    texts = ["SAME START A", "SAME START B", "", "中文", None]
    keys = [(t, d, Decimal(a)) for t in texts for d in days for a in amounts]
    rows = [(*k, f"C{n}", (n,)) for k in keys for n in (3, 1, 2)]
    found = [tuple(r) for r in first_rows(spark.createDataFrame(rows, TYPED).repartition(5)).collect()]
    assert len(found) == len(keys) and {r[:3] for r in found} == set(keys)
    assert {(r[3], r[4].n) for r in found} == {("C1", 1)}


def test_first_rows_are_sorted_by_a_number(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1), Decimal("1.00"), "POS", (1,))], TYPED)
    plan = first_rows(df)._jdf.queryExecution().sparkPlan()
    assert plan.toString().count("Aggregate(key=[_") > 0  # of the columns packed into numbers, the first leads
    assert first_rows(df).schema["amount"].dataType == df.schema["amount"].dataType


def test_cells_are_cleaned_in_one_projection(spark):
    raw = spark.createDataFrame([("2024-03-05", "Uniqlo", "6.50", "", "POS", 1, (1,))], HEADERS)
    plan = typed_rows(raw)._jdf.queryExecution().executedPlan().toString()
    assert "_common_expr" not in plan and "_in_text" not in plan


def test_cells_are_stripped_like_python_does(spark):
    inner = ["", "a", "a b", "1,234.50", "\x7fa", "a\x7f", "中 文", "é", "\x00a\x00", "-", "~"]
    ends = ["", " ", "  ", *WHITESPACE, "\t 　", "​"]
    cells = [a + t + b for t in inner for a in ends for b in ends] + [None]
    out = spark.createDataFrame([(c,) for c in cells], "c string").select("c", strip_cell(F.col("c")).alias("s")).collect()
    assert len(out) == len(cells) and all(r.s == (None if r.c is None else r.c.strip()) for r in out)


def _folded_copy(spark, workdir, monkeypatch):
    """A warehouse whose fold stops once its copy is complete, and the file names of that copy."""
    import glob
    import os

    from ledgerlens.operators.load import Warehouse

    wh = Warehouse(spark, f"{workdir}/wh")
    wh.initialise()
    raw = [(f"2024-0{1 + n % 3}-05", f"SHOP {n % 2}", f"{n}.50", "", None, 1, (n,)) for n in range(12)]
    wh.load_statements(spark.createDataFrame(raw, HEADERS))
    wh.set_overrides(spark.createDataFrame([("SHOP 1", "Side Business")], "merchant string, category string"))
    with monkeypatch.context() as m:
        m.setattr(Warehouse, "_finish_fold", lambda self: None)
        assert wh.fold_overrides() == ["2024-01", "2024-02", "2024-03"]
    return wh, {os.path.basename(f) for f in glob.glob(f"{wh.path(wh.FOLD)}/year_month=*/*.parquet")}


def test_a_fold_writes_its_months_once(spark, workdir, monkeypatch):
    import glob
    import os

    wh, copied = _folded_copy(spark, workdir, monkeypatch)
    wh._finish_fold()
    assert copied and {os.path.basename(f) for f in glob.glob(f"{wh.path('transactions')}/year_month=*/*.parquet")} == copied
    assert not os.path.exists(wh.path(wh.FOLD))
    rows = wh.read("transactions").collect()
    assert len(rows) == 12 and {r.category for r in rows if r.merchant == "SHOP 1"} == {"Side Business"}
    assert wh.fold_overrides() == []


def test_a_replacement_that_stops_between_months_is_finished(spark, workdir, monkeypatch):
    import shutil

    wh, _ = _folded_copy(spark, workdir, monkeypatch)
    want = sorted(map(tuple, wh.view().drop("created_at").collect()), key=str)
    shutil.rmtree(f"{wh.path('transactions')}/year_month=2024-01")  # one month is in place already,
    shutil.move(f"{wh.path(wh.FOLD)}/year_month=2024-01", wh.path("transactions"))
    shutil.rmtree(f"{wh.path('transactions')}/year_month=2024-02")  # the next is taken away and not replaced yet
    wh._finish_fold()
    assert sorted(map(tuple, wh.view().drop("created_at").collect()), key=str) == want
    assert wh.fold_overrides() == []
