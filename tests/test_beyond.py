"""Running totals, unusual amounts, recurring payments, merchant groups, comparison, overrides, export."""

import datetime as dt
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import fixture_path
from ledgerlens.operators import compare, merchant_groups, recurring, running, views
from ledgerlens.operators.load import Warehouse
from ledgerlens.sources import read_statements
from ledgerlens.sources.testdata import FIXTURE_CODES
from ledgerlens.streaming.ingest import epoch_writer

VIEW = "transaction_hash string, merchant string, transaction_date date, month string, amount decimal(28,2), category string, description string"


def rows(n=600, seed=1):
    """A third of all rows on one merchant and in one month."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        hot = i % 3 == 0
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(31 if hot else 200))
        merchant = "HOT" if hot else f"M{rnd.randrange(12)}"
        out.append((f"{rnd.getrandbits(64):016x}", merchant, day, day.strftime("%Y-%m"), Decimal(-rnd.randint(100, 99999)) / 100, "Food & Drink", merchant))
    return out


def test_running_totals_equal_a_loop(spark):
    data = rows()
    view = spark.createDataFrame(data, VIEW)
    want, so_far = {}, {}
    for r in sorted(data, key=lambda r: (r[2], r[0])):
        so_far[r[3]] = so_far.get(r[3], Decimal(0)) - r[4]
        want[r[0]] = so_far[r[3]]
    assert {r.transaction_hash: r.spent_so_far for r in running.running_month_spend(view).collect()} == want
    days = {r.transaction_date: r.spent_so_far for r in running.running_day_spend(view).collect()}
    assert days == {d: want[max(r[0] for r in data if r[2] == d)] for d in {r[2] for r in data}}
    assert running.running_month_spend(view.limit(0)).count() == 0


def test_unusual_amounts_use_earlier_days_only(spark):
    data = rows() + [("f" * 16, "M1", dt.date(2025, 1, 1), "2025-01", Decimal("-99999.00"), "x", "x"), ("e" * 16, "NEW", dt.date(2025, 1, 1), "2025-01", Decimal("-1.00"), "x", "x")]
    got = {r.transaction_hash: r for r in running.unusual_amounts(spark.createDataFrame(data, VIEW)).collect()}
    for h, merchant, day, _, amount, _, _ in data:
        prior = [float(r[4]) for r in data if r[1] == merchant and r[2] < day]
        assert got[h].prior_count == len(prior)
        if prior:
            mean = sum(prior) / len(prior)
            std = math.sqrt(sum((x - mean) ** 2 for x in prior) / len(prior))
            assert got[h].prior_mean == pytest.approx(mean) and got[h].prior_std == pytest.approx(std, abs=1e-4)
            assert got[h].unusual == (len(prior) >= 5 and abs(float(amount) - mean) > 3 * std)
        else:
            assert got[h].prior_mean is None and got[h].prior_std is None and not got[h].unusual
    assert got["f" * 16].unusual


def series(merchant, amount, days):
    return [(f"{merchant}{i}", merchant, d, d.strftime("%Y-%m"), Decimal(amount), "x", merchant) for i, d in enumerate(days)]


def test_recurring_payments_are_found_and_broken_series_are_not(spark):
    start, rnd, data = dt.date(2022, 1, 31), random.Random(2), []
    months = [dt.date(2022 + (m // 12), m % 12 + 1, 15 + rnd.randint(-1, 1)) for m in range(20)]
    data += series("MONTHLY", "-15.98", months)
    data += series("WEEKLY", "-7.50", [start + dt.timedelta(days=7 * i) for i in range(30)])
    data += series("YEARLY", "-120.00", [start, start.replace(year=2023), start.replace(year=2024)])
    data += series("BROKEN", "-15.98", [d for i, d in enumerate(months) if i % 3])
    data += series("TWICE", "-9.00", months[:2])
    for j in range(40):  # merchants paid at random
        data += series(f"RANDOM{j}", "-12.00", [start + dt.timedelta(days=rnd.randrange(700)) for _ in range(12)])
    # a third of all rows on one merchant, with one monthly series of its own amount among them
    data += [(f"h{i}", "HOT", start + dt.timedelta(days=rnd.randrange(600)), "x", Decimal(-rnd.randint(2000, 9999)) / 100, "x", "x") for i in range(len(data) // 2)]
    data += series("HOT", "-150.00", months)
    found = {(r.merchant, r.band_from): r for r in recurring.payment_series(spark.createDataFrame(data, VIEW)).collect()}
    named = {k for k, r in found.items() if r.recurring}
    planted = {("MONTHLY", 15.0), ("WEEKLY", 7.5), ("YEARLY", 120.0), ("HOT", 150.0)}
    assert planted <= named and len(planted) >= 0.9 * len(named)
    assert not found["BROKEN", 15.0].recurring and ("TWICE", 9.0) not in found
    assert found["YEARLY", 120.0].cadence == "yearly" and found["YEARLY", 120.0].next_due == dt.date(2025, 1, 31)
    assert found["WEEKLY", 7.5].next_due == start + dt.timedelta(days=7 * 30)
    assert found["MONTHLY", 15.0].regular_share == 1.0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def grouped(names):
    letters = {n: "".join(c for c in n.upper() if c.isalpha()) for n in names}
    parent = {n: n for n in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in names:
        for b in names:
            x, y = letters[a], letters[b]
            short = min(len(x), len(y))
            alike = x and (x == y or distance(x, y) <= (2 if short >= 16 else 1 if short >= 5 else 0) and y != "")
            if a < b and alike and root(a) != root(b):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {n: root(n) for n in names}


def test_merchant_groups_equal_all_pairs(spark):
    rnd = random.Random(4)
    names = {"7-ELEVEN 012", "7-ELEVEN 377", "STARBUCKS JURONG", "STARBUCK JURONG", "GRAB", "GRAP", "", "123", "#9", "MCDONALDS", "McDonald's", "ÉCLAIR HOUSE", "ECLAIR HOUSE"}
    base = "NORTHERN GENERAL TRADING"
    for _ in range(60):  # a family
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = rnd.choice("AEIOUXYZ 17")
        names.add("".join(t))
    names |= {"".join(rnd.choice("ABCDE") for _ in range(rnd.randint(3, 7))) for _ in range(80)}
    df = spark.createDataFrame([(n,) for n in names] + [(None,), ("GRAB",)], "merchant string")
    out = merchant_groups.merchant_groups(df).collect()
    got, want = {r.merchant: r.merchant_group for r in out}, grouped(sorted(names))
    assert got == want and len(out) == len(names)
    assert {r.merchant: r.group_size for r in out} == {n: sum(g == want[n] for g in want.values()) for n in names}
    assert merchant_groups.merchant_groups(df.limit(0)).count() == 0


def test_a_merchant_family_makes_small_blocks(spark):
    """The candidate join grows with the names, not with the square of the family."""
    def candidates(n):
        rnd = random.Random(5)
        names = {"STALL " + "".join(rnd.choice("ABCDEFGHIJ") for _ in range(6)) for _ in range(n)}
        keys = spark.createDataFrame([(x.replace(" ", ""),) for x in names], "class string").select(F.explode(merchant_groups.variants(F.col("class"))).alias("k"))
        return keys.groupBy("k").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * F.col("c"))).first()[0] / len(names)

    assert candidates(3000) < 2 * candidates(1000)


def test_compare_statements(spark):
    d = dt.date(2024, 1, 1)
    schema = "transaction_date date, description string, amount decimal(28,2)"
    a = [(d, "KEPT", 1), (d, "GONE", 2), (d, "GONE", 2), (d, "PRICE", 3), (d, "PRICE", 3), (d, "LESS", 4), (d, "LESS", 4), (d, "TWO", 5), (d, "TWO", 6)]
    b = [(d, "KEPT", 1), (d, "NEW", 9), (d, "PRICE", 7), (d, "LESS", 4), (d, "TWO", 8)]
    make = lambda x: spark.createDataFrame([(p, q, Decimal(r)) for p, q, r in x], schema)
    whole = lambda v: None if v is None else int(v)
    got = {(r.description, r.change, whole(r.amount_before), whole(r.amount_after), r.n) for r in compare.compare_statements(make(a), make(b)).collect()}
    assert got == {
        ("GONE", "removed", 2, None, 2), ("NEW", "added", None, 9, 1), ("PRICE", "changed", 3, 7, 1), ("PRICE", "removed", 3, None, 1),
        ("LESS", "removed", 4, None, 1), ("TWO", "removed", 5, None, 1), ("TWO", "removed", 6, None, 1), ("TWO", "added", None, 8, 1),
    }
    assert compare.compare_statements(make(a), make(a)).count() == 0


@pytest.fixture()
def warehouse(spark, workdir):
    wh = Warehouse(spark, f"{workdir}/wh")
    wh.initialise()
    wh.seed_codes(spark.createDataFrame(FIXTURE_CODES, "code string, description string"))
    wh.load_statements(read_statements(spark, fixture_path("statement.csv")))
    return wh


def categories(wh, merchant):
    return {r.category for r in wh.view().where(F.col("merchant") == merchant).collect()}


def files(wh):
    return {f for f in wh.read("transactions").select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}


def test_override_holds_for_stored_and_reloaded_rows(spark, warehouse):
    wh = warehouse
    n = wh.view().count()
    merchant = wh.read("merchants").orderBy("merchant").first()["merchant"]
    before, base = files(wh), categories(wh, merchant)
    chosen = spark.createDataFrame([(merchant, "Side Business"), (None, "x"), (merchant, None)], "merchant string, category string")
    assert wh.set_overrides(chosen) == 1
    assert categories(wh, merchant) == {"Side Business"} and wh.view().count() == n
    assert {r.category for r in wh.merchant_categories().where("overridden").collect()} == {"Side Business"}
    months = wh.fold_overrides()
    touched = {r.month for r in wh.view().where(F.col("merchant") == merchant).collect()}
    assert set(months) == touched and wh.fold_overrides() == []
    kept = {f for f in before if not any(f"year_month={m}" in f for m in months)}
    assert kept <= files(wh) and wh.view().count() == n
    assert {r.category for r in wh.read("transactions").where(F.col("merchant") == merchant).collect()} == {"Side Business"}
    wh.reset()
    wh.seed_codes(spark.createDataFrame(FIXTURE_CODES, "code string, description string"))
    wh.load_statements(read_statements(spark, fixture_path("statement.csv")))
    assert categories(wh, merchant) == {"Side Business"} and wh.view().count() == n
    wh.set_overrides(spark.createDataFrame([(merchant, "Travel")], "merchant string, category string"))
    assert categories(wh, merchant) == {"Travel"}
    assert wh.clear_overrides(spark.createDataFrame([(merchant,), ("NO SUCH",)], "merchant string")) == 1
    assert categories(wh, merchant) == base


def test_a_fold_that_stops_is_finished_by_the_next_load(spark, warehouse, monkeypatch):
    wh = warehouse
    merchant = wh.read("merchants").orderBy("merchant").first()["merchant"]
    want = sorted(map(tuple, wh.view().where(F.col("merchant") != merchant).collect()), key=str)
    wh.set_overrides(spark.createDataFrame([(merchant, "Side Business")], "merchant string, category string"))
    finish = Warehouse._finish_fold
    monkeypatch.setattr(Warehouse, "_finish_fold", lambda self: None)
    wh.fold_overrides()  # stops once the copy is complete
    monkeypatch.setattr(Warehouse, "_finish_fold", finish)
    assert categories(wh, merchant) == {"Side Business"}
    wh.load_statements(read_statements(spark, fixture_path("statement.csv")))
    assert wh.fold_overrides() == [] and categories(wh, merchant) == {"Side Business"}
    assert sorted(map(tuple, wh.view().where(F.col("merchant") != merchant).collect()), key=str) == want


def test_export_round_trip(spark, workdir):
    data = [(f"{i:016x}", 'A "B", C', dt.date(2024, 1, 1 + i % 9), "2024-01", Decimal("-1.50"), "Food & Drink", f'line {i}\nsecond, "quoted"') for i in range(40)]
    view = spark.createDataFrame(data, VIEW).withColumn("transaction_code", F.lit(None).cast("string"))
    path = f"{workdir}/export"
    for _ in range(2):  # the second replaces the first
        views.export_csv(view, path)
    want = views.display_log(view)
    got = views.read_exported(spark, path)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_replayed_micro_batch_is_stored_once(spark, workdir):
    write = epoch_writer(f"{workdir}/out")
    write(spark.range(5), 0)
    write(spark.range(5, 8), 1)
    write(spark.range(5, 8), 1)
    assert sorted(r.id for r in spark.read.parquet(f"{workdir}/out").collect()) == list(range(8))
