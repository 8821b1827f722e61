"""Views and roll-ups over a warehouse loaded with the golden statement."""

import os

import pytest

from conftest import fixture_path
from pyspark.sql import functions as F

from ledgerlens.operators import audits, quality, rollups, views
from ledgerlens.operators.load import Warehouse
from ledgerlens.sources import read_statements
from ledgerlens.sources.testdata import FIXTURE_CODES


@pytest.fixture(scope="module")
def view(spark, tmp_path_factory):
    wh = Warehouse(spark, os.path.join(str(tmp_path_factory.mktemp("wh")), "wh"))
    wh.initialise()
    wh.seed_codes(spark.createDataFrame(FIXTURE_CODES, "code string, description string"))
    wh.load_statements(read_statements(spark, fixture_path("statement.csv")))
    v = views.transactions_view(wh.read("transactions"), wh.read("merchants"), wh.read("categories"),
                                wh.read("codes"))
    return v.cache()


def test_view_columns_and_rows(view):
    assert view.columns == views.VIEW_COLUMNS
    assert view.count() == 13


def test_empty_selection_is_no_filter(view):
    state = views.FilterState()
    assert views.month_scoped(view, state).count() == 13
    assert views.full_view(view, state).count() == views.full_view(view, views.FilterState([], [])).count()


def test_expense_view_subset_of_month_scope(view):
    state = views.FilterState(["2024-03"], [], False, False)
    exp = {r.transaction_hash for r in views.expense_view(view, state).collect()}
    scope = {r.transaction_hash for r in views.month_scoped(view, state).collect()}
    assert exp <= scope
    cats = {r.category for r in views.expense_view(view, state).collect()}
    assert not cats & {"Transfers", "PayNow & FAST", "Cash Withdrawals", "Internal Transfers"}


def test_spend_share_and_kpis(view):
    exp = views.expense_view(view, views.FilterState())
    spent = {r.category: r.spent for r in rollups.spend_by_category(exp).collect()}
    # STARBUCKS 6.50 + FAIRPRICE 45.00 + KOPITIAM 5.00 = 56.50 food; GRAB 12.40; NETFLIX 15.98;
    # UNKNOWN PAYEE 3.20 uncategorised; the REFUND SHOP expense (-10) keeps its merchant's Income.
    assert spent == {"Food & Drink": 56.5, "Transport": 12.4, "Subscriptions": 15.98, "Uncategorised": 3.2,
                     "Income": 10.0}
    shares = {r.category: r.share_pct for r in rollups.category_share(exp).collect()}
    assert shares == {"Food & Drink": 57.6, "Transport": 12.6, "Subscriptions": 16.3, "Uncategorised": 3.3,
                      "Income": 10.2}
    k = rollups.kpis(views.month_scoped(view, views.FilterState()), views.expense_condition(views.FilterState())).first()
    assert (k.total_income, k.total_spent, k.unique_merchants) == (5010.0, 348.08, 7)
    assert round(k.net_flow, 2) == round(k.total_income - k.total_spent, 2)


def test_budget_variance_zero_limit(spark, view):
    exp = views.expense_view(view, views.FilterState())
    budgets = spark.createDataFrame([("Transport", 0.0), ("Donations", 100.0)], "category string, monthly_limit double")
    v = {r.category: (r.remaining, r.utilisation_pct) for r in rollups.budget_variance(exp, budgets).collect()}
    assert v["Transport"] == (pytest.approx(-12.4), pytest.approx(1240.0))
    assert v["Donations"] == (100.0, 0.0)
    long = rollups.budget_long(rollups.budget_variance(exp, budgets))
    assert {r.Metric for r in long.collect()} == {"Actual Spend", "Budget Limit"}


def test_search_is_literal_and_case_insensitive(view):
    full = views.full_view(view, views.FilterState(show_income=True))
    assert views.search(full, "grab").count() == 1
    assert views.search(full, "NETFLIX.COM").count() == 1
    assert views.search(full, "netflix.c.m", regex=True).count() == 1
    assert views.search(full, "netflix.c.m").count() == 0


def test_audits_and_quality(spark, view):
    stats = audits.load_stats(view).first()
    assert (stats.total, stats.merchants) == (13, 12)
    ratios = quality.quality_ratios(view).first()
    assert ratios.rows == 13 and ratios.merchants == 12 and ratios.merchants_ok
    assert audits.transfers_by_code(view).count() >= 1


def test_budget_months_scaling(spark, view):
    exp = views.expense_view(view, views.FilterState())
    budgets = spark.createDataFrame([("Transport", 10.0)], "category string, monthly_limit double")
    r = {x.category: x for x in rollups.budget_variance(exp, budgets, months=3).collect()}["Transport"]
    assert r.monthly_limit == 30.0 and round(r.remaining, 2) == 17.6


def test_shares_and_means_of_very_large_totals(spark):
    from decimal import Decimal

    from ledgerlens.functions.money import cents, mean_half_up

    rows = [("a", Decimal("-80000000000000000.01")), ("b", Decimal("-20000000000000000.00")), ("c", Decimal("-50.00"))]
    df = spark.createDataFrame(rows, "category string, amount decimal(28,2)")
    assert {r.category: r.share_pct for r in rollups.category_share(df).collect()} == {"a": 80.0, "b": 20.0, "c": 0.0}
    means = df.agg(mean_half_up(cents(F.sum("amount")), F.count("*")).alias("m")).first()
    assert means.m == -33333333333333350.0
