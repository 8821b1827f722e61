"""End-to-end entry points over a stored warehouse, mirroring how the source application is
used: load statement files (with the code list), build the dashboard frames for one filter
state, and produce the audit report. Everything returned is a lazy DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators import audits, rollups, views
from ledgerlens.operators.load import LoadReport, Warehouse
from ledgerlens.sources import read_statements


@dataclass
class LoadSummary:
    report: LoadReport
    by_category: DataFrame  # category, n, total (cents), ascending total
    stats: DataFrame  # total, coded, merchants, uncategorised, floor percentages


def load_statement_files(
    spark: SparkSession,
    statements: str | list[str],
    warehouse_root: str,
    code_list: str | None = None,
    reset: bool = False,
    strip_thousands: bool = False,
) -> LoadSummary:
    """Create the warehouse if needed (optionally emptying it first), seed the code list if one
    is given and present, load the statement files idempotently, and summarise the result."""
    wh = Warehouse(spark, warehouse_root)
    wh.initialise()
    if reset:
        wh.reset()
    if code_list:
        wh.seed_codes_from_file(code_list)
    report = wh.load_statements(read_statements(spark, statements), strip_thousands=strip_thousands)
    view = warehouse_view(wh)
    return LoadSummary(report, audits.category_summary(view).orderBy("total"), audits.load_stats(view))


def warehouse_view(wh: Warehouse) -> DataFrame:
    return wh.view()


@dataclass
class Dashboard:
    view: DataFrame
    month_scope: DataFrame
    expenses: DataFrame
    log: DataFrame
    budgets: DataFrame
    by_category: DataFrame
    share: DataFrame
    monthly_trend: DataFrame
    daily: DataFrame
    top_merchants: DataFrame
    kpis: DataFrame
    income_vs_spend: DataFrame
    budget_variance: DataFrame
    budget_long: DataFrame
    uncategorised: DataFrame
    filter_options: DataFrame
    code_coverage: DataFrame


def dashboard(wh: Warehouse, state: views.FilterState, search_text: str = "", top_n: int = 12) -> Dashboard:
    """Every frame the dashboard shows for one filter state. Each is one plan over the stored
    tables; persist ``view`` first when many of them are computed in one session."""
    view = warehouse_view(wh)
    month_scope = views.month_scoped(view, state)
    expenses = views.expense_view(view, state)
    log = views.display_log(views.search(views.full_view(view, state), search_text).orderBy(
        F.desc("transaction_date"), "transaction_hash"))
    budgets = wh.budgets_or_default(view)
    variance = rollups.budget_variance(expenses, budgets).orderBy(
        F.desc("utilisation_pct"), "category")
    return Dashboard(
        view=view,
        month_scope=month_scope,
        expenses=expenses,
        log=log,
        budgets=budgets,
        by_category=rollups.spend_by_category(expenses).orderBy(F.desc("spent"), "category"),
        share=rollups.category_share(expenses),
        monthly_trend=rollups.monthly_trend(expenses),
        daily=rollups.daily_spend(expenses),
        top_merchants=rollups.top_merchants(expenses, top_n),
        kpis=rollups.kpis(month_scope, views.expense_condition(state)),
        income_vs_spend=rollups.income_vs_spend(month_scope),
        budget_variance=variance,
        budget_long=rollups.budget_long(variance),
        uncategorised=rollups.uncategorised_review(view).orderBy("Total_SGD", "merchant"),
        filter_options=audits.filter_options(view).orderBy("kind", "value"),
        code_coverage=audits.code_coverage(view),
    )


def audit_report(wh: Warehouse) -> dict[str, DataFrame]:
    """The eight audit sections plus the code listing and codes per category."""
    view = warehouse_view(wh)
    tx, merchants = wh.read("transactions"), wh.read("merchants")
    codes, categories = wh.read("codes"), wh.read("categories")
    return {
        "transfers_by_code": audits.transfers_by_code(view),
        "transfers_preview": audits.transfers_preview(view),
        "paynow_by_code": audits.paynow_by_code(view).orderBy(F.desc("n")),
        "uncategorised_patterns": audits.uncategorised_patterns(view),
        "singleton_merchants": audits.singleton_merchants(merchants, tx),
        "singleton_merchant_count": audits.singleton_merchant_count(merchants, tx),
        "distinct_dates": audits.distinct_dates(tx),
        "uncoded_by_category": audits.uncoded_by_category(view).orderBy(F.desc("no_code_count")),
        "income_by_code": audits.income_by_code(view).orderBy(F.desc("total")),
        "code_listing": audits.code_listing(codes, categories),
        "codes_per_category": audits.codes_per_category(codes, categories).orderBy(F.desc("cnt")),
    }
