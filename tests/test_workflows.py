import os

from conftest import fixture_path
from ledgerlens.operators.views import FilterState
from ledgerlens.plans.workflows import audit_report, dashboard, load_statement_files
from ledgerlens.operators.load import Warehouse


def test_load_dashboard_and_audits(spark, workdir):
    root = os.path.join(workdir, "wh")
    summary = load_statement_files(spark, fixture_path("statement.csv"), root, code_list=fixture_path("codes.txt"))
    assert summary.report.inserted == 13
    again = load_statement_files(spark, fixture_path("statement.csv"), root, code_list=fixture_path("codes.txt"))
    assert (again.report.inserted, again.report.skipped) == (0, 13)
    stats = summary.stats.first()
    assert stats.total == 13
    wh = Warehouse(spark, root)
    d = dashboard(wh, FilterState(), search_text="grab")
    assert d.log.count() == 1
    assert d.kpis.first().total_income == 5010.0
    # default budgets: every spending category with limit 0; rows with spend remain
    assert {r.category for r in d.budget_variance.collect()} == {"Food & Drink", "Transport", "Subscriptions",
                                                                  "Uncategorised", "Income"}
    report = audit_report(wh)
    assert set(report) >= {"transfers_by_code", "singleton_merchants", "code_listing"}
    for df in report.values():
        df.collect()
