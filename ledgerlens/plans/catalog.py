"""Named queries: each takes (spark, sf_dir) and returns a lazy DataFrame over the whole tables.

Money leaves every query as double (it is summed as decimal inside); counts are bigint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.dates import parse_mixed_date
from ledgerlens.operators import audits, quality, rollups, views
from ledgerlens.defaults import MERCHANT_KEYWORDS
from ledgerlens.functions.money import money_label, percent_label
from ledgerlens.functions.rules import first_match
from ledgerlens.operators.categorise import classify_codes
from ledgerlens.operators.dimension import first_writer_categories
from ledgerlens.operators.load import seeded_categories
from ledgerlens.plans.star import DEFAULT_STATE, SEARCH_REGEX, SEARCH_TEXT, SELECTED_STATE, build_star, two_loads
from ledgerlens.sources import testdata
from ledgerlens.sources.literal import literal_table

Query = Callable[[SparkSession, str], DataFrame]


def _dbl(c: str) -> F.Column:
    return F.col(c).cast("double").alias(c)


# -- cleaning -------------------------------------------------------------------------------

def clean_transactions(spark, sf_dir):
    s = build_star(spark, sf_dir)
    return s.clean.select(
        "transaction_date", "year_month", _dbl("amount"), "description",
        "transaction_code", "merchant_name", "transaction_hash",
    )


def parse_mixed_dates(spark, sf_dir):
    raw = testdata.raw_statements(spark, sf_dir)
    return raw.groupBy(
        F.col("Transaction Date").alias("date_text"),
        parse_mixed_date(F.col("Transaction Date")).alias("transaction_date"),
    ).agg(F.count("*").alias("n"))


def merchant_normalise(spark, sf_dir):
    s = build_star(spark, sf_dir)
    return s.clean.groupBy("description", "merchant_name").agg(F.count("*").alias("n"))


def transaction_hash(spark, sf_dir):
    s = build_star(spark, sf_dir)
    return s.clean.select("transaction_date", _dbl("amount"), "description", "transaction_hash")


def dedup_batch(spark, sf_dir):
    s = build_star(spark, sf_dir)
    return s.first.select("transaction_hash", "transaction_date", _dbl("amount"), "description",
                          "transaction_code", "merchant_name")


def keyword_categories(spark, sf_dir):
    s = build_star(spark, sf_dir)
    per = s.clean.groupBy("description").agg(F.count("*").alias("n")).withColumn("_lc", F.lower("description"))
    return per.select("description", first_match(F.col("_lc"), MERCHANT_KEYWORDS).alias("keyword_category"), "n")


# -- codes ----------------------------------------------------------------------------------

def _document_codes(spark, sf_dir):
    return classify_codes(testdata.document_descriptions(spark, sf_dir))


def code_classification(spark, sf_dir):
    return _document_codes(spark, sf_dir).select("code", "category")


def codes_per_category(spark, sf_dir):
    return audits.codes_per_category(_document_codes(spark, sf_dir), seeded_categories(spark))


def code_listing(spark, sf_dir):
    return audits.code_listing(_document_codes(spark, sf_dir), seeded_categories(spark))


# -- categories and loading -----------------------------------------------------------------

def row_category(spark, sf_dir):
    from ledgerlens.operators.categorise import categorise_rows

    s = build_star(spark, sf_dir)
    return categorise_rows(s.first, s.codes).select("transaction_hash", "transaction_code", "row_category")


def merchant_dimension(spark, sf_dir):
    return build_star(spark, sf_dir).merchants


def incremental_load(spark, sf_dir):
    batch = two_loads(spark, sf_dir)
    tx = batch.select("transaction_hash", F.col("merchant_name").alias("merchant"), "load_no", "amount")
    return tx.join(first_writer_categories(batch), "merchant").select(
        "transaction_hash", "merchant", "category", "load_no", _dbl("amount"))


def load_counters(spark, sf_dir):
    seen = Observation("clean")
    stored = two_loads(spark, sf_dir, seen).agg(
        F.count("*").alias("batch_rows"),
        F.count_if(F.col("load_no") == 1).alias("first_load_inserted"),
        F.count_if(F.col("load_no") == 2).alias("second_load_inserted"),
    )
    counted = {n: seen.get.get(n, 0) for n in ("raw_rows", "bad_dates", "zero_amounts", "rejected_amounts")}
    kept = counted["raw_rows"] - counted["bad_dates"] - counted["zero_amounts"]
    return stored.select(
        *[F.lit(v).cast("long").alias(n) for n, v in counted.items()],
        "batch_rows", "first_load_inserted", "second_load_inserted",
        (F.lit(kept) - F.col("batch_rows")).alias("in_batch_duplicates"),
        (F.col("batch_rows") - F.col("second_load_inserted")).alias("second_load_skipped"),
    )


# -- views ----------------------------------------------------------------------------------

def _view_out(df: DataFrame) -> DataFrame:
    return df.select(
        "transaction_hash", "transaction_date", _dbl("amount"), "description", "transaction_code",
        "code_description", "merchant", "category", "month", "day", "is_expense",
    )


def full_view(spark, sf_dir):
    return _view_out(build_star(spark, sf_dir).view)


def month_scoped(spark, sf_dir):
    return _view_out(views.month_scoped(build_star(spark, sf_dir).view, SELECTED_STATE))


def expense_view(spark, sf_dir):
    state = views.FilterState(SELECTED_STATE.selected_months, (), False, False)
    return _view_out(views.expense_view(build_star(spark, sf_dir).view, state))


def full_log_view(spark, sf_dir):
    return views.display_log(views.full_view(build_star(spark, sf_dir).view, SELECTED_STATE))


def search_log(spark, sf_dir):
    state = views.FilterState(show_income=True)
    v = views.full_view(build_star(spark, sf_dir).view, state)
    return views.display_log(views.search(v, SEARCH_TEXT))


# -- roll-ups ---------------------------------------------------------------------------------

def _expenses(spark, sf_dir):
    return views.expense_view(build_star(spark, sf_dir).view, DEFAULT_STATE)


def spend_by_category(spark, sf_dir):
    return rollups.spend_by_category(_expenses(spark, sf_dir))


def monthly_trend(spark, sf_dir):
    return rollups.monthly_trend(_expenses(spark, sf_dir))


def daily_spend(spark, sf_dir):
    return rollups.daily_spend(_expenses(spark, sf_dir))


def top_merchants(spark, sf_dir):
    return rollups.top_merchants(_expenses(spark, sf_dir))


def category_share(spark, sf_dir):
    return rollups.category_share(_expenses(spark, sf_dir))


def share_axis(spark, sf_dir):
    return rollups.share_axis_bound(rollups.category_share(_expenses(spark, sf_dir)))


def kpis(spark, sf_dir):
    v = build_star(spark, sf_dir).view
    return rollups.kpis(views.month_scoped(v, DEFAULT_STATE), views.expense_condition(DEFAULT_STATE))


def income_vs_spend(spark, sf_dir):
    return rollups.income_vs_spend(views.month_scoped(build_star(spark, sf_dir).view, DEFAULT_STATE))


def budget_variance(spark, sf_dir):
    return rollups.budget_variance(_expenses(spark, sf_dir), testdata.fixture_budgets(spark))


def budget_long(spark, sf_dir):
    return rollups.budget_long(budget_variance(spark, sf_dir))


def default_budgets(spark, sf_dir):
    return rollups.default_budgets(build_star(spark, sf_dir).view)


def uncategorised_review(spark, sf_dir):
    return rollups.uncategorised_review(build_star(spark, sf_dir).view)


def uncategorised_totals(spark, sf_dir):
    return rollups.uncategorised_totals(build_star(spark, sf_dir).view)


# -- audits ---------------------------------------------------------------------------------

def category_summary(spark, sf_dir):
    return audits.category_summary(build_star(spark, sf_dir).view)


def load_stats(spark, sf_dir):
    return audits.load_stats(build_star(spark, sf_dir).view)


def code_coverage(spark, sf_dir):
    return audits.code_coverage(build_star(spark, sf_dir).view)


def transfers_by_code(spark, sf_dir):
    return audits.transfers_by_code(build_star(spark, sf_dir).view)


def transfers_preview(spark, sf_dir):
    return audits.transfers_preview(build_star(spark, sf_dir).view)


def paynow_by_code(spark, sf_dir):
    return audits.paynow_by_code(build_star(spark, sf_dir).view)


def income_by_code(spark, sf_dir):
    return audits.income_by_code(build_star(spark, sf_dir).view)


def uncategorised_patterns(spark, sf_dir):
    return audits.uncategorised_patterns(build_star(spark, sf_dir).view)


def singleton_merchants(spark, sf_dir):
    s = build_star(spark, sf_dir)
    return audits.singleton_merchants(s.merchants, s.transactions)


def singleton_merchant_count(spark, sf_dir):
    s = build_star(spark, sf_dir)
    return audits.singleton_merchant_count(s.merchants, s.transactions)


def distinct_dates(spark, sf_dir):
    return audits.distinct_dates(build_star(spark, sf_dir).transactions)


def uncoded_by_category(spark, sf_dir):
    return audits.uncoded_by_category(build_star(spark, sf_dir).view)


def filter_options(spark, sf_dir):
    return audits.filter_options(build_star(spark, sf_dir).view)


# -- quality --------------------------------------------------------------------------------

def quality_ratios(spark, sf_dir):
    return quality.quality_ratios(build_star(spark, sf_dir).view)


def referential_check(spark, sf_dir):
    s = build_star(spark, sf_dir)
    return quality.referential_check(s.transactions, s.merchants, s.categories, s.codes)


def uniqueness_check(spark, sf_dir):
    s = build_star(spark, sf_dir)
    return quality.uniqueness_check(s.transactions, s.merchants, s.categories, s.codes)


def null_check(spark, sf_dir):
    s = build_star(spark, sf_dir)
    return quality.null_check(s.transactions, s.merchants)


def _damaged(spark, sf_dir):
    """A star with faults of every kind the checks look for: missing merchants and codes, unknown
    categories, transactions stored twice, descriptions missing."""
    s = build_star(spark, sf_dir)
    unknown = F.lit("No such category")
    merchants = s.merchants.where("merchant not like 'S%'").withColumn(
        "category", F.when(F.col("merchant").like("G%"), unknown).otherwise(F.col("category")))
    codes = s.codes.where("code <> 'MST'").withColumn("category", F.when(F.col("code") == "AWL", unknown).otherwise(F.col("category")))
    day = F.dayofmonth("transaction_date")
    t = s.transactions.withColumn("description", F.when(day != 2, F.col("description")))
    return s, t.unionByName(t.where(day == 1)), merchants, codes


def referential_check_damaged(spark, sf_dir):
    s, transactions, merchants, codes = _damaged(spark, sf_dir)
    return quality.referential_check(transactions, merchants, s.categories, codes)


def uniqueness_check_damaged(spark, sf_dir):
    s, transactions, merchants, codes = _damaged(spark, sf_dir)
    return quality.uniqueness_check(transactions, merchants, s.categories, codes)


def null_check_damaged(spark, sf_dir):
    _, transactions, merchants, _ = _damaged(spark, sf_dir)
    return quality.null_check(transactions, merchants)


QUERIES: dict[str, Query] = {
    "referential_check_damaged": referential_check_damaged,
    "uniqueness_check_damaged": uniqueness_check_damaged,
    "null_check_damaged": null_check_damaged,
    "clean_transactions": clean_transactions,
    "parse_mixed_dates": parse_mixed_dates,
    "merchant_normalise": merchant_normalise,
    "transaction_hash": transaction_hash,
    "dedup_batch": dedup_batch,
    "keyword_category": keyword_categories,
    "code_classification": code_classification,
    "codes_per_category": codes_per_category,
    "code_listing": code_listing,
    "row_category": row_category,
    "merchant_dimension": merchant_dimension,
    "incremental_load": incremental_load,
    "load_counters": load_counters,
    "full_view": full_view,
    "month_scoped": month_scoped,
    "expense_view": expense_view,
    "full_log_view": full_log_view,
    "search_log": search_log,
    "spend_by_category": spend_by_category,
    "monthly_trend": monthly_trend,
    "daily_spend": daily_spend,
    "top_merchants": top_merchants,
    "category_share": category_share,
    "share_axis": share_axis,
    "kpis": kpis,
    "income_vs_spend": income_vs_spend,
    "budget_variance": budget_variance,
    "budget_long": budget_long,
    "default_budgets": default_budgets,
    "uncategorised_review": uncategorised_review,
    "uncategorised_totals": uncategorised_totals,
    "category_summary": category_summary,
    "load_stats": load_stats,
    "code_coverage": code_coverage,
    "transfers_by_code": transfers_by_code,
    "transfers_preview": transfers_preview,
    "paynow_by_code": paynow_by_code,
    "income_by_code": income_by_code,
    "uncategorised_patterns": uncategorised_patterns,
    "singleton_merchants": singleton_merchants,
    "singleton_merchant_count": singleton_merchant_count,
    "distinct_dates": distinct_dates,
    "uncoded_by_category": uncoded_by_category,
    "filter_options": filter_options,
    "quality_ratios": quality_ratios,
    "referential_check": referential_check,
    "uniqueness_check": uniqueness_check,
    "null_check": null_check,
}


# -- streaming --------------------------------------------------------------------------------

def _event_batch_star(spark, sf_dir):
    """Batch view of the events-derived statement rows (used for the static merchant side)."""
    from ledgerlens.operators.categorise import lookup_codes
    from ledgerlens.operators.clean import clean_first

    codes = classify_codes(testdata.fixture_codes(spark))
    batch = lookup_codes(clean_first(testdata.event_statements(spark, sf_dir)), codes)
    return first_writer_categories(batch)


def stream_ingest(spark, sf_dir):
    """T1: the events file stream loaded into a fresh warehouse by the idempotent batch load."""
    from ledgerlens.operators.load import Warehouse
    from ledgerlens.session import staging_path
    from ledgerlens.streaming.ingest import ingest_stream

    wh = Warehouse(spark, staging_path(spark, "stream-warehouse"))
    wh.initialise()
    wh.seed_codes(testdata.fixture_codes(spark))
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .option("maxFilesPerTrigger", 1).parquet(sf_dir))
    raw = testdata.events_to_statements(events).drop("event_time")
    q = ingest_stream(raw, wh, staging_path(spark, "stream-ingest-ckpt"))
    q.awaitTermination()
    # The category stored on each fact row at load time (its merchant's first-writer category).
    return wh.read("transactions").select("transaction_hash", "merchant", "category", _dbl("amount"))


def stream_dedup(spark, sf_dir):
    """T2: fingerprint de-duplication within a watermark over the events stream."""
    from ledgerlens.streaming.ingest import clean_event_stream, dedup_stream, run_available

    out = run_available(dedup_stream(clean_event_stream(spark, sf_dir)), spark, "stream-dedup")
    return out.select("transaction_hash", "transaction_date", _dbl("amount"), "description")


def stream_monthly(spark, sf_dir):
    """T3: running spend per month and category over the de-duplicated events stream."""
    from ledgerlens.streaming.ingest import clean_event_stream, dedup_stream, monthly_spend_stream, run_available

    # The static side lacks the merchants first seen in the stream, which take their own row's category.
    known = _event_batch_star(spark, sf_dir).where("crc32(merchant) % 2 = 0")
    codes = classify_codes(testdata.fixture_codes(spark))
    stream = monthly_spend_stream(dedup_stream(clean_event_stream(spark, sf_dir)), known, codes)
    out = run_available(stream, spark, "stream-monthly", mode="complete")
    return out.select("month", "category", _dbl("spent"), "txns")


def stream_spend_ledger(spark, sf_dir):
    """T3 by the loader's rule: running spend whose categories are fixed by first rows of the stream."""
    from ledgerlens.session import staging_path
    from ledgerlens.streaming.ingest import clean_event_stream
    from ledgerlens.streaming.spend import SpendLedger

    codes = classify_codes(testdata.fixture_codes(spark))
    ledger = SpendLedger(spark, staging_path(spark, "spend-ledger"), codes)
    ledger.start(clean_event_stream(spark, sf_dir)).awaitTermination()
    return ledger.spend().select("month", "category", _dbl("spent"), "txns")


def stream_daily(spark, sf_dir):
    """T3 in append form: spend of the days that the watermark has closed."""
    from ledgerlens.streaming.ingest import clean_event_stream, run_available
    from ledgerlens.streaming.spend import by_category, daily_spend_stream

    days = run_available(daily_spend_stream(clean_event_stream(spark, sf_dir)), spark, "stream-daily")
    return by_category(days, _event_batch_star(spark, sf_dir)).select("day", "category", _dbl("spent"), "txns")


# -- sources and warehouse ----------------------------------------------------------------------

def search_log_regex(spark, sf_dir):
    state = views.FilterState(show_income=True)
    return views.display_log(views.search(views.full_view(build_star(spark, sf_dir).view, state), SEARCH_REGEX, regex=True))


def rule_table_match(spark, sf_dir):
    """The keyword rules as a table, joined to all distinct descriptions."""
    from ledgerlens.functions.rules import match_with_rule_table, rule_table

    texts = build_star(spark, sf_dir).clean.groupBy("description").agg(F.count("*").alias("n")).withColumn("lowered", F.lower("description"))
    out = match_with_rule_table(texts, "lowered", rule_table(spark, MERCHANT_KEYWORDS), "keyword_category")
    return out.select("description", "keyword_category", "n")


def _statement_files(spark, sf_dir) -> str:
    """The raw batch as CSV files of two layouts: other column order, and no code column for the
    rows without a code."""
    from ledgerlens.session import staging_path

    raw = testdata.raw_statements(spark, sf_dir).drop("account_id", "seq")
    root = staging_path(spark, "statement-files")
    uncoded = F.col("Transaction Code") == ""
    names = ["Deposit Amount", "Description", "Transaction Date", "Withdrawal Amount"]
    raw.where(~uncoded).write.option("header", True).option("escape", '"').csv(f"{root}/coded")
    raw.where(uncoded).select(*names).write.option("header", True).option("escape", '"').csv(f"{root}/uncoded")
    return root


def statement_files(spark, sf_dir):
    """Statement CSV files of two layouts, read back by header names and cleaned."""
    from ledgerlens.operators.clean import clean_statements
    from ledgerlens.sources.statements import read_statements

    root = _statement_files(spark, sf_dir)
    clean = clean_statements(read_statements(spark, [f"{root}/coded", f"{root}/uncoded"], with_order=False))
    return clean.select("transaction_date", "year_month", _dbl("amount"), "description", "transaction_code", "merchant_name", "transaction_hash")


def bank_layouts(spark, sf_dir):
    """Statement files of three banks in one folder, read into the default columns and cleaned."""
    from ledgerlens.functions.dates import parse_mixed_date
    from ledgerlens.operators.clean import clean_statements
    from ledgerlens.session import staging_path
    from ledgerlens.sources.layouts import MARKER_LAYOUT, SIGNED_LAYOUT
    from ledgerlens.sources.statements import read_layouts

    raw = testdata.raw_statements(spark, sf_dir).drop("seq")
    root = staging_path(spark, "bank-layouts")
    out, into, code = F.col("Withdrawal Amount"), F.col("Deposit Amount"), F.col("Transaction Code")
    own = F.when(code == "", "marker").when(F.col("account_id") % 2 == 0, "signed").otherwise("columns")
    date = F.col("Transaction Date")
    turned = F.when(out.startswith("-"), F.substring(out, 2, 1 << 20)).otherwise(F.concat(F.lit("-"), out))
    signed, marked = SIGNED_LAYOUT.columns, MARKER_LAYOUT.columns
    tables = {
        "columns": [F.col(c) for c in raw.columns if c != "account_id"],
        "signed": [code.alias(signed["code"]), date.alias(signed["date"]), F.col("Description").alias(signed["description"]),
                   F.when(out == "", into).otherwise(turned).alias(signed["amount"])],
        # This bank writes the month first; dates that cannot be read stay as they are.
        "marker": [F.coalesce(F.date_format(parse_mixed_date(date), "MM/dd/yyyy"), date).alias(marked["date"]),
                   F.col("Description").alias(marked["description"]),
                   F.when(out == "", "CR").otherwise("DR").alias(marked["marker"]),
                   F.when(out == "", into).otherwise(out).alias(marked["amount"])],
    }
    for name, columns in tables.items():
        raw.where(own == name).select(*columns).write.option("header", True).option("escape", '"').csv(f"{root}/{name}")
    clean = clean_statements(read_layouts(spark, [f"{root}/{name}" for name in tables], with_order=False))
    return clean.select("transaction_date", "year_month", _dbl("amount"), "description", "transaction_code", "merchant_name", "transaction_hash")


def code_list_file(spark, sf_dir):
    """A code list written as text from the documents, read back and seeded into a warehouse."""
    from ledgerlens.operators.load import Warehouse
    from ledgerlens.session import staging_path

    codes = testdata.document_descriptions(spark, sf_dir)
    path = staging_path(spark, "code-list")
    one_line = F.btrim(F.regexp_replace("description", r"[^!-~]+", " "))
    codes.where(F.length(one_line) > 0).select(F.concat_ws("\n", "code", one_line).alias("value")).write.text(path)
    wh = Warehouse(spark, staging_path(spark, "code-warehouse"))
    wh.initialise()
    wh.seed_codes_from_file(path)
    return wh.read("codes").select("code", "category")


def _loaded_warehouse(spark, sf_dir):
    from ledgerlens.operators.load import Warehouse
    from ledgerlens.session import staging_path

    wh = Warehouse(spark, staging_path(spark, "warehouse"))
    wh.initialise()
    wh.seed_codes(testdata.fixture_codes(spark))
    raw = testdata.raw_statements(spark, sf_dir)
    return wh, [wh.load_statements(raw), wh.load_statements(raw)]


def warehouse_view(spark, sf_dir):
    """The stored star after loading the same batch twice."""
    wh, _ = _loaded_warehouse(spark, sf_dir)
    return _view_out(wh.view())


def warehouse_reports(spark, sf_dir):
    """Counters of the first load, of a repeat, and of a load after a full reset; budgets are
    kept by the reset."""
    from dataclasses import asdict

    wh, reports = _loaded_warehouse(spark, sf_dir)
    wh.save_budgets(testdata.fixture_budgets(spark))
    wh.reset()
    wh.seed_codes(testdata.fixture_codes(spark))
    reports.append(wh.load_statements(testdata.raw_statements(spark, sf_dir)))
    budgets = wh.read("budgets").count()
    rows = [[i + 1, *asdict(r).values(), budgets] for i, r in enumerate(reports)]
    names = ["load_no", *asdict(reports[0]), "budgets"]
    return literal_table(spark, rows, ", ".join(f"{n} long" for n in names))


def display_labels(spark, sf_dir):
    """Spend and share as the dashboard shows them."""
    shares = category_share(spark, sf_dir)
    return shares.select("category", money_label(F.col("spent")).alias("spent_label"), percent_label(F.col("share_pct")).alias("share_label"))


QUERIES.update({
    "search_log_regex": search_log_regex,
    "rule_table_match": rule_table_match,
    "statement_files": statement_files,
    "bank_layouts": bank_layouts,
    "code_list_file": code_list_file,
    "warehouse_view": warehouse_view,
    "warehouse_reports": warehouse_reports,
    "display_labels": display_labels,
    "stream_ingest": stream_ingest,
    "stream_dedup": stream_dedup,
    "stream_monthly": stream_monthly,
    "stream_spend_ledger": stream_spend_ledger,
    "stream_daily": stream_daily,
})


# -- beyond the dashboard: running totals, series, outliers, merchant groups, comparison --------------

def _expenses(spark, sf_dir):
    return views.expense_view(build_star(spark, sf_dir).view, DEFAULT_STATE)


def running_month_spend(spark, sf_dir):
    from ledgerlens.operators.running import running_month_spend

    out = running_month_spend(_expenses(spark, sf_dir))
    return out.select("month", "transaction_date", "transaction_hash", _dbl("spent"), _dbl("spent_so_far"))


def running_day_spend(spark, sf_dir):
    from ledgerlens.operators.running import running_day_spend

    out = running_day_spend(_expenses(spark, sf_dir))
    return out.select("month", "transaction_date", _dbl("spent"), _dbl("spent_so_far"))


def unusual_amounts(spark, sf_dir):
    from ledgerlens.operators.running import unusual_amounts

    out = unusual_amounts(build_star(spark, sf_dir).view, min_history=5, deviations=2.0)
    return out.select("transaction_hash", "merchant", "transaction_date", _dbl("amount"), "prior_count", "prior_mean", "prior_std", "unusual")


def recurring_payments(spark, sf_dir):
    from ledgerlens.operators.recurring import payment_series

    out = payment_series(_expenses(spark, sf_dir))
    return out.withColumn("spent", F.col("spent").cast("double"))


def merchant_groups(spark, sf_dir):
    """Every merchant of the batch and the group of near-identical names it belongs to."""
    from ledgerlens.operators.merchant_groups import merchant_groups

    return merchant_groups(build_star(spark, sf_dir).merchants)


def spend_by_merchant_group(spark, sf_dir):
    from ledgerlens.operators.merchant_groups import merchant_groups, spend_by_group

    star = build_star(spark, sf_dir)
    out = spend_by_group(views.expense_view(star.view, DEFAULT_STATE), merchant_groups(star.merchants))
    return out.withColumn("spent", F.col("spent").cast("double"))


def _two_statements(spark, sf_dir):
    """Two overlapping statements of the batch: the second lacks the year 1992 and has the
    amounts of some descriptions' rows raised by one."""
    clean = build_star(spark, sf_dir).clean.select("transaction_date", "description", "amount")
    raised = F.when(F.length("description") % 3 == 0, (F.col("amount") + 1).cast("decimal(28,2)")).otherwise(F.col("amount"))
    before = clean.where("year(transaction_date) < 1998")
    return before, clean.where("year(transaction_date) > 1992").withColumn("amount", raised)


def compare_statements(spark, sf_dir):
    from ledgerlens.operators.compare import compare_statements

    out = compare_statements(*_two_statements(spark, sf_dir))
    return out.select("transaction_date", "description", "change", _dbl("amount_before"), _dbl("amount_after"), "n")


def compare_categories(spark, sf_dir):
    """Spend per category of 1996 beside 1997."""
    from ledgerlens.operators.compare import compare_categories

    view = build_star(spark, sf_dir).view
    out = compare_categories(view.where("month like '1996-%'"), view.where("month like '1997-%'"))
    return out.select("category", _dbl("spent_before"), _dbl("spent_after"), _dbl("change"))


QUERIES.update({
    "running_month_spend": running_month_spend,
    "running_day_spend": running_day_spend,
    "unusual_amounts": unusual_amounts,
    "recurring_payments": recurring_payments,
    "merchant_groups": merchant_groups,
    "spend_by_merchant_group": spend_by_merchant_group,
    "compare_statements": compare_statements,
    "compare_categories": compare_categories,
})


def manual_override(spark, sf_dir):
    """The stored view after a load, overrides, a full reset, a reload and a fold."""
    from ledgerlens.operators.load import Warehouse
    from ledgerlens.session import staging_path

    wh = Warehouse(spark, staging_path(spark, "override-warehouse"))
    wh.initialise()
    wh.seed_codes(testdata.fixture_codes(spark))
    wh.load_statements(testdata.raw_statements(spark, sf_dir))
    chosen = wh.read("merchants").where("merchant like 'N%'").select("merchant", F.lit("Side Business").alias("category"))
    wh.set_overrides(chosen)
    wh.reset()
    wh.seed_codes(testdata.fixture_codes(spark))
    wh.load_statements(testdata.raw_statements(spark, sf_dir))
    wh.fold_overrides()
    return wh.view().select("transaction_hash", "merchant", "category", "month", _dbl("amount"))


def export_log(spark, sf_dir):
    """The filtered transaction log written as CSV files and read back."""
    from ledgerlens.session import staging_path

    path = staging_path(spark, "export")
    views.export_csv(views.full_view(build_star(spark, sf_dir).view, SELECTED_STATE), path)
    return views.read_exported(spark, path)


QUERIES.update({"manual_override": manual_override, "export_log": export_log})
