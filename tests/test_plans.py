"""Plan-shape checks for the properties the design relies on at scale."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlens.operators.clean import dedup_first
from ledgerlens.operators.dimension import first_writer_categories
from ledgerlens.operators.categorise import lookup_codes
from ledgerlens.plans import catalog
from ledgerlens.plans.star import build_star


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_star_plans_have_no_window_cross_or_nested_loop_join(spark):
    for name in ["full_view", "spend_by_category", "incremental_load", "kpis", "quality_ratios"]:
        plan = _plan(catalog.QUERIES[name](spark, SF_SMALL))
        for bad in ("Window", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in plan, (name, bad)


def test_dedup_and_merchants_aggregate_map_side(spark):
    s = build_star(spark, SF_SMALL)
    batch = dedup_first(lookup_codes(s.clean, s.codes))
    plan = batch._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan  # combined before the shuffle on the fingerprint
    m = first_writer_categories(s.batch)
    assert "partial_min_by" in m._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(catalog.QUERIES["code_classification"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = _plan(catalog.QUERIES["spend_by_category"](spark, SF_SMALL))
    assert "l_quantity" not in plan and "l_comment" not in plan


def test_hot_fingerprint_and_hot_merchant(spark):
    # One fingerprint repeated on a third of the rows, one merchant on two thirds: results stay
    # whole (one row per fingerprint, every other row kept) and exact.
    n = 3000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-01")).otherwise(
            F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 300).cast("int")), "yyyy-MM-dd")
        ).alias("Transaction Date"),
        F.when(F.col("id") % 3 == 0, F.lit("GRAB* A1 SI SGP 01JAN 1")).otherwise(
            F.when(F.col("id") % 3 == 1, F.lit("GRAB* B2")).otherwise(F.concat(F.lit("SHOP "), F.col("id").cast("string")))
        ).alias("Description"),
        F.when(F.col("id") % 3 == 0, F.lit("10.00")).otherwise(F.format_string("%d.00", F.col("id"))).alias("Withdrawal Amount"),
        F.lit("").alias("Deposit Amount"),
        F.lit("POS").alias("Transaction Code"),
        F.struct(F.col("id").alias("row")).alias("seq"),
    )
    s = build_star(spark, SF_SMALL, raw=rows)
    tx = s.transactions
    # hot fingerprint collapses to one row; the other 2000 rows are distinct
    assert tx.count() == 1 + 2000
    grab = s.merchants.filter("merchant = 'GRAB'").first()
    assert grab.category == "Transport"


def test_month_filter_prunes_stored_partitions(spark, workdir):
    import os

    from conftest import fixture_path
    from ledgerlens.operators.load import Warehouse
    from ledgerlens.operators.views import FilterState, month_scoped
    from ledgerlens.sources import read_statements

    wh = Warehouse(spark, os.path.join(workdir, "wh"))
    wh.initialise()
    wh.load_statements(read_statements(spark, fixture_path("statement.csv")))
    df = month_scoped(wh.view(), FilterState(["2024-01"]))
    assert df.count() == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year_month" in plan and "2024-01" in plan


def test_parse_is_not_copied_into_the_row_filter(spark):
    s = build_star(spark, SF_SMALL)
    plan = s.clean._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter" in line and "CollectMetrics" not in line]
    assert filters and not any("gettimestamp" in f for f in filters)


def test_star_view_scans_the_input_once(spark):
    s = build_star(spark, SF_SMALL)
    plan = _plan(s.view)
    # the view reads the staged batch (written once), not lineitem again per branch
    assert "lineitem" not in plan
    assert plan.count("FileScan parquet") >= 2 and "star-batch" in plan


def test_first_rows_carry_the_order_once_and_nothing_derived(spark):
    """The dedup shuffle holds no merchant, month or fingerprint; the first row of each fingerprint wins."""
    from ledgerlens.operators.clean import clean_first, first_rows, typed_rows

    rows = [("01/02/2025", "GRAB* FOOD", "5.00", "", "POS", (2, 1)), ("2025-02-01", " grab* food ", "5", "", "MST", (1, 9)),
            ("2025-02-01", "GRAB* FOOD", "6.00", "", "", (0, 0))]
    names = ["Transaction Date", "Description", "Withdrawal Amount", "Deposit Amount", "Transaction Code"]
    raw = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names) + ", seq struct<a int, b int> not null")
    kept = first_rows(typed_rows(raw))
    assert not {"merchant_name", "year_month", "transaction_hash"} & set(kept.columns)
    assert sorted((str(r.amount), r.transaction_code, tuple(r.seq)) for r in kept.collect()) == [("-5.00", "MST", (1, 9)), ("-6.00", None, (0, 0))]
    old = dedup_first(clean_first(raw))
    assert sorted(map(str, old.collect())) == sorted(map(str, clean_first(raw).collect()))


def test_repeat_and_first_loads_join_no_whole_rows(spark):
    """A batch that is stored as a whole, or not at all, is answered without a join of its rows."""
    from ledgerlens.operators.load import new_transactions

    facts = spark.sql("""select sha2(string(id), 256) transaction_hash, date'2025-01-01' transaction_date, '2025-01' year_month,
        cast(id as decimal(28,2)) amount, 'D' description, 'M' merchant_name, 'POS' transaction_code from range(9)""")
    plans = {}
    for name, old in (("all", facts), ("none", facts.where("false")), ("other", facts.select("year_month", facts.amount.cast("string").alias("transaction_hash"))),
                      ("some", facts.where("amount < 4"))):
        new = new_transactions(facts, old)
        plans[name] = (new.count(), "Join" in new._jdf.queryExecution().optimizedPlan().toString())
    assert plans == {"all": (0, False), "none": (9, False), "other": (9, False), "some": (5, True)}
