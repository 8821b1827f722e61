import os
import sys

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerlens.functions import money_label, percent_label
from ledgerlens.operators.audits import category_names
from ledgerlens.operators.load import seeded_categories
from ledgerlens.plans import catalog


def test_labels(spark):
    df = spark.createDataFrame([(1234.4, 12.345)], "v double, p double")
    r = df.select(money_label(F.col("v")).alias("m"), percent_label(F.col("p")).alias("p")).first()
    assert (r.m, r.p) == ("SGD 1,234", "12.3%")


def test_category_names_sorted(spark):
    names = [r.name for r in category_names(seeded_categories(spark)).collect()]
    assert names == sorted(names) and len(names) == 20


def test_streams_match_batch(spark):
    ingest = catalog.stream_ingest(spark, SF_SMALL)
    dedup = catalog.stream_dedup(spark, SF_SMALL)
    # The stream load and the stream dedup keep one row per fingerprint, like the batch dedup.
    assert ingest.count() == dedup.count() == dedup.select("transaction_hash").distinct().count()
    monthly = catalog.stream_monthly(spark, SF_SMALL)
    spent = monthly.agg(F.sum("spent")).first()[0]
    batch = dedup.filter("amount < 0").agg(F.sum(F.abs("amount"))).first()[0]
    assert round(spent, 2) == round(batch, 2)


def test_entry_smoke(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["category", "spent"] and df.count() > 0
    from ledgerlens.plans import catalog

    assert set(catalog.QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


def test_stream_replay_inserts_nothing(spark, workdir):
    import os

    from ledgerlens.operators.load import Warehouse
    from ledgerlens.sources.testdata import FIXTURE_CODES, events_to_statements
    from ledgerlens.streaming.ingest import ingest_stream

    wh = Warehouse(spark, os.path.join(workdir, "wh"))
    wh.initialise()
    wh.seed_codes(spark.createDataFrame(FIXTURE_CODES, "code string, description string"))
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema

    def run(ckpt):
        ev = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF_SMALL)
        ingest_stream(events_to_statements(ev).drop("event_time"), wh, os.path.join(workdir, ckpt)).awaitTermination()
        return wh.read("transactions").count()

    first = run("ckpt1")
    # A new checkpoint replays the whole source: the load skips every stored fingerprint.
    assert run("ckpt2") == first and first > 0


def test_shares_sum_to_hundred(spark):
    shares = catalog.category_share(spark, SF_SMALL).agg(F.sum("share_pct")).first()[0]
    assert abs(shares - 100.0) <= 0.05 * 20
