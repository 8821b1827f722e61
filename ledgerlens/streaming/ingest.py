"""Structured Streaming forms of the statement load.

* :func:`ingest_stream` (T1): every micro-batch of raw statement rows goes through the same
  idempotent warehouse load as a batch file (``foreachBatch``). The sink is at-least-once, and a
  replayed micro-batch inserts nothing because the load anti-joins on the fingerprint.
* :func:`dedup_stream` (T2): bounded-state de-duplication on the fingerprint within a lateness
  horizon (``dropDuplicatesWithinWatermark``). Weaker than T1: a repeat that arrives after the
  watermark has passed is emitted again.
* :func:`monthly_spend_stream` (T3): running spend per (month, category), the category taken
  from the merchant dimension (stream-static join) or, for a new merchant, from its own row,
  in complete mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.defaults import MERCHANT_KEYWORDS
from ledgerlens.functions.rules import first_match_array
from ledgerlens.operators.categorise import CODE_CATEGORY, cascade_with_keyword, lookup_codes
from ledgerlens.operators.clean import clean_statements
from ledgerlens.operators.load import Warehouse
from ledgerlens.session import staging_path


def ingest_stream(raw_stream: DataFrame, warehouse: Warehouse, checkpoint: str,
                  available_now: bool = True) -> StreamingQuery:
    """Start loading a stream of raw statement rows into ``warehouse`` (T1). Rows need a
    ``seq`` column (file order) for first-row-wins; the warehouse load stages each batch."""

    def load(batch: DataFrame, epoch_id: int) -> None:
        if "seq" not in batch.columns:
            batch = batch.withColumn("seq", F.struct(F.lit(epoch_id).alias("epoch"),
                                                     F.monotonically_increasing_id().alias("row")))
        warehouse.load_statements(batch)

    writer = raw_stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def dedup_stream(clean_stream: DataFrame, event_time: str = "event_time", horizon: str = "2 days") -> DataFrame:
    """Drop repeated fingerprints that arrive within ``horizon`` of each other (T2)."""
    return clean_stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(["transaction_hash"])


def monthly_spend_stream(clean_stream: DataFrame, merchants: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Running spend per (month, category) of expense rows (T3). A merchant that is not in the
    dimension (one first seen in the stream) takes the category of its own row by the rule
    cascade, with ``codes`` as the code table if given; no row is lost."""
    known = merchants.select(F.col("merchant").alias("merchant_name"), "category")
    rows = clean_stream.filter(F.col("amount") < 0).withColumn("_lc", F.lower("description"))
    if codes is not None:
        rows = lookup_codes(rows, codes)
    else:
        rows = rows.withColumn(CODE_CATEGORY, F.lit(None).cast("string"))
    own = cascade_with_keyword(F.col("transaction_code"), F.col(CODE_CATEGORY), first_match_array(F.col("_lc"), MERCHANT_KEYWORDS), F.col("amount"))
    rows = rows.join(known, "merchant_name", "left").withColumn("category", F.coalesce("category", own))
    return rows.groupBy(F.col("year_month").alias("month"), "category").agg(
        F.abs(F.sum("amount")).alias("spent"), F.count("*").alias("txns"))


def epoch_writer(out: str, mode: str = "append"):
    """A ``foreachBatch`` function that stores micro-batches under ``out``; repeats are harmless."""

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/epoch={epoch_id}")

    return write


def run_available(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Run ``stream`` over all currently available input, store the result under the
    checkpoint folder and return it as a batch DataFrame. Complete-mode results are rewritten
    by every micro-batch (``foreachBatch``); in append mode each micro-batch overwrites a folder of
    its own, so a micro-batch that is replayed after a failure is not stored twice."""
    out = staging_path(spark, f"{name}-out")
    ckpt = staging_path(spark, f"{name}-ckpt")
    write = epoch_writer(out, mode)

    q = (stream.writeStream.outputMode(mode).foreachBatch(write)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out).drop("epoch")


def clean_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a file stream, shaped as statement rows and cleaned."""
    from ledgerlens.sources.testdata import events_to_statements

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .option("maxFilesPerTrigger", 1).parquet(sf_dir))
    return clean_statements(events_to_statements(events))
