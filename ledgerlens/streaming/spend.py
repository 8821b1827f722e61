"""Running spend over a stream of cleaned statement rows, by the loader's rules (T3).

* :class:`SpendLedger`: spend per (month, category) where, as in a batch load, the first row ever
  seen of a merchant fixes its category and a stored fingerprint is never counted again.
* :func:`daily_spend_stream`: spend per (day, merchant) in append mode; a day is emitted once, when
  the watermark has passed its end, and its state is dropped then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.operators.categorise import lookup_codes
from ledgerlens.operators.clean import dedup_first
from ledgerlens.operators.dimension import first_writer_categories
from ledgerlens.session import drop_staged, staging_path
from ledgerlens.streaming.ingest import dedup_stream


class SpendLedger:
    """State of a running-spend stream under ``root``: three tables with one folder per micro-batch.

    ``merchants`` (merchant, category) new in the micro-batch, ``seen`` (year_month,
    transaction_hash) its new fingerprints, ``spend`` its sums. A micro-batch reads the folders of
    earlier ones only and overwrites its own, so a replay after a failure gives the same folders. The
    state belongs to one checkpoint, which is kept beside it.

    Within a micro-batch the row with the lowest ``seq`` is first; between them the earlier
    micro-batch is. A late row counts in the month of its own date and leaves its merchant's category
    alone. No key is held by one task: first rows and sums combine before the shuffle, and the merchants
    are joined by a plain equi-join that AQE may split.
    """

    SCHEMAS = {
        "merchants": "merchant string, category string",
        "seen": "year_month string, transaction_hash string",
        "spend": "month string, category string, amount decimal(38,2), txns bigint",
    }

    def __init__(self, spark: SparkSession, root: str, codes: DataFrame):
        self.spark, self.root, self.codes = spark, root.rstrip("/"), codes
        for table, schema in self.SCHEMAS.items():
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.root}/{table}/epoch=-1")

    def read(self, table: str, before: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{self.SCHEMAS[table]}, epoch bigint").parquet(f"{self.root}/{table}")
        return (rows if before is None else rows.where(F.col("epoch") < before)).drop("epoch")

    def _store(self, df: DataFrame, table: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/epoch={epoch}")

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """Fold one micro-batch of cleaned rows (with ``seq``) into the state."""
        path = staging_path(self.spark, "spend-batch")
        lookup_codes(batch, self.codes).write.parquet(path)
        rows = dedup_first(self.spark.read.parquet(path))
        # Copies of stored rows may still bring a new merchant in a batch load; they do here as well.
        self._store(first_writer_categories(rows, existing=self.read("merchants", epoch)), "merchants", epoch)
        months = [r[0] for r in rows.select("year_month").distinct().collect()]  # one value a calendar month
        seen = self.read("seen", epoch).where(F.col("year_month").isin(months))
        new = rows.join(seen, ["year_month", "transaction_hash"], "left_anti")
        fingerprints = new.select("year_month", "transaction_hash")
        # Sorted by month, so that the months of a later micro-batch skip the other row groups.
        self._store(fingerprints.sortWithinPartitions("year_month"), "seen", epoch)
        spent = new.where("amount < 0").withColumnRenamed("merchant_name", "merchant")
        known = self.read("merchants", epoch + 1)
        sums = (spent.join(known, "merchant").groupBy(F.col("year_month").alias("month"), "category")
                .agg(F.sum("amount").cast("decimal(38,2)").alias("amount"), F.count("*").alias("txns")))
        self._store(sums, "spend", epoch)
        drop_staged(self.spark, path)

    def start(self, clean_stream: DataFrame, available_now: bool = True) -> StreamingQuery:
        writer = clean_stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.root}/checkpoint")
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
        return writer.start()

    def spend(self) -> DataFrame:
        """Spend so far per (month, category): the sum of the micro-batches' sums."""
        return self.read("spend").groupBy("month", "category").agg(
            F.abs(F.sum("amount")).alias("spent"), F.sum("txns").alias("txns"))


def daily_spend_stream(clean_stream: DataFrame, event_time: str = "event_time", horizon: str = "2 days") -> DataFrame:
    """Spend per (day, merchant) of the expense rows, for append mode. A day is emitted when an event
    ``horizon`` or more after its end has been seen. Rows of an emitted day are late and dropped; the
    idempotent load (T1) still stores them."""
    rows = dedup_stream(clean_stream, event_time, horizon).where("amount < 0")
    days = rows.groupBy(F.window(event_time, "1 day"), "merchant_name").agg(
        F.sum(-F.col("amount")).alias("spent"), F.count("*").alias("txns"))
    return days.select(F.col("window.start").cast("date").alias("day"), F.col("merchant_name").alias("merchant"), "spent", "txns")


def by_category(days: DataFrame, merchants: DataFrame) -> DataFrame:
    """Closed days per category, each merchant with the category its first row fixed."""
    return days.join(merchants, "merchant").groupBy("day", "category").agg(
        F.sum("spent").alias("spent"), F.sum("txns").alias("txns"))
