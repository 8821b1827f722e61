"""Scan parallelism guard."""

from __future__ import annotations

from pyspark.sql import DataFrame


def ensure_parallelism(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan over at least ``min_partitions`` tasks (default: the cluster's default
    parallelism) when the files yield fewer splits, e.g. one large file with a single row
    group. The heavy per-row work (regular expressions, hashing) that follows then runs on all
    cores. Inputs that are already split finely enough (the normal case for large data) are
    returned unchanged, so no shuffle is added there.
    """
    try:
        want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session has no RDD view; keep the scan as is
        return df
    return df if have >= want else df.repartition(want)
