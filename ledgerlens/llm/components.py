"""Connected components of an edge table, on Spark (alternating large-star / small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stage


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 30)).alias("s")).first()
    return r["n"], r["s"]


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges`` (u long, v long, any direction, repeats and loops allowed)
    with the smallest node of its component: returns (node, label), one row per node that has
    an edge to another node. Nulls are dropped. No edges: an empty result.

    Each round is two aggregations and two joins on the edge table; the neighbour minimum is a
    partial aggregate, so a hub is pre-aggregated before the shuffle, and the join on a hub can
    be split by the skew-join rule. Rounds grow with the logarithm of the component size. Each
    round's edges are written to the checkpoint folder, which also cuts the lineage; only a
    count and a checksum reach the driver."""
    cur = stage(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(),
        "edges",
    )
    state = _state(cur)
    while state[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        cur = stage(small, "edges")
        new = _state(cur)
        if new == state:
            break
        state = new
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
