"""Code-list text file scan: a header, then alternating CODE / DESCRIPTION lines.

The pairing needs the position of every non-blank line inside its file. Instead of reading a
file as one value (which would put a whole file through one task), lines are numbered
per file split and the splits' line counts are summed in order: the only global step is a
window over one row per split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens import defaults as D
from ledgerlens.functions.text import ustrip


def number_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, pos, line): stripped non-blank lines with their 0-based position in the file."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("rid"),
        ustrip(F.col("value")).alias("line"),
    )
    kept = raw.filter(F.col("line") != "")
    # Inside one split the row ids are increasing in file order; rank them within the split.
    in_split = Window.partitionBy("file", "block").orderBy("rid")
    kept = kept.withColumn("k", F.row_number().over(in_split) - 1)
    # Lines before each split = running sum of the earlier splits' counts (one row per split).
    per_split = kept.groupBy("file", "block").agg(F.count("*").alias("n"))
    offsets = per_split.withColumn(
        "offset",
        F.coalesce(
            F.sum("n").over(
                Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    ).drop("n")
    return kept.join(offsets, ["file", "block"]).select(
        "file", (F.col("offset") + F.col("k")).alias("pos"), "line"
    )


def read_code_list(spark: SparkSession, path: str | list[str], split_alternatives: bool = False) -> DataFrame:
    """(code, description) pairs. Optional header lines are skipped, an unpaired last line is
    ignored, a repeated code keeps its last description, and codes are upper-cased (the first
    spelling of a code wins when two differ only in case).

    Entries such as ``DCR / DCRT`` are one key by default (so neither ``DCR`` nor ``DCRT``
    matches a statement code); ``split_alternatives=True`` stores each alternative instead."""
    lines = number_lines(spark, path)
    first = lines.filter(F.col("pos") <= 1).groupBy("file").agg(
        F.max(F.when(F.col("pos") == 0, F.col("line"))).alias("l0"),
        F.max(F.when(F.col("pos") == 1, F.col("line"))).alias("l1"),
    )
    h1 = F.lower(F.col("l0")).startswith(D.CODE_LIST_HEADER_PREFIX)
    second = F.when(h1, F.col("l1")).otherwise(F.col("l0"))
    h2 = F.lower(second) == D.CODE_LIST_SECOND_HEADER
    skip = first.select(
        "file",
        (F.when(h1, 1).otherwise(0) + F.when(F.coalesce(h2, F.lit(False)), 1).otherwise(0)).alias("skip"),
    )
    from ledgerlens.operators.joins import broadcast_if_small

    # One row per input file.
    body = lines.join(broadcast_if_small(skip), "file").filter(F.col("pos") >= F.col("skip"))
    body = body.withColumn("i", F.col("pos") - F.col("skip"))
    pairs = body.groupBy("file", F.floor(F.col("i") / 2).alias("pair")).agg(
        F.max(F.when(F.col("i") % 2 == 0, F.col("line"))).alias("code"),
        F.max(F.when(F.col("i") % 2 == 1, F.col("line"))).alias("description"),
    ).filter(F.col("description").isNotNull())
    if split_alternatives:
        pairs = pairs.withColumn("code", F.explode(F.split(F.col("code"), r"\s*/\s*"))).filter(F.col("code") != "")
    order = F.struct("file", "pair")
    # Last description per exact code, then first spelling per upper-cased code.
    per_code = pairs.groupBy("code").agg(
        F.max_by("description", order).alias("description"), F.min(order).alias("first_seen")
    )
    return per_code.groupBy(F.upper("code").alias("code")).agg(
        F.min_by("description", "first_seen").alias("description")
    )
