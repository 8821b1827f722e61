"""Statement CSV scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.sources.layouts import LAYOUTS, Layout, detect, to_default_columns
from ledgerlens.sources.parallelism import ensure_parallelism


def header_lines(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """Header line -> files that start with it (one row per file reaches the driver)."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "row").alias("header"))
    found: dict[str, list[str]] = {}
    for r in sorted(first.collect(), key=lambda r: r["file"]):
        found.setdefault((r["header"] or "").lstrip("\ufeff").rstrip("\r"), []).append(r["file"])
    return found


def read_statements(spark: SparkSession, path: str | list[str], with_order: bool = True, multi_line: bool = False) -> DataFrame:
    """Read statement CSV files (header row) with every column as text and blanks as "".

    Columns are matched by name: files are grouped by their header line, each group is read on
    its own, and the groups are combined by name (a column that a file lacks reads as blank).
    With ``with_order`` a ``seq`` struct (file, block offset, row id) records the file order of
    rows, which decides "first row wins" later on. The row id part is only stable within one
    evaluation, so persist or write the cleaned batch before using ``seq`` twice.

    ``multi_line``: quoted fields may hold line breaks (each file is then read by one task).
    Without it files are split at line ends, and a row with an unclosed quote, which such a
    field would leave, fails the query rather than losing the transaction.
    """
    parts = [_read_layout(spark, files, with_order, multi_line) for files in header_lines(spark, path).values()]
    if not parts:
        return spark.createDataFrame([], T.StructType([]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return ensure_parallelism(out.na.fill(""))


def read_layouts(spark: SparkSession, path: str | list[str], layouts: Sequence[Layout] = LAYOUTS,
                 with_order: bool = True, multi_line: bool = False) -> DataFrame:
    """Read statement CSV files of several banks into the default columns, all as text.

    Each file's layout is found from its first line (see ``layouts.detect``; the order of columns
    and further columns do not matter where there is a header), files of one header line are read
    together, and so are files without a header of one layout. A file of no known layout raises
    ``UnknownLayoutError`` before any row is read."""
    groups: dict[tuple, tuple[Layout, list[str]]] = {}
    for line, files in header_lines(spark, path).items():
        layout, has_header = detect(line, files[0], layouts)
        groups.setdefault((layout.name, line if has_header else None), (layout, []))[1].extend(files)
    parts = []
    for (_, line), (layout, files) in groups.items():
        names = None if line is not None else [layout.columns[p] for p in layout.order]
        parts.append(to_default_columns(_read_layout(spark, files, with_order, multi_line, names), layout))
    if not parts:
        return spark.createDataFrame([], T.StructType([]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return ensure_parallelism(out.na.fill(""))


def _read_layout(spark: SparkSession, files: list[str], with_order: bool, multi_line: bool,
                 names: list[str] | None = None) -> DataFrame:
    """Files of one header line, or files without one whose columns are ``names``."""
    reader = spark.read.option("header", names is None).option("escape", '"').option("multiLine", multi_line)
    if names is None:
        names = reader.option("inferSchema", False).csv(files[:1]).columns
    broken = "_broken_line"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, broken]])
    df = reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", broken).csv(files)
    quotes = F.length(broken) - F.length(F.replace(F.col(broken), F.lit('"'), F.lit("")))
    unclosed = F.col(broken).isNotNull() & (quotes % 2 == 1)
    message = F.concat(F.lit("unclosed quote, read this file with multi_line=True: "), F.col("_metadata.file_path"))
    columns = [F.col(f"`{c}`") for c in names]
    if not multi_line:
        columns[0] = F.when(unclosed, F.raise_error(message)).otherwise(columns[0]).alias(names[0])
    if with_order:
        columns.append(
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("seq")
        )
    return df.select(*columns)
