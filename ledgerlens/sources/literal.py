"""Small literal tables built inside the JVM (no Python worker, no driver-side RDD)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal_table(spark: SparkSession, rows: Sequence[Sequence], schema: str | T.StructType) -> DataFrame:
    """A DataFrame of ``rows`` as one inline array of structs: a single generated relation whose
    size is known when the plan is built."""
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    if not rows:
        return spark.createDataFrame([], st)
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, st.fields)]) for row in rows
    ]
    from ledgerlens.operators.joins import with_known_rows

    return with_known_rows(spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs))), len(rows))
