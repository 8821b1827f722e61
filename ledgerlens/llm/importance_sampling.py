"""Quality selection by importance resampling.

Two bags of hashed n-grams (single words and word pairs) are counted: one over target texts, one
over all raw texts. A document's log importance weight is the sum over its n-grams of
log p_target - log p_raw. Adding Gumbel noise, fixed by the row's hash, and taking the k largest
keys samples k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import LOWER, bounded_batches, gram_hashes, stage, text_bytes, text_key, word_hashes, word_table
from ledgerlens.operators.joins import broadcast_if_small

#: Target texts that the queries learn from, at most.
TARGET_TEXTS = 20_000
#: Hash cells of the n-gram models, pseudo count of a cell, ranges of a selection round.
CELLS, PSEUDO, SPLIT = 1 << 16, 0.1, 4096
_SHIFT = np.uint64(48)


def cells_of(data: bytes | None, table: np.ndarray) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.int64)
    words = word_hashes(data.translate(LOWER), table)
    return (np.concatenate((words, gram_hashes(words, 2))) >> _SHIFT).astype(np.int64)


def _counts():
    table = word_table("blank")

    def run(batches):
        total = np.zeros((2, CELLS), dtype=np.int64)
        for b in batches:
            for good, data in zip(b.column("target").to_pylist(), text_bytes(b.column("text")), strict=True):
                n = np.bincount(cells_of(data, table), minlength=CELLS)
                total[0] += n
                if good:
                    total[1] += n
        kind, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[kind, cell])], names=["kind", "cell", "n"]
        )

    return run


def _weights(shared):
    table = word_table("blank")

    def run(batches):
        ratio = shared.value
        for b in batches:
            n, w = [], []
            for data in text_bytes(b.column("text")):
                c = cells_of(data, table)
                n.append(len(c))
                w.append(float(ratio[c].sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(w, pa.float64())], names=["doc_id", "th", "n_grams", "log_weight"]
            )

    return run


def log_ratio(marked: DataFrame) -> np.ndarray:
    """log p_target - log p_raw of every cell, from all rows of (text, target boolean). The
    driver receives at most 2 x CELLS numbers. Without target texts all ratios are 0."""
    got = marked.mapInArrow(_counts(), "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((2, CELLS), PSEUDO)
    counts[got["kind"].to_numpy(np.int64), got["cell"].to_numpy(np.int64)] += got["n"].to_numpy(np.float64)
    if counts[1].sum() <= CELLS * PSEUDO * 1.0000001:
        return np.zeros(CELLS)
    p = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    return p[1] - p[0]


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest value of the double column ``key`` (null rows ignored; None if k < 1 or
    there are fewer rows). Every round counts the rows in SPLIT equal ranges and goes on in the
    range that holds the k-th, until its values are all equal; only counts reach the driver."""
    live = keys.where("key is not null")
    s = live.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).first()
    if k < 1 or s["n"] < k:
        return None
    lo, hi = s["lo"], s["hi"]
    while lo < hi:
        width = (hi - lo) / SPLIT
        inside = live.where((F.col("key") >= lo) & (F.col("key") <= hi))
        at = F.least(F.floor((F.col("key") - lo) / width), F.lit(SPLIT - 1)) if width > 0 else F.lit(0)
        by = {r["at"]: r for r in inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for i in sorted(by, reverse=True):
            if k <= by[i]["n"]:
                lo, hi = by[i]["lo"], by[i]["hi"]
                break
            k -= by[i]["n"]
        if len(by) == 1 and width <= 0:
            break
        if by[i]["n"] == 1:
            break
    return hi


def gumbel(seed: int, *cols: str) -> Column:
    u = (F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def resample(docs: DataFrame, target: DataFrame, share: float, seed: int = 17) -> DataFrame:
    """Importance resampling of round(share x rows) documents. ``target`` has the doc_id of the
    target texts among ``docs`` (other columns ignored). Needs doc_id and text in ``docs``; other
    columns are ignored. Returns one row per input row: doc_id, n_grams, log_weight, sample_key,
    kept.

    Defined cases: null and wordless texts have log weight 0 and take part; rows with equal keys
    at the cut (rows equal in doc_id and text) are kept or left together; without target texts
    all weights are 0 and the sample is uniform; an empty table gives an empty result. Reruns
    with one seed agree."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ids = target.select(F.col("doc_id").alias("__target")).where("__target is not null").distinct()
    base = docs.select("doc_id", "text").withColumn("th", text_key())
    ids = broadcast_if_small(ids)
    marked = base.join(ids, base["doc_id"] == ids["__target"], "left").select("text", F.col("__target").isNotNull().alias("target"))
    ratio = spark.sparkContext.broadcast(log_ratio(marked))  # CELLS doubles
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = base.mapInArrow(_weights(ratio), f"doc_id {kind}, th long, n_grams long, log_weight double")
    scored = stage(scored.withColumn("sample_key", F.col("log_weight") + gumbel(seed, "doc_id", "th")), "resample")
    k = round(share * scored.count())
    cut = kth_largest(scored.select(F.col("sample_key").alias("key")), k)
    kept = F.lit(False) if cut is None else F.col("sample_key") >= cut
    return scored.select("doc_id", "n_grams", "log_weight", "sample_key", kept.alias("kept"))
