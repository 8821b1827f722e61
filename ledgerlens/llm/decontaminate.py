"""Benchmark decontamination by winnowing.

Words are lower-cased (A-Z) runs of ASCII letters, digits and characters beyond ASCII. For each
text the smallest hash of every 6 consecutive 5-word grams is kept (winnowing), so any shared
span of at least 10 words shares a kept fingerprint. Document fingerprints are joined with the
benchmark's: first by a Bloom filter of fixed size in the scan, then each hit is extended to
every 10-word window around it, and these windows are joined exactly with the windows of the
benchmark items. Items of fewer than 10 words are one window of their own length; no winnowed
fingerprint is guaranteed for those, so all grams of these (at most nine) lengths are looked up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlens.llm.common import LOWER, bounded_batches, gram_hashes, mix, stage, text_bytes, text_key, word_hashes, word_table
from ledgerlens.operators.joins import broadcast_if_small

#: Bits of the fingerprint filter (8 MB); a larger benchmark only makes it let more through.
FILTER_BITS = 1 << 26
_PROBES = 3
_U = np.uint64


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash (the rightmost of equals) of every w consecutive grams."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, low = np.full(n, w - 1), grams[w - 1 :].copy()
    for i in range(w - 2, -1, -1):
        g = grams[i : i + n]
        less = g < low
        low = np.where(less, g, low)
        best[less] = i
    return np.unique(best + np.arange(n))


def filter_bits(h: np.ndarray) -> list[np.ndarray]:
    """The filter's bit numbers of each hash."""
    return [mix(h + _U(977 * (i + 1))) & _U(FILTER_BITS - 1) for i in range(_PROBES)]


class Filter:
    """Bloom filter over hashes, as 64-bit cells."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for b in filter_bits(h):
            out &= (self.bits[(b >> _U(6)).astype(np.int64)] >> (b & _U(63))) & _U(1) == 1
        return out


def _words(data: bytes | None, table: np.ndarray) -> np.ndarray:
    return word_hashes(data.translate(LOWER), table) if data else np.zeros(0, dtype=np.uint64)


def _bench(window: int, k: int):
    table = word_table("alnum")

    def run(batches):
        for b in batches:
            ids, lens, hs, fps = [], [], [], []
            for item, data in zip(b.column("item_id").to_pylist(), text_bytes(b.column("text")), strict=True):
                words = _words(data, table)
                if not len(words):
                    continue
                n = min(window, len(words))
                h = np.unique(gram_hashes(words, n))
                if n < window:
                    f = h
                else:
                    grams = gram_hashes(words, k)
                    f = np.unique(grams[winnow(grams, window - k + 1)])
                for x, kind in ((h, 0), (f, 1)):
                    ids += [item] * len(x)
                    lens += [n] * len(x)
                    hs.append(x.view(np.int64))
                    fps += [kind] * len(x)
            if hs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array(lens, pa.int32()), pa.array(np.concatenate(hs)), pa.array(fps, pa.int32())],
                    names=["item_id", "len", "h", "kind"],
                )

    return run


def _cells():
    def run(batches):
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            bit = np.concatenate(filter_bits(h)) if len(h) else h
            yield pa.RecordBatch.from_arrays(
                [pa.array((bit >> _U(6)).astype(np.int64)), pa.array((_U(1) << (bit & _U(63))).view(np.int64))], names=["cell", "bits"]
            )

    return run


_CANDIDATES = pa.list_(pa.struct([("s", pa.int32()), ("len", pa.int32()), ("h", pa.int64())]))


def _scan(window: int, k: int, shared, short: list[int]):
    table = word_table("alnum")

    def candidates(words: np.ndarray, known: Filter) -> list[dict]:
        out = []
        if len(words) >= window:
            grams = gram_hashes(words, k)
            at = winnow(grams, window - k + 1)
            at = at[known.has(grams[at])]
            if len(at):  # extend each hit to the windows that hold its gram
                s = np.unique((at[:, None] - np.arange(window - k + 1)).ravel())
                s = s[(s >= 0) & (s <= len(words) - window)]
                h = gram_hashes(words, window)[s].view(np.int64)
                out += [{"s": int(a), "len": window, "h": int(b)} for a, b in zip(s, h, strict=True)]
        for n in short:
            h = gram_hashes(words, n)
            at = np.flatnonzero(known.has(h))
            out += [{"s": int(a), "len": n, "h": int(b)} for a, b in zip(at, h[at].view(np.int64), strict=True)]
        return out

    def run(batches):
        known = Filter(shared.value)
        for b in batches:
            n, wins = [], []
            for data in text_bytes(b.column("text")):
                words = _words(data, table)
                n.append(len(words))
                wins.append(candidates(words, known))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(wins, _CANDIDATES)], names=["doc_id", "th", "n_words", "wins"]
            )

    return run


def benchmark_overlaps(docs: DataFrame, bench: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """Where documents repeat windows of ``window`` consecutive words of benchmark items.

    Needs doc_id and text, and item_id and text; other columns are ignored. Returns one row per
    input row: doc_id, text_hash, n_words, n_hit (words inside any occurrence of a window),
    items (sorted item ids as strings whose windows occur; null if none), spans (merged word
    spans, start and end exclusive; null if none).

    Defined cases: null and wordless texts have no words and no hits; items without words are
    ignored; an item without an id counts for hits but not in items; repeated rows each get a
    row; repeated items count once; empty tables give an empty or a hitless result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = bench.select(F.col("item_id").cast("string").alias("item_id"), "text")
    marks = stage(items.mapInArrow(_bench(window, k), "item_id string, len int, h long, kind int"), "bench")
    cells = marks.where("kind = 1").select("h").distinct().mapInArrow(_cells(), "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    got = cells.toPandas()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    bits[got["cell"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    known = spark.sparkContext.broadcast(bits)
    short = sorted(r["len"] for r in marks.where(F.col("len") < window).select("len").distinct().collect())

    base = docs.select("doc_id", "text").withColumn("th", text_key())
    scanned = base.mapInArrow(_scan(window, k, known, short), f"{_id_type(docs)}, th long, n_words long, wins array<struct<s:int,len:int,h:long>>")
    scanned = stage(scanned, "scan")
    found = scanned.where(F.size("wins") > 0).select("th", "n_words", F.inline("wins")).distinct()
    targets = broadcast_if_small(marks.where("kind = 0").select("h", "len", "item_id").distinct())
    hits = stage(found.join(targets, ["h", "len"]).select("th", "n_words", "s", (F.col("s") + F.col("len")).alias("e"), "item_id"), "hits")

    w = Window.partitionBy("th", "n_words").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = (
        hits.groupBy("th", "n_words", "s")
        .agg(F.max("e").alias("e"))
        .withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1))
        .withColumn("span", F.sum("new").over(w))
        .groupBy("th", "n_words", "span")
        .agg(F.min("s").alias("start"), F.max("e").alias("end"))
        .groupBy("th", "n_words")
        .agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    )
    which = hits.where("item_id is not null").groupBy("th", "n_words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    plain = scanned.where(F.size("wins") == 0)
    met = scanned.where(F.size("wins") > 0).select("doc_id", "th", "n_words").join(spans, ["th", "n_words"], "left").join(which, ["th", "n_words"], "left")
    met = met.select("doc_id", F.col("th").alias("text_hash"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "items", "spans")
    none = [F.lit(0).cast("long").alias("n_hit"), *(F.lit(None).cast(met.schema[c].dataType).alias(c) for c in ("items", "spans"))]
    return met.unionByName(plain.select("doc_id", F.col("th").alias("text_hash"), "n_words", *none))


def _id_type(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def without_overlaps(docs: DataFrame, bench: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The rows of ``docs`` without any window of a benchmark item (whole documents go, whatever
    the share of hit words). Same cases as :func:`benchmark_overlaps`."""
    bad = benchmark_overlaps(docs, bench, window, k).where("n_hit > 0").select(F.col("text_hash").alias("__bad_text")).distinct()
    return docs.join(broadcast_if_small(bad), text_key() == F.col("__bad_text"), "left_anti")
