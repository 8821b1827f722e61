"""Helpers shared by the operators: staging, Arrow batch bounds, word hashing.

Word hashing works on UTF-8 bytes with numpy: a word's hash is a polynomial over random byte
values modulo 2**64, computed for all words of a text at once from prefix sums, then mixed.
Equal words always have equal hashes; two different words share one with probability about
2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import materialise

#: Python regex class body of the word separators used by most contracts (ASCII white space).
BLANKS = " \t\n\x0b\x0c\r"

_BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches handed to Python tasks by rows and bytes, so that a run of very
    long texts cannot fill a worker's memory (one text is always handed over whole)."""
    for k, v in _BATCH_CONF.items():
        spark.conf.set(k, v)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under ``spark.checkpoint.dir`` and return the stored copy."""
    return materialise(df, f"llm-{name}")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(text_col: str = "text"):
    """64-bit key of a text (null has a key of its own)."""
    return F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0).cast("long"))


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


# -- numpy word hashing -------------------------------------------------------------------

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_SEGMENT = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def byte_table(seed: int = 7) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03) + _U(seed))


_BYTES = byte_table()
_POW = _powers(_MULT, _SEGMENT * 2)
_IPOW = _powers(_INV, _SEGMENT * 2)


def word_table(kind: str) -> np.ndarray:
    """Which bytes belong to words. ``blank``: all but ASCII white space; ``alnum``: ASCII
    digits, lower-case letters and every byte of a character beyond ASCII."""
    t = np.ones(256, dtype=bool)
    if kind == "blank":
        t[[ord(c) for c in BLANKS]] = False
    else:
        t[:128] = False
        t[ord("0") : ord("9") + 1] = True
        t[ord("a") : ord("z") + 1] = True
    return t


#: bytes.translate table that lower-cases A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _segments(a: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut a long text at separators into pieces of about _SEGMENT bytes; a longer run
    without a separator stays whole."""
    at, n = 0, len(a)
    while at < n:
        end = min(n, at + _SEGMENT)
        while end < n and is_word[a[end]]:
            more = np.flatnonzero(~is_word[a[end : end + _SEGMENT]])
            if len(more):
                end += int(more[0])
                break
            end = min(n, end + _SEGMENT)
        yield at, end
        at = end


def word_hashes(data: bytes, is_word: np.ndarray) -> np.ndarray:
    """Hashes (uint64) of the words of a UTF-8 text, in order."""
    a = np.frombuffer(data, dtype=np.uint8)
    out = []
    for lo, hi in _segments(a, is_word):
        b = a[lo:hi]
        w = is_word[b]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], w, [False])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            continue
        n = len(b)
        pw, ip = (_POW, _IPOW) if n < len(_POW) else (_powers(_MULT, n), _powers(_INV, n))
        s = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[b] * pw[:n], out=s[1:])
        out.append(mix((s[ends] - s[starts]) * ip[starts]))
    if not out:
        return np.zeros(0, dtype=np.uint64)
    return out[0] if len(out) == 1 else np.concatenate(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows, in order (empty if there are fewer words)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(m, k, dtype=np.uint64)
    for i in range(k):
        h = (h ^ words[i : i + m]) * _U(_MULT)
        h ^= h >> _U(29)
    return mix(h)


def text_bytes(column) -> list:
    """Texts of an Arrow string column as bytes (None for null)."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few thousand driver-made rows as one JSON literal, unpacked in the JVM.
    ``schema`` is a DDL list of fields; the dicts use its names."""
    import json

    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def pinned(df: DataFrame, name: str, value) -> DataFrame:
    """``df`` with a column computed exactly once per row: a one-element explode is a barrier
    through which the optimizer neither copies the expression into later lambdas nor pushes a
    filter on it."""
    return df.withColumn(name, F.explode(F.array(value)))
