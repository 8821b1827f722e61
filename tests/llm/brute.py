"""Plain re-implementations that the operators are compared with, and shared fixtures."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import types as T

BLANK_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = ["th", "sig", "n", "key", "h", "part", "words", "grp", "rk", "e", "score", "_id"]


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def blank_words(text):
    return re.findall(BLANK_WORD, text or "")


def shingles(text, k):
    w = blank_words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(rows, k, num):
    """rows: (doc_id, text) -> per row (n_shingles, component_id, n_links)."""
    sets = [shingles(t, k) for _, t in rows]
    parent, links = list(range(len(rows))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [(len(sets[i]), low.get(root(i)) if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows)]


def edge_rows():
    """Nulls in any column, empty, blank, very long and repeated texts."""
    rnd = random.Random(5)
    long = " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(30_000))
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \t\n ", "en", "a", 4),
        (None, "one two three four five six", "en", None, 1),
        (None, None, None, None, None),
        (4, long, "en", "b", len(long)),
        (5, long, "en", "b", len(long)),
        (6, "ONE two three four five six", "en", "a", 1),
        (6, "ONE two three four five six", "en", "a", 1),
        (7, "x" * 200_000, None, "c", 200_000),
        (8, "émile\x0b naïve Ünder\x00 \U0001f600 wörd", "fr", "c", 1),
    ]


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])
    return df


def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(SCHEMA))


def key(row):
    return tuple((x is None, str(x)) for x in row)
