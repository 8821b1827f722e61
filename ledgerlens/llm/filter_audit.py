"""Filter interaction audit: what each of several document filters removes in every order.

Method (exact constrained least squares): every document gets a mask of the filters that it fails;
documents are counted by mask, and each coalition S of filters gets its removals v(S), the number
of documents that fail any filter of S (all 32 coalitions of five filters). The Shapley value of
the filters is the phi that minimises  sum over S of w(S) (v(S) - sum of phi in S)^2  under
sum of phi = v(all), w the Shapley kernel; its normal equations with the efficiency constraint
are solved in rationals, so the values are exact. The counts of a step of an order are differences
of coalitions: removed = v(before + filter) - v(before), and so on.

The heavy part (reading texts, finding equal texts, joining labels, counting masks) is DataFrame
code over narrow rows; per part at most 32 masks x 4 label combinations are left, which one small
Python task turns into the part's rows. Nothing passes the driver.

Equal texts are found by 128-bit digests: the smallest doc_id of every text comes from a
map-side combined aggregate, and rows are compared with it by a join on (digest, doc_id), so a
text that a third of all rows share meets in no task.

Edge cases: a null text is empty; a null lang and an empty one are the part ``""``; a row with a
null doc_id equals no smaller one (and is none); repeated rows count once each, and rows that
repeat the smallest doc_id of a text are not duplicates of it; a document with several label rows
has a label if any row has it; a missing or null label is 0; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from itertools import combinations, permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stage

#: Words are separated by ASCII white space.
_BLANKS = r"[\x20\x09-\x0D]+"

RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions A to D of one text (E, equal to a smaller doc_id's text, is found across rows)."""
    words = F.array_remove(F.split(text, _BLANKS), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 200,
        "B": 100 * distinct.cast("long") < 50 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _mask(conditions: dict[str, Column], names: str) -> Column:
    total = F.lit(0)
    for k, c in conditions.items():
        total = total + F.when(c, 1 << names.index(k)).otherwise(0)
    return total.cast("int")


def failure_counts(
    docs: DataFrame,
    labels: DataFrame,
    failures: Callable[[Column], dict[str, Column]] = text_failures,
    copies: str | None = "E",
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """Rows (part, mask, n, n_good, n_toxic): documents by part and failed filters. Bit k of
    ``mask`` is the k-th filter by name. ``copies`` names the filter that removes texts equal to
    one of a smaller id (None: no such filter)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = "".join(sorted([*failures(text), *([copies] if copies else [])]))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.md5(text)).alias("digest"),
        _mask(failures(text), names).alias("mask"),
    )
    rows = stage(rows, "filter-rows")  # narrow rows, read three times below
    counted = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    if copies:
        first = rows.groupBy("digest").agg(F.min("id").alias("id"))
        first = first.where("id is not null").withColumn("is_first", F.lit(True))
        copy = F.col("is_first").isNull() & F.col("id").isNotNull()
        bit = F.when(copy, 1 << names.index(copies)).otherwise(0)
        counted = counted.join(first, ["digest", "id"], "left").withColumn("mask", F.col("mask") + bit)
    flags = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
    )
    return (
        counted.join(flags.where("id is not null and good + toxic > 0"), "id", "left")
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("n_good"),
            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n_toxic"),
        )
    )


def coalition_values(counts: dict[int, int], n: int) -> list[int]:
    """v(S) for every coalition S (a bit set): the documents that fail any filter of S."""
    return [sum(c for mask, c in counts.items() if mask & s) for s in range(1 << n)]


def solve(rows: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The solution of a regular linear system, by Gauss-Jordan elimination in rationals."""
    a = [[*r, b] for r, b in zip(rows, right, strict=True)]
    for k in range(len(a)):
        pivot = next(i for i in range(k, len(a)) if a[i][k])
        a[k], a[pivot] = a[pivot], a[k]
        a[k] = [x / a[k][k] for x in a[k]]
        for i in range(len(a)):
            if i != k and a[i][k]:
                a[i] = [x - a[i][k] * y for x, y in zip(a[i], a[k], strict=True)]
    return [r[-1] for r in a]


def shapley_by_least_squares(v: list[int], n: int) -> list[Fraction]:
    """Shapley values of the game ``v`` as the kernel-weighted least-squares fit of an additive
    game that shares out v(all) completely (a Lagrange multiplier holds the constraint)."""
    if n == 1:
        return [Fraction(v[1])]
    normal = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    right = [Fraction(0)] * (n + 1)
    for size in range(1, n):
        weight = Fraction(n - 1, comb(n, size) * size * (n - size))
        for members in combinations(range(n), size):
            value = v[sum(1 << i for i in members)] - v[0]
            for i in members:
                right[i] += weight * value
                for j in members:
                    normal[i][j] += weight
    for i in range(n):
        normal[i][n] = normal[n][i] = Fraction(1)
    right[n] = Fraction(v[-1] - v[0])
    return solve(normal, right)[:n]


def audit_part(part: str, masks: list[tuple[int, int, int, int]], names: str) -> list[tuple]:
    """All rows of one part; ``masks`` holds (mask, documents, good ones, toxic ones)."""
    n = len(names)
    v, good, toxic = (coalition_values({m[0]: m[k] for m in masks}, n) for k in (1, 2, 3))
    total, every = sum(m[1] for m in masks), (1 << n) - 1
    shapley = [int(x * factorial(n)) for x in shapley_by_least_squares(v, n)]
    out = []
    for order in permutations(range(n)):
        label, before = "".join(names[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = v[after] - v[before]
            unique = v[every] - v[every ^ 1 << i]
            lost = (good[after] - good[before], toxic[after] - toxic[before])
            out.append((part, label, step, total - v[after], removed, v[1 << i] - removed, unique, *lost, shapley[i]))
            before = after
    return out


def audit(counts: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step (see RESULT); ``shapley`` is the filter's
    removals summed over all orders, that is n! times its Shapley value. The number of orders is
    n!, so this is meant for up to about seven filters."""

    def of_part(key, group):
        import pandas as pd

        masks = list(group[["mask", "n", "n_good", "n_toxic"]].itertuples(index=False, name=None))
        rows = audit_part(key[0], [tuple(int(x) for x in m) for m in masks], names)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return counts.groupBy("part").applyInPandas(of_part, RESULT)
