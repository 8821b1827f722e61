"""Ordered, first-match-wins substring rules.

Three statement steps are the same operator: the merchant alias map, the merchant keyword map
and the code-description rules. A rule list is ordered ``(pattern, value)`` pairs; the value
of the first pattern contained in the text wins (not the longest, not the leftmost).

Three Spark forms:

* :func:`first_match` / :func:`first_group_match` build one ``CASE WHEN`` expression. Runs of
  neighbouring rules with the same value collapse into one ``OR`` branch, which is exact
  because only the first hit matters. Right for fixed lists of a few hundred patterns.
* :func:`first_match_array` filters a literal array of rules with a lambda: small generated
  code, interpreted per element; used on one-row-per-merchant tables.
* :func:`match_with_rule_table` is the same operator over a rules *DataFrame* (user-supplied,
  possibly large): an equi-join on each rule's rarest substring, verified, then the minimum
  rule ordinal. It works on distinct texts first, so repeated texts are matched once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import let


def rule_groups(rules: Sequence[tuple[str, str]]) -> list[tuple[list[str], str]]:
    """Collapse neighbouring rules with equal values into (patterns, value) groups."""
    groups: list[tuple[list[str], str]] = []
    for pattern, value in rules:
        if groups and groups[-1][1] == value:
            groups[-1][0].append(pattern)
        else:
            groups.append(([pattern], value))
    return groups


def first_group_match(text: Column, groups: Sequence[tuple[Sequence[str], str]]) -> Column:
    """Value of the first group that has any pattern contained in ``text``; null if none."""
    expr = None
    for patterns, value in groups:
        hit = None
        for p in patterns:
            c = text.contains(F.lit(p))
            hit = c if hit is None else (hit | c)
        expr = F.when(hit, F.lit(value)) if expr is None else expr.when(hit, F.lit(value))
    return expr if expr is not None else F.lit(None).cast("string")


def first_match(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Value of the first ``(pattern, value)`` rule whose pattern is contained in ``text``."""
    return first_group_match(text, rule_groups(rules))


def first_match_array(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Same answer as :func:`first_match`, as one higher-order expression over a literal array
    of (pattern, value) structs. Its generated code stays small however long the rule list is
    (the lambda is interpreted), so it suits small tables, e.g. one row per merchant, and
    filters that the optimizer may push onto the expression."""
    arr = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(v).alias("v")) for p, v in rules])
    return let(text, lambda t: F.get(F.filter(arr, lambda r: t.contains(r["p"])), 0)["v"])


def first_group_match_array(text: Column, groups: Sequence[tuple[Sequence[str], str]]) -> Column:
    """Same answer as :func:`first_group_match`, as a higher-order expression over a literal
    array of (keywords, value) groups: small generated code, and on long texts (where each
    substring test dominates) as fast as the CASE form."""
    arr = F.array(*[
        F.struct(F.array(*[F.lit(k) for k in patterns]).alias("ks"), F.lit(value).alias("v"))
        for patterns, value in groups
    ])
    return let(text, lambda t: F.get(F.filter(arr, lambda g: F.exists(g["ks"], lambda k: t.contains(k))), 0)["v"])


def rule_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rules as a DataFrame (ordinal, pattern, value)."""
    from ledgerlens.sources.literal import literal_table

    return literal_table(spark, [(i, p, v) for i, (p, v) in enumerate(rules)],
                         "ordinal int, pattern string, value string")


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters."""
    places = F.sequence(F.lit(1), F.length(text) - (size - 1))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda i: text.substr(i, F.lit(size)))))


def match_with_rule_table(df: DataFrame, text_col: str, rules: DataFrame, out_col: str, size: int = 3) -> DataFrame:
    """Add ``out_col`` = value of the lowest-ordinal rule whose pattern occurs in ``text_col``.

    ``rules`` has columns (ordinal, pattern, value) and may have any number of rows. Distinct
    texts are split into their substrings of ``size`` characters; every rule is joined on the
    one of its own substrings that the fewest texts have (patterns shorter than ``size`` on the
    whole pattern, against substrings of that length), and the pairs are verified with
    ``contains``. The empty pattern occurs in every text that is not null."""
    texts = df.select(F.col(text_col).alias("_text")).where("_text is not null").distinct()
    pieces = texts.select("_text", F.explode(F.flatten(F.array_compact(F.array(*[_grams(F.col("_text"), n) for n in range(1, size + 1)])))).alias("_gram"))
    spots = rules.where("length(pattern) > 0").select("ordinal", "pattern", "value", F.explode(
        F.when(F.length("pattern") >= size, _grams(F.col("pattern"), size)).otherwise(F.array("pattern"))).alias("_gram"))
    wanted = spots.select("_gram").distinct()
    pieces = pieces.join(wanted, "_gram", "left_semi")
    often = pieces.groupBy("_gram").agg(F.count("*").alias("_n"))
    # A substring that no text has rules its pattern out: the left join leaves it the rarest.
    rarest = spots.join(often, "_gram", "left").groupBy("ordinal", "pattern", "value").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("_key"))
    keyed = rarest.where("_key.n > 0").select("ordinal", "pattern", "value", F.col("_key.g").alias("_gram"))
    hits = pieces.join(keyed, "_gram").where(F.col("_text").contains(F.col("pattern"))).select("_text", "ordinal", "value")
    always = rules.where("length(pattern) = 0").orderBy("ordinal", "value").select("ordinal", "value").first()  # at most one row
    best = hits.groupBy("_text").agg(F.min(F.struct("ordinal", "value")).alias("_best"))
    joined = df.join(best, df[text_col] == best["_text"], "left").drop("_text")
    value = F.col("_best.value")
    if always is not None:
        first = F.col("_best").isNull() | (F.col("_best.ordinal") > always["ordinal"])
        value = F.when(F.col(text_col).isNotNull(), F.when(first, F.lit(always["value"])).otherwise(value))
    return joined.withColumn(out_col, value).drop("_best")
