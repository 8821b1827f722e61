"""Weak supervision of document quality.

Each rule looks at a few statistics of a text and votes good (1), bad (-1) or abstains (0).
Expectation-maximisation over the table of distinct vote patterns estimates the share of good
documents and, for each rule, how often it votes each way on good and on bad ones. The posterior
probability of a good document given all its votes decides, instead of "all rules must pass".

Only DataFrame functions. The texts are read once, into one narrow row of numbers each; the
repeats inside a text are found in its own row, so no word or window is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import stage

#: Words of a repeated window.
WINDOW = 8
_BLANK = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def _count_bytes(text: str, chars: str) -> Column:
    """How often the given ASCII characters occur."""
    rest = F.col(text)
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def text_statistics(docs: DataFrame) -> DataFrame:
    """One narrow row of counts per document; texts are read whole, null counts as empty.

    The repeated windows: hashes of all windows, a test for duplicates by a hash set, and only
    for a text that has some, the windows sorted with their places, whose runs of equals give
    the places and from these the words covered. Each step is a column used more than once, so
    that it is computed once."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "text", F.array_remove(F.split("text", _BLANK), "").alias("words"), F.split("text", "\n").alias("lines"))
    d = d.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("wh"),
        F.filter("lines", lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0).alias("lines"),
    )
    window = F.transform(F.sequence(F.lit(0), F.size("wh") - WINDOW), lambda i: F.xxhash64(*[F.get("wh", i + k) for k in range(WINDOW)]))
    kept_text = F.octet_length("text").cast("long")
    d = d.select(
        "doc_id",
        "n_words",
        F.when(F.size("wh") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("win"),
        (F.length("text") - _count_bytes("text", " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        _count_bytes("text", _SYMBOLS).alias("n_symbols"),
        _count_bytes("text", "!").alias("n_exclaims"),
        (kept_text - F.octet_length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long").alias("n_upper"),
        (kept_text - F.octet_length(F.regexp_replace("text", "[0-9]+", ""))).cast("long").alias("n_digits"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended_lines"),
    )
    rest = [c for c in d.columns if c != "win"]
    d = d.withColumn("n_equal", F.size("win") - F.size(F.array_distinct("win")))
    d = d.select(*rest, "n_equal", F.when(F.col("n_equal") > 0, F.sort_array(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    equal = F.filter("s", lambda x, k: x["h"].eqNullSafe(F.get("s", k - 1)["h"]) | x["h"].eqNullSafe(F.get("s", k + 1)["h"]))
    d = d.select(*rest, F.when(F.col("n_equal") > 0, F.sort_array(F.transform(equal, lambda x: x["i"]))).alias("at"))
    gap = F.transform("at", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - x, F.lit(WINDOW))).cast("long"))
    covered = F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select(*rest, F.when(F.col("at").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes of the rules over the columns of :func:`text_statistics`. Rules that look for one
    kind of damage abstain where they do not find it, as its absence proves no quality."""
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    symbols, mean = F.col("n_symbols") / n, F.col("word_chars") / n
    upper, chars = F.col("n_upper") / F.greatest("word_chars", F.lit(1)), F.greatest("word_chars", F.lit(1))
    ended = F.col("n_ended_lines") / lines
    repeats, dups = F.col("n_repeat_words") / n, F.col("n_dup_lines") / lines
    never = F.lit(False)
    return {
        "length": _vote(F.col("n_words") < 20, F.col("n_words") >= 60),
        "symbols": _vote(symbols > 0.3, symbols < 0.05),
        "sentences": _vote(ended < 0.2, ended > 0.6),
        "capitals": _vote(upper > 0.3, never),
        "exclaims": _vote(F.col("n_exclaims") / n > 0.3, never),
        "repeats": _vote(repeats > 0.2, never),
        "same_lines": _vote((dups > 0.3) & (F.col("n_dup_lines") >= 3), never),
        "word_length": _vote((mean < 2.5) | (mean > 12), never),
        "digits": _vote(F.col("n_digits") / chars > 0.2, never),
    }


VOTES = (-1, 0, 1)


#: Share of votes on good and on bad documents that a rule is believed to cast before any data,
#: and the weight of that belief as a share of all documents (for each class).
BELIEF = {1: {1: 0.5, 0: 0.495, -1: 0.005}, -1: {1: 0.3, 0: 0.3, -1: 0.4}}
BELIEF_WEIGHT = 0.05


def estimate(votes: DataFrame, names: list[str], rounds: int = 25) -> tuple[float, dict[str, dict[int, float]]]:
    """EM over the vote patterns (at most 3 ** rules rows): the prior log odds of a good document
    and the log likelihood ratio good : bad of every vote of every rule. Each round is one
    aggregation of the pattern table to a few sums a rule.

    Two classes alone could swap meaning, so the estimates start from BELIEF and keep it with
    BELIEF_WEIGHT; good documents are taken to be no minority; no rule's good votes may speak for
    bad documents or the reverse, and an abstention says nothing."""
    patterns = stage(votes.groupBy(*names).agg(F.count("*").alias("n")), "votes")
    prior = math.log(0.8 / 0.2)
    ratio = {r: {v: math.log(BELIEF[1][v] / BELIEF[-1][v]) if v else 0.0 for v in VOTES} for r in names}
    for _ in range(rounds):
        good = F.col("n") * posterior(prior, ratio)
        sums = [F.sum(good).alias("good"), F.sum("n").alias("all")]
        sums += [F.sum(F.when(F.col(r) == v, x)).alias(f"{r}|{v}|{k}") for r in names for v in (-1, 1) for k, x in (("g", good), ("n", F.col("n")))]
        got = patterns.agg(*sums).first()
        if not got["all"]:
            break
        g, b, w = got["good"], got["all"] - got["good"], BELIEF_WEIGHT * got["all"]
        before = prior
        prior = max(0.0, math.log((g + w * 0.8) / (b + w * 0.2)))
        for r in names:
            for v in (-1, 1):
                gv = got[f"{r}|{v}|g"] or 0.0
                bv = (got[f"{r}|{v}|n"] or 0) - gv
                x = math.log((gv + w * BELIEF[1][v]) / (g + w)) - math.log((bv + w * BELIEF[-1][v]) / (b + w))
                ratio[r][v] = v * max(0.0, v * x)
        if abs(prior - before) < 1e-6:
            break
    return prior, ratio


def posterior(prior: float, ratio: dict[str, dict[int, float]]) -> Column:
    odds = F.lit(prior)
    for r, by in ratio.items():
        odds = odds + F.when(F.col(r) == 1, by[1]).when(F.col(r) == -1, by[-1]).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def quality_posteriors(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, the counts of :func:`text_statistics`, one vote column
    (vote_<rule>) per rule, quality (posterior probability of a good document).

    Needs doc_id and text; other columns are ignored. Defined cases: a null text counts as empty
    (no words; the length and sentence rules vote bad); equal windows are told by 64-bit hashes;
    repeated rows count as many times as they occur; a null doc_id is kept; an empty table gives
    an empty result."""
    stats = stage(text_statistics(docs), "quality")
    names = [f"vote_{r}" for r in rules()]
    votes = stats.select("*", *[v.alias(f"vote_{r}") for r, v in rules().items()])
    prior, ratio = estimate(votes, names)
    return votes.withColumn("quality", posterior(prior, ratio))
