"""Toxicity by a weighted lexicon.

Texts are folded to a skeleton (lower case, homoglyphs of other scripts to Latin letters, digit
and symbol substitutions to the letters they stand for, look-alikes i/l/1 to one letter), words
are set apart by blanks, and an Aho-Corasick automaton finds the lexicon's entries: whole words
or word beginnings. Where several entries start at one place the longest wins, so an exception
phrase (a longer entry of weight 0) hides the entry inside it. The hit weight, plain and per
length, gives the score through a logistic curve.

Entries, weights, exceptions and curve are learned from a bounded sample of labelled texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import bounded_batches, stage, text_bytes

#: Labelled texts used for learning, at most (toxic, clean).
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
#: A kept entry occurs in this many toxic texts and after this many different words. Every entry
#: that does, and has the odds below, is kept; the size of the sample bounds their number.
SUPPORT, CONTEXTS = 5, 5
MIN_LOG_ODDS, MAX_WEIGHT = 2.0, 8.0

# Look-alikes of Latin letters in other scripts, character substitutions.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ɡ": "g", "ı": "i",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "ι": "i", "κ": "k", "ε": "e", "η": "n", "χ": "x", "ω": "w",
}
INVISIBLE = "​‌‍⁠﻿­"
DIGITS = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SYMBOLS = {"@": "a", "$": "s", "!": "l", "|": "l"}

_BEYOND = re.compile("[^\x00-\xac\xae-\xff]")
_SYMBOL = re.compile(r"[@$!|](?=[^\W_])")
_NOT_WORD = re.compile(r"[\W_]+")
_WIDE = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(c): None for c in INVISIBLE}


def _letter(c: str) -> str:
    c = c.lower()
    c = DIGITS.get(c, "l" if c == "i" else c)
    return c if len(c) == 1 and c.isalnum() and ord(c) < 256 else " "


_TABLE = bytes(ord(_letter(chr(i))) for i in range(256))


def fold(text: str) -> list[str]:
    """The words of a text's skeleton."""
    if _BEYOND.search(text) or "\xad" in text:
        text = unicodedata.normalize("NFKC", text).lower().translate(_WIDE)
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _SYMBOL.sub(lambda m: SYMBOLS[m[0]], text)
    if _BEYOND.search(text):
        text = "".join(_letter(c) if ord(c) < 256 else c for c in text)
        return _NOT_WORD.sub(" ", text).split()
    return text.encode("latin-1").translate(_TABLE).decode("latin-1").split(" ")


def words_of(data: bytes | None) -> list[str]:
    return [w for w in fold(data.decode("utf-8", "replace")) if w] if data else []


def spaced(words: list[str]) -> str:
    """Each word between blanks of its own, so that neighbouring entries do not overlap."""
    return " " + "  ".join(words) + " "


def entries_of(word: str) -> list[str]:
    """A word's possible lexicon entries: itself and its beginnings of 3 to 9 letters."""
    w = f" {word} "
    return [w] + [w[:n] for n in range(4, min(11, len(w) - 1))]


def normal_entry(phrase: str) -> str:
    return spaced([w for w in fold(phrase) if w])


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, w in self.weights.items():
            a.add_word(k, w)
        for k in self.exceptions:
            a.add_word(k, 0.0)
        a.make_automaton()
        return a


def hits(automaton, words: list[str]) -> tuple[float, int]:
    if not words or not len(automaton):
        return 0.0, 0
    found = [w for _, w in automaton.iter_long(spaced(words)) if w]
    return sum(found), len(found)


def features(weight: float, n_words: int) -> tuple[float, float]:
    return math.log1p(weight), math.log1p(1000 * weight / (n_words + 50))


def _doc_counts():
    """Rows (entry, n): in how many texts of the task's share each entry occurs."""

    def run(batches):
        count: Counter = Counter()
        for b in batches:
            for data in text_bytes(b.column("text")):
                count.update({e for w in set(words_of(data)) for e in entries_of(w)})
            if len(count) > 500_000:
                yield _pairs(count)
                count = Counter()
        yield _pairs(count)

    return run


def _pairs(count):
    return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["entry", "n"])


def _contexts(only: set[str]):
    """Rows (entry, context): the word before each occurrence."""

    def run(batches):
        for b in batches:
            rows = set()
            for data in text_bytes(b.column("text")):
                prev = ""
                for w in words_of(data):
                    rows.update((e, prev) for e in entries_of(w) if e in only)
                    prev = w
            e, c = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.string()), pa.array(c, pa.string())], names=["entry", "context"])

    return run


def _around(kept: set[str]):
    """Rows (entry, n): in how many texts of the task's share each longer word of a kept
    beginning, and each phrase of two or three words with a kept entry, occurs."""

    def run(batches):
        count: Counter = Counter()
        for b in batches:
            for data in text_bytes(b.column("text")):
                words, seen = words_of(data), set()
                for i, w in enumerate(words):
                    listed = [e for e in entries_of(w) if e in kept]
                    if not listed:
                        continue
                    if f" {w} " not in kept:
                        seen.add(f" {w} ")
                    for lo, hi in ((i - 1, i + 1), (i, i + 2), (i - 2, i + 1), (i - 1, i + 2), (i, i + 3)):
                        if lo >= 0 and hi <= len(words):
                            seen.add(spaced(words[lo:hi]))
                count.update(seen)
            if len(count) > 500_000:
                yield _pairs(count)
                count = Counter()
        yield _pairs(count)

    return run


def _scores(lexicon: Lexicon, names: list[str]):
    def run(batches):
        automaton = lexicon.automaton()
        a, b1, b2 = lexicon.curve
        for b in batches:
            out = []
            for data in text_bytes(b.column("text")):
                words = words_of(data)
                w, n = hits(automaton, words)
                x, y = features(w, len(words))
                out.append((1 / (1 + math.exp(-min(50.0, max(-50.0, a + b1 * x + b2 * y)))), w, n, len(words)))
            s, w, n, m = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(s, pa.float64()), pa.array(w, pa.float64()), pa.array(n, pa.int64()), pa.array(m, pa.int64())],
                names=[*names, "score", "hit_weight", "n_hits", "n_words"],
            )

    return run


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    ridge = np.diag([1e-4, 1e-2, 1e-2]) * len(x) / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        g = a.T @ (y - p) - ridge @ w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def _strongest(entries: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Weights of the entries (odds, texts): of nested ones (one begins with the other) the
    strongest stays."""
    kept: dict[str, float] = {}
    whole, begun = set(), set()  # kept entries without blanks behind them, and their beginnings
    for e in sorted(entries, key=lambda e: (-entries[e][0] * math.sqrt(entries[e][1]), -len(e), e)):
        inner = e.rstrip()
        if inner in begun or any(inner[:n] in whole for n in range(1, len(inner) + 1)):
            continue
        kept[e] = min(MAX_WEIGHT, entries[e][0])
        whole.add(inner)
        begun.update(inner[:n] for n in range(1, len(inner) + 1))
    return kept


def _beginning_with(kept: set[str]):
    """Keeps the words that begin with a kept beginning."""

    def run(batches):
        import pyarrow.compute as pc

        for b in batches:
            found = [any(e[:n] in kept for n in range(2, len(e))) for e in b.column("entry").to_pylist()]
            yield b.filter(pc.fill_null(pa.array(found, pa.bool_()), False))

    return run


def training_sample(docs: DataFrame, labels: DataFrame, use, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    """(text, toxic) of at most ``toxic`` and ``clean`` distinct labelled texts, chosen by the
    hash of their id; ``use`` says which ids may be learned from."""
    marked = labels.where("doc_id is not null and toxic is not null").where(use).groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    chosen = marked.where("toxic = 1").orderBy(*order).limit(toxic).unionByName(marked.where("toxic <> 1").orderBy(*order).limit(clean))
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    return stage(texts.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-sample")


def learn(sample: DataFrame, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Lexicon, exceptions and curve from a bounded sample of (text, toxic 0/1). Besides those
    given, exceptions are the longer words of a kept beginning and the phrases of two or three
    words around a kept entry that SUPPORT or more clean texts hold (a tenth of them, if fewer than
    SUPPORT) and that are likelier in clean texts than in toxic ones."""
    bounded_batches(sample.sparkSession)
    per = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_tox, n_clean = per.get(1, 0), per.get(0, 0)
    fixed = [normal_entry(e) for e in exceptions]
    if not n_tox or not n_clean:
        prior = (n_tox + 0.5) / (n_tox + n_clean + 1) if n_tox + n_clean else 1e-3
        return Lexicon({}, fixed, (math.log(prior / (1 - prior)), 0.0, 0.0))
    tox_text, clean_text = sample.where("toxic = 1").select("text"), sample.where("toxic <> 1").select("text")

    def counts(part):
        return part.mapInArrow(_doc_counts(), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))

    floor = max(2, min(SUPPORT, n_tox // 10))
    clean = counts(clean_text).withColumnRenamed("n", "clean")
    odds = F.log((F.col("n") + 0.5) / (n_tox + 1)) - F.log((F.coalesce("clean", F.lit(0)) + 0.5) / (n_clean + 1))
    scored = counts(tox_text).where(F.col("n") >= floor).join(clean, "entry", "left").select("entry", "n", odds.alias("odds"))
    scored = stage(scored, "toxic-entries")
    tried = {r["entry"]: (r["odds"], r["n"]) for r in scored.where(F.col("odds") >= MIN_LOG_ODDS).collect()}
    after = tox_text.mapInArrow(_contexts(set(tried)), "entry string, context string").groupBy("entry").agg(F.countDistinct("context").alias("n"))
    spread = {r["entry"] for r in after.where(F.col("n") >= min(CONTEXTS, floor)).collect()}
    kept = _strongest({e: tried[e] for e in spread})
    near = sample.select("text", (F.col("toxic") == 1).alias("bad"))
    seen_in = [near.where(c).select("text").mapInArrow(_around(set(kept)), "entry string, n long").groupBy("entry").agg(F.sum("n").alias(n)) for c, n in (("not bad", "clean"), ("bad", "toxic"))]
    support = max(2, min(SUPPORT, n_clean // 10))
    less = (F.coalesce("toxic", F.lit(0)) + 0.5) / (n_tox + 1) < (F.col("clean") + 0.5) / (n_clean + 1)
    around = seen_in[0].where(F.col("clean") >= support).join(seen_in[1], "entry", "left").where(less)
    longer = scored.where((F.col("odds") < 0) & F.col("entry").endswith(" ")).select("entry").mapInArrow(_beginning_with(set(kept)), "entry string")
    harmless = {r["entry"] for r in longer.collect()}
    lexicon = Lexicon(kept, fixed + sorted(harmless | {r["entry"] for r in around.select("entry").collect()}))
    rows = sample.mapInArrow(_scores(lexicon, ["toxic"]), "toxic long, score double, hit_weight double, n_hits long, n_words long").collect()
    x = np.array([features(r["hit_weight"], r["n_words"]) for r in rows])
    lexicon.curve = _fit(x, np.array([float(r["toxic"] == 1) for r in rows]))
    return lexicon


def toxicity_scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), hit_weight, n_hits, n_words. Needs doc_id
    and text; other columns are ignored.

    Defined cases: a null or wordless text has no hits and the score of a text without hits; a
    lexicon learned without toxic or without clean texts gives every text the labels' rate (near
    0 without labels); repeated rows are scored alike; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scores(lexicon, ["doc_id"]), f"doc_id {kind}, score double, hit_weight double, n_hits long, n_words long")


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns unchanged."""
    bounded_batches(docs.sparkSession)
    names = docs.columns

    def run(batches):
        for b, s in zip_scores(batches):
            yield b.filter(pa.array(s < threshold))

    def zip_scores(batches):
        score = _scores(lexicon, [])
        for b in batches:
            (out,) = score(iter([b]))
            yield b, out.column("score").to_numpy(zero_copy_only=False)

    return docs.select(*names).mapInArrow(run, docs.schema)
