"""Language identification of mixed texts.

Words are runs of letters and of marks after a letter. The script of a word (by character ranges) narrows the languages it
may belong to; each of these scores the word by its hashed letter trigrams. Viterbi with a
penalty for switching turns the word scores into spans of one language each. The model, counts
of trigrams and of letters per script for each language, is learned from labelled texts.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import bounded_batches, text_bytes

#: Hash cells of trigrams, languages held as full tables, log penalty of a switch,
#: share of a language's own letters that makes it a candidate for their script.
CELLS, DENSE, SWITCH, SCRIPT_SHARE = 1 << 15, 200, 12.0, 0.01

# First and last code point of letter ranges by script (0 is no letter, 1 any other).
SCRIPTS = (
    (2, 0x41, 0x24F), (2, 0x1E00, 0x1EFF), (3, 0x370, 0x3FF), (3, 0x1F00, 0x1FFF), (4, 0x400, 0x52F), (5, 0x530, 0x58F),
    (6, 0x590, 0x5FF), (7, 0x600, 0x77F), (8, 0x900, 0x97F), (9, 0x980, 0x9FF), (10, 0xB80, 0xBFF), (11, 0xE00, 0xE7F),
    (12, 0x10A0, 0x10FF), (13, 0xAC00, 0xD7AF), (13, 0x1100, 0x11FF), (14, 0x3040, 0x30FF), (15, 0x3400, 0x9FFF),
)
N_SCRIPTS, _MARK = 16, 32
_SEGMENT = 1 << 16
#: Scores (words x languages) of a text that are kept between passes; those of more are made again.
_KEPT = 1 << 24


@functools.cache
def script_table() -> np.ndarray:
    """The script of each code point's letter; _MARK is added for a combining mark."""
    t = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    kind = np.array([unicodedata.category(chr(i))[0] for i in range(len(t))])
    t[(kind == "L") | (kind == "M")] = 1
    for script, lo, hi in SCRIPTS:
        t[lo : hi + 1][t[lo : hi + 1] > 0] = script
    t[kind == "M"] += _MARK
    return t


def without_loose_marks(script: np.ndarray) -> np.ndarray:
    """Marks get the script of the letter before them in their word, and 0 without one."""
    mark, at = script >= _MARK, np.arange(len(script))
    base = np.maximum.accumulate(np.where((script > 0) & ~mark, at, -1))
    gap = np.maximum.accumulate(np.where(script == 0, at, -1))
    return np.where(mark, np.where(base > gap, script[base], 0), script).astype(np.uint8)


def segments(text: str, size: int = _SEGMENT) -> Iterator[str]:
    """Pieces of a long text, cut at blanks."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        if cut < 0:
            break
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def letters(text: str, table: np.ndarray):
    """(letter places, trigram cell of each letter, word starts among the letters, scripts)."""
    low = text.lower()
    if len(low) != len(text):  # keep one code point for one
        low = "".join(c.lower()[0] for c in text)
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    script = table[c]
    if len(c) and script.max() >= _MARK:
        script = without_loose_marks(script)
    at = np.flatnonzero(script)
    if not len(at):
        return at, at, at, script[:0]
    held = np.where(script > 0, c, 0).astype(np.uint32)
    held = np.concatenate((np.zeros(1, np.uint32), held, np.zeros(1, np.uint32)))
    cell = (held[at] * np.uint32(0x9E3779B1)) ^ (held[at + 1] * np.uint32(0x85EBCA77)) ^ (held[at + 2] * np.uint32(0xC2B2AE3D))
    cell = ((cell ^ (cell >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    starts = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    return at, cell.astype(np.int64), starts, script[at]


def _counts(index: dict[str, int]):
    """Rows (lang, cell, n). A task holds full tables of DENSE languages at a time and hands on
    partial counts before it takes up more."""

    def rows(total):
        lang, (cells, n) = list(total), zip(*((c := np.flatnonzero(row), row[c]) for row in total.values()), strict=True)
        of = np.repeat(np.array(lang, dtype=np.int32), [len(c) for c in cells])
        return pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.concatenate(cells).astype(np.int32)), pa.array(np.concatenate(n))], names=["lang", "cell", "n"])

    def run(batches):
        table, total = script_table(), {}
        for b in batches:
            for lang, data in zip(b.column("lang").to_pylist(), text_bytes(b.column("text")), strict=True):
                if lang not in index or not data:
                    continue
                if index[lang] not in total:
                    if len(total) == DENSE:
                        yield rows(total)
                        total = {}
                    total[index[lang]] = np.zeros(CELLS + N_SCRIPTS, dtype=np.int64)
                row = total[index[lang]]
                for piece in segments(data.decode("utf-8", "replace")):
                    _, cell, _, script = letters(piece, table)
                    row[:CELLS] += np.bincount(cell, minlength=CELLS)
                    row[CELLS:] += np.bincount(script, minlength=N_SCRIPTS)
        if total:
            yield rows(total)

    return run


class Scores:
    """Trigram log probabilities. Those of up to DENSE languages are one table (cells x
    languages); of more languages only the cells that each has seen are held, by cell, as what
    they add to the language's log probability of an unseen cell."""

    def __init__(self, languages: int, lang: np.ndarray, cell: np.ndarray, n: np.ndarray):
        below = np.bincount(lang, weights=n, minlength=languages) + 0.05 * CELLS
        order = np.argsort(cell, kind="stable")
        self.unseen = np.log(0.05 / below)
        self.lang, self.more = lang[order].astype(np.int32), np.log((n[order] + 0.05) / 0.05).astype(np.float32)
        self.first = np.searchsorted(cell[order], np.arange(CELLS + 1))
        self.table = None
        if languages <= DENSE:
            grams = np.zeros((languages, CELLS))
            grams[lang, cell] = n
            self.table = np.log((grams + 0.05) / below[:, None]).T.astype(np.float32)
            self.lang, self.more = self.lang[:0], self.more[:0]

    def of_words(self, cell: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Words x languages; ``word`` are the places of the words' first letters."""
        if self.table is not None:
            return np.add.reduceat(self.table[cell], word, axis=0)
        size, held = np.diff(np.append(word, len(cell))), self.first[cell + 1] - self.first[cell]
        at = np.repeat(self.first[cell] - np.cumsum(held) + held, held) + np.arange(held.sum())
        k = len(self.unseen)
        place = np.repeat(np.repeat(np.arange(len(word)), size), held) * k + self.lang[at]
        more = np.bincount(place, weights=self.more[at], minlength=len(word) * k).reshape(len(word), k)
        return (more + size[:, None] * self.unseen).astype(np.float32)


class Model:
    """Languages, trigram scores, candidates (scripts x languages). Counts are given as the
    cells (trigrams, then scripts) that occur for a language."""

    def __init__(self, languages: list[str], lang: np.ndarray, cell: np.ndarray, n: np.ndarray):
        self.languages = languages
        gram, scripts = cell < CELLS, np.zeros((len(languages), N_SCRIPTS))
        scripts[lang[~gram], cell[~gram] - CELLS] = n[~gram]
        self.scores = Scores(len(languages), lang[gram], cell[gram], n[gram])
        self.allowed = (scripts >= SCRIPT_SHARE * scripts.sum(axis=1, keepdims=True)).T & (scripts.T > 0)


def learn(docs: DataFrame) -> Model:
    """Learn all languages from all rows of (text, lang) with both set. The driver receives one
    number per language and cell that occurs in its texts: at most CELLS + 16 a language."""
    bounded_batches(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").select("text", "lang")
    languages = sorted(known.select("lang").distinct().toArrow().column(0).to_pylist())
    if not languages:
        return Model([], *(np.zeros(0, dtype=np.int64),) * 3)
    index = {x: i for i, x in enumerate(languages)}
    got = known.mapInArrow(_counts(index), "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    return Model(languages, *(got.column(c).to_numpy() for c in ("lang", "cell", "n")))


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word (words x languages scores)."""
    return best_path(lambda: iter([scores]), penalty)


def best_path(blocks: Callable[[], Iterator[np.ndarray]], penalty: float) -> np.ndarray:
    """Best language of each word; ``blocks`` gives the scores (words x languages) in order, and
    again for each pass. One language throughout is best unless some stretch of words gains more
    than the penalty elsewhere; only then the full recursion runs."""
    total, n = 0.0, 0
    for s in blocks():
        total, n = total + s.sum(axis=0), n + len(s)
    k, main = len(total), int(np.argmax(total))
    if k == 1:
        return np.zeros(n, dtype=np.int64)
    run = low = most = 0.0
    for s in blocks():
        gain = s - s[:, main : main + 1]
        gain[:, main] = -np.inf
        runs = np.cumsum(np.concatenate(([run], gain.max(axis=1))), dtype=np.float64)
        lows = np.minimum.accumulate(np.minimum(runs, low))
        run, low, most = runs[-1], lows[-1], max(most, (runs - lows).max())
    if most <= penalty:
        return np.full(n, main, dtype=np.int64)
    back = np.empty((n, (k + 7) // 8), dtype=np.uint8)  # one bit a language: it comes from the lead
    leads = np.zeros(n, dtype=np.int64)
    best, i = None, 0
    for s in blocks():
        for row in s:
            if best is None:
                best = row.astype(np.float64)
            else:
                lead = leads[i] = int(best.argmax())
                switch = best < best[lead] - penalty
                back[i] = np.packbits(switch)
                best = np.where(switch, best[lead] - penalty, best) + row
            i += 1
    out = np.empty(n, dtype=np.int64)
    out[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        j = out[i]
        out[i - 1] = leads[i] if back[i, j >> 3] >> (7 - (j & 7)) & 1 else j
    return out


def label_text(text: str, languages: int, scores: Scores, allowed: np.ndarray, table: np.ndarray, penalty: float):
    """(word starts, word ends, language of each word, letters of each word)."""
    starts, ends, sizes, parts = [], [], [], []
    offset = 0
    for piece in segments(text, max(1 << 10, _SEGMENT * DENSE // max(DENSE, languages))):
        at, cell, word, script = letters(piece, table)
        if len(at):
            size = np.diff(np.append(word, len(at)))
            starts.append(at[word] + offset)
            ends.append(at[word + size - 1] + 1 + offset)
            sizes.append(size)
            parts.append((cell, word, script[word]))
        offset += len(piece)
    if not parts:
        return (np.zeros(0, dtype=np.int64),) * 4

    def blocks():
        for cell, word, script in parts:
            s = scores.of_words(cell, word)
            may = allowed[script]
            may[~may.any(axis=1)] = True
            yield np.where(may, s, s.min(axis=1, keepdims=True) - 50.0)

    sizes = np.concatenate(sizes)
    kept = list(blocks()) if len(sizes) * languages <= _KEPT else None
    labels = best_path(blocks if kept is None else lambda: iter(kept), penalty)
    return np.concatenate(starts), np.concatenate(ends), labels, sizes


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def _label(languages: list[str], shared, penalty: float):
    def run(batches):
        table = script_table()
        scores, allowed = shared.value
        for b in batches:
            pred, score, spans = [], [], []
            for data in text_bytes(b.column("text")):
                labels = ()
                if data and languages:
                    starts, ends, labels, sizes = label_text(data.decode("utf-8", "replace"), len(languages), scores, allowed, table, penalty)
                if not len(labels):
                    pred.append("und")
                    score.append(0.0)
                    spans.append([])
                    continue
                weight = np.bincount(labels, weights=sizes, minlength=len(languages))
                best = int(weight.argmax())
                pred.append(languages[best])
                score.append(float(weight[best] / weight.sum()))
                first = np.flatnonzero(np.concatenate(([True], labels[1:] != labels[:-1])))
                last = np.append(first[1:], len(labels)) - 1
                spans.append([{"start": int(starts[i]), "end": int(ends[j]), "lang": languages[labels[i]]} for i, j in zip(first, last, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, _SPANS)],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    return run


def identify_languages(docs: DataFrame, model: Model, penalty: float = SWITCH) -> DataFrame:
    """One row per input row: doc_id, lang_pred (the language of most letters), score (its share
    of the letters), spans (start, end in code points, lang). Needs doc_id and text; other columns
    are ignored.

    Defined cases: null, empty and letterless texts, and any text for a model without languages,
    are "und" with score 0 and no spans; equal shares go to the first language in sorted order;
    words of a script that no language knows may be any language; repeated rows are labelled
    alike; an empty table gives an empty result."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model.scores, model.allowed))  # DENSE x CELLS floats, or 8 bytes per cell that a language has seen
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>"
    return docs.select("doc_id", "text").mapInArrow(_label(model.languages, shared, penalty), schema)
