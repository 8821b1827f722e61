"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived that every match
satisfies. Each batch of texts gets an inverted index of the trigrams that the queries use
(trigram -> numbers of the texts that hold it); a rule's postings are intersected and united as
its query says, and only the texts left are searched with the expression. A rule without
mandatory trigrams searches every text of the batch. An index segment lives for one batch, so
memory is bounded and a lost task is simply run again; nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as ops
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm.common import LOWER, bounded_batches, text_bytes


@dataclass(frozen=True)
class Rule:
    """A kind of secret: expression, the group whose length counts (0: whole match), least length."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# The base rules, then well-known public token formats.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 39),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("url_password", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@]+:([^\s:/@]+)@", 4, 1),
)

#: Most strings kept while a run of literals is multiplied out.
_MOST = 64
TRUE = ("and", ())


def _all(parts):
    parts = tuple(dict.fromkeys(p for p in parts if p != TRUE))
    return parts[0] if len(parts) == 1 else ("and", parts)


def _any(parts):
    parts = sorted(set(parts), key=lambda q: (len(trigrams(q)), str(q)))
    flat = [isinstance(q, str) or all(isinstance(x, str) for x in q[1]) and q[0] == "and" for q in parts]
    # an "and" that asks for more than another one adds nothing to the union
    parts = tuple(q for i, q in enumerate(parts) if not any(flat[i] and flat[j] and trigrams(parts[j]) <= trigrams(q) for j in range(i)))
    return TRUE if TRUE in parts else parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings):
    """Trigrams of a place that holds one of the given strings."""
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _exact(op, arg):
    """The few strings that an element can match (lower-cased), or None."""
    if op is ops.LITERAL:
        return {chr(arg).lower()}
    if op is ops.IN and all(o is ops.LITERAL for o, _ in arg) and len(arg) <= 8:
        return {chr(a).lower() for _, a in arg}
    if op is ops.SUBPATTERN:
        return _exact_run(arg[3])
    if op is ops.BRANCH:
        each = [_exact_run(b) for b in arg[1]]
        return None if None in each else set().union(*each)
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[1] == 1:
        inner = _exact_run(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _exact_run(seq):
    strings = {""}
    for op, arg in seq:
        more = _exact(op, arg)
        if more is None or len(strings) * len(more) > _MOST:
            return None
        strings = {a + b for a in strings for b in more}
    return strings


def _query(seq):
    parts, run = [], {""}
    for op, arg in seq:
        strings = _exact(op, arg)
        if strings is not None and len(run) * len(strings) <= _MOST:
            run = {a + b for a in run for b in strings}
            continue
        parts.append(_of_strings(run))
        run = {""} if strings is None else strings
        if op is ops.SUBPATTERN:
            parts.append(_query(arg[3]))
        elif op is ops.BRANCH:
            parts.append(_any(_query(b) for b in arg[1]))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[0] > 0:
            parts.append(_query(arg[2]))
    return _all([*parts, _of_strings(run)])


def trigram_query(pattern: str):
    """Boolean query that the lower-cased text of every match satisfies: a trigram, or ("and"
    or "or", parts); TRUE where no trigram is mandatory."""
    return _query(_parser.parse(pattern))


def trigrams(query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


def candidates(query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Numbers of the texts that satisfy a query."""
    if query == TRUE:
        return np.arange(n)
    if isinstance(query, str):
        return postings[query]
    each = [candidates(q, postings, n) for q in query[1]]
    return reduce(np.intersect1d if query[0] == "and" else np.union1d, each)


_CHUNK = 1 << 20


def _code(gram: str) -> int:
    """Number of a trigram's first three bytes (all of it but for letters beyond ASCII)."""
    return int.from_bytes(gram.encode()[:3], "big")


def wanted_trigrams(grams: set[str]) -> np.ndarray:
    """A table over all three-byte numbers (16 MB a worker): which of them queries use."""
    table = np.zeros(1 << 24, dtype=bool)
    table[[_code(g) for g in grams]] = True
    return table


def index_segment(texts: list[bytes], grams: set[str], wanted: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Inverted index of lower-cased texts, restricted to the trigrams that queries use: every
    text's trigrams are taken once and looked up in ``wanted``, so the work follows the bytes of
    the texts and not the number of rules. Long runs of texts go through in chunks."""
    wanted = wanted_trigrams(grams) if wanted is None else wanted
    # Two zero bytes end each text, so no trigram of letters spans two texts.
    ends = np.cumsum([len(t) + 2 for t in texts]) if texts else np.zeros(0, dtype=np.int64)
    whole = np.frombuffer(b"".join(t.translate(LOWER) + b"\0\0" for t in texts), dtype=np.uint8)
    codes, owners = [], []
    for lo in range(0, max(len(whole) - 2, 0), _CHUNK):
        part = whole[lo : lo + _CHUNK + 2].astype(np.uint32)
        code = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
        at = np.flatnonzero(wanted[code])
        pairs = np.unique(np.stack([code[at].astype(np.int64), np.searchsorted(ends, at + lo, side="right")], axis=1), axis=0)
        codes.append(pairs[:, 0])
        owners.append(pairs[:, 1])
    code, owner = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (codes, owners))
    order = np.lexsort((owner, code))
    code, owner = code[order], owner[order]

    def posting(gram):
        lo, hi = np.searchsorted(code, [_code(gram), _code(gram) + 1])
        return np.unique(owner[lo:hi])

    return {g: posting(g) for g in sorted(grams)}


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(rules: tuple[Rule, ...]):
    def run(batches):
        queries = [trigram_query(r.pattern) for r in rules]
        grams = set().union(*(trigrams(q) for q in queries))
        wanted = wanted_trigrams(grams)
        patterns = [re.compile(r.pattern, re.ASCII) for r in rules]
        for b in batches:
            texts = [t or b"" for t in text_bytes(b.column("text"))]
            postings = index_segment(texts, grams, wanted)
            found: list[list] = [[] for _ in texts]
            decoded: dict[int, str] = {}
            for order, (rule, query, pattern) in enumerate(zip(rules, queries, patterns, strict=True)):
                for i in candidates(query, postings, len(texts)):
                    if i not in decoded:
                        decoded[i] = texts[i].decode("utf-8", "replace")
                    for m in pattern.finditer(decoded[i]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[i].append((m.start(), order, m.end()))
            spans = [[{"kind": rules[o].kind, "start": s, "end": e} for s, o, e in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, _SPANS)], names=["doc_id", "spans"])

    return run


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """One row per input row: doc_id, spans (kind, start, end in code points, end exclusive;
    leftmost non-overlapping matches of each rule, too short ones dropped; by start, then in the
    order of the rules). Needs doc_id and text; other columns are ignored.

    Defined cases: null and empty texts have no spans; repeated rows each get a row; a null
    doc_id is kept; an empty table gives an empty result."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan(tuple(rules)), f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")
