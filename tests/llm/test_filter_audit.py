"""Filter audit: every order played document by document."""

from fractions import Fraction
from itertools import permutations

from pyspark.sql import functions as F

from ledgerlens.llm import filter_audit
from tests.llm import brute

LABELS = "doc_id long, quality int, toxic int"


def failures(text, doc_id, first):
    t = text or ""
    w = brute.blank_words(t)
    return {
        "A": len(w) < 200,
        "B": 100 * len(set(w)) < 50 * len(w),
        "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
        "D": any(c in "#$%&*|" for c in t),
        "E": doc_id is not None and first[t] is not None and first[t] < doc_id,
    }


def played(rows, labels):
    """(part, order, step) -> counts, by running every order over every document."""
    first = {}
    for r in rows:
        t = r[1] or ""
        first[t] = min((x for x in (first.get(t), r[0]) if x is not None), default=None)
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, x in labels if x == 1} - {None}
    out = {}
    for part in {r[2] or "" for r in rows}:
        docs = [(r[0], failures(r[1], r[0], first)) for r in rows if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                failing = sum(d[1][f] for d in docs)
                only = sum(d[1][f] and sum(d[1].values()) == 1 for d in docs)
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), only, sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def result(spark, rows, labels, clash=False):
    df = filter_audit.audit(filter_audit.failure_counts(brute.frame(spark, rows, clash), spark.createDataFrame(labels, LABELS)))
    return {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in df.collect()}


def test_equals_every_order_played(spark):
    words = " ".join(f"w{i}" for i in range(220))
    rows = [
        *brute.edge_rows(),
        (20, words, "en", "a", 1),
        (21, words, "de", "a", 1),
        (22, words, "en", "a", 1),
        (22, words, "en", "a", 1),
        (23, words + " $", "en", "a", 1),
        (24, words.upper(), "en", "a", 1),
        (25, "la " * 300, "de", "a", 1),
        (26, "LA| " * 100, "", "a", 1),
    ]
    labels = [(20, 1, 0), (20, 1, None), (22, 1, 1), (25, 0, 1), (26, None, None), (None, 1, 1), (99, 1, 1)]
    got = result(spark, rows, labels)
    assert got == played(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    assert result(spark, rows, labels, clash=True) == got


def test_a_text_shared_by_a_third_of_all_rows(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", "en", "a", 1) for i in range(600)]
    got = result(spark, rows, [(0, 1, 0), (3, 1, 1)])
    assert got["en", "EABCD", 1] == [401, 199, 0, 0, 1, 1, 120 * 0 + sum(v[1] for (_, o, s), v in got.items() if o[s - 1] == "E")]
    assert got["en", "AEBCD", 2][:3] == [0, 0, 199]


def test_empty_tables(spark):
    counts = filter_audit.failure_counts(brute.empty(spark), spark.createDataFrame([], LABELS))
    assert filter_audit.audit(counts).collect() == []
    one = filter_audit.failure_counts(brute.frame(spark, [(1, "x", "en", "a", 1)]), spark.createDataFrame([], LABELS))
    assert filter_audit.audit(one).count() == 600


def test_least_squares_gives_shapley_values():
    counts = {0: 5, 1: 7, 3: 2, 6: 4, 21: 9, 31: 1, 16: 3}
    v = filter_audit.coalition_values(counts, 5)
    plain = [Fraction(0)] * 5
    for order in permutations(range(5)):
        before = 0
        for i in order:
            plain[i] += Fraction(v[before | 1 << i] - v[before], 120)
            before |= 1 << i
    assert filter_audit.shapley_by_least_squares(v, 5) == plain
    assert filter_audit.shapley_by_least_squares(v[:2], 1) == [v[1]]


def test_other_filters(spark):
    """Any set of filters may be audited."""
    docs = brute.frame(spark, [(1, "aa b", "en", "a", 1), (2, "c", "en", "a", 1)])
    counts = filter_audit.failure_counts(docs, spark.createDataFrame([], LABELS), lambda t: {"X": t.contains("a"), "Y": F.length(t) > 1}, copies=None)
    rows = filter_audit.audit(counts, "XY").orderBy("filter_order", "step").collect()
    assert [(r.filter_order, r.step, r.kept, r.removed, r.redundant, r.shapley) for r in rows] == [("XY", 1, 1, 1, 0, 1), ("XY", 2, 1, 0, 1, 1), ("YX", 1, 1, 1, 0, 1), ("YX", 2, 1, 0, 1, 1)]
