import random
import re

from brute import ALNUM_WORD, edge_rows, empty, frame, key, lower

from ledgerlens.llm import decontaminate

ITEMS = "item_id long, text string"


def expected(rows, items):
    wins = {}
    for item, text in items:
        w = re.findall(ALNUM_WORD, lower(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for d, text, *_ in rows:
        w = re.findall(ALNUM_WORD, lower(text))
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in wins[k] if x is not None}
        out.append((d, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=key)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"] or ())) for r in df.collect()), key=key)


def test_equals_brute_force(spark):
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 9, 10, 11, 40])))) for i in range(25)]
    items += [(None, items[3][1]), (4, items[4][1]), (90, None), (91, "..."), (92, "ZZ top")]
    rows = []
    for d in range(60):
        t = [rnd.choice(vocab) for _ in range(rnd.randint(0, 60))]
        if d % 3 == 0:
            p = items[rnd.randrange(25)][1].split()
            i = rnd.randrange(len(p))
            t[5:5] = p[i : i + rnd.randint(3, 25)]
        rows.append((d, ", ".join(t).upper() + (" zz-top" if d == 7 else ""), None, None, None))
    rows += edge_rows()
    out = decontaminate.benchmark_overlaps(frame(spark, rows, clash=True), spark.createDataFrame(items, ITEMS))
    assert got(out) == expected(rows, items)
    for r in out.where("n_hit > 0").collect():
        assert sum(s["end"] - s["start"] for s in r.spans) == r.n_hit


def test_every_shared_span_has_a_kept_fingerprint():
    import numpy as np

    rnd = np.random.default_rng(3)
    for _ in range(50):
        span = rnd.integers(0, 2**63, 6, dtype=np.uint64)
        a, b = (np.concatenate((rnd.integers(0, 2**63, rnd.integers(0, 9), dtype=np.uint64), span, rnd.integers(0, 2**63, 5, dtype=np.uint64))) for _ in range(2))
        kept = [set(x[decontaminate.winnow(x, 6)].tolist()) for x in (a, b)]
        assert kept[0] & kept[1] & set(span.tolist())


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    rows = edge_rows()
    assert got(decontaminate.benchmark_overlaps(frame(spark, rows), none)) == expected(rows, [])
    assert decontaminate.benchmark_overlaps(empty(spark), none).count() == 0
    assert decontaminate.without_overlaps(frame(spark, rows), spark.createDataFrame([(1, "two three four")], ITEMS)).count() == len(rows) - 3
