import random
import re
from collections import Counter

import pytest
from brute import blank_words, edge_rows, empty, frame, key

from ledgerlens.llm import quality_rules


def counts(text):
    text = text or ""
    w = blank_words(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if blank_words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_base_counts_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = edge_rows()
    for i in range(40):
        t = [rnd.choice("ab#c$ <d> é f|g".split()) for _ in range(rnd.randint(0, 60))]
        if i % 2:
            t += t[3:20] * rnd.randint(1, 3)
        rows.append((100 + i, rnd.choice(["\n", "\n\n", " \n", "\t"]).join(" ".join(t[j : j + 5]) for j in range(0, len(t), 5)), None, None, None))
    out = quality_rules.text_statistics(frame(spark, rows, clash=True)).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out), key=key)
    assert got == sorted(((r[0], *counts(r[1])) for r in rows), key=key)


def prose(rnd, n=120):
    words = [rnd.choice("the small river runs under old stone bridges and people walk home".split()) + str(rnd.randrange(90)) * (rnd.random() < 0.1) for _ in range(n)]
    return ".\n".join(" ".join(words[i : i + 9]) for i in range(0, n, 9)) + "."


def test_posteriors_part_damaged_texts_from_prose(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd), None, None, None) for i in range(90)]
    rows += [(200 + i, " | ".join(prose(rnd).split()), None, None, None) for i in range(6)]
    rows += [(300 + i, "!! ".join(prose(rnd).upper().split()), None, None, None) for i in range(6)]
    rows += [(400 + i, "\n".join(["same line again."] * 30), None, None, None) for i in range(6)]
    out = quality_rules.quality_posteriors(frame(spark, rows)).collect()
    assert all((r.quality >= 0.5) == (r.doc_id < 200) for r in out)


def test_estimate_equals_plain_em(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(400):
        good = rnd.random() < 0.8
        rows.append(tuple(rnd.choices((-1, 0, 1), (1, 4, 5) if good else (6, 3, 1))[0] for _ in range(3)))
    names = ["a", "b", "c"]
    prior, ratio = quality_rules.estimate(spark.createDataFrame(rows, "a int, b int, c int"), names, rounds=3)

    from math import exp, log

    belief, w = quality_rules.BELIEF, quality_rules.BELIEF_WEIGHT * len(rows)
    p, lr = log(4), {r: {v: log(belief[1][v] / belief[-1][v]) if v else 0.0 for v in (-1, 0, 1)} for r in names}
    for _ in range(3):
        post = [1 / (1 + exp(-(p + sum(lr[n][v] for n, v in zip(names, r, strict=True))))) for r in rows]
        g, b = sum(post), len(rows) - sum(post)
        p = max(0.0, log((g + 0.8 * w) / (b + 0.2 * w)))
        for i, n in enumerate(names):
            for v in (-1, 1):
                gv = sum(x for x, r in zip(post, rows, strict=True) if r[i] == v)
                bv = sum(1 - x for x, r in zip(post, rows, strict=True) if r[i] == v)
                x = log((gv + w * belief[1][v]) / (g + w)) - log((bv + w * belief[-1][v]) / (b + w))
                lr[n][v] = v * max(0.0, v * x)
    assert prior == pytest.approx(p)
    assert all(ratio[n][v] == pytest.approx(lr[n][v]) for n in names for v in (-1, 1))


def test_edge_rows_and_empty_table(spark):
    rows = edge_rows()
    out = quality_rules.quality_posteriors(frame(spark, rows)).collect()
    assert len(out) == len(rows) and all(0 <= r.quality <= 1 for r in out)
    assert quality_rules.quality_posteriors(empty(spark)).count() == 0
