import math
import random
import re
import textwrap

import numpy as np
from brute import edge_rows, empty, frame, key

from ledgerlens.llm import importance_sampling, licences
from ledgerlens.llm.common import word_table


def test_kth_largest_equals_sorting(spark):
    rnd = random.Random(1)
    vals = [rnd.choice([rnd.gauss(0, 1e6), 0.0, 1.5, -1e-300]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "key double")
    for k in (1, 2, 77, 250, 499, 500):
        assert importance_sampling.kth_largest(df, k) == sorted(vals, reverse=True)[k - 1]
    assert importance_sampling.kth_largest(df, 0) is None and importance_sampling.kth_largest(df, 501) is None


def test_weights_equal_plain_models_and_sample_has_its_size(spark):
    rnd = random.Random(2)
    good, bad = "calm clear river stone bridge".split(), "zzz ### buy !!! now".split()
    rows = [(i, " ".join(rnd.choice(good if i % 3 else bad) for _ in range(30)), None, None, None) for i in range(120)] + edge_rows()
    target = spark.createDataFrame([(i,) for i in range(120) if i % 3 and i % 2] + [(None,)], "doc_id long")
    out = importance_sampling.resample(frame(spark, rows, clash=True), target, share=0.5).collect()
    table = word_table("blank")
    counts = np.full((2, importance_sampling.CELLS), importance_sampling.PSEUDO)
    for d, t, *_ in rows:
        c = importance_sampling.cells_of((t or "").encode(), table)
        np.add.at(counts[0], c, 1)
        if d is not None and d < 120 and d % 3 and d % 2:
            np.add.at(counts[1], c, 1)
    p = np.log(counts / counts.sum(axis=1, keepdims=True))
    want = sorted(((d, round(float((p[1] - p[0])[importance_sampling.cells_of((t or "").encode(), table)].sum()), 5)) for d, t, *_ in rows), key=key)
    got = sorted(((r.doc_id, round(r.log_weight, 5)) for r in out), key=key)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(math.isclose(g[1], w[1], rel_tol=1e-6, abs_tol=1e-4) for g, w in zip(got, want, strict=True))
    kept = [r for r in out if r.kept]
    assert len(kept) in (round(0.5 * len(rows)), round(0.5 * len(rows)) + 1)
    assert min(r.sample_key for r in kept) > max(r.sample_key for r in out if not r.kept)


def test_resample_without_targets_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long")
    out = importance_sampling.resample(frame(spark, edge_rows()), none, 0.4).collect()
    assert {r.log_weight for r in out} == {0.0}
    assert importance_sampling.resample(empty(spark), none, 0.4).count() == 0


def pairs(text):
    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    return set(zip(w, w[1:], strict=False))


def test_licences_equal_comparing_all_units_with_all_templates(spark):
    rnd = random.Random(3)
    rows = edge_rows()
    for i in range(60):
        name, t = rnd.choice(licences.TEMPLATES)
        w = t.split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(["the", "foo", "License", ""])
        cut = rnd.randrange(len(w))
        rows.append((100 + i, rnd.choice(["prose before\n", ""]) + " ".join(w[:cut]) + rnd.choice(["\n", " "]) + " ".join(w[cut:]) + rnd.choice(["\nmore prose.", ""]), None, None, None))
    out = licences.scan_licences(frame(spark, rows, clash=True)).collect()
    want = []
    for d, text, *_ in rows:
        found = []
        for unit, part in enumerate([text, *text.split("\n")] if text is not None else []):
            a = pairs(part)
            each = [(2 * len(a & (b := pairs(t))) / (len(a) + len(b)), n) for n, t in licences.TEMPLATES if a]
            if each and max(each)[0] >= licences.THRESHOLD:
                found.append((unit, max(each)[1], round(max(each)[0], 9)))
        want.append((d, found))
    got = sorted(((r.doc_id, [(m.unit, m.name, round(m.dice, 9)) for m in r.matches]) for r in out), key=key)
    assert got == sorted(want, key=key)
    assert sum(bool(m) for _, m in got) > 20
    assert licences.scan_licences(empty(spark)).count() == 0


def spans_by_trying_all(text):
    """Every word span against every template, then those furthest over the threshold that share no word."""
    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    found = []
    for name, t in licences.TEMPLATES:
        b = pairs(t)
        for i in range(len(w)):
            a = set()
            for j in range(i + 1, len(w)):
                a.add((w[j - 1], w[j]))
                both = len(a & b)
                if 2.0 * both / (len(a) + len(b)) >= licences.THRESHOLD:
                    found.append((licences.THRESHOLD * (len(a) + len(b)) - 2.0 * both, j - i, name, i, j + 1, 2.0 * both / (len(a) + len(b))))
    taken = []
    for s in sorted(found):
        if not any(s[3] < x[4] and x[3] < s[4] for x in taken):
            taken.append(s)
    return sorted((s[3], s[4], s[2], round(s[5], 9)) for s in taken)


def wrapped(text, width, mark=""):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


def test_notices_wrapped_commented_and_embedded_equal_trying_all_spans(spark):
    rnd = random.Random(6)
    prose = "river stone the software bridge and calm the license of light".split()
    rows = [(i, t, None, None, None) for i, (_, t, *_) in enumerate(edge_rows()) if t is None or len(t) < 2000]
    for i in range(40):
        w = rnd.choice(licences.TEMPLATES)[1].split()[:60]
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(["the", "foo", "License", "of the"])
        body = [rnd.choice(prose) for _ in range(rnd.randint(0, 30))] + w + [rnd.choice(prose) for _ in range(rnd.randint(0, 30))]
        if i % 4 == 0:
            body += rnd.choice(licences.TEMPLATES[:15])[1].split() + w[: rnd.randint(1, len(w))]
        rows.append((100 + i, wrapped(" ".join(body), rnd.choice([30, 75, 5000]), rnd.choice(["", "# ", " * "])), None, None, None))
    rows += [rows[-1], (None, *rows[-1][1:]), (None, *rows[-1][1:])]
    got = sorted(((r.doc_id, [(s.start, s.end, s.name, round(s.dice, 9)) for s in r.spans]) for r in licences.scan_licences(frame(spark, rows, clash=True)).collect()), key=key)
    assert got == sorted(((d, spans_by_trying_all(t or "")) for d, t, *_ in rows), key=key)
    assert sum(bool(s) for _, s in got) > 25


def test_full_texts_and_comment_headers_inside_files_are_found(spark):
    full = {n: t for n, t in licences.TEMPLATES if n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0") or n.endswith("-or-later")}
    code = "\n".join(f"int f{i}(int x) {{ return x + {i}; }}" for i in range(300))
    names = sorted(full)
    rows = [(i, wrapped(f"Copyright (c) 2020 Some Body. {full[n]}", 72), None, None, None) for i, n in enumerate(names)]
    rows += [(100 + i, "/*\n" + wrapped(f"Copyright 2020 Some Body. {full[n]}", 72, " * ") + "\n */\n" + code, None, None, None) for i, n in enumerate(names)]
    gpl = "and this work is licensed under the GNU General Public License, version 3, as you may know"
    rows += [(200, f"{code}\nA long line of words before it {gpl} {code}", None, None, None), (201, code, None, None, None)]
    out = {r.doc_id: r for r in licences.scan_licences(frame(spark, rows)).collect()}
    for i, n in enumerate(names):
        assert out[i].licences == out[100 + i].licences == [n] and out[i].n_matches and out[100 + i].best == n
    assert out[200].licences == ["GPL-3.0"] and out[200].dice == 1.0 and out[200].n_matches == 1
    assert not out[201].licences and out[201].n_matches == 0
