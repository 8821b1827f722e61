import random

import numpy as np
import pyarrow as pa
import pytest
from brute import components, edge_rows, empty, frame, key

from ledgerlens.llm import ngram_join
from ledgerlens.llm.components import connected_components


def family(n_base, copies, words, seed, edits):
    rnd = random.Random(seed)
    rows = []
    for b in range(n_base):
        base = [f"b{b}w{rnd.randrange(400)}" for _ in range(rnd.randint(*words))]
        for _ in range(copies):
            t = list(base)
            for _ in range(rnd.randint(*edits)):
                t[rnd.randrange(len(t))] = f"e{rnd.randrange(10**6)}"
            rows.append("common line here " * rnd.randint(0, 1) + " ".join(t))
    rnd.shuffle(rows)
    return [(i, t, "en", "s", 1) for i, t in enumerate(rows)]


def same(df, rows, k, num):
    """Components, and components with the number of every row's links."""
    want = sorted(((r[0], *c) for r, c in zip(rows, components([r[:2] for r in rows], k, num), strict=True)), key=key)
    out = ngram_join.jaccard_components(df, k, num, 100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=key) == [w[:3] for w in want]
    counted = ngram_join.jaccard_components(df, k, num, 100, every_link=True).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in counted), key=key) == want
    assert sorted(r.component_rows for r in out) == sorted(r.component_rows for r in counted)


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_equals_all_pairs_with_many_small_blocks(spark, monkeypatch, k, num):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ngram_join, "BLOCK_QUERIES", 20)
    monkeypatch.setattr(ngram_join, "LEADS", 2)
    monkeypatch.setattr(ngram_join, "PURE", 9)
    monkeypatch.setattr(ngram_join, "HOT_SETS", 8)
    rows = family(3, 60, (60, 120), 3, (0, 5)) + [(1000 + i, r[1], None, None, None) for i, r in enumerate(family(40, 3, (1, 30), 4, (0, 1)))]
    same(frame(spark, rows), rows, k, num)


def test_a_family_of_a_third_of_all_rows(spark, monkeypatch):
    """Near copies join in the first round: later rounds compare few of them."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ngram_join, "PURE", 16)
    monkeypatch.setattr(ngram_join, "HOT_SETS", 8)
    asked = []
    compared = ngram_join._compared

    def counted(base, nodes, members, asks, *a):
        asked.append(asks.count())
        return compared(base, nodes, members, asks, *a)

    monkeypatch.setattr(ngram_join, "_compared", counted)
    rows = family(1, 300, (150, 150), 5, (0, 2)) + [(1000 + i, r[1], "en", "s", 1) for i, r in enumerate(family(600, 1, (20, 60), 6, (0, 0)))]
    out = ngram_join.jaccard_components(frame(spark, rows), 5, 80, 100).collect()
    want = components([r[:2] for r in rows], 5, 80)
    assert {r.doc_id: r.component_id for r in out} == {r[0]: c[1] for r, c in zip(rows, want, strict=True)}
    assert asked[0] <= len(rows) and sum(asked[1:]) <= 100  # 300 sets in 19 blocks would ask some 2,800 times


def test_sets_are_matched_on_their_rarest_slots(spark):
    """40 sets with two common slots are never matched on these; linked ones keep a shared slot."""
    held = [(k, i, 3, i, 0, 0) for i in range(40) for k in (1, 2, 100 + i // 2, 200 + i // 2)]
    held = spark.createDataFrame(held, "key long, sig long, tag int, grp long, block int, rank long")
    matrix = held.selectExpr("key", "grp as to_grp", "block as to_block", "rank as to_rank").distinct()
    rows = ngram_join._rarest(held, matrix).collect()
    assert sorted((r.sig, r.key) for r in rows) == sorted((i, k) for i in range(40) for k in (100 + i // 2, 200 + i // 2))
    asks = ngram_join._asked(held, matrix, "to_grp < grp").collect()
    assert sorted((r.sig, r.grp) for r in asks) == [(i, i - 1) for i in range(1, 40, 2)]


def test_edge_rows_and_empty_table(spark):
    rows = edge_rows()
    same(frame(spark, rows, clash=True), rows, 3, 90)
    assert ngram_join.jaccard_components(empty(spark)).count() == 0
    assert ngram_join.keep_one(empty(spark)).count() == 0


def test_keep_one_leaves_the_first_of_each_group_and_all_columns(spark):
    rows = edge_rows()
    df = frame(spark, rows, clash=True)
    out = ngram_join.keep_one(df, 5, 80, 100)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=lambda x: (x is None, x)) == [1, 2, 3, 4, 6, 7, 8, None]


def test_every_linked_pair_shares_the_needed_slots():
    rnd = random.Random(9)
    for num in (80, 90):
        bands = ngram_join.Bands(num, 100)
        for _ in range(400):
            n = rnd.choice([9, 10, 11, 20, 50, 200])
            a = np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], dtype=np.uint64))
            b = a.copy()
            while True:
                c = np.unique(np.concatenate((np.delete(b, rnd.randrange(len(b))), np.array([rnd.getrandbits(64)][: rnd.randint(0, 1)], dtype=np.uint64))))
                both = len(np.intersect1d(a, c))
                if 100 * both < num * (len(a) + len(c) - both):
                    break
                b = c
            ka, kb = ({k: t for ks, t in bands.keys(x) for k in ks.tolist()} for x in (a, b))
            if len(b) == len(a) and (a == b).all():
                continue
            shared = set(ka) & set(kb)
            assert any(sum(ka[s] == t for s in shared) >= t % 64 for t in set(ka.values())) and shared


def test_every_threshold_has_finite_slots():
    for num in (30, 50, 80, 90, 95):
        bands = ngram_join.Bands(num, 100)
        assert len(bands.slots) == len(bands.slack) == len(bands.tops)
        for n in (1, 2, 9, 40, 300):
            tokens = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
            for keys, tag in bands.keys(tokens):
                assert 1 <= tag % 64 <= len(keys)


def test_shared_runs_over_any_batch_cut():
    rnd = random.Random(2)
    rows = sorted((rnd.randrange(12), rnd.randrange(6), 5) for _ in range(60))
    want = []
    for k in {r[0] for r in rows}:
        sigs = sorted({r[1] for r in rows if r[0] == k})
        if len(sigs) > 1:
            want += [(k, s, 5, sigs[0]) for s in sigs]
    for size in (1, 2, 3, 7, 60):
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = (pa.RecordBatch.from_arrays([pa.array([r[c] for r in b], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], names=["key", "sig", "tag"]) for b in cut)
        got = [t for b in ngram_join.shared_runs(batches) for t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert sorted(got) == sorted(want)


def test_connected_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(150)] + [(7, 7)]
    label = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    out = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.label for r in out.collect()} == {x: label[x] for x in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
