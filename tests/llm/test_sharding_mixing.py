import random
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from brute import blank_words, edge_rows, empty, frame, key

from ledgerlens.llm import hash_ring, mixing


def test_walk_fills_shards_to_their_bounds_going_clockwise():
    owners, counts, bounds = [0, 1, 2, 0], [5, 0, 1, 2], [3, 3, 2]
    out = hash_ring.walk(owners, counts, bounds)
    assert sum(r["hi"] - r["lo"] for r in out) == 8
    held = Counter()
    for r in out:
        held[r["shard"]] += r["hi"] - r["lo"]
    assert held == {0: 3, 1: 3, 2: 2}
    assert {"arc": 0, "lo": 3, "hi": 5, "shard": 1, "slot_lo": 0} in out


@pytest.mark.parametrize("n", [0, 5, 100, 701])
def test_shards_differ_by_one_row_at_most(spark, n):
    rows = [(i, f"text {i % 50}", None, None, None) for i in range(n)]
    rows += (edge_rows() + [(9, "same", None, None, None)] * 300) if n == 701 else []
    out = hash_ring.shard_rows(frame(spark, rows, clash=True), shards=24).collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 8, crc32((r[1] or "").encode())) for r in rows), key=key)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=key) == want
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)


def test_few_rows_move_when_a_shard_is_added(spark):
    rows = [(i, f"t{i}", None, None, None) for i in range(2000)]
    a, b = ({r.doc_id: r.shard for r in hash_ring.shard_rows(frame(spark, rows), s).collect()} for s in (24, 25))
    assert sum(a[i] != b[i] for i in a) < 0.15 * len(rows)


def targets(sizes):
    """sizes: source -> words; the excess over three times is reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest, weight = total - sum(3 * sizes[s] for s in capped), sum(w[s] for s in free)
        over = {s for s in free if rest * w[s] / weight > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else rest * w[s] / weight for s in order}
        capped |= over


def test_mix_meets_targets_and_reruns_agree(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 30)), None, rnd.choice(["a", "a", "a", "b", "c", None, "é"]), None) for i in range(1500)]
    rows += [(5000 + i, "w w", None, "tiny", None) for i in range(3)] + edge_rows()[:4] + [(9, "w w w", None, "a", None)] * 20
    df = frame(spark, rows, clash=True)
    out = mixing.mix_sources(df).collect()
    sizes = Counter()
    for d, t, _, s, _ in rows:
        sizes[s] += len(blank_words(t))
    want, taken = targets(sizes), Counter()
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.passes <= 3
        taken[r.source] += r.passes * r.size
    assert all(abs(taken[s] - want[s]) <= 31 for s in sizes)
    assert sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(tuple, out), key=key) == sorted(map(tuple, again), key=key)
    mix = mixing.take_mix(df)
    assert mix.columns == df.columns
    assert Counter(r.source for r in mix.collect()) == Counter({r.source: 0 for r in out}) + sum((Counter({r.source: r.passes}) for r in out), Counter())


def test_mix_follows_finish_times(spark):
    rows = [(i, "w " * (1 + i % 7), None, "ab"[i % 2], None) for i in range(400)]
    out = mixing.mix_sources(frame(spark, rows)).collect()
    b = [r for r in out if r.source == "b"]
    assert sum(r.passes for r in b) and max(r.passes for r in b) - min(r.passes for r in b) <= 1


def test_empty_and_wordless(spark):
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert mixing.take_mix(empty(spark)).count() == 0
    out = mixing.mix_sources(frame(spark, edge_rows()[:3])).collect()
    assert [(r.size, r.target, r.passes) for r in out] == [(0, 0.0, 0)] * 3
