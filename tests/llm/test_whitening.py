"""Embedding whitening against numpy's eigendecomposition of the whole matrix."""

import math
import random

import numpy as np

from ledgerlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, d, seed=1, spread=None):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, d)) * (np.linspace(0.1, 2, d) if spread is None else spread)
    return [(i, [float(np.float32(v)) for v in row], 0) for i, row in enumerate(x)]


def plain(rows, k):
    """vec_id -> (deviation, whitened) rows, explained shares; the integers as the contract has them."""
    x = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, _ in rows]
    n, d = len(x), len(x[0][1])
    s = [sum(v[j] for _, v in x) for j in range(d)]
    deviation = [sum((n * v[j] - s[j]) ** 2 for j in range(d)) for _, v in x]
    y = np.array([[v[j] - 1_000_000 for j in range(d)] for _, v in x], dtype=float)
    y -= y.mean(0)
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return [i for i, _ in x], deviation, y @ axes / np.sqrt(values), values / (y * y).sum() * n


def result(spark, rows, k=32, parts=3, extra=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    if extra:
        df = df.selectExpr("*", "1 AS id", "2 AS vector", "3 AS component", "4 AS n")
    out = whitening.whiten(df, components=k).collect()
    return sorted(out, key=lambda r: (r.vec_id is None, r.vec_id or 0, r.component))


def check(rows, got, k):
    ids, deviation, white, explained = plain(rows, k)
    assert [(r.vec_id, r.component) for r in got] == [(i, c) for i in ids for c in range(1, k + 1)]
    assert [r.deviation for r in got] == [v for v in deviation for _ in range(k)]
    assert {r.n for r in got} == {len(rows)}
    mine = np.array([r.whitened for r in got]).reshape(len(ids), k)
    signs = np.sign((mine * white).sum(0))
    assert np.abs(mine * signs - white).max() < 1e-7
    assert np.abs(np.array([r.explained for r in got[:k]]) / explained - 1).max() < 1e-9
    error = np.abs(mine.T @ mine / len(ids) - np.eye(k)).max()
    assert error < 1e-9 and all(r.identity_error < 1e-9 for r in got)


def test_equals_the_whole_matrix(spark):
    rows = vectors(400, 20)
    check(rows, result(spark, rows, 8), 8)
    check(rows, result(spark, rows, 20, parts=1, extra=True), 20)
    # more tasks than one combining round takes
    check(rows, result(spark, rows, 8, parts=40), 8)


def test_fewer_dimensions_than_components(spark):
    rows = vectors(50, 3)
    check(rows, result(spark, rows, 32), 3)


def test_equal_variances_and_a_hot_vector(spark):
    """Equal eigenvalues have no axes of their own: the space and the identity are what counts."""
    cube = [(i, [float(i >> j & 1) for j in range(5)], 0) for i in range(32)]
    got = result(spark, cube, 5)
    white = np.array([r.whitened for r in got]).reshape(32, 5)
    assert np.abs(white.T @ white / 32 - np.eye(5)).max() < 1e-12
    assert {round(r.explained, 12) for r in got} == {0.2}
    rows = vectors(200, 12)
    rows = [(i, rows[0][1] if i % 3 == 0 else v, 0) for i, v, _ in rows]
    check(rows, result(spark, rows, 12), 12)


def test_unusable_rows(spark):
    rows = vectors(60, 6)
    bad = [
        (100, None, 1),
        (101, [0.5, None, 0.5, 0.5, 0.5, 0.5], 1),
        (102, [0.5, float("nan"), 0.5, 0.5, 0.5, 0.5], 1),
        (103, [float("inf"), 0.5, 0.5, 0.5, 0.5, 0.5], 1),
        (104, [0.5] * 5, 1),
        (105, [], 1),
        (106, [3e38] * 6, 1),
    ]
    check(rows, result(spark, rows + bad, 6), 6)


def test_repeated_rows_and_null_ids(spark):
    rows = vectors(40, 4)
    rows = rows + rows[:5] + [(None, rows[7][1], None)]
    got = result(spark, rows, 4)
    assert len(got) == 46 * 4 and {r.n for r in got} == {46}
    assert [r.component for r in got[-4:]] == [1, 2, 3, 4] and got[-1].vec_id is None
    by_id = {r.vec_id: r for r in got if r.component == 1}
    assert by_id[None].whitened == by_id[7].whitened


def test_no_variance(spark):
    got = result(spark, [(i, [0.5, 0.25, 0.125], 0) for i in range(5)])
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in got] == [(0.0, 0.0, 0.0, 0)] * 15
    # a plane in space: the third component has no variance
    rnd = random.Random(2)
    rows = [(i, [(a := rnd.randint(-9, 9)) / 4, (b := rnd.randint(-9, 9)) / 4, (a + b) / 4], 0) for i in range(80)]
    got = result(spark, rows)
    assert [r.whitened for r in got if r.component == 3] == [0.0] * 80
    assert all(r.identity_error < 1e-9 for r in got) and got[2].explained == 0.0
    assert result(spark, rows[:1])[0].whitened == 0.0


def test_empty_tables(spark):
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns[:2] == ["vec_id", "component"]
    assert result(spark, [(1, None, 0), (2, [], 0)], parts=2) == []


def test_large_numbers_stay_exact(spark):
    """Sums and deviations beyond 53 bits; a deviation beyond 63 bits is null."""
    rnd = random.Random(3)
    rows = [(i, [float(np.float32(rnd.uniform(-1e4, 1e4))) for _ in range(3)], 0) for i in range(30)]
    check(rows, result(spark, rows, 3), 3)
    huge = [(i, [1e12 * i, 0.0], 0) for i in range(4)]
    assert all(r.deviation is None for r in result(spark, huge) if r.vec_id in (0, 3))


def test_rank_one_updates():
    rnd = np.random.default_rng(7)
    for kind in range(6):
        d = 12
        a = rnd.normal(size=(30, d)) * (10.0 ** -np.arange(d) if kind == 1 else 1)
        if kind == 2:
            a[:, 5:] = 0
        if kind == 3:
            a[::2] = a[0]
        if kind == 4:
            a = np.round(a)
        if kind == 5:
            a = np.repeat(np.eye(d), 4, axis=0)
        s, t = whitening.Spectrum(d), whitening.Spectrum(d)
        s.add(a[:11]), t.add(a[11:])
        s.merge(t)
        c = a - a.mean(0)
        scale = np.linalg.eigvalsh(c.T @ c)[-1]
        assert np.abs(s.basis.T @ s.basis - np.eye(d)).max() < 1e-12
        assert np.abs(s.basis @ np.diag(s.values) @ s.basis.T - c.T @ c).max() < 1e-12 * scale
