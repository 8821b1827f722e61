"""Embedding whitening by incremental eigendecomposition.

Method: every task walks through its vectors once and keeps the eigendecomposition of their
scatter matrix: a new vector is a centred rank-one update, solved by the secular equation with
deflation (close eigenvalues are merged by a reflection, entries without weight are left alone),
eigenvectors from the recomputed update vector, so that they stay orthogonal (Gu and Eisenstat).
The tasks' spectra are combined in rounds of FAN: each eigenpair of one is a rank-one update of the
other, the difference of the means the last one. A final distributed Rayleigh-Ritz step projects the exactly
centred vectors on the basis found, sums the projected covariance and rotates the basis by its
eigenvectors; as the basis spans the whole space, the components are exact to double precision.

The vectors are integers x = floor(64 c) + 1000000. Sums are exact integers; the constant is left out of all
sums (it moves no difference from the mean), and vectors are centred by subtracting the integer part of the
mean exactly and then its fraction.

Size: a task and the driver hold a few d x d matrices (d the dimension), never vectors beyond one
Arrow batch; one such matrix per task is shuffled. Every round is written to
the checkpoint folder, so a lost executor repeats its own tasks only.

Edge cases: rows whose vector is null or holds null, NaN or infinite entries are dropped, as are
entries too large for a long (64 c beyond 2**62) and vectors whose length is not the most
frequent one (the greater of equally frequent ones; empty vectors count as null). A component without variance (at
most 1e-12 of the trace) has whitened 0, explained 0 and no part in identity_error. Repeated rows
count as often as they occur; a null id is kept. deviation is null where it exceeds a
long. An empty table, or one without usable vectors, gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import bounded_batches, stage
from ledgerlens.sources.parallelism import ensure_parallelism

#: Spectra (or partial sums) that one task of a combining round takes.
FAN = 16
#: Components with less than this share of the trace count as without variance.
NO_VARIANCE = 1e-12
_EPS = np.finfo(float).eps
_LARGEST = float(1 << 62)


# -- rank-one updates of an eigendecomposition ----------------------------------------------


def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum w_j / (d_j - x) for ascending distinct ``d`` and positive ``w``, one
    above each d_i: (nearest pole of each root, root minus that pole). All roots are iterated at
    once by rational interpolation of the two nearest poles, with a bracket for each."""
    m = len(d)
    i = np.arange(m)
    upper = np.append(d[1:], d[-1] + w.sum())
    half = (upper - d) / 2
    middle = d + half
    f = 1 + (w / (d[None, :] - middle[:, None])).sum(1)
    left = (f >= 0) | (i == m - 1)
    pole = np.where(left, i, np.minimum(i + 1, m - 1))
    lo = np.where(left, 0.0, -half)
    hi = np.where(left, half, 0.0)
    if f[-1] < 0:
        lo[-1], hi[-1] = half[-1], 2 * half[-1]
    tau = (lo + hi) / 2
    at, apart = i, d[None, :] - d[pole][:, None]
    lower = np.tri(m)
    for _ in range(100):
        gap = apart - tau[at][:, None]
        t = w / gap
        t2 = t / gap
        below = np.einsum("ij,ij->i", t2, lower)
        slope = t2.sum(1)
        value = 1 + t.sum(1)
        noise = 4 * _EPS * (value - 2 * np.einsum("ij,ij->i", t, lower))  # terms below are negative
        x = tau[at]
        lo[at] = np.where(value < 0, x, lo[at])
        hi[at] = np.where(value < 0, hi[at], x)
        done = (np.abs(value) <= noise) | (hi[at] - lo[at] <= _EPS * np.maximum(np.abs(lo[at]), np.abs(hi[at])))
        if done.all():
            break
        near = gap[np.arange(len(at)), at]
        last = at == m - 1
        far = np.where(last, 1.0, gap[np.arange(len(at)), np.minimum(at + 1, m - 1)])
        with np.errstate(all="ignore"):
            c = value - near * below - far * (slope - below)
            a = (near + far) * value - near * far * slope
            b = near * far * value
            r = np.sqrt(np.abs(a * a - 4 * b * c))
            step = np.where(a > 0, 2 * b / (a + r), (a - r) / (2 * c))
            step = np.where(last, near + near * near * below / (value - near * below), step)
            new = x + step
        inside = (new > lo[at]) & (new < hi[at])
        tau[at] = np.where(done, x, np.where(inside, new, (lo[at] + hi[at]) / 2))
        if done.sum() * 4 > len(at):
            at, apart, lower = at[~done], apart[~done], lower[~done]
    return pole, tau


def rank_one(values: np.ndarray, basis: np.ndarray, u: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigendecomposition (ascending) of basis diag(values) basis' + rho u u', rho >= 0."""
    z = u @ basis
    norm = float(np.sqrt(z @ z))
    if not norm or not rho:
        return values, basis
    z, rho = z / norm, rho * norm * norm
    tol = 8 * _EPS * max(abs(float(values[-1])), rho)
    close = np.diff(values) <= tol
    if close.any():
        basis = basis.copy()
        edge = np.flatnonzero(np.diff(np.concatenate(([False], close, [False])).view(np.int8)))
        for a, b in zip(edge[::2], edge[1::2] + 1, strict=True):
            v = z[a:b].copy()
            size = np.sqrt(v @ v)
            z[a:b] = 0
            if size:
                z[b - 1] = -size if v[-1] > 0 else size
                v[-1] -= z[b - 1]
                v /= np.sqrt(v @ v)
                basis[:, a:b] -= np.outer(basis[:, a:b] @ v, 2 * v)
    k = np.flatnonzero(rho * np.abs(z) > tol)
    if not len(k):
        return values, basis
    d, z = values[k], z[k]
    pole, tau = secular_roots(d, rho * z * z)
    gap = d[:, None] - d[pole][None, :] - tau[None, :]
    apart = d[None, :] - d[:, None]
    np.fill_diagonal(apart, 1.0)
    z = np.copysign(np.sqrt(np.abs(np.prod(-gap / apart, axis=1))), z)
    vectors = z[:, None] / gap
    vectors /= np.sqrt((vectors * vectors).sum(0))
    values, basis = values.copy(), basis.copy()
    values[k] = d[pole] + tau
    basis[:, k] = basis[:, k] @ vectors
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """Count, exact sums, mean and eigendecomposition of the scatter matrix of some vectors."""

    def __init__(self, dim: int):
        self.n, self.sums = 0, [0] * dim
        self.mean, self.values, self.basis = np.zeros(dim), np.zeros(dim), np.eye(dim)

    @classmethod
    def of(cls, state: dict) -> Spectrum:
        """From ``vars`` of another one."""
        out = cls(len(state["sums"]))
        vars(out).update(state)
        return out

    def add(self, y: np.ndarray) -> None:
        for row in y.astype(float):
            u = row - self.mean
            if self.n:
                self.values, self.basis = rank_one(self.values, self.basis, u, self.n / (self.n + 1))
            self.n += 1
            self.mean = self.mean + u / self.n
        self.sums = [a + b for a, b in zip(self.sums, exact_sums(y), strict=True)]

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self.values, self.basis = rank_one(self.values, self.basis, vector, float(value))
        u, n = other.mean - self.mean, self.n + other.n
        self.values, self.basis = rank_one(self.values, self.basis, u, self.n * other.n / n)
        self.mean = self.mean + u * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]


def exact_sums(y: np.ndarray) -> list[int]:
    """Column sums as Python integers."""
    if not len(y):
        return [0] * y.shape[1]
    if int(np.abs(y).max()) < (1 << 62) // len(y):
        return [int(x) for x in y.sum(0)]
    return [int(x) for x in y.astype(object).sum(0)]


# -- distributed steps ------------------------------------------------------------------------


def _integers(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the usable rows, their floor(64 c) as int64) of an Arrow list column."""
    import pyarrow as pa
    import pyarrow.compute as pc

    right = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(right)
    flat = pc.list_flatten(column.take(pa.array(at))).cast(pa.float64())
    c = flat.to_numpy(zero_copy_only=False).reshape(len(at), dim)  # null entries become NaN
    with np.errstate(all="ignore"):
        c = np.floor(64 * c)
    good = (np.abs(c) < _LARGEST).all(1)
    return at[good], c[good].astype(np.int64)


def _reduced(vectors: DataFrame, dim: int, fold: Callable[[Iterator[np.ndarray]], object], merge: Callable[[list], object], name: str):
    """Fold every task's vectors into a state of bounded size, combine the states in rounds of
    FAN and return the last one (None if there are no vectors)."""

    def of_task(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        state = fold(_integers(b.column(0), dim)[1] for b in batches)
        if state is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["task", "state"])

    def of_group(key, group):
        import pandas as pd

        states = [pickle.loads(x) for x in group.sort_values("task")["state"]]
        return pd.DataFrame({"task": [key[0]], "state": [pickle.dumps(merge(states))]})

    states = stage(vectors.mapInArrow(of_task, "task long, state binary"), f"{name}-tasks")
    while True:
        span = states.agg(F.count("*").alias("n"), F.max("task").alias("last")).first()
        if span["n"] <= 1:
            break
        groups = states.select(F.floor(F.col("task") / FAN).alias("grp"), "task", "state").groupBy("grp")
        states = stage(groups.applyInPandas(of_group, "task long, state binary"), f"{name}-round")
    got = states.first()
    return None if got is None else pickle.loads(got["state"])


def _spectrum(vectors: DataFrame, dim: int) -> Spectrum | None:
    def fold(matrices):
        s = Spectrum(dim)
        for y in matrices:
            s.add(y)
        return vars(s) if s.n else None

    def merge(states):
        first = Spectrum.of(states[0])
        for other in states[1:]:
            first.merge(Spectrum.of(other))
        return vars(first)

    state = _reduced(vectors, dim, fold, merge, "spectrum")
    return None if state is None else Spectrum.of(state)


class Centre:
    """Exact centring of integer vectors by sums / n."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole = n, [s // n for s in sums]
        self.rest = [s - n * w for s, w in zip(sums, self.whole, strict=True)]

    def _shifted(self, y: np.ndarray) -> np.ndarray:
        return y - np.array(self.whole, dtype=np.int64)

    def floats(self, y: np.ndarray) -> np.ndarray:
        return self._shifted(y).astype(float) - np.array([r / self.n for r in self.rest])

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n y - sums)**2, exact."""
        d = self._shifted(y)
        most = self.n * (int(np.abs(d).max()) + 1) if d.size else 0
        kind = np.int64 if most * most * max(1, d.shape[1]) < 1 << 63 else object
        e = d.astype(kind) * self.n - np.array(self.rest, dtype=kind)
        return [int(x) if x < 1 << 63 else None for x in (e * e).sum(1)]


def _projected_covariance(vectors: DataFrame, dim: int, centre: Centre, basis: np.ndarray) -> np.ndarray:
    def fold(matrices):
        h = np.zeros((dim, dim))
        for y in matrices:
            p = centre.floats(y) @ basis
            h += p.T @ p
        return h

    return _reduced(vectors, dim, fold, lambda hs: sum(hs[1:], hs[0]), "ritz") / centre.n


def _whitened_covariance(vectors: DataFrame, dim: int, centre: Centre, project: np.ndarray) -> np.ndarray:
    """Covariance of the whitened vectors themselves, from merged centred moments."""

    def joined(a, b):
        n = a[0] + b[0]
        u = b[1] - a[1]
        return (n, a[1] + u * (b[0] / n), a[2] + b[2] + np.outer(u, u) * (a[0] * b[0] / n))

    def fold(matrices):
        state = None
        for y in matrices:
            if len(y):
                p = centre.floats(y) @ project
                mean = p.mean(0)
                own = (len(p), mean, (p - mean).T @ (p - mean))
                state = own if state is None else joined(state, own)
        return state

    def merge(states):
        out = states[0]
        for s in states[1:]:
            out = joined(out, s)
        return out

    n, _, moment = _reduced(vectors, dim, fold, merge, "whitened")
    return moment / n


def common_length(vectors: DataFrame, vec_col: str) -> int:
    """The most frequent length of vectors without null or non-finite entries (0: there are none)."""
    c = F.col(vec_col)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sizes = vectors.where(c.isNotNull() & (F.size(c) > 0)).where(~bad).groupBy(F.size(c).alias("d")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32) -> DataFrame:
    """One row per usable vector and component (numbered from 1 by falling eigenvalue): see OUT."""
    spark = table.sparkSession
    bounded_batches(spark)
    narrow = table.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
    vectors = ensure_parallelism(narrow.select("vector"))
    dim = common_length(narrow, "vector")
    found = _spectrum(vectors, dim) if dim else None
    if found is None:
        return spark.createDataFrame([], f"`{id_col}` {table.schema[id_col].dataType.simpleString()}, {OUT}")
    centre = Centre(found.n, found.sums)
    basis, _ = np.linalg.qr(found.basis[:, ::-1])
    ritz, rotation = np.linalg.eigh(_projected_covariance(vectors, dim, centre, basis))
    k, trace = min(components, dim), float(ritz.sum())
    values = ritz[::-1][:k]
    axes = (basis @ rotation)[:, ::-1][:, :k]
    axes = axes / np.sqrt((axes * axes).sum(0))
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    varies = values > NO_VARIANCE * trace
    project = axes * np.where(varies, 1 / np.sqrt(np.where(varies, values, 1.0)), 0.0)
    explained = np.where(varies, values / trace if trace > 0 else 0.0, 0.0)
    error = 0.0
    if varies.any():
        covariance = _whitened_covariance(vectors, dim, centre, project[:, varies])
        error = float(np.abs(covariance - np.eye(int(varies.sum()))).max())

    def rows(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at, y = _integers(b.column(1), dim)
            white = centre.floats(y) @ project
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * k), pa.array(white.reshape(-1)))
            ids = b.column(0).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([ids, pa.array(centre.deviations(y), pa.int64()), lists], names=["id", "deviation", "w"])

    out = narrow.mapInArrow(rows, f"id {table.schema[id_col].dataType.simpleString()}, deviation long, w array<double>")
    shares = F.array(*[F.lit(float(x)) for x in explained])
    return out.select("id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
