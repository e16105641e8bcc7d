"""Embedding whitening by QR, bidiagonalisation and a qd solver.

Centred rows are reduced block by block to the triangle R of a QR factorisation, so no covariance is ever formed and
small directions keep their accuracy. The triangles of all partitions meet in a tree. Householder reflections make R
bidiagonal (R = U B W'), dqds finds the singular values of B to high relative accuracy, and twisted factorisations of
B'B - s^2 give its eigenvectors without inverse iteration; W carries them back to the space of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bedtrace.llm.common import bound_batches
from bedtrace.session import cut_lineage

SCALE, SHIFT = 64, 1_000_000  # x = floor(SCALE * c) + SHIFT
COMPONENTS = 32
BLOCK = 4096  # rows of one QR block
FAN = 8  # triangles that meet in one task
EPS = float(np.finfo(float).eps)
RANK = 1e-11  # singular values below this share of the largest one are rounding, not data
GAP = 1e-3  # eigenvalues closer than this (relative) are given orthogonal vectors together


# --- solver on one triangle -------------------------------------------------------------------------------------------


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, upper diagonal b and W with r = U B W' for a square r, by Householder reflections."""
    b, n = np.array(r, float), len(r)
    w = np.eye(n)
    for k in range(n):
        v = _reflector(b[k:, k])
        b[k:, k:] -= np.outer(v, v @ b[k:, k:])
        if k < n - 2:
            v = _reflector(b[k, k + 1 :])
            b[k:, k + 1 :] -= np.outer(b[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(b).copy(), np.diag(b, 1).copy(), w


def _reflector(x: np.ndarray) -> np.ndarray:
    """v with (I - v v') x = a multiple of the first unit vector."""
    top = np.abs(x).max()
    if top == 0 or len(x) == 1:
        return np.zeros(len(x))
    v = x / top
    norm = np.linalg.norm(v)
    v[0] += math.copysign(norm, v[0])
    return v * (math.sqrt(2) / np.linalg.norm(v))


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squares of the singular values of a bidiagonal matrix with squared entries q and e, in falling order.

    Each sweep takes a shift from the last two rows; a sweep that would leave the positive range is repeated with a
    smaller shift, the last resort being none. Sums of positive terms only: every value keeps its relative accuracy.
    """
    out, todo = [], [(list(q), list(e), 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        while q:
            n = len(q)
            if n == 1 or e[-1] <= EPS**2 * (sigma + q[-1]):
                out.append(sigma + q.pop())
                e = e[:-1]
                continue
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= EPS**2 * (sigma + q[k])), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            tau = _shift(q, e)
            for _ in range(4):
                step = _sweep(q, e, tau)
                if step:
                    break
                tau *= 0.25
            else:
                tau, step = 0.0, _sweep(q, e, 0.0)
            q, e = step
            sigma += tau
    return sorted(out, reverse=True)


def _shift(q: list[float], e: list[float]) -> float:
    """A bit less than the smaller eigenvalue of the last two rows."""
    x, y, o = q[-2] + (e[-2] if len(q) > 2 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
    half = (x - y) / 2
    low = y - o / (half + math.sqrt(half * half + o)) if half >= 0 else y - (math.sqrt(half * half + o) - half)
    return max(0.0, min(low, q[-1]) * (1 - 1e-8))


def _sweep(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float]] | None:
    d, qs, es = q[0] - tau, [], []
    for k in range(len(e)):
        if d < 0:
            return None
        top = d + e[k]
        t = q[k + 1] / top if top > 0 else 1.0
        qs.append(top)
        es.append(e[k] * t)
        d = (d * t if top > 0 else q[k + 1]) - tau
    return None if d < 0 else ([*qs, d], es)


def twisted(a: np.ndarray, b: np.ndarray, lam: float) -> np.ndarray:
    """Unit eigenvector of B'B (B bidiagonal with a, b) for its eigenvalue ``lam``.

    B'B - lam is factorised from the top (stationary) and from the bottom (progressive); both meet where the pivot is
    smallest, and the vector is read off the factors from there to both ends.
    """
    n, tiny = len(a), EPS * EPS * max(lam, 1e-300)
    d, low = a * a, b / a[:-1]
    s, lp = np.empty(n), np.empty(n - 1)
    s[0] = -lam
    for i in range(n - 1):
        piv = d[i] + s[i]
        lp[i] = low[i] * d[i] / (piv if piv != 0 else tiny)
        s[i + 1] = lp[i] * low[i] * s[i] - lam
    p, um = np.empty(n), np.empty(n - 1)
    p[n - 1] = d[n - 1] - lam
    for i in range(n - 2, -1, -1):
        piv = d[i] * low[i] ** 2 + p[i + 1]
        t = d[i] / (piv if piv != 0 else tiny)
        um[i] = low[i] * t
        p[i] = p[i + 1] * t - lam
    k = int(np.argmin(np.abs(s + p + lam)))
    z = np.zeros(n)
    z[k] = 1
    for i in range(k - 1, -1, -1):
        z[i] = -lp[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -um[i] * z[i]
    return z / np.linalg.norm(z)


def _cluster(t: np.ndarray, lams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonal vectors and values of eigenvalues that lie too close for vectors found one by one."""
    n, rng = len(t), np.random.default_rng(1)
    z = np.linalg.qr(rng.normal(size=(n, len(lams))))[0]
    off = lams.mean() + EPS * np.abs(t).max()
    for _ in range(4):
        z = np.linalg.qr(np.linalg.solve(t - off * np.eye(n), z))[0]
    e, y = np.linalg.eigh(z.T @ t @ z)
    return e[::-1], z @ y[:, ::-1]


def singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the singular values of a square matrix in falling order, and its right singular vectors as columns."""
    a, b, w = bidiagonal(r)
    n, top = len(a), max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if top == 0:
        return np.zeros(n), w
    a = np.where(np.abs(a) < EPS * EPS * top, EPS * EPS * top, a)
    ends = [*(np.flatnonzero(np.abs(b) <= EPS * (np.abs(a[:-1]) + np.abs(a[1:]))) + 1).tolist(), n]
    values, vectors, lo = [], [], 0
    for hi in ends:  # parts without a link have no common vectors
        x, y = a[lo:hi], b[lo : hi - 1]
        lam = np.array(dqds((x * x).tolist(), (y * y).tolist()))
        z = np.zeros((n, hi - lo))
        at = 0
        while at < hi - lo:
            to = at + 1
            while to < hi - lo and lam[to - 1] - lam[to] <= GAP * lam[to - 1]:
                to += 1
            if to == at + 1:
                z[lo:hi, at] = twisted(x, y, lam[at])
            else:
                t = np.diag(x * x) + np.diag(x[:-1] * y, 1) + np.diag(x[:-1] * y, -1)
                t[np.arange(1, hi - lo), np.arange(1, hi - lo)] += y * y
                lam[at:to], z[lo:hi, at:to] = _cluster(t, lam[at:to])
            at = to
        values.append(lam)
        vectors.append(z)
        lo = hi
    lam, z = np.concatenate(values), np.concatenate(vectors, axis=1)
    order = np.argsort(-lam, kind="stable")
    return lam[order], w @ z[:, order]


# --- rows -------------------------------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """What ``fit`` finds: number of vectors, sum of each dimension, eigenvalues, trace and directions (as columns)."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    trace: float
    directions: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums // self.n).astype(float) - (self.sums % self.n) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 per row; None where it is no long."""
        small = ((self.n * self.centred(x)) ** 2).sum(1) < 9.2e18
        exact = ((self.n * (x - self.sums // self.n) - self.sums % self.n) ** 2).sum(1)
        return [v if ok else None for v, ok in zip(exact.tolist(), small.tolist())]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions / np.sqrt(self.values)


def whole_vectors(arr: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and x-vectors of a batch, one pair for each length; rows with null or non-finite entries are left out."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    rows = np.flatnonzero(arr.is_valid().to_numpy(zero_copy_only=False))
    lens = arr.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[rows]
    flat = arr.flatten()
    c = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lens) - lens
    for d in np.unique(lens[lens > 0]).tolist():
        at = np.flatnonzero(lens == d)
        m = c[starts[at][:, None] + np.arange(d)]
        fine = (np.abs(m) < 2.0**56).all(1)  # false for NaN and infinities; larger entries have no long x
        yield rows[at[fine]], np.floor(SCALE * m[fine]).astype(np.int64) + SHIFT


def _of_length(arr: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    return next(((r, x) for r, x in whole_vectors(arr) if x.shape[1] == d), (np.zeros(0, np.int64), np.zeros((0, d), np.int64)))


def _merged(parts: DataFrame, join: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """One matrix out of the rows (id, part) by a tree; no task holds more than FAN of them."""
    parts = cut_lineage(parts)
    while parts.count() > FAN:

        def meet(t: pa.Table) -> pa.Table:
            out = join([np.frombuffer(x.as_py()) for x in t.column("part")])
            return pa.table({"id": [t.column("id")[0].as_py() // FAN], "part": [out.tobytes()]}, schema=pa.schema([("id", pa.int64()), ("part", pa.binary())]))

        parts = cut_lineage(parts.groupBy(F.floor(F.col("id") / FAN)).applyInArrow(meet, "id long, part binary"))
    found = [np.frombuffer(r["part"]) for r in parts.orderBy("id").collect()]  # at most FAN matrices
    return join(found) if found else None


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Directions of the largest variance of all whole vectors of ``df``; None if there is no vector or no variance."""
    bound_batches(df.sparkSession)
    src = df.select(F.col(f"`{vector}`").alias("v"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for r, x in whole_vectors(b.column(0)):
                n, s = sums.get(x.shape[1], (0, np.zeros(x.shape[1], np.int64)))
                sums[x.shape[1]] = (n + len(r), s + x.sum(0))
        for d, (n, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(s)], names=["d", "i", "n", "s"])

    per = cut_lineage(src.mapInArrow(totals, "d long, i long, n long, s long").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    best = per.filter("i = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if best is None or best["n"] == 0:
        return None
    d, n = best["d"], best["n"]
    sums = np.array([r["s"] for r in per.filter(F.col("d") == d).orderBy("i").collect()], np.int64)
    model = Whitening(n, sums, np.ones(0), 0.0, np.zeros((d, 0)))

    def triangle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for b in batches:
            y = model.centred(_of_length(b.column(0), d)[1])
            for at in range(0, len(y), BLOCK):
                r = np.linalg.qr(np.vstack([r, y[at : at + BLOCK]]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["id", "part"])

    r = _merged(src.mapInArrow(triangle, "id long, part binary"), lambda parts: np.linalg.qr(np.vstack([p.reshape(-1, d) for p in parts]), mode="r"))
    r = np.vstack([r.reshape(-1, d), np.zeros((max(0, d - r.size // d), d))])
    values, vectors = singular(r)
    keep = np.flatnonzero(values > RANK**2 * values[0])[:components] if values[0] > 0 else []
    return Whitening(n, sums, values[keep] / n, float(values.sum() / n), vectors[:, keep]) if len(keep) else None


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    bound_batches(df.sparkSession)
    d, k = model.directions.shape

    def join(parts: list[np.ndarray]) -> np.ndarray:
        """Rows: count and mean, then the sums of products around the mean."""
        n, mean, m2 = 0.0, np.zeros(k), np.zeros((k, k))
        for p in parts:
            c, mu, s = p[0], p[1 : k + 1], p[k + 1 :].reshape(k, k)
            diff = mu - mean
            m2 = m2 + s + np.outer(diff, diff) * (n * c / (n + c))
            mean = mean + diff * (c / (n + c))
            n += c
        return np.concatenate([[n], mean, m2.ravel()])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            w = model.whitened(_of_length(b.column(0), d)[1])
            if len(w):
                y = w - w.mean(0)
                part = np.concatenate([[len(w)], w.mean(0), (y.T @ y).ravel()])
                total = part if total is None else join([total, part])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["id", "part"])

    total = _merged(df.select(F.col(f"`{vector}`").alias("v")).mapInArrow(moments, "id long, part binary"), join)
    return float(np.abs(total[k + 1 :].reshape(k, k) / total[0] - np.eye(k)).max())


OUT = T.StructType([T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                    T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])


def whiten(df: DataFrame, cols: list[str], vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``cols`` of every whole vector with one row per component: component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries (or some beyond 2^56) are dropped, and so are
    vectors of another length than the commonest one (the longer of two equally common). Directions without variance
    (fewer vectors than dimensions, copies of one vector) have no component: a table without variance, or an empty one,
    gives no rows. Repeated rows count as often as they occur; equal eigenvalues have any orthogonal directions.
    ``deviation`` is null where it exceeds a long. Columns of ``cols`` named like an output give way to it.
    """
    bound_batches(df.sparkSession)
    cols = [c for c in cols if c not in OUT.fieldNames()]
    src = df.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{vector}`").alias("__vector"))
    schema = T.StructType([src.schema[c] for c in cols] + OUT.fields)
    model = fit(src, "__vector", components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error, k = identity_error(src, model, "__vector"), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):  # k rows come out of each
                b = whole.slice(at, BLOCK)
                rows, x = _of_length(b.column(len(cols)), len(model.sums))
                take, m = pa.array(np.repeat(rows, k)), len(rows)
                made = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array([v for v in model.deviation(x) for _ in range(k)], pa.int64()),
                        pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays([b.column(i).take(take) for i in range(len(cols))] + made, names=[*cols, *OUT.fieldNames()])

    return src.mapInArrow(run, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), ["vec_id"])
