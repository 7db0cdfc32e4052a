"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Two scans fit the model: exact sums of the integer entries give n and the means, then the
products of the centred entries give the covariance V. Tasks add up what they read and send
one small matrix each, of the square of the dimension; partial matrices are added in two
levels. V = L L' by Cholesky with pivots, where L has as many columns as V has rank. Plane
rotations from the right make L's columns orthogonal (L J, so V = (L J)(L J)'): their squared
norms are the eigenvalues and the columns, scaled to length 1, the components. Small
eigenvalues keep their relative accuracy, as L is never squared again. Only the d x d matrix
comes to the driver; d is the length of a vector, and ``MAX_DIMENSION`` bounds it.

A third scan projects the vectors. Their covariance is measured on what was written, so
``identity_error`` is that of the rows returned.

Defined results: vectors that are null, hold null or non-finite entries or entries that make
no long are left out, and so are vectors of another length than most have (of equally
frequent lengths the larger counts) and empty ones; repeated rows count and are returned each;
a null vec_id stays null; components beyond the rank of V are left out (no rows if all vectors are
equal); equal eigenvalues have any orthogonal directions; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
MAX_DIMENSION = 8192
#: Vectors that are centred and multiplied at a time.
ROWS = 4096
#: Groups in which partial matrices are added before they are added for good.
FAN_IN = 64
SWEEPS = 60
EPS = float(np.finfo(np.float64).eps)

Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Model:
    """Sums ``s`` (exact) of ``n`` vectors, components as columns by falling eigenvalue, and the trace of V."""

    n: int
    s: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole part and remainder of s / n, so that n * x - s = n * (x - whole) - rest."""
        whole, rest = zip(*(divmod(v, self.n) for v in self.s), strict=True)
        return np.array(whole, np.int64), np.array(rest, np.int64)


def integers(column: pa.Array, dimension: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of good vectors and their entries as longs, one pair for each length (or for ``dimension`` alone)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = column.drop_null()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int64)
    values = column.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for d in [dimension] if dimension else np.unique(sizes[sizes > 0]).tolist():
        mine = np.flatnonzero(sizes == d)
        for k in range(0, len(mine), ROWS):
            some = mine[k : k + ROWS]
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(SCALE * values[(ends[some] - d)[:, None] + np.arange(d)])
                good = np.flatnonzero((np.abs(x) < 2.0**62).all(axis=1))
            if len(good):
                yield rows[some[good]], x[good].astype(np.int64) + SHIFT


def add_entries(batches: Batches) -> Batches:
    """embedding in; for each length d and place: rows, and the sums of the entries' upper and lower 32 bits."""
    held: dict[int, list] = {}
    for batch in batches:
        for _, x in integers(batch.column(0)):
            one = held.setdefault(x.shape[1], [0, 0, 0])
            one[0] += len(x)
            one[1] = one[1] + (x >> 32).sum(axis=0)
            one[2] = one[2] + (x & 0xFFFFFFFF).sum(axis=0)
    for d, (n, high, low) in held.items():
        cols = [np.full(d, d), np.arange(d), np.full(d, n), high, low]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["d", "place", "n", "high", "low"])


def centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """x - s / n, of which all but the fraction is taken in whole numbers."""
    return (x - whole).astype(np.float64) - rest / n


def multiplier(whole: np.ndarray, rest: np.ndarray, n: int) -> Callable[[Batches], Batches]:
    """embedding in; the rows of this task's sum of products of centred entries out."""

    def multiply(batches: Batches) -> Batches:
        total = None
        for batch in batches:
            for _, x in integers(batch.column(0), len(whole)):
                z = centred(x, whole, rest, n)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield from _matrix_rows(dict(enumerate(total)))

    return multiply


def _matrix_rows(rows: dict[int, np.ndarray]) -> Batches:
    for k, v in rows.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v], pa.list_(pa.float64()))], names=["place", "row"])


def add_rows(batches: Batches) -> Batches:
    """place, row in; one row for each place of this partition out, the sum of its rows, read one batch at a time."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            v = v.values.to_numpy(zero_copy_only=False)
            held[k] = held[k] + v if k in held else v.copy()
    yield from _matrix_rows(held)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """The factor L, its rows in the order of ``a``, with a = L L' to rounding; as many columns as pivots stay above it."""
    d = len(a)
    a, order, low = a.copy(), np.arange(d), np.zeros((d, d))
    left = a.diagonal().copy()
    least = d * EPS * max(float(left.max(initial=0.0)), 0.0)
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if not left[p] > least:
            return _unpermuted(low[:, :k], order)
        if p != k:
            for x in (a, low, left, order):
                x[[k, p]] = x[[p, k]]
            a[:, [k, p]] = a[:, [p, k]]
        low[k, k] = np.sqrt(left[k])
        low[k + 1 :, k] = (a[k + 1 :, k] - low[k + 1 :, :k] @ low[k, :k]) / low[k, k]
        left[k + 1 :] -= low[k + 1 :, k] ** 2
    return _unpermuted(low, order)


def _unpermuted(low: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(low)
    out[order] = low
    return out


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and components of factor @ factor.T by rotations of its columns.

    The pairs of a sweep are played as a tournament: in each round every column meets one
    other, so a round's rotations touch different columns and are made together.
    """
    w = factor.copy()
    seats = list(range(w.shape[1])) + [-1] * (w.shape[1] % 2)
    for _ in range(SWEEPS):
        moved = False
        for _ in range(max(0, len(seats) - 1)):
            half = len(seats) // 2
            pairs = np.array([(p, q) for p, q in zip(seats[:half], seats[: half - 1 : -1], strict=True) if p >= 0 and q >= 0], np.int64).reshape(-1, 2)
            moved |= _rotate(w, pairs[:, 0], pairs[:, 1])
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if not moved:
            break
    else:
        raise ValueError(f"rotations did not settle in {SWEEPS} sweeps")
    norms = np.linalg.norm(w, axis=0)
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, w[:, order] / norms[order]


def _rotate(w: np.ndarray, p: np.ndarray, q: np.ndarray) -> bool:
    """Make column p orthogonal to column q, pair by pair; whether any was not."""
    a, b = w[:, p], w[:, q]
    aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
    off = np.abs(ab) > len(w) * EPS * np.sqrt(aa * bb)
    if not off.any():
        return False
    p, q, a, b, aa, bb, ab = p[off], q[off], a[:, off], b[:, off], aa[off], bb[off], ab[off]
    zeta = (bb - aa) / (2 * ab)
    t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
    c = 1 / np.hypot(1.0, t)
    w[:, p], w[:, q] = c * a - c * t * b, c * t * a + c * b
    return True


def fit(embeddings: DataFrame, vector: str = "embedding") -> Model | None:
    """The model of all good vectors; None if there are none."""
    rows = embeddings.select(F.col(vector).cast("array<double>").alias("embedding"))
    sums = rows.mapInArrow(add_entries, "d long, place long, n long, high long, low long")
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    sums = staged(sums.groupBy("d", "place").agg(F.sum("n").alias("n"), *whole), "sums")
    most = sums.where("place = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return None
    d, n = most["d"], most["n"]
    if d > MAX_DIMENSION:
        raise ValueError(f"vectors of {d} entries; at most {MAX_DIMENSION} can be whitened")
    s = [(int(r["high"]) << 32) + int(r["low"]) for r in sums.where(F.col("d") == d).orderBy("place").collect()]
    model = Model(n, tuple(s), np.zeros((d, 0)), np.zeros(0), 0.0)
    parts = rows.mapInArrow(multiplier(*model.split, n), "place int, row array<double>")
    some = parts.withColumn("group", F.spark_partition_id() % FAN_IN).repartition("place", "group").drop("group").mapInArrow(add_rows, "place int, row array<double>")
    added = some.repartition("place").mapInArrow(add_rows, "place int, row array<double>")
    scatter = np.zeros((d, d))
    for r in added.toLocalIterator():
        scatter[r["place"]] = r["row"]
    v = (scatter + scatter.T) / (2 * n)
    values, components = jacobi(pivoted_cholesky(v))
    return Model(n, tuple(s), components, values, float(np.trace(v)))


def deviations(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """For each row the exact sum of (n * x - s)^2; None where that is no long.

    Machine integers wrap round at 2^64, which leaves a sum that is a long exact; a sum in
    floating point tells whether it is one.
    """
    about = n * centred(x, whole, rest, n)
    size = (about * about).sum(axis=1)
    off = np.uint64(n % 2**64) * (x - whole).view(np.uint64) - rest.view(np.uint64)
    exact = (off * off).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()
    most = 2.0**63
    for k in np.flatnonzero(size > most * (1 - 1e-9)).tolist():
        told = sum((n * (a - b) - r) ** 2 for a, b, r in zip(x[k].tolist(), whole.tolist(), rest.tolist(), strict=True))
        exact[k] = told if told < 2**63 else None
    return exact


def projector(model: Model, k: int) -> Callable[[Batches], Batches]:
    """vec_id, embedding in; vec_id, deviation and the whitened coordinates out."""
    (whole, rest), n = model.split, model.n
    basis = model.components[:, :k] / np.sqrt(model.eigenvalues[:k])

    def project(batches: Batches) -> Batches:
        for batch in batches:
            for at, x in integers(batch.column(1), len(whole)):
                w = centred(x, whole, rest, n) @ basis
                cols = [batch.column(0).take(pa.array(at)), pa.array(deviations(x, whole, rest, n), pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(w.reshape(-1)), w.shape[1]).cast(pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "deviation", "whitened"])

    return project


def transform(embeddings: DataFrame, model: Model, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """vec_id, deviation and ``whitened`` (an array) of each good vector."""
    k = min(components, len(model.eigenvalues))
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col(vector).cast("array<double>").alias("embedding"))
    return rows.mapInArrow(projector(model, k), "vec_id long, deviation long, whitened array<double>")


def identity_error(white: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity.

    Vectors were centred before they were projected, so the means here are rounding errors;
    they are taken off all the same before anything is multiplied.
    """
    means = white.agg(*(F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(k))).first()
    z = [F.col("whitened")[i] - F.lit(means[i]) for i in range(k)]
    got = white.agg(*(F.abs(F.avg(z[i] * z[j]) - float(i == j)).alias(f"e{i}_{j}") for i in range(k) for j in range(i, k))).first()
    return max(got)


def whitened(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each good vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(embeddings, vector)
    k = min(components, len(model.eigenvalues)) if model else 0
    if not k:
        return embeddings.sparkSession.createDataFrame([], schema)
    white = staged(transform(embeddings, model, k, vector), "whitened")
    explained = F.lit((model.eigenvalues[:k] / model.trace).tolist())
    long = white.select("vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", F.posexplode("whitened").alias("at", "whitened"), F.lit(identity_error(white, k)).alias("identity_error"))
    return long.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), "identity_error")
