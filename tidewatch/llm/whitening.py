"""Whitening of embeddings by an incremental eigendecomposition.

Entries become whole numbers, so sums and differences from the mean are exact however large the offset is.

Each partition keeps the eigenvectors and eigenvalues of its centred scatter matrix, and adds to them by
rank-one updates: a secular equation gives the new eigenvalues, with deflation of what an update leaves as it
is.  Rows come in blocks; a block is first turned, by an orthogonal transformation, into as many rows as there
are dimensions with the same scatter, so an update serves many vectors.  The distance between the block's mean
and the mean so far is one more update.  Spectra of partitions are combined in the same way, a few at a time
in a tree of groups.

The result is then refined by one distributed Rayleigh-Ritz step: all vectors are projected on the basis, and the
small matrix of the projections is solved again.  What leaves a task is of the size of one matrix of
dimensions squared, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ship
from tidewatch.workspace import written

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Vectors that are turned into one block of updates.
BLOCK_ROWS = 4096
#: Spectra that one task combines.
FAN_IN = 16

EPS = np.finfo(np.float64).eps
#: Whole numbers below this are added and multiplied as 64-bit integers, others as Python's.
SAFE = 1 << 62
SPECTRUM = "part long, n long, total array<decimal(38,0)>, eigenvalues array<double>, vectors array<double>"


def _deflated(d: np.ndarray, z: np.ndarray, q: np.ndarray, rho: float) -> list[int]:
    """The places whose eigenvalues an update changes, after turning close pairs; changes its arguments.

    An entry of ``z`` that is negligible leaves its eigenvalue as it is.  Of two eigenvalues that are nearly the same, a rotation
    of their vectors makes one entry of ``z`` zero.
    """
    tolerance = 8 * EPS * max(np.abs(d).max(), rho)
    kept: list[int] = []
    for i in range(len(d)):
        if rho * abs(z[i]) <= tolerance:
            continue
        if kept:
            p = kept[-1]
            length = np.hypot(z[i], z[p])
            c, s = z[i] / length, -z[p] / length
            if abs((d[i] - d[p]) * c * s) <= tolerance:
                z[i], z[p] = length, 0.0
                q[:, p], q[:, i] = c * q[:, p] + s * q[:, i], c * q[:, i] - s * q[:, p]
                d[p], d[i] = d[p] * c * c + d[i] * s * s, d[p] * s * s + d[i] * c * c
                kept[-1] = i
                continue
        kept.append(i)
    return kept


def _secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of ``1 + rho * sum(z_i^2 / (d_i - x))`` for rising ``d``, and the matrix ``d_i - root_j``.

    One root lies above each ``d``, the last below ``d + rho |z|^2``.  Each is found as its distance from the nearer pole, by
    bisection over the doubles themselves, so that small distances are as accurate as large ones.
    """
    square = z * z
    width = np.append(np.diff(d), rho * square.sum())
    with np.errstate(divide="ignore"):
        halfway = 1 + rho * (square[:, None] / (d[:, None] - (d + width / 2)[None, :])).sum(axis=0)
    above = halfway < 0
    above[-1] = False
    origin = np.where(above, np.append(d[1:], d[-1]), d)
    sign = np.where(above, -1.0, 1.0)
    base = d[:, None] - origin[None, :]
    low = np.zeros(len(d), np.int64)
    high = np.where(np.arange(len(d)) == len(d) - 1, width, width / 2).view(np.int64).copy()
    while (high - low > 1).any():
        middle = low + ((high - low) >> 1)
        step = middle.view(np.float64)
        with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
            value = sign * (1 + rho * (square[:, None] / (base - (sign * step)[None, :])).sum(axis=0))
        below = value < 0
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    step = sign * np.maximum(high, 1).view(np.float64)
    return origin + step, base - step[None, :]


def rank_one_update(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of ``vectors diag(values) vectors^T + weight v v^T`` for a positive weight."""
    z = vectors.T @ v
    length = np.sqrt(z @ z)
    rho = weight * length * length
    if not rho > 0:
        return values, vectors
    order = np.argsort(values, kind="stable")
    d, q, z = values[order], vectors[:, order], z[order] / length
    kept = _deflated(d, z, q, rho)
    if not kept:  # smaller than the rounding of what is there
        return d, q
    poles, own = d[kept], z[kept]
    roots, apart = _secular_roots(poles, own, rho)
    # The vector for which these roots are exact; it makes the eigenvectors orthogonal.
    count = len(kept)
    row, column = np.indices((count, count))
    nearest = np.where(column < row, poles[column], poles[np.minimum(column + 1, count - 1)]) - poles[row]
    nearest[:, -1] = 1.0
    exact = np.sqrt(np.abs((-apart / nearest).prod(axis=1) / rho)) * np.where(own < 0, -1.0, 1.0)
    turned = exact[:, None] / apart
    turned /= np.sqrt((turned * turned).sum(axis=0))
    q[:, kept] = q[:, kept] @ turned
    d[kept] = roots
    return d, q


def _exact(x: np.ndarray) -> list[int]:
    """Sums of the columns as whole numbers."""
    if len(x) and int(np.abs(x).max()) < SAFE // len(x):
        return [int(s) for s in x.sum(axis=0)]
    return [sum(column) for column in x.T.tolist()]


def from_mean(x: np.ndarray, n: int, total: Sequence[int]) -> np.ndarray:
    """``n * x - total``, exact: 64-bit integers where they suffice, else Python's."""
    largest = int(np.abs(x).max()) if x.size else 0
    if n * largest + max(map(abs, total), default=0) < SAFE:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


class Spectrum:
    """Number, sum and centred scatter of some vectors, the scatter as eigenvalues and eigenvectors."""

    def __init__(self, n: int, total: Sequence[int], values: np.ndarray, vectors: np.ndarray):
        self.n, self.total, self.values, self.vectors = n, list(total), values, vectors

    @staticmethod
    def empty(dimensions: int) -> "Spectrum":
        return Spectrum(0, [0] * dimensions, np.zeros(dimensions), np.eye(dimensions))

    def _update(self, v: np.ndarray, weight: float) -> None:
        self.values, self.vectors = rank_one_update(self.values, self.vectors, v, weight)

    def _join(self, n: int, total: Sequence[int]) -> None:
        """Move the mean to that of both sides: the distance of the means is a rank-one update."""
        if self.n:
            shift = [(b * self.n - a * n) / (self.n * n) for a, b in zip(self.total, total)]
            self._update(np.array(shift), self.n * n / (self.n + n))
        self.n += n
        self.total = [a + b for a, b in zip(self.total, total)]

    def add(self, x: np.ndarray) -> None:
        """Take in the rows of a block."""
        total = _exact(x)
        rows = from_mean(x, len(x), total).astype(np.float64) / len(x)
        if len(rows) > rows.shape[1]:
            rows = np.linalg.qr(rows, mode="r")
        for row in rows:
            self._update(row, 1.0)
        self._join(len(x), total)

    def combine(self, other: "Spectrum") -> None:
        for value, vector in zip(other.values, other.vectors.T):
            self._update(vector, float(value))
        self._join(other.n, other.total)

    def record(self, part: int) -> pa.RecordBatch:
        decimals = pa.array([[Decimal(t) for t in self.total]], pa.list_(pa.decimal128(38, 0)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int64()), pa.array([self.n], pa.int64()), decimals,
                pa.array([self.values], pa.list_(pa.float64())), pa.array([self.vectors.ravel()], pa.list_(pa.float64())),
            ],
            ["part", "n", "total", "eigenvalues", "vectors"],
        )

    @staticmethod
    def of(row: dict) -> "Spectrum":
        size = len(row["total"])
        vectors = np.array(row["vectors"], np.float64).reshape(size, size)
        return Spectrum(row["n"], [int(t) for t in row["total"]], np.array(row["eigenvalues"], np.float64), vectors)


@dataclass(frozen=True)
class Whitening:
    """``components`` are rows; ``identity_error`` is what the covariance of the whitened vectors is off by."""

    dimensions: int
    n: int
    total: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.eigenvalues)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return from_mean(x, self.n, self.total).astype(np.float64) / self.n


def _whole(column: pa.Array, dimensions: int) -> np.ndarray:
    """Vectors as rows of whole numbers; what no 64-bit integer holds is cut to the largest one's half."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.clip(np.floor(values * SCALE), -(2.0**62), 2.0**62 - 2**20)
    return scaled.astype(np.int64).reshape(-1, dimensions) + OFFSET


def _usable(vector: str) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def _dimensions(vectors: DataFrame) -> int:
    """The commonest length, the longer of equally common ones; 0 without vectors."""
    sizes = vectors.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return 0 if first is None else first["size"]


def usable(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """``vec_id, vector`` of the rows that are whitened, and the number of their dimensions."""
    named = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).filter(_usable("vector"))
    dimensions = _dimensions(named)
    return named.filter(F.size("vector") == dimensions), dimensions


def _spectra(vectors: DataFrame, dimensions: int, block_rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, rows = Spectrum.empty(dimensions), [], 0
        for batch in batches:
            x = _whole(batch.column(0), dimensions)
            for start in range(0, len(x), block_rows):
                held.append(x[start : start + block_rows])
                rows += len(held[-1])
                if rows >= block_rows:
                    own.add(np.concatenate(held))
                    held, rows = [], 0
        if held:
            own.add(np.concatenate(held))
        if own.n:
            yield own.record(TaskContext.get().partitionId())

    return vectors.select("vector").mapInArrow(run, SPECTRUM)


def _reduced(parts: DataFrame, purpose: str, merge: Callable[[list[dict]], pa.RecordBatch], fan_in: int) -> list[dict]:
    """Merge the rows of numbered parts, ``fan_in`` in a task, level by level; one row or none is left."""
    parts = written(parts, purpose)
    top = parts.agg(F.max("part")).first()[0]
    schema = parts.schema

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(schema.names).to_pylist(), key=lambda row: row["part"])
        return pa.Table.from_batches([merge(rows)])

    while top:
        grouped = parts.withColumn("_group", F.col("part").cast("long") - F.pmod("part", F.lit(fan_in)))
        parts = written(grouped.groupBy("_group").applyInArrow(run, schema), purpose)
        parts = parts.withColumn("part", F.floor(F.col("part") / fan_in).cast("long"))
        top //= fan_in
    return [row.asDict() for row in parts.collect()]


def _merged_spectra(rows: list[dict]) -> pa.RecordBatch:
    whole = Spectrum.of(rows[0])
    for row in rows[1:]:
        whole.combine(Spectrum.of(row))
    return whole.record(rows[0]["part"])


def _sums(rows: list[dict]) -> pa.RecordBatch:
    total = np.sum([np.array(row["sums"], np.float64) for row in rows], axis=0)
    return _sum_record(rows[0]["part"], total)


def _sum_record(part: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([sums.ravel()], pa.list_(pa.float64()))], ["part", "sums"])


def _gram(vectors: DataFrame, dimensions: int, project: Callable[[np.ndarray], np.ndarray], size: int, fan_in: int) -> np.ndarray:
    """Sum over all vectors of the outer products of ``(projection, 1)`` with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((size + 1, size + 1)), False
        for batch in batches:
            if batch.num_rows:
                seen = True
                found = project(_whole(batch.column(0), dimensions))
                found = np.column_stack([found, np.ones(len(found))])
                total += found.T @ found
        if seen:
            yield _sum_record(TaskContext.get().partitionId(), total)

    parts = vectors.select("vector").mapInArrow(run, "part long, sums array<double>")
    rows = _reduced(parts, "projections", _sums, fan_in)
    return np.array(rows[0]["sums"]).reshape(size + 1, size + 1)


def fit(
    vectors: DataFrame, dimensions: int, components: int = COMPONENTS, block_rows: int = BLOCK_ROWS, fan_in: int = FAN_IN
) -> Whitening | None:
    """The leading components of ``vectors`` as :func:`usable` gives them; None without vectors.

    Components along which the vectors don't vary are left out, so there may be fewer than asked for.
    """
    ship(vectors.sparkSession)
    if not dimensions:
        return None
    rows = _reduced(_spectra(vectors, dimensions, block_rows), "spectra", _merged_spectra, fan_in)
    if not rows:
        return None
    whole = Spectrum.of(rows[0])
    basis, _ = np.linalg.qr(whole.vectors)
    first = Whitening(dimensions, whole.n, tuple(whole.total), basis.T, np.ones(dimensions), 0.0)
    projected = _gram(vectors, dimensions, first.project, dimensions, fan_in)[:dimensions, :dimensions] / whole.n
    values, turn = np.linalg.eigh((projected + projected.T) / 2)
    order = np.argsort(-values, kind="stable")
    values, found = values[order], (basis @ turn[:, order]).T
    # Either sign would do; the largest entry of each is made positive.
    largest = found[np.arange(dimensions), np.abs(found).argmax(axis=1)]
    found *= np.where(largest < 0, -1.0, 1.0)[:, None]
    varies = values > dimensions * EPS * max(values[0], 0.0)
    size = min(components, int(varies.sum()))
    model = Whitening(dimensions, whole.n, tuple(whole.total), found[:size], values[:size], float(values.sum()))
    if not size:
        return model
    white = _gram(vectors, dimensions, model.project, size, fan_in) / whole.n
    covariance = white[:size, :size] - np.outer(white[:size, size], white[:size, size])
    error = float(np.abs(covariance - np.eye(size)).max())
    return Whitening(dimensions, model.n, model.total, model.components, model.eigenvalues, model.trace, error)


def _deviation(gaps: np.ndarray) -> list[int | None]:
    """Sums of the squares of the rows, exact; None where no 64-bit integer holds one."""
    if gaps.dtype != object and (not gaps.size or gaps.shape[1] * int(np.abs(gaps).max()) ** 2 < SAFE):
        return (gaps * gaps).sum(axis=1).tolist()
    exact = [sum(g * g for g in row) for row in gaps.tolist()]
    return [e if e < 2**63 else None for e in exact]


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, deviation, whitened`` of each vector, the latter with one entry per component.

    ``deviation`` is the sum over dimensions of ``(n * x - total)^2``, null if it doesn't fit a long.
    """
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(batch.column("vector"), model.dimensions)
            white = model.project(x)
            bounds = np.arange(len(x) + 1) * len(model.components)
            columns = [
                batch.column("vec_id"), pa.array(_deviation(from_mean(x, model.n, model.total)), pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(white.ravel())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "whitened"])

    named = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    return named.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def whitened(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    block_rows: int = BLOCK_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Left out are vectors that are null, empty, hold null or non-finite entries, or have another length than the
    commonest one (of equally common ones the longest).  Rows that repeat an id, or have none, are vectors of
    their own.  Components along which no vector differs from the others have no rows, so one vector, or
    equal ones, give none.  Only the two columns are read.
    """
    vectors, dimensions = usable(table, id_col, vector_col)
    model = fit(vectors, dimensions, components, block_rows, fan_in)
    size = 0 if model is None else len(model.components)
    if not size:
        return table.sparkSession.createDataFrame(
            [], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.eigenvalues])
    each = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return each.select(
        "vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(share, F.col("_at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
