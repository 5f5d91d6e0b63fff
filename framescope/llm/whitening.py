"""Whitening of embeddings by shifted CholeskyQR.

The vectors, as whole numbers ``x = floor(SCALE * entry) + OFFSET``, form a tall matrix
A of centred rows.  Its QR factorisation needs sums over the rows only:

1. the Gram matrix of A, plus a small shift s on the diagonal so that rounding cannot
   make it indefinite, is factored: A'A + s I = R1' R1;
2. the Gram matrix of Q1 = A / R1 (each task solves the triangular system for its own
   rows) gives R2, that of Q2 = Q1 / R2 gives R3; Q3 = Q2 / R3 is orthonormal to double
   precision, and A = Q3 R with R = R3 R2 R1;
3. the singular value decomposition of R, a matrix as small as the dimension, has the
   components in V: A'A = V S^2 V', so the covariance's eigenvalues are S^2 / n.

The condition of A enters R, unlike an eigenvalue routine on A'A, not squared.  Every
pass sends one matrix of the dimension's size per task, split by rows and added up in
two steps in tasks; the driver gets one such matrix, whatever the number of vectors.
A row's components are its own projections: no shuffle.

Dimensions that no vector moves in (rank below the dimension) are left out first, by
their pivot in the shifted factor, so that no pass divides by rounding errors; a
component whose eigenvalue is not above rounding of the largest is not returned.

Nulls: a vector that is null or holds a null, NaN or infinite entry is dropped; a null
id is kept.  Vectors of another length than the most frequent one (the longer at ties)
cannot be projected and are dropped; so are empty ones.  Repeated rows count each time.
Equal eigenvalues: any basis of their space.  Fewer dimensions than ``components``: as
many as there are.  One vector, equal vectors or an empty table: no rows.  Entries
beyond +-2^40 are held there.  Other columns are not read, so no name
can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: An entry's limit, so that every x fits a long.
ENTRY_LIMIT = float(1 << 40)
#: The matrices of all tasks are added up in this many groups first, then by row.
GROUPS = 16
#: Vectors a task works on at a time.
SLICE = 4096
#: Columns of A by place, and the triangular factor that divides them.
Factor = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Centre:
    """``n`` vectors whose sums are ``n * whole + rest`` with ``rest`` in [0, n), by dimension."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - S)^2, exact; None for those that are no long."""
        rough = ((self.n * (x - self.whole).astype(np.float64) - self.rest) ** 2).sum(axis=1)
        small = rough < 2.0**62
        found = np.zeros(len(x), object)
        found[small] = ((self.n * (x[small] - self.whole) - self.rest) ** 2).sum(axis=1)
        for k in np.flatnonzero(~small):
            exact = sum((self.n * (int(v) - int(w)) - int(r)) ** 2 for v, w, r in zip(x[k], self.whole, self.rest, strict=True))
            found[k] = exact if exact < 1 << 63 else None
        return found.tolist()


@dataclass(frozen=True)
class Whitening:
    """Per component a direction (a row), an eigenvalue and its part of the whole variance."""

    centre: Centre
    directions: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def projected(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.directions.T / np.sqrt(self.eigenvalues)


def _slices(batch: pa.RecordBatch, size: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch with their vectors as a matrix of long x."""
    for k in range(0, batch.num_rows, SLICE):
        part = batch.slice(k, SLICE)
        flat = np.asarray(part.column(column).flatten(), np.float64).reshape(-1, size)
        yield part, np.floor(SCALE * np.clip(flat, -ENTRY_LIMIT, ENTRY_LIMIT)).astype(np.int64) + OFFSET


def usable(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """The rows whose vector can be whitened, and the vectors' length (0 if there are none)."""
    finite = F.forall(F.col(vector).cast("array<double>"), lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    rows = vectors.filter(F.coalesce(finite, F.lit(False)))
    sizes = rows.groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("many")).filter("size > 0")
    found = sizes.orderBy(F.col("many").desc(), F.col("size").desc()).head()
    return rows.filter(F.size(vector) == (found["size"] if found else 0)), found["size"] if found else 0


def _summed(rows: DataFrame, vector: str, size: int, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of(x)``, a matrix of ``shape``, over all slices of vectors.

    A task sends its sum as one row per matrix row; these are added up by (row,
    group of tasks) and then by row, so no task holds more than a row of some tasks.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for batch in batches:
            for _, x in _slices(batch, size):
                total += of(x)
        group = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(shape[0]), pa.int32()), pa.array([group] * shape[0], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
            names=["row", "group", "values"],
        )

    def added(table: pa.Table) -> pa.Table:
        values = np.asarray(table.column("values").combine_chunks().flatten(), np.float64).reshape(-1, shape[1]).sum(axis=0)
        return pa.table({"row": table.column("row")[:1], "group": table.column("group")[:1], "values": pa.array([values], pa.list_(pa.float64()))})

    schema = "row int, group int, values array<double>"
    parts = rows.select(F.col(vector).cast("array<double>")).mapInArrow(sums, schema)
    parts = parts.groupBy("row", "group").applyInArrow(added, schema).groupBy("row").applyInArrow(added, schema)
    whole = np.zeros(shape)
    for r in parts.collect():  # one matrix of the dimension's size
        whole[r["row"]] = r["values"]
    return whole


def _centre(rows: DataFrame, vector: str, size: int) -> Centre | None:
    """The number of vectors and their exact sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [0] * (size + 1)
        for batch in batches:
            for _, x in _slices(batch, size):
                found = [a + b for a, b in zip(found, [*x.sum(axis=0).tolist(), len(x)], strict=True)]
        exact = pa.array([Decimal(v) for v in found], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), exact], names=["place", "part"])

    parts = rows.select(F.col(vector).cast("array<double>")).mapInArrow(sums, "place int, part decimal(38,0)")
    total = [int(r["total"]) for r in parts.groupBy("place").agg(F.sum("part").alias("total")).orderBy("place").collect()]
    if not total or not total[-1]:
        return None
    n = total.pop()
    return Centre(n, np.array([t // n for t in total], np.int64), np.array([t % n for t in total], np.int64))


def _divided(q: np.ndarray, factors: Sequence[Factor]) -> np.ndarray:
    """The columns of ``q`` that each factor names, divided by it: X with X R = Q, column by column."""
    for columns, r in factors:
        b, q = q[:, columns], np.empty((len(q), len(columns)))
        for k in range(len(columns)):
            q[:, k] = (b[:, k] - q[:, :k] @ r[:k, k]) / r[k, k]
    return q


def _moving(gram: np.ndarray) -> np.ndarray:
    """Columns that are no combination of those before them but for rounding."""
    left, kept = gram.copy(), []
    least = np.diag(gram) * (len(gram) * 64 * np.finfo(float).eps)
    for k in range(len(gram)):
        if left[k, k] > max(least[k], 0.0):
            kept.append(k)
            row = left[k] / np.sqrt(left[k, k])
            left = left - np.outer(row, row)
    return np.array(kept, np.int64)


def fit(rows: DataFrame, size: int, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``usable`` rows; None where no vector differs from another."""
    centre = _centre(rows, vector, size)
    if centre is None:
        return None

    def gram(factors: Sequence[Factor]) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            q = _divided(centre.centred(x), factors)
            return q.T @ q

        many = len(factors[-1][0]) if factors else size
        found = _summed(rows, vector, size, (many, many), of)
        return (found + found.T) / 2

    first = gram([])
    columns = _moving(first)
    m = len(columns)
    if not m:
        return None
    first = first[np.ix_(columns, columns)]
    shift = 11 * (m + 1) * np.finfo(float).eps * np.trace(first)
    factors = [(columns, np.linalg.cholesky(first + shift * np.eye(m)).T)]
    for _ in range(2):
        factors.append((np.arange(m), np.linalg.cholesky(gram(factors)).T))
    if m == size:
        r = factors[2][1] @ factors[1][1] @ factors[0][1]
    else:  # the columns left out are combinations of the others: all of R is Q'A
        r = _summed(rows, vector, size, (m, size), lambda x: _divided(centre.centred(x), factors).T @ centre.centred(x))
    _, singular, directions = np.linalg.svd(r, full_matrices=False)
    eigenvalues = singular**2 / centre.n
    kept = np.flatnonzero(singular > singular[0] * size * np.finfo(float).eps)[:components]
    model = Whitening(centre, directions[kept], eigenvalues[kept], eigenvalues[kept] / eigenvalues.sum())
    return replace(model, identity_error=_identity_error(rows, vector, size, model))


def _identity_error(rows: DataFrame, vector: str, size: int, model: Whitening) -> float:
    """The largest entry, over all rows, of the covariance of the whitened rows minus the identity."""
    many, n = len(model.eigenvalues), model.centre.n
    mean = _summed(rows, vector, size, (1, many), lambda x: model.projected(x).sum(axis=0, keepdims=True)) / n

    def of(x: np.ndarray) -> np.ndarray:
        w = model.projected(x) - mean
        return w.T @ w

    covariance = _summed(rows, vector, size, (many, many), of) / n
    return float(np.abs(covariance - np.eye(many)).max())


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For every usable row and component: ``vec_id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    ``deviation`` is the sum over dimensions of (n x - S)^2, exact; null where it is no long.
    """
    rows, size = usable(vectors, vector)
    model = fit(rows, size, vector, components) if size else None
    own = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    more = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = T.StructType([own.schema["vec_id"], *T.StructType.fromDDL(more).fields])
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    many = len(model.eigenvalues)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _slices(batch, size, 1):
                each = pa.array(np.repeat(np.arange(len(x)), many))
                columns = [
                    part.column(0).take(each), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), model.centre.n, np.int64)),
                    pa.array(model.centre.deviations(x), pa.int64()).take(each), pa.array(model.projected(x).ravel()),
                    pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(each), model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return own.mapInArrow(whitened, schema)
