"""Embedding whitening by cyclic Jacobi.

Tasks sum the grid vectors exactly, then the scatter of the centred vectors; only one matrix of the embedding's
dimension reaches the driver. There, symmetric Jacobi rotations go through all pairs of dimensions until nothing is left
off the diagonal, which keeps small eigenvalues accurate; the sorted components, over the roots of their eigenvalues,
are the whitening matrix that goes back to the tasks.

Defined results: vectors that are null, empty, or hold null or non-finite entries are left out, and so are those of
another length than the most frequent one (of equally frequent ones, the longest); entries beyond 2**50 on the grid
count as that; a null id stays; repeated rows and ids count each time; a component of no variance (under VANISHED of the
whole) is whitened to 0 and counts for no identity error; a deviation that no long holds is null; an empty table gives
no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import fields

#: The grid: an entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT, FARTHEST = 1024, 100_000, 1 << 50
#: Share of the whole variance under which a component counts as none.
VANISHED = 1e-13
#: Rows worked on at once.
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """n vectors were fitted; sums of their grid vectors; eigenvalues from the largest on, and their unit vectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def matrix(self, most: int) -> np.ndarray:
        """Columns that take a centred grid vector to its first whitened components."""
        kept = self.values[:most]
        held = kept > VANISHED * max(self.values.sum(), 0.0)
        return self.vectors[:, :most] * np.where(held, 1 / np.sqrt(np.where(held, kept, 1.0)), 0.0)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v: rows whose vector has entries, and only finite ones."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return df.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where((F.size("v") > 0) & F.forall("v", fine))


def dimension(rows: DataFrame) -> int | None:
    """The most frequent length; None without rows."""
    found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else None


def grid(values: pa.Array, d: int) -> np.ndarray:
    """The grid vectors of a batch, one in a row."""
    flat = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.clip(np.floor(SCALE * flat) + SHIFT, -FARTHEST, FARTHEST).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, grid(part.column(column), d)


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Their number and exact sum: each task gives one number a dimension."""
    schema = fields("i int, n long, total decimal(38,0)")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=object)
        for part, x in _blocks(batches, 0, d):
            n, total = n + part.num_rows, total + x.sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({"i": list(range(d)), "n": [n] * d, "total": [Decimal(int(t)) for t in total]}, schema=arrow)

    found = rows.select("v").mapInArrow(run, schema).groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("i").collect()  # d rows
    return found[0]["n"], [int(r["total"]) for r in found]


def _scatter(rows: DataFrame, d: int, project) -> np.ndarray:
    """The sum over rows of y y', where y = project(grid vectors): each task gives one triangle, which Spark adds up."""
    schema = fields("i int, j int, s double")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, 0, d):
            y = project(x)
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, type=pa.int32()), pa.array(j, type=pa.int32()), pa.array(total[i, j])], schema=arrow)

    found = rows.select("v").mapInArrow(run, schema).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # a triangle of the dimension
    size = max(r["j"] for r in found) + 1
    out = np.zeros((size, size))
    for r in found:
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["s"]
    return out


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns; the entry of the largest size is positive) of a symmetric
    matrix, by sweeps of rotations, each of which takes one pair of off-diagonal entries to 0."""
    a = np.array(matrix, dtype=np.float64)
    d = len(a)
    vectors = np.eye(d)
    for _ in range(sweeps):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                # what is under the rounding of both diagonal entries is nothing, also between small ones
                if abs(off) <= 1e-17 * np.sqrt(abs(a[p, p]) * abs(a[q, q])) or off == 0.0:
                    a[p, q] = a[q, p] = 0.0
                    continue
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(1.0, theta))
                c = 1 / np.hypot(1.0, t)
                s = t * c
                app, aqq = a[p, p] - t * off, a[q, q] + t * off
                row_p, row_q = a[p].copy(), a[q].copy()
                a[p], a[q] = c * row_p - s * row_q, s * row_p + c * row_q
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
                col_p, col_q = vectors[:, p].copy(), vectors[:, q].copy()
                vectors[:, p], vectors[:, q] = c * col_p - s * col_q, s * col_p + c * col_q
        if not turned:
            break
    values = np.maximum(np.diag(a), 0.0)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(d)])
    return values[order], vectors * np.where(signs == 0, 1.0, signs)


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of all rows (id, v); None if there are none."""
    if (d := dimension(rows)) is None:
        return None
    rows = rows.where(F.size("v") == d)
    n, sums = _sums(rows, d)
    mean = np.array([s / n for s in sums])
    values, vectors = jacobi(_scatter(rows, d, lambda x: x - mean) / n)
    return Whitening(n, sums, values, vectors)


def identity_error(rows: DataFrame, model: Whitening, most: int) -> float:
    """The largest entry, by size, of the whitened rows' covariance less the identity, measured over all rows."""
    mean, matrix = model.mean, model.matrix(most)
    kept = np.flatnonzero(np.abs(matrix).sum(axis=0))
    if not len(kept):
        return 0.0
    found = _scatter(rows, len(mean), lambda x: np.hstack([(x - mean) @ matrix[:, kept], np.ones((len(x), 1))]))
    centre = found[:-1, -1] / model.n
    return float(np.abs(found[:-1, :-1] / model.n - np.outer(centre, centre) - np.eye(len(kept))).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """For each row the exact sum over dimensions of (n * x - sums)**2; null if no long holds it."""
    largest = max(int(np.abs(x).max()) * n, max(map(abs, sums))) if len(x) else 0
    if largest < 1 << 61:
        apart = n * x - np.array(sums, dtype=np.int64)
        if len(sums) * int(np.abs(apart).max()) ** 2 < 1 << 63:
            return (apart * apart).sum(axis=1).tolist()
    apart = n * x.astype(object) - np.array(sums, dtype=object)
    return [int(t) if t < 1 << 63 else None for t in (apart * apart).sum(axis=1)]


def whitened(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 8) -> DataFrame:
    """One row for each usable vector: id, n, deviation, whitened (an array of up to `most` components)."""
    rows = usable(df, id_col, vec_col)
    return transform(rows, fit(rows), most).withColumnRenamed("id", id_col)


def transform(rows: DataFrame, model: Whitening | None, most: int = 8) -> DataFrame:
    """id, n, deviation, whitened of rows (id, v) by a fitted model."""
    schema = StructType([rows.schema["id"], *fields("n long, deviation long").fields, StructField("whitened", ArrayType(DoubleType()))])
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    arrow, n, sums, mean, matrix = to_arrow_schema(schema), model.n, model.sums, model.mean, model.matrix(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1, len(mean)):
            y = (x - mean) @ matrix
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], type=pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(y), n)), pa.array(deviations(x, n, sums), type=pa.int64()), lists.cast(arrow.field(3).type)], schema=arrow)

    return rows.where(F.size("v") == len(mean)).mapInArrow(run, schema)


def whitening_report(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 8) -> DataFrame:
    """A row for each usable vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = usable(df, id_col, vec_col)
    model = fit(rows)
    each = transform(rows, model, most).select("id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", _shares(model, most)[F.col("at")].alias("explained"), F.lit(identity_error(rows.where(F.size("v") == len(model.sums)), model, most) if model else 0.0).alias("identity_error"))


def _shares(model: Whitening | None, most: int) -> Column:
    """Each component's share of the variance (0 where there is none)."""
    if model is None:
        return F.array(F.lit(0.0))
    whole = model.values.sum()
    return F.array(*[F.lit(float(v / whole) if whole > 0 else 0.0) for v in model.values[:most]])
