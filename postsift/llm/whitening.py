"""Embedding whitening from exact variances: the covariance by polarisation.

Vectors become whole numbers, so all sums are exact in any order.  Of the different vectors, each centred by n times
itself less the sum of all, only squares are added up: of every dimension, and of the sum of every two dimensions.  As
the variance of a sum is both variances and twice the covariance, differences give all cross-covariances.  The matrix,
as small as the dimensions squared, goes to eigh on the driver; the projection of the rows is spread again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postsift.llm.common import per_worker, small_batches
from postsift.session import Rounds

#: Steps per unit of an entry; entries that make larger numbers than LARGEST are no usable ones.
SCALE, LARGEST = 256, 1 << 52
#: Components with less than this share of the variance have no direction of their own: nothing can be divided by it.
NO_VARIANCE = 1e-13
_EXACT = pa.decimal128(38, 0)
_LIMB = 20


@dataclass
class Whitener:
    """Number of vectors fitted, their exact sums, and unit components as rows by falling variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Centred rows on each component, over its standard deviation; NaN where it has no variance."""
        centred = centre(x, self.n, self.sums)
        usable = self.variances > NO_VARIANCE * self.total
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (centred.astype(np.float64) / self.n) @ self.components.T / np.sqrt(np.where(usable, self.variances, np.nan))
        return out


def centre(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: as 64-bit numbers if they are small enough to be added in pairs, else as Python's."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if largest < 1 << 60:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def square_sums(values: np.ndarray, axis: int) -> list[int]:
    """Exact sums of squares along an axis; numbers are split in limbs, so that no product or sum overflows."""
    if values.dtype == object:
        return [int(v) for v in (values * values).sum(axis=axis)]
    limbs, rest = [], values
    while True:
        limbs.append(rest & ((1 << _LIMB) - 1))
        rest = rest >> _LIMB
        if not rest.any() or (rest == -1).all():
            limbs[-1] += rest << _LIMB  # the sign
            break
        if np.abs(rest).max() < 1 << _LIMB:
            limbs.append(rest)
            break
    total = np.zeros(values.shape[1 - axis], object)
    for i, a in enumerate(limbs):
        for j in range(i, len(limbs)):
            part = (a * limbs[j]).sum(axis=axis, dtype=np.int64)
            total = total + part.astype(object) * ((1 if i == j else 2) << _LIMB * (i + j))
    return [int(v) for v in total]


def matrix(batch_column: pa.Array) -> np.ndarray:
    """Rows of a column of lists of equal length."""
    return batch_column.flatten().to_numpy(zero_copy_only=False).reshape(len(batch_column), -1)


def whole_numbers(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the usable rows: floor(SCALE * c) of each entry."""
    entry = lambda c: c.cast("double") * SCALE
    usable = ~F.exists(vector_col, lambda c: F.coalesce(~(F.abs(entry(c)) <= float(LARGEST)) | F.isnan(entry(c)), F.lit(True)))
    rows = rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & usable)
    # the sum turns -0 into 0, in doubles as in whole numbers
    return rows.select(F.col(id_col).alias("id"), F.transform(vector_col, lambda c: F.floor(entry(c)) + F.lit(0).cast("long")).alias("x"))


def fit(distinct: DataFrame, components: int) -> Whitener | None:
    """Fit on (x) rows that are all different, of one length.  What comes to the driver is two numbers for each
    dimension and one for each pair of dimensions.  None without rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                own = matrix(batch.column(0)).sum(axis=0, dtype=object)
                n, sums = n + batch.num_rows, own if sums is None else sums + own
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), pa.array(map(Decimal, sums), _EXACT)],
                names=["i", "n", "s"],
            )

    found = distinct.mapInArrow(add, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    if not found:
        return None
    n, sums = found[0]["n"], [int(r["s"]) for r in found]
    size = len(sums)
    left, right = np.triu_indices(size)  # a dimension with itself stands for its own variance

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in small_batches(batches, 256):
            c = centre(matrix(batch.column(0)), n, sums)
            pairs = c[:, left] + np.where(left == right, 0, c[:, right])
            own = square_sums(pairs, 0)
            total = own if total is None else [a + b for a, b in zip(total, own)]
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(map(Decimal, total), _EXACT)], names=["i", "j", "q"]
            )

    squares = distinct.mapInArrow(square, "i int, j int, q decimal(38,0)").groupBy("i", "j").agg(F.sum("q").alias("q")).collect()
    q = {(r["i"], r["j"]): int(r["q"]) for r in squares}
    v = np.zeros((size, size))
    for (i, j), both in q.items():
        # whole numbers up to here, and one correctly rounded division by n for the mean and n^2 for the scale
        v[i, j] = v[j, i] = both / n**3 if i == j else (both - q[i, i] - q[j, j]) / (2 * n**3)
    return Whitener(n, sums, *_components(v, components), sum(q[i, i] for i in range(size)) / n**3)


def _components(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first unit eigenvectors, as rows, by falling eigenvalue; each one's largest entry is positive."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:count]
    rows = vectors[:, order].T
    largest = np.abs(rows).argmax(axis=1)
    signs = np.where(rows[np.arange(len(rows)), largest] < 0, -1.0, 1.0)
    return rows * signs[:, None], np.maximum(values[order], 0.0)


def _projected(rows: DataFrame, found: Whitener) -> DataFrame:
    """(id, deviation, w) of (id, x) rows."""
    shared, key = rows.sparkSession.sparkContext.broadcast(vars(found)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with per_worker(f"whitening:{key}", lambda: Whitener(**shared.value)) as whitener:
            for batch in small_batches(batches, 1024):
                x = matrix(batch.column(1))
                far = square_sums(centre(x, whitener.n, whitener.sums), 1)
                w = whitener.project(x)
                ends = np.arange(0, w.size + 1, w.shape[1] or 1, dtype=np.int32)
                values = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(map(Decimal, far), _EXACT), pa.ListArray.from_arrays(pa.array(ends), values)], names=["id", "deviation", "w"]
                )

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, deviation decimal(38,0), w array<double>")


def whiten(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """One row per usable vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Left out are null and empty vectors, those with null, NaN or infinite entries or entries whose whole number passes
    LARGEST, and those whose length is not the commonest one (the greater one of equally common).  Each different vector
    counts once in the fit, however many rows repeat it; repeated rows and null ids are projected like others.  A
    component without variance has null for whitened and counts nothing in identity_error.  Vectors of fewer dimensions
    than *components* have a component for each.  *deviation* is decimal(38,0).  Other columns are ignored; an empty
    table gives an empty one.

    *identity_error* is measured: the whitened vectors of the fit are projected, and their covariances aggregated.
    """
    spark = embeddings.sparkSession
    rows, rounds = whole_numbers(embeddings, id_col, vector_col), Rounds(spark, "whitening")
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    rows = rows.where(F.size("x") == (sizes[0]["size"] if sizes else 0))
    # a vector that many rows repeat is one row of each task before the shuffle
    distinct = rounds.keep(rows.select("x").distinct(), "distinct")
    found = fit(distinct, components)
    schema = f"{id_col} {dict(embeddings.dtypes)[id_col]}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if found is None:
        return spark.createDataFrame([], schema)
    usable = [k for k, e in enumerate(found.variances) if e > NO_VARIANCE * found.total]
    error = 0.0
    if usable:
        w = _projected(distinct.select(F.lit(0).alias("id"), "x"), found)
        pairs = [(a, b) for a in usable for b in usable if a <= b]
        measured = w.agg(*[F.covar_pop(F.col("w")[a], F.col("w")[b]) for a, b in pairs]).first()
        error = max(abs(value - (a == b)) for (a, b), value in zip(pairs, measured))
    rounds.drop("distinct")
    shares = [float(e) / found.total if found.total else 0.0 for e in found.variances]
    out = _projected(rows, found).select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*map(F.lit, shares)), F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
