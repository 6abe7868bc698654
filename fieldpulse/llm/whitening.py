"""Whitening of embeddings by shifted Cholesky QR."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shared_table

#: Entries are whole multiples of 1 / SCALE.
SCALE = 256
COMPONENTS = 4
#: Gram passes that give a factor; a last one measures what they leave.
PASSES = 4
#: A Gram matrix this close to the identity is not factored again.
CLOSE = 1e-11
#: Singular values below this share of the largest are directions without spread.
FLAT = 1e-12
UNIT = 2.0 ** -53
#: Rows whose products a task adds up before it adds them to its total.
STRETCH = 4096


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) of each entry, or null for a vector that is null or
    holds null or non-finite entries."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(finite, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("bigint")))


def _matrices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for start in range(0, b.num_rows, STRETCH):
            part = b.slice(start, STRETCH)
            yield part, part.column(column).flatten().to_numpy().reshape(part.num_rows, -1)


def _total(fit: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Number of vectors and the sum of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 1, np.int64)
        for _, x in _matrices(batches, 0):
            total += np.append(x.sum(axis=0), len(x))
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array(total)], ["at", "s"])

    out = np.zeros(dims + 1, np.int64)
    for r in fit.select("x").mapInArrow(run, "at int, s bigint").groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[r["at"]] = r["s"]
    return int(out[-1]), out[:-1]


def solve_rows(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular factor, column after column."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _gram(fit: DataFrame, mean: np.ndarray, of) -> np.ndarray:
    """Sum of the products of each pair of columns of ``of(centred rows)``.

    A task adds up its rows and passes on one row per pair; those are summed in
    Spark, so the driver gets the upper triangle of one matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, 0):
            q = of(x - mean)
            total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])],
                                             ["i", "j", "g"])

    sums = fit.select("x").mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    side = int(sums["j"].max()) + 1
    out = np.zeros((side, side))
    out[sums["i"], sums["j"]] = sums["g"]
    return out + np.triu(out, 1).T


def factors(fit: DataFrame, mean: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Upper triangular factors R1, R2, ... of the centred rows and the Gram matrix of
    what they leave of them.

    The first Gram matrix may be near singular or singular, so it is shifted by
    the rounding error it can have; the rows divided by its factor are well
    conditioned, and the next passes bring them to orthonormal columns.  A dimension
    without spread of its own stays a column of zeros."""
    found: list[np.ndarray] = []
    while True:
        def reduced(rows: np.ndarray, so_far=tuple(found)) -> np.ndarray:
            for factor in so_far:
                rows = solve_rows(rows, factor)
            return rows

        g = _gram(fit, mean, reduced)
        d = len(g)
        if len(found) == PASSES or found and np.abs(g - np.eye(d)).max() < CLOSE:
            return found, g
        spread = float(np.trace(g))
        if not spread:
            return found, g
        shift = 11 * (d * min(n, STRETCH) + d * (d + 1)) * UNIT * spread
        found.append(np.linalg.cholesky(g + (shift if not found else UNIT * d * spread) * np.eye(d)).T)


def components(fit: DataFrame, n: int, sums: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors (rows) and eigenvalues of the covariance, and its trace.

    The centred rows are Q R with R the product of the factors; what Q lacks to
    orthonormal columns is in its Gram matrix, whose root completes R.  R's singular
    values and right singular vectors are those of the rows."""
    found, rest = factors(fit, sums / n, n)
    values, vectors = np.linalg.eigh(rest)
    r = np.sqrt(np.maximum(values, 0))[:, None] * vectors.T
    for factor in reversed(found):
        r = r @ factor
    _, spread, axes = np.linalg.svd(r)
    keep = [k for k in range(min(most, len(spread))) if spread[k] > FLAT * spread[0]]
    axes = axes[keep]
    axes *= np.sign(axes[np.arange(len(keep)), np.abs(axes).argmax(axis=1)])[:, None]
    return axes, spread[keep] ** 2 / n, float((spread ** 2).sum() / n)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - sum)^2; null beyond 64 bits."""
    bound = n * max(int(np.abs(x).max(initial=0)), 1) + int(np.abs(sums).max(initial=0))
    if len(sums) * bound * bound < 1 << 63:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS,
           scale: int = SCALE) -> DataFrame:
    """One row (vec_id, component, n, deviation, whitened, explained,
    identity_error) per remaining row and component.

    Rows whose vector is null, or holds null or non-finite entries, are left out,
    and so are rows of another length than most distinct vectors have (ties: the
    longer).  The fit counts equal vectors once.  Directions without spread give no
    component, so a table with one distinct vector, or none, gives an empty result.
    ``deviation`` is null where it exceeds 64 bits; entries of 2^31 or more in size
    may fail the sums.  Null ids stay null, repeated rows give repeated rows, other
    columns are not read.  Matrices of dimension squared reach the driver and the
    tasks, whatever the number of rows."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("vec_id"), whole(F.col(vector_col), scale).alias("x")).where("x is not null")
    fit = shared_table(rows.select("x").distinct(), "whitening")
    schema = (f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    longest = fit.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = longest["dims"] if longest else 0
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    fit, rows = fit.where(F.size("x") == dims), rows.where(F.size("x") == dims)
    n, sums = _total(fit, dims)
    axes, values, trace = components(fit, n, sums, most)
    k = len(values)
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    mean, to = sums / n, axes.T / np.sqrt(values)
    error = float(np.abs(_gram(fit, mean, lambda centred: centred @ to) / n - np.eye(k)).max())
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _matrices(batches, 1):
            m = len(x)
            deviation = pa.array(_deviations(x, n, sums), pa.int64())
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, n)), deviation.take(each), pa.array(((x - mean) @ to).ravel()),
                 pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
