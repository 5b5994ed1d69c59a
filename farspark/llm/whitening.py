"""Embedding whitening: vectors on the unit eigenvectors of their covariance, each with variance one.

The covariance is never formed. The rows are integers, so their sums are exact and the centred rows are right to the last bit; each
product of the covariance with a block of vectors is a pass over the distinct rows, whose tasks hand back one small matrix.
Jacobi-Davidson runs on the driver with vectors as long as a row is wide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from farspark.llm.jacobi_davidson import EPS, leading_pairs
from farspark.operators.settle import settle


@dataclass(frozen=True)
class Whitening:
    """What a fit found: rows, exact sums, values (falling) and vectors (rows of `directions`), total variance, and how far the
    covariance of the whitened rows is from the identity."""

    n: int
    sums: tuple[int, ...]
    values: tuple[float, ...]
    directions: tuple[tuple[float, ...], ...]
    trace: float
    identity_error: float


def whole_numbers(rows: DataFrame, vector: str, scale: int, name: str = "x") -> DataFrame:
    """Add `name`: floor(scale * component) of each vector as BIGINTs. Rows without a vector of finite components go.

    Only vectors of the most frequent length stay (the longer of two equally frequent ones): others have no place in one covariance.
    """
    # The guard inside the lambda keeps casts from failing on values that the filter drops anyway.
    number = lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x.cast("double"))
    good = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: number(x).isNotNull())
    kept = rows.filter(F.coalesce(good, F.lit(False)))
    width = kept.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    kept = kept.filter(F.size(vector) == (width["width"] if width else 0))
    return kept.withColumn(name, F.transform(vector, lambda x: F.floor(number(x) * F.lit(float(scale))).cast("bigint")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def _summed(fit: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], size: int, kind: str) -> np.ndarray:
    """The sum over all batches of rows of `kernel(rows)`, an array of `size` numbers. Tasks add up first; the driver gets `size` rows."""
    numbers = np.int64 if kind == "bigint" else np.float64

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=numbers)
        for batch in batches:
            if batch.num_rows:
                total += kernel(_matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["at", "value"])

    out = np.zeros(size, dtype=numbers)
    for row in fit.mapInArrow(part, f"at bigint, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[row["at"]] = row["value"]
    return out


def fit(rows: DataFrame, components: int = 4, x: str = "x") -> Whitening:
    """Fit on each distinct vector of `x` once. Directions of no variance are left out, so there may be fewer than asked for.

    Every pass reads the distinct vectors from shared storage, so a lost executor costs its tasks only.
    """
    distinct = settle(rows.select(x).distinct())
    head = distinct.select(F.size(x)).first()
    if head is None:
        return Whitening(0, (), (), (), 0.0, 0.0)
    width = head[0]
    counted = _summed(distinct, lambda m: np.append(m.sum(axis=0), len(m)), width + 1, "bigint")
    sums, n = counted[:-1], int(counted[-1])
    trace = float(_summed(distinct, lambda m: np.array([np.square(_centred(m, n, sums)).sum()]), 1, "double")[0]) / n
    if not trace > 0:
        return Whitening(n, tuple(map(int, sums)), (), (), 0.0, 0.0)

    def product(block: np.ndarray) -> np.ndarray:
        def kernel(m: np.ndarray) -> np.ndarray:
            c = _centred(m, n, sums)
            return (c.T @ (c @ block)).reshape(-1)

        return _summed(distinct, kernel, block.size, "double").reshape(block.shape) / n

    pairs = leading_pairs(product, width, components)
    kept = int((pairs.values > width * EPS * trace).sum())
    values, vectors = pairs.values[:kept], pairs.vectors[:, :kept]

    def moments(m: np.ndarray) -> np.ndarray:
        w = _centred(m, n, sums) @ vectors / np.sqrt(values)
        return np.append(w.sum(axis=0), (w.T @ w).reshape(-1))

    got = _summed(distinct, moments, kept + kept * kept, "double") / n
    mean, square = got[:kept], got[kept:].reshape(kept, kept)
    error = float(np.abs(square - np.outer(mean, mean) - np.eye(kept)).max())
    return Whitening(n, tuple(map(int, sums)), tuple(map(float, values)), tuple(tuple(map(float, v)) for v in vectors.T), trace, error)


def whiten(rows: DataFrame, model: Whitening, x: str = "x", name: str = "whitened") -> DataFrame:
    """Add `name`: the whitened components of each row's whole-number vector."""
    n, sums = model.n, np.array(model.sums, dtype=np.int64)
    onto = np.array(model.directions).T / np.sqrt(model.values) if model.values else np.empty((len(sums), 0))

    @F.arrow_udf("array<double>")
    def project(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.float64()))
        w = _centred(_matrix(column), n, sums) @ onto
        offsets = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.reshape(-1)))

    return rows.withColumn(name, project(x))


def deviation(model: Whitening, x: str = "x"):
    """The sum of (n x - S)^2 over the components, in BIGINTs: exact, and a sum beyond them stops the query."""
    squares = F.zip_with(x, F.array(*(F.lit(s).cast("bigint") for s in model.sums)), lambda a, s: F.lit(model.n).cast("bigint") * a - s)
    return F.aggregate(squares, F.lit(0).cast("bigint"), lambda total, d: total + d * d)


def whitened_rows(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per vector and component, numbered from 1.

    Rows whose vector is null, empty, of another length than most, or holds null or non-finite entries take no part. Repeated vectors count once in the
    fit and each get their rows; a null key stays null. There are fewer components where the vectors have fewer directions of
    variance, none for an empty table or a single distinct vector. Other columns are not read.
    """
    whole = whole_numbers(rows.select(F.col(key).alias("_key"), F.col(vector).alias("_vector")), "_vector", scale).select("_key", "x")
    model = fit(whole, components)
    if not model.values:
        return whole.limit(0).select(
            F.col("_key").alias(key), F.lit(1).alias("component"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("deviation"),
            F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    explained = F.array(*(F.lit(e / model.trace) for e in model.values))
    out = whiten(whole.withColumn("deviation", deviation(model)), model)
    return out.select("_key", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("_key").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
