"""Usable vectors, each distinct one once, and numerics shared by search and clustering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.session import materialize


@dataclass(frozen=True)
class VectorSet:
    """``distinct``: ``id`` and ``vec``, a row for each different vector, under the smallest id that has it.
    ``copies``: ``id``, ``rep`` for all ids of vectors that several ids have, the representative included.
    """

    distinct: DataFrame
    copies: DataFrame
    n: int
    n_copies: int
    width: int


def usable(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """``id`` and ``vec`` of rows with an id and a vector of ``width`` finite numbers."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(key).isNotNull() & (F.size(v) == width) & fine).select(F.col(key).alias("id"), v.cast("array<float>").alias("vec"))


def vector_set(df: DataFrame, key: str, vector: str, width: int) -> VectorSet:
    """The usable vectors of a table. Rows of one id hold the same vector; exact copies are kept aside, however many.

    Equality of vectors is that of two hashes of 64 and 32 bits. Vectors are shuffled once.
    """
    rows = usable(df, key, vector, width)
    # 0.0 and -0.0 are one number
    vec = F.transform("vec", lambda x: x + F.lit(0.0).cast("float"))
    rows = rows.select("id", vec.alias("vec")).select("id", "vec", F.xxhash64("vec").alias("h"), F.hash("vec").alias("g"))
    groups = materialize(
        rows.groupBy("h", "g").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("vec").alias("vec"))
    )
    several = groups.where(F.col("id") != F.col("last")).select("h", "g", F.col("id").alias("rep"))
    n, n_copies = groups.agg(F.count(F.lit(1)), F.count(F.when(F.col("id") != F.col("last"), 1))).first()
    copies = rows.select("id", "h", "g").join(several, ["h", "g"]).select("id", "rep").distinct()
    return VectorSet(groups.select("id", "vec"), materialize(copies) if n_copies else copies.limit(0), n, n_copies, width)


def bounded_sample(vectors: DataFrame, n: int, size: int, seed: int = 0) -> np.ndarray:
    """About ``size`` vectors, chosen by the hash of their ids, at most a tenth more, on the driver."""
    if n <= 0:
        return np.zeros((0, 0), np.float32)
    part = min(1.0, size / n)
    rows = vectors
    if part < 1:
        rows = vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    table = rows.select("id", "vec").limit(int(size * 1.1)).toArrow()
    order = np.argsort(table["id"].to_numpy())
    return matrix(table["vec"].combine_chunks())[order]


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Partitioned by keys into ``spark.sql.shuffle.partitions`` parts that are not put together again.

    For stages whose work is far more than their bytes tell.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of a matrix of single precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def lists(m: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    n, w = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(np.ascontiguousarray(m).ravel()))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to those of ``y``, by one matrix product."""
    d = x @ y.T
    d *= -2
    d += np.einsum("ij,ij->i", x, x)[:, None]
    d += np.einsum("ij,ij->i", y, y)[None, :]
    return np.maximum(d, 0, out=d)


def augmented(y: np.ndarray) -> np.ndarray:
    """``y`` such that a product with ``(x, 1)`` gives squared distances less the squared norm of ``x``."""
    return np.ascontiguousarray(np.concatenate([-2 * y, np.einsum("ij,ij->i", y, y)[:, None]], axis=1).T, dtype=np.float32)


def nearest(x: np.ndarray, centres: np.ndarray, rows: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre of each row and the squared distance to it."""
    at, d, y = np.empty(len(x), np.int64), np.empty(len(x), np.float32), augmented(centres)
    for a in range(0, len(x), rows):
        part = x[a : a + rows]
        s = part @ y[:-1]
        s += y[-1]
        at[a : a + rows] = s.argmin(1)
        # the distance by difference, which loses nothing to large norms
        e = part - centres[at[a : a + rows]]
        d[a : a + rows] = np.einsum("ij,ij->i", e, e)
    return at, d


def lloyd(x: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    """k-means from given centres; a centre that loses all its points moves to the point that lies worst."""
    centres = centres.astype(np.float32).copy()
    for _ in range(rounds):
        at, d = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros(centres.shape, np.float64)
        np.add.at(sums, at, x)
        full = n > 0
        centres[full] = (sums[full] / n[full, None]).astype(np.float32)
        empty = np.flatnonzero(~full)
        if len(empty):
            worst = np.argsort(-d, kind="stable")[: len(empty)]
            centres[empty[: len(worst)]] = x[worst]
    return centres
