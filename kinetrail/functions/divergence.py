"""Divergences between distributions, in NumPy for rows of a matrix and in Spark for tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kl_divergence(target: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Kullback-Leibler divergence of rows; terms where either is 0 are left out, a negative result counts as 0."""
    p, q = np.atleast_2d(target).astype(float), np.atleast_2d(ref).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        term = np.where((p > 0) & (q > 0), p * np.log(p / q), 0.0)
    return np.clip(term.sum(axis=1), 0, None)


def sym_kl_divergence(target: np.ndarray, ref: np.ndarray) -> np.ndarray:
    return kl_divergence(target, ref) + kl_divergence(ref, target)


def js_divergence(target: np.ndarray, ref: np.ndarray) -> np.ndarray:
    m = 0.5 * (np.atleast_2d(target) + np.atleast_2d(ref))
    return 0.5 * kl_divergence(target, m) + 0.5 * kl_divergence(ref, m)


def js_metric(target: np.ndarray, ref: np.ndarray) -> np.ndarray:
    return np.sqrt(js_divergence(target, ref))


def frobenius(target: np.ndarray, ref: np.ndarray) -> float:
    return float(np.linalg.norm(np.asarray(target) - np.asarray(ref)))


def row_distance(kind):
    """A divergence as ``f(rows, row, i)`` for the clustering of rows."""
    return lambda rows, other, i: kind(rows, np.broadcast_to(other[i], np.shape(rows)))


js_metric_array = row_distance(js_metric)
js_divergence_array = row_distance(js_divergence)
sym_kl_divergence_array = row_distance(sym_kl_divergence)


def frobenius_array(rows: np.ndarray, other: np.ndarray, i: int) -> np.ndarray:
    return np.linalg.norm(np.asarray(rows) - np.asarray(other)[i], axis=1)


def of_matrices(kind, target: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """A divergence of the rows of two transition matrices, given flat or square."""
    n = int(round(np.size(target) ** 0.5))
    return kind(np.reshape(target, (n, n)), np.reshape(ref, (n, n)))


def divergence_table(p: DataFrame, q: DataFrame, keys: list[str], item: str, weight: str = "p") -> DataFrame:
    """``keys``, ``kl`` (of ``p`` from ``q``) and ``js`` for distributions stored as (keys, item, weight)."""
    a = p.select(*keys, item, F.col(weight).alias("__p"))
    b = q.select(*keys, item, F.col(weight).alias("__q"))
    both = a.join(b, [*keys, item], "full").na.fill(0.0, ["__p", "__q"])
    m = (F.col("__p") + F.col("__q")) / 2
    log = lambda x, y: F.when((x > 0) & (y > 0), x * F.ln(x / y)).otherwise(0.0)
    return both.groupBy(*keys).agg(
        F.greatest(F.sum(log(F.col("__p"), F.col("__q"))), F.lit(0.0)).alias("kl"),
        F.greatest(F.sum((log(F.col("__p"), m) + log(F.col("__q"), m)) / 2), F.lit(0.0)).alias("js"),
    )
