"""Distance kernels between arrays as Spark expressions, evaluated in the JVM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("euclidean", "sqeuclidean", "cityblock", "chebyshev", "canberra", "braycurtis", "hamming", "jaccard")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def distance(u: Column, v: Column, metric: str = "euclidean") -> Column:
    """Distance of two arrays of one length. Where the formula has 0 / 0 the result is NULL."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    d = lambda f: F.zip_with(u, v, lambda a, b: f(a.cast("double"), b.cast("double")))
    if metric == "sqeuclidean":
        return _sum(d(lambda a, b: (a - b) * (a - b)))
    if metric == "euclidean":
        return F.sqrt(distance(u, v, "sqeuclidean"))
    if metric == "cityblock":
        return _sum(d(lambda a, b: F.abs(a - b)))
    if metric == "chebyshev":
        return F.array_max(d(lambda a, b: F.abs(a - b)))
    if metric == "canberra":
        return _sum(d(lambda a, b: F.when((a != 0) | (b != 0), F.abs(a - b) / (F.abs(a) + F.abs(b))).otherwise(0.0)))
    if metric == "braycurtis":
        return F.try_divide(_sum(d(lambda a, b: F.abs(a - b))), _sum(d(lambda a, b: F.abs(a + b))))
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    if metric == "hamming":
        return F.try_divide(_sum(d(lambda a, b: one(a != b))), F.size(u).cast("double"))
    some = lambda a, b: (a != 0) | (b != 0)
    return F.try_divide(_sum(d(lambda a, b: one((a != b) & some(a, b)))), _sum(d(lambda a, b: one(some(a, b)))))


def pairwise(x: np.ndarray, y: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances of the rows of two small matrices, on the driver or in a worker."""
    x, y = np.atleast_2d(x).astype(float), np.atleast_2d(y).astype(float)
    if metric == "rmsd":  # rows are flat coordinates
        return np.stack([kabsch_rmsd(x.reshape(len(x), -1, 3), r.reshape(-1, 3)) for r in y], 1)
    if metric in ("euclidean", "sqeuclidean"):
        s = np.stack([((x - r) ** 2).sum(axis=1) for r in y], 1) if len(y) * x.size < 1e7 else np.clip((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0, None)
        return s if metric == "sqeuclidean" else np.sqrt(s)
    out = np.empty((len(x), len(y)))
    with np.errstate(divide="ignore", invalid="ignore"):
        for j, r in enumerate(y):
            d = np.abs(x - r)
            if metric == "cityblock":
                out[:, j] = d.sum(1)
            elif metric == "chebyshev":
                out[:, j] = d.max(1)
            elif metric == "canberra":
                out[:, j] = np.nan_to_num(d / (np.abs(x) + np.abs(r))).sum(1)
            elif metric == "braycurtis":
                out[:, j] = d.sum(1) / np.abs(x + r).sum(1)
            elif metric == "hamming":
                out[:, j] = (x != r).mean(1)
            elif metric == "jaccard":
                some = (x != 0) | (r != 0)
                out[:, j] = ((x != r) & some).sum(1) / some.sum(1)
            else:
                raise ValueError(f"unknown metric {metric!r}")
    return out


def kabsch_rmsd(x: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Least root-mean-square deviation of frames (frames, atoms, 3) from a reference over rotations, both centred."""
    a = x - x.mean(axis=1, keepdims=True)
    b = ref - ref.mean(axis=0, keepdims=True)
    h = np.einsum("fai,aj->fij", a, b)
    s = np.linalg.svd(h, compute_uv=False)
    s[:, -1] *= np.sign(np.linalg.det(h))
    inner = (a**2).sum(axis=(1, 2)) + (b**2).sum() - 2 * s.sum(axis=1)
    return np.sqrt(np.clip(inner, 0, None) / x.shape[1])


def superpose(x: np.ndarray, ref: np.ndarray, atoms: np.ndarray | None = None) -> np.ndarray:
    """Frames moved and turned onto a reference, by the given atoms."""
    atoms = np.arange(x.shape[1]) if atoms is None else np.asarray(atoms)
    ca, cb = x[:, atoms].mean(axis=1, keepdims=True), ref[atoms].mean(axis=0)
    h = np.einsum("fai,aj->fij", x[:, atoms] - ca, ref[atoms] - cb)
    u, _, vt = np.linalg.svd(h)
    flip = np.sign(np.linalg.det(u @ vt))
    u[:, :, -1] *= flip[:, None]
    return (x - ca) @ (u @ vt) + cb
