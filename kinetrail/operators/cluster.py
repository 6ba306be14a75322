"""Discretisation of feature vectors: nearest centres, grids, k-centres and the rest.

Every clusterer keeps its centres on the driver, where there are few, and assigns
with them in Arrow batches or array expressions. Algorithms that need all pairs
of their points take all rows to the driver, or a sample where one is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kinetrail.functions.distances import distance, pairwise
from kinetrail.functions.linalg import cut_tree, linkage
from kinetrail.operators.preprocessing import literal, width_of
from kinetrail.session import drop, materialize


def nearest_expression(x: Column, centers: np.ndarray, metric: str = "euclidean") -> Column:
    """Struct of ``label`` and ``distance`` of the nearest centre, the first of equals: for few centres, in the JVM."""
    ds = F.array(*(distance(x, literal(c), metric) for c in np.atleast_2d(centers)))
    least = F.array_min(ds)
    return F.struct((F.array_position(ds, least) - 1).cast("int").alias("label"), least.alias("distance"))


def assign_nearest(df: DataFrame, centers: np.ndarray, metric: str = "euclidean", features: str = "features") -> DataFrame:
    """``df`` with ``label`` and ``distance`` of the nearest centre, by matrix arithmetic on Arrow batches.

    Columns of these names that ``df`` has are replaced.
    """
    centers = np.atleast_2d(np.asarray(centers, float))

    @F.pandas_udf("label int, distance double")
    def nearest(rows: pd.Series) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"label": pd.Series(dtype="int32"), "distance": pd.Series(dtype=float)})
        d = pairwise(np.stack(rows.to_numpy()), centers, metric)
        at = d.argmin(axis=1)
        return pd.DataFrame({"label": at.astype(np.int32), "distance": d[np.arange(len(d)), at]})

    kept = [df[c] for c in df.columns if c not in ("label", "distance")]
    return df.select(*kept, nearest(features).alias("__n")).select("*", "__n.label", "__n.distance").drop("__n")


def inertia(assigned: DataFrame) -> float:
    return float(assigned.agg(F.sum("distance")).first()[0] or 0.0)


def distances_to(df: DataFrame, point, metric: str = "euclidean", features: str = "features") -> DataFrame:
    """``df`` with the ``distance`` of each row to one point."""
    return df.withColumn("distance", distance(F.col(features), literal(point), metric))


def cdist(a: DataFrame, b: DataFrame, key: str, metric: str = "euclidean", features: str = "features", most: int = 10_000) -> DataFrame:
    """``a``, ``b``, ``distance`` for all pairs of two sets, of which ``b`` has at most ``most`` rows, which is checked."""
    if b.limit(most + 1).count() > most:
        raise ValueError(f"all pairs need a second set of at most {most} rows")
    x = a.select(F.col(key).alias("a"), F.col(features).alias("__x"))
    y = b.select(F.col(key).alias("b"), F.col(features).alias("__y"))
    return x.crossJoin(F.broadcast(y)).select("a", "b", distance(F.col("__x"), F.col("__y"), metric).alias("distance"))


def pdist(df: DataFrame, key: str, metric: str = "euclidean", features: str = "features", most: int = 10_000) -> DataFrame:
    """``a``, ``b``, ``distance`` for the pairs of one small set, ``a`` before ``b``."""
    return cdist(df, df, key, metric, features, most).where(F.col("a") < F.col("b"))


def sumdist(df: DataFrame, pairs: DataFrame, key: str, metric: str = "euclidean", features: str = "features") -> DataFrame:
    """One row with ``total``, the sum of distances over pairs of keys ``a`` and ``b``."""
    x = df.select(F.col(key).alias("a"), F.col(features).alias("__x"))
    y = df.select(F.col(key).alias("b"), F.col(features).alias("__y"))
    d = pairs.select("a", "b").join(x, "a").join(y, "b")
    return d.agg(F.coalesce(F.sum(distance(F.col("__x"), F.col("__y"), metric)), F.lit(0.0)).alias("total"))


class Clusterer:
    """Base: ``cluster_centers_`` after ``fit``, labels by the nearest of them."""

    metric = "euclidean"
    features = "features"
    cluster_centers_: np.ndarray

    def predict(self, df: DataFrame) -> DataFrame:
        return assign_nearest(df, self.cluster_centers_, self.metric, self.features)

    transform = predict

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).predict(df)

    def _sample(self, df: DataFrame, most: int | None, seed: int, order: list[str] | None = None) -> np.ndarray:
        """At most ``most`` rows by the hash of the row, or all, in ``order``."""
        cols = order or [self.features]
        rows = df.select(*dict.fromkeys([*cols, self.features]))
        if most is not None:
            rows = rows.orderBy(F.xxhash64(*cols, F.lit(seed)), *cols).limit(most)
        rows = rows.orderBy(*cols).collect()
        return np.array([r[self.features] for r in rows], float)


class NDGrid(Clusterer):
    """A regular grid: the label is the sum of the bins of the features, the first least significant. Out of range fails."""

    def __init__(self, n_bins_per_feature: int = 2, min=None, max=None, features: str = "features"):
        self.n, self.min, self.max, self.features = n_bins_per_feature, min, max, features

    def fit(self, df: DataFrame) -> NDGrid:
        k = self.n_features_ = width_of(df, self.features)
        if self.min is None or self.max is None:
            x = F.col(self.features)
            row = df.agg(*(F.min(x[i]).alias(f"a{i}") for i in range(k)), *(F.max(x[i]).alias(f"b{i}") for i in range(k))).first()
        low = [float(row[f"a{i}"]) for i in range(k)] if self.min is None else np.broadcast_to(self.min, k)
        high = [float(row[f"b{i}"]) for i in range(k)] if self.max is None else np.broadcast_to(self.max, k)
        self.low_, self.high_ = np.asarray(low, float) - 1e-10, np.asarray(high, float) + 1e-10
        return self

    def expression(self, x: Column) -> Column:
        label = F.lit(0).cast("long")
        for i in range(self.n_features_):
            a, b = float(self.low_[i]), float(self.high_[i])
            v = x[i].cast("double")
            bin_ = F.floor((v - a) / ((b - a) / self.n))
            inside = (v >= a) & (v <= b)
            label = label + F.when(inside, F.least(bin_, F.lit(self.n - 1))).otherwise(F.raise_error(F.lit("a value lies outside the grid")).cast("long")) * self.n**i
        return label

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("label", self.expression(F.col(self.features)))

    transform = predict


class KCenters(Clusterer):
    """Farthest-first traversal. A round is one scan that keeps for each partition its farthest row; no distances are stored.

    ``cluster_ids_`` are the keys of the centres. ``first`` names the first centre, else
    it is drawn by the hash of the key. Of equally far rows the smallest key is taken.
    """

    def __init__(self, n_clusters: int = 8, metric: str = "euclidean", key: str = "id", first=None, seed: int = 0, features: str = "features"):
        self.n_clusters, self.metric, self.key, self.first, self.seed, self.features = n_clusters, metric, key, first, seed, features

    def fit(self, df: DataFrame) -> KCenters:
        rows = df.select(F.col(self.key).alias("__k"), F.col(self.features).alias("__x")).persist()
        start = rows.where(F.col("__k") == F.lit(self.first)) if self.first is not None else rows.orderBy(F.xxhash64("__k", F.lit(self.seed)), "__k")
        r = start.first()
        if r is None:
            raise ValueError("there is no row to begin with")
        keys, centers = [r["__k"]], [np.asarray(r["__x"], float)]
        metric = self.metric
        while len(centers) < self.n_clusters:
            known = np.array(centers)

            def farthest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                best = None
                for part in parts:
                    if len(part):
                        d = pairwise(np.stack(part["__x"].to_numpy()), known, metric).min(axis=1)
                        part = part.assign(d=d)
                        top = part[d == d.max()].sort_values("__k").iloc[:1]
                        if best is None or (top["d"].iloc[0], best["__k"].iloc[0]) > (best["d"].iloc[0], top["__k"].iloc[0]):
                            best = top
                if best is not None:
                    yield best

            schema = T.StructType([*rows.schema, T.StructField("d", T.DoubleType())])
            r = rows.mapInPandas(farthest, schema).orderBy(F.desc("d"), "__k").first()
            if r["d"] == 0:
                break  # no more different rows
            keys.append(r["__k"])
            centers.append(np.asarray(r["__x"], float))
        rows.unpersist()
        self.cluster_ids_, self.cluster_centers_ = keys, np.array(centers)
        return self


class RegularSpatial(Clusterer):
    """Leaders: rows farther than ``d_min`` from each other, such that every row lies within it of one.

    Ranges of ``order`` find their own leaders in order; these are merged in order,
    and rows that lost their leader in the merge follow. With ``partitions=1`` the
    result is that of one pass over all rows in order, which streams through one task.
    """

    partitions: int | None = None

    def __init__(self, d_min: float = 1.0, metric: str = "euclidean", order: list[str] | None = None, partitions: int | None = None, features: str = "features"):
        self.d_min, self.metric, self.order, self.partitions, self.features = d_min, metric, order or ["id"], partitions, features

    def fit(self, df: DataFrame) -> RegularSpatial:
        order, features, d_min, metric = self.order, self.features, self.d_min, self.metric
        rows = df.select(*order, F.col(features).alias("__x")).repartitionByRange(*([self.partitions] if self.partitions else []), *order).sortWithinPartitions(*order)

        def leaders(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = np.zeros((0, 0))
            for part in parts:
                if not len(part):
                    continue
                x = np.stack(part["__x"].to_numpy()).astype(float)
                known, fresh = _lead(x, known, d_min, metric)
                if fresh:
                    yield part.iloc[fresh]

        found = rows.mapInPandas(leaders, rows.schema).orderBy(*order).collect()
        x = np.array([r["__x"] for r in found], float)
        # a row that an earlier partition covers is none; one that was covered by such a row may be
        self.cluster_centers_, fresh = _lead(x, np.zeros((0, 0)), d_min, metric)
        self.cluster_ids_ = [tuple(found[i][c] for c in order) for i in fresh]
        left = self.predict(df).where(F.col("distance") > d_min)
        while True:  # rows that lost their leader, in order
            r = left.orderBy(*order).first()
            if r is None:
                return self
            self.cluster_centers_ = np.vstack([self.cluster_centers_, np.asarray(r[features], float)])
            self.cluster_ids_.append(tuple(r[c] for c in order))
            left = self.predict(df).where(F.col("distance") > d_min)


def _lead(x: np.ndarray, known: np.ndarray, d_min: float, metric: str) -> tuple[np.ndarray, list[int]]:
    leaders, fresh = [*known], []
    d = pairwise(x, known, metric).min(axis=1) if len(known) else np.full(len(x), np.inf)
    for i in range(len(x)):
        if d[i] > d_min:
            leaders.append(x[i])
            fresh.append(i)
            d = np.minimum(d, pairwise(x, x[i : i + 1], metric)[:, 0])
    return np.array(leaders), fresh


class KMedoids(Clusterer):
    """Alternation of assignment and medoids over all rows, or a sample of ``max_sample``; the best of several random starts.

    Distances are made in blocks when needed, so the driver holds the rows but not all pairs.
    """

    def __init__(self, n_clusters: int = 8, n_passes: int = 1, metric: str = "euclidean", max_sample: int | None = None, seed: int = 0, features: str = "features"):
        self.n_clusters, self.n_passes, self.metric, self.max_sample, self.seed, self.features = n_clusters, n_passes, metric, max_sample, seed, features

    def fit(self, df: DataFrame) -> KMedoids:
        x = self._sample(df, self.max_sample, self.seed)
        if len(x) < self.n_clusters:
            raise ValueError("fewer rows than clusters")
        rng = np.random.default_rng(self.seed)
        best = (np.inf, None)
        for _ in range(self.n_passes):
            medoids = rng.choice(len(x), self.n_clusters, replace=False)
            best = min(best, _medoid_rounds(x, medoids, self.metric), key=lambda b: b[0])
        self.inertia_ = best[0]
        self.cluster_centers_ = x[np.sort(best[1])]
        return self


#: Rows whose distances to all others are made at once.
BLOCK = 1000


def _medoid_rounds(x: np.ndarray, medoids: np.ndarray, metric: str, rounds: int = 300) -> tuple[float, np.ndarray]:
    for _ in range(rounds):
        labels = pairwise(x, x[medoids], metric).argmin(axis=1)
        new = medoids.copy()
        for k in range(len(medoids)):
            inside = np.flatnonzero(labels == k)
            if len(inside):
                cost = np.concatenate([pairwise(x[inside], x[inside[i : i + BLOCK]], metric).sum(axis=0) for i in range(0, len(inside), BLOCK)])
                new[k] = inside[cost.argmin()]
        if (new == medoids).all():
            break
        medoids = new
    return float(pairwise(x, x[medoids], metric).min(axis=1).sum()), medoids


class _Passes:
    """All rows in batches, in another order by hash in each pass; the driver holds one partition at a time.

    Equal rows are numbered, so that copies of one are spread over the batches.
    """

    def __init__(self, df: DataFrame, features: str, batch_size: int, seed: int):
        counted = df.where(F.col(features).isNotNull()).groupBy(F.col(features).alias("x")).agg(F.count(F.lit(1)).alias("n"))
        self.rows = materialize(counted.select("x", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")))
        self.n, self.size, self.seed = self.rows.count(), batch_size, seed

    def first(self, k: int) -> np.ndarray:
        """Rows to begin with by hash, copies of one only where there are too few others."""
        if self.n < k:
            raise ValueError("fewer rows than clusters")
        rows = self.rows.orderBy("i", F.xxhash64("x", F.lit(self.seed)), "x").limit(k)
        return np.array([r["x"] for r in rows.collect()], float)

    def batches(self, number: int) -> Iterator[np.ndarray]:
        rows = (r["x"] for r in self._ordered(number).toLocalIterator())
        while batch := list(islice(rows, self.size)):
            yield np.array(batch, float)

    def _ordered(self, number: int) -> DataFrame:
        return self.rows.orderBy(F.xxhash64("x", "i", F.lit(self.seed), F.lit(number)), "x", "i").select("x")


class MiniBatchKMedoids(Clusterer):
    """k-medoids over batches joined to the medoids so far.

    ``max_iter`` counts passes over all rows. After the first, fitting ends once the medoids
    have stayed the same for ``max_no_improvement`` batches. ``n_rows_`` are the rows that were read.
    """

    def __init__(self, n_clusters: int = 8, max_iter: int = 5, batch_size: int = 100, metric: str = "euclidean", max_no_improvement: int = 10, seed: int = 0, features: str = "features"):
        self.n_clusters, self.max_iter, self.batch_size, self.metric = n_clusters, max_iter, batch_size, metric
        self.max_no_improvement, self.seed, self.features = max_no_improvement, seed, features

    def fit(self, df: DataFrame) -> MiniBatchKMedoids:
        passes = _Passes(df, self.features, self.batch_size, self.seed)
        centers, still, self.n_rows_ = passes.first(self.n_clusters), 0, 0
        for p in range(self.max_iter):
            for batch in passes.batches(p):
                pool = np.vstack([centers, batch])
                _, m = _medoid_rounds(pool, np.arange(self.n_clusters), self.metric)
                # a copy of a medoid is the same medoid
                still = still + 1 if (pool[m] == centers).all() else 0
                centers, self.n_rows_ = pool[m], self.n_rows_ + len(batch)
                if self.n_rows_ >= passes.n and still >= self.max_no_improvement:
                    break
            else:
                continue
            break
        drop(passes.rows)
        self.cluster_centers_ = centers
        return self


class LandmarkAgglomerative(Clusterer):
    """Hierarchical clustering of landmarks; a row goes to the cluster of least pooled distance to its landmarks."""

    def __init__(self, n_clusters: int, n_landmarks: int = 500, linkage: str = "average", metric: str | Callable = "euclidean", ward_predictor: str = "ward", seed: int = 0, features: str = "features"):
        self.n_clusters, self.n_landmarks, self.linkage, self.metric, self.ward_predictor, self.seed, self.features = n_clusters, n_landmarks, linkage, metric, ward_predictor, seed, features

    def _distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.stack([self.metric(x, y, i) for i in range(len(y))], 1) if callable(self.metric) else pairwise(x, y, self.metric)

    def fit(self, df: DataFrame) -> LandmarkAgglomerative:
        self.landmarks_ = self._sample(df, self.n_landmarks, self.seed)
        d = self._distances(self.landmarks_, self.landmarks_)
        self.landmark_labels_ = cut_tree(linkage((d + d.T) / 2, self.linkage), min(self.n_clusters, len(self.landmarks_)))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        marks, labels, k = self.landmarks_, self.landmark_labels_, int(self.landmark_labels_.max()) + 1
        pool = self.ward_predictor if self.linkage == "ward" else self.linkage
        inner = np.array([self._distances(marks[labels == c], marks[labels == c]).__pow__(2).sum() / max(1, 2 * (labels == c).sum() ** 2) for c in range(k)])
        measure = self._distances

        @F.pandas_udf("int")
        def nearest(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype="int32")
            d = measure(np.stack(rows.to_numpy()).astype(float), marks)
            out = []
            for c in range(k):
                part = d[:, labels == c]
                if pool == "ward":
                    n = part.shape[1]
                    out.append(np.sqrt(np.clip(((part**2).mean(axis=1) - inner[c]) * 2 * n / (n + 1), 0, None)))
                else:
                    out.append({"average": part.mean, "complete": part.max, "single": part.min}[pool](axis=1))
            return pd.Series(np.stack(out, 1).argmin(axis=1).astype(np.int32))

        return df.withColumn("label", nearest(self.features))

    transform = predict


class KMeans(Clusterer):
    """Spark's k-means with parallel seeding."""

    def __init__(self, n_clusters: int = 8, max_iter: int = 20, seed: int = 0, features: str = "features"):
        self.n_clusters, self.max_iter, self.seed, self.features = n_clusters, max_iter, seed, features

    def fit(self, df: DataFrame) -> KMeans:
        from pyspark.ml.clustering import KMeans as Spark
        from pyspark.ml.functions import array_to_vector

        rows = df.select(array_to_vector(F.col(self.features)).alias("v")).persist()
        model = Spark(k=self.n_clusters, maxIter=self.max_iter, seed=self.seed, featuresCol="v").fit(rows)
        rows.unpersist()
        self.cluster_centers_ = np.array(model.clusterCenters())
        self.inertia_ = model.summary.trainingCost
        return self


class MiniBatchKMeans(Clusterer):
    """k-means over batches: centres move by the running mean of what they were given.

    ``max_iter`` counts passes over all rows. After the first, fitting ends once the smoothed
    inertia has not fallen for ``max_no_improvement`` batches. ``n_rows_`` are the rows that were read.
    """

    def __init__(self, n_clusters: int = 8, batch_size: int = 1000, max_iter: int = 20, seed: int = 0, features: str = "features", max_no_improvement: int = 10):
        self.n_clusters, self.batch_size, self.max_iter, self.seed, self.features = n_clusters, batch_size, max_iter, seed, features
        self.max_no_improvement = max_no_improvement

    def fit(self, df: DataFrame) -> MiniBatchKMeans:
        passes = _Passes(df, self.features, self.batch_size, self.seed)
        centers, n, self.n_rows_ = passes.first(self.n_clusters), np.zeros(self.n_clusters), 0
        weight = min(1.0, 2 * self.batch_size / (passes.n + 1))
        smooth, least, still = None, np.inf, 0
        for p in range(self.max_iter):
            for batch in passes.batches(p):
                d = pairwise(batch, centers, "sqeuclidean")
                at, cost = d.argmin(axis=1), float(d.min(axis=1).mean())
                for k in np.unique(at):
                    part = batch[at == k]
                    n[k] += len(part)
                    centers[k] += (part.mean(axis=0) - centers[k]) * len(part) / n[k]
                smooth = cost if smooth is None else smooth + weight * (cost - smooth)
                least, still = (smooth, 0) if smooth < least else (least, still + 1)
                self.n_rows_ += len(batch)
                if self.n_rows_ >= passes.n and still >= self.max_no_improvement:
                    break
            else:
                continue
            break
        drop(passes.rows)
        self.cluster_centers_ = centers
        return self


class GMM:
    """Spark's Gaussian mixture, the likeliest of ``n_init`` starts; ``predict`` adds ``label`` and ``probability``."""

    def __init__(self, n_components: int = 2, max_iter: int = 50, n_init: int = 5, seed: int = 0, features: str = "features"):
        self.n_components, self.max_iter, self.n_init, self.seed, self.features = n_components, max_iter, n_init, seed, features

    def fit(self, df: DataFrame) -> GMM:
        from pyspark.ml.clustering import GaussianMixture
        from pyspark.ml.functions import array_to_vector

        rows = df.select(array_to_vector(F.col(self.features)).alias("__v")).persist()
        fits = [
            GaussianMixture(k=self.n_components, maxIter=self.max_iter, seed=self.seed + i, featuresCol="__v", predictionCol="label", probabilityCol="__p").fit(rows)
            for i in range(self.n_init)
        ]
        rows.unpersist()
        self.model_ = max(fits, key=lambda m: m.summary.logLikelihood)
        self.means_ = np.array([g.mean.toArray() for g in self.model_.gaussians])
        self.weights_ = np.array(self.model_.weights)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        out = self.model_.transform(df.withColumn("__v", array_to_vector(F.col(self.features))))
        return out.withColumn("probability", vector_to_array("__p")).drop("__v", "__p")


class _SampleClusterer(Clusterer):
    """Clusterers of all rows, or of a sample of ``max_sample``; any row takes the label of the nearest row that was fitted."""

    def __init__(self, max_sample: int | None = None, metric: str = "euclidean", seed: int = 0, features: str = "features"):
        self.max_sample, self.metric, self.seed, self.features = max_sample, metric, seed, features

    def _labels(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def fit(self, df: DataFrame):
        self.sample_ = self._sample(df, self.max_sample, self.seed)
        self.labels_ = self._labels(self.sample_)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        labels = np.asarray(self.labels_, np.int32)
        near = assign_nearest(df, self.sample_, self.metric, self.features)
        return near.withColumn("label", F.pandas_udf(lambda at: pd.Series(labels[at.to_numpy()]), "int")("label"))

    transform = predict


class AgglomerativeClustering(_SampleClusterer):
    def __init__(self, n_clusters: int = 2, linkage: str = "ward", **kw):
        super().__init__(**kw)
        self.n_clusters, self.linkage = n_clusters, linkage

    def _labels(self, x):
        return cut_tree(linkage(pairwise(x, x, self.metric), self.linkage), min(self.n_clusters, len(x)))


class SpectralClustering(_SampleClusterer):
    """k-means on the leading eigenvectors of the normalised affinity."""

    def __init__(self, n_clusters: int = 8, gamma: float = 1.0, **kw):
        super().__init__(**kw)
        self.n_clusters, self.gamma = n_clusters, gamma

    def _labels(self, x):
        a = np.exp(-self.gamma * pairwise(x, x, "sqeuclidean"))
        root = 1 / np.sqrt(a.sum(axis=1))
        _, v = np.linalg.eigh(a * root[:, None] * root[None, :])
        y = v[:, -self.n_clusters :] * root[:, None]
        return _small_kmeans(y, self.n_clusters, self.seed)


def _small_kmeans(y: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    best = (np.inf, None)
    for _ in range(10):
        c = [y[rng.integers(len(y))]]
        for _ in range(k - 1):
            d = pairwise(y, np.array(c), "sqeuclidean").min(axis=1)
            c.append(y[rng.choice(len(y), p=d / d.sum())] if d.sum() > 0 else y[rng.integers(len(y))])
        c = np.array(c)
        for _ in range(100):
            at = pairwise(y, c, "sqeuclidean").argmin(axis=1)
            new = np.array([y[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = pairwise(y, c, "sqeuclidean").min(axis=1).sum()
        if cost < best[0]:
            best = (cost, at)
    return best[1]


class AffinityPropagation(_SampleClusterer):
    """Messages between the points until exemplars stand."""

    def __init__(self, damping: float = 0.7, max_iter: int = 200, preference: float | None = None, **kw):
        super().__init__(**kw)
        self.damping, self.max_iter, self.preference = damping, max_iter, preference

    def _labels(self, x):
        s = -pairwise(x, x, "sqeuclidean")
        n = len(x)
        np.fill_diagonal(s, np.median(s[~np.eye(n, dtype=bool)]) if self.preference is None and n > 1 else self.preference or 0.0)
        r, a = np.zeros((n, n)), np.zeros((n, n))
        for _ in range(self.max_iter):
            t = a + s
            top = t.argmax(axis=1)
            first = t[np.arange(n), top]
            t[np.arange(n), top] = -np.inf
            other = np.tile(first[:, None], (1, n))
            other[np.arange(n), top] = t.max(axis=1)
            r = self.damping * r + (1 - self.damping) * (s - other)
            p = np.maximum(r, 0)
            np.fill_diagonal(p, np.diag(r))
            new = p.sum(axis=0)[None, :] - p
            own = np.diag(new).copy()
            new = np.minimum(new, 0)
            np.fill_diagonal(new, own)
            a = self.damping * a + (1 - self.damping) * new
        centers = np.flatnonzero(np.diag(r + a) > 0)
        if not len(centers):
            centers = np.array([int(np.argmax(s.sum(axis=0)))])
        at = s[:, centers].argmax(axis=1)
        at[centers] = np.arange(len(centers))
        self.exemplars_ = x[centers]
        return at


class MeanShift(_SampleClusterer):
    """Points climb to the modes of a flat kernel of a bandwidth; modes nearer than it are one."""

    def __init__(self, bandwidth: float = 1.0, max_iter: int = 100, **kw):
        super().__init__(**kw)
        self.bandwidth, self.max_iter = bandwidth, max_iter

    def _labels(self, x):
        y = np.concatenate([self._climb(x[i : i + BLOCK], x) for i in range(0, len(x), BLOCK)])
        self.modes_, _ = _lead(y, np.zeros((0, 0)), self.bandwidth, "euclidean")
        return pairwise(y, self.modes_).argmin(axis=1)

    def _climb(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        for _ in range(self.max_iter):
            inside = pairwise(y, x) <= self.bandwidth
            new = (inside @ x) / inside.sum(axis=1, keepdims=True)
            if np.abs(new - y).max() < 1e-6:
                break
            y = new
        return y


class NearestFrames:
    """k nearest frames of a set to given points: distance and keys, the nearest first. The points are few and given."""

    def __init__(self, df: DataFrame, key: list[str], features: str = "features"):
        self.df, self.key, self.features = df, key, features

    def query(self, points: np.ndarray, k: int = 1, p: float = 2, bound: float | None = None) -> DataFrame:
        """``query``, ``rank`` from 0, ``distance`` and the key. ``p`` is the Minkowski power, ``bound`` the largest distance."""
        points = np.atleast_2d(np.asarray(points, float))
        key, features = self.key, self.features
        rows = self.df.select(*key, F.col(features).alias("__x"))
        schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("distance", T.DoubleType()), *(rows.schema[c] for c in key)])

        def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # of each batch no more than k rows a point go on
            for part in parts:
                if not len(part):
                    continue
                x = np.stack(part["__x"].to_numpy()).astype(float)
                for q, y in enumerate(points):
                    d = (np.abs(x - y) ** p).sum(axis=1) ** (1 / p) if np.isfinite(p) else np.abs(x - y).max(axis=1)
                    out = part[key].assign(query=q, distance=d)
                    out = out if bound is None else out[d <= bound]
                    yield out.sort_values(["distance", *key]).head(k)[["query", "distance", *key]]

        ranked = W.partitionBy("query").orderBy("distance", *key)
        found = rows.mapInPandas(best, schema).withColumn("rank", F.row_number().over(ranked) - 1)
        return found.where(F.col("rank") < k).select("query", "rank", "distance", *key)
