"""Linear projections from moments: one scan sums the moments, the driver solves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from kinetrail.functions.linalg import generalized_eigh
from kinetrail.plans.trajectories import Trajectories


@dataclass
class Moments:
    """Additive statistics of lagged pairs of frames. ``n`` pairs; ``x``, ``y`` sums of the earlier and the later
    frames; ``xy``, ``xx``, ``yy`` sums of outer products; ``frames`` all frames and ``sequences`` long enough trajectories."""

    n: float
    frames: float
    sequences: float
    x: np.ndarray
    y: np.ndarray
    xy: np.ndarray
    xx: np.ndarray
    yy: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(*(getattr(self, f) + getattr(other, f) for f in self.__dataclass_fields__))


def lagged_moments(t: Trajectories, lag: int) -> Moments:
    """Moments of frames ``lag`` apart in one trajectory; trajectories that are too short are left out.

    One window gives the pairs, Arrow batches are multiplied as matrices, and a
    partition sends one row of features squared numbers.
    """
    if lag < 1:
        raise ValueError("a lag is at least one frame")
    x = F.col(t.features)
    pairs = t.df.select(
        x.alias("x"), F.lead(x, lag).over(t.window).alias("y"), (F.row_number().over(t.window) == 1).alias("first")
    )

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Moments | None = None
        for part in parts:
            if not len(part):
                continue
            both = part[part["y"].notna()]
            w = len(part["x"].iloc[0])
            a = np.stack(both["x"].to_numpy()).astype(float) if len(both) else np.zeros((0, w))
            b = np.stack(both["y"].to_numpy()).astype(float) if len(both) else np.zeros((0, w))
            # a trajectory is long enough if its first frame has a partner
            m = Moments(len(both), len(part), float(both["first"].sum()), a.sum(0), b.sum(0), a.T @ b, a.T @ a, b.T @ b)
            total = m if total is None else total + m
        if total is not None:
            flat = np.concatenate([[total.n, total.frames, total.sequences], total.x, total.y, total.xy.ravel(), total.xx.ravel(), total.yy.ravel()])
            yield pd.DataFrame({"w": [len(total.x)], "m": [flat.tolist()]})

    rows = pairs.mapInPandas(partial, "w int, m array<double>")
    total = rows.select("w", F.posexplode("m").alias("i", "v")).groupBy("w", "i").agg(F.sum("v").alias("v")).collect()
    if not total:
        raise ValueError("there are no frames")
    w = total[0]["w"]
    flat = np.zeros(3 + 2 * w + 3 * w * w)
    for r in total:
        flat[r["i"]] = r["v"]
    if flat[0] == 0:
        raise ValueError("no trajectory is longer than the lag")
    cut = np.split(flat[3:], np.cumsum([w, w, w * w, w * w]))
    return Moments(*flat[:3], cut[0], cut[1], *(c.reshape(w, w) for c in cut[2:]))


def moment_table(t: Trajectories, lag: int) -> DataFrame:
    """``i``, ``j``, ``xy``, ``xx``, ``yy``: sums of products of feature i and j over pairs of frames, as one SQL plan."""
    x = F.col(t.features)
    pairs = t.df.select(x.alias("x"), F.lead(x, lag).over(t.window).alias("y")).where(F.col("y").isNotNull())
    left = pairs.select("x", "y", F.posexplode("x").alias("i", "xi"))
    both = left.select("i", "xi", F.get("y", F.col("i")).alias("yi"), "y", F.posexplode("x").alias("j", "xj"))
    both = both.withColumn("yj", F.get("y", F.col("j")))
    total = lambda a, b: F.sum(F.col(a).cast("double") * F.col(b))
    return both.groupBy("i", "j").agg(total("xi", "yj").alias("xy"), total("xi", "xj").alias("xx"), total("yi", "yj").alias("yy"))


class Projection:
    """Base: (x - ``means_``) times the rows of ``components_``, times ``scale_``."""

    features = "features"
    means_: np.ndarray
    components_: np.ndarray

    @property
    def scale_(self) -> np.ndarray:
        return np.ones(len(self.components_))

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        matrix, mean = (self.components_ * self.scale_[:, None]).T, self.means_

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            return pd.Series(list((np.stack(rows.to_numpy()).astype(float) - mean) @ matrix))

        return df.withColumn(out or self.features, project(self.features))


def rao_blackwell_shrinkage(s: np.ndarray, n: float) -> float:
    """Shrinkage of a covariance towards its mean variance, after the Rao-Blackwell estimate of Ledoit and Wolf's."""
    p = len(s)
    trace2, square = np.trace(s) ** 2, (s * s).sum()
    if square * p <= trace2:
        return 1.0
    gamma = ((n - 2) / n * square + trace2) / ((n + 2) * (square - trace2 / p))
    return float(min(max(gamma, 0.0), 1.0))


class tICA(Projection):
    """Slowest linear combinations of features: the generalised eigenproblem of lagged and instantaneous covariance."""

    def __init__(self, n_components: int | None = None, lag_time: int = 1, shrinkage: float | None = None, kinetic_mapping: bool = False, commute_mapping: bool = False, features: str = "features"):
        if kinetic_mapping and commute_mapping:
            raise ValueError("kinetic and commute mapping exclude each other")
        self.n_components, self.lag_time, self.shrinkage = n_components, lag_time, shrinkage
        self.kinetic_mapping, self.commute_mapping, self.features = kinetic_mapping, commute_mapping, features
        self.moments_: Moments | None = None

    def fit(self, t: Trajectories):
        self.moments_ = None
        return self.partial_fit(t)

    def partial_fit(self, t: Trajectories):
        """Add more trajectories to the moments."""
        m = lagged_moments(t, self.lag_time)
        self.moments_ = m if self.moments_ is None else self.moments_ + m
        self._solved = None
        return self

    @property
    def means_(self) -> np.ndarray:
        m = self.moments_
        return (m.x + m.y) / (2 * m.n)

    @property
    def offset_correlation_(self) -> np.ndarray:
        m = self.moments_
        return (m.xy + m.xy.T) / (2 * m.n) - np.outer(self.means_, self.means_)

    @property
    def raw_covariance_(self) -> np.ndarray:
        m = self.moments_
        return (m.xx + m.yy) / (2 * m.n) - np.outer(self.means_, self.means_)

    @property
    def covariance_(self) -> np.ndarray:
        s = self.raw_covariance_
        self.shrinkage_ = rao_blackwell_shrinkage(s, self.moments_.frames) if self.shrinkage is None else self.shrinkage
        return (1 - self.shrinkage_) * s + self.shrinkage_ * np.trace(s) / len(s) * np.eye(len(s))

    def _vectors(self) -> tuple[np.ndarray, np.ndarray]:
        return generalized_eigh(self.offset_correlation_, self.covariance_)

    def _solve(self) -> tuple[np.ndarray, np.ndarray]:
        if self._solved is None:
            self._solved = self._vectors()
        w, v = self._solved
        k = self.n_components or len(w)
        return w[:k], v[:, :k]

    @property
    def eigenvalues_(self) -> np.ndarray:
        return self._solve()[0]

    @property
    def eigenvectors_(self) -> np.ndarray:
        return self._solve()[1]

    @property
    def components_(self) -> np.ndarray:
        return self._solve()[1].T

    @property
    def timescales_(self) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return -self.lag_time / np.log(self.eigenvalues_)

    @property
    def scale_(self) -> np.ndarray:
        if self.kinetic_mapping:
            return self.eigenvalues_
        if self.commute_mapping:
            t = np.nan_to_num(self.timescales_)
            return np.sqrt(np.clip(t, 0, None) / 2)
        return np.ones(len(self.eigenvalues_))

    @property
    def score_(self) -> float:
        return float(self.eigenvalues_.sum())

    def score(self, t: Trajectories) -> float:
        """Generalised matrix Rayleigh quotient on other trajectories."""
        other = tICA(lag_time=self.lag_time, shrinkage=self.shrinkage).fit(t)
        v = self.eigenvectors_
        return float(np.trace(v.T @ other.offset_correlation_ @ v @ np.linalg.inv(v.T @ other.covariance_ @ v)))

    def summarize(self) -> str:
        return f"tICA: lag {self.lag_time}, shrinkage {getattr(self, 'shrinkage_', None)}\ntimescales {self.timescales_[:5]}\neigenvalues {self.eigenvalues_[:5]}"


class SparseTICA(tICA):
    """tICA with few features a component: a log penalty by majorisation, each weighted-L1 problem by alternating directions."""

    def __init__(self, n_components: int | None = None, lag_time: int = 1, rho: float = 0.01, epsilon: float = 1e-6, tolerance: float = 1e-6, maxiter: int = 200, **kw):
        super().__init__(n_components, lag_time, **kw)
        self.rho, self.epsilon, self.tolerance, self.maxiter = rho, epsilon, tolerance, maxiter

    def _vectors(self):
        a, b = self.offset_correlation_, self.covariance_
        if self.rho <= 0:
            return generalized_eigh(a, b)
        values, vectors = [], []
        for _ in range(self.n_components or len(a)):
            v = sparse_generalized_vector(a, b, self.rho, self.epsilon, self.tolerance, self.maxiter)
            w = float(v @ a @ v / (v @ b @ v))
            values.append(w)
            vectors.append(v)
            a = schur_deflation(a, v)
        order = np.argsort(values)[::-1]
        return np.array(values)[order], np.array(vectors)[order].T


def sparse_generalized_vector(a: np.ndarray, b: np.ndarray, rho: float, eps: float, tol: float, rounds: int) -> np.ndarray:
    """A vector of large ``v a v`` with ``v b v <= 1`` and few entries."""
    w, vectors = generalized_eigh(a, b)
    v = vectors[:, 0]
    shift = max(0.0, -np.linalg.eigvalsh(a)[0])  # a convex part to linearise
    a = a + shift * np.eye(len(a))
    scale = np.log1p(1 / eps)
    for _ in range(rounds):
        weights = rho / scale / (np.abs(v) + eps)
        new = weighted_l1_step(a @ v, b, weights)
        if not new.any():
            break
        if np.abs(new - v).max() < tol:
            v = new
            break
        v = new
    return refit(a - shift * np.eye(len(a)), b, v)


def weighted_l1_step(g: np.ndarray, b: np.ndarray, weights: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Largest ``g v - sum(weights abs(v) / 2)`` with ``v b v <= 1``: a split into soft thresholds and projections."""
    x = project_ellipsoid(g, b)
    z, u = x.copy(), np.zeros_like(x)
    for _ in range(rounds):
        x = project_ellipsoid(z - u + g, b)
        last, z = z, soft_threshold(x + u, weights / 2)
        u = u + x - z
        if max(np.abs(x - z).max(), np.abs(z - last).max()) < 1e-8:
            break
    return z


def soft_threshold(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - k, 0)


def project_ellipsoid(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The nearest point with ``v b v <= 1``: a root in one multiplier."""
    if x @ b @ x <= 1:
        return x
    w, q = np.linalg.eigh(b)
    y = q.T @ x
    low, high = 0.0, 1.0
    f = lambda m: (w * (y / (1 + m * w)) ** 2).sum() - 1
    while f(high) > 0:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return q @ (y / (1 + high * w))


def refit(a: np.ndarray, b: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The best vector on the entries that a sparse vector uses."""
    on = np.abs(v) > 1e-7 * max(np.abs(v).max(), 1e-300)
    if not on.any():
        on[np.argmax(np.diag(a) / np.diag(b))] = True
    out = np.zeros(len(v))
    out[on] = generalized_eigh(a[np.ix_(on, on)], b[np.ix_(on, on)])[1][:, 0]
    return out


def schur_deflation(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``a`` without what a vector explains."""
    w = a @ v
    d = v @ w
    return a - np.outer(w, w) / d if abs(d) > 1e-12 else a


class KSparseTICA(tICA):
    """tICA with exactly ``k`` features a component, by truncated power iteration from a seeded start."""

    def __init__(self, n_components: int | None = None, lag_time: int = 1, k: int = 5, max_iter: int = 300, kinetic_mapping: bool = True, seed: int = 0, **kw):
        super().__init__(n_components, lag_time, kinetic_mapping=kinetic_mapping, **kw)
        self.k, self.max_iter, self.seed = k, max_iter, seed

    def _vectors(self):
        a, b = self.offset_correlation_, self.covariance_
        rng = np.random.default_rng(self.seed)
        values, vectors = [], []
        for _ in range(self.n_components or len(a)):
            step = np.linalg.solve(b, a)
            step = step + max(0.0, -np.linalg.eigvals(step).real.min()) * np.eye(len(a))
            v = rng.normal(size=len(a))
            for _ in range(self.max_iter):
                new = step @ v
                new[np.argsort(-np.abs(new))[self.k :]] = 0
                new /= np.linalg.norm(new)
                if np.abs(new - v).max() < 1e-10:
                    break
                v = new
            v = refit(a, b, v)
            values.append(float(v @ a @ v / (v @ b @ v)))
            vectors.append(v)
            a = schur_deflation(a, v)
        order = np.argsort(values)[::-1]
        return np.array(values)[order], np.array(vectors)[order].T


class LandmarkNystroem:
    """Kernel features by landmarks: kernel values to them times the inverse root of their own kernel, singular values at least 1e-12."""

    def __init__(self, landmarks: np.ndarray, kernel: str = "rbf", gamma: float | None = None, degree: int = 3, coef0: float = 1.0, features: str = "features"):
        self.landmarks, self.kernel, self.degree, self.coef0, self.features = np.asarray(landmarks, float), kernel, degree, coef0, features
        self.gamma = 1.0 / self.landmarks.shape[1] if gamma is None else gamma
        u, s, vt = np.linalg.svd(self._kernel(self.landmarks))
        self.normalization_ = (u / np.sqrt(np.maximum(s, 1e-12))) @ vt

    def _kernel(self, x: np.ndarray) -> np.ndarray:
        y = self.landmarks
        if self.kernel == "linear":
            return x @ y.T
        if self.kernel == "rbf":
            return np.exp(-self.gamma * np.clip((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0, None))
        if self.kernel in ("poly", "polynomial"):
            return (self.gamma * x @ y.T + self.coef0) ** self.degree
        if self.kernel == "sigmoid":
            return np.tanh(self.gamma * x @ y.T + self.coef0)
        if self.kernel == "cosine":
            return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
        raise ValueError(f"unknown kernel {self.kernel!r}")

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        kernel, norm = self._kernel, self.normalization_

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def features(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            return pd.Series(list(kernel(np.stack(rows.to_numpy()).astype(float)) @ norm.T))

        return df.withColumn(out or self.features, features(self.features))


def nystroem(df: DataFrame, n_components: int = 100, seed: int = 0, features: str = "features", **kw) -> LandmarkNystroem:
    """Landmarks drawn by the hash of the row."""
    rows = df.select(features).orderBy(F.xxhash64(features, F.lit(seed))).limit(n_components).collect()
    return LandmarkNystroem(np.array([r[0] for r in rows], float), features=features, **kw)


class KernelTICA(tICA):
    """tICA in the kernel features of landmarks; without landmarks every ``stride``-th frame that has a lagged partner is one, and the partner.

    At most ``max_landmarks`` different frames are drawn by hash, or with None all are taken; their number squared is held on the driver.
    """

    def __init__(self, n_components: int | None = None, lag_time: int = 1, kernel: str = "rbf", gamma: float | None = None, degree: int = 3, coef0: float = 1.0, stride: int = 1, landmarks: np.ndarray | None = None, max_landmarks: int | None = 500, **kw):
        super().__init__(n_components, lag_time, **kw)
        self.kernel_args = {"kernel": kernel, "gamma": gamma, "degree": degree, "coef0": coef0}
        self.stride, self.landmarks, self.max_landmarks = stride, landmarks, max_landmarks

    def fit(self, t: Trajectories):
        marks = self.landmarks
        if marks is None:
            marks = self._landmarks(t)
        self.landmarks_ = marks
        self.nystroem_ = LandmarkNystroem(marks, features=t.features, **self.kernel_args)
        return super().fit(t.replace(self.nystroem_.transform(t.df)))

    def _landmarks(self, t: Trajectories) -> np.ndarray:
        last = F.count(F.lit(1)).over(W.partitionBy("traj_id")) - 1
        rows = t.frames().withColumn("last", last)
        # the k-th strided frame goes with frame lag_time + k * stride
        begins = (F.col("frame") % self.stride == 0) & (F.col("frame") + self.lag_time <= F.col("last"))
        ends = (F.col("frame") >= self.lag_time) & ((F.col("frame") - self.lag_time) % self.stride == 0)
        rows = rows.where(begins | ends)
        if self.max_landmarks is None:
            rows = rows.orderBy("traj_id", "frame")
        else:
            rows = rows.orderBy(F.xxhash64("traj_id", "frame"), "traj_id", "frame").limit(self.max_landmarks)
        return np.array([r["features"] for r in rows.select("features").collect()], float)

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        return super().transform(self.nystroem_.transform(df, out), out)


def covariance(df: DataFrame, features: str = "features") -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, mean and population covariance, from one scan with a matrix product a batch."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, None, None
        for part in parts:
            if len(part):
                x = np.stack(part["x"].to_numpy()).astype(float)
                n, s, ss = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if ss is None else ss)
        if n:
            yield pd.DataFrame({"m": [np.concatenate([[n], s, ss.ravel()]).tolist()]})

    rows = df.where(F.col(features).isNotNull()).select(F.col(features).alias("x")).mapInPandas(partial, "m array<double>")
    total = rows.select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    if not total:
        raise ValueError("there are no rows")
    flat = np.array([r["v"] for r in sorted(total, key=lambda r: r["i"])])
    w = int((-1 + np.sqrt(1 + 4 * (len(flat) - 1))) / 2)
    n, mean = flat[0], flat[1 : w + 1] / flat[0]
    return n, mean, flat[w + 1 :].reshape(w, w) / n - np.outer(mean, mean)


class PCA(Projection):
    """Principal components, centred, by falling variance; the largest entry of each is positive."""

    def __init__(self, n_components: int | None = None, whiten: bool = False, features: str = "features"):
        self.n_components, self.whiten, self.features = n_components, whiten, features

    def fit(self, df: DataFrame) -> PCA:
        n, self.means_, c = covariance(df, self.features)
        w, v = np.linalg.eigh(c * n / max(n - 1, 1))
        k = self.n_components or len(w)
        self.explained_variance_ = np.clip(w[::-1][:k], 0, None)
        self.explained_variance_ratio_ = self.explained_variance_ / max(w.sum(), 1e-300)
        v = v[:, ::-1][:, :k]
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
        self.components_ = v.T
        return self

    @property
    def scale_(self) -> np.ndarray:
        return 1 / np.sqrt(np.maximum(self.explained_variance_, 1e-300)) if self.whiten else np.ones(len(self.components_))


class SparsePCA(Projection):
    """Principal components with few features: soft-thresholded power iterations on the covariance, deflated."""

    def __init__(self, n_components: int = 2, alpha: float = 0.1, max_iter: int = 500, features: str = "features"):
        self.n_components, self.alpha, self.max_iter, self.features = n_components, alpha, max_iter, features

    def fit(self, df: DataFrame) -> SparsePCA:
        _, self.means_, c = covariance(df, self.features)
        found = []
        for _ in range(self.n_components):
            v = np.linalg.eigh(c)[1][:, -1]
            for _ in range(self.max_iter):
                g = c @ v
                new = soft_threshold(g, self.alpha * np.abs(g).max())
                new /= max(np.linalg.norm(new), 1e-300)
                if np.abs(new - v).max() < 1e-10:
                    break
                v = new
            found.append(v)
            c = schur_deflation(c, v)
        self.components_ = np.array(found)
        return self


class MiniBatchSparsePCA(SparsePCA):
    """As above: the covariance comes from batches in any case."""


class KernelPCA(Projection):
    """Principal components of kernel features of landmarks."""

    def __init__(self, n_components: int = 2, n_landmarks: int = 200, seed: int = 0, features: str = "features", **kernel):
        self.n_components, self.n_landmarks, self.seed, self.features, self.kernel = n_components, n_landmarks, seed, features, kernel

    def fit(self, df: DataFrame) -> KernelPCA:
        self.nystroem_ = nystroem(df, self.n_landmarks, self.seed, self.features, **self.kernel)
        inner = PCA(self.n_components, features=self.features).fit(self.nystroem_.transform(df))
        self.means_, self.components_, self.explained_variance_ = inner.means_, inner.components_, inner.explained_variance_
        return self

    def transform(self, df: DataFrame, out: str | None = None) -> DataFrame:
        return super().transform(self.nystroem_.transform(df, out), out)


class FactorAnalysis(Projection):
    """Factors with a noise variance for each feature, by expectation maximisation on the covariance; rows project to expected factors."""

    def __init__(self, n_components: int = 2, max_iter: int = 1000, tol: float = 1e-8, features: str = "features"):
        self.n_components, self.max_iter, self.tol, self.features = n_components, max_iter, tol, features

    def fit(self, df: DataFrame) -> FactorAnalysis:
        _, self.means_, s = covariance(df, self.features)
        w, v = np.linalg.eigh(s)
        k = self.n_components
        load = v[:, -k:] * np.sqrt(np.maximum(w[-k:], 1e-12))
        noise = np.maximum(np.diag(s - load @ load.T), 1e-6)
        last = -np.inf
        for _ in range(self.max_iter):
            beta = np.linalg.solve(load @ load.T + np.diag(noise), load).T
            second = np.eye(k) - beta @ load + beta @ s @ beta.T
            load = s @ beta.T @ np.linalg.inv(second)
            noise = np.maximum(np.diag(s - load @ beta @ s), 1e-12)
            c = load @ load.T + np.diag(noise)
            now = -np.linalg.slogdet(c)[1] - np.trace(np.linalg.solve(c, s))
            if abs(now - last) < self.tol:
                break
            last = now
        self.loadings_, self.noise_variance_ = load.T, noise
        self.components_ = np.linalg.solve(load @ load.T + np.diag(noise), load).T
        return self


class FastICA(Projection):
    """Independent components: whitening by the covariance, then fixed-point rounds, each a scan that sums g(wx)x."""

    def __init__(self, n_components: int | None = None, max_iter: int = 50, tol: float = 1e-4, seed: int = 0, features: str = "features"):
        self.n_components, self.max_iter, self.tol, self.seed, self.features = n_components, max_iter, tol, seed, features

    def fit(self, df: DataFrame) -> FastICA:
        n, self.means_, c = covariance(df, self.features)
        w, v = np.linalg.eigh(c)
        k = self.n_components or len(w)
        white = (v[:, ::-1][:, :k] / np.sqrt(np.maximum(w[::-1][:k], 1e-12))).T
        mean = self.means_
        turn = self._orthogonal(np.random.default_rng(self.seed).normal(size=(k, k)))
        rows = df.where(F.col(self.features).isNotNull()).select(F.col(self.features).alias("x")).persist()
        for _ in range(self.max_iter):
            now = turn

            def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                a, b = np.zeros((k, k)), np.zeros(k)
                for part in parts:
                    if len(part):
                        z = (np.stack(part["x"].to_numpy()).astype(float) - mean) @ white.T
                        g = np.tanh(z @ now.T)
                        a += g.T @ z
                        b += (1 - g * g).sum(0)
                yield pd.DataFrame({"m": [np.concatenate([a.ravel(), b]).tolist()]})

            parts = rows.mapInPandas(partial, "m array<double>").select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
            flat = np.array([r["v"] for r in sorted(parts, key=lambda r: r["i"])]) / n
            turn = self._orthogonal(flat[: k * k].reshape(k, k) - flat[k * k :, None] * now)
            if np.abs(np.abs((turn * now).sum(axis=1)) - 1).max() < self.tol:
                break
        rows.unpersist()
        self.components_ = turn @ white
        return self

    @staticmethod
    def _orthogonal(m: np.ndarray) -> np.ndarray:
        u, _, vt = np.linalg.svd(m)
        return u @ vt
