"""Hidden Markov models with Gaussian or von Mises emissions.

The E-step runs on the trajectories of a partition, many at once, and returns sums
only: the M-step on the driver sees states times features numbers. A trajectory
must fit a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrail.functions.linalg import eigensystem, minimize_bfgs, reversible_mle, stationary
from kinetrail.operators.cluster import KMeans
from kinetrail.plans.trajectories import Trajectories

#: Transition probabilities count as at least this much in logarithms.
FLOOR = 1e-20


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def forward_backward(log_b: np.ndarray, log_t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, state probabilities of each frame and expected transitions; all states begin alike.

    Scaled recursions: each frame's emission is taken relative to its best state.
    """
    n, k = log_b.shape
    top = log_b.max(axis=1, keepdims=True)
    b, t = np.exp(log_b - top), np.exp(log_t)
    alpha, scale = np.empty((n, k)), np.empty(n)
    a = b[0] / k
    for i in range(n):
        if i:
            a = (alpha[i - 1] @ t) * b[i]
        scale[i] = a.sum()
        alpha[i] = a / scale[i]
    beta = np.ones((n, k))
    for i in range(n - 2, -1, -1):
        beta[i] = t @ (b[i + 1] * beta[i + 1]) / scale[i + 1]
    post = alpha * beta
    post /= post.sum(axis=1, keepdims=True)
    pairs = t * (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None])) if n > 1 else np.zeros((k, k))
    return float(np.log(scale).sum() + top.sum()), post, pairs


def forward_backward_many(parts: list[np.ndarray], log_t: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray]:
    """The same for many trajectories at once: total log-likelihood, state probabilities of each, summed transitions.

    Trajectories are ordered by falling length, so at each step those that are still
    running are the first ones, and one matrix product serves them all.
    """
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    sizes = np.array([len(parts[i]) for i in order])
    m, n, k = len(parts), int(sizes[0]), log_t.shape[0]
    b, top = np.zeros((n, m, k)), 0.0
    for j, i in enumerate(order):
        high = parts[i].max(axis=1, keepdims=True)
        b[: sizes[j], j] = np.exp(parts[i] - high)
        top += float(high.sum())
    running = (sizes[None, :] > np.arange(n)[:, None]).sum(axis=1)
    t = np.exp(log_t)
    alpha, scale = np.zeros((n, m, k)), np.ones((n, m))
    for i in range(n):
        r = running[i]
        a = b[i, :r] / k if i == 0 else (alpha[i - 1, :r] @ t) * b[i, :r]
        scale[i, :r] = a.sum(axis=1)
        alpha[i, :r] = a / scale[i, :r, None]
    beta, pairs = np.ones((n, m, k)), np.zeros((k, k))
    for i in range(n - 2, -1, -1):
        r = running[i + 1]
        ahead = b[i + 1, :r] * beta[i + 1, :r] / scale[i + 1, :r, None]
        beta[i, :r] = ahead @ t.T
        pairs += alpha[i, :r].T @ ahead
    post = alpha * beta
    post /= np.maximum(post.sum(axis=2, keepdims=True), 1e-300)
    out: list = [None] * m
    for j, i in enumerate(order):
        out[i] = post[: sizes[j], j]
    return float(np.log(scale).sum()) + top, out, t * pairs


def whole_trajectories(parts: Iterator[pd.DataFrame], frames: int = 50_000) -> Iterator[list[np.ndarray]]:
    """Feature matrices of whole trajectories from sorted batches, about so many frames at a time."""
    done: list[np.ndarray] = []
    held: list[np.ndarray] = []
    key, size = None, 0
    for part in parts:
        if not len(part):
            continue
        x = np.stack(part["features"].to_numpy()).astype(float)
        ids = part["traj_id"].to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if held and ids[a] != key:
                done.append(np.concatenate(held))
                size += len(done[-1])
                held = []
                if size >= frames:
                    yield done
                    done, size = [], 0
            key = ids[a]
            held.append(x[a:b])
    if held:
        done.append(np.concatenate(held))
    if done:
        yield done


def viterbi(log_b: np.ndarray, log_t: np.ndarray) -> tuple[float, np.ndarray]:
    """The most likely path and its log-probability; of equals the lowest state."""
    n, k = log_b.shape
    back = np.zeros((n, k), int)
    v = log_b[0] - np.log(k)
    for i in range(1, n):
        step = v[:, None] + log_t
        back[i] = step.argmax(axis=0)
        v = step[back[i], np.arange(k)] + log_b[i]
    path = np.empty(n, int)
    path[-1] = int(v.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return float(v.max()), path


class _HMM:
    n_states: int
    features = "features"

    # emissions, given by the subclasses
    def _log_b(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def _sums(self, x: np.ndarray, post: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def _maximise(self, sums: np.ndarray, w: int) -> None:
        raise NotImplementedError

    def _start(self, t: Trajectories, seed: int) -> None:
        raise NotImplementedError

    def _emission(self):
        """What a worker needs, without the driver's objects."""
        clone = type(self).__new__(type(self))
        clone.__dict__.update({k: v for k, v in self.__dict__.items() if not k.startswith("_")})
        return clone

    def _e_step(self, frames: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
        model, log_t, k = self._emission(), np.log(np.maximum(self.transmat_, FLOOR)), self.n_states

        def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for xs in whole_trajectories(parts):
                ll, posts, pairs = forward_backward_many([model._log_b(x) for x in xs], log_t)
                flat = np.concatenate([[ll], pairs.ravel(), model._sums(np.concatenate(xs), np.concatenate(posts)).ravel()])
                total = flat if total is None else total + flat
            if total is not None:
                yield pd.DataFrame({"s": [total.tolist()]})

        # whole trajectories follow one another in a partition, which sends one row
        parts = frames.mapInPandas(sums, "s array<double>")
        rows = parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])
        return float(flat[0]), flat[1 : 1 + k * k].reshape(k, k), flat[1 + k * k :]

    def fit(self, t: Trajectories):
        """The best of ``n_init`` runs by final log-likelihood."""
        frames = self._sorted(t).persist()
        kept = None
        self._width = len(frames.select("features").first()[0])
        for run in range(self.n_init):
            self._start(t, self.seed + run)
            self.transmat_ = np.full((self.n_states, self.n_states), 1.0 / self.n_states)
            trace: list[float] = []
            for _ in range(self.n_iter):
                ll, pairs, sums = self._e_step(frames)
                trace.append(ll)
                self._maximise(sums, self._width)
                self._set_transitions(pairs)
                if len(trace) > 1 and abs(trace[-1] - trace[-2]) < self.thresh:
                    break
            if kept is None or trace[-1] > kept[0]:
                kept = trace[-1], dict(self.__dict__), trace
        frames.unpersist()
        self.__dict__.update(kept[1])
        self.fit_logprob_ = kept[2]
        self.populations_ = stationary(self.transmat_)
        return self

    def _set_transitions(self, pairs: np.ndarray) -> None:
        pairs = pairs + 1e-20
        if self.reversible_type == "mle":
            self.transmat_ = reversible_mle(np.maximum(pairs, 1e-15), 1e-8)[0]
        elif self.reversible_type == "transpose":
            both = pairs + pairs.T
            self.transmat_ = both / both.sum(axis=1, keepdims=True)
        else:
            raise ValueError(f"unknown reversible_type {self.reversible_type!r}")

    def score(self, t: Trajectories) -> float:
        return self._e_step(self._sorted(t))[0]

    @staticmethod
    def _sorted(t: Trajectories) -> DataFrame:
        return t.frames().select("traj_id", "frame", "features").repartition("traj_id").sortWithinPartitions("traj_id", "frame")

    def predict(self, t: Trajectories) -> DataFrame:
        """``traj_id``, ``frame``, ``state`` on the most likely path, and ``logprob`` of the trajectory's path."""
        model, log_t = self._emission(), np.log(np.maximum(self.transmat_, FLOOR))
        frames = t.frames().select("traj_id", "frame", "features")

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("frame")
            p, path = viterbi(model._log_b(np.stack(pdf["features"].to_numpy()).astype(float)), log_t)
            return pd.DataFrame({"traj_id": pdf["traj_id"], "frame": pdf["frame"], "state": path, "logprob": p})

        schema = T.StructType([frames.schema["traj_id"], frames.schema["frame"], T.StructField("state", T.IntegerType()), T.StructField("logprob", T.DoubleType())])
        return frames.groupBy("traj_id").applyInPandas(one, schema)

    def fit_predict(self, t: Trajectories) -> DataFrame:
        return self.fit(t).predict(t)

    @property
    def timescales_(self) -> np.ndarray:
        u = np.real(eigensystem(self.transmat_, None, self.n_states, True)[0])[1:]
        u = u[(u > 0) & (u < 1)]
        return -1 / np.log(u)

    def _densities(self, t: Trajectories) -> DataFrame:
        model = self._emission()

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def density(rows: pd.Series) -> pd.Series:
            return pd.Series(list(model._log_b(np.stack(rows.to_numpy()).astype(float)))) if len(rows) else pd.Series([], dtype=object)

        return t.frames().withColumn("__d", density("features"))

    def draw_centroids(self, t: Trajectories) -> DataFrame:
        """``state``, ``traj_id``, ``frame`` of the frame of greatest density for each state."""
        rows = self._densities(t).select("traj_id", "frame", F.posexplode("__d").alias("state", "d"))
        return rows.groupBy("state").agg(F.max_by(F.struct("traj_id", "frame"), F.struct("d", -F.col("frame"))).alias("b")).select("state", "b.traj_id", "b.frame")

    def draw_samples(self, t: Trajectories, n_samples: int, scheme: str = "even", match_vars: bool = True, seed: int = 0, pool: int = 5000) -> DataFrame:
        """``state``, ``draw``, ``traj_id``, ``frame``: random frames of each state.

        ``even`` draws from the frames on the most likely path; ``maxent`` reweights at most ``pool``
        frames a state so that mean, and with ``match_vars`` variance, are those of the state.
        """
        path = self.predict(t).select("traj_id", "frame", "state")
        frames = path.join(t.frames().select("traj_id", "frame", "features"), ["traj_id", "frame"])
        from pyspark.sql import Window as W

        ranked = frames.withColumn("r", F.row_number().over(W.partitionBy("state").orderBy(F.xxhash64("traj_id", "frame", F.lit(seed)), "traj_id", "frame")))
        most = n_samples if scheme == "even" else pool
        rows = ranked.where(F.col("r") <= most).collect()
        rng, out = np.random.default_rng(seed), []
        for s in range(self.n_states):
            mine = sorted((r for r in rows if r["state"] == s), key=lambda r: r["r"])
            if not mine:
                continue
            if scheme == "even":
                at = rng.integers(len(mine), size=n_samples)
            elif scheme == "maxent":
                x = np.array([r["features"] for r in mine], float)
                p = maxent_weights(x, self.means_[s], self.vars_[s] if match_vars else None)
                at = rng.choice(len(mine), size=n_samples, p=p)
            else:
                raise ValueError(f"unknown scheme {scheme!r}")
            out += [(s, k, mine[i]["traj_id"], mine[i]["frame"]) for k, i in enumerate(at)]
        schema = T.StructType([T.StructField("state", T.IntegerType()), T.StructField("draw", T.IntegerType()), frames.schema["traj_id"], frames.schema["frame"]])
        return t.df.sparkSession.createDataFrame(out, schema)


class NotSatisfiableError(ValueError):
    """No weights of the given frames have the wanted moments."""


def maxent_weights(x: np.ndarray, mean: np.ndarray, var: np.ndarray | None) -> np.ndarray:
    """Weights of largest entropy under which the frames have a mean and a variance: an exponential family, by its dual."""
    f = x if var is None else np.hstack([x, (x - mean) ** 2])
    goal = mean if var is None else np.concatenate([mean, var])
    scale = np.maximum(f.std(axis=0), 1e-12)
    g = (f - goal) / scale

    def dual(lam):
        e = g @ lam
        top = e.max()
        p = np.exp(e - top)
        z = p.sum()
        return top + np.log(z), g.T @ (p / z)

    lam, _, _ = minimize_bfgs(dual, np.zeros(g.shape[1]), max_iter=500, tol=1e-7)
    e = g @ lam
    p = np.exp(e - e.max())
    p /= p.sum()
    if np.abs(g.T @ p).max() > 0.05:
        raise NotSatisfiableError("the frames cannot have these moments")
    return p


class GaussianHMM(_HMM):
    """Diagonal Gaussian emissions. ``fusion_prior`` pulls the means of different states together feature by feature."""

    def __init__(self, n_states: int, n_init: int = 10, n_iter: int = 10, n_lqa_iter: int = 10, fusion_prior: float = 1e-2, thresh: float = 1e-2,
                 reversible_type: str = "mle", vars_prior: float = 1e-3, vars_weight: float = 1.0, seed: int = 0, n_hotstart: int = 100_000):
        self.n_states, self.n_init, self.n_iter, self.n_lqa_iter, self.fusion_prior, self.thresh = n_states, n_init, n_iter, n_lqa_iter, fusion_prior, thresh
        self.reversible_type, self.vars_prior, self.vars_weight, self.seed, self.n_hotstart = reversible_type, vars_prior, vars_weight, seed, n_hotstart

    def _log_b(self, x):
        d = (x[:, None, :] - self.means_[None]) ** 2 / self.vars_[None]
        return -0.5 * (d + np.log(2 * np.pi * self.vars_)[None]).sum(axis=2)

    def _sums(self, x, post):
        return np.concatenate([post.sum(0), (post.T @ x).ravel(), (post.T @ (x * x)).ravel()])

    def _start(self, t, seed):
        rows = t.df.select(F.col(t.features).alias("features")).where(F.col("features").isNotNull())
        rows = rows.orderBy(F.xxhash64("features", F.lit(seed))).limit(self.n_hotstart)
        self.means_ = KMeans(self.n_states, seed=seed).fit(rows).cluster_centers_
        w = self._width
        v = rows.agg(*(F.var_pop(F.col("features")[i]).alias(f"v{i}") for i in range(w))).first()
        self.vars_ = np.tile(np.maximum([v[f"v{i}"] for i in range(w)], self.vars_prior), (self.n_states, 1))

    def _maximise(self, sums, w):
        k = self.n_states
        n, s1, s2 = sums[:k], sums[k : k + k * w].reshape(k, w), sums[k + k * w :].reshape(k, w)
        n = np.maximum(n, 1e-12)
        means = s1 / n[:, None]
        if self.fusion_prior > 0:
            means = self._fused(means, n)
        self.vars_ = (s2 - 2 * means * s1 + n[:, None] * means**2 + self.vars_prior) / (n[:, None] + max(self.vars_weight - 1, 0))
        self.vars_ = np.maximum(self.vars_, 1e-8)
        self.means_ = means

    def _fused(self, means: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Means under a penalty on their absolute differences: quadratic bounds of it, solved again and again."""
        out = means.copy()
        for f in range(means.shape[1]):
            x, a = out[:, f], n / self.vars_[:, f]
            free = np.maximum(np.abs(means[:, f][:, None] - means[:, f]), 1e-9)
            strength = self.fusion_prior / free  # adaptive: far means are left apart
            for _ in range(self.n_lqa_iter):
                pull = strength / np.maximum(np.abs(x[:, None] - x), 1e-6)
                np.fill_diagonal(pull, 0)
                m = np.diag(a + pull.sum(axis=1)) - pull
                x = np.linalg.solve(m, a * means[:, f])
            out[:, f] = x
        return out

    def summarize(self) -> str:
        return f"Gaussian HMM of {self.n_states} states, log-likelihood {self.fit_logprob_[-1]:.3f}\nmeans\n{self.means_}\nvariances\n{self.vars_}\ntransitions\n{self.transmat_}"


def bessel_ratio(k: np.ndarray) -> np.ndarray:
    """I1(k) / I0(k): the continued fraction from its tail upwards."""
    k = np.asarray(k, float)
    r = np.zeros_like(k)
    depth = 30 + int(2 * np.sqrt(np.max(k, initial=1.0)) + np.max(k, initial=0.0) * 0.75)
    for m in range(depth, 0, -1):
        r = 1.0 / (2.0 * m / np.maximum(k, 1e-300) + r)
    return r


def log_i0(k: np.ndarray) -> np.ndarray:
    """log I0(k), by the series of NumPy for small and the asymptotic series for large arguments."""
    k = np.asarray(k, float)
    small = np.log(np.i0(np.minimum(k, 500)))
    big = np.maximum(k, 1.0)
    large = big - 0.5 * np.log(2 * np.pi * big) + np.log1p(1 / (8 * big) + 9 / (128 * big**2) + 225 / (3072 * big**3))
    return np.where(k < 500, small, large)


def inverse_bessel_ratio(r: np.ndarray) -> np.ndarray:
    """The concentration whose ratio I1 / I0 is ``r``, between 1e-5 and 700: Newton from a rational guess."""
    r = np.clip(np.asarray(r, float), 0, 1 - 1e-9)
    k = np.clip(r * (2 - r**2) / (1 - r**2), 1e-5, 700)
    for _ in range(30):
        a = bessel_ratio(k)
        k = np.clip(k - (a - r) / np.maximum(1 - a / k - a * a, 1e-12), 1e-5, 700)
    return k


class VonMisesHMM(_HMM):
    """Circular emissions of angles."""

    def __init__(self, n_states: int, n_init: int = 10, n_iter: int = 10, thresh: float = 1e-2, reversible_type: str = "mle", seed: int = 0):
        self.n_states, self.n_init, self.n_iter, self.thresh, self.reversible_type, self.seed = n_states, n_init, n_iter, thresh, reversible_type, seed

    def _log_b(self, x):
        return (self.kappas_[None] * np.cos(x[:, None, :] - self.means_[None]) - np.log(2 * np.pi) - log_i0(self.kappas_)[None]).sum(axis=2)

    def _sums(self, x, post):
        return np.concatenate([post.sum(0), (post.T @ np.cos(x)).ravel(), (post.T @ np.sin(x)).ravel()])

    def _start(self, t, seed):
        x = F.col(t.features)
        circle = t.df.select(F.concat(F.transform(x, F.sin), F.transform(x, F.cos)).alias("features"))
        c = KMeans(self.n_states, seed=seed).fit(circle.orderBy(F.xxhash64("features", F.lit(seed))).limit(100_000)).cluster_centers_
        w = self._width
        self.means_ = np.arctan2(c[:, :w], c[:, w:])
        self.kappas_ = np.ones((self.n_states, w))

    def _maximise(self, sums, w):
        k = self.n_states
        n, c, s = np.maximum(sums[:k], 1e-12), sums[k : k + k * w].reshape(k, w), sums[k + k * w :].reshape(k, w)
        self.means_ = np.arctan2(s, c)
        self.kappas_ = inverse_bessel_ratio(np.sqrt(c**2 + s**2) / n[:, None])

    @property
    def overlap_(self) -> np.ndarray:
        """Logarithm of the integral of the product of two states' densities, over all features."""
        k, m = self.kappas_, self.means_
        joint = np.sqrt(k[:, None] ** 2 + k[None] ** 2 + 2 * k[:, None] * k[None] * np.cos(m[:, None] - m[None]))
        return (log_i0(joint) - np.log(2 * np.pi) - log_i0(k)[:, None] - log_i0(k)[None]).sum(axis=2)
