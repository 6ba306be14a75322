"""Markov state models: counts from Spark, then small dense algebra on the driver."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinetrail.functions.linalg import eigensystem, reversible_mle, stationary
from kinetrail.operators import counting
from kinetrail.operators.counting import CountMatrix
from kinetrail.plans.trajectories import Trajectories


class StateModel:
    """What all models over a trimmed alphabet share: the mapping and the transforms of trajectories."""

    labels_: list
    n_states_: int

    @property
    def mapping_(self) -> dict:
        return {s: i for i, s in enumerate(self.labels_)}

    @property
    def state_labels_(self) -> list:
        return list(self.labels_)

    def transform(self, t: Trajectories, mode: str = "clip") -> DataFrame:
        """Labels to indices: ``clip`` cuts at labels the model does not know, ``fill`` leaves NULL there."""
        if mode not in ("clip", "fill"):
            raise ValueError("mode is 'clip' or 'fill'")
        return (counting.clip_labels if mode == "clip" else counting.fill_labels)(t, self.mapping_)

    def inverse_transform(self, df: DataFrame, column: str = "idx", out: str = "label") -> DataFrame:
        return counting.inverse_labels(df, column, self.labels_, out)

    def draw_samples(self, t: Trajectories, n_samples: int, seed: int = 0) -> DataFrame:
        """For each state ``n_samples`` frames with replacement: ``idx``, ``draw``, ``traj_id``, ``frame``.

        A draw takes the frame of a random rank within the state; ranks are those of a
        random order, and only as many as were drawn leave the ranking.
        """
        frames = counting.fill_labels(t, self.mapping_).where(F.col("idx").isNotNull())
        sizes = {r["idx"]: r["n"] for r in frames.groupBy("idx").agg(F.count(F.lit(1)).alias("n")).collect()}
        rng = np.random.default_rng(seed)
        draws = [(int(i), k, int(rng.integers(n)) + 1) for i, n in sorted(sizes.items()) for k in range(n_samples)]
        wanted = t.df.sparkSession.createDataFrame(draws, "idx int, draw int, rank int")
        # a rank among all frames of a state, from sizes of hash buckets, so that no state is sorted in one task
        order = F.xxhash64("traj_id", "frame", F.lit(seed))
        bucketed = frames.withColumn("__h", order).withColumn("__b", F.pmod("__h", F.lit(1024)))
        within = F.row_number().over(W.partitionBy("idx", "__b").orderBy("__h", "traj_id", "frame"))
        base = bucketed.groupBy("idx", "__b").agg(F.count(F.lit(1)).alias("n"))
        upto = F.coalesce(F.sum("n").over(W.partitionBy("idx").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        base = base.select("idx", "__b", upto.alias("__base"))
        ranked = bucketed.withColumn("__r", within).join(base, ["idx", "__b"]).withColumn("rank", (F.col("__r") + F.col("__base")).cast("int"))
        return ranked.join(F.broadcast(wanted), ["idx", "rank"]).select("idx", "draw", "traj_id", "frame")


class MarkovStateModel(StateModel):
    """A transition matrix estimated from labelled trajectories.

    ``reversible_type`` is ``mle`` (maximum likelihood under detailed balance),
    ``transpose`` or ``none``. Eigenvectors are computed when first asked for.
    """

    def __init__(
        self,
        lag_time: int = 1,
        n_timescales: int | None = None,
        reversible_type: str | None = "mle",
        ergodic_cutoff: str | float = "on",
        prior_counts: float = 0.0,
        sliding_window: bool = True,
    ):
        if reversible_type not in ("mle", "transpose", "none", None):
            raise ValueError(f"unknown reversible_type {reversible_type!r}")
        self.lag_time, self.n_timescales, self.reversible_type = lag_time, n_timescales, reversible_type or "none"
        self.ergodic_cutoff, self.prior_counts, self.sliding_window = ergodic_cutoff, prior_counts, sliding_window

    def clone(self, **changes) -> MarkovStateModel:
        return MarkovStateModel(**(self.params | changes))

    @property
    def params(self) -> dict:
        names = ("lag_time", "n_timescales", "reversible_type", "ergodic_cutoff", "prior_counts", "sliding_window")
        return {n: getattr(self, n) for n in names}

    def fit(self, t: Trajectories) -> MarkovStateModel:
        return self.fit_counts(counting.count_matrix(t, self.lag_time, self.sliding_window))

    def fit_counts(self, counts: CountMatrix) -> MarkovStateModel:
        """From counts already divided by the lag; trims, then estimates."""
        cut = counting.ergodic_cutoff(self.ergodic_cutoff, self.lag_time, self.sliding_window)
        kept = counts.trimmed(cut)
        self.__dict__.pop("_eigen", None)
        self.countsmat_, self.labels_, self.percent_retained_ = kept.counts, kept.labels, kept.percent_retained
        self.n_states_ = len(self.labels_)
        c = self.countsmat_ + self.prior_counts
        if not self.n_states_:
            self.transmat_, self.populations_ = np.zeros((0, 0)), np.zeros(0)
        elif self.reversible_type == "mle":
            self.transmat_, self.populations_ = reversible_mle(c)
        elif self.reversible_type == "transpose":
            both = 0.5 * (self.countsmat_ + self.countsmat_.T) + self.prior_counts
            self.populations_ = both.sum(axis=0) / both.sum()
            self.transmat_ = both / both.sum(axis=1, keepdims=True)
        else:
            self.transmat_ = c / c.sum(axis=1, keepdims=True)
            self.populations_ = stationary(self.transmat_)
        return self

    # --- spectrum ---

    @property
    def n_modes(self) -> int:
        most = max(self.n_states_ - 1, 0)
        return most if self.n_timescales is None else min(self.n_timescales, most)

    @cached_property
    def _eigen(self):
        return eigensystem(self.transmat_, self.populations_, self.n_modes + 1, self.reversible_type != "none")

    @property
    def eigenvalues_(self) -> np.ndarray:
        return self._eigen[0]

    @property
    def left_eigenvectors_(self) -> np.ndarray:
        return self._eigen[1]

    @property
    def right_eigenvectors_(self) -> np.ndarray:
        return self._eigen[2]

    @property
    def timescales_(self) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return -self.lag_time / np.log(np.real(self.eigenvalues_[1:]))

    @property
    def score_(self) -> float:
        return float(np.real(self.eigenvalues_).sum())

    def score_counts(self, test: CountMatrix) -> float:
        """Generalised matrix Rayleigh quotient of this model's modes on test counts, over the states both have."""
        other = self.clone(ergodic_cutoff="off").fit_counts(test)
        shared = [s for s in self.labels_ if s in other.mapping_]
        mine, theirs = [self.mapping_[s] for s in shared], [other.mapping_[s] for s in shared]
        v = self.right_eigenvectors_[mine]
        pi = other.populations_[theirs]
        s = np.diag(pi)
        c = s @ other.transmat_[np.ix_(theirs, theirs)]
        return float(np.real(np.trace(v.T @ c @ v @ np.linalg.pinv(v.T @ s @ v))))

    def score(self, t: Trajectories) -> float:
        return self.score_counts(counting.count_matrix(t, self.lag_time, self.sliding_window, self.ergodic_cutoff))

    def score_ll(self, t: Trajectories) -> float:
        """Log-likelihood of trajectories at lag 1; minus infinity where a label or a step is impossible."""
        total = 0.0
        for r in counting.transition_counts(t, 1).collect():
            i, j = self.mapping_.get(r["src"]), self.mapping_.get(r["dst"])
            p = 0.0 if i is None or j is None else self.transmat_[i, j]
            total += r["n"] * np.log(p) if p > 0 else -np.inf
        return float(total)

    def eigtransform(self, t: Trajectories, right: bool = True, mode: str = "clip") -> DataFrame:
        """Frames projected on the slow modes: the transform's columns and ``modes``, NULL where there is no state."""
        vectors = np.real(self.right_eigenvectors_ if right else self.left_eigenvectors_)[:, 1:]
        rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
        table = t.df.sparkSession.createDataFrame(rows, "idx int, modes array<double>")
        return self.transform(t, mode).join(F.broadcast(table), "idx", "left")  # a row a state

    def sample_discrete(self, state=None, n_steps: int = 100, seed: int | None = None) -> list:
        """A chain of labels; ``state`` is a label, a distribution over states, or None for the populations."""
        rng = np.random.default_rng(seed)
        if state is None:
            start = rng.choice(self.n_states_, p=self.populations_)
        elif isinstance(state, (list, tuple, np.ndarray)):
            p = np.asarray(state, float)
            if len(p) != self.n_states_ or abs(p.sum() - 1) > 1e-8:
                raise ValueError("a distribution over all states sums to 1")
            start = rng.choice(self.n_states_, p=p)
        else:
            start = self.mapping_[state]
        edges = np.cumsum(self.transmat_, axis=1)
        chain = [int(start)]
        for u in rng.random(n_steps - 1):
            chain.append(min(int(np.searchsorted(edges[chain[-1]], u, side="right")), self.n_states_ - 1))
        return [self.labels_[i] for i in chain]

    # --- uncertainty ---

    def uncertainty_eigenvalues(self, columns: bool = False) -> np.ndarray:
        """Standard errors of the eigenvalues by the delta method, rows of counts taken as Dirichlet distributions.

        With ``columns`` the columns are, as some tools have it.
        """
        c = self.countsmat_ + self.prior_counts
        if columns:
            c = c.T
        u, left, right = (np.real(x) for x in self._eigen)
        out = []
        for k in range(len(u)):
            slope = np.outer(left[:, k], right[:, k])
            variance = 0.0
            for i in range(self.n_states_):
                w = c[i].sum()
                p = c[i] / w
                variance += (slope[i] @ (np.diag(p) - np.outer(p, p)) @ slope[i]) / (w + 1)
            out.append(np.sqrt(max(variance, 0.0)))
        return np.array(out)

    def uncertainty_timescales(self) -> np.ndarray:
        u = np.real(self.eigenvalues_[1:])
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.lag_time / (np.abs(u) * np.log(np.abs(u)) ** 2) * self.uncertainty_eigenvalues()[1:]

    # --- tables ---

    def to_frames(self, spark) -> dict[str, DataFrame]:
        """The model as tables: states, transition matrix in coordinates, modes."""
        states = [(i, str(s), float(p)) for i, (s, p) in enumerate(zip(self.labels_, self.populations_))]
        matrix = [(int(i), int(j), float(self.transmat_[i, j])) for i, j in np.argwhere(self.transmat_ > 0)]
        u, left, right = (np.real(x) for x in self._eigen)
        modes = [(k, i, float(u[k]), float(left[i, k]), float(right[i, k])) for k in range(len(u)) for i in range(self.n_states_)]
        return {
            "states": spark.createDataFrame(states, "idx int, label string, population double"),
            "transmat": spark.createDataFrame(matrix, "src int, dst int, value double"),
            "modes": spark.createDataFrame(modes, "mode int, idx int, eigenvalue double, left double, right double"),
        }

    def summarize(self) -> str:
        slow = ", ".join(f"{x:.2f}" for x in self.timescales_[:10])
        return (
            f"Markov state model, lag {self.lag_time}, {self.reversible_type}\n"
            f"states: {self.n_states_}, counts kept: {self.percent_retained_:.2f} %\n"
            f"nonzero counts: {int((self.countsmat_ > 0).sum())}, total {self.countsmat_.sum():.1f}\ntimescales: {slow}"
        )


def _matrices(t: Trajectories, lags: list[int]) -> dict[int, CountMatrix]:
    """Count matrices of many lags from one Spark job."""
    labels = counting.alphabet(t)
    by: dict[int, list] = {k: [] for k in lags}
    for r in counting.multilag_counts(t, sorted(set(lags))).collect():
        by[r["lag"]].append((r["src"], r["dst"], r["n"]))
    return {k: CountMatrix(counting.dense_counts(rows, labels, k, True), labels) for k, rows in by.items()}


def implied_timescales(t: Trajectories, lag_times: list[int], n_timescales: int = 10, model: MarkovStateModel | None = None) -> DataFrame:
    """``lag``, ``mode``, ``timescale`` for each lag, as many modes as every lag has."""
    model = model or MarkovStateModel()
    fits = {k: model.clone(lag_time=k, n_timescales=n_timescales).fit_counts(m) for k, m in _matrices(t, lag_times).items()}
    least = min(len(m.timescales_) for m in fits.values())
    rows = [(k, i, float(fits[k].timescales_[i])) for k in lag_times for i in range(least)]
    return t.df.sparkSession.createDataFrame(rows, "lag int, mode int, timescale double")


def param_sweep(t: Trajectories, grid: dict[str, list], model: MarkovStateModel | None = None, workers: int = 4) -> list[MarkovStateModel]:
    """A fitted copy for each point of the grid; points that share lag and window share their counts."""
    model = model or MarkovStateModel()
    names = sorted(grid)
    points = [dict(zip(names, values)) for values in product(*(grid[n] for n in names))]
    models = [model.clone(**p) for p in points]
    sliding = _matrices(t, [m.lag_time for m in models if m.sliding_window]) if any(m.sliding_window for m in models) else {}
    strided = {k: counting.count_matrix(t, k, False) for k in {m.lag_time for m in models if not m.sliding_window}}
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(lambda m: m.fit_counts((sliding if m.sliding_window else strided)[m.lag_time]), models))


class BootStrapMarkovStateModel:
    """Models of resampled sets of whole trajectories.

    Counts are made once for each trajectory. A replicate weights them by how often the
    trajectory was drawn, a number that depends on the trajectory and the replicate
    alone (Poisson resampling), so one aggregation gives all replicates; what
    was not drawn is its test set.
    """

    def __init__(self, n_samples: int = 10, model: MarkovStateModel | None = None, seed: int = 0):
        self.n_samples, self.model, self.seed = n_samples, model or MarkovStateModel(), seed

    def weighted_counts(self, t: Trajectories) -> DataFrame:
        """``sample``, ``src``, ``dst``, ``n`` drawn pairs and ``n_out`` pairs of trajectories that were not drawn."""
        each = counting.trajectory_counts(t, self.model.lag_time, self.model.sliding_window)
        return weighted_replicates(each, self.n_samples, self.seed)

    def fit(self, t: Trajectories) -> BootStrapMarkovStateModel:
        labels = counting.alphabet(t)
        lag, sliding = self.model.lag_time, self.model.sliding_window
        inside: dict[int, list] = {k: [] for k in range(self.n_samples)}
        outside: dict[int, list] = {k: [] for k in range(self.n_samples)}
        whole: dict[tuple, float] = {}
        for r in self.weighted_counts(t).collect():
            inside[r["sample"]].append((r["src"], r["dst"], r["n"]))
            outside[r["sample"]].append((r["src"], r["dst"], r["n_out"]))
        for r in counting.transition_counts(t, lag, sliding).collect():
            whole[r["src"], r["dst"]] = r["n"]
        make = lambda rows: CountMatrix(counting.dense_counts(rows, labels, lag, sliding), labels)
        self.mle_ = self.model.clone().fit_counts(make([(a, b, n) for (a, b), n in whole.items()]))
        self.models_, pops, scores = [], [], []
        for k in range(self.n_samples):
            try:
                m = self.model.clone().fit_counts(make(inside[k]))
                self.models_.append(m)
                pops.append([m.populations_[m.mapping_[s]] if s in m.mapping_ else 0.0 for s in self.mle_.labels_])
                scores.append(m.score_counts(make(outside[k])) if any(n for *_, n in outside[k]) else np.nan)
            except (ValueError, np.linalg.LinAlgError):
                self.models_.append(None)
                pops.append([np.nan] * self.mle_.n_states_)
                scores.append(np.nan)
        self.all_populations_, self.test_scores_ = np.array(pops), np.array(scores)
        return self


def weighted_replicates(each: DataFrame, n_samples: int, seed: int = 0) -> DataFrame:
    """Counts of replicates from counts of trajectories: weights are Poisson numbers of mean 1 from a hash.

    Rows are multiplied by the number of replicates before a partial aggregation over
    pairs of states, so the shuffle holds states squared times replicates a task.
    """
    u = (F.pmod(F.xxhash64("traj_id", "sample", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    # cumulative probabilities of a Poisson number of mean 1
    edges = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1), dtype=float) for k in range(12)])
    weight = sum(F.when(F.col("__u") > float(e), 1).otherwise(0) for e in edges)
    rows = each.select("traj_id", "src", "dst", "n", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("sample"))
    rows = rows.withColumn("__u", u).withColumn("w", weight)
    out = rows.groupBy("sample", "src", "dst").agg(
        F.sum(F.col("n") * F.col("w")).alias("n"), F.sum(F.when(F.col("w") == 0, F.col("n")).otherwise(0)).alias("n_out")
    )
    return out.where((F.col("n") > 0) | (F.col("n_out") > 0))


def macro_counts(t: Trajectories, macro: dict, lag: int = 1) -> DataFrame:
    """Transition counts between groups of states: ``src``, ``dst``, ``n``; labels outside all groups count as missing."""
    table = counting.mapping_table(t, macro)
    lumped = t.df.join(F.broadcast(table), F.col(t.state) == F.col("__label"), "left").drop("__label")
    return counting.transition_counts(t.replace(lumped).with_state("idx"), lag).select("src", "dst", "n")


def score_terms(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row with ``log_likelihood``: the counts ``n`` of ``test`` times the logarithm of ``t_ij`` of ``train``."""
    joined = test.join(train.select("src", "dst", "t_ij"), ["src", "dst"], "left")
    term = F.when(F.col("t_ij") > 0, F.col("n") * F.log("t_ij")).otherwise(F.lit(float("-inf")))
    return joined.agg(F.sum(term).alias("log_likelihood"))
