"""Bayesian Markov models: reversible Metropolis chains, one to a task, and perturbed matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from kinetrail.functions.linalg import eigensystem, stationary
from kinetrail.operators import counting
from kinetrail.operators.msm import StateModel
from kinetrail.plans.trajectories import Trajectories


def reversible_chain(counts: np.ndarray, n_samples: int, n_thin: int, seed: int, warm: int = 0) -> np.ndarray:
    """Samples of reversible transition matrices given counts, after Metzner, Noe and Schuette.

    The state is a symmetric matrix of weights ``k`` for the pairs of states that
    were observed. A step changes one weight while the total stays between 0.9 and
    1.1; it is accepted by the ratio of likelihoods, which involves two rows only.
    """
    rng = np.random.default_rng(seed)
    z = np.asarray(counts, float)
    rows = z.sum(axis=1)
    k = z + z.T
    k = k / k.sum()
    pairs = [(int(i), int(j)) for i, j in np.argwhere(np.triu(k > 0))]
    sums, total = k.sum(axis=1), 1.0
    out = np.empty((n_samples, len(z), len(z)))
    made = 0
    for step in range(warm + n_samples * n_thin):
        i, j = pairs[int(rng.integers(len(pairs)))]
        times = 1 if i == j else 2
        low = max(-k[i, j], (0.9 - total) / times)
        high = (1.1 - total) / times
        e = rng.uniform(low, high)
        new = k[i, j] + e
        if new > 0:
            joint = z[i, i] if i == j else z[i, j] + z[j, i]
            change = joint * np.log(new / k[i, j])
            change -= rows[i] * np.log((sums[i] + e) / sums[i])
            if i != j:
                change -= rows[j] * np.log((sums[j] + e) / sums[j])
            change -= np.log(new / k[i, j])  # a flat prior in the weights' logarithm
            if np.log(rng.random()) < change:
                k[i, j] = k[j, i] = new
                sums[i] += e
                if i != j:
                    sums[j] += e
                total += times * e
        if step >= warm and (step - warm + 1) % n_thin == 0:
            out[made] = k / sums[:, None]
            made += 1
    return out


class BayesianMarkovStateModel(StateModel):
    """An ensemble of reversible transition matrices given the counts, from independent chains on Spark tasks."""

    def __init__(self, lag_time: int = 1, n_samples: int = 100, n_steps: int = 0, n_chains: int = 4, n_timescales: int | None = None,
                 ergodic_cutoff: str | float = "on", prior_counts: float = 0.0, sliding_window: bool = True, seed: int = 0):
        self.lag_time, self.n_samples, self.n_steps, self.n_chains, self.n_timescales = lag_time, n_samples, n_steps, n_chains, n_timescales
        self.ergodic_cutoff, self.prior_counts, self.sliding_window, self.seed = ergodic_cutoff, prior_counts, sliding_window, seed

    def fit(self, t: Trajectories) -> BayesianMarkovStateModel:
        c = counting.count_matrix(t, self.lag_time, self.sliding_window, self.ergodic_cutoff)
        self.countsmat_, self.labels_, self.percent_retained_ = c.counts, c.labels, c.percent_retained
        self.n_states_ = len(c.labels)
        z = c.counts + self.prior_counts
        each = -(-self.n_samples // self.n_chains)
        thin = self.n_steps or max(1, self.n_states_**2)
        seed = self.seed

        def chains(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for chain in part["id"]:
                    # a seed of its own for each chain, nothing shared
                    drawn = reversible_chain(z, each, thin, int(np.random.SeedSequence([seed, chain]).generate_state(1)[0]), 10 * thin)
                    yield pd.DataFrame({"chain": chain, "draw": range(each), "matrix": [m.ravel().tolist() for m in drawn]})

        rows = t.df.sparkSession.range(0, self.n_chains, 1, self.n_chains).mapInPandas(chains, "chain long, draw int, matrix array<double>")
        drawn = sorted(rows.collect(), key=lambda r: (r["draw"], r["chain"]))
        self.all_transmats_ = np.array([r["matrix"] for r in drawn][-self.n_samples :]).reshape(-1, self.n_states_, self.n_states_)
        return self

    @property
    def all_populations_(self) -> np.ndarray:
        return np.array([stationary(m) for m in self.all_transmats_])

    @property
    def all_eigenvalues_(self) -> np.ndarray:
        k = self.n_states_ if self.n_timescales is None else min(self.n_timescales + 1, self.n_states_)
        return np.array([eigensystem(m, None, k, True)[0] for m in self.all_transmats_])

    @property
    def all_timescales_(self) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return -self.lag_time / np.log(self.all_eigenvalues_[:, 1:])

    def to_frame(self, spark) -> DataFrame:
        """``sample_id``, ``src``, ``dst``, ``value``."""
        rows = [(k, int(i), int(j), float(m[i, j])) for k, m in enumerate(self.all_transmats_) for i, j in np.argwhere(m > 0)]
        return spark.createDataFrame(rows, "sample_id int, src int, dst int, value double")

    def summarize(self) -> str:
        mean, sd = self.all_timescales_.mean(axis=0), self.all_timescales_.std(axis=0)
        return "\n".join([f"{self.n_samples} reversible matrices of {self.n_states_} states"] + [f"timescale {i}: {a:.2f} +- {b:.2f}" for i, (a, b) in enumerate(zip(mean, sd))])


def perturb_params(counts: np.ndarray) -> np.ndarray:
    """Standard error of each transition probability by the central limit theorem."""
    rows = counts.sum(axis=1, keepdims=True)
    p = counts / rows
    return np.sqrt(p * (1 - p) / rows)


def perturb_transmat(transmat: np.ndarray, error: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The matrix with normal noise of these errors, negatives set to 0, rows normalised."""
    m = np.clip(transmat + rng.normal(size=transmat.shape) * error, 0, None)
    return m / m.sum(axis=1, keepdims=True)
