"""Coarse-graining of Markov models: states to macrostates, then a join to apply it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from kinetrail.functions.divergence import js_metric_array
from kinetrail.functions.linalg import cut_tree, linkage, minimize_simplex
from kinetrail.operators import counting
from kinetrail.operators.msm import MarkovStateModel
from kinetrail.plans.trajectories import Trajectories


class Lumping(MarkovStateModel):
    """A Markov model with ``microstate_mapping_``: the macrostate of each of its states."""

    def __init__(self, n_macrostates: int, **kw):
        super().__init__(**kw)
        self.n_macrostates = n_macrostates

    def clone(self, **changes) -> MarkovStateModel:
        return MarkovStateModel(**(self.params | changes))

    def fit_counts(self, counts):
        super().fit_counts(counts)
        self.microstate_mapping_ = self._lump()
        return self

    @classmethod
    def from_msm(cls, model: MarkovStateModel, n_macrostates: int, **kw) -> Lumping:
        """From a fitted model, without fitting again."""
        out = cls(n_macrostates, **(model.params | kw))
        for name in ("countsmat_", "labels_", "percent_retained_", "n_states_", "transmat_", "populations_"):
            setattr(out, name, getattr(model, name))
        out.microstate_mapping_ = out._lump()
        return out

    def _lump(self) -> np.ndarray:
        raise NotImplementedError

    @property
    def macro_mapping_(self) -> dict:
        return {s: int(self.microstate_mapping_[i]) for i, s in enumerate(self.labels_)}

    def macro_transform(self, t: Trajectories, mode: str = "clip") -> DataFrame:
        """Trajectories of macrostates; labels outside the model cut them or stay NULL."""
        return (counting.clip_labels if mode == "clip" else counting.fill_labels)(t, self.macro_mapping_)

    def _slow(self) -> np.ndarray:
        """Slow right eigenvectors, one fewer than macrostates."""
        k = self.n_macrostates
        if k > self.n_states_:
            raise ValueError("more macrostates than states")
        from kinetrail.functions.linalg import eigensystem

        return np.real(eigensystem(self.transmat_, self.populations_, k, self.reversible_type != "none")[2])


class PCCA(Lumping):
    """Perron cluster analysis: each slow eigenvector splits the macrostate over which it spreads most, by sign."""

    def __init__(self, n_macrostates: int, pcca_tolerance: float = 1e-5, **kw):
        super().__init__(n_macrostates, **kw)
        self.pcca_tolerance = pcca_tolerance

    def _lump(self) -> np.ndarray:
        blocks = [np.arange(self.n_states_)]
        for mode in self._slow().T[1 : self.n_macrostates]:
            at = max(range(len(blocks)), key=lambda k: np.ptp(mode[blocks[k]]) if len(blocks[k]) else -1.0)
            above = mode[blocks[at]] >= self.pcca_tolerance
            blocks[at : at + 1], risen = [blocks[at][~above]], blocks[at][above]
            blocks.append(risen)
        macro = np.empty(self.n_states_, int)
        for k, block in enumerate(blocks):
            macro[block] = k
        return macro


class PCCAPlus(Lumping):
    """Robust Perron cluster analysis after Deuflhard and Weber: fuzzy memberships that are linear in the slow eigenvectors."""

    def __init__(self, n_macrostates: int, do_minimization: bool = True, objective_function: str = "crisp_metastability", **kw):
        super().__init__(n_macrostates, **kw)
        if objective_function not in ("crisp_metastability", "metastability", "crispness"):
            raise ValueError(f"unknown objective {objective_function!r}")
        self.do_minimization, self.objective_function = do_minimization, objective_function

    def _lump(self) -> np.ndarray:
        y = self._slow().copy()
        y[:, 0] = 1.0
        start = np.linalg.inv(y[self._corners(y)])
        self.rotation_ = self._feasible(start[1:, 1:], y)
        if self.do_minimization and self.n_macrostates > 2:
            k = self.n_macrostates - 1
            x, _ = minimize_simplex(lambda z: -self.objective(self._feasible(z.reshape(k, k), y), y), start[1:, 1:].ravel(), 0.05)
            better = self._feasible(x.reshape(k, k), y)
            if self.objective(better, y) > self.objective(self.rotation_, y):
                self.rotation_ = better
        self.chi_ = y @ self.rotation_
        return self.chi_.argmax(axis=1)

    def _corners(self, y: np.ndarray) -> list[int]:
        """States that lie farthest apart in the eigenvectors: the first farthest out, each next farthest from the span so far."""
        z = y - y[int(np.argmax(np.linalg.norm(y[:, 1:], axis=1)))]
        found = [int(np.argmax(np.linalg.norm(y[:, 1:], axis=1)))]
        for _ in range(self.n_macrostates - 1):
            size = np.linalg.norm(z, axis=1)
            found.append(int(np.argmax(size)))
            e = z[found[-1]] / max(size[found[-1]], 1e-300)
            z = z - np.outer(z @ e, e)
        return found

    @staticmethod
    def _feasible(core: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A rotation whose memberships are not negative and sum to 1, from its lower right part."""
        k = y.shape[1]
        a = np.zeros((k, k))
        a[1:, 1:] = core
        a[1:, 0] = -core.sum(axis=1)
        a[0] = -(y[:, 1:] @ a[1:]).min(axis=0)
        return a / a[0].sum()

    def objective(self, a: np.ndarray, y: np.ndarray) -> float:
        chi = y @ a
        pi = self.populations_
        if self.objective_function == "crispness":
            # how near memberships are to 0 and 1
            return float(np.trace((chi * pi[:, None]).T @ chi / (pi @ chi)[:, None]))
        if self.objective_function == "crisp_metastability":
            hard = np.eye(chi.shape[1])[chi.argmax(axis=1)]
            if not hard.any(axis=0).all():
                return -np.inf
            chi = hard
        weight = chi * pi[:, None]
        return float(np.trace(weight.T @ self.transmat_ @ chi / weight.sum(axis=0)[:, None]))


class MVCA(Lumping):
    """Ward clustering of the rows of the transition matrix under a divergence; the tree is kept as ``linkage_``."""

    def __init__(self, n_macrostates: int, metric=js_metric_array, n_landmarks: int | None = None, fit_only: bool = False, seed: int = 0, **kw):
        super().__init__(n_macrostates, **kw)
        self.metric, self.n_landmarks, self.fit_only, self.seed = metric, n_landmarks, fit_only, seed

    def _lump(self) -> np.ndarray:
        n, t = self.n_states_, self.transmat_
        chosen = np.arange(n)
        if self.n_landmarks and self.n_landmarks < n:
            chosen = np.sort(np.random.default_rng(self.seed).choice(n, self.n_landmarks, replace=False))
        rows = t[chosen]
        d = np.array([self.metric(rows, rows, i) for i in range(len(rows))])
        self.linkage_ = linkage((d + d.T) / 2, "ward")
        labels = cut_tree(self.linkage_, self.n_macrostates)
        if len(chosen) == n:
            return labels
        # a state goes to the macrostate whose landmarks are nearest on the average
        d = np.array([self.metric(rows, t, i) for i in range(n)])
        return np.stack([d[:, labels == k].mean(axis=1) for k in range(self.n_macrostates)], 1).argmin(axis=1)


class BACE(Lumping):
    """Bayesian agglomerative clustering: states are merged by the evidence that their rows are one distribution.

    States with few counts are absorbed by the neighbour they lead to most. The mapping is
    that after the last merge, for any number of merges, none included.
    """

    def __init__(self, n_macrostates: int, filter: float = 1.1, save_all_maps: bool = True, **kw):
        super().__init__(n_macrostates, **kw)
        self.filter, self.save_all_maps = filter, save_all_maps

    def _lump(self) -> np.ndarray:
        n = self.n_states_
        # evidence and filter ask for numbers of transitions, which sliding windows divide by the lag
        counts = self.countsmat_ * (self.lag_time if self.sliding_window else 1)
        c = counts + 1.0 / n  # a pseudo-count a row
        macro = [{i} for i in range(n)]
        alive = list(range(n))
        self.map_dict, self.bayesFactors = {}, {}
        rows = {i: c[i].copy() for i in alive}
        for i in [i for i in range(n) if counts[i].sum() < self.filter and n > self.n_macrostates]:
            if len(alive) <= self.n_macrostates:
                break
            pull = {j: sum(counts[i, m] + counts[m, i] for m in macro[j]) for j in alive if j != i}
            self._merge(max(pull, key=lambda j: (pull[j], -j)), i, rows, macro, alive)
        while len(alive) > self.n_macrostates:
            best, pair = np.inf, None
            for x, i in enumerate(alive):
                for j in alive[x + 1 :]:
                    f = self._evidence(rows[i], rows[j])
                    if f < best:
                        best, pair = f, (i, j)
            self.bayesFactors[len(alive) - 1] = best
            self._merge(*pair, rows, macro, alive)
            if self.save_all_maps:
                self.map_dict[len(alive)] = self._labels(macro, alive, n)
        return self._labels(macro, alive, n)

    @staticmethod
    def _evidence(a: np.ndarray, b: np.ndarray) -> float:
        """Twice the pooled divergence: the logarithm of the Bayes factor against one common distribution."""
        p, q = a / a.sum(), b / b.sum()
        m = (a + b) / (a.sum() + b.sum())
        return float(a.sum() * (p * np.log(p / m)).sum() + b.sum() * (q * np.log(q / m)).sum())

    @staticmethod
    def _merge(i: int, j: int, rows: dict, macro: list, alive: list) -> None:
        rows[i] = rows[i] + rows.pop(j)
        # the columns of merged states are one as well: spread evenly over their members
        macro[i] = macro[i] | macro[j]
        alive.remove(j)
        members = sorted(macro[i])
        for r in rows.values():
            r[members] = r[members].mean()

    @staticmethod
    def _labels(macro: list, alive: list, n: int) -> np.ndarray:
        out = np.zeros(n, int)
        for k, i in enumerate(alive):
            out[sorted(macro[i])] = k
        return out
