"""Chains of estimators over trajectories, and scores over folds of whole trajectories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kinetrail.operators import counting
from kinetrail.operators.counting import CountMatrix
from kinetrail.operators.msm import MarkovStateModel
from kinetrail.plans.trajectories import Trajectories
from kinetrail.session import materialize


class Pipeline:
    """Named steps, each fitted on what the one before gives.

    A step learns from trajectories (models along them) or from rows (the rest); its
    ``transform`` gives rows with ``features`` or a ``label``. Tables between steps are
    written once, as the next step scans them more than once.
    """

    #: Kinds that learn from trajectories; the others from rows.
    ALONG = ("tICA", "SparseTICA", "KSparseTICA", "KernelTICA", "MarkovStateModel", "BayesianMarkovStateModel", "ContinuousTimeMSM", "GaussianHMM", "VonMisesHMM", "PCCA", "PCCAPlus", "MVCA", "BACE", "APM")

    def __init__(self, steps: list[tuple[str, object]]):
        self.steps = steps

    @property
    def named_steps(self) -> dict:
        return dict(self.steps)

    def fit(self, t: Trajectories) -> Pipeline:
        for k, (_, step) in enumerate(self.steps):
            step.fit(t if type(step).__name__ in self.ALONG else t.df)
            if k < len(self.steps) - 1:
                t = self._through(step, t, keep=True)
        return self

    def transform(self, t: Trajectories) -> Trajectories:
        """All steps but a last one that only models."""
        for _, step in self.steps:
            if isinstance(step, MarkovStateModel):
                break
            t = self._through(step, t, keep=False)
        return t

    @staticmethod
    def _through(step, t: Trajectories, keep: bool) -> Trajectories:
        out = step.transform(t.df) if not hasattr(step, "predict") else step.predict(t.df)
        out = materialize(out) if keep else out
        labelled = hasattr(step, "predict")
        return Trajectories(out, t.traj, t.order, "label" if labelled else t.state, t.features or "features")


def cross_validate(t: Trajectories, model: MarkovStateModel, folds: int = 5, seed: int = 0) -> np.ndarray:
    """The score of the model on each fold when fitted on the others.

    Folds are of whole trajectories by hash, and their counts come from one job: the
    counts of the others are the whole minus the fold's.
    """
    each = counting.trajectory_counts(t, model.lag_time, model.sliding_window)
    fold = F.pmod(F.xxhash64("traj_id", F.lit(seed)), F.lit(folds))
    labels = counting.alphabet(t)
    rows = each.groupBy(fold.alias("fold"), "src", "dst").agg(F.sum("n").alias("n")).collect()
    parts = [counting.dense_counts([(r["src"], r["dst"], r["n"]) for r in rows if r["fold"] == k], labels, model.lag_time, model.sliding_window) for k in range(folds)]
    whole = sum(parts)
    out = []
    for k in range(folds):
        if not parts[k].any():
            out.append(np.nan)
            continue
        cut = counting.ergodic_cutoff(model.ergodic_cutoff, model.lag_time, model.sliding_window)
        fit = model.clone().fit_counts(CountMatrix(whole - parts[k], labels))
        out.append(fit.score_counts(CountMatrix(parts[k], labels).trimmed(cut)))
    return np.array(out)
