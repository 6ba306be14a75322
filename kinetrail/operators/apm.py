"""Automatic partitioning: rounds of splitting states until they relax and lumping them by kinetics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinetrail.functions.distances import pairwise
from kinetrail.operators import counting
from kinetrail.operators.cluster import KCenters
from kinetrail.operators.lumping import PCCA
from kinetrail.plans.trajectories import Trajectories
from kinetrail.session import drop, materialize


class Stage:
    """States of one round: centres, the macrostate within which each holds, and the macrostate it is lumped to."""

    def __init__(self, centers: np.ndarray, owner: np.ndarray, metric: str):
        self.centers, self.owner, self.metric = centers, owner, metric
        self.macro: list[int | None] = []

    def near(self, x: np.ndarray, macro: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = pairwise(x, self.centers, self.metric)
        d[np.asarray(macro)[:, None] != self.owner[None, :]] = np.inf
        at = d.argmin(axis=1)
        return at, d[np.arange(len(d)), at]

    def inner(self) -> np.ndarray:
        """Macrostates with those of states outside the ergodic part taken from the nearest centre inside it."""
        known = np.array([i for i, m in enumerate(self.macro) if m is not None])
        return np.array([self.macro[known[k]] for k in pairwise(self.centers, self.centers[known], self.metric).argmin(axis=1)])


def _walk(stages: list[Stage], x: np.ndarray) -> np.ndarray:
    """Macrostates of frames after some rounds."""
    macro = np.zeros(len(x), int)
    for s in stages:
        macro = s.inner()[s.near(x, macro)[0]]
    return macro


class APM:
    """Labels of the best metastability over ``max_iter`` rounds.

    A state whose frames leave it too slowly within the lag, by a relaxation probability of
    at most 1 - 1/e, is split in two by its farthest frames until none is left or there are
    ``max_states``; the states are then lumped to ``n_macrostates``. A round stands if its
    metastability is not much below the last; the next one splits within its macrostates.
    """

    def __init__(self, n_macrostates: int, max_iter: int = 5, lag_time: int = 1, metric: str = "euclidean", max_states: int = 200, seed: int = 0):
        self.n_macrostates, self.max_iter, self.lag_time, self.metric, self.max_states, self.seed = n_macrostates, max_iter, lag_time, metric, max_states, seed

    def fit(self, t: Trajectories) -> APM:
        after = F.lead("features", self.lag_time).over(W.partitionBy("traj_id").orderBy("frame"))
        frames = materialize(t.frames().select("traj_id", "frame", "features", after.alias("after"), F.xxhash64("traj_id", "frame").alias("id")))
        self.Q_, last, stages = -np.inf, None, []
        self.rounds_: list[dict] = []
        for r in range(self.max_iter):
            stage = self._split(frames, stages, self._start(frames, stages, r))
            labelled = frames.select("traj_id", "frame", _label([*stages, stage], F.col("features")).alias("label"))
            counts = counting.count_matrix(Trajectories(labelled, "traj_id", ("frame",), "label"), self.lag_time, cutoff="on")
            k = min(self.n_macrostates, len(counts.labels))
            lumped = PCCA(k, lag_time=self.lag_time, reversible_type="transpose").fit_counts(counts)
            m = np.eye(k)[lumped.microstate_mapping_]
            c = m.T @ lumped.countsmat_ @ m
            q = float((np.diag(c) / np.maximum(c.sum(axis=1), 1e-300)).sum())
            stage.macro = [lumped.macro_mapping_.get(i) for i in range(len(stage.centers))]
            stands = last is None or bool(np.exp(q * q - last * last) > 0.95)
            self.rounds_.append({"states": len(stage.centers), "relaxed": stage.relaxed, "Q": q, "stands": stands})
            if not stands:
                continue
            last, stages = q, [*stages, stage]
            if q > self.Q_:
                self.Q_, self.stages_, self.cluster_centers_ = q, stages, stage.centers
        drop(frames)
        return self

    def _start(self, frames: DataFrame, stages: list[Stage], r: int) -> Stage:
        """Centres of a round: of all frames, or two of each macrostate so far."""
        if not stages:
            centers = KCenters(self.n_macrostates, self.metric, key="id", seed=self.seed + r).fit(frames).cluster_centers_
            return Stage(centers, np.zeros(len(centers), int), self.metric)
        macro = F.pandas_udf(lambda x: pd.Series(_walk(stages, np.stack(x.to_numpy()))) if len(x) else pd.Series([], dtype="int64"), "bigint")
        known = frames.withColumn("macro", macro("features"))
        owners = sorted(set(stages[-1].inner().tolist()))
        parts = [KCenters(2, self.metric, key="id", seed=self.seed + r).fit(known.where(F.col("macro") == m)).cluster_centers_ for m in owners]
        return Stage(np.vstack(parts), np.repeat(owners, [len(p) for p in parts]), self.metric)

    def _split(self, frames: DataFrame, stages: list[Stage], stage: Stage) -> Stage:
        while True:
            n = len(stage.centers)

            def scan(parts: Iterator[pd.DataFrame], stage=stage, n=n) -> Iterator[pd.DataFrame]:
                # of each partition the counts of a state and its farthest frame
                total, stay, far = np.zeros(n), np.zeros(n), {}
                for part in parts:
                    if not len(part):
                        continue
                    x = np.stack(part["features"].to_numpy()).astype(float)
                    at, d = stage.near(x, _walk(stages, x))
                    has = part["after"].notna().to_numpy()
                    if has.any():
                        y = np.stack(part["after"][has].to_numpy()).astype(float)
                        then = stage.near(y, _walk(stages, y))[0]
                        total += np.bincount(at[has], minlength=n)
                        stay += np.bincount(at[has][at[has] == then], minlength=n)
                    for k in np.unique(at):
                        inside = np.flatnonzero(at == k)
                        i = inside[d[inside].argmax()]
                        far[k] = max(far.get(k, (-1.0, [])), (float(d[i]), x[i].tolist()))
                yield pd.DataFrame([(int(k), total[k], stay[k], dist, x) for k, (dist, x) in far.items()], columns=["state", "total", "stay", "d", "x"])

            found = frames.select("features", "after").mapInPandas(scan, "state int, total double, stay double, d double, x array<double>").collect()
            total, stay, far = np.zeros(n), np.zeros(n), {}
            for row in found:
                total[row["state"]] += row["total"]
                stay[row["state"]] += row["stay"]
                far[row["state"]] = max(far.get(row["state"], (-1.0, [])), (row["d"], list(row["x"])))
            slow = [k for k in np.flatnonzero((total > 0) & (stay >= total / np.e)) if far[k][0] > 0]
            stage.relaxed = not slow
            slow = slow[: max(0, self.max_states - n)]
            if not slow:
                return stage
            fresh = np.array([far[k][1] for k in slow])
            stage = Stage(np.vstack([stage.centers, fresh]), np.concatenate([stage.owner, stage.owner[slow]]), self.metric)

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``label``, the macrostate, or NULL for a state outside the ergodic part."""
        macro = F.array(*(F.lit(m).cast("int") for m in self.stages_[-1].macro))
        return df.withColumn("label", F.get(macro, _label(self.stages_, F.col("features"))))


def _label(stages: list[Stage], x: Column) -> Column:
    """The state of the last round."""

    @F.pandas_udf("int")
    def label(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype="int32")
        y = np.stack(rows.to_numpy()).astype(float)
        return pd.Series(stages[-1].near(y, _walk(stages[:-1], y))[0].astype(np.int32))

    return label(x)
