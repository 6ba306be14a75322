"""Representative frames: along a dimension, near centres, along a simulated chain."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinetrail.operators.cluster import NearestFrames
from kinetrail.operators.msm import MarkovStateModel
from kinetrail.plans.trajectories import Trajectories


def sample_states(t: Trajectories, centers: np.ndarray, k: int = 1) -> DataFrame:
    """``query`` (the centre), ``rank``, ``distance``, ``traj_id``, ``frame`` of the k nearest frames of each centre."""
    return NearestFrames(t.frames(), ["traj_id", "frame"]).query(centers, k)


def sample_dimension(t: Trajectories, dim: int, n_frames: int, scheme: str = "linear", seed: int = 0) -> DataFrame:
    """Frames nearest to points on one feature: spread evenly, drawn at random, or the edges.

    Without repetition: a frame stands once, at its first point.
    """
    frames = t.frames().select("traj_id", "frame", F.array(F.col("features")[dim]).alias("features"))
    if scheme == "random":
        order = F.xxhash64("traj_id", "frame", F.lit(seed))
        return frames.orderBy(order, "traj_id", "frame").limit(n_frames).select("traj_id", "frame", F.col("features")[0].alias("value"))
    low, high = frames.agg(F.min(F.col("features")[0]), F.max(F.col("features")[0])).first()
    if scheme == "linear":
        points = np.linspace(low, high, n_frames)
    elif scheme == "edges":
        half = n_frames // 2
        ends = [frames.orderBy(o, "traj_id", "frame").limit(n) for o, n in ((F.col("features")[0], half), (F.col("features")[0].desc(), n_frames - half))]
        return ends[0].unionByName(ends[1]).select("traj_id", "frame", F.col("features")[0].alias("value")).distinct()
    else:
        raise ValueError(f"unknown scheme {scheme!r}")
    near = NearestFrames(frames, ["traj_id", "frame"]).query(points[:, None], 1)
    return near.select("traj_id", "frame").distinct().join(frames, ["traj_id", "frame"]).select("traj_id", "frame", F.col("features")[0].alias("value"))


def sample_msm(t: Trajectories, centers: np.ndarray, model: MarkovStateModel, n_steps: int, state=None, stride: int = 1, seed: int = 0) -> DataFrame:
    """``step``, ``state``, ``traj_id``, ``frame``: a simulated chain with the frame nearest to the centre of each visited state."""
    chain = model.sample_discrete(state, n_steps * stride, seed)[::stride]
    steps = t.df.sparkSession.createDataFrame([(i, int(s)) for i, s in enumerate(chain)], "step int, state int")
    near = sample_states(t, centers, 1).select(F.col("query").alias("state"), "traj_id", "frame")
    return steps.join(F.broadcast(near), "state").select("step", "state", "traj_id", "frame")


def map_drawn_samples(drawn: DataFrame, frames: DataFrame) -> DataFrame:
    """The rows of ``frames`` that are referred to by ``traj_id`` and ``frame``, as often as they were drawn."""
    return drawn.join(frames, ["traj_id", "frame"])


def categorical(df: DataFrame, probabilities: DataFrame, key: Column, seed: int = 0) -> DataFrame:
    """Each row with a drawn ``idx``: the probabilities (``idx``, ``p``), a short list, as an array of edges."""
    rows = probabilities.orderBy("idx").collect()
    edges = np.cumsum([r["p"] for r in rows])
    if abs(edges[-1] - 1) > 1e-8:
        raise ValueError("probabilities must sum to 1")
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    above = F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= u)
    at = F.least(F.size(above), F.lit(len(rows) - 1))
    return df.withColumn("idx", F.get(F.array(*(F.lit(r["idx"]) for r in rows)), at))


def unique_in_order(df: DataFrame, value: str, position: str) -> DataFrame:
    """The different values in the order of their first positions."""
    return df.groupBy(value).agg(F.min(position).alias(position)).orderBy(position).select(value, position)


def trajectory_medians(t: Trajectories, dim: int) -> DataFrame:
    """``traj_id`` and the frame whose feature is nearest to the trajectory's median."""
    frames = t.frames().withColumn("v", F.col("features")[dim].cast("double"))
    m = frames.groupBy("traj_id").agg(F.percentile("v", F.lit(0.5)).alias("m"))
    near = W.partitionBy("traj_id").orderBy(F.abs(F.col("v") - F.col("m")), "frame")
    return frames.join(m, "traj_id").withColumn("r", F.row_number().over(near)).where(F.col("r") == 1).select("traj_id", "frame", "v")
