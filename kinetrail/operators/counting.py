"""Transition counting: pairs at a lag within trajectories, trimming, and label transforms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinetrail.functions.linalg import ergodic_part
from kinetrail.plans.trajectories import Trajectories, missing


def _kind(t: Trajectories) -> str:
    if t.state is None:
        raise ValueError("the trajectories have no state column")
    return t.df.schema[t.state].dataType.simpleString()


def _checked(lag: int) -> int:
    if lag < 1:
        raise ValueError("a lag is at least one frame")
    return lag


def transition_pairs(t: Trajectories, lag: int = 1, sliding: bool = True) -> DataFrame:
    """``traj_id``, ``src`` and ``dst`` of each pair of frames ``lag`` apart in one trajectory.

    Pairs never cross trajectories. A missing label drops the pairs that touch it
    and does not shift the others: the pair is formed first, the filter follows.
    Without ``sliding`` only every ``lag``-th frame of a trajectory counts.
    """
    _checked(lag)
    kind = _kind(t)
    state = F.col(t.state)
    base = t.df.select(F.col(t.traj).alias("traj_id"), state.alias("src"), F.lead(state, lag).over(t.window).alias("dst"), *(
        [] if sliding else [F.row_number().over(t.window).alias("__n")]
    ))
    if not sliding:
        base = base.where((F.col("__n") - 1) % lag == 0)
    return base.where(~missing(F.col("src"), kind) & ~missing(F.col("dst"), kind)).select("traj_id", "src", "dst")


def transition_counts(t: Trajectories, lag: int = 1, sliding: bool = True) -> DataFrame:
    """``src``, ``dst``, ``n`` pairs and ``count``: pairs divided by the lag if sliding, since such pairs overlap."""
    pairs = transition_pairs(t, lag, sliding)
    n = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("count", F.col("n") / float(lag if sliding else 1))


def multilag_counts(t: Trajectories, lags: list[int]) -> DataFrame:
    """``lag``, ``src``, ``dst``, ``n`` for many lags in one pass: one window with a lead for each lag, then one aggregation."""
    kind = _kind(t)
    state = F.col(t.state)
    leads = F.array(*(F.struct(F.lit(_checked(k)).alias("lag"), F.lead(state, k).over(t.window).alias("dst")) for k in lags))
    rows = t.df.select(state.alias("src"), leads.alias("p")).select("src", F.explode("p").alias("p"))
    rows = rows.select("p.lag", "src", "p.dst").where(~missing(F.col("src"), kind) & ~missing(F.col("dst"), kind))
    return rows.groupBy("lag", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def trajectory_counts(t: Trajectories, lag: int = 1, sliding: bool = True) -> DataFrame:
    """``traj_id``, ``src``, ``dst``, ``n``: the counts of each trajectory, what resampling of trajectories needs."""
    return transition_pairs(t, lag, sliding).groupBy("traj_id", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def alphabet(t: Trajectories) -> list:
    """The labels that occur, sorted, without missing ones; as many as there are states."""
    kind = _kind(t)
    rows = t.df.select(F.col(t.state).alias("s")).where(~missing(F.col("s"), kind)).distinct().orderBy("s").collect()
    return [r["s"] for r in rows]


@dataclass(frozen=True)
class CountMatrix:
    """Counts between states. ``labels`` are the states in order, ``mapping`` a label to its index."""

    counts: np.ndarray
    labels: list
    percent_retained: float = 100.0

    @property
    def mapping(self) -> dict:
        return {s: i for i, s in enumerate(self.labels)}

    def trimmed(self, cutoff: float) -> CountMatrix:
        """The most populated strongly connected part; a cut-off of 0 trims nothing."""
        if cutoff == 0:
            return self
        kept, percent = ergodic_part(self.counts, cutoff)
        return CountMatrix(self.counts[np.ix_(kept, kept)], [self.labels[i] for i in kept], percent)


def compose(first: dict, second: dict) -> dict:
    """Mapping over two steps; what the second does not know is dropped."""
    return {k: second[v] for k, v in first.items() if v in second}


def ergodic_cutoff(cutoff: str | float, lag: int, sliding: bool) -> float:
    """``on``: one observed transition, ``off``: none; a number stands for itself."""
    if cutoff == "on":
        return 1.0 / lag if sliding else 1.0
    if cutoff == "off":
        return 0.0
    if isinstance(cutoff, str):
        raise ValueError(f"unknown cut-off {cutoff!r}")
    return float(cutoff)


def dense_counts(rows: list, labels: list, lag: int, sliding: bool) -> np.ndarray:
    at = {s: i for i, s in enumerate(labels)}
    c = np.zeros((len(labels), len(labels)))
    for src, dst, n in rows:
        c[at[src], at[dst]] += n
    return c / (lag if sliding else 1)


def count_matrix(t: Trajectories, lag: int = 1, sliding: bool = True, cutoff: str | float = "off") -> CountMatrix:
    """The dense count matrix on the driver, trimmed at ``cutoff``. At most states squared numbers are collected."""
    labels = alphabet(t)
    rows = [(r["src"], r["dst"], r["n"]) for r in transition_counts(t, lag, sliding).collect()]
    return CountMatrix(dense_counts(rows, labels, lag, sliding), labels).trimmed(ergodic_cutoff(cutoff, lag, sliding))


def mapping_table(t: Trajectories, mapping: dict, name: str = "__label") -> DataFrame:
    """A mapping as a DataFrame of a row a state."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(name, t.df.schema[t.state].dataType), T.StructField("idx", T.IntegerType())])
    return t.df.sparkSession.createDataFrame([(k, int(v)) for k, v in mapping.items()], schema)


def fill_labels(t: Trajectories, mapping: dict) -> DataFrame:
    """``traj_id``, ``frame`` and ``idx``, the index of the label or NULL where it has none."""
    frames = t.frames()
    table = F.broadcast(mapping_table(t, mapping))  # a row a state
    return frames.join(table, F.col("state") == F.col("__label"), "left").select("traj_id", "frame", "idx")


def clip_labels(t: Trajectories, mapping: dict) -> DataFrame:
    """``traj_id``, ``segment``, ``frame``, ``idx``: each run between labels without an index is a segment, from 0."""
    filled = fill_labels(t, mapping)
    ordered = W.partitionBy("traj_id").orderBy("frame")
    gaps = F.sum(F.col("idx").isNull().cast("int")).over(ordered)
    kept = filled.withColumn("__g", gaps).where(F.col("idx").isNotNull())
    segment = F.dense_rank().over(W.partitionBy("traj_id").orderBy("__g")) - 1
    return kept.select("traj_id", segment.cast("bigint").alias("segment"), "frame", "idx")


def inverse_labels(df: DataFrame, column: str, labels: list, out: str = "label") -> DataFrame:
    """Indices back to labels. An index without a label fails the job."""
    at = F.array(*(F.lit(s) for s in labels))
    fine = F.col(column).isNull() | ((F.col(column) >= 0) & (F.col(column) < len(labels)))
    bad = F.raise_error(F.concat(F.lit("no label for index "), F.col(column).cast("string")))
    label = F.when(fine, F.get(at, F.col(column).cast("int"))).otherwise(bad)
    return df.withColumn(out, label)


def subsample(t: Trajectories, lag: int, sliding: bool = True) -> DataFrame:
    """``traj_id``, ``shift``, ``frame``, and the columns of the frame: each trajectory as its strided copies.

    Sliding gives all ``lag`` shifts, else only the first.
    """
    frames = t.frames()
    shift = F.pmod("frame", F.lit(_checked(lag)))
    out = frames.withColumn("shift", shift)
    return out if sliding else out.where(F.col("shift") == 0)


def transpose_matrix(counts: DataFrame) -> DataFrame:
    """Reversible transition matrix by symmetrisation: ``src``, ``dst``, ``t_ij`` and the population ``pi_i`` of ``src``."""
    both = counts.select("src", "dst", "n").unionByName(counts.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    s = both.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    row, whole = F.sum("n").over(W.partitionBy("src")), F.sum("n").over(W.partitionBy())  # a row a pair of states
    return s.select("src", "dst", (F.col("n") / row).alias("t_ij"), (row / whole).alias("pi_i"))


def row_matrix(counts: DataFrame) -> DataFrame:
    """Transition matrix by normalised rows: ``src``, ``dst``, ``t_ij``."""
    return counts.select("src", "dst", (F.col("n") / F.sum("n").over(W.partitionBy("src"))).alias("t_ij"))
