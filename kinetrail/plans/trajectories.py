"""A trajectory set as one DataFrame: which column tells the trajectory, which order its frames.

All operators that look along a trajectory use one window over the same keys, so
that Spark shuffles and sorts once for any number of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class Trajectories:
    """Frames of many trajectories. ``order`` must end in a unique key of a frame within its trajectory."""

    df: DataFrame
    traj: str
    order: tuple[str, ...]
    state: str | None = None
    features: str | None = None

    @property
    def window(self):
        return W.partitionBy(self.traj).orderBy(*self.order)

    def frames(self, *more: Column) -> DataFrame:
        """Columns ``traj_id``, ``frame`` from 0 and, where named, ``state`` and ``features``."""
        columns = [F.col(self.traj).alias("traj_id"), (F.row_number().over(self.window) - 1).cast("bigint").alias("frame")]
        if self.state:
            columns.append(F.col(self.state).alias("state"))
        if self.features:
            columns.append(F.col(self.features).alias("features"))
        return self.df.select(*columns, *more)

    def with_state(self, state: str) -> Trajectories:
        return Trajectories(self.df, self.traj, self.order, state, self.features)

    def with_features(self, features: str) -> Trajectories:
        return Trajectories(self.df, self.traj, self.order, self.state, features)

    def replace(self, df: DataFrame) -> Trajectories:
        return Trajectories(df, self.traj, self.order, self.state, self.features)


def missing(c: Column, kind: str) -> Column:
    """Whether a label is missing: NULL, and NaN where it is a floating number."""
    return (c.isNull() | F.isnan(c)) if kind in ("double", "float") else c.isNull()
