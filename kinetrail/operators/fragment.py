"""Per-key work without hot tasks: fragment and replicate by estimated load.

Keys are packed to tasks by their load. Keys that would fill a task are split
into shards in proportion to their load, and the matching side of a join is
copied to the shards of such a key only. Light keys go where their hash sends
them; shards of heavy keys are placed around that load, the largest first, by
choosing for each shard a salt whose hash leads to the least loaded of several
tasks. Spark's own hash partitioning then realises the plan, so joins and
aggregations on ``(key, salt)`` need no exchange besides the planned one.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetrail.session import drop, materialize

SALT = "__salt"
#: Tasks among which the place of a shard is chosen.
CHOICES = 64


@dataclass(frozen=True)
class FragmentPlan:
    """Shards of the heavy keys: at most ``2 * tasks`` keys, whatever the data."""

    key: str
    tasks: int
    #: heavy key -> salts of its shards
    shards: dict
    #: estimated rows of each task
    loads: tuple[float, ...]
    table: DataFrame

    @property
    def imbalance(self) -> float:
        """Largest load over mean load."""
        total = sum(self.loads)
        return max(self.loads) * self.tasks / total if total else 1.0


def plan_fragments(df: DataFrame, key: str, tasks: int | None = None, weight: Column | None = None) -> FragmentPlan:
    """Estimate the load of each key, in rows or in ``weight``, and place it.

    NULL is a key like any other. An empty table gives a plan without shards.
    To the driver go the heavy keys, of which there are at most ``2 * tasks``, and
    a number for each task.
    """
    spark = df.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    amount = F.count(F.lit(1)).cast("double") if weight is None else F.coalesce(F.sum(weight).cast("double"), F.lit(0.0))
    loads = materialize(df.groupBy(key).agg(amount.alias("__load")))
    place = lambda salt: F.pmod(F.hash(F.col(key), salt), F.lit(tasks))
    light = {r[0]: r[1] for r in loads.groupBy(place(F.lit(0)).alias("t")).agg(F.sum("__load").alias("n")).collect()}
    total = sum(light.values())
    target = total / tasks
    heavy: dict = {}
    if total:
        for r in loads.where(F.col("__load") > target / 2).select(key, "__load", place(F.lit(0)).alias("t")).collect():
            heavy[r[0]] = r["__load"]
            light[r["t"]] -= r["__load"]
    at = [float(light.get(t, 0.0)) for t in range(tasks)]
    kind = df.schema[key].dataType
    parts = {k: max(1, math.ceil(n / target)) for k, n in heavy.items()}
    places: dict = {}
    if heavy:
        tried = spark.createDataFrame([(k, CHOICES + 4 * n) for k, n in parts.items()], T.StructType([T.StructField(key, kind), T.StructField("n", T.IntegerType())]))
        tried = tried.select(key, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("salt"))
        for k, salt, t in tried.select(key, "salt", place(F.col("salt"))).collect():
            places.setdefault(k, {})[salt] = t
    shards: dict = {k: [] for k in heavy}
    queue = [(-n / parts[k], i, k) for i, (k, n) in enumerate(heavy.items()) for _ in range(parts[k])]
    heapq.heapify(queue)
    while queue:
        size, _, k = heapq.heappop(queue)
        salt = min(places[k], key=lambda s: (at[places[k][s]], s))
        at[places[k].pop(salt)] -= size
        shards[k].append(salt)
    drop(loads)
    rows = [(k, s) for k, s in shards.items()]
    schema = T.StructType([T.StructField("__k", kind), T.StructField("__salts", T.ArrayType(T.IntegerType()))])
    return FragmentPlan(key, tasks, shards, tuple(at), spark.createDataFrame(rows, schema))


def fragmented(df: DataFrame, plan: FragmentPlan, spread: list[str] | None = None) -> DataFrame:
    """``df`` with the salt of the shard of each row, evenly by the hash of ``spread`` or of the whole row.

    The hash depends on the row alone, so a task that runs again gives the same.
    """
    even = F.xxhash64(*(spread or [c for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]))
    joined = df.join(F.broadcast(plan.table), df[plan.key].eqNullSafe(F.col("__k")), "left")
    salt = F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(
        F.element_at("__salts", (F.pmod(even, F.greatest(F.size("__salts"), F.lit(1))) + 1).cast("int"))
    )
    return joined.select(*(df[c] for c in df.columns), salt.alias(SALT))


def replicated(df: DataFrame, plan: FragmentPlan, key: str | None = None) -> DataFrame:
    """``df`` with a copy of each row for each shard of its key; rows of light keys stay single."""
    joined = df.join(F.broadcast(plan.table), df[key or plan.key].eqNullSafe(F.col("__k")), "left")
    salts = F.coalesce(F.col("__salts"), F.array(F.lit(0)))
    return joined.select(*(df[c] for c in df.columns), F.explode(salts).alias(SALT))


def fragment_aggregate(
    df: DataFrame,
    key: str,
    partial: dict[str, Column],
    merge: dict[str, Column] | None = None,
    plan: FragmentPlan | None = None,
    spread: list[str] | None = None,
) -> DataFrame:
    """Per-key results from partial results of the shards.

    ``partial`` are aggregates of the rows of a shard, ``merge`` aggregates of their
    columns; by default partial results are summed. Spark aggregates before the
    exchange, then each shard, then the few shards of each key.
    """
    plan = plan or plan_fragments(df, key)
    of_shards = fragmented(df, plan, spread).groupBy(key, SALT).agg(*(c.alias(n) for n, c in partial.items()))
    merge = merge or {n: F.sum(n) for n in partial}
    return of_shards.groupBy(key).agg(*(c.alias(n) for n, c in merge.items()))


def fragment_replicate_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", plan: FragmentPlan | None = None, spread: list[str] | None = None
) -> DataFrame:
    """Join on ``key`` with the rows of ``left`` split and those of ``right`` copied to the shards.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``: each row of ``left`` is in
    one shard, so these hold as they do without shards. NULL keys match nothing.
    Columns of ``right`` that clash with ``left`` get the suffix ``_right``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a fragmented side cannot be joined by {how}")
    plan = plan or plan_fragments(left, key)
    clash = [c for c in right.columns if c != key and c in left.columns]
    for c in clash:
        right = right.withColumnRenamed(c, f"{c}_right")
    a = fragmented(left, plan, spread).repartition(plan.tasks, key, SALT)
    b = replicated(right, plan).repartition(plan.tasks, key, SALT)
    return a.join(b, [key, SALT], how).drop(SALT)


def usable_runs(meta: DataFrame) -> DataFrame:
    """One row a trajectory: ``traj_id``, project ``i0``, usable ``nframes`` and usable ``step_ps``.

    The row with the latest ``gathered_at`` counts for the numbers; the project is
    that of any row. Counts below zero and steps that are not positive and finite
    are NULL. Rows without ``traj_id`` are left out.
    """
    last = F.max(F.struct("gathered_at", "nframes", "step_ps"))
    rows = (
        meta.where(F.col("traj_id").isNotNull())
        .select("traj_id", F.upper(F.trim("i0")).alias("i0"), "gathered_at", "nframes", "step_ps")
        .groupBy("traj_id")
        .agg(F.max(F.when(F.col("i0") != "", F.col("i0"))).alias("i0"), last.alias("last"))
    )
    step = F.col("last.step_ps")
    return rows.select(
        "traj_id",
        "i0",
        F.when(F.col("last.nframes") >= 0, F.col("last.nframes").cast("long")).alias("nframes"),
        F.when((step > 0) & (step < float("inf")) & ~F.isnan(step), step).alias("step_ps"),
    )


def project_totals(meta: DataFrame) -> DataFrame:
    """Per project: trajectories ``n_traj``, frames ``nframes``, simulated time ``sim_ps`` and the share of all trajectories.

    Trajectories without a project count in the total of the share and have no
    row; a project without usable numbers has 0. An empty table gives no rows.
    """
    runs = materialize(usable_runs(meta))
    totals = fragment_aggregate(
        runs,
        "i0",
        {
            "n_traj": F.count(F.lit(1)),
            "nframes": F.coalesce(F.sum("nframes"), F.lit(0)),
            "sim_ps": F.coalesce(F.sum(F.col("nframes") * F.col("step_ps")), F.lit(0.0)),
        },
        spread=["traj_id"],
    )
    everything = totals.agg(F.sum("n_traj").alias("__all"))
    return (
        totals.crossJoin(F.broadcast(everything))  # one row
        .where(F.col("i0").isNotNull())
        .select("i0", "n_traj", "nframes", "sim_ps", (F.col("n_traj") / F.col("__all")).alias("share"))
    )


def trajectory_shares(meta: DataFrame) -> DataFrame:
    """Each trajectory that has a project and frames with its share of the frames of that project.

    The trajectories of a hot project are split, its totals copied to the shards.
    """
    runs = materialize(usable_runs(meta).where(F.col("i0").isNotNull() & (F.col("nframes") > 0)))
    plan = plan_fragments(runs, "i0")
    totals = fragment_aggregate(runs, "i0", {"total": F.sum("nframes")}, plan=plan, spread=["traj_id"])
    joined = fragment_replicate_join(runs, totals, "i0", plan=plan, spread=["traj_id"])
    return joined.select("traj_id", "i0", "nframes", (F.col("nframes") / F.col("total")).alias("share"))
