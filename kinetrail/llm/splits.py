"""Splits that keep related records together: components, then a search that swaps whole components.

Components are found on the graph of topologies, not of records: records reach
their component over their file and its topology. The assignment starts from the
hash of each component; annealing then moves and exchanges whole components until
the sizes of the splits, and of every stratum in them, deviate little from the
shares. Large components, a bounded number, are searched together by parallel
chains, the best of which is kept; the small ones are searched in buckets of
neighbouring strata on all tasks, each against its part of what the large ones left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.functions.paths import project_path, topology_path
from kinetrail.session import drop, materialize

#: Components of more than this part of all rows are searched together: at most 20,000.
LARGE = 1 / 20_000
#: Part of all rows below which the rows of a large component in one stratum are pooled in the search, so that the driver holds at most a million numbers.
POOLED = 1e-6
#: Weight of the deviation of all rows against that of the strata together.
WHOLE = 8.0
#: How often a component is tried, and tries of all components together where there are few.
SWEEPS, TRIES = 8, 15_000
#: Small components of a bucket on the average.
BUCKET = 2048
#: Strata up to which their targets are broadcast.
SMALL_TABLE = 100_000


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component``, the smallest node of its component, for each node of ``edges``.

    Alternates two steps until nothing changes: each node links its greater
    neighbours to its smallest one, then itself and its smaller neighbours. The
    number of rounds grows with the logarithm of the longest path. Edges stay
    distributed and are written once a round; the least neighbour of a node is
    aggregated before the shuffle. Edges with a NULL end are left out, loops and
    repeated edges do no harm, an empty table gives no rows.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = materialize(links.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    now = materialize(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    known = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        step = materialize(small.select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
        state = step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        now = step
        if state == known:
            break
        known = state
    return nodes.join(now, nodes.node == now.u, "left").select("node", F.coalesce("v", "node").alias("component"))


def file_topologies(meta: DataFrame) -> DataFrame:
    """``file`` and each ``topology`` that a row of meta gives for it: ``top_fn``, else ``top_abs_fn``."""
    known = F.coalesce(topology_path(F.col("top_fn")), topology_path(F.col("top_abs_fn")))
    return (
        meta.select(project_path(F.col("traj_fn")).alias("file"), known.alias("topology"))
        .where(F.col("file").isNotNull() & (F.col("topology") != ""))
        .distinct()
    )


def topology_components(topologies: DataFrame, files: DataFrame) -> DataFrame:
    """``topology``, ``component`` and ``group_id``, the smallest ``top_id`` of the component or NULL.

    Topologies are related by descent, over parents that are not registered too,
    and by standing for one file.
    """
    own = topologies.select("top_id", topology_path(F.col("top_fn")).alias("topology"), topology_path(F.col("derived_from")).alias("parent"))
    own = own.where(F.col("topology").isNotNull() & (F.col("topology") != ""))
    descent = own.select(F.col("topology").alias("u"), F.coalesce(F.when(F.col("parent") != "", F.col("parent")), F.col("topology")).alias("v"))
    least = files.groupBy("file").agg(F.min("topology").alias("m"))
    shared = files.join(least, "file").select(F.col("topology").alias("u"), F.col("m").alias("v")).distinct()
    of = connected_components(descent.unionByName(shared), "u", "v").withColumnRenamed("node", "topology")
    ids = of.join(own, "topology").groupBy("component").agg(F.min("top_id").alias("group_id"))
    return of.join(ids, "component", "left").select("topology", "component", "group_id")


def related_frames(featurized: DataFrame, meta: DataFrame, topologies: DataFrame) -> DataFrame:
    """Each ``vec_id`` once with its ``file``, its ``component`` and its ``group_id``.

    A frame without file is a component of its own, a file without known topology
    one with its frames. Rows without ``vec_id`` are left out.
    """
    files = materialize(file_topologies(meta))
    groups = topology_components(topologies, files)
    of_file = (
        files.join(groups, "topology").groupBy("file").agg(F.min("component").alias("c"), F.min("group_id").alias("group_id"))
    )
    frames = (
        featurized.where(F.col("vec_id").isNotNull())
        .select("vec_id", project_path(F.col("fns")).alias("file"))
        .groupBy("vec_id")
        .agg(F.max("file").alias("file"))
    )
    name = F.coalesce(
        F.concat(F.lit("t:"), "c"), F.concat(F.lit("f:"), "file"), F.concat(F.lit("v:"), F.col("vec_id").cast("string"))
    )
    return frames.join(of_file, "file", "left").select("vec_id", "file", name.alias("component"), "group_id")


@dataclass(frozen=True)
class Units:
    """Components with their rows by stratum, sparse: ``at`` and ``n`` of unit ``i`` from ``first[i]`` on. ``want`` is what each split is to hold: split x stratum."""

    key: np.ndarray
    first: np.ndarray
    at: np.ndarray
    n: np.ndarray
    want: np.ndarray

    @classmethod
    def of(cls, names: list, strata: np.ndarray, n: np.ndarray, want: np.ndarray) -> Units:
        """From one entry a component and stratum; entries of one component follow one another."""
        names = np.asarray(names)
        first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.zeros(0, int)
        key = np.array([xxhash.xxh64_intdigest(str(x)) for x in names[first]], np.uint64)
        return cls(key, np.append(first, len(names)), strata.astype(np.int64), n.astype(float), want)

    def hashed(self, salt: int) -> np.ndarray:
        """Numbers in [0, 1) that depend on a component alone."""
        with np.errstate(over="ignore"):
            z = self.key ^ np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)

    def start(self, shares: np.ndarray, seed: int) -> np.ndarray:
        """The split of each component by its hash."""
        return np.searchsorted(np.cumsum(shares)[:-1], self.hashed(seed), side="right")

    def sizes(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(self.want.shape)
        np.add.at(out, (np.repeat(at, np.diff(self.first)), self.at), self.n)
        return out

    def deviation(self, at: np.ndarray) -> float:
        """Absolute deviation from what is wanted: of each stratum, and ``WHOLE`` times that of all rows."""
        off = self.sizes(at) - self.want
        return float(WHOLE * np.abs(off.sum(1)).sum() + np.abs(off).sum())


def anneal(units: Units, shares: np.ndarray, seed: int, chain: int, sweeps: int | None = None) -> tuple[float, np.ndarray]:
    """One chain from the hashed start: move a component or exchange two, accept what costs less, or more by a falling chance; the best state seen.

    The order of tries and their chances are hashes of the components, so that the same
    components are tried alike whatever others there are. Each is tried ``sweeps`` times,
    by default at least ``SWEEPS`` and more often where there are few.
    """
    k, count = len(shares), len(units.key)
    sweeps = sweeps or int(np.clip(TRIES // max(count, 1), SWEEPS, 20 * SWEEPS))
    at = units.start(shares, seed)
    off = units.sizes(at) - units.want
    whole = off.sum(1)
    cost = float(WHOLE * np.abs(whole).sum() + np.abs(off).sum())
    best, kept = cost, at.copy()
    if not count or k < 2:
        return best, kept
    heat = max(cost, 1e-9) / count * 2
    parts = [(units.at[a:b], units.n[a:b]) for a, b in zip(units.first[:-1], units.first[1:])]
    for sweep in range(sweeps):
        salt = (seed * 64 + chain) * 65536 + sweep * 4
        order = np.argsort(units.hashed(salt), kind="stable").tolist()
        luck, other, pair = units.hashed(salt + 1), units.hashed(salt + 2), units.hashed(salt + 3)
        for place, i in enumerate(order):
            a = int(at[i])
            j = order[place - 1] if pair[i] < 0.5 and place else -1
            b = int(at[j]) if j >= 0 else (a + 1 + int(other[i] * (k - 1))) % k
            if a == b:
                continue
            s, n = parts[i]
            if j >= 0:  # what i takes from a to b and j from b to a
                s, n = np.concatenate([s, parts[j][0]]), np.concatenate([n, -parts[j][1]])
                s, where = np.unique(s, return_inverse=True)
                n = np.bincount(where, weights=n)
            total = n.sum()
            x, y = off[a, s], off[b, s]
            change = float((np.abs(x - n) - np.abs(x) + np.abs(y + n) - np.abs(y)).sum())
            change += WHOLE * (abs(whole[a] - total) - abs(whole[a]) + abs(whole[b] + total) - abs(whole[b]))
            if change <= 0 or luck[i] < math.exp(-change / heat):
                off[a, s] = x - n
                off[b, s] = y + n
                whole[a] -= total
                whole[b] += total
                cost += change
                at[i] = b
                if j >= 0:
                    at[j] = a
                if cost < best - 1e-9:
                    best, kept = cost, at.copy()
        heat *= 0.5 ** (12 / sweeps)
    return best, kept


def grouped_split(
    rows: DataFrame,
    group: str,
    stratum: Column,
    shares: dict[str, float],
    seed: int = 0,
    chains: int = 4,
    sweeps: int | None = None,
) -> DataFrame:
    """``rows`` with their ``split``; all rows of one ``group`` get the same.

    Components above a twenty-thousandth of all rows are searched together on ``chains``
    tasks, the others in buckets by the stratum that most of their rows have; whole
    components all, and every stratum counts. A column ``split`` of ``rows`` is replaced.
    A NULL group is one group; an empty table stays empty.
    """
    spark = rows.sparkSession
    names, portion = list(shares), np.array(list(shares.values()), float)
    portion /= portion.sum()
    rows = rows.drop("split")
    name = F.coalesce(F.col(group).cast("string"), F.lit(""))
    sizes = materialize(rows.select(name.alias("g"), F.coalesce(stratum, F.lit("")).alias("s")).groupBy("g", "s").agg(F.count(F.lit(1)).alias("n")))
    groups = sizes.groupBy("g").agg(F.sum("n").alias("n"), F.max_by("s", F.struct("n", "s")).alias("main"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = F.broadcast(groups.where(F.col("n") > total * LARGE).select("g"))  # at most 1 / LARGE
    least = F.col("n") >= total * POOLED
    entries = sizes.join(large, "g").groupBy("g", F.when(least, F.col("s")).alias("s")).agg(F.sum("n").alias("n")).orderBy("g", "s").toArrow()
    # without large components their number is none and nothing is left behind
    code = {s: i for i, s in enumerate(sorted({s for s in entries["s"].to_pylist() if s is not None}))}
    at = np.array([code.get(s, len(code)) for s in entries["s"].to_pylist()], int)
    n = entries["n"].to_numpy().astype(float)
    local = np.bincount(at, weights=n, minlength=len(code) + 1)
    units = Units.of(entries["g"].to_pylist(), at, n, portion[:, None] * local[None, :])
    chosen = _best_chain(spark, units, portion, seed, chains, sweeps)
    of_unit = np.array([e for e in entries["g"].to_pylist()], object)[units.first[:-1]] if len(units.key) else []
    heavy = spark.createDataFrame([(g, names[c]) for g, c in zip(of_unit, chosen)], "g string, split string")
    light = _light_splits(sizes, groups.where(F.col("n") <= total * LARGE), heavy, names, portion, seed, sweeps)
    # large components are a bounded table and go by broadcast, so that none is a hot key; small ones are none
    named = rows.withColumn("__g", name).join(F.broadcast(heavy.withColumnsRenamed({"g": "__g", "split": "__a"})), "__g", "left")
    light = light.withColumnsRenamed({"g": "__g", "split": "__b"})
    small = named.where(F.col("__a").isNull()).join(light, "__g").withColumn("split", F.col("__b")).drop("__g", "__a", "__b")
    return named.where(F.col("__a").isNotNull()).withColumn("split", F.col("__a")).drop("__g", "__a").unionByName(small)


def _best_chain(spark: SparkSession, units: Units, shares: np.ndarray, seed: int, chains: int, sweeps: int | None) -> np.ndarray:
    if not len(units.key):
        return np.zeros(0, np.int8)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0).to_pylist():
                cost, at = anneal(units, shares, seed, c, sweeps)
                yield pa.RecordBatch.from_pydict({"cost": pa.array([cost]), "chain": pa.array([c]), "at": pa.array([at.astype(np.int8).tobytes()])})

    best = spark.range(0, chains, 1, chains).mapInArrow(chain, "cost double, chain bigint, at binary").orderBy("cost", "chain").first()
    return np.frombuffer(bytes(best["at"]), np.int8)


def _light_splits(sizes: DataFrame, groups: DataFrame, heavy: DataFrame, names: list[str], portion: np.ndarray, seed: int, sweeps: int | None) -> DataFrame:
    """``g`` and ``split`` of the small components, searched in buckets against what the large ones leave of each stratum."""
    k = len(names)
    held = sizes.join(F.broadcast(heavy), "g", "left")
    left = [F.sum(F.col("n")) * float(p) - F.coalesce(F.sum(F.when(F.col("split") == x, F.col("n"))), F.lit(0)) for x, p in zip(names, portion)]
    strata = held.groupBy("s").agg(F.array(*left).alias("want"), F.sum(F.when(F.col("split").isNull(), F.col("n"))).alias("rest")).where(F.col("rest") > 0)
    buckets = groups.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("salts"))
    placed = groups.join(buckets, "main").select("g", "main", F.pmod(F.xxhash64("g", F.lit("bucket")), F.col("salts")).alias("salt"))
    strata = materialize(strata)
    if strata.count() <= SMALL_TABLE:
        strata = F.broadcast(strata)
    entries = sizes.join(placed, "g").join(strata, "s").select("main", "salt", "g", "s", "n", (F.col("n") / F.col("rest")).alias("part"), "want")

    def search(pdf):
        pdf = pdf.sort_values(["g", "s"])
        codes, at = np.unique(pdf["s"].to_numpy(str), return_inverse=True)
        want = np.zeros((k, len(codes)))
        # this bucket's part of what is left of each stratum
        np.add.at(want.T, at, np.stack(pdf["want"].to_list()) * pdf["part"].to_numpy()[:, None])
        units = Units.of(pdf["g"].tolist(), at, pdf["n"].to_numpy(), want)
        chosen = anneal(units, portion, seed, 0, sweeps)[1]
        return pd.DataFrame({"g": pdf["g"].to_numpy()[units.first[:-1]], "split": [names[c] for c in chosen]})

    return materialize(entries.groupBy("main", "salt").applyInPandas(search, "g string, split string"))


def frame_splits(featurized: DataFrame, meta: DataFrame, topologies: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """Each ``vec_id`` with its ``split``, 80 / 10 / 10 by default, stratified by project, and its ``group_id``.

    ``group_id`` is the smallest ``top_id`` related to the topology of the frame, NULL where none is known or registered.
    """
    related = materialize(related_frames(featurized, meta, topologies))
    project = F.regexp_extract(F.coalesce("file", F.lit("")), r"^([^/]*)", 1)
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    return grouped_split(related, "component", project, shares).select("vec_id", "split", "group_id")


def frame_groups(splits: DataFrame) -> DataFrame:
    """Of :func:`frame_splits` each ``vec_id`` whose file has a known topology, with the group that stands in its split whole."""
    return splits.where(F.col("group_id").isNotNull() & F.col("split").isNotNull()).select("vec_id", "group_id")
