"""Runs: hand-made labels, equality with brute force, and pieces that cross stretches."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinetrail.llm import runs


def brute_cost(x, penalty):
    """The cheapest segmentation by trying every start."""
    best = [-penalty]
    for t in range(1, len(x) + 1):
        best.append(min(best[s] + ((x[s:t] - x[s:t].mean()) ** 2).sum() + penalty for s in range(t)))
    return best[-1]


def test_segmentation_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(1, 25))
        x = rng.choice([0.0, 0.1, 0.2, 0.5, 1.0, 3.0], n) + rng.normal(size=n) * 0.02
        p = float(rng.choice([0.01, 0.1, 1.0]))
        w = rng.integers(1, 4, n).astype(float)
        parts = runs.optimal_segments(w, w * x, w * x * x, p)
        assert parts[0][0] == 0 and parts[-1][1] == n and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        full = np.repeat(x, w.astype(int))
        ends = np.cumsum(np.concatenate([[0], w])).astype(int)
        cost = sum(((full[ends[a] : ends[b]] - full[ends[a] : ends[b]].mean()) ** 2).sum() for a, b in parts) + p * (len(parts) - 1)
        assert cost == pytest.approx(brute_cost(full, p), abs=1e-8)


@pytest.mark.parametrize(
    "label, number",
    [("67", 67), ("１７７", 177), ("74.0000002", 74), ("s154", 154), ("S-097", 97), ("State_133", 133), ("state 2", 2), (" 59", 59), (" 8 ", 8), ("7.0000e+00", 7), ("1.4e+02", 140), ("+28", 28)]
    + [(x, None) for x in (None, "", " ", "nan", "None", "-5", "0", "s", "12x", "5.4.3")],
)
def test_labels(spark, label, number):
    got = spark.createDataFrame([(label,)], "l string").select(runs.label_number(F.col("l"))).first()[0]
    assert got is None if number is None else got == pytest.approx(number, abs=1e-5)


def frames(spark, rows):
    df = spark.createDataFrame([(t, f, l, h) for t, f, l, h in rows], "traj_id bigint, frame bigint, label string, h int")
    return df.withColumn("loaded_at", F.expr("timestamp_ntz'2030-01-01 00:00:00' + make_interval(0,0,0,0,h)")).withColumn("chunk", F.lit("clash"))


def steps(spark):
    return spark.sql("select 1L traj_id, cast(2.5 as double) step_ps, timestamp_ntz'2030-01-01 00:00:00' gathered_at union all select 2L, double('NaN'), timestamp_ntz'2030-01-01 00:00:00'")


def test_states_with_corrections_gaps_and_missing(spark):
    rows = [(1, 0, "5", 0), (1, 1, "s5", 0), (1, 2, "5.0000001", 0), (1, 3, "6", 0), (1, 3, "5", 2), (1, 5, "5", 0), (1, 6, "5", 0), (1, 7, "", 0), (1, 8, "5", 0)]
    rows += [(1, 0, "5", 0)] * 3 + [(2, 0, "1", 0), (2, 1, "2", None), (None, 1, "2", 0), (2, None, "2", 0), (2, 2, "2", 0)]
    got = {tuple(r) for r in runs.state_runs(frames(spark, rows), steps(spark)).collect()}
    assert got == {(1, 5, 0, 3, 4, 10.0), (1, 5, 5, 6, 2, 5.0), (1, 5, 8, 8, 1, 2.5), (2, 1, 0, 0, 1, None), (2, 2, 1, 2, 2, None)}


def test_states_come_through_the_segmentation(spark, monkeypatch):
    """Neighbouring states are told apart by cost alone, noise within 0.001 is not, and a stub shows."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.integers(3, 6, 40), rng.integers(1, 6, 40))
    rows = [(1, i, f"{v + e:.4f}", 0) for i, (v, e) in enumerate(zip(x, rng.uniform(-0.0009, 0.0009, len(x))))] + [(2, 0, "2", 0), (2, 1, "2.5", 0), (2, 2, "2", 0)]
    cuts = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)]
    want = {(1, int(x[a]), a, b - 1) for a, b in zip(cuts, cuts[1:])} | {(2, 2, 0, 0), (2, 2, 2, 2)}
    found = lambda: {tuple(r)[:4] for r in runs.state_runs(frames(spark, rows), steps(spark)).collect()}
    assert found() == want
    t = pa.table({"__e": [1] * 4, "chunk": [0] * 4, "first": [1, 2, 3, 4], "value": [3.0, 3.0, 4.0, 4.0]})
    real = runs._chunk_runs(t, 2e5, 0.001, 1.27, 100).num_rows
    monkeypatch.setattr(runs, "optimal_segments", lambda n, s, q, p: [(0, len(n))])
    assert real == 2 and runs._chunk_runs(t, 2e5, 0.001, 1.27, 100).num_rows == 1


def test_near_identical_events(spark):
    """A slow drift is one run by cost, though no two values are equal; a real step is a boundary."""
    x = np.concatenate([1 + 0.01 * np.sin(np.arange(50)), 1.3 + 0.01 * np.cos(np.arange(30)), [1.31, 1.0], 1 + 0.01 * np.sin(np.arange(9))])
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "e string, p bigint, v double")
    got = sorted((r["first"], r["last"], r["n"]) for r in runs.collapse_runs(df, "e", "p", "v", penalty=0.1).collect())
    assert got == [(0, 49, 50), (50, 80, 31), (81, 90, 10)]


def test_certain_boundaries_hold_in_any_surroundings():
    rng = np.random.default_rng(5)
    some = 0
    for _ in range(150):
        x = np.repeat(rng.choice([0.0, 0.7, 1.0, 2.0], 8), rng.integers(1, 5, 8))
        p = float(rng.choice([0.05, 0.2, 0.5]))
        sure = runs.certain_boundaries(np.ones(len(x)), x, x * x, p)
        some += len(sure)
        for _ in range(5):
            a, b = rng.choice([0.0, 0.7, 1.0, 2.0], int(rng.integers(0, 6))), rng.choice([0.0, 0.7, 1.0, 2.0], int(rng.integers(0, 6)))
            y = np.concatenate([a, x, b])
            starts = {c - len(a) for c, _ in runs.optimal_segments(np.ones(len(y)), y, y * y, p)}
            assert set(sure) <= starts
    assert some > 200


def test_nothing(spark):
    assert runs.state_runs(frames(spark, []), steps(spark)).count() == 0
    assert runs.state_runs(frames(spark, [(1, 0, None, 0), (1, 1, "", 0)]), steps(spark)).count() == 0


@pytest.mark.parametrize("wider", [2, 512])
def test_stretches_are_joined(spark, monkeypatch, wider):
    monkeypatch.setattr(runs, "WIDER", wider)
    rng = np.random.default_rng(1)
    x = np.repeat(rng.choice([1.0, 1.05, 1.1, 4.0], 60), rng.integers(1, 9, 60))
    at = np.delete(np.arange(len(x)), [20, 21, 90])
    df = spark.createDataFrame([("a", int(i), float(x[i])) for i in at], "e string, p bigint, v double")
    got = sorted((r["first"], r["last"], r["n"]) for r in runs.collapse_runs(df, "e", "p", "v", penalty=0.02, stretch=7).collect())
    want, pieces = [], np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    for piece in pieces:
        v = x[piece]
        for a, b in runs.optimal_segments(np.ones(len(v)), v, v * v, 0.02):
            want.append((piece[a], piece[b - 1], b - a))
    cost = lambda parts: sum(((x[[i for i in at if a <= i <= b]] - x[[i for i in at if a <= i <= b]].mean()) ** 2).sum() for a, b, _ in parts) + 0.02 * len(parts)
    assert cost(got) == pytest.approx(cost(want)) and sum(n for *_, n in got) == len(at)


def test_hot_entity_is_many_groups(spark):
    df = spark.range(200_000).select(F.lit(1).alias("e"), F.col("id").alias("p"), F.lit(3.0).alias("v"))
    got = runs.collapse_runs(df, "e", "p", "v").collect()
    assert [(r["first"], r["last"], r["n"]) for r in got] == [(0, 199_999, 200_000)]
