"""Transition counting on sequences small enough to count by hand."""

import math

import numpy as np
import pytest

from kinetrail.functions.linalg import ergodic_part, strong_components
from kinetrail.operators import counting
from kinetrail.plans.trajectories import Trajectories


def labels(spark, sequences, kind="bigint"):
    rows = [(i, j, x) for i, s in enumerate(sequences) for j, x in enumerate(s)]
    return Trajectories(spark.createDataFrame(rows, f"t bigint, f bigint, s {kind}"), "t", ("f",), "s")


def matrix(t, lag=1, sliding=True, cutoff="off"):
    return counting.count_matrix(t, lag, sliding, cutoff)


def test_ramp(spark):
    t = labels(spark, [range(10)])
    assert np.array_equal(matrix(t).counts, np.eye(10, k=1))
    assert np.array_equal(matrix(t, 2).counts, 0.5 * np.eye(10, k=2))
    assert matrix(t).mapping == {i: i for i in range(10)}
    assert np.allclose(matrix(labels(spark, [range(6)]), 3).counts, np.eye(6, k=3) / 3)


def test_strings_and_large_numbers(spark):
    m = matrix(labels(spark, [["alpha", "b", "b", "b", "c"]], "string"))
    assert m.labels == ["alpha", "b", "c"]
    assert np.array_equal(m.counts, [[0, 1, 0], [0, 2, 1], [0, 0, 0]])
    big = matrix(labels(spark, [[10**8, 10**8, 10**8 + 1, 10**8 + 1]]))
    assert np.array_equal(big.counts, [[1, 1], [0, 1]])


def test_missing_labels_drop_pairs_not_positions(spark):
    t = labels(spark, [[0.0, math.nan], [None]], "double")
    assert np.array_equal(matrix(t).counts, [[0]])
    assert matrix(labels(spark, [[math.nan]], "double")).counts.shape == (0, 0)
    # the pair over the gap is not made at lag 1, but is at lag 2
    gap = labels(spark, [[1, None, 2]])
    assert matrix(gap, 1).counts.sum() == 0
    assert matrix(gap, 2).counts.sum() == 0.5


def test_pairs_never_cross_trajectories(spark):
    assert matrix(labels(spark, [[0, 1], [2, 3]])).counts.sum() == 2


def test_strided_equals_every_third_frame(spark):
    a = matrix(labels(spark, [range(10)]), 3, sliding=False)
    b = matrix(labels(spark, [[0, 3, 6, 9]]))
    assert a.counts.sum() == 3 and b.counts.sum() == 3
    assert {(a.labels[i], a.labels[j]) for i, j in np.argwhere(a.counts)} == {(b.labels[i], b.labels[j]) for i, j in np.argwhere(b.counts)}


def test_many_lags_are_single_lags(spark):
    t = labels(spark, [[0, 1, 0, 2, 1, 1, 0, 2], [2, 1, 0]])
    many = {(r["lag"], r["src"], r["dst"]): r["n"] for r in counting.multilag_counts(t, [1, 2, 5]).collect()}
    for k in (1, 2, 5):
        one = {(k, r["src"], r["dst"]): r["n"] for r in counting.transition_counts(t, k).collect()}
        assert one == {x: n for x, n in many.items() if x[0] == k}


def test_trimming(spark):
    t = labels(spark, [[1] * 9 + [2]])
    assert matrix(labels(spark, [[1] * 9]), cutoff=0).counts.tolist() == [[8]]
    m = matrix(t, cutoff=1)
    assert m.labels == [1] and m.counts.tolist() == [[8]]


@pytest.mark.parametrize(
    "counts, kept, percent",
    [
        ([[1, 0, 0], [0, 1, 1], [0, 1, 1]], [1, 2], 80),
        ([[1, 1, 0], [0, 1, 1], [0, 1, 1]], [1, 2], 100 * 5 / 6),
        (np.eye(3, k=1), [], 50),
        (np.zeros((3, 3)), [], math.nan),
    ],
)
def test_strong_parts(counts, kept, percent):
    got, share = ergodic_part(np.array(counts, float), 1)
    assert got.tolist() == kept
    assert share == pytest.approx(percent, nan_ok=True)


def test_components_of_a_cycle_with_tail():
    a = np.zeros((5, 5), bool)
    a[[0, 1, 2, 2, 3], [1, 2, 0, 3, 4]] = True
    assert sorted(strong_components(a)) == [[0, 1, 2], [3], [4]]


def test_clip_and_fill(spark):
    t = labels(spark, [["a", "b", "c", "d"], ["a", "a", "x", "b", "b", "b"]], "string")
    mapping = {"a": 0, "b": 1, "c": 2}
    fill = sorted((r["traj_id"], r["frame"], r["idx"]) for r in counting.fill_labels(t, mapping).collect() if r["traj_id"] == 0)
    assert [x[2] for x in fill] == [0, 1, 2, None]
    clip = sorted((r["traj_id"], r["segment"], r["frame"], r["idx"]) for r in counting.clip_labels(t, mapping).collect())
    assert [(x[1], x[3]) for x in clip if x[0] == 1] == [(0, 0), (0, 0), (1, 1), (1, 1), (1, 1)]


def test_inverse_and_bad_index(spark):
    df = spark.createDataFrame([(0,), (2,), (None,)], "idx int")
    assert [r["label"] for r in counting.inverse_labels(df, "idx", ["a", "b", "c"]).collect()] == ["a", "c", None]
    with pytest.raises(Exception, match="no label"):
        counting.inverse_labels(spark.createDataFrame([(3,)], "idx int"), "idx", ["a"]).collect()


def test_lag_and_cutoff_rules(spark):
    with pytest.raises(ValueError):
        counting.transition_counts(labels(spark, [[1]]), 0)
    assert counting.ergodic_cutoff("on", 4, True) == 0.25 and counting.ergodic_cutoff("on", 4, False) == 1
    assert counting.ergodic_cutoff("off", 4, True) == 0 and counting.compose({1: 2, 3: 4}, {2: 9}) == {1: 9}


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "t bigint, f bigint, s bigint")
    assert counting.transition_counts(Trajectories(df, "t", ("f",), "s")).count() == 0
    odd = spark.createDataFrame([(1, 0, "a", 7, 8), (1, 1, "b", 7, 8)], "t bigint, f bigint, s string, src int, n int")
    assert counting.transition_counts(Trajectories(odd, "t", ("f",), "s")).count() == 1


def test_subsample(spark):
    got = counting.subsample(labels(spark, [range(7)]), 3, sliding=False).collect()
    assert sorted(r["frame"] for r in got) == [0, 3, 6]
