"""Similar vectors and similarity groups against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.llm import clusters, similar
from kinetrail.llm.vectors import matrix, squares, vector_set
from kinetrail.session import materialize

W = 6


def table(spark, x, ids=None, extra=()):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), [float(v) for v in a], "clash", 1.0) for i, a in zip(ids, x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id bigint, data array<float>, block string, d double").repartition(4)


def cloud(n=400, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.uniform(-40, 40, size=(12, W))
    x = c[rng.integers(0, 12, n)] + rng.normal(size=(n, W)) * 0.5
    x[-30:] = rng.uniform(-60, 60, size=(30, W))
    return x.round(3).astype(np.float32)


BAD = [(900, None, "x", 0.0), (901, [1.0], "x", 0.0), (902, [1.0] * (W - 1) + [float("nan")], "x", 0.0), (903, [float("inf")] * W, "x", 0.0), (904, [None] * W, "x", 0.0), (None, [0.0] * W, "x", 0.0)]


def exact(x, k):
    d = squares(x, x)
    np.fill_diagonal(d, np.inf)
    return [set(r) for r in np.argsort(d, axis=1, kind="stable")[:, :k].tolist()]


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(similar, "PER_CELL", 64)
    x = cloud(1500)
    got = similar.similar_vectors(table(spark, x, extra=BAD), "vec_id", "data", W, k=10)
    near: dict = {}
    for r in got.collect():
        near.setdefault(r["id"], set()).add(r["other"])
        assert r["distance"] == pytest.approx(float(np.linalg.norm(x[r["id"]].astype(float) - x[r["other"]])), rel=1e-5)
    assert set(near) == set(range(1500)) and all(len(v) == 10 for v in near.values())
    assert np.mean([len(near[i] & t) / 10 for i, t in enumerate(exact(x, 10))]) > 0.9


def test_close_pairs_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(similar, "PER_CELL", 50)
    monkeypatch.setattr(similar, "BLOCK", 40)
    x = cloud(600)
    x[560:590] = x[0] + np.random.default_rng(2).normal(size=(30, W)).astype(np.float32) * 0.02
    x[300:340] = x[:40] + np.random.default_rng(1).normal(size=(40, W)).astype(np.float32) * 0.05
    got = {(r[0], r[1]) for r in similar.close_pairs(table(spark, np.vstack([x, x]), list(range(600)) * 2), "vec_id", "data", W, 0.4).collect()}
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1))
    want = {(int(i), int(j)) for i, j in np.argwhere(d <= 0.4) if i < j}
    assert got == want and max((d <= 0.4).sum(1)) > 11


def test_many_copies_are_told_by_their_first(spark):
    x = np.vstack([np.zeros((30, W)), np.full((1, W), 0.1), np.full((3, W), 9.0)])
    got = sorted(tuple(r) for r in similar.close_pairs(table(spark, x), "vec_id", "data", W, 0.4).collect())
    assert got == sorted([(0, i) for i in range(1, 31)] + [(31, 32), (31, 33), (32, 33)])


def test_recall_of_isolated_vectors(spark, monkeypatch):
    """Queries are the ids divisible by 50, against all vectors, in more than 200 cells."""
    monkeypatch.setattr(similar, "PER_CELL", 180)
    df = spark.read.parquet("/root/testdata/sf0.1/featurized.parquet")
    got: dict = {}
    for r in similar.similar_vectors(df, "vec_id", "data", 24, every=50).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    rows = vector_set(df, "vec_id", "data", 24).distinct.toArrow()
    ids, x = rows["id"].to_numpy(), matrix(rows["vec"])
    assert len(x) / 180 > 200
    ask = np.flatnonzero(ids % 50 == 0)
    d = squares(x[ask], x)
    d[np.arange(len(ask)), ask] = np.inf
    near = np.argpartition(d, 10, axis=1)[:, :10]
    far = np.sqrt(np.take_along_axis(d, near, 1).max(1))
    hit = np.array([len(got[int(ids[i])] & set(ids[n].tolist())) / 10 for i, n in zip(ask, near)])
    assert hit.mean() > 0.95 and (far > 8).sum() > 50 and hit[far > 8].mean() > 0.9


def test_copies_are_searched_once(spark):
    x = np.vstack([np.zeros((40, W)), np.ones((1, W)), np.full((3, W), 5.0)])
    got: dict = {}
    for r in similar.similar_vectors(table(spark, x), "vec_id", "data", W, k=4).orderBy("id", "distance", "other").collect():
        got.setdefault(r["id"], []).append((r["other"], round(r["distance"], 4)))
    assert [o for o, d in got[0]] == [1, 2, 3, 4] and [o for o, d in got[3]] == [0, 1, 2, 4] and [o for o, d in got[39]] == [0, 1, 2, 3]
    assert [o for o, _ in got[40]] == [0, 1, 2, 3] and [o for o, _ in got[41]] == [42, 43, 40, 0] and len(got) == 44
    some = similar.similar_vectors(table(spark, x), "vec_id", "data", W, k=4, every=20).select("id").distinct().collect()
    assert {r["id"] for r in some} == {0, 20, 40}


def test_few_vectors(spark):
    assert similar.similar_vectors(table(spark, np.zeros((0, W)), extra=BAD), "vec_id", "data", W).count() == 0
    assert similar.similar_vectors(table(spark, np.ones((1, W))), "vec_id", "data", W).count() == 0
    assert similar.similar_vectors(table(spark, np.eye(3, W)), "vec_id", "data", W).count() == 6


def test_codes_get_better_with_the_beam():
    x = cloud(500)
    books = similar.fit_codebooks(x, 500)
    rest = x - books.coarse[similar.nearest(x, books.coarse)[0]]
    narrow, wide = (similar.beam_encode(rest, books.residual, b)[1] for b in (1, 8))
    assert (wide <= narrow + 1e-4).mean() > 0.8 and wide.mean() <= narrow.mean()
    codes, error = similar.beam_encode(rest, books.residual, 4)
    decoded = sum(b[codes[:, m]] for m, b in enumerate(books.residual))
    assert np.allclose(np.linalg.norm(rest - decoded, axis=1), error, atol=1e-3)


# --- groups ---


def brute_groups(x, distance, least):
    near = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1)) <= distance
    out = set()
    for i in range(len(x)):
        members = np.flatnonzero(near[i])
        if len(members) >= least and all((near[j] == near[i]).all() for j in members):
            out |= {(int(j), int(members[0])) for j in members}
    return out


@pytest.mark.parametrize("seed, distance", [(0, 8.0), (1, 3.0), (2, 2.0), (3, 20.0)])
def test_groups_equal_brute_force(spark, monkeypatch, seed, distance):
    monkeypatch.setattr(clusters, "PER_CELL", 60)
    monkeypatch.setattr(clusters, "BLOCK", 50)
    monkeypatch.setattr(clusters, "GRID_BLOCK", 60)
    monkeypatch.setattr(clusters, "COPY_COST", 1e-9)
    x = cloud(500, seed)
    # a chain that is no group, a group of seven, and two that touch in one vector
    x[:20] = 100 + np.arange(20)[:, None] * distance / 4
    x[20:27] = 300 + np.random.default_rng(seed).normal(size=(7, W)) * 0.01
    x[27:45] = 500 + np.random.default_rng(seed).normal(size=(18, W)) * 0.01
    x[44, 0] += distance
    g = clusters.similarity_groups(table(spark, x, extra=BAD), "vec_id", "data", W, distance)
    assert {(r["id"], r["cluster_id"]) for r in g.members.collect()} == brute_groups(x, distance, 8)


def test_copies_count_as_vectors(spark):
    x = np.vstack([np.zeros((9, W)), np.full((3, W), 50.0), np.full((5, W), -50.0), np.full((4, W), -50.5)])
    g = clusters.similarity_groups(table(spark, x), "vec_id", "data", W, 8.0)
    assert {(r["id"], r["cluster_id"]) for r in g.members.collect()} == {(i, 0) for i in range(9)} | {(i, 12) for i in range(12, 21)}
    profiles = {r["cluster_id"]: (r["size"], r["typical"]) for r in clusters.group_profiles(g, 2).collect()}
    assert profiles == {0: (9, [0, 1]), 12: (9, [12, 13])}
    outside = {r["id"] for r in clusters.all_frames(g).where("cluster_id is null").collect()}
    assert outside == {9, 10, 11}


def test_no_vectors_no_groups(spark):
    g = clusters.similarity_groups(table(spark, np.zeros((0, W)), extra=BAD), "vec_id", "data", W, 8.0)
    assert g.members.count() == 0 and clusters.all_frames(g).count() == 0


def test_hashed_features_bound_distances():
    f = clusters.HashedFeatures.make(24, places=8)
    x = np.random.default_rng(0).normal(size=(60, 24)).astype(np.float32)
    assert f(x).shape == (60, 8) and f.load > 1
    assert (squares(f(x), f(x)) <= f.load * squares(x, x) + 1e-3).all()
    heavy = clusters.HashedFeatures.make(W, [2.0] + [1.0] * (W - 1))
    assert np.abs(heavy(np.eye(W, dtype=np.float32))[0]).max() == 2
    with pytest.raises(ValueError):
        clusters.HashedFeatures.make(W, [1.0])


def test_parts_of_a_cell_save_comparisons():
    """Numbers, smallest ids and hashes are those of brute force, and a tight group is hardly compared."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(6000, 24)) * 0.5, 30 + rng.normal(size=(2000, 24)), rng.uniform(-20, 20, (200, 24))]).astype(np.float32)
    ids = rng.permutation(50_000)[: len(x)]
    held = clusters._Held(ids, x, np.zeros(len(x), np.float32), 8.0)
    got = {r[0]: r[1:4] for r in zip(*held.near(ids, x, np.zeros(len(x), np.float32), 8.0))}
    d = np.sqrt(squares(x[::40].astype(float), x.astype(float))) <= 8
    h = clusters.mixed(ids)
    for i, near in zip(ids[::40], d):
        assert got[i] == (near.sum(), ids[near].min(), np.bitwise_xor.reduce(h[near]).view(np.int64))
    assert held.compared < len(x) ** 2 / 20


def test_a_large_group_is_merged_from_its_balls(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 200)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(3000, W)) * 0.4, 50 + rng.normal(size=(20, W)) * 0.4])
    compared = []
    monkeypatch.setattr(clusters, "neighbourhoods", lambda items, *a, real=clusters.neighbourhoods: compared.append(items.count()) or real(items, *a))
    g = clusters.similarity_groups(table(spark, x), "vec_id", "data", W, 8.0)
    assert {(r["id"], r["cluster_id"]) for r in g.members.collect()} == {(i, 0) for i in range(3000)} | {(i, 3000) for i in range(3000, 3020)}
    assert compared[0] < 60 and compared[1] == 0


def test_rounds_over_the_grid_change_no_group(spark, monkeypatch):
    rng = np.random.default_rng(0)
    c = rng.normal(size=(60, W)) * 12
    x = np.concatenate([c[rng.integers(0, 60, 1000)] + rng.normal(size=(1000, W)) * 0.3, rng.normal(size=(1000, W)) * 12]).astype(np.float32)
    seen, real = [], clusters._rounds
    monkeypatch.setattr(clusters, "COPY_COST", 1e-12)
    monkeypatch.setattr(clusters, "LEAST_ROOM", 150_000)
    monkeypatch.setattr(clusters, "_rounds", lambda *a: seen.append(real(*a)) or seen[-1])
    g = clusters.similarity_groups(table(spark, x), "vec_id", "data", W, 6.0)
    found = {(r["id"], r["cluster_id"]) for r in g.members.collect()}
    assert found == brute_groups(x, 6.0, 8) and len(found) > 100
    assert max(by_cell for by_cell, _ in seen) > 1 and max(by_ask for _, by_ask in seen) > 1


def test_a_write_takes_its_shuffle_files_along(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    kept = materialize(spark.range(10_000).repartition(3, "id"))
    assert not files() - before
    assert kept.count() == 10_000


def test_seeding_covers_far_groups(spark):
    x = np.vstack([np.zeros((500, W)), np.full((5, W), 90.0), np.full((5, W), -90.0)]) + np.random.default_rng(0).normal(size=(510, W)) * 0.1
    df = table(spark, x).select(F.col("vec_id").alias("id"), F.col("data").alias("vec"))
    c = clusters.kmeans(df, clusters.HashedFeatures(np.eye(W, dtype=np.float32), 1), x[0], 3)
    assert sorted(np.round(c.mean(1)).tolist()) == [-90, 0, 90]
