"""Scalers, filters, clusterers, projections, hidden Markov models, featurizers and sampling."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetrail.functions import distances, geometry
from kinetrail.operators import apm, cluster, decomposition, featurizers, hmm, preprocessing, sampling
from kinetrail.plans.trajectories import Trajectories


def frame_table(spark, arrays):
    rows = [(i, j, [float(v) for v in x]) for i, a in enumerate(arrays) for j, x in enumerate(np.asarray(a).reshape(len(a), -1))]
    return spark.createDataFrame(rows, "traj_id bigint, frame bigint, features array<double>")


def trajectories(spark, arrays):
    return Trajectories(frame_table(spark, arrays), "traj_id", ("frame",), None, "features")


def values(df, *order):
    return np.array([r["features"] for r in df.orderBy(*(order or ("traj_id", "frame"))).collect()], float)


@pytest.fixture(scope="module")
def normals():
    return [np.random.default_rng(42 + i).normal(size=(100, 3)) for i in range(3)]


# --- preprocessing ---


def test_scalers_equal_their_definitions(spark, normals):
    df, x = frame_table(spark, normals), np.concatenate(normals)
    q = np.percentile(x, [25, 50, 75], axis=0)
    wanted = {
        preprocessing.StandardScaler: (x - x.mean(0)) / x.std(0),
        preprocessing.MinMaxScaler: (x - x.min(0)) / np.ptp(x, axis=0),
        preprocessing.MaxAbsScaler: x / np.abs(x).max(0),
        preprocessing.RobustScaler: (x - q[1]) / (q[2] - q[0]),
    }
    for kind, y in wanted.items():
        assert np.allclose(values(kind().fit_transform(df)), y), kind
    parts = preprocessing.StandardScaler().fit(frame_table(spark, normals[:1])).partial_fit(frame_table(spark, normals[1:]))
    assert np.allclose(parts.var_, x.var(0))
    flat = preprocessing.StandardScaler().fit_transform(frame_table(spark, [np.ones((4, 2))]))
    assert np.allclose(values(flat), 0)


def test_other_transformers(spark):
    df = frame_table(spark, [[[1.0, -2.0], [0.0, 0.0], [3.0, 4.0]]])
    assert np.allclose(values(preprocessing.Normalizer("l2").transform(df))[2], [0.6, 0.8])
    assert np.allclose(values(preprocessing.Normalizer("max").transform(df))[0], [0.5, -1])
    assert values(preprocessing.Binarizer(0.5).transform(df)).tolist() == [[1, 0], [0, 0], [1, 1]]
    assert preprocessing.PolynomialFeatures(2).fit(df).powers_ == [(), (0,), (1,), (0, 0), (0, 1), (1, 1)]
    assert np.allclose(values(preprocessing.FunctionTransformer(lambda x: x * 2).transform(df))[2], [6, 8])
    holes = spark.createDataFrame([(0, 0, [1.0, None]), (0, 1, [float("nan"), 4.0]), (0, 2, [3.0, 4.0])], "traj_id int, frame int, features array<double>")
    assert values(preprocessing.Imputer().fit(holes).transform(holes)).tolist() == [[1, 4], [2, 4], [3, 4]]
    assert preprocessing.VarianceThreshold(0.1).fit(frame_table(spark, [[[1, 1], [1, 2]]])).support_.tolist() == [1]
    sets = spark.createDataFrame([(["a", "c"],), (["b"],)], "l array<string>")
    m = preprocessing.MultiLabelBinarizer().fit(sets, "l").transform(sets, "l")
    assert [r["features"] for r in m.collect()] == [[1, 0, 1], [0, 1, 0]]
    with pytest.raises(ValueError):
        preprocessing.StandardScaler().fit(df.limit(0))


def test_filters_along_trajectories(spark):
    x = np.cumsum(np.random.default_rng(0).normal(size=(60, 2)), axis=0)
    t = trajectories(spark, [x, x[:7]])
    got = values(preprocessing.ewma(t, span=4).where("traj_id = 0"))
    assert np.allclose(got, pd.DataFrame(x).ewm(span=4).mean())
    both = values(preprocessing.double_ewma(t, span=4).where("traj_id = 0"))
    back = pd.DataFrame(x[::-1]).ewm(span=4).mean().to_numpy()
    assert np.allclose(both, (got + back[::-1]) / 2)
    assert np.allclose(values(preprocessing.double_ewma(t, span=4, literal_order=True).where("traj_id = 0")), (got + back) / 2)
    b, a = preprocessing.butterworth_coefficients(3, 0.4)
    response = lambda w: np.polyval(b[::-1], np.exp(-1j * w)) / np.polyval(a[::-1], np.exp(-1j * w))
    assert abs(response(0)) == pytest.approx(1) and abs(response(0.4 * np.pi)) == pytest.approx(2**-0.5)
    flat = trajectories(spark, [np.full((20, 1), 3.0)])
    assert np.allclose(values(preprocessing.butterworth(flat, 4)), 3.0)


# --- distances and clusters ---


def test_expressions_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 5)).round(1), rng.normal(size=5).round(1)
    df = frame_table(spark, [x])
    for m in distances.METRICS:
        got = [r["d"] for r in df.orderBy("frame").select(distances.distance(F.col("features"), preprocessing.literal(y), m).alias("d")).collect()]
        assert np.allclose(got, distances.pairwise(x, y[None], m)[:, 0]), m
    zero = frame_table(spark, [np.zeros((1, 5))]).select(distances.distance(F.col("features"), preprocessing.literal(np.zeros(5)), "jaccard").alias("d")).first()
    assert zero["d"] is None


def test_grid(spark):
    df = frame_table(spark, [[[-3], [-2], [-1], [1], [2], [3]]])
    g = cluster.NDGrid(2).fit(df)
    assert [r["label"] for r in g.predict(df).orderBy("frame").collect()] == [0, 0, 0, 1, 1, 1]
    two = frame_table(spark, [[[0, 0], [1, 0], [0, 1], [1, 1]]])
    assert [r["label"] for r in cluster.NDGrid(2, 0, 1).fit(two).predict(two).orderBy("frame").collect()] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="outside"):
        g.predict(frame_table(spark, [[[9.0]]])).collect()


def test_k_centres(spark):
    x = np.repeat([[0.0, 0.0], [1.0, 1.0], [0.5, 0.5]], 10, axis=0)
    df = frame_table(spark, [x]).withColumn("label", F.lit("own"))
    k = cluster.KCenters(2, key="frame", first=0).fit(df)
    d = {round(r["distance"], 6) for r in k.predict(df).collect()}
    assert d == {0.0, round(0.5**0.5, 6)} and k.cluster_ids_ == [0, 10]
    assert len(cluster.KCenters(9, key="frame").fit(df).cluster_centers_) == 3


@pytest.mark.parametrize(
    "kind",
    [
        lambda: cluster.KMedoids(2, 3), lambda: cluster.MiniBatchKMedoids(2, 5, 30), lambda: cluster.LandmarkAgglomerative(2, 50, "ward"),
        lambda: cluster.LandmarkAgglomerative(2, 50, "average"), lambda: cluster.KMeans(2), lambda: cluster.MiniBatchKMeans(2, 30, 5),
        lambda: cluster.AgglomerativeClustering(2), lambda: cluster.SpectralClustering(2, 0.5), lambda: cluster.MeanShift(2.0), lambda: cluster.AffinityPropagation(preference=-200.0),
        lambda: cluster.GMM(2),
    ],
)
def test_two_clouds(spark, kind):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(30, 2)) * 0.3, rng.normal(size=(30, 2)) * 0.3 + 6])
    df = frame_table(spark, [x])
    rows = kind().fit(df).predict(df).orderBy("frame").collect()
    labels = [r["label"] for r in rows]
    assert len(set(labels[:30])) == 1 and len(set(labels[30:])) == 1 and labels[0] != labels[30]


@pytest.mark.parametrize("kind", [cluster.AgglomerativeClustering, cluster.SpectralClustering, cluster.AffinityPropagation, cluster.MeanShift, cluster.KMedoids])
def test_clusters_are_those_of_all_rows(spark, kind):
    # more rows than any sample used to have
    x = np.random.default_rng(3).normal(size=(2100, 2))
    df = frame_table(spark, [x])
    args = {cluster.AffinityPropagation: {"max_iter": 2}, cluster.MeanShift: {"bandwidth": 1.0, "max_iter": 3}}.get(kind, {"n_clusters": 3})
    model = kind(**args).fit(df)
    if kind is not cluster.KMedoids:
        assert len(model.sample_) == 2100
        own = dict(zip(map(tuple, model.sample_), model.labels_))
        rows = model.predict(df).collect()
        assert all(own[tuple(r["features"])] == r["label"] for r in rows)
        return
    labels = distances.pairwise(x, model.cluster_centers_).argmin(axis=1)
    for k, c in enumerate(model.cluster_centers_):
        mine = x[labels == k]
        assert distances.pairwise(mine, c[None]).sum() == pytest.approx(distances.pairwise(mine, mine).sum(axis=0).min())


@pytest.mark.parametrize("kind", [cluster.MiniBatchKMedoids, cluster.MiniBatchKMeans])
def test_mini_batches_cover_all_rows(spark, kind, monkeypatch):
    # copies of one row are most of the table
    x = np.concatenate([np.zeros((800, 2)), np.random.default_rng(0).normal(size=(190, 2)), np.full((10, 2), 1000.0)])
    seen, rounds = [], cluster._medoid_rounds
    monkeypatch.setattr(cluster, "_medoid_rounds", lambda pool, m, *a: (seen.append(pool[len(m) :]), rounds(pool, m, *a))[1])
    df = frame_table(spark, [x])
    passes = cluster._Passes(df, "features", 30, 0)
    for p in range(2):
        got = [b for b in passes.batches(p)]
        assert [len(b) for b in got] == [30] * 33 + [10]
        assert sorted(map(tuple, np.concatenate(got))) == sorted(map(tuple, x))
        assert max((b == 0).all(axis=1).sum() for b in got) < 30
    one = kind(1, max_iter=1, batch_size=30).fit(df)
    assert one.n_rows_ == 1000
    if kind is cluster.MiniBatchKMeans:  # one centre is the mean of what it was given
        assert np.allclose(one.cluster_centers_, x.mean(axis=0))
    else:
        assert sorted(map(tuple, np.concatenate(seen))) == sorted(map(tuple, x))
    more = kind(2, max_iter=4, batch_size=30, max_no_improvement=10**9).fit(df)
    assert more.n_rows_ == 4000
    assert 1000 <= kind(2, max_iter=4, batch_size=30, max_no_improvement=1).fit(df).n_rows_ < 4000


@pytest.mark.parametrize("method", ["single", "complete", "average", "ward"])
def test_linkage_merges_the_nearest_each_time(method):
    from kinetrail.functions.linalg import linkage

    x = np.random.default_rng(5).integers(0, 6, size=(40, 2)).astype(float)  # with ties
    d = distances.pairwise(x, x)
    groups, tree = {i: [i] for i in range(40)}, linkage(d, method)
    for step, (a, b, h, n) in enumerate(tree):
        def gap(p, q):
            e = d[np.ix_(p, q)]
            if method == "ward":
                return np.sqrt(2 * len(p) * len(q) / (len(p) + len(q)) * ((x[p].mean(0) - x[q].mean(0)) ** 2).sum())
            return {"single": e.min, "complete": e.max, "average": e.mean}[method]()

        assert h == pytest.approx(min(gap(groups[p], groups[q]) for p in groups for q in groups if p < q))
        assert h == pytest.approx(gap(groups[int(a)], groups[int(b)]))
        groups[40 + step] = groups.pop(int(a)) + groups.pop(int(b))
        assert n == len(groups[40 + step])


def test_leaders(spark):
    x = np.random.default_rng(0).uniform(size=(200, 2))
    df = frame_table(spark, [x])
    for parts in (1, 4):
        r = cluster.RegularSpatial(0.3, order=["traj_id", "frame"], partitions=parts).fit(df)
        d = distances.pairwise(r.cluster_centers_, r.cluster_centers_) + 9 * np.eye(len(r.cluster_centers_))
        assert d.min() > 0.3 and r.predict(df).agg(F.max("distance")).first()[0] <= 0.3
    leaders, _ = cluster._lead(x, np.zeros((0, 0)), 0.3, "euclidean")
    assert np.allclose(cluster.RegularSpatial(0.3, order=["traj_id", "frame"], partitions=1).fit(df).cluster_centers_, leaders)


def test_nearest_frames_and_pairs(spark):
    df = frame_table(spark, [np.random.default_rng(0).normal(size=(20, 2)) * 0.1, np.random.default_rng(1).normal(size=(20, 2)) * 0.1 + 10])
    rows = cluster.NearestFrames(df, ["traj_id", "frame"]).query([[0, 0], [10, 10]], 3).collect()
    assert len(rows) == 6 and all(r["traj_id"] == r["query"] and r["distance"] < 0.5 for r in rows)
    one = df.where("traj_id = 0").withColumnRenamed("frame", "id")
    assert cluster.pdist(one, "id").count() == 190
    with pytest.raises(ValueError):
        cluster.cdist(one, one, "id", most=5)


def test_partitioning_of_a_metastable_line(spark):
    rng = np.random.default_rng(0)
    well = np.repeat(rng.integers(0, 2, 12), 40)
    x = well[:, None] * 5.0 + rng.normal(size=(480, 1)) * 0.3
    model = apm.APM(2, max_iter=2).fit(trajectories(spark, [x]))
    got = [r["label"] for r in model.predict(frame_table(spark, [x])).orderBy("frame").collect()]
    same = np.mean([a == b for a, b in zip(got, well)])
    assert max(same, 1 - same) > 0.95


def test_partitioning_splits_until_states_relax(spark):
    # wells of a line: frames stay where they are unless the states are far more than four a macrostate
    x = np.repeat(np.arange(20.0), 3)[np.random.default_rng(0).permutation(60)].repeat(2)[:, None]
    model = apm.APM(2, max_iter=3).fit(trajectories(spark, [x]))
    assert model.rounds_[0]["states"] > 8 and len(model.rounds_) == 3
    later = [s for s in model.rounds_[1:]]
    assert all(r["states"] > 8 for r in later)
    # within a macrostate of the last round, centres serve only its frames
    one = apm.Stage(np.array([[0.0], [10.0], [1.0]]), np.array([0, 0, 1]), "euclidean")
    assert one.near(np.array([[1.0], [1.0]]), np.array([0, 1]))[0].tolist() == [0, 2]
    # a small cap is kept
    assert apm.APM(2, max_iter=1, max_states=5).fit(trajectories(spark, [x])).rounds_[0]["states"] == 5
    # frames that leave at once are not split further
    fast = np.tile([0.0, 5.0], 40)[:, None]
    done = apm.APM(2, max_iter=1).fit(trajectories(spark, [fast])).rounds_[0]
    assert done["states"] == 2 and done["relaxed"]


# --- projections ---


def plain_tica(arrays, lag):
    a = np.concatenate([x[:-lag] for x in arrays if len(x) > lag])
    b = np.concatenate([x[lag:] for x in arrays if len(x) > lag])
    m = (a.sum(0) + b.sum(0)) / (2 * len(a))
    c = (a.T @ b + b.T @ a) / (2 * len(a)) - np.outer(m, m)
    s = (a.T @ a + b.T @ b) / (2 * len(a)) - np.outer(m, m)
    return c, s


def test_tica(spark):
    rng = np.random.default_rng(0)
    arrays = [np.cumsum(rng.normal(size=(n, 4)), axis=0) * 0.1 + rng.normal(size=(n, 4)) for n in (80, 50, 2)]
    t = trajectories(spark, arrays)
    m = decomposition.tICA(lag_time=3, shrinkage=0.0).fit(t)
    c, s = plain_tica(arrays, 3)
    assert np.allclose(m.offset_correlation_, c) and np.allclose(m.covariance_, s)
    w = np.sort(np.linalg.eigvals(np.linalg.solve(s, c)).real)[::-1]
    assert np.allclose(m.eigenvalues_, w) and m.score_ == pytest.approx(m.score(t))
    small = decomposition.tICA(2, 3, 0.0).fit(t)
    assert np.allclose(small.eigenvectors_, m.eigenvectors_[:, :2])
    kinetic = decomposition.tICA(2, 3, 0.0, kinetic_mapping=True).fit(t)
    assert np.allclose(values(kinetic.transform(t.df)), values(small.transform(t.df)) * small.eigenvalues_)
    again = decomposition.tICA(lag_time=3, shrinkage=0.0).fit(trajectories(spark, arrays[:1])).partial_fit(trajectories(spark, arrays[1:]))
    assert np.allclose(again.covariance_, m.covariance_)
    with pytest.raises(ValueError):
        decomposition.tICA(kinetic_mapping=True, commute_mapping=True)
    with pytest.raises(ValueError):
        decomposition.tICA(lag_time=200).fit(t)
    assert 0 < decomposition.tICA(lag_time=1).fit(t).covariance_[0, 0] and 0 <= decomposition.rao_blackwell_shrinkage(s, 100) <= 1


def test_sparse_and_kernel_tica(spark):
    rng = np.random.default_rng(0)
    slow = np.repeat(rng.normal(size=(20, 1)), 20, axis=0)
    x = np.concatenate([slow + 0.1 * rng.normal(size=(400, 1)), rng.normal(size=(400, 4))], 1)
    t = trajectories(spark, [x])
    for m in (decomposition.SparseTICA(1, 1, rho=0.05), decomposition.KSparseTICA(1, 1, k=1, kinetic_mapping=False)):
        v = m.fit(t).components_[0]
        assert np.flatnonzero(np.abs(v) > 1e-6).tolist() == [0]
    plain = decomposition.SparseTICA(2, 1, rho=0.0).fit(t).eigenvalues_
    assert np.allclose(plain, decomposition.tICA(2, 1).fit(t).eigenvalues_)
    line = decomposition.KernelTICA(1, 1, kernel="linear", shrinkage=1e-3, landmarks=x[:40]).fit(t)
    assert line.eigenvalues_[0] == pytest.approx(decomposition.tICA(1, 1, shrinkage=1e-3).fit(t).eigenvalues_[0], abs=0.05)


def test_kernel_landmarks_are_strided_frames_and_their_partners(spark):
    a, b = np.arange(10.0)[:, None], 100 + np.arange(7.0)[:, None]
    t = trajectories(spark, [a, b])
    for lag, stride in ((1, 1), (2, 5), (3, 4), (8, 3)):
        want = []
        for x in (a, b):
            u = np.arange(len(x))[lag::stride]
            v = np.arange(len(x))[::stride][: len(u)]
            want += x[np.union1d(u, v)].ravel().tolist()
        m = decomposition.KernelTICA(1, lag, stride=stride, max_landmarks=None)
        assert m._landmarks(t).ravel().tolist() == want
    assert len(decomposition.KernelTICA(1, 2, stride=5, max_landmarks=3)._landmarks(t)) == 3


def test_kernel_queries_use_the_operators_landmarks(spark, small, monkeypatch):
    from kinetrail.plans.queries import QUERIES

    used, made = [], decomposition.LandmarkNystroem.__init__
    monkeypatch.setattr(decomposition.LandmarkNystroem, "__init__", lambda self, marks, *a, **k: (used.append(len(marks)), made(self, marks, *a, **k))[1])
    QUERIES["kernel_tica_transform"](spark, small)
    QUERIES["kernel_pca_transform"](spark, small)
    assert used == [500, 200]


def test_components(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4)) @ np.diag([3, 2, 1, 0.1]) + 5
    df = frame_table(spark, [x])
    p = decomposition.PCA(2).fit(df)
    w = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(p.explained_variance_, w[:2]) and np.allclose(values(p.transform(df)).mean(0), 0, atol=1e-9)
    assert (np.abs(decomposition.SparsePCA(1, 0.3).fit(df).components_[0]) > 1e-6).sum() == 1
    loads = rng.normal(size=(1, 5))
    y = rng.normal(size=(2000, 1)) @ loads + 0.1 * rng.normal(size=(2000, 5))
    f = decomposition.FactorAnalysis(1).fit(frame_table(spark, [y]))
    assert abs(np.corrcoef(f.loadings_[0], loads[0])[0, 1]) > 0.999
    s = rng.uniform(-1, 1, size=(2000, 2))
    ica = decomposition.FastICA(2).fit(frame_table(spark, [s @ [[1, 0.5], [0.3, 1]]]))
    out = values(ica.transform(frame_table(spark, [s @ [[1, 0.5], [0.3, 1]]])))
    assert np.sort(np.abs(np.corrcoef(out.T, s.T)[:2, 2:]).max(1)).min() > 0.98
    assert len(decomposition.KernelPCA(2, 50).fit(df).explained_variance_) == 2


# --- hidden Markov models ---


def chain(t, n, rng):
    s = [0]
    for _ in range(n - 1):
        s.append(rng.choice(len(t), p=t[s[-1]]))
    return np.array(s)


def test_gaussian_states(spark):
    rng, t = np.random.default_rng(0), np.array([[0.7, 0.3], [0.4, 0.6]])
    paths = [chain(t, 600, rng) for _ in range(6)]
    arrays = [rng.normal(size=(600, 1)) + 5.0 * p[:, None] for p in paths]
    view = trajectories(spark, arrays)
    m = hmm.GaussianHMM(2, n_init=1, n_iter=12).fit(view)
    order = np.argsort(m.means_[:, 0])
    assert np.allclose(m.means_[order, 0], [0, 5], atol=0.15) and np.allclose(m.transmat_[np.ix_(order, order)], t, atol=0.06)
    assert m.fit_logprob_[-1] >= m.fit_logprob_[0] and m.score(view) == pytest.approx(m.fit_logprob_[-1], abs=5)
    got = np.array([r["state"] for r in m.predict(view).orderBy("traj_id", "frame").collect()])
    assert np.mean(order.argsort()[got] == np.concatenate(paths)) > 0.97
    assert {r["state"] for r in m.draw_centroids(view).collect()} == {0, 1}
    for scheme in ("even", "maxent"):
        assert m.draw_samples(view, 3, scheme).count() == 6
    assert len(m.timescales_) == 1


def test_forward_backward_is_the_sum_over_paths():
    rng = np.random.default_rng(0)
    log_b, t = rng.normal(size=(4, 2)), np.array([[0.8, 0.2], [0.3, 0.7]])
    total = []
    for code in range(16):
        p = [code >> i & 1 for i in range(4)]
        total.append(np.log(0.5) + log_b[np.arange(4), p].sum() + sum(np.log(t[a, b]) for a, b in zip(p, p[1:])))
    ll, post, pairs = hmm.forward_backward(log_b, np.log(t))
    assert ll == pytest.approx(np.log(np.exp(total).sum())) and pairs.sum() == pytest.approx(3) and np.allclose(post.sum(1), 1)
    assert hmm.viterbi(log_b, np.log(t))[0] == pytest.approx(max(total))


def test_many_trajectories_at_once():
    rng, t = np.random.default_rng(0), np.log(np.array([[0.8, 0.2], [0.3, 0.7]]))
    parts = [rng.normal(size=(n, 2)) for n in (5, 1, 9, 5)]
    ll, posts, pairs = hmm.forward_backward_many(parts, t)
    single = [hmm.forward_backward(p, t) for p in parts]
    assert ll == pytest.approx(sum(s[0] for s in single)) and np.allclose(pairs, sum(s[2] for s in single))
    assert all(np.allclose(a, s[1]) for a, s in zip(posts, single))
    rows = pd.DataFrame({"traj_id": [1, 1, 2, 3, 3, 3], "features": [[float(i)] for i in range(6)]})
    got = [len(x) for xs in hmm.whole_trajectories(iter([rows.iloc[:1], rows.iloc[1:4], rows.iloc[4:]]), 2) for x in xs]
    assert got == [2, 1, 3]


def test_circular_states(spark):
    rng, t = np.random.default_rng(0), np.array([[0.9, 0.1], [0.1, 0.9]])
    arrays = [rng.vonmises(np.where(chain(t, 500, rng) == 0, 3.0, 0.2), 8.0)[:, None] for _ in range(4)]
    m = hmm.VonMisesHMM(2, n_init=1, n_iter=10).fit(trajectories(spark, arrays))
    order = np.argsort(np.abs(m.means_[:, 0]))
    assert np.allclose(m.means_[order, 0], [0.2, 3.0], atol=0.1) and np.allclose(m.kappas_[order, 0], 8, rtol=0.2)
    k = np.array([1e-3, 0.5, 3.0, 40.0, 600.0])
    assert np.allclose(hmm.inverse_bessel_ratio(hmm.bessel_ratio(k)), k, rtol=1e-6)
    grid = np.linspace(0, 2 * np.pi, 4001)[:-1]
    assert np.allclose(hmm.log_i0(np.array([2.0, 30.0])), [np.log(np.exp(c * np.cos(grid)).mean()) for c in (2.0, 30.0)])
    assert m.overlap_[0, 1] < m.overlap_[0, 0]


def test_weights_of_largest_entropy():
    x = np.random.default_rng(0).normal(size=(500, 1))
    p = hmm.maxent_weights(x, np.array([0.5]), np.array([0.8]))
    assert p @ x[:, 0] == pytest.approx(0.5, abs=0.02)
    with pytest.raises(hmm.NotSatisfiableError):
        hmm.maxent_weights(x, np.array([50.0]), None)


# --- featurizers ---


def alanines(n):
    """A chain of residues with three backbone atoms, a side-chain carbon and a ligand of one atom at its end."""
    atoms = tuple(featurizers.Atom(a, a[0], r) for r in range(n) for a in ("N", "CA", "C", "CB"))
    atoms += (featurizers.Atom("C1", "C", n, "LIG", 1),)
    bonds = tuple((4 * r + i, 4 * r + j) for r in range(n) for i, j in ((0, 1), (1, 2), (1, 3)))
    return featurizers.Topology(atoms, bonds + tuple((4 * r + 2, 4 * r + 4) for r in range(n - 1)))


def test_geometry_of_known_points():
    x = np.array([[[0, 0, 0], [1, 0, 0], [1, 1, 0], [1, 1, 1]]], float)
    assert geometry.angles(x, [[0, 1, 2]])[0, 0] == pytest.approx(np.pi / 2)
    assert abs(geometry.dihedrals(x, [[0, 1, 2, 3]])[0, 0]) == pytest.approx(np.pi / 2)
    assert geometry.distances(x, [[0, 3]], np.array([1.5, 1.5, 1.5]))[0, 0] == pytest.approx(0.75**0.5)
    turn, _ = np.linalg.qr(np.random.default_rng(0).normal(size=(3, 3)))
    turn *= np.sign(np.linalg.det(turn))
    assert distances.kabsch_rmsd(x @ turn + 2, x[0])[0] == pytest.approx(0, abs=1e-6)
    assert np.allclose(distances.superpose(x @ turn + 2, x[0]), x)
    one = geometry.surface_areas(np.zeros((1, 1, 3)), [0.17])
    assert one[0, 0] == pytest.approx(4 * np.pi * 0.31**2)


def test_featurizers_have_their_widths(spark):
    top, rng = alanines(6), np.random.default_rng(0)
    x = rng.normal(size=(3, 25, 3))
    f = featurizers
    widths = {
        f.DihedralFeaturizer(top): 20, f.DihedralFeaturizer(top, ["phi"], False): 5, f.VonMisesFeaturizer(top, ["psi"], 6): 30,
        f.AlphaAngleFeaturizer(top): 6, f.KappaAngleFeaturizer(top): 2, f.AngleFeaturizer([[0, 1, 2]]): 1, f.SASAFeaturizer(top, points=50): 7,
        f.ContactFeaturizer(top): 6, f.ContactFeaturizer(top, [(0, 5)], "ca", soft_min=True): 1, f.BinaryContactFeaturizer(top, cutoff=1.0): 6, f.LogisticContactFeaturizer(top): 6,
        f.GaussianSolventFeaturizer([0, 1], [8, 9, 10], 0.3): 2, f.RawPositionsFeaturizer([0, 1], x[0]): 6, f.DRIDFeaturizer(top, [1, 5]): 6,
        f.SuperposeFeaturizer([0, 1, 2], x[0]): 3, f.RMSDFeaturizer(x[:2]): 2, f.LandMarkRMSDFeaturizer(x[:2], sigma=0.5): 2, f.AtomPairsFeaturizer([(0, 1), (2, 5)]): 2,
        f.LigandContactFeaturizer(top): 6, f.BinaryLigandContactFeaturizer(top): 6, f.LigandRMSDFeaturizer(top, x[0]): 1,
        f.CommonContactFeaturizer({"a": "AAAAAA", "b": "AAAA-A"}, "a", top): 4, f.subset_cos_psi(top, [0]): 1, f.subset_sin_phi(top): 5,
        f.FeatureSelector([("phi", f.DihedralFeaturizer(top, "phi")), ("pair", f.AtomPairsFeaturizer([(0, 1)]))]): 11,
        f.FeatureSlicer(f.DihedralFeaturizer(top), [0, 2]): 2, f.subset_atom_pairs([(0, 1), (1, 2)], [1]): 1,
    }
    for g, w in widths.items():
        out = np.asarray(g.compute(x)).reshape(3, -1)
        assert out.shape == (3, w) and np.isfinite(out).all(), type(g).__name__
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "i int, xyz array<array<double>>")
    got = [r["features"] for r in f.DihedralFeaturizer(top).transform(df).orderBy("i").collect()]
    assert np.allclose(got, f.DihedralFeaturizer(top).compute(x))
    pairs = f.AtomPairsFeaturizer([(0, 1), (2, 5)], exponent=2)
    assert np.allclose([r["f"] for r in df.orderBy("i").select(pairs.expression().alias("f")).collect()], pairs.compute(x))
    s = [r["features"] for r in f.Slicer(first=2).transform(f.DihedralFeaturizer(top).transform(df)).collect()]
    assert all(len(v) == 2 for v in s)
    with pytest.raises(ValueError):
        f.FeatureSelector([("a", pairs)], "b")
    with pytest.raises(TypeError):
        f.FeatureSelector({"a": pairs})
    assert len(f.atompair_indices(top, {"CA"})) == 15 and len(f.DihedralFeaturizer(top).describe()) == 20
    atoms = spark.range(4).withColumnRenamed("id", "idx")
    assert f.atompair_table(atoms, spark.createDataFrame([(1, 0)], "i int, j int")).count() == 5


# --- sampling ---


def test_sampling(spark):
    t = trajectories(spark, [np.arange(50)[:, None], np.arange(50, 100)[:, None]])
    line = [r["value"] for r in sampling.sample_dimension(t, 0, 5).orderBy("value").collect()]
    assert np.allclose(line, [0, 25, 50, 74, 99], atol=1)
    assert sampling.sample_dimension(t, 0, 4, "edges").count() == 4 and sampling.sample_dimension(t, 0, 4, "random").count() == 4
    rows = sampling.sample_states(t, np.array([[10.2], [70.0]]), 2).collect()
    assert {(r["query"], r["traj_id"], r["frame"]) for r in rows if r["rank"] == 0} == {(0, 0, 10), (1, 1, 20)}
    p = spark.createDataFrame([(0, 0.25), (1, 0.75)], "idx int, p double")
    drawn = sampling.categorical(spark.range(4000), p, F.col("id"))
    assert drawn.where("idx = 1").count() / 4000 == pytest.approx(0.75, abs=0.03)
    got = sampling.map_drawn_samples(spark.createDataFrame([(0, 3), (0, 3)], "traj_id bigint, frame bigint"), t.df)
    assert got.count() == 2
