"""Markov models, path theory, lumping and rate matrices: identities and closed forms."""

import numpy as np
import pytest

from kinetrail.functions import divergence, linalg
from kinetrail.operators import bayes, lumping, msm, ratematrix, tpt
from kinetrail.operators.counting import CountMatrix
from kinetrail.plans.trajectories import Trajectories

FIVE = np.array([[5, 0, 3, 3, 7], [9, 3, 5, 2, 4], [7, 6, 8, 8, 1], [6, 7, 7, 8, 1], [5, 9, 8, 9, 4]], float)


def fit(counts, **kw):
    return msm.MarkovStateModel(**kw).fit_counts(CountMatrix(np.asarray(counts, float), list(range(len(counts)))))


def test_reversible_estimate():
    t, pi = linalg.reversible_mle(FIVE)
    assert np.allclose(pi, [0.23663723, 0.17598011, 0.23528227, 0.22273036, 0.12937003], atol=1e-6)
    flow = pi[:, None] * t
    assert np.allclose(flow, flow.T, atol=1e-8) and np.allclose(t.sum(1), 1)


def test_reversible_estimate_with_zeros():
    for c in ([[5, 0, 3], [0, 2, 4], [3, 5, 1]], [[0, 2, 3], [4, 5, 1], [2, 1, 0]]):
        t, pi = linalg.reversible_mle(np.array(c, float))
        assert np.allclose(pi[:, None] * t, (pi[:, None] * t).T, atol=1e-8)
    assert np.allclose(linalg.reversible_mle(np.array([[0.0, 1], [1, 0]]))[0], [[0, 1], [1, 0]])
    for bad in (np.zeros((3, 3)), -np.ones((3, 3))):
        with pytest.raises(ValueError):
            linalg.reversible_mle(bad)


@pytest.mark.parametrize("kind", ["mle", "transpose", "none"])
def test_modes_are_biorthonormal(kind):
    m = fit(FIVE, reversible_type=kind)
    assert np.allclose(m.left_eigenvectors_.T @ m.right_eigenvectors_, np.eye(5), atol=1e-8)
    assert m.left_eigenvectors_[:, 0].sum() == pytest.approx(1)
    assert np.real(m.eigenvalues_[0]) == pytest.approx(1)
    assert np.allclose(m.populations_ @ m.transmat_, m.populations_, atol=1e-7)


def test_score_on_own_data_is_the_sum_of_eigenvalues():
    m = fit(FIVE, n_timescales=2)
    assert m.score_counts(CountMatrix(FIVE, list(range(5)))) == pytest.approx(m.score_, abs=1e-6)


def test_likelihood_and_unseen_labels(spark):
    rows = lambda s: Trajectories(spark.createDataFrame([(0, i, x) for i, x in enumerate(s)], "t int, f int, s string"), "t", ("f",), "s")
    m = msm.MarkovStateModel(reversible_type="mle").fit(rows("aabbaabb"))
    a, b = m.mapping_["a"], m.mapping_["b"]
    assert m.score_ll(rows("abb")) == pytest.approx(np.log(m.transmat_[a, b]) + np.log(m.transmat_[b, b]))
    assert not np.isfinite(m.score_ll(rows("abc")))
    assert len(m.sample_discrete("a", 50, 1)) == 50
    drawn = m.draw_samples(rows("aabbaabb"), 7).collect()
    assert len(drawn) == 14 and {(r["idx"], "aabbaabb"[r["frame"]]) for r in drawn} == {(a, "a"), (b, "b")}
    assert m.eigtransform(rows("abcx"), mode="fill").where("modes is null").count() == 2
    assert "states: 2" in m.summarize() and len(m.uncertainty_timescales()) == 1


def test_sweep_and_timescales_share_counts(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, j, int(x)) for i in range(5) for j, x in enumerate(rng.integers(0, 4, 200))], "t int, f int, s int")
    t = Trajectories(df, "t", ("f",), "s")
    for m in msm.param_sweep(t, {"lag_time": [1, 5], "sliding_window": [True, False]}):
        assert np.allclose(m.transmat_, m.clone().fit(t).transmat_)
    table = msm.implied_timescales(t, [1, 2], 2).collect()
    assert {r["lag"] for r in table} == {1, 2}
    b = msm.BootStrapMarkovStateModel(6).fit(t)
    assert b.all_populations_.shape == (6, 4) and np.nanmax(np.abs(b.all_populations_.sum(1) - 1)) < 1e-6


def test_delta_method_against_draws():
    c = np.array([[4380, 153, 15], [211, 4788, 1], [15, 3, 3000]], float) + 1 / 3
    m = fit(c, reversible_type="none", ergodic_cutoff="off")
    rng = np.random.default_rng(1)
    drawn = np.array([np.sort(np.linalg.eigvals(np.array([rng.dirichlet(r) for r in c])).real)[::-1] for _ in range(2000)])
    assert np.allclose(m.uncertainty_eigenvalues()[1:], drawn.std(axis=0)[1:], rtol=0.15)


def test_chains_agree_with_the_estimate(spark):
    c = np.array([[100, 10, 2], [12, 126, 13], [5, 20, 120]], float)
    t, _ = linalg.reversible_mle(c)
    drawn = bayes.reversible_chain(c, 400, 30, 3, 2000)
    assert np.abs(drawn.mean(0) - t).max() < 0.03
    flow = linalg.stationary(drawn[5])[:, None] * drawn[5]
    assert np.allclose(flow, flow.T, atol=1e-8)
    df = spark.createDataFrame([(i, j, (i + j * j) % 3) for i in range(4) for j in range(60)], "t int, f int, s int")
    m = bayes.BayesianMarkovStateModel(n_samples=10, n_chains=2).fit(Trajectories(df, "t", ("f",), "s"))
    assert m.all_transmats_.shape[0] == 10 and np.allclose(m.all_transmats_.sum(2), 1)
    assert tpt.committors(0, 2, m).shape == (m.n_states_,) and 0 <= tpt.fraction_visited(0, 2, 1, m) <= 1


# --- path theory ---


class Model:
    def __init__(self, t):
        self.transmat_ = np.asarray(t, float)
        self.n_states_ = len(self.transmat_)
        self.populations_ = linalg.stationary(self.transmat_)
        self.countsmat_ = 1000 * self.populations_[:, None] * self.transmat_


def test_two_state_passage_times():
    m = Model([[0.9, 0.1], [0.22, 0.78]])
    assert np.allclose(tpt.mfpts(m), [[0, 10], [1 / 0.22, 0]])
    assert np.allclose(tpt.mfpts(m, 1, lag_time=3), [30, 0])
    mean, sd = tpt.mfpts(m, 1, errors=True)
    assert sd[0] > 0


def test_all_passage_times_agree_with_each_sink():
    m = Model(linalg.reversible_mle(FIVE)[0])
    whole = tpt.mfpts(m)
    for k in range(5):
        assert np.allclose(whole[:, k], tpt.mfpts(m, k))


def test_paths_of_a_small_graph():
    net = np.zeros((6, 6))
    for i, j, f in [(0, 2, 0.5), (0, 1, 0.5), (2, 4, 0.5), (1, 3, 0.3), (1, 5, 0.2), (3, 5, 0.3)]:
        net[i, j] = f
    found, sizes = tpt.paths(0, [4, 5], net)
    assert found == [[0, 2, 4], [0, 1, 3, 5], [0, 1, 5]] and np.allclose(sizes, [0.5, 0.3, 0.2])
    assert tpt.top_path(0, [4, 5], net)[0] == [0, 2, 4]
    assert tpt.top_path(0, 4, np.zeros((6, 6))) == ([], 0.0)


def test_hub_of_a_star_and_conditions():
    star = np.zeros((5, 5))
    star[2, [0, 1, 3, 4]] = 0.25
    star[[0, 1, 3, 4], 2] = star[[0, 1, 3, 4], [0, 1, 3, 4]] = 0.5
    m = Model(star)
    assert tpt.hub_scores(m, 2)[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        tpt.conditional_committors(0, 0, 1, m)
    q = tpt.committors(0, 4, m)
    assert q[0] == 0 and q[4] == 1 and np.all((q >= 0) & (q <= 1))
    f = tpt.fluxes(0, 4, m)
    assert f[0].sum() == pytest.approx(f[:, 4].sum())


# --- lumping ---


def blocks():
    rng = np.random.default_rng(0)
    s = np.concatenate([rng.choice([0, 1], 250), rng.choice([2, 3], 250), rng.choice([0, 1], 250), rng.choice([2, 3], 250)])
    c = np.zeros((4, 4))
    np.add.at(c, (s[:-1], s[1:]), 1)
    return c


@pytest.mark.parametrize("kind", [lumping.PCCA, lumping.PCCAPlus, lumping.MVCA, lumping.BACE])
def test_two_metastable_blocks(kind):
    m = kind(2).fit_counts(CountMatrix(blocks(), list("abcd"))).microstate_mapping_
    assert m[0] == m[1] != m[2] == m[3]
    again = kind.from_msm(fit(blocks()), 2).microstate_mapping_
    assert again[0] == again[1] != again[2] == again[3]


def test_lumping_of_none_and_memberships():
    assert len(set(lumping.BACE(4).fit_counts(CountMatrix(blocks(), list("abcd"))).microstate_mapping_)) == 4
    for goal in ("crispness", "metastability", "crisp_metastability"):
        c = np.kron(np.eye(3), np.full((3, 3), 200.0)) + np.random.default_rng(0).integers(1, 4, (9, 9))
        m = lumping.PCCAPlus(3, objective_function=goal).fit_counts(CountMatrix(c, list(range(9))))
        assert np.allclose(m.chi_.sum(1), 1) and m.chi_.min() > -1e-6 and len(set(m.microstate_mapping_)) == 3


# --- rate matrices ---


def test_gradient_of_the_rate_likelihood():
    rng = np.random.default_rng(0)
    c, theta = rng.integers(1, 50, (4, 4)).astype(float), rng.random(10)
    _, g = ratematrix.log_likelihood(theta, c, 2.0)
    e = np.eye(10) * 1e-6
    num = [(ratematrix.log_likelihood(theta + d, c, 2.0)[0] - ratematrix.log_likelihood(theta - d, c, 2.0)[0]) / 2e-6 for d in e]
    assert np.allclose(g, num, atol=1e-4)


@pytest.mark.parametrize("prior, arg", [(ratematrix.exponential_prior, 0.7), (ratematrix.dirichlet_prior, 1.5)])
def test_gradients_of_priors(prior, arg):
    x = np.array([0.3, 0.8, 1.1])
    num = [(prior(x + d, arg)[0] - prior(x - d, arg)[0]) / 2e-6 for d in np.eye(3) * 1e-6]
    assert np.allclose(prior(x, arg)[1], num, atol=1e-5)


def test_rate_matrix_reaches_the_reversible_estimate():
    rng = np.random.default_rng(3)
    c = rng.integers(1, 40, (4, 4)) + np.diag([200.0] * 4)
    m = ratematrix.ContinuousTimeMSM().fit_counts(CountMatrix(c, list("abcd")))
    assert np.allclose(m.transmat_, linalg.reversible_mle(c)[0], atol=1e-4)
    assert np.allclose(m.ratemat_.sum(1), 0, atol=1e-9) and (m.timescales_ > 0).all() and (m.uncertainty_timescales() > 0).all()
    b = ratematrix.BayesianContinuousTimeMSM(n_samples=60).fit_counts(CountMatrix(c, list("abcd")))
    assert b.acceptance_ > 0.5 and np.allclose(b.all_timescales_.mean(0), m.timescales_, rtol=0.2)


def _sampled(counts, **kw):
    return ratematrix.BayesianContinuousTimeMSM(**kw).fit_counts(CountMatrix(np.asarray(counts, float), list(range(len(counts)))))


@pytest.mark.parametrize("times", [1, 60])
def test_sampled_rates_of_states_without_memory(times):
    # the counts of the events of sf0.1, whose rates are large and one of them zero, as often as in larger tables
    c = times * np.array([[3800, 3932, 3977, 4036, 3815], [3887, 3860, 3988, 3864, 3917], [3955, 3899, 3898, 3932, 4083], [4022, 3931, 4025, 4094, 3947], [3900, 3871, 3902, 4057, 3908]])
    b = _sampled(c, n_samples=50)
    assert np.isfinite(b.all_timescales_).all() and (b.all_timescales_ > 0).all() and b.acceptance_ > 0.5
    pi = c.sum(1) / c.sum()
    assert np.allclose(b.all_populations_.std(0), np.sqrt(pi * (1 - pi) / c.sum()), rtol=0.5)


def test_sampled_rates_spread_as_the_errors_say():
    c = 1000 * (np.array([[5, 9, 3], [9, 2, 7], [3, 7, 4]]) + np.diag([200, 300, 100]))
    b = _sampled(c, n_samples=200)
    m = ratematrix.ContinuousTimeMSM().fit_counts(CountMatrix(c.astype(float), list("abc")))
    assert np.allclose(b.all_timescales_.mean(0), m.timescales_, rtol=0.02)
    assert np.allclose(b.all_timescales_.std(0), m.uncertainty_timescales(), rtol=0.3)


def test_rates_beyond_all_numbers_have_no_likelihood():
    for theta in ([800.0, 0, 0], [1e308, 0, 0], [np.inf, 0, 0], [1.0, 800, 0]):
        value, slope = ratematrix.log_likelihood(np.array(theta), np.ones((2, 2)), 1.0)
        assert not np.isnan(value) and np.isfinite(slope).all()


def test_divergences():
    p, q = np.array([[0.5, 0.5, 0.0]]), np.array([[0.25, 0.25, 0.5]])
    assert divergence.kl_divergence(p, p)[0] == 0
    assert divergence.js_divergence(p, q)[0] == pytest.approx(divergence.js_divergence(q, p)[0])
    assert divergence.js_metric(p, q)[0] ** 2 == pytest.approx(divergence.js_divergence(p, q)[0])
    assert divergence.of_matrices(divergence.kl_divergence, np.ones(4) / 2, np.ones(4) / 2).tolist() == [0, 0]
