"""Continuous-time Markov models: a reversible rate matrix by maximum likelihood or Hamiltonian sampling.

Parameters are the upper triangle of a symmetric matrix ``s >= 0`` and the
logarithms of the populations up to a constant; the rate from i to j is
``s_ij * sqrt(pi_j / pi_i)``, so detailed balance holds by construction.
"""

from __future__ import annotations

import numpy as np

from kinetrail.functions.linalg import minimize_bfgs
from kinetrail.operators import counting
from kinetrail.operators.msm import StateModel
from kinetrail.plans.trajectories import Trajectories


def unpack(theta: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric rates with their diagonal, and populations."""
    upper = np.triu_indices(n, 1)
    s = np.zeros((n, n))
    s[upper] = theta[: len(upper[0])]
    s += s.T
    log_pi = theta[len(upper[0]) :]
    pi = np.exp(log_pi - log_pi.max())
    pi /= pi.sum()
    root = np.sqrt(pi)
    np.fill_diagonal(s, -(s @ root) / root)
    return s, pi


def rate_matrix(theta: np.ndarray, n: int) -> np.ndarray:
    s, pi = unpack(theta, n)
    root = np.sqrt(pi)
    return s * root[None, :] / root[:, None]


def log_likelihood(theta: np.ndarray, counts: np.ndarray, lag: float) -> tuple[float, np.ndarray]:
    """Log-likelihood of counts at a lag, and its gradient through the spectrum of the symmetric matrix.

    Parameters whose rates leave the range of the numbers have no likelihood: minus infinity, without slope.
    """
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        value, slope = _log_likelihood(theta, counts, lag)
    return (value, slope) if np.isfinite(value) and np.isfinite(slope).all() else (-np.inf, np.zeros(len(theta)))


def _log_likelihood(theta: np.ndarray, counts: np.ndarray, lag: float) -> tuple[float, np.ndarray]:
    n = len(counts)
    s, pi = unpack(theta, n)
    root = np.sqrt(pi)
    if not np.isfinite(s).all():
        return -np.inf, np.zeros(len(theta))
    w, v = np.linalg.eigh(s)
    e = np.exp(lag * w)
    sym = (v * e) @ v.T
    t = np.maximum(sym * root[None, :] / root[:, None], 1e-300)
    value = float((counts * np.log(t))[counts > 0].sum())
    ratio = np.where(counts > 0, counts / t, 0.0)
    # d value / d exp(lag s): carry the scaling by populations over
    m = ratio * root[None, :] / root[:, None]
    d = w[:, None] - w[None, :]
    kernel = np.where(np.abs(d) > 1e-10, (e[:, None] - e[None, :]) / d, lag * (e[:, None] + e[None, :]) / 2)
    g = v @ (kernel * (v.T @ m @ v)) @ v.T  # d value / d s, entries taken as free
    upper = np.triu_indices(n, 1)
    # an entry off the diagonal changes both diagonals
    r = root[None, :] / root[:, None]
    diag = np.diag(g)
    ds = g + g.T - diag[:, None] * r - diag[None, :] * r.T
    # populations: by the scaling of t, and by the diagonal of s
    off = s - np.diag(np.diag(s))
    scaling = 0.5 * (counts.sum(axis=0) - counts.sum(axis=1))
    through = 0.5 * (-(diag[:, None] * off * r).sum(axis=0) + diag * (off * r).sum(axis=1))
    return value, np.concatenate([ds[upper], scaling + through])


class ContinuousTimeMSM(StateModel):
    """A reversible rate matrix fitted to transition counts."""

    def __init__(self, lag_time: int = 1, n_timescales: int | None = None, ergodic_cutoff: str | float = 1, sliding_window: bool = True, guess: str = "log"):
        self.lag_time, self.n_timescales, self.ergodic_cutoff, self.sliding_window, self.guess = lag_time, n_timescales, ergodic_cutoff, sliding_window, guess
        self.theta_: np.ndarray | None = None

    def fit(self, t: Trajectories) -> ContinuousTimeMSM:
        return self.fit_counts(counting.count_matrix(t, self.lag_time, self.sliding_window, self.ergodic_cutoff))

    def fit_counts(self, c: counting.CountMatrix) -> ContinuousTimeMSM:
        """A second fit with as many states begins where the first ended."""
        self.countsmat_, self.labels_, self.percent_retained_ = c.counts, c.labels, c.percent_retained
        n = self.n_states_ = len(c.labels)
        pairs = n * (n - 1) // 2
        start = self.theta_ if self.theta_ is not None and len(self.theta_) == pairs + n else self._guess(c.counts)
        low = np.concatenate([np.zeros(pairs), np.full(n, -20.0)])
        scale = max(c.counts.sum(), 1.0)

        def loss(x):
            f, g = log_likelihood(x, c.counts, self.lag_time)
            return -f / scale, -g / scale

        self.theta_, f, self.n_iter_ = minimize_bfgs(loss, start, low, max_iter=2000, tol=1e-9)
        self.loglikelihood_ = -f * scale
        self.ratemat_ = rate_matrix(self.theta_, n)
        self.symmetric_, self.populations_ = unpack(self.theta_, n)
        root = np.sqrt(self.populations_)
        w, v = np.linalg.eigh(self.symmetric_)
        self.transmat_ = ((v * np.exp(self.lag_time * w)) @ v.T) * root[None, :] / root[:, None]
        order = np.argsort(-w)
        self._w, self._v = w[order], v[:, order]
        return self

    def _guess(self, counts: np.ndarray) -> np.ndarray:
        """Rates from the matrix logarithm of the symmetrised estimate, or from its first-order form."""
        n = len(counts)
        both = counts + counts.T + 1e-8
        pi = both.sum(axis=1) / both.sum()
        root = np.sqrt(pi)
        sym = both / both.sum() / np.outer(root, root)
        if self.guess == "log":
            w, v = np.linalg.eigh((sym + sym.T) / 2)
            s = (v * np.log(np.clip(w, 1e-6, None)) / self.lag_time) @ v.T
        elif self.guess == "pseudo":
            s = (sym - np.eye(n)) / self.lag_time
        else:
            raise ValueError("guess is 'log' or 'pseudo'")
        return np.concatenate([np.clip(s[np.triu_indices(n, 1)], 1e-8, None), np.log(pi)])

    @property
    def eigenvalues_(self) -> np.ndarray:
        k = self.n_states_ if self.n_timescales is None else min(self.n_timescales + 1, self.n_states_)
        return self._w[:k]

    @property
    def timescales_(self) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return -1.0 / self.eigenvalues_[1:]

    @property
    def left_eigenvectors_(self) -> np.ndarray:
        return np.sqrt(self.populations_)[:, None] * self._v[:, : len(self.eigenvalues_)]

    @property
    def right_eigenvectors_(self) -> np.ndarray:
        return self._v[:, : len(self.eigenvalues_)] / np.sqrt(self.populations_)[:, None]

    @property
    def score_(self) -> float:
        return float(np.exp(self.eigenvalues_ * self.lag_time).sum())

    # --- errors ---

    @property
    def information_(self) -> np.ndarray:
        """Covariance of the parameters that are not at zero: pseudo-inverse of the Hessian, by differences of the gradient."""
        n, pairs = self.n_states_, self.n_states_ * (self.n_states_ - 1) // 2
        free = np.concatenate([np.flatnonzero(self.theta_[:pairs] > 1e-8), np.arange(pairs, pairs + n)])
        h = np.zeros((len(free), len(free)))
        for a, i in enumerate(free):
            step = 1e-5 * max(abs(self.theta_[i]), 1e-3)
            up, down = self.theta_.copy(), self.theta_.copy()
            up[i] += step
            down[i] -= step
            h[a] = (log_likelihood(up, self.countsmat_, self.lag_time)[1] - log_likelihood(down, self.countsmat_, self.lag_time)[1])[free] / (2 * step)
        cov = np.zeros((len(self.theta_),) * 2)
        cov[np.ix_(free, free)] = np.linalg.pinv(-(h + h.T) / 2, rcond=1e-8)
        return cov

    def _errors(self, f) -> np.ndarray:
        """Delta method for a function of the parameters, by differences."""
        base = np.asarray(f(self.theta_))
        cov = self.information_
        slope = np.zeros((len(self.theta_), base.size))
        for i in range(len(self.theta_)):
            if not cov[i, i]:
                continue
            step = 1e-6 * max(abs(self.theta_[i]), 1e-3)
            up = self.theta_.copy()
            up[i] += step
            slope[i] = (np.asarray(f(up)) - base).ravel() / step
        return np.sqrt(np.clip(np.einsum("ia,ij,ja->a", slope, cov, slope), 0, None)).reshape(base.shape)

    def uncertainty_K(self) -> np.ndarray:
        return self._errors(lambda x: rate_matrix(x, self.n_states_))

    def uncertainty_pi(self) -> np.ndarray:
        return self._errors(lambda x: unpack(x, self.n_states_)[1])

    def uncertainty_eigenvalues(self) -> np.ndarray:
        return self._errors(lambda x: np.sort(np.linalg.eigvalsh(unpack(x, self.n_states_)[0]))[::-1][: len(self.eigenvalues_)])

    def uncertainty_timescales(self) -> np.ndarray:
        return self._errors(lambda x: -1 / np.sort(np.linalg.eigvalsh(unpack(x, self.n_states_)[0]))[::-1][1 : len(self.eigenvalues_)])


def exponential_prior(s: np.ndarray, beta: float) -> tuple[float, np.ndarray]:
    """Log-density of an exponential prior on the rates, and its gradient."""
    return float(-beta * s.sum()), np.full(len(s), -beta)


def dirichlet_prior(log_pi: np.ndarray, alpha: np.ndarray | float) -> tuple[float, np.ndarray]:
    """Log-density of a Dirichlet prior on populations given as softmax, and its gradient."""
    a = np.broadcast_to(alpha, log_pi.shape).astype(float)
    p = np.exp(log_pi - log_pi.max())
    p /= p.sum()
    return float((a * np.log(p)).sum()), a - a.sum() * p


def _scales(density, y: np.ndarray) -> np.ndarray:
    """Directions, as columns, in which a log-density falls about evenly around ``y``: from its Hessian, by differences of the gradient."""
    hessian = np.zeros((len(y), len(y)))
    for i in range(len(y)):
        up, down = y.copy(), y.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        hessian[i] = (density(down)[1] - density(up)[1]) / 2e-5
    w, v = np.linalg.eigh((hessian + hessian.T) / 2)
    # where the density is flat or bends upwards the priors alone hold it, within about a unit
    return v / np.sqrt(np.maximum(w, 0.25))


class BayesianContinuousTimeMSM(ContinuousTimeMSM):
    """An ensemble of rate matrices by Hamiltonian Monte Carlo, begun at the most probable one.

    Rates move in their logarithms, so they stay positive; the prior is exponential
    on rates and Dirichlet on populations. Directions are scaled by the curvature of
    the density where the chain begins, as many counts leave some of them thousands of
    times narrower than others. ``epsilon`` is the first step in this scale; ``n_warm``
    draws, which are not kept, bring the chain to where most of the density is and
    the step to a size at which four moves in five are accepted.
    """

    def __init__(self, n_samples: int = 200, n_steps: int = 25, epsilon: float = 0.02, prior_alpha: float = 1.0, prior_beta: float = 1.0, seed: int = 0, n_warm: int = 200, **kw):
        super().__init__(**kw)
        self.n_samples, self.n_steps, self.epsilon, self.prior_alpha, self.prior_beta, self.seed = n_samples, n_steps, epsilon, prior_alpha, prior_beta, seed
        self.n_warm = n_warm

    def fit_counts(self, c: counting.CountMatrix) -> BayesianContinuousTimeMSM:
        super().fit_counts(c)
        n, pairs = self.n_states_, self.n_states_ * (self.n_states_ - 1) // 2
        rng = np.random.default_rng(self.seed)

        def density(y):
            with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                theta = np.concatenate([np.exp(y[:pairs]), y[pairs:]])
                f, g = log_likelihood(theta, c.counts, self.lag_time)
                a, ga = exponential_prior(theta[:pairs], self.prior_beta)
                b, gb = dirichlet_prior(theta[pairs:], self.prior_alpha)
                centre = y[pairs:].mean()  # the constant of the logarithms is free; keep it near 0
                grad = np.concatenate([(g[:pairs] + ga) * theta[:pairs] + 1, g[pairs:] + gb - centre])
                value = f + a + b + y[:pairs].sum() - 0.5 * n * centre**2
            return (value, grad) if np.isfinite(value) and np.isfinite(grad).all() else (-np.inf, np.zeros(len(y)))

        def loss(y):
            f, g = density(y)
            return -f / scale, -g / scale

        scale = max(c.counts.sum(), 1.0)
        y = np.concatenate([np.log(np.clip(self.theta_[:pairs], 1e-6, None)), self.theta_[pairs:] - self.theta_[pairs:].mean()])
        y = minimize_bfgs(loss, y, None, max_iter=2000, tol=1e-12)[0]
        turn = _scales(density, y)
        f, g = density(y)
        drawn, accepted, step = [], 0, self.epsilon
        for draw in range(-self.n_warm, self.n_samples):
            p = rng.normal(size=len(y))
            h = step * rng.uniform(0.5, 1.5)  # no period of the motion is met again and again
            z, zf, zg, q = y.copy(), f, g, p + 0.5 * h * (turn.T @ g)
            for k in range(self.n_steps):
                z = z + h * (turn @ q)
                zf, zg = density(z)
                if not np.isfinite(zf):
                    break
                q = q + (h if k < self.n_steps - 1 else 0.5 * h) * (turn.T @ zg)
            gain = min(0.0, zf - f - 0.5 * (q @ q - p @ p)) if np.isfinite(zf) else -np.inf
            if np.log(rng.random()) < gain:
                y, f, g = z, zf, zg
                accepted += draw >= 0
            if draw < 0:
                step = min(1.0, step * float(np.exp((np.exp(gain) - 0.8) * 3 / np.sqrt(draw + self.n_warm + 1))))
            else:
                drawn.append(np.concatenate([np.exp(y[:pairs]), y[pairs:]]))
        self.all_theta_, self.acceptance_, self.step_ = np.array(drawn), accepted / max(self.n_samples, 1), step
        self.all_ratemats_ = np.array([rate_matrix(x, n) for x in drawn])
        return self

    @property
    def all_populations_(self) -> np.ndarray:
        return np.array([unpack(x, self.n_states_)[1] for x in self.all_theta_])

    @property
    def all_timescales_(self) -> np.ndarray:
        return np.array([-1 / np.sort(np.linalg.eigvalsh(unpack(x, self.n_states_)[0]))[::-1][1:] for x in self.all_theta_])
