"""Transition path theory on a Markov model: committors, fluxes, paths, passage times, hub scores."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.functions.linalg import stationary, widest_path
from kinetrail.operators.bayes import perturb_params, perturb_transmat


def _states(x) -> list[int]:
    return [int(v) for v in np.atleast_1d(x)]


def _matrices(model) -> np.ndarray | None:
    """The samples of an ensemble model, or None for a single one."""
    return getattr(model, "all_transmats_", None)


def _committor(t: np.ndarray, sources: list[int], sinks: list[int]) -> np.ndarray:
    n = len(t)
    if set(sources) & set(sinks):
        raise ValueError("sources and sinks must differ")
    q = np.zeros(n)
    q[sinks] = 1
    inner = np.setdiff1d(np.arange(n), sources + sinks)
    if len(inner):
        a = np.eye(len(inner)) - t[np.ix_(inner, inner)]
        q[inner] = np.linalg.solve(a, t[np.ix_(inner, sinks)].sum(axis=1))
    return q


def committors(sources, sinks, model) -> np.ndarray:
    """Probability to reach the sinks before the sources from each state; the median over an ensemble."""
    a, b = _states(sources), _states(sinks)
    ensemble = _matrices(model)
    if ensemble is not None:
        return np.median([_committor(t, a, b) for t in ensemble], axis=0)
    return _committor(model.transmat_, a, b)


def _conditional(t: np.ndarray, source: int, sink: int, waypoint: int) -> np.ndarray:
    if len({source, sink, waypoint}) < 3:
        raise ValueError("source, sink and waypoint must be three states")
    # first to the waypoint before either end, then from there to the sink before the source
    to_way = _committor(t, [source, sink], [waypoint])
    return to_way * _committor(t, [source], [sink])[waypoint]


def conditional_committors(source: int, sink: int, waypoint: int, model) -> np.ndarray:
    """Probability to pass the waypoint and then reach the sink, before returning to the source."""
    ensemble = _matrices(model)
    if ensemble is not None:
        return np.median([_conditional(t, source, sink, waypoint) for t in ensemble], axis=0)
    return _conditional(model.transmat_, source, sink, waypoint)


def _flux(t: np.ndarray, pi: np.ndarray, q: np.ndarray) -> np.ndarray:
    f = (pi * (1 - q))[:, None] * t * q[None, :]
    np.fill_diagonal(f, 0)
    return f


def fluxes(sources, sinks, model, for_committors: np.ndarray | None = None) -> np.ndarray:
    """Probability flux of reactive trajectories along each edge."""
    a, b = _states(sources), _states(sinks)
    ensemble = _matrices(model)
    if ensemble is not None:
        return np.median([_flux(t, stationary(t), _committor(t, a, b)) for t in ensemble], axis=0)
    q = _committor(model.transmat_, a, b) if for_committors is None else np.asarray(for_committors)
    return _flux(model.transmat_, model.populations_, q)


def net_fluxes(sources, sinks, model, for_committors: np.ndarray | None = None) -> np.ndarray:
    f = fluxes(sources, sinks, model, for_committors)
    return np.clip(f - f.T, 0, None)


def flux_table(transmat: DataFrame, populations: DataFrame, committor: DataFrame) -> DataFrame:
    """Fluxes of a matrix in coordinates: ``src``, ``dst``, ``flux`` and ``net``.

    ``transmat`` has ``src``, ``dst``, ``t_ij``; ``populations`` and ``committor`` have ``idx`` and a value.
    """
    p = populations.select(F.col("idx").alias("src"), F.col("pi_i"))
    a = committor.select(F.col("idx").alias("src"), F.col("q").alias("q_i"))
    b = committor.select(F.col("idx").alias("dst"), F.col("q").alias("q_j"))
    f = transmat.where(F.col("src") != F.col("dst")).join(p, "src").join(a, "src").join(b, "dst")
    f = f.select("src", "dst", (F.col("pi_i") * (1 - F.col("q_i")) * F.col("t_ij") * F.col("q_j")).alias("flux"))
    back = f.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("flux").alias("back"))
    net = F.greatest(F.col("flux") - F.coalesce("back", F.lit(0.0)), F.lit(0.0))
    return f.join(back, ["src", "dst"], "left").select("src", "dst", "flux", net.alias("net"))


def top_path(sources, sinks, net_flux: np.ndarray) -> tuple[list[int], float]:
    """The path of largest bottleneck and its flux."""
    return widest_path(np.asarray(net_flux, float), _states(sources), _states(sinks))


def _subtract(net: np.ndarray, path: list[int], flux: float) -> np.ndarray:
    out = net.copy()
    out[path[:-1], path[1:]] -= flux
    return out


def _bottleneck(net: np.ndarray, path: list[int], flux: float) -> np.ndarray:
    out = net.copy()
    k = int(np.argmin(net[path[:-1], path[1:]]))
    out[path[k], path[k + 1]] = 0
    return out


def paths(sources, sinks, net_flux: np.ndarray, remove_path: str | Callable = "subtract", num_paths: float = np.inf, flux_cutoff: float = 1 - 1e-10):
    """Paths by falling flux until their number or their share of the whole flux is reached."""
    a, b = _states(sources), _states(sinks)
    rules = {"subtract": _subtract, "bottleneck": _bottleneck}
    rule = remove_path if callable(remove_path) else rules.get(remove_path)
    if rule is None:
        raise ValueError(f"unknown way to remove a path: {remove_path!r}")
    net = np.array(net_flux, float)
    whole, explained = net[a].sum(), 0.0
    out, sizes = [], []
    while len(out) < num_paths:
        path, flux = widest_path(net, a, b)
        if not path or not np.isfinite(flux):
            break
        out.append(path)
        sizes.append(flux)
        explained += flux / whole
        if explained >= flux_cutoff:
            break
        net = rule(net, path, flux)
    return out, np.array(sizes)


def path_table(spark, found: list[list[int]], sizes: np.ndarray) -> DataFrame:
    """``rank``, ``path``, ``flux``."""
    return spark.createDataFrame([(k, p, float(f)) for k, (p, f) in enumerate(zip(found, sizes))], "rank int, path array<int>, flux double")


def _mfpt(t: np.ndarray, pi: np.ndarray | None, sinks: list[int] | None) -> np.ndarray:
    n = len(t)
    if sinks is not None:
        out = np.zeros(n)
        inner = np.setdiff1d(np.arange(n), sinks)
        out[inner] = np.linalg.solve(np.eye(len(inner)) - t[np.ix_(inner, inner)], np.ones(len(inner)))
        return out
    pi = stationary(t) if pi is None else pi
    z = np.linalg.inv(np.eye(n) - t + pi[None, :])
    return (np.diag(z)[None, :] - z) / pi[None, :]


def mfpts(model, sinks=None, lag_time: float = 1.0, errors: bool = False, n_samples: int = 100, seed: int = 0):
    """Mean first passage times in units of ``lag_time``: to the sinks, or between all pairs.

    With ``errors`` also the standard deviation over matrices perturbed by the error of their counts.
    """
    b = None if sinks is None else _states(sinks)
    ensemble = _matrices(model)
    if ensemble is not None:
        all_ = np.array([_mfpt(t, None, b) for t in ensemble]) * lag_time
        return (all_.mean(axis=0), all_.std(axis=0)) if errors else all_.mean(axis=0)
    out = _mfpt(model.transmat_, model.populations_, b) * lag_time
    if not errors:
        return out
    rng = np.random.default_rng(seed)
    error = perturb_params(model.countsmat_)
    all_ = np.array([_mfpt(perturb_transmat(model.transmat_, error, rng), None, b) for _ in range(n_samples)]) * lag_time
    return all_.mean(axis=0), all_.std(axis=0)


def _visited(t: np.ndarray, source: int, sink: int, waypoint: int) -> float:
    q = _committor(t, [source], [sink])
    via = _conditional(t, source, sink, waypoint)
    # of those that leave the source for the sink, the ones that pass the waypoint
    return float(t[source] @ via / (t[source] @ q))


def fraction_visited(source: int, sink: int, waypoint: int, model) -> float:
    """Share of reactive trajectories that pass the waypoint; the median over an ensemble."""
    ensemble = _matrices(model)
    if ensemble is not None:
        return float(np.median([_visited(t, source, sink, waypoint) for t in ensemble]))
    return _visited(model.transmat_, source, sink, waypoint)


def hub_scores(model, waypoints=None) -> np.ndarray:
    """For each waypoint the mean fraction visited over all ordered pairs of other states."""
    n = model.n_states_
    points = range(n) if waypoints is None else _states(waypoints)
    out = []
    for w in points:
        others = [i for i in range(n) if i != w]
        out.append(np.mean([fraction_visited(a, b, w, model) for a in others for b in others if a != b]))
    return np.array(out)
