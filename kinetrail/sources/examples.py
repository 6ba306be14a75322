"""Example data: Brownian motion in one- and two-dimensional potentials, and the spectra that belong to it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The four terms of the Mueller potential.
MULLER = {"A": (-200.0, -100.0, -170.0, 15.0), "a": (-1.0, -1.0, -6.5, 0.7), "b": (0.0, 0.0, 11.0, 0.6), "c": (-10.0, -10.0, -6.5, 0.7), "x": (1.0, 0.0, -0.5, -1.0), "y": (0.0, 0.5, 1.5, 1.0)}

FRAMES = "traj_id bigint, frame bigint, features array<double>"


def _trajectories(spark: SparkSession, n: int, one: Callable[[int, np.random.Generator], np.ndarray], seed: int) -> DataFrame:
    """A task a trajectory, each with a random stream of its own."""

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in part["id"]:
                x = one(int(i), np.random.default_rng([seed, int(i)]))
                x = x.reshape(len(x), -1)
                for a in range(0, len(x), 50_000):
                    yield pd.DataFrame({"traj_id": i, "frame": np.arange(a, min(a + 50_000, len(x))), "features": list(x[a : a + 50_000])})

    return spark.range(0, n, 1, n).mapInPandas(make, FRAMES)


def brownian(force: Callable, start: float, steps: int, low: float, high: float, diffusion: float, dt: float, rng: np.random.Generator) -> np.ndarray:
    """Overdamped motion between reflecting walls."""
    out = np.empty(steps)
    x, noise = start, rng.normal(size=steps) * np.sqrt(2 * diffusion * dt)
    for i in range(steps):
        out[i] = x
        x = x + force(x) * dt + noise[i]
        if x > high:
            x = 2 * high - x
        elif x < low:
            x = 2 * low - x
    return out


def double_well(spark: SparkSession, n_trajectories: int = 10, n_steps: int = 100_000, seed: int = 0) -> DataFrame:
    """The potential 1 + cos(2x) between -pi and pi, from 0."""
    return _trajectories(spark, n_trajectories, lambda i, r: brownian(lambda x: 2 * np.sin(2 * x), 0.0, n_steps, -np.pi, np.pi, 1e3, 1e-3 * 1e-3, r), seed)


def quad_potential(x):
    return 4 * (x**8 + 0.8 * np.exp(-80 * x**2) + 0.2 * np.exp(-80 * (x - 0.5) ** 2) + 0.5 * np.exp(-40 * (x + 0.5) ** 2))


def quad_force(x):
    return -4 * (8 * x**7 - 128 * x * np.exp(-80 * x**2) - 32 * (x - 0.5) * np.exp(-80 * (x - 0.5) ** 2) - 40 * (x + 0.5) * np.exp(-40 * (x + 0.5) ** 2))


def quad_well(spark: SparkSession, n_trajectories: int = 100, n_steps: int = 1000, seed: int = 0) -> DataFrame:
    """Four wells between -1.2 and 1.2, from uniform starts."""
    return _trajectories(spark, n_trajectories, lambda i, r: brownian(quad_force, r.uniform(-1, 1), n_steps, -1.2, 1.2, 1.0, 1e-3, r), seed)


def muller_energy(x: Column, y: Column) -> Column:
    """The Mueller potential as an expression."""
    out = F.lit(0.0)
    for i in range(4):
        dx, dy = x - MULLER["x"][i], y - MULLER["y"][i]
        out = out + MULLER["A"][i] * F.exp(MULLER["a"][i] * dx * dx + MULLER["b"][i] * dx * dy + MULLER["c"][i] * dy * dy)
    return out


def muller_force(p: np.ndarray) -> np.ndarray:
    f = np.zeros(2)
    for i in range(4):
        dx, dy = p[0] - MULLER["x"][i], p[1] - MULLER["y"][i]
        a, b, c = MULLER["a"][i], MULLER["b"][i], MULLER["c"][i]
        e = MULLER["A"][i] * np.exp(a * dx * dx + b * dx * dy + c * dy * dy)
        f -= e * np.array([2 * a * dx + b * dy, b * dx + 2 * c * dy])
    return f


def muller(spark: SparkSession, n_trajectories: int = 10, n_steps: int = 1_000_000, thin: int = 100, seed: int = 0, kt: float = 15.0, dt: float = 1e-4) -> DataFrame:
    def one(i: int, rng: np.random.Generator) -> np.ndarray:
        p = np.array([rng.uniform(-1.5, 1.2), rng.uniform(-0.2, 2.0)])
        out = np.empty((n_steps // thin, 2))
        scale = np.sqrt(2 * kt * dt)
        for k in range(n_steps // thin * thin):
            if k % thin == 0:
                out[k // thin] = p
            p = p + np.clip(muller_force(p), -1e4, 1e4) * dt + rng.normal(size=2) * scale
        return out

    return _trajectories(spark, n_trajectories, one, seed)


def grid_spectrum(potential: Callable, low: float, high: float, n_grid: int, lag: float, diffusion: float, dt: float, n_modes: int, reflect: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues and right eigenvectors of the one-step chain on a grid, at a lag of whole steps."""
    x = np.linspace(low, high, n_grid)
    h = 1e-5
    force = -(potential(x + h) - potential(x - h)) / (2 * h)
    mean = x + force * dt
    width = x[1] - x[0]
    p = np.exp(-((x[None] - mean[:, None]) ** 2) / (4 * diffusion * dt))
    if reflect:  # steps beyond a wall come back
        for wall in (2 * high - x, 2 * low - x):
            p += np.exp(-((wall[None] - mean[:, None]) ** 2) / (4 * diffusion * dt))
    p *= width
    p /= p.sum(axis=1, keepdims=True)
    w, v = np.linalg.eig(p)
    order = np.argsort(-w.real)[:n_modes]
    return w.real[order] ** lag, v.real[:, order]


def doublewell_eigs(n_grid: int = 200, lag_time: float = 1, n_modes: int = 5):
    return grid_spectrum(lambda x: 1 + np.cos(2 * x), -np.pi, np.pi, n_grid, lag_time, 1e3, 1e-6, n_modes)


def quadwell_eigs(n_grid: int = 200, lag_time: float = 1, n_modes: int = 5):
    return grid_spectrum(quad_potential, -1.2, 1.2, n_grid, lag_time, 1.0, 1e-3, n_modes)
