"""Geometry of coordinates (frames, atoms, 3), in NumPy, for Arrow batches."""

from __future__ import annotations

import numpy as np


def vectors(x: np.ndarray, pairs: np.ndarray, box: np.ndarray | None = None) -> np.ndarray:
    """From the first to the second atom of each pair, by the nearest image of an orthorhombic box if one is given."""
    pairs = np.asarray(pairs, int).reshape(-1, 2)
    d = x[:, pairs[:, 1]] - x[:, pairs[:, 0]]
    if box is not None:
        b = np.asarray(box, float).reshape(-1, 1, 3)
        d = d - b * np.round(d / b)
    return d


def distances(x: np.ndarray, pairs: np.ndarray, box: np.ndarray | None = None) -> np.ndarray:
    return np.linalg.norm(vectors(x, pairs, box), axis=2)


def angles(x: np.ndarray, triples: np.ndarray) -> np.ndarray:
    """Angle at the middle atom, in radians."""
    t = np.asarray(triples, int).reshape(-1, 3)
    u, v = x[:, t[:, 0]] - x[:, t[:, 1]], x[:, t[:, 2]] - x[:, t[:, 1]]
    c = (u * v).sum(2) / (np.linalg.norm(u, axis=2) * np.linalg.norm(v, axis=2))
    return np.arccos(np.clip(c, -1, 1))


def dihedrals(x: np.ndarray, quads: np.ndarray) -> np.ndarray:
    """Torsion about the middle bond, in radians between -pi and pi."""
    q = np.asarray(quads, int).reshape(-1, 4)
    a, b, c = (x[:, q[:, i + 1]] - x[:, q[:, i]] for i in range(3))
    m, n = np.cross(a, b), np.cross(b, c)
    y = (np.linalg.norm(b, axis=2)[..., None] * a * n).sum(2)
    return np.arctan2(y, (m * n).sum(2))


def sphere(n: int) -> np.ndarray:
    """Points spread evenly over the unit sphere by the golden angle."""
    i = np.arange(n) + 0.5
    z, phi = 1 - 2 * i / n, np.pi * (1 + 5**0.5) * i
    r = np.sqrt(1 - z * z)
    return np.stack([r * np.cos(phi), r * np.sin(phi), z], 1)


def surface_areas(x: np.ndarray, radii: np.ndarray, probe: float = 0.14, points: int = 960) -> np.ndarray:
    """Solvent-accessible area of each atom by test points on its sphere, after Shrake and Rupley."""
    r = np.asarray(radii, float) + probe
    unit = sphere(points)
    out = np.empty(x.shape[:2])
    for f, atoms in enumerate(x):
        d = np.linalg.norm(atoms[:, None] - atoms[None], axis=2)
        for i in range(len(atoms)):
            near = np.flatnonzero((d[i] < r[i] + r) & (np.arange(len(atoms)) != i))
            p = atoms[i] + r[i] * unit
            free = np.ones(points, bool)
            for j in near:
                free &= ((p - atoms[j]) ** 2).sum(1) >= r[j] ** 2
            out[f, i] = 4 * np.pi * r[i] ** 2 * free.mean()
    return out


def reciprocal_moments(x: np.ndarray, atoms: np.ndarray, excluded: list[set[int]]) -> np.ndarray:
    """For each atom mean, root of the second and cube root of the third central moment of reciprocal distances."""
    out = []
    n = x.shape[1]
    for k, a in enumerate(atoms):
        others = [j for j in range(n) if j != a and j not in excluded[k]]
        if not others:
            out.append(np.zeros((len(x), 3)))
            continue
        r = 1 / np.linalg.norm(x[:, others] - x[:, [a]], axis=2)
        m = r.mean(1)
        c = r - m[:, None]
        out.append(np.stack([m, np.sqrt((c**2).mean(1)), np.cbrt((c**3).mean(1))], 1))
    return np.concatenate(out, 1)
