"""Dense linear algebra on the driver: matrices of states or features, never of frames."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np


def strong_components(adjacency: np.ndarray) -> list[list[int]]:
    """Strongly connected components of a directed graph, by one iterative depth-first search with low links."""
    n = len(adjacency)
    ahead = [np.flatnonzero(row).tolist() for row in adjacency]
    number, low, on = [-1] * n, [0] * n, [False] * n
    stack: list[int] = []
    out: list[list[int]] = []
    count = 0
    for root in range(n):
        if number[root] >= 0:
            continue
        work = [(root, iter(ahead[root]))]
        number[root] = low[root] = count
        count += 1
        stack.append(root)
        on[root] = True
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if number[nxt] < 0:
                    number[nxt] = low[nxt] = count
                    count += 1
                    stack.append(nxt)
                    on[nxt] = True
                    work.append((nxt, iter(ahead[nxt])))
                    break
                if on[nxt]:
                    low[node] = min(low[node], number[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    part = []
                    while True:
                        x = stack.pop()
                        on[x] = False
                        part.append(x)
                        if x == node:
                            break
                    out.append(sorted(part))
    return out


def ergodic_part(counts: np.ndarray, weight: float) -> tuple[np.ndarray, float]:
    """States of the most populated strong component of ``counts >= weight`` and the percentage of counts it keeps.

    Population is the sum of columns; of equals the component of the first state
    wins. A single state without a transition to itself is no component: nothing is kept.
    """
    if not len(counts):
        return np.zeros(0, int), float("nan")
    parts = sorted(strong_components(counts >= weight if weight > 0 else counts > 0))
    population = counts.sum(axis=0)
    best = max(parts, key=lambda p: (population[p].sum(), -p[0]))
    kept = np.array(best)
    if len(kept) == 1 and counts[kept[0], kept[0]] == 0:
        kept = kept[:0]
    with np.errstate(invalid="ignore", divide="ignore"):
        percent = 100.0 * population[best].sum() / population.sum() if population.sum() else float("nan")
    return kept, float(percent)


def reversible_mle(counts: np.ndarray, tol: float = 1e-10, max_iter: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood transition matrix under detailed balance, and its stationary distribution.

    Cyclic maximisation over the symmetric matrix of unconditional weights: each
    diagonal entry and each pair of states that was observed is set to the exact
    maximum given the others, the root of a quadratic. Ends when a sweep gains less
    than ``tol`` in log-likelihood.
    """
    c = np.asarray(counts, float)
    if c.ndim != 2 or c.shape[0] != c.shape[1]:
        raise ValueError("counts must be a square matrix")
    if (c < 0).any() or not np.isfinite(c).all():
        raise ValueError("counts must be finite and not negative")
    rows = c.sum(axis=1)
    if not len(c) or (rows <= 0).any():
        raise ValueError("every state needs a count")
    x = c + c.T
    both = np.argwhere(np.triu(x > 0, 1))
    diagonal = np.flatnonzero(np.diag(c) > 0)
    sums = x.sum(axis=1)
    seen = c > 0

    def likelihood() -> float:
        return float((c[seen] * np.log((x / sums[:, None])[seen])).sum())

    last = likelihood()
    pairs = [(int(i), int(j)) for i, j in both]
    for _ in range(max_iter):
        for i in diagonal:
            gap = rows[i] - c[i, i]
            if gap > 0:
                new = c[i, i] * (sums[i] - x[i, i]) / gap
                sums[i] += new - x[i, i]
                x[i, i] = new
        for i, j in pairs:
            a = rows[i] + rows[j] - c[i, j] - c[j, i]
            away_i, away_j = sums[i] - x[i, j], sums[j] - x[i, j]
            joint = c[i, j] + c[j, i]
            b = rows[i] * away_j + rows[j] * away_i - joint * (away_i + away_j)
            product = joint * away_i * away_j
            if a > 0:
                new = (-b + math.sqrt(max(b * b + 4 * a * product, 0.0))) / (2 * a)
            elif b > 0:
                new = product / b
            else:
                continue
            if new > 0:
                sums[i] += new - x[i, j]
                sums[j] += new - x[i, j]
                x[i, j] = x[j, i] = new
        x /= x.sum()
        sums = x.sum(axis=1)
        now = likelihood()
        if abs(now - last) < tol:
            break
        last = now
    else:
        raise ValueError("the iteration did not converge")
    return x / sums[:, None], sums / sums.sum()


def stationary(transmat: np.ndarray) -> np.ndarray:
    """The distribution that a transition matrix leaves as it is: least squares with the sum fixed."""
    n = len(transmat)
    a = np.vstack([transmat.T - np.eye(n), np.ones(n)])
    pi = np.linalg.lstsq(a, np.append(np.zeros(n), 1.0), rcond=None)[0]
    pi = np.clip(pi, 0, None)
    return pi / pi.sum()


def eigensystem(transmat: np.ndarray, pi: np.ndarray | None, k: int, reversible: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading ``k`` eigenvalues, left and right eigenvectors (columns), by falling real part.

    The first left vector sums to 1 and the others have norm 1 in the inverse
    stationary metric; left and right vectors are biorthonormal.
    """
    n = len(transmat)
    if pi is None:
        pi = stationary(transmat)
    if reversible:
        root = np.sqrt(pi)
        u, v = np.linalg.eigh(root[:, None] * transmat / root[None, :])
        order = np.argsort(-u)[:k]
        u, v = u[order], v[:, order]
        left, right = root[:, None] * v, v / root[:, None]
    else:
        u, right = np.linalg.eig(transmat)
        order = np.argsort(-u.real, kind="stable")
        u, right = u[order], right[:, order]
        left = np.linalg.pinv(right).T
        u, left, right = (np.real_if_close(x, 1e6)[..., :k] for x in (u, left, right))
    total = left[:, 0].sum()
    left, right = left.copy(), right.copy()
    left[:, 0] /= total
    for i in range(1, min(k, n)):
        norm = np.sqrt(np.abs((left[:, i] ** 2 / pi).sum()))
        left[:, i] /= norm
        largest = np.argmax(np.abs(left[:, i]))
        if np.real(left[largest, i]) < 0:  # a fixed sign
            left[:, i] = -left[:, i]
    scale = np.einsum("ij,ij->j", left, right)
    return u, left, right / scale[None, :]


def generalized_eigh(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of ``a v = w b v`` for symmetric ``a`` and positive definite ``b``, by falling ``w``; vectors have norm 1 in ``b``."""
    try:
        low = np.linalg.cholesky(b)
    except np.linalg.LinAlgError as error:
        raise ValueError("the covariance matrix is not positive definite; use more shrinkage or fewer features") from error
    half = np.linalg.solve(low, np.linalg.solve(low, a).T)
    w, v = np.linalg.eigh((half + half.T) / 2)
    return w[::-1], np.linalg.solve(low.T, v)[:, ::-1]


def expm_symmetric(s: np.ndarray, t: float = 1.0) -> np.ndarray:
    w, v = np.linalg.eigh(s)
    return (v * np.exp(t * w)) @ v.T


def minimize_bfgs(fun: Callable, x: np.ndarray, lower: np.ndarray | None = None, max_iter: int = 500, tol: float = 1e-8) -> tuple[np.ndarray, float, int]:
    """Minimum of a smooth function with gradient under lower bounds.

    Quasi-Newton steps in the free variables, projected to the bounds, with
    backtracking; the inverse Hessian starts afresh where the step is no descent.
    """
    low = np.full(len(x), -np.inf) if lower is None else lower
    x = np.maximum(np.asarray(x, float), low)
    f, g = fun(x)
    h = np.eye(len(x))
    for it in range(max_iter):
        free = ~((x <= low) & (g > 0))
        if not free.any() or np.abs(np.where(free, g, 0)).max() < tol:
            return x, f, it
        p = np.zeros(len(x))
        p[free] = -h[np.ix_(free, free)] @ g[free]
        if p @ g >= -1e-16 * np.abs(p).sum():
            h = np.eye(len(x))
            p = np.where(free, -g, 0.0)
        t = 1.0
        if it == 0:
            t = min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        for _ in range(60):
            y = np.maximum(x + t * p, low)
            new, grad = fun(y)
            if np.isfinite(new) and new <= f + 1e-4 * g @ (y - x):
                break
            t /= 2
        else:
            return x, f, it
        s, d = y - x, grad - g
        if s @ d > 1e-12 * np.linalg.norm(s) * np.linalg.norm(d):
            rho = 1.0 / (s @ d)
            left = np.eye(len(x)) - rho * np.outer(s, d)
            h = left @ h @ left.T + rho * np.outer(s, s)
        done = abs(f - new) <= tol * max(1.0, abs(f)) * 1e-3 and np.abs(s).max() < 1e-10
        x, f, g = y, new, grad
        if done:
            return x, f, it
    return x, f, max_iter


def minimize_simplex(fun: Callable, x: np.ndarray, step: float = 0.1, max_iter: int = 2000, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    """Minimum of a function without gradient, by the downhill simplex of Nelder and Mead."""
    n = len(x)
    points = [np.asarray(x, float)] + [np.asarray(x, float) + step * (np.arange(n) == i) for i in range(n)]
    values = [fun(p) for p in points]
    for _ in range(max_iter):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] <= tol * (1 + abs(values[0])) and np.abs(points[-1] - points[0]).max() < 1e-6:
            break
        centre = np.mean(points[:-1], axis=0)
        away = centre - points[-1]
        trial, value = centre + away, fun(centre + away)
        if value < values[0]:
            far, further = centre + 2 * away, fun(centre + 2 * away)
            points[-1], values[-1] = (far, further) if further < value else (trial, value)
        elif value < values[-2]:
            points[-1], values[-1] = trial, value
        else:
            near = centre + (0.5 if value < values[-1] else -0.5) * away
            inner = fun(near)
            if inner < min(value, values[-1]):
                points[-1], values[-1] = near, inner
            else:
                points = [points[0]] + [(points[0] + p) / 2 for p in points[1:]]
                values = [values[0]] + [fun(p) for p in points[1:]]
    best = int(np.argmin(values))
    return points[best], values[best]


def linkage(d: np.ndarray, method: str = "average") -> np.ndarray:
    """Hierarchical clustering of a distance matrix: rows of (a, b, height, size), clusters numbered on from n.

    Distances of merged clusters follow the recurrence of Lance and Williams.
    """
    n = len(d)
    d = np.array(d, float)
    if method == "ward":
        d = d**2
    np.fill_diagonal(d, np.inf)
    size, name = np.ones(n), list(range(n))
    near = d.argmin(axis=1)  # of each row, the first of its nearest
    least = d[np.arange(n), near]
    out = []
    for step in range(n - 1):
        i = int(np.argmin(least))
        i, j = sorted((i, int(near[i])))
        h = d[i, j]
        a, b = size[i], size[j]
        if method == "single":
            new = np.minimum(d[i], d[j])
        elif method == "complete":
            new = np.maximum(d[i], d[j])
        elif method == "average":
            new = (a * d[i] + b * d[j]) / (a + b)
        elif method == "ward":
            new = ((a + size) * d[i] + (b + size) * d[j] - size * h) / (a + b + size)
        else:
            raise ValueError(f"unknown linkage {method}")
        new[i] = new[j] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        stale = np.flatnonzero((near == i) | (near == j) | (new < least) | (new == least) & (i < near))
        stale = np.union1d(stale, [i, j])
        near[stale] = d[stale].argmin(axis=1)
        least[stale] = d[stale, near[stale]]
        pair = sorted((name[i], name[j]))
        size[i] = a + b
        out.append((*pair, math.sqrt(h) if method == "ward" else h, a + b))
        name[i] = n + step
    return np.array(out).reshape(-1, 4)


def cut_tree(tree: np.ndarray, k: int) -> np.ndarray:
    """Labels of ``k`` clusters from a linkage, numbered in the order of their first members."""
    n = len(tree) + 1
    parent = list(range(2 * n))

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for s in range(n - k):
        parent[top(int(tree[s, 0]))] = parent[top(int(tree[s, 1]))] = n + s
    labels: dict[int, int] = {}
    return np.array([labels.setdefault(top(i), len(labels)) for i in range(n)])


def widest_path(weights: np.ndarray, sources: list[int], sinks: list[int]) -> tuple[list[int], float]:
    """The path whose smallest weight is largest, and that weight; an empty path with 0 where none leads over."""
    n = len(weights)
    width, back = np.full(n, -np.inf), np.full(n, -1)
    queue = []
    for s in sources:
        width[s] = np.inf
        heapq.heappush(queue, (-np.inf, s))
    done = np.zeros(n, bool)
    while queue:
        w, u = heapq.heappop(queue)
        if done[u]:
            continue
        done[u] = True
        if u in sinks:
            break
        for v in np.flatnonzero(weights[u] > 0):
            new = min(-w, weights[u, v])
            if not done[v] and new > width[v]:
                width[v], back[v] = new, u
                heapq.heappush(queue, (-new, int(v)))
    reached = [s for s in sinks if width[s] > 0]
    if not reached:
        return [], 0.0
    end = max(reached, key=lambda s: (width[s], -s))
    path = [end]
    while back[path[-1]] >= 0:
        path.append(int(back[path[-1]]))
    return [int(x) for x in path[::-1]], float(width[end])
