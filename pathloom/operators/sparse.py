"""Weighted graph Laplacians, solved by eliminating blocks of nodes.

A block's own nodes are eliminated against its separator nodes; what is left is a
system over separators again. In numpy, for use inside a task.
"""

from __future__ import annotations

import numpy as np

#: Nodes of a system that is solved as a whole, and of a block.
DENSE, CHUNK = 1200, 400


def laplacian(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and right side of the least sum of w |x_j - x_i - want|^2."""
    a, b = np.zeros((n, n)), np.zeros((n, want.shape[1]))
    np.add.at(a, (i, i), w)
    np.add.at(a, (j, j), w)
    np.add.at(a, (i, j), -w)
    np.add.at(a, (j, i), -w)
    np.add.at(b, j, w[:, None] * want)
    np.add.at(b, i, -w[:, None] * want)
    return a, b


def eliminated(a: np.ndarray, b: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The system over the kept nodes, and (g, h) with x_other = h - g x_kept."""
    other = np.setdiff1d(np.arange(len(a)), kept)
    cross = a[np.ix_(other, kept)]
    both = np.linalg.solve(a[np.ix_(other, other)], np.concatenate([cross, b[other]], axis=1)) if len(other) else np.zeros((0, len(kept) + b.shape[1]))
    g, h = both[:, : len(kept)], both[:, len(kept) :]
    return a[np.ix_(kept, kept)] - cross.T @ g, b[kept] - cross.T @ h, g, h


def solved(n: int, i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with A x = b, where A (symmetric, positive) is the sum of its entries a at (i, j), both triangles given.

    Nodes near in number should be near in the graph. Runs of CHUNK nodes are
    eliminated against the nodes that have an entry with an earlier run.
    """
    if n <= DENSE:
        whole = np.zeros((n, n))
        np.add.at(whole, (i, j), a)
        return np.linalg.solve(whole, b)
    run = np.arange(n) // CHUNK
    separator = np.zeros(n, bool)
    separator[np.where(run[i] < run[j], j, i)[run[i] != run[j]]] = True
    if separator.mean() > 0.7:  # too entangled: elimination gains nothing
        return conjugate(n, i, j, a, b)
    place = np.cumsum(separator) - 1
    rest_i, rest_j, rest_a, rest_b = [], [], [], np.array(b[separator])
    both = separator[i] & separator[j]
    rest_i.append(place[i[both]])
    rest_j.append(place[j[both]])
    rest_a.append(a[both])
    i, j, a = i[~both], j[~both], a[~both]
    owner = np.where(separator[i], run[j], run[i])
    order = np.argsort(owner, kind="stable")
    i, j, a, owner = i[order], j[order], a[order], owner[order]
    back = []
    for k in range(int(run[-1]) + 1):
        lo, hi = np.searchsorted(owner, [k, k + 1])
        own = np.flatnonzero((run == k) & ~separator)
        if not len(own):
            continue
        nodes = np.union1d(own, np.concatenate([i[lo:hi], j[lo:hi]]))
        part = np.zeros((len(nodes), len(nodes)))
        np.add.at(part, (np.searchsorted(nodes, i[lo:hi]), np.searchsorted(nodes, j[lo:hi])), a[lo:hi])
        side = np.where(separator[nodes][:, None], 0.0, b[nodes])
        kept = np.flatnonzero(separator[nodes])
        s, r, g, h = eliminated(part, side, kept)
        at = place[nodes[kept]]
        rest_i.append(np.repeat(at, len(at)))
        rest_j.append(np.tile(at, len(at)))
        rest_a.append(s.reshape(-1))
        np.add.at(rest_b, at, r)
        back.append((own, nodes[kept], g, h))
    x = np.zeros_like(b)
    x[separator] = solved(int(separator.sum()), *map(np.concatenate, (rest_i, rest_j, rest_a)), rest_b)
    for own, kept, g, h in back:
        x[own] = h - g @ x[kept]
    return x


def conjugate(n: int, i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 5000) -> np.ndarray:
    """The same by conjugate gradients with the diagonal as preconditioner."""
    diagonal = np.bincount(i[i == j], a[i == j], n)[:, None]
    times = lambda x: np.stack([np.bincount(i, a * x[j, c], n) for c in range(x.shape[1])], axis=1)
    x, r = np.zeros_like(b), b.copy()
    z = r / diagonal
    d, rz = z.copy(), (r * z).sum(axis=0)
    limit = 1e-20 * np.maximum(rz, 1e-300)
    for _ in range(steps):
        if (rz <= limit).all():
            break
        q = times(d)
        step = rz / np.maximum((d * q).sum(axis=0), 1e-300)
        x, r = x + step * d, r - step * q
        z = r / diagonal
        rz, old = (r * z).sum(axis=0), rz
        d = z + rz / np.maximum(old, 1e-300) * d
    return x
