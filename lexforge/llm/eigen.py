"""Eigenvectors of a small symmetric matrix: tridiagonal form, divide and conquer, refinement.

The matrix is as large as vectors have components, however many vectors there are.
"""

from __future__ import annotations

import numpy as np

#: Tridiagonal matrices of at most so many rows are not divided.
LEAF = 4
_EPS = np.finfo(np.float64).eps


def symmetric_eigen(matrix: np.ndarray, refinements: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and their unit eigenvectors as columns, both in extended precision.

    ``matrix`` may be in extended precision; steps of refinement use all of it.
    """
    wide = np.asarray(matrix, dtype=np.longdouble)
    d, e, q = tridiagonal(wide.astype(np.float64))
    e[np.abs(e) <= _EPS * max(np.abs(d).max(), np.abs(e).max(initial=0))] = 0
    _, v = divide(d, e)
    return _refined(wide, (q @ v)[:, ::-1], refinements)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reflections: diagonal, off-diagonal and Q with A = Q T Q'."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :] -= 2 * np.outer(x, x @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def divide(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors of a tridiagonal matrix.

    T is two smaller tridiagonal matrices and a matrix of rank one, whose eigenvectors are joined.
    """
    n = len(d)
    if n <= LEAF:
        return np.linalg.eigh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    m = n // 2
    rho = e[m - 1]
    upper, lower = d[:m].copy(), d[m:].copy()
    upper[-1] -= abs(rho)
    lower[0] -= abs(rho)
    (x, u), (y, w) = divide(upper, e[: m - 1]), divide(lower, e[m:])
    v = np.zeros((n, n))
    v[:m, :m], v[m:, m:] = u, w
    z = np.concatenate([u[-1], np.sign(rho) * w[0]]) if rho else np.zeros(n)
    return _joined(np.concatenate([x, y]), z, abs(rho), v)


def _joined(d: np.ndarray, z: np.ndarray, rho: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of V (D + rho z z') V'."""
    order = np.argsort(d, kind="stable")
    d, z, v = d[order].copy(), z[order].copy(), v[:, order].copy()
    scale = max(np.abs(d).max(), rho * (z @ z), np.finfo(float).tiny)
    kept: list[int] = []
    for j in range(len(d)):  # deflation: a small entry of z, or two values that are near
        if rho * abs(z[j]) <= 8 * _EPS * scale:
            z[j] = 0
            continue
        if kept:
            i = kept[-1]
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            if abs((d[j] - d[i]) * c * s) <= 8 * _EPS * scale:
                v[:, i], v[:, j] = c * v[:, i] - s * v[:, j], s * v[:, i] + c * v[:, j]
                z[i], z[j] = 0, r
                d[i], d[j] = c * c * d[i] + s * s * d[j], s * s * d[i] + c * c * d[j]
                kept.pop()
        kept.append(j)
    if kept:
        some = np.array(kept)
        some = some[np.argsort(d[some], kind="stable")]
        values, vectors = _secular(d[some], z[some], rho)
        d[some], v[:, some] = values, v[:, some] @ vectors
    order = np.argsort(d, kind="stable")
    return d[order], v[:, order]


def _secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z_j^2 / (d_j - x)), one after each ``d``, and the vectors of D + rho z z'.

    Each root is sought as a distance from the nearer of the two values around it. Vectors come from
    the z for which the roots found are exact, so they are orthogonal however near roots are.
    """
    n = len(d)
    gap = np.append(np.diff(d), rho * (z @ z))
    f = lambda origin, x: 1 + rho * (z**2 / ((d[None, :] - origin[:, None]) - x[:, None])).sum(1)
    near = np.where(f(d, gap / 2) >= 0, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    near[-1] = n - 1
    origin = d[near]
    left = near == np.arange(n)
    low, high = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
    high[-1] = gap[-1]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for _ in range(1200):
            # halve the exponents first, so that tiny distances are found to full precision
            small, large = np.minimum(np.abs(low), np.abs(high)), np.maximum(np.abs(low), np.abs(high))
            mid = np.where(small > 0, np.sqrt(small) * np.sqrt(large), large * 2.0**-30)
            mid = np.where((large < 4 * small) | (mid < np.finfo(float).tiny), (small + large) / 2, mid) * np.where(left, 1.0, -1.0)
            mid = np.clip(mid, np.minimum(low, high), np.maximum(low, high))
            value = f(origin, mid)
            up = value < 0  # the function rises between two values of d
            stay = (mid == low) | (mid == high)
            low, high = np.where(up & ~stay, mid, low), np.where(~up & ~stay, mid, high)
            if stay.all():
                break
        x = np.where(left, np.where(low > 0, low, high), np.where(high < 0, high, low))
    apart = (d[None, :] - origin[:, None]) - x[:, None]  # d_j less root i
    lead = np.empty(n)
    for j in range(n):
        ratio = np.concatenate([-apart[:j, j] / (d[:j] - d[j]), -apart[j : n - 1, j] / (d[j + 1 :] - d[j])])
        lead[j] = np.sqrt(np.abs(np.prod(ratio) * apart[n - 1, j] / rho))
    vectors = (np.copysign(lead, z)[None, :] / apart).T
    return origin + x, vectors / np.linalg.norm(vectors, axis=0)


def _refined(a: np.ndarray, v: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors of ``a`` after steps that square the error, in its precision."""
    v = v.astype(np.longdouble)
    n = len(a)
    values = np.diag(v.T @ a @ v).copy()
    for _ in range(steps):
        r, s = np.eye(n, dtype=np.longdouble) - v.T @ v, v.T @ a @ v
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        apart = values[None, :] - values[:, None]
        off = s - np.diag(np.diag(s))
        close = np.abs(apart) <= 2 * (np.linalg.norm(off.astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float)))
        step = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, apart))
        v = v + v @ step
    v = v @ (3 * np.eye(n, dtype=np.longdouble) - v.T @ v) / 2
    v = v / np.sqrt((v * v).sum(0))
    values = ((a @ v) * v).sum(0)
    order = np.argsort(-values, kind="stable")
    return values[order], v[:, order]
