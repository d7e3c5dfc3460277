"""Eigenvalues and eigenvectors of a symmetric matrix: reduced to tridiagonal form, then by divide and conquer."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(diagonal, off-diagonal, q)`` with ``a = q T q'``, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        if not v[1:].any():
            continue
        alpha = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= alpha
        v /= np.linalg.norm(v)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w -= (v @ w) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0.0
        a[k + 1, k] = a[k, k + 1] = alpha
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def _secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho sum z_i^2 / (d_i - x)`` (d ascending, z nonzero, rho > 0): for each root the number of
    the pole that it is measured from and its distance from there, by bisection to the last bit of the distance."""
    k = len(d)
    gap = np.append(d[1:] - d[:-1], rho * (z @ z))
    value = lambda at, mu: 1 + rho * (z**2 / ((d[None, :] - d[at][:, None]) - mu[:, None])).sum(axis=1)
    left = np.arange(k)
    with np.errstate(divide="ignore", invalid="ignore"):
        right = (value(left, gap / 2) <= 0) & (left < k - 1)
        at = np.where(right, left + 1, left)
        lo = np.where(right, -gap / 2, 0.0)
        hi = np.where(right, 0.0, np.where(left < k - 1, gap / 2, gap))
        for _ in range(1200):
            mid = (lo + hi) / 2
            if (np.abs(hi - lo) <= EPS * np.abs(mid)).all():
                break
            up = value(at, mid) < 0
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return at, (lo + hi) / 2


def _merged(d: np.ndarray, z: np.ndarray, rho: float, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of ``q (diag(d) + rho z z') q'`` for rho > 0."""
    order = np.argsort(d, kind="stable")
    d, z, q = d[order].copy(), z[order].copy(), q[:, order].copy()
    small = 8 * EPS * max(np.abs(d).max(), rho * (z @ z))
    keep: list[int] = []
    for j in range(len(d)):
        if rho * abs(z[j]) * np.sqrt(z @ z) <= small:
            continue
        if keep:
            i = keep[-1]
            tau = np.hypot(z[i], z[j])
            c, s = z[j] / tau, -z[i] / tau
            if abs((d[j] - d[i]) * c * s) <= small:  # equal to rounding: turn the two so that one leaves the update
                z[i], z[j] = 0.0, tau
                q[:, i], q[:, j] = c * q[:, i] + s * q[:, j], c * q[:, j] - s * q[:, i]
                d[i], d[j] = d[i] * c * c + d[j] * s * s, d[i] * s * s + d[j] * c * c
                keep.pop()
        keep.append(j)
    if keep:
        at = np.array(keep)
        p, w = d[at], z[at]
        pole, mu = _secular(p, w, rho)
        far = (p[pole][None, :] - p[:, None]) + mu[None, :]  # root j less pole i
        apart = p[None, :] - p[:, None]
        np.fill_diagonal(apart, 1.0)
        w = np.copysign(np.sqrt(np.abs(np.prod(far / apart, axis=1))), w)  # the update whose roots these are exactly
        vectors = w[:, None] / -far
        vectors /= np.sqrt((vectors**2).sum(axis=0))
        q[:, at] = q[:, at] @ vectors
        d[at] = p[pole] + mu
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


def conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors of a tridiagonal matrix: halves, joined by an update of rank one."""
    n = len(d)
    if n == 1:
        return d.copy(), np.ones((1, 1))
    m = n // 2
    rho = e[m - 1]
    upper, lower = d[:m].copy(), d[m:].copy()
    upper[-1] -= abs(rho)
    lower[0] -= abs(rho)
    d1, q1 = conquer(upper, e[: m - 1])
    d2, q2 = conquer(lower, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    values = np.concatenate([d1, d2])
    if rho == 0:
        order = np.argsort(values, kind="stable")
        return values[order], q[:, order]
    return _merged(values, np.concatenate([q1[-1], np.copysign(1.0, rho) * q2[0]]), abs(rho), q)


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(values, vectors)`` of a symmetric matrix, values falling, vectors in columns."""
    scale = np.abs(a).max(initial=0.0)
    if not len(a) or scale == 0:
        return np.zeros(len(a)), np.eye(len(a))
    d, e, q = tridiagonal(a / scale)
    values, vectors = conquer(d, e)
    return values[::-1] * scale, (q @ vectors)[:, ::-1]
