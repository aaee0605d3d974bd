"""Eigenvectors of a symmetric matrix by spectral divide and conquer over QDWH polar decompositions.

The polar factor of ``A - shift * I`` is +1 on the eigenvectors above the shift and -1 on those below, so half of it plus the identity projects
on the upper ones. Bases of both projectors' ranges split the matrix into two smaller ones, and so on. The shift is the mean of
the eigenvalues (the trace tells it), which lies between the smallest and the largest one unless all are equal.

The matrix has the size of one vector, never that of the data.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
_STEPS = 12
_TRIES = 8


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of ``a`` by dynamically weighted Halley steps, each one QR decomposition (no inverse)."""
    size = len(a)
    x = a / np.abs(a).sum(axis=0).max()
    low = _EPS / 8  # below all singular values of x that differ from zero
    for _ in range(_STEPS):
        low2 = low * low
        d = np.cbrt(4 * (1 - low2) / (low2 * low2))
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(max(8 - 4 * d + 8 * (2 - low2) / (low2 * root), 0.0)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(size)]))
        before, x = x, wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:size] @ q[size:].T)
        x = (x + x.T) / 2
        low = min(low * (wa + wb * low2) / (1 + wc * low2), 1.0)
        if 1 - low < 10 * _EPS and np.linalg.norm(x - before) < np.cbrt(_EPS):
            break
    return x


def _halves(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the eigenvectors above and below a shift, or None for a multiple of the identity."""
    size = len(a)
    mean = np.trace(a) / size
    spread = np.linalg.norm(a - mean * np.eye(size)) / np.sqrt(size)
    if spread <= size * _EPS * scale:
        return None
    random = np.random.default_rng(size).standard_normal((size, size))
    for attempt in range(_TRIES):  # an eigenvalue too near to the shift has no side: shift a little
        sign = polar_factor(a - (mean + (attempt + 1) // 2 * (-1) ** attempt * spread / 64) * np.eye(size))
        upper = (sign + np.eye(size)) / 2
        above = round(np.trace(upper))
        if np.linalg.norm(sign @ sign - np.eye(size)) > 1e-10 * size or not 0 < above < size:
            continue
        basis = random
        for _ in range(2):
            basis, _ = np.linalg.qr(np.hstack([upper @ basis[:, :above], basis[:, above:] - upper @ basis[:, above:]]))
        return basis[:, :above], basis[:, above:]
    return None


def _divide(a: np.ndarray, scale: float) -> np.ndarray:
    parts = _halves(a, scale) if len(a) > 1 else None
    if parts is None:
        return np.eye(len(a))
    made = []
    for basis in parts:
        inside = basis.T @ a @ basis
        made.append(basis @ _divide((inside + inside.T) / 2, scale))
    return np.hstack(made)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and their unit eigenvectors as columns."""
    a = (a + a.T) / 2
    scale = np.abs(a).sum(axis=0).max() if len(a) else 0.0
    vectors = _divide(a, scale)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]
