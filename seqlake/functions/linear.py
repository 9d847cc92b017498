"""Small dense matrices, in batches: numpy arrays of shape (..., rows, columns)."""

from __future__ import annotations

import numpy as np


def kronecker(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a[..., :, None, :, None] * b[..., None, :, None, :]
    return out.reshape(*out.shape[:-4], a.shape[-2] * b.shape[-2], a.shape[-1] * b.shape[-1])


def centring(n: int) -> np.ndarray:
    """The matrix that takes the mean off a vector of n."""
    return np.eye(n) - 1.0 / n


def solve_triangular(a: np.ndarray, b: np.ndarray, lower: bool = True) -> np.ndarray:
    """x of a x = b for a triangular a; b holds columns."""
    x = np.zeros(np.broadcast_shapes(a.shape[:-2], b.shape[:-2]) + b.shape[-2:])
    n = a.shape[-1]
    for i in range(n) if lower else reversed(range(n)):
        x[..., i, :] = (b[..., i, :] - (a[..., i, None, :] @ x)[..., 0, :]) / a[..., i, i, None]
    return x


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in pivoted order, the unit lower and the upper factor of each matrix: a[order] = l u."""
    a = np.array(a, dtype=float)
    shape, n = a.shape, a.shape[-1]
    u = a.reshape(-1, n, n)
    every = np.arange(len(u))
    order = np.tile(np.arange(n), (len(u), 1))
    low = np.zeros_like(u)
    for k in range(n):
        pivot = np.abs(u[:, k:, k]).argmax(axis=1) + k
        for table in (u, low, order):
            held = table[every, k].copy()
            table[every, k] = table[every, pivot]
            table[every, pivot] = held
        with np.errstate(divide="ignore", invalid="ignore"):
            factor = np.where(u[:, k, k, None] != 0, u[:, k + 1 :, k] / u[:, k, k, None], 0.0)
        low[:, k + 1 :, k] = factor
        u[:, k + 1 :] -= factor[..., None] * u[:, k, None, :]
    return order.reshape(shape[:-1]), (low + np.eye(n)).reshape(shape), u.reshape(shape)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of a x = b by the factors of a; b holds columns."""
    order, low, up = lu(a)
    return solve_triangular(up, solve_triangular(low, np.take_along_axis(b, order[..., None], axis=-2)), lower=False)


def inverse(a: np.ndarray) -> np.ndarray:
    return solve(a, np.broadcast_to(np.eye(a.shape[-1]), a.shape))


def log_determinant(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign and logarithm of the absolute determinant, by the factors."""
    order, _, up = lu(a)
    diagonal = np.diagonal(up, axis1=-2, axis2=-1)
    n = order.shape[-1]
    swaps = sum((order[..., i, None] > order[..., i + 1 :]).sum(axis=-1) for i in range(n))
    with np.errstate(divide="ignore"):
        return np.sign(diagonal).prod(axis=-1) * np.where(swaps % 2, -1, 1), np.log(np.abs(diagonal)).sum(axis=-1)


def cholesky_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of a x = b for a positive definite a."""
    root = np.linalg.cholesky(a)
    return solve_triangular(np.swapaxes(root, -1, -2), solve_triangular(root, b), lower=False)


def cholesky_log_determinant(a: np.ndarray) -> np.ndarray:
    return 2 * np.log(np.diagonal(np.linalg.cholesky(a), axis1=-2, axis2=-1)).sum(axis=-1)
