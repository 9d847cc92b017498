"""Hierarchical Dirichlet process mixture: evaluation of given dishes (clusters).

Parameters come from the caller: a prior (mu0, scale matrix S0, kappa0, nu0)
and, for each dish, the mean and scale of its members and their number. There
is no sampler.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def log_t(x: np.ndarray, mu: np.ndarray, scale: np.ndarray, df: float) -> np.ndarray:
    """Log density of a multivariate Student t with a scale matrix."""
    d = len(mu)
    root = np.linalg.cholesky(scale)
    z = np.linalg.solve(root, (np.atleast_2d(x) - mu).T)
    maha = (z * z).sum(axis=0)
    det = 2 * np.log(np.diag(root)).sum()
    return math.lgamma((df + d) / 2) - math.lgamma(df / 2) - 0.5 * (d * math.log(df * math.pi) + det) - 0.5 * (df + d) * np.log1p(maha / df)


def prior_parameters(data: np.ndarray, kappa: float = 0.1) -> tuple[np.ndarray, np.ndarray, float, float]:
    """mu0, S0, kappa0 and nu0 from pooled data."""
    d = data.shape[1]
    centred = data - data.mean(axis=0)
    return data.mean(axis=0), centred.T @ centred / len(data) + 1e-9 * np.eye(d), kappa, float(d + 2)


def dish_parameters(members: np.ndarray, mu0: np.ndarray, s0: np.ndarray, kappa0: float, nu0: float):
    """Posterior mu, scale, kappa and nu of a dish with those members."""
    mean = members.mean(axis=0)
    centred = members - mean
    return posterior(len(members), mean, centred.T @ centred, mu0, s0, kappa0, nu0)


def posterior(n: int, mean: np.ndarray, scatter: np.ndarray, mu0: np.ndarray, s0: np.ndarray, kappa0: float, nu0: float):
    """The same from the number, mean and scatter matrix of the members."""
    shift = (mean - mu0)[:, None]
    kappa, nu = kappa0 + n, nu0 + n
    return (kappa0 * mu0 + n * mean) / kappa, s0 + scatter + kappa0 * n / kappa * (shift @ shift.T), kappa, nu


def predictive(x: np.ndarray, mu: np.ndarray, scale: np.ndarray, kappa: float, nu: float) -> np.ndarray:
    """Log posterior predictive of rows of x."""
    df = nu - len(mu) + 1
    return log_t(x, mu, scale * (kappa + 1) / (kappa * df), df)


def memberships(x: np.ndarray, dishes: list[tuple], tables: list[float], prior: tuple, gamma: float = 1.0, top: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` most probable dishes of each row and their probabilities; the prior (a new dish) is the last index."""
    logs = [math.log(m) + predictive(x, *d) for d, m in zip(dishes, tables)] + [math.log(gamma) + predictive(x, *prior)]
    logs = np.stack(logs, axis=1)
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    order = np.argsort(-p, axis=1, kind="stable")[:, :top]
    return order, np.take_along_axis(p, order, axis=1)


def mixed(x: np.ndarray, dishes: list[tuple], tables: list[float], prior: tuple, weight: float = 0.1) -> np.ndarray:
    """Rows moved towards the means of their dishes by their memberships."""
    order, p = memberships(x, dishes, tables, prior, top=len(dishes) + 1)
    means = np.array([d[0] for d in dishes] + [prior[0]])
    return (1 - weight) * x + weight * (p[:, :, None] * means[order]).sum(axis=1)


def _log_gamma(d: int, x: float) -> float:
    """Logarithm of the multivariate gamma function."""
    return d * (d - 1) / 4 * math.log(math.pi) + sum(math.lgamma(x - i / 2) for i in range(d))


def log_evidence(members: np.ndarray, mu0: np.ndarray, s0: np.ndarray, kappa0: float, nu0: float) -> float:
    """Log probability of a matrix of members (rows) under the prior, their mean and covariance integrated out."""
    n, d = members.shape
    _, scale, kappa, nu = dish_parameters(members, mu0, s0, kappa0, nu0)
    before, after = np.linalg.slogdet(s0)[1], np.linalg.slogdet(scale)[1]
    return -n * d / 2 * math.log(math.pi) + _log_gamma(d, nu / 2) - _log_gamma(d, nu0 / 2) + nu0 / 2 * before - nu / 2 * after + d / 2 * math.log(kappa0 / kappa)


def log_predictive(rows: np.ndarray, members: np.ndarray, prior: tuple) -> float:
    """Log probability of a matrix of new rows given a dish's members (none: the prior)."""
    if not len(members):
        return log_evidence(rows, *prior)
    return log_evidence(np.vstack([members, rows]), *prior) - log_evidence(members, *prior)


def log_probability(groups: list[np.ndarray], prior: tuple) -> tuple[float, list[float]]:
    """Log probability of all dishes' members, and of each dish's."""
    each = [log_evidence(x, *prior) for x in groups]
    return sum(each), each


def profile_memberships(profiles: DataFrame, dishes: list[tuple], tables: list[float], prior: tuple, top: int = 4, mix: float | None = None) -> DataFrame:
    """Positions (profile_id, pos, cv) with the ``top`` dishes and their probabilities, and with ``mix`` the vector moved towards its dishes' means.

    The dishes are parameters of a model and go to the workers with the function.
    """

    def placed(batches):
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["cv"].to_numpy())
            order, p = memberships(x, dishes, tables, prior, top=top)
            moved = mixed(x, dishes, tables, prior, mix) if mix is not None else x
            yield pd.DataFrame({"profile_id": b["profile_id"], "pos": b["pos"], "dish": [r.tolist() for r in order], "p": [r.tolist() for r in p], "mixed": [r.tolist() for r in moved]})

    return profiles.select("profile_id", "pos", "cv").mapInPandas(placed, "profile_id long, pos int, dish array<long>, p array<double>, mixed array<double>")
