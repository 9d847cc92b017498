"""Position-by-position scores of profile pairs.

As DataFrame expressions for pairs of positions, and as numpy blocks for the
search, where a whole score matrix lives inside one Arrow batch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.operators.profiles import CV_DIMS, CV_KAPPA0, CV_NU0

#: What the base score is lowered by, with and without realignment.
SHIFT_MAP, SHIFT_PLAIN = 0.002, 0.0003


def base_score(q: Column, t: Column, q_bkg: Column, t_bkg: Column, shift: float = SHIFT_MAP) -> Column:
    """ln of the sum of q t / (mean background), less the shift."""
    mean = F.zip_with(q_bkg, t_bkg, lambda a, b: (a + b) / 2)
    product = F.zip_with(q, t, lambda a, b: a * b)
    return F.log(F.aggregate(F.zip_with(product, mean, lambda a, m: a / m), F.lit(0.0), lambda a, x: a + x)) - shift


def base_matrix(q: np.ndarray, t: np.ndarray, q_bkg: np.ndarray, t_bkg: np.ndarray, shift: float = SHIFT_MAP) -> np.ndarray:
    """The same for all positions of two profiles (m x 20, n x 20)."""
    return np.log((q / ((q_bkg + t_bkg) / 2)) @ t.T) - shift


def ss_matrix(q: np.ndarray, t: np.ndarray, table: np.ndarray, weight: float = 0.12) -> np.ndarray:
    """Secondary-structure score of m x 3 and n x 3 state probabilities (C, E, H).

    ``table`` is 30 x 30: state times ten plus the tenth the probability is in.
    """
    qi, ti = ((np.arange(3) * 10 + (9.999 * p).astype(int)) for p in (q, t))
    # one product: what a position of the query gives each of the 30 states, times what a target's position has of it; then the helix
    left, right = np.full((len(q), 32), weight), np.zeros((32, len(t)))
    left[:, :30] = sum(q[:, a, None] * table[qi[:, a]] for a in range(3)) * weight
    for b in range(3):
        right[ti[:, b], np.arange(len(t))] += t[:, b]
    left[:, 30] = (q[:, 2] + 0.1) * (weight / 9.0)
    right[30], right[31] = t[:, 2] + 0.1, -0.05
    return left @ right


def cv_statistic(q: np.ndarray, t: np.ndarray, q_norm2: np.ndarray, t_norm2: np.ndarray, q_prior: np.ndarray, t_prior: np.ndarray, k0: float = CV_KAPPA0, nu0: float = CV_NU0, whole: bool = False) -> np.ndarray:
    """Log odds that two context vectors come from one Gaussian: the density of the pair against those of the singles.

    ``whole`` cuts the singles' log densities to whole numbers, as scores without realignment do.
    """
    dims = q.shape[1]
    one, power = 1.0 / k0, -0.5 * (nu0 + 2)
    det = (q_norm2[:, None] + 1 + one) * (t_norm2[None, :] + 1 + one) - (q @ t.T + one) ** 2
    if whole:
        q_prior, t_prior = np.trunc(q_prior), np.trunc(t_prior)
    return cv_constant(dims, k0, nu0) + power * np.log(det) - q_prior[:, None] - t_prior[None, :]


def cv_constant(dims: int = CV_DIMS, k0: float = CV_KAPPA0, nu0: float = CV_NU0) -> float:
    """What the log odds of context vectors have whatever the vectors are."""
    return (0.5 * dims - 0.5 * (nu0 + 2)) * (math.log(k0) - math.log(k0 + 2)) + sum(math.log((nu0 + 1 - i) / 2) for i in range(1, dims + 1))


def step_lookup(values: np.ndarray, keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Table value at the nearest half unit; values at or beyond an end key take that end's. ``keys`` rise by 0.5."""
    at = np.rint(2 * np.clip(values, keys[0], keys[-1])).astype(int) - int(round(2 * keys[0]))
    return np.asarray(table)[np.minimum(at, len(keys) - 1)]


def step_key(value: Column) -> Column:
    """The half unit that a value is looked up at, for a broadcast join with a score table."""
    return F.rint(value * 2) / 2


def smoothed(table: DataFrame, order: str, value: str) -> DataFrame:
    """Five-point moving average over the rows that have a value; the two at either end take the nearest full window's, missing ones the one before."""
    own = Window.partitionBy().orderBy(order)  # a score table: a few hundred rows
    present = table.withColumn("at", F.when(F.col(value).isNotNull(), F.count(value).over(own)))
    rows = present.filter("at IS NOT NULL")
    near = Window.partitionBy().orderBy(order).rowsBetween(-2, 2)
    mean = F.when(F.count("*").over(near) == 5, F.avg(value).over(near))
    every = Window.partitionBy().orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("mean", mean).withColumn("first", F.first("mean", True).over(every)).withColumn("last", F.last("mean", True).over(every)).withColumn("n", F.max("at").over(every))
    smooth = F.when(F.col("at") <= 2, F.col("first")).when(F.col("at") > F.col("n") - 2, F.col("last")).otherwise(F.col("mean"))
    rows = rows.select(F.col(order).alias("o"), F.when(F.col("n") >= 5, smooth).otherwise(F.col(value)).alias("smooth"))
    joined = table.join(F.broadcast(rows), F.col(order).eqNullSafe(F.col("o")), "left").drop("o")
    return joined.withColumn("smooth", F.last("smooth", True).over(Window.partitionBy().orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def triangular_index(a: Column, b: Column) -> Column:
    """Index of an unordered pair in a lower triangle stored by rows."""
    high, low = F.greatest(a, b), F.least(a, b)
    return (high * (high + 1) / 2).cast("long") + low


# Inverse covariances of the weight of cluster scores, and its centre and scales.
HDP_ENO, HDP_ENO_CROSS, HDP_P, HDP_P_CROSS = 0.47, 0.47, 0.37, 1.17
HDP_CENTRE, HDP_ENO_SCALE, HDP_P_SCALE, HDP_LEAST = 23.0, 1.5e-5, 7.5, 0.4
#: What the weight of cluster scores is multiplied by beside secondary-structure scores, and the shift of the modular part.
HDP_WITH_SS, MODULAR_SHIFT = 0.45, 0.5


def hdp_factor(eno1, eno2, p1, p2):
    """Weight of a cluster score by the effective numbers and the membership probabilities (columns, or arrays that broadcast)."""
    exp = F.exp if isinstance(eno1, Column) else np.exp
    a, b = (eno1 - HDP_CENTRE) * (eno1 - HDP_CENTRE), (eno2 - HDP_CENTRE) * (eno2 - HDP_CENTRE)
    x, y = p1 - 1.0, p2 - 1.0
    by_eno = exp((a * a * HDP_ENO + b * b * HDP_ENO + a * b * (2 * HDP_ENO_CROSS)) * -HDP_ENO_SCALE) * (1 - HDP_LEAST) + HDP_LEAST
    return by_eno * exp((x * x * HDP_P + y * y * HDP_P + x * y * (2 * HDP_P_CROSS)) * -HDP_P_SCALE)


def cluster_matrix(q_cluster: np.ndarray, t_cluster: np.ndarray, q_p: np.ndarray, t_p: np.ndarray, q_eno: float, t_eno: float, table: np.ndarray) -> np.ndarray:
    """Cluster scores of m and n positions; a negative cluster, and a table value at or below -99, counts 0."""
    q, t = np.maximum(q_cluster, 0), np.maximum(t_cluster, 0)
    score = table[q[:, None], t[None, :]]
    known = (q_cluster[:, None] >= 0) & (t_cluster[None, :] >= 0) & (score > -99.0)
    return np.where(known, score * hdp_factor(q_eno, t_eno, q_p[:, None], t_p[None, :]), 0.0)


@dataclass
class Terms:
    """Which scores a search adds to the base score, with their tables and weights; a missing table leaves its term out."""

    ss_table: np.ndarray | None = None
    ss_weight: float = 0.12
    cv_keys: np.ndarray | None = None
    cv_values: np.ndarray | None = None
    cv_weight: float = 0.15
    hdp_table: np.ndarray | None = None
    hdp_weight: float = 0.33
    realign: bool = True


def score_matrices(q: dict, t: dict, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """The scores of all positions of two profiles, and their modular part (secondary structure and context, shifted).

    A term is added where both profiles have its fields: ss; cv, norm2 and
    prior; cluster, cluster_p and eno.
    """
    shift = SHIFT_MAP if terms.realign else SHIFT_PLAIN
    scores = base_matrix(q["trg"], t["trg"], q["bkg"], t["bkg"], shift)
    modular = np.zeros_like(scores)
    both = lambda *names: all(x.get(c) is not None for x in (q, t) for c in names)
    if terms.hdp_table is not None and both("cluster"):
        weight = terms.hdp_weight * (HDP_WITH_SS if terms.ss_table is not None and terms.ss_weight > 0 else 1.0)
        scores = scores + weight * cluster_matrix(q["cluster"], t["cluster"], q["cluster_p"], t["cluster_p"], q["eno"], t["eno"], terms.hdp_table)
    used = False
    if terms.ss_table is not None and terms.ss_weight > 0 and both("ss"):
        modular, used = modular + ss_matrix(q["ss"], t["ss"], terms.ss_table, terms.ss_weight), True
    if terms.cv_keys is not None and terms.cv_weight > 0 and both("cv"):
        odds = cv_statistic(q["cv"], t["cv"], q["norm2"], t["norm2"], q["prior"], t["prior"], whole=not terms.realign)
        modular, used = modular + terms.cv_weight * step_lookup(odds, terms.cv_keys, terms.cv_values), True
    return scores + modular, modular - MODULAR_SHIFT * terms.cv_weight if used else modular


def correlation_bonus(matched: DataFrame, keys: list[str], at: str, score: str) -> DataFrame:
    """Autocorrelation bonus along an alignment path: sign * sqrt(abs(sum s_k (s_{k-1} + .. + s_{k-4}) / 2))."""
    path = Window.partitionBy(*keys).orderBy(F.col(at).desc())
    before = sum((F.coalesce(F.lag(score, i).over(path), F.lit(0.0)) for i in range(2, 5)), F.coalesce(F.lag(score, 1).over(path), F.lit(0.0)))
    sums = matched.withColumn("term", F.col(score) * before).groupBy(*keys).agg((F.sum("term") / 2).alias("r"))
    return sums.select(*keys, (F.signum("r") * F.sqrt(F.abs("r"))).alias("bonus"))
