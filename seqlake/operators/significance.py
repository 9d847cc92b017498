"""Alignment statistics (Karlin & Altschul 1990) and E-values."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.functions.special import log_beta_i, log_gamma_q

# Reference statistics of the ungapped and the gapped scheme.
LAMBDA_REF, K_REF = 1.116276, 0.115812
LAMBDA_GAPPED, K_GAPPED = 0.561132, 0.001488
ALPHA, BETA = 0.5, -1.0
SCORE_LIMIT, SCALE = 10, 32


def histogram(scores: DataFrame, keys: list[str], score: str = "score", scale: int = SCALE) -> DataFrame:
    """Counts of scores, clamped to [-10, 10], in steps of 1 / scale, and their probabilities."""
    clamped = F.greatest(F.least(F.col(score), F.lit(float(SCORE_LIMIT))), F.lit(-float(SCORE_LIMIT)))
    counts = scores.groupBy(*keys, F.rint(clamped * scale).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return probabilities(counts, keys)


def probabilities(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts n of bins with their share p of each key's."""
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def masked_histogram(scores: DataFrame, keys: list[str], q_residue: str, t_residue: str, score: str = "score") -> DataFrame:
    """The same without the cells where either residue is unknown (X)."""
    return histogram(scores.filter((F.col(q_residue) != "X") & (F.col(t_residue) != "X")), keys, score)


def expected(hist: DataFrame, keys: list[str], scale: int = SCALE) -> DataFrame:
    """Expected, least and largest score."""
    s = F.col("bin") / scale
    return hist.groupBy(*keys).agg(F.sum(s * F.col("p")).alias("expected"), F.min(s).alias("min_score"), F.max(s).alias("max_score"))


def solve_lambda(scores: np.ndarray, p: np.ndarray) -> float:
    """Positive root of sum p exp(lambda s) = 1; -1 unless the mean is negative and a score positive."""
    if (scores * p).sum() >= 0 or not (scores[p > 0] > 0).any():
        return -1.0
    f = lambda x: float((p * np.exp(x * scores)).sum() - 1.0)
    high = 0.5
    while f(high) < 0:
        high *= 2
        if high > 1e4:
            return -1.0
    low = 0.0  # the function is below zero just above 0, and convex
    x = high
    for _ in range(200):
        e = p * np.exp(x * scores)
        value, slope = float(e.sum() - 1), float((e * scores).sum())
        if value > 0:
            high = x
        else:
            low = x
        if abs(value) < 1e-13 or high - low < 1e-14 * high:
            break
        step = x - value / slope if slope > 0 else low
        x = step if low < step < high else (low + high) / 2
    return x


def relative_entropy(scores: np.ndarray, p: np.ndarray, lam: float) -> float:
    """lambda times the mean score under the tilted distribution."""
    return float((lam * scores * np.exp(lam * scores) * p).sum()) if lam > 0 else -1.0


def solve_k(scores: np.ndarray, p: np.ndarray, lam: float, h: float, rounds: int = 100, tolerance: float = 1e-6) -> float:
    """Karlin's K for integer scores: closed forms where -1 or 1 is the limit, else by repeated convolution."""
    mean = float((scores * p).sum())
    if mean >= 0 or lam <= 0 or h <= 0:
        return -1.0
    low, high = int(scores[p > 0].min()), int(scores[p > 0].max())
    at = {int(s): float(x) for s, x in zip(scores, p)}
    if low == -1 and high == 1:
        return (at[-1] - at[1]) ** 2 / at[-1]
    if high == 1:
        return h / lam * (1 - math.exp(-lam))
    if low == -1:
        return lam / h * (1 - math.exp(-lam)) * mean * mean
    one = np.zeros(high - low + 1)
    for s, x in zip(scores.astype(int), p):
        if low <= s <= high:
            one[s - low] += x
    total, power = 0.0, np.ones(1)
    for k in range(1, rounds + 1):
        power = np.convolve(power, one)
        s = np.arange(k * low, k * low + len(power))
        part = float((power * np.where(s < 0, np.exp(lam * np.minimum(s, 0)), 1.0)).sum()) / k
        total += part
        if part < tolerance:
            break
    return lam * math.exp(-2 * total) / (h * (1 - math.exp(-lam)))


def statistics(hist: DataFrame, keys: list[str], scale: int = SCALE) -> DataFrame:
    """lambda, H and K of each histogram; at most 641 bins each, which is what a group holds."""
    kinds = dict(hist.dtypes)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        s, p = group["bin"].to_numpy() / scale, group["p"].to_numpy()
        lam = solve_lambda(s, p)
        h = relative_entropy(s, p, lam)
        whole = np.rint(s).astype(int)
        unit = np.unique(whole)
        mass = np.array([p[whole == u].sum() for u in unit])
        k = solve_k(unit, mass, lam, h)
        return pd.DataFrame([[*group[keys].iloc[0], lam, h, k]], columns=[*keys, "lambda", "h", "k"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", lambda double, h double, k double"
    return hist.select(*keys, "bin", "p").groupBy(*keys).applyInPandas(one, schema)


# ----------------------------------------------------------- column formulas


def gapped_lambda(lam: Column) -> Column:
    return F.when(lam > 0, lam * (LAMBDA_GAPPED / LAMBDA_REF))


def gapped_k(k: Column) -> Column:
    return F.when(k > 0, k * (K_GAPPED / K_REF))


def log_evalue(score: Column, space: Column, lam: Column | float = LAMBDA_GAPPED, k: Column | float = K_GAPPED) -> Column:
    """ln(K space) - lambda score."""
    k, lam = (x if isinstance(x, Column) else F.lit(x) for x in (k, lam))
    return F.log(k * space) - lam * score


def log_pair_evalue(score: Column, m: Column, n: Column, lam: Column, k: Column) -> Column:
    """E-value of the pair alone, by the reference statistics where its own failed."""
    space = m.cast("double") * n
    return F.when((lam > 0) & (k > 0), F.log(k * space) - lam * score).otherwise(F.log(F.lit(K_REF) * space) - F.lit(LAMBDA_REF) * score)


def bit_score(log_e: Column, space: Column) -> Column:
    return (F.log(space) - log_e) / math.log(2.0)


def evalue(log_e: Column) -> Column:
    return F.exp(F.least(log_e, F.lit(700.0)))


def pvalue(e: Column) -> Column:
    return F.when(e < 0.01, e).otherwise(1 - F.exp(-e))


def score_threshold(cutoff: float, m: Column, n: Column, lam: float = LAMBDA_GAPPED, k: float = K_GAPPED) -> Column:
    """Least score worth an E-value: that of a ten-fold cutoff (three-fold from 1 up); 999 for none."""
    if cutoff <= 0:
        return F.lit(999.0)
    factor = 10.0 if cutoff < 1 else 3.0
    return F.greatest(-F.log(F.lit(factor * cutoff / k) / (m.cast("double") * n)) / lam, F.lit(0.0))


def threshold_of(cutoff: float, m: int, n: int, lam: float = LAMBDA_GAPPED, k: float = K_GAPPED) -> float:
    """The same for one query."""
    if cutoff <= 0:
        return 999.0
    return max(0.0, -math.log((10.0 if cutoff < 1 else 3.0) * cutoff / k / (m * n)) / lam)


def length_adjustment(m: int, n_db: int, n_profiles: int, lam: float = LAMBDA_GAPPED, k: float = K_GAPPED, alpha: float = ALPHA, beta: float = BETA, rounds: int = 20) -> int:
    """Expected alignment length: the fixed point of l -> alpha / lambda ln(K (m - l)(n - N l)) + beta, in whole numbers.

    The right side falls with l, so the fixed point is the largest l that it
    isn't below. The search keeps a bracket of it: [low, high] with low
    feasible. High starts where K (m - l)(n - N l) falls to max(m, n); the
    iteration steps to the right side's value while that lies in the
    bracket, otherwise to its middle, and ends within one of the fixed point.
    The next whole number is then taken if it is feasible, too.
    """
    if lam <= 0 or k <= 0 or n_profiles < 1 or m * n_db < max(m, n_db) / k:
        return 0

    def mapped(length: float) -> float:
        space = (m - length) * (n_db - n_profiles * length)
        return alpha / lam * (math.log(k) + math.log(space)) + beta if space > 0 else -math.inf

    total, spare = n_db + m * n_profiles, m * n_db - max(m, n_db) / k
    low, high = 0.0, 2 * spare / (total + math.sqrt(total * total - 4 * n_profiles * spare))
    at, near = 0.0, False
    for turn in range(rounds):
        value = mapped(at)
        if value >= at:
            low, near = at, value - at <= 1
            if near or low == high:
                break
        else:
            high = at
        inside = low <= value <= high
        at = value if inside else (low + high) / 2 if turn else high
    if near and math.ceil(low) <= min(high, mapped(math.ceil(low))):
        low = math.ceil(low)
    return int(low)


def search_space(m: int, n_db: int, n_profiles: int, **how) -> float:
    """Effective search space after the length adjustment."""
    cut = length_adjustment(m, n_db, n_profiles, **how)
    return float((m - cut) * (n_db - n_profiles * cut))


# ---------------------------------------------------------- evalue model 1, 2

# The negative binomial of the positives and the combination of the two p-values.
NBD_FACTOR, NBD_EXPONENT, NBD_SHAPE, NBD_PROBABILITY = 100000.0, 1.5, 0.1, 0.757213
BROWN_HALF_DF, BROWN_SCALE = 1.346206, 1.485656
LOG_PAIRS = -9.210340372
#: The product of lengths that positives are normalised by is at least this.
LEAST_AREA = 625.0


def combined_log_evalue(score: float, positives: float, m: int, n: int, space: float, k: float, mu: float, scale: float, variant: int = 2, least_product: float = LEAST_AREA) -> float:
    """Log E-value from the extreme-value p-value of the score and the p-value of the normalised number of positives.

    The two are combined by the empirical Brown method. Without usable
    parameters it is ln(K space) - lambda score.
    """
    if mu <= 0 or scale <= 0:
        return math.log(K_GAPPED * space) - LAMBDA_GAPPED * score
    log_kmn = mu / scale
    if K_REF < k < 1:
        log_kmn += math.log(k / K_REF)
    log_e = log_kmn - score / scale + (LOG_PAIRS if variant == 2 else 0.0)
    log_p = log_e
    if log_e >= math.log(0.01):
        e = math.exp(min(log_e, 80.0))
        log_p = math.log(-math.expm1(-e)) if e < 700 else 0.0
    area = float(m * n)
    shape = round(NBD_FACTOR * positives / max(area, least_product) ** NBD_EXPONENT)
    log_q = log_beta_i(shape + 1.0, NBD_SHAPE, NBD_PROBABILITY)
    log_c = log_gamma_q(BROWN_HALF_DF, (-log_p - log_q) / BROWN_SCALE)
    if log_c >= math.log(0.01):
        c = math.exp(log_c)
        log_c = math.log(-math.log1p(-c)) if c < 1 else 77.0
    return log_c + math.log(space / area)


def dynamic_parameters(log_pair_evalue: Column) -> tuple[Column, Column]:
    """Offset and multiplier of the modular part for realignment, from the pair's E-value."""
    z = log_pair_evalue + 22.0
    e = F.exp(F.least(z, F.lit(0.0)))
    return 0.05 * e, F.when(z < 0, 0.9 * (1 - e)).otherwise(0.0)


def network(x: np.ndarray, hidden: np.ndarray, output: np.ndarray, factor: float = 30.0) -> np.ndarray:
    """Two-layer network with bias inputs and activation 2 / (1 + exp(-x)) - 1: rows of inputs to rows of outputs."""
    act = lambda v: 2 / (1 + np.exp(-v)) - 1
    one = np.ones((len(x), 1))
    return factor * act(np.hstack([one, act(np.hstack([one, x]) @ hidden.T)]) @ output.T)


# What the networks' outputs are multiplied by, and the bounds of the predictions.
MU_FACTOR, SCALE_FACTOR = 30.0, 5.0
LEAST_MU, LEAST_SCALE, MOST_SCALE = 3.0, 0.1, 5.0


@dataclass
class ScoreModel:
    """Networks and adjustments of the extreme-value parameters; all come from the caller.

    Each network is (hidden, output) with the bias first: ``by_profile``
    takes four inputs, ``by_scores_mu`` and ``by_scores_scale`` three and a
    dummy. ``adjust`` has mu_e, mu_s and scale_e as (slope, intercept), and
    the numbers scale_s, alpha and beta.
    """

    by_profile: tuple[np.ndarray, np.ndarray]
    by_scores_mu: tuple[np.ndarray, np.ndarray]
    by_scores_scale: tuple[np.ndarray, np.ndarray]
    adjust: dict
    variant: int = 2


def score_inputs(lam: Column, len1: Column, len2: Column) -> Column:
    """Inputs (0.2 lambda, ln len / ln 1000 of the longer and of the shorter profile, 0); lambda in steps of 0.1 from 0.1 to 10."""
    stepped = F.rint(lam * 10) / 10
    stepped = F.when(stepped <= 0, 0.1).when(stepped > 10, 10.0).otherwise(stepped)
    part = lambda n: F.log(n) / math.log(1000.0)
    return F.array(stepped * 0.2, part(F.greatest(len1, len2)), part(F.least(len1, len2)), F.lit(0.0))


def extreme_value_parameters(e_mu, s_mu, s_scale, lam, adjust: dict):
    """(mu, scale) from the three networks' outputs (columns): affine adjustments, and a mean whose weights depend on 1 / lambda."""
    e_mu, s_mu = F.greatest(e_mu, F.lit(LEAST_MU)), F.greatest(s_mu, F.lit(LEAST_MU))
    bounded = lambda x: F.least(F.greatest(x, F.lit(LEAST_SCALE)), F.lit(MOST_SCALE))
    by_scores = bounded(adjust["scale_s"] * (F.exp(F.greatest(s_scale, F.lit(LEAST_SCALE))) - 1))
    by_profile = bounded(adjust["scale_e"][0] * e_mu + adjust["scale_e"][1])
    mu_e, mu_s = (adjust[k][0] * x + adjust[k][1] for k, x in (("mu_e", e_mu), ("mu_s", s_mu)))
    share = F.when(lam > 0, F.least(1 / lam, F.lit(10.0)) * 0.1).otherwise(0.0)
    alpha = adjust["alpha"] - adjust["alpha"] * share
    beta = adjust["beta"] + (1 - adjust["beta"]) * share
    return alpha * mu_e + (1 - alpha) * mu_s, (1 - beta) * by_profile + beta * by_scores


def with_parameters(pairs: DataFrame, model: ScoreModel, eno: tuple[str, str] = ("query_eno", "target_eno"), length: tuple[str, str] = ("query_len", "target_len"), lam: str = "lambda") -> DataFrame:
    """Pairs with the ``mu`` and ``scale`` that the model predicts."""
    e1, e2, n1, n2 = (F.col(c) for c in (*eno, *length))

    @F.pandas_udf("struct<e_mu:double,s_mu:double,s_scale:double>")
    def predicted(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        a, b = (np.stack(v.to_numpy()) if len(v) else np.zeros((0, 4)) for v in (x, y))
        out = [network(a, *model.by_profile, MU_FACTOR), network(b, *model.by_scores_mu, MU_FACTOR), network(b, *model.by_scores_scale, SCALE_FACTOR)]
        return pd.DataFrame({c: v[:, 0] for c, v in zip(("e_mu", "s_mu", "s_scale"), out)})

    rows = pairs.withColumn("nn", predicted(network_inputs(e1, n1, e2, n2), score_inputs(F.col(lam), n1, n2)))
    mu, scale = extreme_value_parameters(F.col("nn.e_mu"), F.col("nn.s_mu"), F.col("nn.s_scale"), F.col(lam), model.adjust)
    return rows.withColumn("mu", mu).withColumn("scale", scale).drop("nn")


def combined_column(score: Column, positives: Column, m: Column, n: Column, space: Column, k: Column, mu: Column, scale: Column, variant: int = 2) -> Column:
    """``combined_log_evalue`` of each row."""

    @F.pandas_udf("double")
    def combined(s: pd.Series, p: pd.Series, a: pd.Series, b: pd.Series, v: pd.Series, kk: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([combined_log_evalue(*row, variant=variant) for row in zip(s, p, a, b, v, kk, x, y)], dtype=float)

    return combined(score, positives, m, n, space, k, mu, scale)


def network_inputs(eno1: Column, len1: Column, eno2: Column, len2: Column) -> Column:
    """Inputs (0.05 eno, ln len / ln 1000) of both profiles, ordered by effective number, then length."""
    swap = (eno1 < eno2) | ((eno1 == eno2) & (len1 < len2))
    part = lambda e, n: (e * 0.05, F.log(n) / math.log(1000.0))
    a, b = part(eno1, len1), part(eno2, len2)
    return F.array(*(F.when(swap, y).otherwise(x) for x, y in zip((*a, *b), (*b, *a))))


def pair_probabilities(sizes: DataFrame, eno: str = "eno", length: str = "len") -> DataFrame:
    """Probabilities of pairs of bins of effective number and length: products of the marginals, unordered."""
    def binned(value: Column, edges: list[float]) -> Column:
        return sum((F.when(value >= e, 1).otherwise(0) for e in edges[1:]), F.when(value >= edges[0], 1).otherwise(0))

    bins = sizes.select((binned(F.col(eno), [3.0, 5.0, 7.0, 9.0, 11.0, 13.0]) * 6 + binned(F.col(length), [75.0, 150.0, 300.0, 500.0, 700.0])).alias("bin"))
    p = bins.groupBy("bin").agg(F.count("*").alias("n"))  # at most 42 rows
    p = p.select("bin", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
    other = p.select(F.col("bin").alias("bin_b"), F.col("p").alias("p_b"))
    pairs = p.join(F.broadcast(other), F.col("bin") >= F.col("bin_b"))
    both = F.when(F.col("bin") == F.col("bin_b"), F.col("p") * F.col("p_b")).otherwise(2 * F.col("p") * F.col("p_b"))
    return pairs.select(F.col("bin").alias("bin_a"), "bin_b", both.alias("p"))


def scaled_scores(scores: np.ndarray, p: np.ndarray, target: float = LAMBDA_REF, rounds: int = 10, unit: float = 1.0 / SCALE) -> tuple[np.ndarray, float]:
    """Scores in steps of ``unit`` whose lambda is near ``target``, and the factor they were multiplied by; unchanged where lambda doesn't exist.

    Rounding makes lambda jump, so the factor is searched for: between the
    scores' own lambda over the target, halved and doubled, by bisection.
    """
    def own(factor: float) -> tuple[np.ndarray, float]:
        stepped = np.rint(scores * factor / unit) * unit
        values, at = np.unique(stepped, return_inverse=True)
        return stepped, solve_lambda(values, np.bincount(at, p))

    lam = solve_lambda(scores, p)
    if lam <= 0:
        return scores, 1.0
    low, high, best = lam / target / 2, lam / target * 2, (math.inf, 1.0)
    at = lam / target
    for _ in range(rounds):
        found = own(at)[1]
        if found > 0:
            best = min(best, (abs(found - target), at))
        if found > target:  # larger scores have a smaller lambda
            low = at
        else:
            high = at
        at = (low + high) / 2
    return own(best[1])[0], best[1]


def profile_score_probabilities(profiles: DataFrame, priors: tuple[float, ...], scale: float = 1.0) -> DataFrame:
    """(profile_id, score, p): probabilities of the whole-number scores of a profile against the background, over its positions.

    ``profiles`` has an array ``score`` of twenty; scores of LOG_ZERO don't count.
    """
    base = F.array(*(F.lit(x) for x in priors))
    long = profiles.select("profile_id", F.posexplode("score").alias("code", "s")).filter("s > -30000")
    n = profiles.groupBy("profile_id").agg(F.count("*").alias("n"))
    sums = long.groupBy("profile_id", F.rint(F.col("s") * scale).cast("int").alias("score")).agg(F.sum(F.element_at(base, F.col("code") + 1)).alias("w"))
    return sums.join(n, "profile_id").select("profile_id", "score", (F.col("w") / F.col("n")).alias("p"))


def lattice_statistics(scores: np.ndarray, p: np.ndarray) -> tuple[float, float, float]:
    """lambda, relative entropy and K of whole-number scores whose steps may have a common divisor: solved in units of it."""
    some = p > 0
    scores, p = scores[some].astype(int), p[some]
    step = int(np.gcd.reduce(np.abs(scores))) or 1
    lam = solve_lambda(scores / step, p)
    h = relative_entropy(scores / step, p, lam)
    return (lam / step if lam > 0 else lam), h, solve_k(scores // step, p, lam, h)
