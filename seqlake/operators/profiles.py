"""Profile inference on rows (profile_id, pos, trg array<double>(20), ...), as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlake.functions.alphabet import AMBIGUOUS, BACKGROUND, N_RESIDUES, X

# Dirichlet parameters of the transition priors, by source state.
TRANSITION_ALPHAS = {"MM": 0.7939, "MI": 0.0234, "MD": 0.0234, "IM": 0.1551, "II": 0.4653, "ID": 0.0, "DM": 0.3001, "DI": 0.0, "DD": 0.9002}
LOG_ZERO = -32768.0


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def normalised(values: Column) -> Column:
    """Values divided by their sum."""
    total = array_sum(values)
    return F.transform(values, lambda x: x / total)


def softmax(values: Column) -> Column:
    return normalised(F.transform(values, lambda x: F.exp(x)))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def transition_posteriors(counts: DataFrame, n_effective: float = 1.0) -> DataFrame:
    """Posterior means of the nine transition probabilities of every match column: (n f + alpha) / (n sum f + sum alpha) in each source state."""
    names = list(TRANSITION_ALPHAS)
    wide = counts.groupBy("msa_id", "k").pivot("step", names).agg(F.sum("frequency"))
    rows = []
    for name in names:
        source = [x for x in names if x[0] == name[0]]
        seen = sum((F.coalesce(F.col(x), F.lit(0.0)) for x in source[1:]), F.coalesce(F.col(source[0]), F.lit(0.0)))
        alpha = sum(TRANSITION_ALPHAS[x] for x in source)
        p = (F.coalesce(F.col(name), F.lit(0.0)) * n_effective + TRANSITION_ALPHAS[name]) / (seen * n_effective + alpha)
        rows.append(F.struct(F.lit(name).alias("step"), p.alias("p")))
    return wide.select("msa_id", "k", F.explode(F.array(*rows)).alias("r")).select("msa_id", "k", "r.step", "r.p")


def log_transition(p: Column, step: Column, gap_factor: float = 0.4) -> Column:
    """Logarithm for the alignment, damped for transitions out of gap states; zero is LOG_ZERO."""
    factor = F.when(F.substring(step, 1, 1) == "M", F.lit(1.0)).otherwise(F.lit(gap_factor))
    return F.when(p > 0, F.log(p) * factor).otherwise(F.lit(LOG_ZERO))


def spread_ambiguity(weights: Column, priors: tuple[float, ...] = BACKGROUND) -> Column:
    """Twenty residue weights from 24 codes: X is dealt out by the background, B, Z and J to their pairs by it; an empty column is the background."""
    base = list(priors)
    parts = []
    for a in range(N_RESIDUES):
        own = F.element_at(weights, a + 1) + F.element_at(weights, X + 1) * base[a]
        for code, pair in AMBIGUOUS.items():
            if a in pair:
                own = own + F.element_at(weights, code + 1) * (base[a] / sum(base[b] for b in pair))
        parts.append(own)
    return F.when(array_sum(weights) > 0, F.array(*parts)).otherwise(F.array(*(F.lit(p) for p in base)))


def targets(weights: Column, pseudo: Column, n: Column) -> Column:
    """Weighted frequencies mixed with pseudocount frequencies; the share of the latter falls with the observations."""
    alpha = F.least(F.greatest(F.lit(0.65) / F.pow(n, F.lit(0.9)), F.lit(0.0)), F.lit(1.0))
    return F.zip_with(weights, pseudo, lambda w, p: (F.lit(1.0) - alpha) * w + alpha * p)


def information(trg: Column, bkg: Column) -> Column:
    """Relative entropy against the background, in bits."""
    return array_sum(F.zip_with(trg, bkg, lambda q, p: F.when(q > 0, q * F.log2(q / p)).otherwise(F.lit(0.0))))


def scores(trg: Column, bkg: Column, lam: float = 1.0) -> Column:
    """ln(q / p) / lambda; LOG_ZERO where q is 0."""
    return F.zip_with(trg, bkg, lambda q, p: F.when(q > 0, F.log(q / p) / lam).otherwise(F.lit(LOG_ZERO)))


def targets_of_scores(score: Column, bkg: Column, lam: float = 1.0) -> Column:
    """exp(s lambda) p, normalised."""
    return normalised(F.zip_with(score, bkg, lambda s, p: F.exp(s * lam) * p))


def posteriors(profiles: DataFrame) -> DataFrame:
    """Mean targets of each profile, normalised: one row a residue."""
    long = profiles.select("profile_id", F.posexplode("trg").alias("code", "q"))
    mean = long.groupBy("profile_id", "code").agg(F.avg("q").alias("p"))
    return mean.select("profile_id", "code", (F.col("p") / F.sum("p").over(Window.partitionBy("profile_id"))).alias("p"))


def recomputed_background(profiles: DataFrame, n_effective: float | Column, priors: tuple[float, ...] = BACKGROUND) -> DataFrame:
    """Mean over the positions of background, of weight max(1, n), mixed with targets, of weight min(20, observations); normalised."""
    base = F.array(*(F.lit(p) for p in priors))
    n = F.greatest(F.lit(1.0), n_effective if isinstance(n_effective, Column) else F.lit(float(n_effective)))
    weight = F.least(F.col("n_obs"), F.lit(20.0))
    long = profiles.select("profile_id", n.alias("n"), weight.alias("w"), F.posexplode("trg").alias("code", "q"))
    mixed = (F.col("n") * F.element_at(base, F.col("code") + 1) + F.col("w") * F.col("q")) / (F.col("n") + F.col("w"))
    sums = long.groupBy("profile_id", "code").agg(F.sum(mixed).alias("raw"))
    return sums.select("profile_id", "code", (F.col("raw") / F.sum("raw").over(Window.partitionBy("profile_id"))).alias("p"))


def logit(trg: Column) -> Column:
    """Logit-normal transform: ln(x_r / x_last) for all but the last."""
    last = F.element_at(trg, N_RESIDUES)
    return F.transform(F.slice(trg, 1, N_RESIDUES - 1), lambda x: F.log(x / last))


def inverse_logit(values: Column) -> Column:
    """The probabilities of a logit vector."""
    whole = F.concat(F.transform(values, lambda x: F.exp(x)), F.array(F.lit(1.0)))
    return normalised(whole)


def context_coefficients(length: int = 15, centre: float = 0.4) -> list[float]:
    """Symmetric weights, geometric on either side of the centre, that sum to 1."""
    half, low, high = length // 2, 0.0, 1.0
    for _ in range(200):
        x = (low + high) / 2
        if 2 * centre * sum(x**i for i in range(1, half + 1)) + centre < 1:
            low = x
        else:
            high = x
    side = [centre * x**i for i in range(1, half + 1)]
    return [*reversed(side), centre, *side]


def context_vectors(profiles: DataFrame, length: int = 15, centre: float = 0.4) -> DataFrame:
    """(profile_id, pos, cv, norm2): logit columns averaged over a window mirrored at the ends, less their mean.

    Profiles shorter than the window have none. The window is an array of the
    neighbours' vectors; at the ends it is filled up by its mirror image.
    """
    half = length // 2
    weights = context_coefficients(length, centre)
    own = Window.partitionBy("profile_id").orderBy("pos")
    rows = profiles.select("profile_id", "pos", logit(F.col("trg")).alias("y")).withColumn("len", F.count("*").over(Window.partitionBy("profile_id")))
    around = F.collect_list("y").over(own.rowsBetween(-2 * half, 2 * half))  # wide enough for the mirrored part
    rows = rows.withColumn("around", around).withColumn("start", F.greatest(F.col("pos") - 2 * half, F.lit(1)))

    def at(k: int) -> Column:
        src = F.col("pos") + k
        src = F.when(src < 1, 2 - src).when(src > F.col("len"), 2 * F.col("len") - src).otherwise(src)
        return F.element_at("around", (src - F.col("start") + 1).cast("int"))

    def added(total: Column, vector: Column, w: float) -> Column:
        return F.zip_with(total, vector, lambda a, v: a + v * w)

    total = F.transform(at(-half), lambda v: v * weights[0])
    for k in range(1 - half, half + 1):
        total = added(total, at(k), weights[k + half])
    rows = rows.filter(F.col("len") >= length).select("profile_id", "pos", total.alias("raw"))
    rows = rows.withColumn("mean", array_sum(F.col("raw")) / F.size("raw")).withColumn("cv", F.transform("raw", lambda x: x - F.col("mean")))
    return rows.select("profile_id", "pos", "cv", dot(F.col("cv"), F.col("cv")).alias("norm2"))


# Parameters of the distribution of context vectors.
CV_DIMS, CV_KAPPA0, CV_NU0 = 19, 0.1, 19.0


def context_prior(norm2: Column) -> Column:
    """Log density of one context vector, up to a constant: a multivariate t around 0."""
    half = -0.5 * (CV_NU0 + 1)
    constant = (0.5 * CV_DIMS + half) * (math.log(CV_KAPPA0) - math.log(CV_KAPPA0 + 1))
    return F.lit(constant) + F.lit(half) * F.log(norm2 + 1 + 1 / CV_KAPPA0)


def masked(profiles: DataFrame, segments: DataFrame, priors: tuple[float, ...] = BACKGROUND) -> DataFrame:
    """Positions inside segments (profile_id, left, right) masked: residue X, background targets and weights, prior transitions, one observation of a match.

    Only columns that the profiles have (aa, trg, obs, trn, mid) change.
    """
    inside = segments.select("profile_id", F.explode(F.sequence("left", "right")).alias("pos")).distinct().withColumn("masked", F.lit(True))
    base = normalised(F.array(*(F.lit(p) for p in priors)))
    sums = {s: sum(a for x, a in TRANSITION_ALPHAS.items() if x[0] == s) for s in "MID"}
    values = {
        "aa": F.lit("X"), "trg": base, "obs": base, "trn": F.array(*(F.lit(a / sums[x[0]]) for x, a in TRANSITION_ALPHAS.items())), "mid": F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)),
    }
    own = profiles.join(inside, ["profile_id", "pos"], "left").withColumn("masked", F.coalesce("masked", F.lit(False)))
    return own.withColumns({c: F.when(F.col("masked"), v).otherwise(F.col(c)) for c, v in values.items() if c in profiles.columns})


def target_estimates(rows: DataFrame, weights: str, n: str, ratios: list[list[float]], priors: tuple[float, ...] = BACKGROUND, lam: float = 1.0) -> DataFrame:
    """Positions with ``trg``, ``information`` and ``score``.

    Weighted frequencies are mixed with pseudocounts p_a sum_b w_b r_ab, from
    a matrix of frequency ratios (20 x 20), whose share falls with the
    observations; information is the relative entropy in bits, not below 0;
    scores are ln(q / p) / lambda, and of the matrix where q is 0.
    """
    matrix, base = np.array(ratios, dtype=float), np.array(priors)

    @F.pandas_udf("struct<trg:array<double>,information:double,score:array<double>>")
    def estimated(w: pd.Series, n: pd.Series) -> pd.DataFrame:
        w = np.stack(w.to_numpy()) if len(w) else np.zeros((0, N_RESIDUES))
        alpha = np.clip(0.65 / n.to_numpy() ** 0.9, 0.0, 1.0)[:, None]
        q = alpha * (w @ matrix.T) * base + (1 - alpha) * w
        with np.errstate(divide="ignore", invalid="ignore"):
            odds = np.log(q / base)
            bits = np.where(q > 0, q * odds, 0.0).sum(axis=1) / np.log(2)
        spare = np.where(matrix > 0, np.log(np.maximum(matrix, 1e-300)), LOG_ZERO)[w.argmax(axis=1)]
        return pd.DataFrame({"trg": list(q), "information": np.maximum(bits, 0.0), "score": list(np.where(q > 0, odds / lam, spare))})

    e = rows.withColumn("e", estimated(weights, n))
    return e.select(*(c for c in rows.columns if c not in ("trg", "information", "score")), "e.trg", "e.information", "e.score")


def targets_by_observations(weights: Column, pseudo: Column, n: Column, strength: float = 7.0) -> Column:
    """Weighted and pseudocount frequencies mixed as (n - 1) to ``strength``, normalised: the older rule of the estimate."""
    alpha = F.greatest(n - 1, F.lit(0.0))
    return normalised(F.zip_with(weights, pseudo, lambda w, p: (alpha * w + strength * p) / (alpha + strength)))


def target_transitions(counts: DataFrame, observations: DataFrame) -> DataFrame:
    """(msa_id, k, step, p): posterior means of the nine transitions at each match column; the begin state and the last column only match.

    ``observations`` (msa_id, k, n_match, n_insert, n_delete) are those of the
    column's states; one observation of a match bears no information.
    """
    names = list(TRANSITION_ALPHAS)
    wide = counts.groupBy("msa_id", "k").pivot("step", names).agg(F.sum("frequency"))
    own = observations.join(wide, ["msa_id", "k"], "left").withColumn("last", F.max("k").over(Window.partitionBy("msa_id")))
    n = {"M": F.greatest(F.col("n_match") - 1, F.lit(0.0)), "I": F.col("n_insert"), "D": F.col("n_delete")}
    rows = []
    for name in names:
        source = [x for x in names if x[0] == name[0]]
        seen = sum((F.coalesce(F.col(x), F.lit(0.0)) for x in source[1:]), F.coalesce(F.col(source[0]), F.lit(0.0)))
        alpha = sum(TRANSITION_ALPHAS[x] for x in source)
        p = (F.coalesce(F.col(name), F.lit(0.0)) * n[name[0]] + TRANSITION_ALPHAS[name]) / (seen * n[name[0]] + alpha)
        ends = F.lit(1.0 if name[1] == "M" else 0.0)
        rows.append(F.struct(F.lit(name).alias("step"), F.when(F.col("k") == F.col("last"), ends).otherwise(p).alias("p")))
    begin = [F.struct(F.lit(x).alias("step"), F.lit(1.0 if x[1] == "M" else 0.0).alias("p")) for x in names]
    first = own.select("msa_id").distinct().select("msa_id", F.lit(0).cast("long").alias("k"), F.explode(F.array(*begin)).alias("r"))
    every = own.select("msa_id", F.col("k").cast("long").alias("k"), F.explode(F.array(*rows)).alias("r")).unionByName(first)
    return every.select("msa_id", "k", "r.step", "r.p")


def reevaluated(p: Column, step: Column, power: float = 0.4) -> Column:
    """A transition probability with those out of gap states raised to a power; zero stays zero."""
    return F.when(p > 0, F.exp(F.log(p) * F.when(F.substring(step, 1, 1) == "M", F.lit(1.0)).otherwise(F.lit(power)))).otherwise(F.lit(0.0))
