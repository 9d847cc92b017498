"""More queries: scores of profile pairs by term, significance models, readers, conversions, linear algebra.

Tables that the engine takes from files (scores, networks, matrices) follow
rules here, which the SQL states for itself.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.functions import linear, special
from seqlake.functions.alphabet import BACKGROUND
from seqlake.operators import alignment as al
from seqlake.operators import construct, convert, msa, pairs, scoring, search, segments
from seqlake.operators import profiles as pr
from seqlake.operators import significance as sig
from seqlake.plans.adapters import CELLS_SQL, PROFILES_SQL, backgrounds, cells, log_transitions, profiles, r6, table
from seqlake.plans.queries import _ALPHA_ROWS, _LOCAL_SQL, _SCORES_SQL, _STEPS_SQL, BKG_LIST, BKG_ROWS, query, scored_positions
from seqlake.sources import formats, tables

# ------------------------------------------------------------------- inference

_RATIO_SQL = "(exp(-abs(a - b) / 5.0) + 0.5)"
RATIOS = [[math.exp(-abs(a - b) / 5.0) + 0.5 for b in range(20)] for a in range(20)]


@query("d23_targets", f"""WITH {PROFILES_SQL}, m AS (SELECT profile_id, pos, least(greatest(0.65 / pow(n_obs, 0.9), 0), 1) AS alpha, obs FROM prof),
t AS (SELECT profile_id, pos, list_transform(generate_series(1, 20), lambda a: (1 - alpha) * obs[a] + alpha * ({BKG_LIST})[a] * list_sum(list_transform(generate_series(1, 20), lambda b: obs[b] * {_RATIO_SQL}))) AS q FROM m)
SELECT profile_id, pos, round(list_sum(q), 6) + 0.0 AS total, round(list_max(q), 6) + 0.0 AS largest, round(greatest(list_sum(list_transform(generate_series(1, 20), lambda i: q[i] * log2(q[i] / ({BKG_LIST})[i]))), 0), 6) + 0.0 AS information,
round(list_sum(list_transform(generate_series(1, 20), lambda i: ln(q[i] / ({BKG_LIST})[i]) / 0.5)), 5) + 0.0 AS scores FROM t""")
def d23_targets(spark, sf_dir):
    """Targets from weights and pseudocounts, information and scores (D21's pseudocounts, D23, D26)."""
    rows = pr.target_estimates(profiles(spark, sf_dir).select("profile_id", "pos", "obs", "n_obs"), "obs", "n_obs", RATIOS, lam=0.5)
    return rows.select(
        "profile_id", "pos", r6(pr.array_sum(F.col("trg"))).alias("total"), r6(F.array_max("trg")).alias("largest"), r6(F.col("information")).alias("information"),
        (F.round(pr.array_sum(F.col("score")), 5) + F.lit(0.0)).alias("scores"),
    )


@query("d21_targets", f"""WITH {PROFILES_SQL}, m AS (SELECT profile_id, pos, greatest(n_obs - 1, 0) AS alpha, obs, trg FROM prof), t AS (SELECT profile_id, pos, list_transform(generate_series(1, 20), lambda i: (alpha * obs[i] + 7 * trg[i]) / (alpha + 7)) AS q FROM m)
SELECT profile_id, pos, round(q[3] / list_sum(q), 6) + 0.0 AS third, round(list_max(q) / list_sum(q), 6) + 0.0 AS largest FROM t""")
def d21_targets(spark, sf_dir):
    q = pr.targets_by_observations(F.col("obs"), F.col("trg"), F.col("n_obs"))
    rows = profiles(spark, sf_dir).select("profile_id", "pos", q.alias("q"))
    return rows.select("profile_id", "pos", r6(F.element_at("q", 3)).alias("third"), r6(F.array_max("q")).alias("largest"))


@query("d19_ambiguity", f"""WITH {PROFILES_SQL}, w AS (SELECT profile_id, pos, list_transform(obs, lambda x: x * 0.8) AS o, ss[1] * 0.2 AS b, ss[2] * 0.1 AS z, ss[2] * 0.1 AS j, ss[3] * 0.2 AS x FROM prof), k AS (SELECT {BKG_LIST} AS p)
SELECT profile_id, pos, round(o[3] + p[3] * x + b * p[3] / (p[3] + p[4]), 6) + 0.0 AS n, round(o[7] + p[7] * x + z * p[7] / (p[6] + p[7]), 6) + 0.0 AS e, round(o[11] + p[11] * x + j * p[11] / (p[10] + p[11]), 6) + 0.0 AS l, round(o[1] + p[1] * x, 6) + 0.0 AS a FROM w CROSS JOIN k""")
def d19_ambiguity(spark, sf_dir):
    """Weights with a part on B, Z, J and X, dealt out to residues."""
    s = lambda i: F.element_at("ss", i)
    whole = F.concat(F.transform("obs", lambda x: x * 0.8), F.array(s(1) * 0.2, s(2) * 0.1, s(2) * 0.1, s(3) * 0.2))
    rows = profiles(spark, sf_dir).select("profile_id", "pos", pr.spread_ambiguity(whole).alias("w"))
    return rows.select("profile_id", "pos", *(r6(F.element_at("w", i)).alias(c) for i, c in ((3, "n"), (7, "e"), (11, "l"), (1, "a"))))


_TARGET_STEPS_SQL = f"""{_LOCAL_SQL}, numb AS (SELECT msa_id, pos, ms AS k FROM col WHERE m = 1),
cnt2s AS (SELECT mem.msa_id, mem.pos, count(*) FILTER (code <> 23) AS most, coalesce(sum(weight) FILTER (code = 24), 0) AS w_gap FROM mem JOIN cell c ON c.msa_id = mem.msa_id AND c.seq_id = mem.seq_id AND c.pos = mem.pos JOIN weights g ON g.msa_id = mem.msa_id AND g.seq_id = mem.seq_id GROUP BY ALL),
ins AS (SELECT pr.msa_id, ms AS k, sum(weight) / count(*) AS w FROM pr JOIN cell c ON c.msa_id = pr.msa_id AND c.seq_id = pr.seq_id AND c.pos = pr.pos JOIN weights g ON g.msa_id = pr.msa_id AND g.seq_id = pr.seq_id WHERE m = 0 AND code < 23 AND pr.pos BETWEEN lft AND rgt GROUP BY ALL),
o3 AS (SELECT n.msa_id, n.k, greatest(1, least(n_obs, most)) AS n_match, CASE WHEN w_gap > 0 THEN greatest(1, least(least(20, e * exp(0.5 * (1 - w_gap) * ln(w_gap))), most)) ELSE 0 END AS n_delete, e, most
  FROM numb n JOIN obs ON obs.msa_id = n.msa_id AND obs.pos = n.pos JOIN med ON med.msa_id = n.msa_id AND med.pos = n.pos JOIN cnt2s x ON x.msa_id = n.msa_id AND x.pos = n.pos),
o4 AS (SELECT a.msa_id, a.k, a.n_match, a.n_delete, CASE WHEN w IS NULL THEN 0 WHEN b.k IS NULL THEN least(least(20, a.e * exp(0.5 * (1 - w) * ln(w))), a.most) ELSE greatest(1, least(least(20, b.e * exp(0.5 * (1 - w) * ln(w))), b.most)) END AS n_insert
  FROM o3 a LEFT JOIN o3 b ON b.msa_id = a.msa_id AND b.k = a.k + 1 LEFT JOIN ins ON ins.msa_id = a.msa_id AND ins.k = a.k)"""


@query("d15_observations", f"WITH {_TARGET_STEPS_SQL} SELECT msa_id, k, round(n_match, 5) + 0.0 AS n_match, round(n_insert, 5) + 0.0 AS n_insert, round(n_delete, 5) + 0.0 AS n_delete FROM o4")
def d15_observations(spark, sf_dir):
    """Observations of the match, insert and delete states of every match column."""
    own = msa.state_weights(cells(spark, sf_dir)).withColumn("k", F.row_number().over(Window.partitionBy("msa_id").orderBy("pos")).cast("long"))
    return own.select("msa_id", "k", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("n_match", "n_insert", "n_delete")))


@query("d15_target_transitions", f"""WITH {_STEPS_SQL.replace('WITH ', '')}, o AS (SELECT msa_id, k, max(pos) OVER (PARTITION BY msa_id) AS q, k % 5 + 1.0 AS n_match, k % 3 AS n_insert, k % 4 * 0.5 AS n_delete, max(k) OVER (PARTITION BY msa_id) AS last FROM (SELECT msa_id, pos, ms AS k FROM col WHERE m = 1)),
g AS (SELECT o.msa_id, o.k, o.last, a.step, a.alpha, coalesce(s.frequency, 0) AS f, CASE substr(a.step, 1, 1) WHEN 'M' THEN greatest(n_match - 1, 0) WHEN 'I' THEN n_insert ELSE n_delete END AS n FROM o CROSS JOIN {_ALPHA_ROWS} LEFT JOIN steps s ON s.msa_id = o.msa_id AND s.k = o.k AND s.step = a.step),
p AS (SELECT msa_id, k, step, CASE WHEN k = last THEN (step[2] = 'M')::INT ELSE (f * n + alpha) / sum(f * n + alpha) OVER (PARTITION BY msa_id, k, substr(step, 1, 1)) END AS p FROM g
UNION ALL SELECT DISTINCT msa_id, 0, a.step, (a.step[2] = 'M')::INT FROM o CROSS JOIN {_ALPHA_ROWS}) SELECT msa_id, k, step, round(p, 6) + 0.0 AS p FROM p""")
def d15_target_transitions(spark, sf_dir):
    """Target transitions at every match column, with observations by a rule."""
    own = cells(spark, sf_dir)
    at = msa.query_cells(own).filter("code <= 23").withColumn("k", F.row_number().over(Window.partitionBy("msa_id").orderBy("pos")).cast("long"))
    obs = at.select("msa_id", "k", (F.col("k") % 5 + 1.0).alias("n_match"), (F.col("k") % 3).cast("double").alias("n_insert"), (F.col("k") % 4 * 0.5).alias("n_delete"))
    return pr.target_transitions(msa.transition_counts(own, msa.global_weights(own)), obs).withColumn("p", r6(F.col("p")))


@query("d33_profiles")
def d33_profiles(spark, sf_dir):
    """Profiles constructed from all alignments: targets, information, transitions, background of each position."""
    rows = construct.constructed(cells(spark, sf_dir), 0.5, RATIOS)
    return rows.select(
        "profile_id", "pos", "aa", "len", "n_seqs", r6(F.col("eff_nos")).alias("eff_nos"), r6(F.array_max("trg")).alias("largest"), r6(F.col("information")).alias("information"),
        r6(F.element_at("trn", 1)).alias("to_match"), r6(F.array_max("bkg")).alias("bkg"),
    )


@query("j6_identity_order", f"""WITH {CELLS_SQL}, q AS (SELECT cell.msa_id, pos, code AS qc, seq_id AS qid FROM cell JOIN (SELECT msa_id, min(seq_id) AS seq_id FROM cell GROUP BY 1) USING (msa_id, seq_id) WHERE code <= 23),
i AS (SELECT c.msa_id, c.seq_id, count(*) FILTER (code = qc) / count(*) FILTER (qc < 20)::DOUBLE AS identity FROM cell c JOIN q USING (msa_id, pos) WHERE code < 20 GROUP BY ALL)
SELECT s.msa_id, s.seq_id, round(coalesce(identity, 0), 6) + 0.0 AS identity, row_number() OVER (PARTITION BY s.msa_id ORDER BY (s.seq_id <> m)::INT, coalesce(identity, 0) DESC, s.seq_id)::INT AS rank
FROM (SELECT DISTINCT msa_id, seq_id, min(seq_id) OVER (PARTITION BY msa_id) AS m FROM cell) s LEFT JOIN i USING (msa_id, seq_id)""")
def j6_identity_order(spark, sf_dir):
    return msa.identity_order(cells(spark, sf_dir)).withColumn("identity", r6(F.col("identity")))


@query("f8_window_probability", """WITH w AS (SELECT user_id, event_id, row_number() OVER o AS loc, count(*) OVER (PARTITION BY user_id) AS n, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS win FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT user_id, event_id, s, count(*) AS c FROM (SELECT user_id, event_id, unnest(win) AS s FROM w WHERE loc + 11 <= n) GROUP BY ALL),
r AS (SELECT user_id, event_id, c, count(*) AS r FROM c GROUP BY ALL), g AS (SELECT user_id, event_id, sum(r) AS used, sum(r * lgamma(c + 1)) AS facts, sum(lgamma(r + 1)) AS shared FROM r GROUP BY ALL)
SELECT user_id, event_id, round(lgamma(13) - facts + lgamma(6) - lgamma(5 - used + 1) - shared - 12 * ln(5), 6) + 0.0 AS log_p FROM g""")
def f8_window_probability(spark, sf_dir):
    """Log probability of the composition of each window of twelve events that starts at an event (F4, F8)."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kinds = ("view", "signup", "error", "click", "purchase")
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.collect_list("event_type").over(own.rowsBetween(0, 11)).alias("win"),
    ).filter(F.size("win") == 12)
    counts = F.array(*(_times(k) for k in kinds))

    @F.pandas_udf("double")
    def log_p(c: pd.Series) -> pd.Series:
        return pd.Series(segments.log_probabilities(np.stack(c.to_numpy()).astype(int), 12, 5) if len(c) else [], dtype=float)

    return rows.select("user_id", "event_id", r6(log_p(counts)).alias("log_p"))


def _times(kind: str):
    return F.size(F.filter("win", lambda x: x == kind))


# ------------------------------------------------------------ terms of the score

_GRID_SQL = "(CASE WHEN k // 3 = k % 3 THEN 1 ELSE -1 END * (1 + least(floor(9.999 * x.ss[k // 3 + 1]), floor(9.999 * y.ss[k % 3 + 1]))) / 10)"
_SS_SQL = f"0.12 * (list_sum(list_transform(generate_series(0, 8), lambda k: x.ss[k // 3 + 1] * y.ss[k % 3 + 1] * {_GRID_SQL})) + (x.ss[3] + 0.1) * (y.ss[3] + 0.1) / 9 - 0.05)"
_PRIOR_SQL = "((0.5 * 19 - 10) * (ln(0.1) - ln(1.1)) - 10 * ln(norm2 + 11))"
_CV_CONSTANT = "((0.5 * 19 - 10.5) * (ln(0.1) - ln(2.1)) + (SELECT sum(ln((20 - i) / 2)) FROM (SELECT unnest(generate_series(1, 19))::DOUBLE AS i)))"
_CV_SQL = f"({_CV_CONSTANT} - 10.5 * ln((x.norm2 + 11) * (y.norm2 + 11) - pow(list_sum(list_transform(generate_series(1, 19), lambda i: x.cv[i] * y.cv[i])) + 10, 2)) - x.prior - y.prior)"
_FULL_SQL = f"""{PROFILES_SQL}, n2 AS (SELECT *, list_sum(list_transform(cv, lambda v: v * v)) AS norm2 FROM prof), fullp AS (SELECT n2.*, {_PRIOR_SQL} AS prior, (pos * 7 + profile_id) % 12 AS cluster, trg[1] AS cluster_p, round(avg(eno) OVER (PARTITION BY profile_id), 6) AS e FROM n2)"""
KEYS = np.arange(-5, 88) / 2
VALUES = KEYS / 5.0
STATES = np.arange(30)
GRID = np.where(STATES[:, None] // 10 == STATES[None, :] // 10, 1.0, -1.0) * (1 + np.minimum(STATES[:, None] % 10, STATES[None, :] % 10)) / 10
CLUSTERS = np.array([[-100.0 if (a + b) % 11 == 0 else a * b % 7 / 5.0 - 0.4 for b in range(12)] for a in range(12)])


def full_profiles(spark, sf_dir) -> DataFrame:
    """Profiles with all fields that score terms use."""
    own = profiles(spark, sf_dir).withColumn("norm2", pr.dot(F.col("cv"), F.col("cv")))
    return own.select(
        "*", pr.context_prior(F.col("norm2")).alias("prior"), ((F.col("pos") * 7 + F.col("profile_id")) % 12).cast("double").alias("cluster"), F.element_at("trg", 1).alias("cluster_p"),
        F.round(F.avg("eno").over(Window.partitionBy("profile_id")), 6).alias("eno_profile"),
    )


def packed_full(spark, sf_dir) -> DataFrame:
    own = full_profiles(spark, sf_dir)
    return search.packed(own.join(backgrounds(own), "profile_id").withColumn("trn", log_transitions()))


def _totals(spark, sf_dir, fields: list[str], matrix, whole: str, digits: dict[str, int]) -> DataFrame:
    """Sum (or mean), largest and least value of a score's matrix of every pair of profiles (query before target), tile by tile."""

    def made(q, t):
        v = matrix(q, t)
        return [float(v.sum())], [float(v.max())], [float(v.min())], [v.size]

    own = full_profiles(spark, sf_dir)
    rows = pairs.tiles(own, fields, made, "total double, largest double, least double, cells long").groupBy("q_id", "t_id")
    total = F.sum("total") / F.sum("cells") if whole == "mean" else F.sum("total")
    values = {whole: total, "largest": F.max("largest"), "least": F.min("least")}
    return rows.agg(*((F.round(values[c], n) + F.lit(0.0)).alias(c) for c, n in digits.items()))


@query("e9_ss_scores", f"WITH {_FULL_SQL} SELECT x.profile_id AS q_id, y.profile_id AS t_id, round(sum({_SS_SQL}), 4) + 0.0 AS total, round(max({_SS_SQL}), 6) + 0.0 AS largest FROM fullp x JOIN fullp y ON x.profile_id < y.profile_id GROUP BY ALL")
def e9_ss_scores(spark, sf_dir):
    """Secondary-structure scores of all pairs; the state table follows a rule."""
    return _totals(spark, sf_dir, ["ss"], lambda q, t: scoring.ss_matrix(q["ss"], t["ss"], GRID), "total", {"total": 4, "largest": 6})


@query("e11_context_scores", f"WITH {_FULL_SQL}, s AS (SELECT x.profile_id AS q_id, y.profile_id AS t_id, {_CV_SQL} AS v FROM fullp x JOIN fullp y ON x.profile_id < y.profile_id) SELECT q_id, t_id, round(avg(v), 5) + 0.0 AS mean, round(max(v), 5) + 0.0 AS largest, round(min(v), 5) + 0.0 AS least FROM s GROUP BY ALL")
def e11_context_scores(spark, sf_dir):
    """Log odds of context vectors of all pairs of positions."""
    odds = lambda q, t: scoring.cv_statistic(q["cv"], t["cv"], q["norm2"], t["norm2"], q["prior"], t["prior"])
    return _totals(spark, sf_dir, ["cv", "norm2", "prior"], odds, "mean", {"mean": 5, "largest": 5, "least": 5})


_CLUSTER_SQL = """CASE WHEN (x.cluster + y.cluster) % 11 = 0 THEN 0 ELSE (x.cluster * y.cluster % 7 / 5.0 - 0.4) * (0.4 + 0.6 * exp(-1.5e-5 * (0.47 * pow(x.e - 23, 4) + 0.47 * pow(y.e - 23, 4) + 2 * 0.47 * pow(x.e - 23, 2) * pow(y.e - 23, 2))))
  * exp(-7.5 * (0.37 * pow(x.cluster_p - 1, 2) + 0.37 * pow(y.cluster_p - 1, 2) + 2 * 1.17 * (x.cluster_p - 1) * (y.cluster_p - 1))) END"""


@query("e13_cluster_scores", f"WITH {_FULL_SQL}, s AS (SELECT x.profile_id AS q_id, y.profile_id AS t_id, 1e6 * {_CLUSTER_SQL} AS v FROM fullp x JOIN fullp y ON x.profile_id < y.profile_id) SELECT q_id, t_id, round(sum(v), 3) + 0.0 AS total, round(max(v), 4) + 0.0 AS largest, round(min(v), 4) + 0.0 AS least FROM s GROUP BY ALL")
def e13_cluster_scores(spark, sf_dir):
    """Cluster scores of all pairs, in millionths; the cluster table follows a rule."""
    score = lambda q, t: 1e6 * scoring.cluster_matrix(q["cluster"], t["cluster"], q["cluster_p"], t["cluster_p"], q["eno"], t["eno"], CLUSTERS)
    return _totals(spark, sf_dir, ["cluster", "cluster_p", "eno_profile"], score, "total", {"total": 3, "largest": 4, "least": 4})


TERMS = scoring.Terms(ss_table=GRID, cv_keys=KEYS, cv_values=VALUES, hdp_table=CLUSTERS)
_FUSED_SQL = f"""{_FULL_SQL}, bkg AS (SELECT profile_id, list(p ORDER BY code) AS b FROM post GROUP BY 1), fb AS (SELECT fullp.*, b FROM fullp JOIN bkg USING (profile_id)),
raw AS (SELECT x.profile_id AS q_id, y.profile_id AS t_id, x.pos AS i, y.pos AS j, ln(list_sum(list_transform(generate_series(1, 20), lambda k: x.trg[k] * y.trg[k] / ((x.b[k] + y.b[k]) / 2)))) - 0.002 AS base, {_SS_SQL} AS s, {_CV_SQL} AS v, {_CLUSTER_SQL} AS h FROM fb x JOIN fb y ON x.profile_id < y.profile_id),
fused AS (SELECT q_id, t_id, i, j, s + 0.15 * greatest(least(round_even(2 * v, 0) / 2, 43.5), -2.5) / 5 AS m, base, h FROM raw), terms AS (SELECT q_id, t_id, i, j, base + m + 0.33 * 0.45 * h AS score, m - 0.5 * 0.15 AS modular FROM fused)"""


@query("e16_fused_scores", f"WITH {_FUSED_SQL} SELECT q_id, t_id, round(sum(score), 3) + 0.0 AS total, round(max(score), 5) + 0.0 AS largest, round(min(score), 5) + 0.0 AS least, round(sum(modular), 3) + 0.0 AS modular FROM terms GROUP BY ALL")
def e16_fused_scores(spark, sf_dir):
    """The whole score of all pairs (base, secondary structure, context, clusters), and its modular part."""

    def made(q, t):
        s, m = scoring.score_matrices(q, t, TERMS)
        return [float(s.sum())], [float(s.max())], [float(s.min())], [float(m.sum())]

    own = full_profiles(spark, sf_dir)
    fields = ["trg", "ss", "cv", "norm2", "prior", "cluster", "cluster_p", "bkg", "eno_profile"]
    rows = pairs.tiles(own.join(backgrounds(own), "profile_id"), fields, made, "total double, largest double, least double, modular double").groupBy("q_id", "t_id")
    values = {"total": (F.sum("total"), 3), "largest": (F.max("largest"), 5), "least": (F.min("least"), 5), "modular": (F.sum("modular"), 3)}
    return rows.agg(*((F.round(v, n) + F.lit(0.0)).alias(c) for c, (v, n) in values.items()))


@query("j8_best_cells", f"WITH {_SCORES_SQL} SELECT q_id, t_id, round(max(score), 6) + 0.0 AS score, arg_max(i * 1000 + j, (round(score, 6), -i, -j))::BIGINT AS cell FROM sc GROUP BY ALL")
def j8_best_cells(spark, sf_dir):
    """The largest score of each pair and its first cell."""
    best = pairs.best_cells(scored_positions(spark, sf_dir))
    return best.select("q_id", "t_id", "score", (F.col("i") * 1000 + F.col("j")).alias("cell"))


@query("h10_masked_histogram", f"""WITH {_SCORES_SQL}, h AS (SELECT q_id, t_id, round_even(greatest(least(round(score, 6), 10), -10) * 32, 0)::INT AS bin, count(*) AS n FROM sc WHERE i % 7 <> 0 AND j % 5 <> 0 GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY q_id, t_id), 6) + 0.0 AS p FROM h""")
def h10_masked_histogram(spark, sf_dir):
    """Score histograms without the cells of masked positions (C11)."""
    own = scored_positions(spark, sf_dir).withColumn("q_known", F.col("pos") % 7 != 0).withColumn("t_known", F.col("pos") % 5 != 0)
    return sig.probabilities(pairs.counts(own, "q_known", "t_known"), ["q_id", "t_id"]).withColumn("p", r6(F.col("p")))


@query("c12_corners", """WITH s AS (SELECT DISTINCT p_size + 20 AS m FROM part), p AS (SELECT a.m, b.m AS n, least(60, round_even(0.34 * greatest(a.m, b.m), 0))::INT AS edge FROM s a JOIN s b ON (a.m * 7 + b.m) % 13 = 0),
c AS (SELECT m, n, edge, y, unnest(generate_series(0, n - 1)) AS x FROM (SELECT *, unnest(generate_series(0, m - 1)) AS y FROM p))
SELECT m, n, count(*) FILTER ((y + edge >= m AND x <= edge + y - m) OR (x >= n - edge + y AND y < edge)) AS closed FROM c GROUP BY ALL""")
def c12_corners(spark, sf_dir):
    """Cells of the corners that alignments don't enter, for pairs of sizes."""
    sizes = table(spark, sf_dir, "part").select((F.col("p_size") + 20).alias("m")).distinct()
    pairs = sizes.join(sizes.withColumnRenamed("m", "n"), (F.col("m") * 7 + F.col("n")) % 13 == 0)

    @F.pandas_udf("long")
    def closed(m: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([int(al.corners(int(a), int(b)).sum()) for a, b in zip(m, n)], dtype="int64")

    return pairs.select("m", "n", closed("m", "n").alias("closed"))


@query("f12_profile_segments")
def f12_profile_segments(spark, sf_dir):
    """Low-complexity segments of profiles, their columns being symbols by classes."""
    return segments.seg_profiles(profiles(spark, sf_dir), distance=45.0, low=3.2, high=3.4)


# ----------------------------------------------------------------- significance


@query("g13_dynamic_parameters", """WITH s AS (SELECT l_orderkey, l_linenumber, 10 - l_quantity AS le FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN le + 22 < 0 THEN 0.05 * exp(le + 22) ELSE 0.05 END, 9) + 0.0 AS lowered, round(CASE WHEN le + 22 < 0 THEN 0.9 * (1 - exp(le + 22)) ELSE 0 END, 9) + 0.0 AS times FROM s""")
def g13_dynamic_parameters(spark, sf_dir):
    """How realignment lowers scores and weighs their modular part, by the E-value of the pair."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (10 - F.col("l_quantity")).alias("le"))
    lowered, times = sig.dynamic_parameters(F.col("le"))
    return rows.select("l_orderkey", "l_linenumber", (F.round(lowered, 9) + F.lit(0.0)).alias("lowered"), (F.round(times, 9) + F.lit(0.0)).alias("times"))


@query("c8_survivors", f"""WITH s AS (SELECT o_orderkey, o_totalprice / 10000 AS score, o_custkey % 300 + 50 AS m, o_orderkey % 5 AS extra FROM orders), t AS (SELECT *, greatest(-ln(10 * 0.5 / {sig.K_GAPPED} / (m * 1e6)) / {sig.LAMBDA_GAPPED}, 0) AS thr FROM s)
SELECT o_orderkey, round(score + extra, 6) + 0.0 AS total, round(ln({sig.K_GAPPED} * m * 1e6) - {sig.LAMBDA_GAPPED} * (score + extra), 5) + 0.0 AS log_evalue FROM t WHERE score > thr AND score + extra > thr AND ln({sig.K_GAPPED} * m * 1e6) - {sig.LAMBDA_GAPPED} * (score + extra) <= ln(0.5)""")
def c8_survivors(spark, sf_dir):
    """Scores above the threshold of an E-value, before and with the bonus, and then below the E-value (C8, C9, C10, H33)."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 10000).alias("score"), (F.col("o_custkey") % 300 + 50).alias("m"), (F.col("o_orderkey") % 5).alias("extra"))
    rows = rows.withColumn("thr", sig.score_threshold(0.5, F.col("m"), F.lit(1e6))).withColumn("total", F.col("score") + F.col("extra"))
    rows = rows.filter((F.col("score") > F.col("thr")) & (F.col("total") > F.col("thr"))).withColumn("log_evalue", sig.log_evalue(F.col("total"), F.col("m") * F.lit(1e6)))
    return rows.filter(F.col("log_evalue") <= math.log(0.5)).select("o_orderkey", r6(F.col("total")).alias("total"), (F.round("log_evalue", 5) + F.lit(0.0)).alias("log_evalue"))


@query("h18_score_probabilities", f"""WITH {PROFILES_SQL}, s AS (SELECT profile_id, round_even(round(ln(q / prior) / 0.25, 6), 0)::INT AS score, prior FROM longp JOIN {BKG_ROWS} USING (code)), n AS (SELECT profile_id, count(*) AS n FROM prof GROUP BY 1)
SELECT s.profile_id, score, round(sum(prior) / any_value(n), 6) + 0.0 AS p FROM s JOIN n USING (profile_id) GROUP BY ALL""")
def h18_score_probabilities(spark, sf_dir):
    """Probabilities of each profile's whole-number scores against the background."""
    score = pr.scores(F.col("trg"), F.array(*(F.lit(p) for p in BACKGROUND)), 0.25)
    rows = profiles(spark, sf_dir).select("profile_id", F.transform(score, lambda x: F.round(x, 6)).alias("score"))
    return sig.profile_score_probabilities(rows, BACKGROUND).withColumn("p", r6(F.col("p")))


def _act(x: str) -> str:
    return f"(2 / (1 + exp(-({x}))) - 1)"


def _network_sql(inputs: list[str], f: str, g: str, factor: float, shift: int) -> str:
    """A network with hidden weights f(k + shift) and output weights g(k + 1 + shift)."""
    hidden = [_act(" + ".join([f"{f}({5 * j + shift})", *(f"{f}({5 * j + 1 + i + shift}) * {x}" for i, x in enumerate(inputs))])) for j in range(4)]
    return f"{factor} * " + _act(" + ".join([f"{g}({1 + shift})", *(f"{g}({j + 2 + shift}) * {h}" for j, h in enumerate(hidden))]))


def _weights(shift: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cos(np.arange(20) + shift).reshape(4, 5), np.sin(np.arange(5) + 1 + shift).reshape(1, 5)


ADJUST = {"mu_e": (0.9, 0.2), "mu_s": (1.1, -0.3), "scale_e": (0.1, 0.4), "scale_s": 0.3, "alpha": 0.6, "beta": 0.4}
MODEL = sig.ScoreModel(_weights(0), _weights(3), _weights(5), ADJUST)
_SIZES_SQL = f"""{PROFILES_SQL}, m AS (SELECT profile_id, round(avg(eno), 6) AS e, count(*) AS n FROM prof GROUP BY 1),
pp AS (SELECT x.profile_id AS q_id, y.profile_id AS t_id, x.n AS n1, y.n AS n2, x.e < y.e OR (x.e = y.e AND x.n < y.n) AS sw, x.e AS e1, y.e AS e2, (x.profile_id + y.profile_id) % 4 * 0.4 - 0.1 AS lam FROM m x JOIN m y ON x.profile_id < y.profile_id),
inp AS (SELECT *, CASE WHEN sw THEN e2 ELSE e1 END * 0.05 AS x1, ln(CASE WHEN sw THEN n2 ELSE n1 END) / ln(1000) AS x2, CASE WHEN sw THEN e1 ELSE e2 END * 0.05 AS x3, ln(CASE WHEN sw THEN n1 ELSE n2 END) / ln(1000) AS x4,
  0.2 * CASE WHEN round_even(round(lam * 10, 6), 0) / 10 <= 0 THEN 0.1 WHEN round_even(round(lam * 10, 6), 0) / 10 > 10 THEN 10 ELSE round_even(round(lam * 10, 6), 0) / 10 END AS y1, ln(greatest(n1, n2)) / ln(1000) AS y2, ln(least(n1, n2)) / ln(1000) AS y3 FROM pp)"""


def pair_sizes(spark, sf_dir) -> DataFrame:
    own = profiles(spark, sf_dir).groupBy("profile_id").agg(F.round(F.avg("eno"), 6).alias("e"), F.count("*").alias("n"))
    one, two = (own.select(*(F.col(c).alias(f"{c}_{s}") for c in own.columns)) for s in "qt")
    rows = one.join(two, F.col("profile_id_q") < F.col("profile_id_t"))
    lam = F.round((F.col("profile_id_q") + F.col("profile_id_t")) % 4 * 0.4 - 0.1, 6)
    return rows.select(F.col("profile_id_q").alias("q_id"), F.col("profile_id_t").alias("t_id"), F.col("e_q").alias("query_eno"), F.col("e_t").alias("target_eno"), F.col("n_q").alias("query_len"), F.col("n_t").alias("target_len"), lam.alias("lambda"))


@query("h21_network", f"WITH {_SIZES_SQL} SELECT q_id, t_id, round({_network_sql(['x1', 'x2', 'x3', 'x4'], 'cos', 'sin', 30.0, 0)}, 6) + 0.0 AS mu FROM inp")
def h21_network(spark, sf_dir):
    """Predictions of a two-layer network with weights by a rule, for all pairs of profiles."""
    x = sig.network_inputs(*(F.col(c) for c in ("query_eno", "query_len", "target_eno", "target_len")))

    @F.pandas_udf("double")
    def predicted(x: pd.Series) -> pd.Series:
        return pd.Series(sig.network(np.stack(x.to_numpy()), *_weights(0))[:, 0] if len(x) else [], dtype=float)

    return pair_sizes(spark, sf_dir).select("q_id", "t_id", r6(predicted(x)).alias("mu"))


@query("h24_score_inputs", f"WITH {_SIZES_SQL} SELECT q_id, t_id, round(y1, 6) + 0.0 AS y1, round(y2, 6) + 0.0 AS y2, round(y3, 6) + 0.0 AS y3 FROM inp")
def h24_score_inputs(spark, sf_dir):
    y = sig.score_inputs(F.col("lambda"), F.col("query_len"), F.col("target_len"))
    rows = pair_sizes(spark, sf_dir).withColumn("y", y)
    return rows.select("q_id", "t_id", *(r6(F.element_at("y", i)).alias(f"y{i}") for i in (1, 2, 3)))


@query("h25_extreme_value_parameters", f"""WITH {_SIZES_SQL}, nn AS (SELECT q_id, t_id, lam, {_network_sql(['x1', 'x2', 'x3', 'x4'], 'cos', 'sin', 30.0, 0)} AS a, {_network_sql(['y1', 'y2', 'y3'], 'cos', 'sin', 30.0, 3)} AS b, {_network_sql(['y1', 'y2', 'y3'], 'cos', 'sin', 5.0, 5)} AS c FROM inp),
c1 AS (SELECT q_id, t_id, lam, greatest(a, 3) AS a, greatest(b, 3) AS b, least(greatest(0.3 * (exp(greatest(c, 0.1)) - 1), 0.1), 5) AS c FROM nn),
c2 AS (SELECT *, least(greatest(0.1 * a + 0.4, 0.1), 5) AS s, 0.6 - 0.6 * 0.1 * CASE WHEN lam > 0 THEN least(10, 1 / lam) ELSE 0 END AS al, 0.4 + 0.6 * 0.1 * CASE WHEN lam > 0 THEN least(10, 1 / lam) ELSE 0 END AS be FROM c1)
SELECT q_id, t_id, round(al * (0.9 * a + 0.2) + (1 - al) * (1.1 * b - 0.3), 6) + 0.0 AS mu, round((1 - be) * s + be * c, 6) + 0.0 AS scale FROM c2""")
def h25_extreme_value_parameters(spark, sf_dir):
    """Location and scale of the score distribution of all pairs from three networks with weights by a rule (H22, H25)."""
    return sig.with_parameters(pair_sizes(spark, sf_dir), MODEL).select("q_id", "t_id", r6(F.col("mu")).alias("mu"), r6(F.col("scale")).alias("scale"))


@query("h34_length_adjustment", f"""WITH t AS (SELECT sum(n_chars) AS n, count(*) AS k FROM documents), d AS (SELECT DISTINCT n_chars + 700 AS m FROM documents), l AS (SELECT m, n, k, unnest(generate_series(0, 60)) AS l FROM d CROSS JOIN t)
SELECT m, max(l) FILTER (l <= {sig.ALPHA} / {sig.LAMBDA_GAPPED} * ln({sig.K_GAPPED} * (m - l) * (n - k * l)::DOUBLE) + {sig.BETA})::INT AS adjustment FROM l GROUP BY ALL""")
def h34_length_adjustment(spark, sf_dir):
    """Length adjustment of every distinct length against all texts: the largest whole number that the fixed point isn't below."""
    docs = table(spark, sf_dir, "documents")
    total = docs.agg(F.sum("n_chars").alias("n"), F.count("*").alias("k")).first()

    @F.pandas_udf("int")
    def adjusted(m: pd.Series) -> pd.Series:
        return pd.Series([sig.length_adjustment(int(x), total["n"], total["k"]) for x in m], dtype="int32")

    return docs.select((F.col("n_chars") + 700).alias("m")).distinct().withColumn("adjustment", adjusted("m"))


@query("g3_full_search")
def g3_full_search(spark, sf_dir):
    """All profiles against all with every score term, an E-value threshold, and extreme-value statistics by a model."""
    own = packed_full(spark, sf_dir)
    size = own.agg(F.sum("len").alias("n"), F.count("*").alias("k")).first()
    found = search.hits(own, own, terms=TERMS, cutoff=10.0, n_positions=int(size["n"]))
    out = search.top_hits(search.with_evalues(found, own, int(size["n"]), int(size["k"]), MODEL), cutoff=1e6)
    return out.select("query_id", "target_id", "rank", *(F.round(c, 4).alias(c) for c in ("score", "log_evalue", "mu", "scale")), "positives", "aln_len", "n_ident", "n_gaps")


# ------------------------------------------------------- mathematics, tables


@query("m2_combinatorics", """SELECT p_size, count(*) AS n, round(lgamma(p_size + 1), 6) + 0.0 AS log_factorial, round(lgamma(p_size + 11) - lgamma(p_size + 1) - lgamma(11), 6) + 0.0 AS log_binomial FROM part GROUP BY 1""")
def m2_combinatorics(spark, sf_dir):
    @F.pandas_udf("struct<f:double,b:double>")
    def values(size: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"f": special.log_gamma(size.to_numpy(float) + 1), "b": [special.log_binomial(x + 10, 10) for x in size]})

    rows = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n")).withColumn("v", values("p_size"))
    return rows.select("p_size", "n", r6(F.col("v.f")).alias("log_factorial"), r6(F.col("v.b")).alias("log_binomial"))


_SYSTEM_SQL = "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, l_discount * 10 + 1 AS b, l_tax * 10 - 2 AS c, l_extendedprice / 10000 + 3 AS d FROM lineitem"


def _systems(spark, sf_dir) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_quantity") + 1).alias("a"), (c("l_discount") * 10 + 1).alias("b"), (c("l_tax") * 10 - 2).alias("c"), (c("l_extendedprice") / 10000 + 3).alias("d"))


@query("n4_linear_systems", f"""WITH s AS ({_SYSTEM_SQL}) SELECT l_orderkey, l_linenumber, round((5 * d - 7 * b) / (a * d - b * c), 6) + 0.0 AS x, round((7 * a - 5 * c) / (a * d - b * c), 6) + 0.0 AS y, round(ln(abs(a * d - b * c)), 6) + 0.0 AS log_det, round(d / (a * d - b * c), 6) + 0.0 AS inverse FROM s""")
def n4_linear_systems(spark, sf_dir):
    """Systems of two unknowns solved by LU factors, with log determinants and inverses."""

    def solved(batches):
        for b in batches:
            if len(b):
                m, right = b[["a", "b", "c", "d"]].to_numpy().reshape(-1, 2, 2), np.broadcast_to(np.array([[5.0], [7.0]]), (len(b), 2, 1))
                x = linear.solve(m, right)
                out = {"x": x[:, 0, 0], "y": x[:, 1, 0], "log_det": linear.log_determinant(m)[1], "inverse": linear.inverse(m)[:, 0, 0]}
                yield b[["l_orderkey", "l_linenumber"]].assign(**{k: np.round(v, 6) + 0.0 for k, v in out.items()})

    return _systems(spark, sf_dir).mapInPandas(solved, "l_orderkey long, l_linenumber int, x double, y double, log_det double, inverse double")


@query("n5_positive_definite", f"""WITH s AS ({_SYSTEM_SQL}), p AS (SELECT l_orderkey, l_linenumber, a * a + b * b + 1 AS e, a * c + b * d AS f, c * c + d * d + 1 AS g FROM s) SELECT l_orderkey, l_linenumber, round((5 * g - 7 * f) / (e * g - f * f), 6) + 0.0 AS x, round(ln(e * g - f * f), 6) + 0.0 AS log_det FROM p""")
def n5_positive_definite(spark, sf_dir):
    """Positive definite systems by Cholesky factors."""

    def solved(batches):
        for b in batches:
            if len(b):
                m = b[["a", "b", "c", "d"]].to_numpy().reshape(-1, 2, 2)
                m = m @ np.swapaxes(m, -1, -2) + np.eye(2)
                x = linear.cholesky_solve(m, np.broadcast_to(np.array([[5.0], [7.0]]), (len(b), 2, 1)))
                yield b[["l_orderkey", "l_linenumber"]].assign(x=np.round(x[:, 0, 0], 6) + 0.0, log_det=np.round(linear.cholesky_log_determinant(m), 6) + 0.0)

    return _systems(spark, sf_dir).mapInPandas(solved, "l_orderkey long, l_linenumber int, x double, log_det double")


@query("n3_products", f"""WITH s AS ({_SYSTEM_SQL}) SELECT l_orderkey, l_linenumber, round(a * a + b * c, 9) + 0.0 AS square, round(a * b + b * d, 9) + 0.0 AS corner, round(a * 2 + b * 3 - (c * 2 + d * 3), 9) + 0.0 AS centred, round(b * 2, 9) + 0.0 AS kron FROM s""")
def n3_products(spark, sf_dir):
    """Products, centring and Kronecker products of small matrices."""

    def made(batches):
        for b in batches:
            if len(b):
                m = b[["a", "b", "c", "d"]].to_numpy().reshape(-1, 2, 2)
                square, v = m @ m, m @ np.array([[2.0], [3.0]])
                out = {"square": square[:, 0, 0], "corner": square[:, 0, 1], "centred": 2 * (linear.centring(2) @ v)[:, 0, 0], "kron": linear.kronecker(m, np.array([[0.0, 1.0], [2.0, 0.0]])[None])[:, 1, 2]}
                yield b[["l_orderkey", "l_linenumber"]].assign(**{k: np.round(x, 9) + 0.0 for k, x in out.items()})

    return _systems(spark, sf_dir).mapInPandas(made, "l_orderkey long, l_linenumber int, square double, corner double, centred double, kron double")


@query("a26_state_table", """WITH r AS (SELECT unnest(generate_series(0, 29)) AS a), p AS (SELECT x.a, y.a AS b FROM r x CROSS JOIN r y) SELECT a::INT AS a, b::INT AS b, CASE WHEN (greatest(a, b) + least(a, b)) % 13 = 0 THEN -99.0 ELSE round(least(a, b) / 10.0 - greatest(a, b) / 20.0, 4) + 0.0 END AS score FROM p""")
def a26_state_table(spark, sf_dir):
    """A triangular score table written as text and read back."""
    body = "\n".join(" ".join("+" if (i + j) % 13 == 0 else f"{j / 10 - i / 20:.4f}" for j in range(i + 1)) for i in range(30))
    read = tables.triangle(f"scores\n## a table by a rule\nCardinality = 30\n{body}\n")
    return spark.createDataFrame([(i, j, float(read[i, j])) for i in range(30) for j in range(30)], "a int, b int, score double")


@query("a27_step_table", """WITH k AS (SELECT unnest(generate_series(0, 40)) AS i), v AS (SELECT i / 2.0 - 3 AS key, CASE WHEN i % 9 <> 4 THEN i * i / 100.0 END AS value FROM k), p AS (SELECT *, row_number() OVER (ORDER BY key) AS r, count(*) OVER () AS n FROM v WHERE value IS NOT NULL),
s AS (SELECT p.key, avg(o.value) AS s FROM p JOIN p o ON o.r BETWEEN least(greatest(p.r, 3), p.n - 2) - 2 AND least(greatest(p.r, 3), p.n - 2) + 2 GROUP BY 1) SELECT v.key::DOUBLE AS key, round(coalesce(s, (SELECT s.s FROM s WHERE s.key < v.key ORDER BY s.key DESC LIMIT 1)), 6) + 0.0 AS value FROM v LEFT JOIN s ON s.key = v.key""")
def a27_step_table(spark, sf_dir):
    """A step table with missing values read from text, smoothed and filled."""
    keys, values = " ".join(f"{i / 2 - 3:.1f}" for i in range(41)), " ".join("+" if i % 9 == 4 else f"{i * i / 100:.4f}" for i in range(41))
    k, v = tables.steps(f"table\nDimensions = 19\nCardinality = 41\n{keys}\n{values}\n")
    return spark.createDataFrame([(float(a), round(float(b), 6)) for a, b in zip(k, v)], "key double, value double")


@query("a16_chunks", """WITH s AS (SELECT doc_id, n_chars AS len FROM documents WHERE n_chars <= 5000), b AS (SELECT *, floor(coalesce(sum(len) OVER (ORDER BY len DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 5000) AS part FROM s),
t AS (SELECT *, floor((row_number() OVER (PARTITION BY part ORDER BY len DESC, doc_id) - 1) / 4) AS turn FROM b) SELECT doc_id, len, (dense_rank() OVER (ORDER BY part, turn) - 1)::INT AS chunk FROM t""")
def a16_chunks(spark, sf_dir):
    """Rows dealt to chunks of bounded size and number, longest first."""
    return formats.chunked(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("len")), "doc_id", "len", 5000, 4).withColumn("chunk", F.col("chunk").cast("int"))


@query("c15_descriptions", r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^[ \t\n\r]+', ''), '[ \t]+', ' ', 'g') AS d FROM documents) SELECT doc_id, CASE WHEN length(d) >= 60 THEN substr(d, 1, 57) || '...' ELSE d END AS line FROM t""")
def c15_descriptions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", formats.described(F.col("text"), 60).alias("line"))


@query("j4_length_order", "SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents")
def j4_length_order(spark, sf_dir):
    """Rows in the order a database is written: longest first."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return convert.numbered(rows, [F.desc("n_chars"), F.col("doc_id")], "rank").withColumn("rank", F.col("rank").cast("int"))


@query("b7_database_header", f"WITH {PROFILES_SQL} SELECT count(DISTINCT profile_id) AS n_profiles, count(*) AS n_positions FROM prof")
def b7_database_header(spark, sf_dir):
    return formats.database_header(profiles(spark, sf_dir).withColumn("name", F.col("profile_id").cast("string")))


@query("o2_conflicts", """WITH p AS (SELECT doc_id, string_split(lang || source, '') AS q FROM documents), c AS (SELECT doc_id, unnest(q) AS q, generate_subscripts(q, 1) AS loc FROM p),
k AS (SELECT *, sum((q <> 's')::INT) OVER (PARTITION BY doc_id ORDER BY loc) AS k FROM c) SELECT k::BIGINT AS q_pos, count(DISTINCT q) AS n FROM k WHERE q <> 's' GROUP BY 1 HAVING count(DISTINCT q) > 1""")
def o2_conflicts(spark, sf_dir):
    """Positions of a query that different hits show with different letters; the letter s is a gap."""
    rows = table(spark, sf_dir, "documents").select(F.lit(0).alias("query_id"), F.col("doc_id").alias("target_id"), F.lit(1).alias("q_from"), F.translate(F.concat("lang", "source"), "s", "-").alias("q_aln"))
    return convert.conflicting_positions(rows).select("q_pos", "n")


@query("o6_last_round", "SELECT conv_id, max(turn) AS turn, count(*) FILTER (turn = m) AS n FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) GROUP BY 1")
def o6_last_round(spark, sf_dir):
    """Rows of the last turn of each conversation, as hits of the last round are kept."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("round"))
    return formats.last_round(rows).groupBy(F.col("query_id").alias("conv_id")).agg(F.max("round").alias("turn"), F.count("*").alias("n"))
