"""The engine's queries over the driver's tables, each with its DuckDB SQL where there is one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.functions import special
from seqlake.functions.alphabet import ALPHABET, BACKGROUND, N_RESIDUES, decode, encode, encode_ss
from seqlake.functions.tables import written
from seqlake.operators import convert, hdp, msa, pairs, scoring, search, segments
from seqlake.operators import profiles as pr
from seqlake.operators import significance as sig
from seqlake.plans.adapters import (
    CELLS_SQL, PROFILES_SQL, WEIGHTS_SQL, backgrounds, cells, log_transitions, profiles, r6, symbols, table,
)
from seqlake.sources import formats

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BKG_LIST = "[" + ", ".join(map(repr, BACKGROUND)) + "]"
BKG_ROWS = "(VALUES " + ", ".join(f"({i}, {p!r}::DOUBLE)" for i, p in enumerate(BACKGROUND)) + ") AS b(code, prior)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# ------------------------------------------------------------------ symbols


@query("c1_encode", f"WITH {CELLS_SQL} SELECT msa_id, seq_id, string_agg(substr('{ALPHABET}', code + 1, 1), '' ORDER BY pos) AS residues, count(*) FILTER (code < 20) AS n_residues FROM cell GROUP BY ALL")
def c1_encode(spark, sf_dir):
    """Decode all sequences, and count the residues that survive a round trip through the encoder."""
    own = cells(spark, sf_dir).withColumn("code", encode(F.lower(decode(F.col("code")))))
    return msa.sequences(own)


@query("c4_ss_states", f"WITH {PROFILES_SQL} SELECT profile_id, pos, list_position(ss, list_max(ss)) - 1 AS state FROM prof")
def c4_ss_states(spark, sf_dir):
    letter = F.substring(F.lit("CEH"), F.array_position("ss", F.array_max("ss")).cast("int"), F.lit(1))
    return profiles(spark, sf_dir).select("profile_id", "pos", encode_ss(letter).alias("state"))


@query("c5_trim", f"""WITH {CELLS_SQL}, e AS (SELECT msa_id, seq_id, min(pos) FILTER (code <= 23) AS first_used, max(pos) FILTER (code <= 23) AS last_used, max(pos) AS n_cells FROM cell GROUP BY ALL)
SELECT msa_id, seq_id, first_used, last_used, CASE WHEN seq_id = min(seq_id) OVER (PARTITION BY msa_id) THEN n_cells ELSE coalesce(last_used - first_used + 1, 0) END AS n_used FROM e""")
def c5_trim(spark, sf_dir):
    return msa.trimmed(cells(spark, sf_dir))


@query("c6_match_columns", f"""WITH {CELLS_SQL}, q AS (SELECT msa_id, pos FROM cell JOIN (SELECT msa_id, min(seq_id) AS seq_id FROM cell GROUP BY 1) USING (msa_id, seq_id) WHERE code <= 23)
SELECT msa_id, pos, count(*) AS n FROM cell JOIN q USING (msa_id, pos) GROUP BY ALL""")
def c6_match_columns(spark, sf_dir):
    return msa.match_columns(cells(spark, sf_dir)).groupBy("msa_id", "pos").agg(F.count("*").alias("n"))


@query("c13_clamp", f"""WITH {PROFILES_SQL} SELECT profile_id, pos, count(*) FILTER (abs(x) >= 10) AS clamped, round(sum(greatest(least(x, 10), -10)), 6) + 0.0 AS total
FROM (SELECT profile_id, pos, unnest(cv) * 10 AS x FROM prof) GROUP BY ALL""")
def c13_clamp(spark, sf_dir):
    rows = profiles(spark, sf_dir).select("profile_id", "pos", F.explode("cv").alias("x")).withColumn("x", F.col("x") * 10)
    held = F.greatest(F.least("x", F.lit(10.0)), F.lit(-10.0))
    return rows.groupBy("profile_id", "pos").agg(F.count_if(F.abs("x") >= 10).alias("clamped"), r6(F.sum(held)).alias("total"))


# ------------------------------------------------- alignments (reduction)

_IDENTITY_SQL = f"""{CELLS_SQL}, res AS (SELECT * FROM cell WHERE code < 20), len AS (SELECT msa_id, seq_id, count(*) AS n FROM res GROUP BY ALL),
pair AS (SELECT a.msa_id, a.seq_id AS i, b.seq_id AS j, count(*) AS matches FROM res a JOIN res b ON a.msa_id = b.msa_id AND a.pos = b.pos AND a.code = b.code AND a.seq_id < b.seq_id GROUP BY ALL),
ident AS (SELECT pair.*, matches / least(x.n, y.n)::DOUBLE AS identity FROM pair JOIN len x ON x.msa_id = pair.msa_id AND x.seq_id = i JOIN len y ON y.msa_id = pair.msa_id AND y.seq_id = j)"""


@query("e22_identities", f"""WITH {CELLS_SQL}, q AS (SELECT msa_id, pos FROM cell JOIN (SELECT msa_id, min(seq_id) AS seq_id FROM cell GROUP BY 1) USING (msa_id, seq_id) WHERE code <= 23),
res AS (SELECT cell.* FROM cell JOIN q USING (msa_id, pos) WHERE code < 20),
pair AS (SELECT a.msa_id, a.seq_id AS i, b.seq_id AS j, count(*) AS overlap, count(*) FILTER (a.code = b.code) AS matches FROM res a JOIN res b ON a.msa_id = b.msa_id AND a.pos = b.pos AND a.seq_id < b.seq_id GROUP BY ALL)
SELECT msa_id, i, j, matches, overlap, round(matches / overlap::DOUBLE, 6) + 0.0 AS identity FROM pair WHERE matches > 0""")
def e22_identities(spark, sf_dir):
    return msa.identities(cells(spark, sf_dir)).withColumn("identity", r6(F.col("identity")))


@query("d3_neff", f"""WITH {_IDENTITY_SQL}, t AS (SELECT unnest([0.1, 0.15, 0.2, 0.62])::DOUBLE AS threshold), s AS (SELECT DISTINCT msa_id, seq_id FROM cell),
e AS (SELECT msa_id, i AS seq_id, identity FROM ident UNION ALL SELECT msa_id, j, identity FROM ident),
k AS (SELECT s.msa_id, s.seq_id, threshold, count(e.identity) FILTER (e.identity >= threshold) AS k FROM s CROSS JOIN t LEFT JOIN e ON e.msa_id = s.msa_id AND e.seq_id = s.seq_id GROUP BY ALL)
SELECT msa_id, count(*) AS n_seqs, threshold, round(sum(1.0::DOUBLE / (1 + k)), 6) + 0.0 AS neff FROM k GROUP BY msa_id, threshold""")
def d3_neff(spark, sf_dir):
    return msa.neff(cells(spark, sf_dir), [0.1, 0.15, 0.2, 0.62]).withColumn("neff", r6(F.col("neff")))


@query("d6_occupancy", f"WITH {CELLS_SQL} SELECT msa_id, pos, count(*) FILTER (code < 20) AS n_residues, count(*) FILTER (code = 24) AS n_gaps FROM cell GROUP BY ALL")
def d6_occupancy(spark, sf_dir):
    return msa.occupancy(cells(spark, sf_dir))


@query("d7_background", f"""WITH {CELLS_SQL}, q AS (SELECT * FROM cell JOIN (SELECT msa_id, min(seq_id) AS seq_id FROM cell GROUP BY 1) USING (msa_id, seq_id) WHERE code < 20),
n AS (SELECT msa_id, count(*) AS total FROM q GROUP BY 1), c AS (SELECT msa_id, code, count(*) AS k FROM q GROUP BY ALL)
SELECT n.msa_id, b.code, round((coalesce(k, 0) + 120 * prior / {sum(BACKGROUND)!r}) / (total + 120), 6) + 0.0 AS p FROM n CROSS JOIN {BKG_ROWS} LEFT JOIN c ON c.msa_id = n.msa_id AND c.code = b.code""")
def d7_background(spark, sf_dir):
    return msa.background(cells(spark, sf_dir)).withColumn("p", r6(F.col("p")))


@query("d9_weights", f"WITH {WEIGHTS_SQL} SELECT msa_id, seq_id, round(weight, 9) + 0.0 AS weight FROM weights")
def d9_weights(spark, sf_dir):
    return msa.global_weights(cells(spark, sf_dir)).withColumn("weight", F.round("weight", 9) + F.lit(0.0))


_ENTROPY_SQL = f"""{WEIGHTS_SQL}, mass AS (SELECT msa_id, pos, code, sum(weight) AS w, count(*) AS k FROM res JOIN weights USING (msa_id, seq_id) GROUP BY ALL),
prob AS (SELECT *, w / sum(w) OVER (PARTITION BY msa_id, pos) AS p FROM mass),
ent AS (SELECT msa_id, pos, sum(k) AS k, exp(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)) AS dist FROM prob GROUP BY ALL),
kept AS (SELECT msa_id, pos, dist FROM ent JOIN (SELECT msa_id, count(DISTINCT seq_id) AS n FROM cell GROUP BY 1) USING (msa_id) WHERE k >= n * 0.5)"""


@query("d10_distinct_residues", f"WITH {_ENTROPY_SQL} SELECT msa_id, pos, round(dist, 6) + 0.0 AS n_distinct FROM kept")
def d10_distinct_residues(spark, sf_dir):
    own = cells(spark, sf_dir)
    return msa.column_entropy(own, msa.global_weights(own)).select("msa_id", "pos", r6(F.col("distinct")).alias("n_distinct"))


@query("d20_median", """WITH h AS (SELECT lang, n_chars AS bin, count(*) AS n FROM documents GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY bin) AS cum, lead(bin) OVER (PARTITION BY lang ORDER BY bin) AS nxt, sum(n) OVER (PARTITION BY lang) AS total FROM h)
SELECT lang, CASE WHEN total % 2 = 0 AND cum * 2 = total AND nxt IS NOT NULL THEN (bin + nxt) / 2.0 ELSE bin::DOUBLE END AS median FROM c WHERE cum * 2 >= total AND (cum - n) * 2 < total""")
def d20_median(spark, sf_dir):
    return msa.histogram_median(table(spark, sf_dir, "documents"), "lang", "n_chars", 1.0)


@query("d18_neff_median", f"""WITH {PROFILES_SQL}, h AS (SELECT profile_id, round_even(n_obs * 1000, 0)::BIGINT AS bin, count(*) AS n FROM prof GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY profile_id ORDER BY bin) AS cum, lead(bin) OVER (PARTITION BY profile_id ORDER BY bin) AS nxt, sum(n) OVER (PARTITION BY profile_id) AS total FROM h)
SELECT profile_id, round(CASE WHEN total % 2 = 0 AND cum * 2 = total AND nxt IS NOT NULL THEN (bin + nxt) / 2.0 ELSE bin END / 1000, 6) + 0.0 AS median FROM c WHERE cum * 2 >= total AND (cum - n) * 2 < total""")
def d18_neff_median(spark, sf_dir):
    """Effective number of sequences of each profile: the median of its observations."""
    return msa.histogram_median(profiles(spark, sf_dir), "profile_id", "n_obs").withColumn("median", r6(F.col("median")))


_SPAN_SQL = """e AS (SELECT msa_id, seq_id, min(pos) FILTER (code <= 23) AS f, max(pos) FILTER (code <= 23) AS l FROM cell GROUP BY ALL),
qid AS (SELECT msa_id, min(seq_id) AS qid, max(pos) AS n_cols FROM cell GROUP BY 1),
col AS (SELECT cell.msa_id, pos, (code <= 23)::INT AS m, sum((code <= 23)::INT) OVER (PARTITION BY cell.msa_id ORDER BY pos) AS ms FROM cell JOIN qid ON qid.msa_id = cell.msa_id AND cell.seq_id = qid),
bnd AS (SELECT msa_id, min(pos) FILTER (m = 1) AS mb, max(pos) FILTER (m = 1) AS me FROM col GROUP BY 1),
pth AS (SELECT cell.msa_id, cell.seq_id, cell.pos, m, ms, (code <= 23 AND m = 1)::INT AS held, sum((code <= 23 AND m = 1)::INT) OVER (PARTITION BY cell.msa_id, cell.seq_id ORDER BY cell.pos) AS mp, f, l, mb, me, cell.seq_id = qid AS is_q
  FROM cell JOIN col ON col.msa_id = cell.msa_id AND col.pos = cell.pos JOIN e ON e.msa_id = cell.msa_id AND e.seq_id = cell.seq_id JOIN bnd ON bnd.msa_id = cell.msa_id JOIN qid ON qid.msa_id = cell.msa_id WHERE f IS NOT NULL),
pe AS (SELECT *, greatest(f, mb) AS lft, least(l, me) AS rgt, max(mp) FILTER (pos = mb) OVER s AS mp_b, max(held) FILTER (pos = mb) OVER s AS sres_b, max(mp) FILTER (pos = me) OVER s AS mp_e, max(ms) FILTER (pos = mb) OVER s AS ms_b, max(ms) FILTER (pos = me) OVER s AS ms_e FROM pth WINDOW s AS (PARTITION BY msa_id, seq_id)),
pr AS (SELECT *, max(mp) FILTER (pos = rgt) OVER s AS mp_r, max(mp - held) FILTER (pos = lft) OVER s AS mp_l0 FROM pe WINDOW s AS (PARTITION BY msa_id, seq_id)),
bord AS (SELECT *, CASE WHEN ms_e - 1 < ms - 1 + 5 THEN mp_e - 1 + (ms_e - ms + 1) - (mp_e - mp + held) - 10 + 1 WHEN ms - 1 - 4 < 0 THEN mp_b - sres_b + (mp - mp_b + sres_b) - (ms - ms_b + 1) ELSE mp - 1 - 4 END AS lo,
  CASE WHEN ms_e - 1 < ms - 1 + 5 THEN mp_e - 1 + (ms_e - ms + 1) - (mp_e - mp + held) WHEN ms - 1 - 4 < 0 THEN mp_b - sres_b + (mp - mp_b + sres_b) - (ms - ms_b + 1) + 10 - 1 ELSE mp - 1 + 5 END AS hi FROM pr WHERE m = 1 AND (is_q OR pos BETWEEN f AND l)),
cov AS (SELECT *, CASE WHEN 10 <= ms_e - ms_b + 1 THEN mp_l0 <= lo AND hi <= mp_r - 1 ELSE pos BETWEEN lft AND rgt END AS covers FROM bord),
ext0 AS (SELECT msa_id, pos, count(*) FILTER (pos BETWEEN lft AND rgt) AS n_seqs, max(lft) FILTER (covers) AS "left", min(rgt) FILTER (covers) AS "right" FROM cov GROUP BY ALL),
ext AS (SELECT ext0.*, b.ms - a.ms + 1 AS "interval" FROM ext0 JOIN col a ON a.msa_id = ext0.msa_id AND a.pos = "left" JOIN col b ON b.msa_id = ext0.msa_id AND b.pos = "right")"""


@query("d8_extents", f"WITH {CELLS_SQL}, {_SPAN_SQL} SELECT msa_id, pos, n_seqs, \"left\", \"right\", \"interval\" FROM ext")
def d8_extents(spark, sf_dir):
    return msa.extents(cells(spark, sf_dir))


_STEPS_SQL = f"""{WEIGHTS_SQL}, {_SPAN_SQL}, own AS (SELECT cell.msa_id, cell.seq_id, cell.pos, code <= 23 AS valid, m, ms - m AS k, CASE WHEN cell.seq_id = qid THEN 1 ELSE f END AS f, CASE WHEN cell.seq_id = qid THEN n_cols ELSE l END AS l, weight
  FROM cell JOIN col ON col.msa_id = cell.msa_id AND col.pos = cell.pos JOIN e ON e.msa_id = cell.msa_id AND e.seq_id = cell.seq_id JOIN qid ON qid.msa_id = cell.msa_id JOIN weights w ON w.msa_id = cell.msa_id AND w.seq_id = cell.seq_id),
used AS (SELECT * FROM own WHERE pos BETWEEN f AND l),
prv AS (SELECT msa_id, seq_id, k + 1 AS k, pos AS ppm, valid AS ppm_valid FROM own WHERE m = 1),
wp AS (SELECT used.*, coalesce(ppm_valid, true) AS before_valid FROM used LEFT JOIN prv ON prv.msa_id = used.msa_id AND prv.seq_id = used.seq_id AND prv.k = used.k WHERE ppm IS NULL OR ppm BETWEEN f AND l),
num AS (SELECT *, sum((m = 0 AND valid)::INT) OVER (PARTITION BY msa_id, seq_id, k ORDER BY pos) AS inserts FROM wp),
st AS (SELECT msa_id, k, weight, CASE WHEN inserts > 0 THEN 'I' WHEN before_valid THEN 'M' ELSE 'D' END || CASE WHEN valid THEN 'M' ELSE 'D' END AS step FROM num WHERE m = 1
  UNION ALL SELECT msa_id, k, weight, CASE WHEN inserts > 1 THEN 'II' WHEN before_valid THEN 'MI' ELSE 'DI' END FROM num WHERE m = 0 AND valid
  UNION ALL SELECT used.msa_id, k + 1, weight, CASE WHEN valid THEN 'MM' ELSE 'DM' END FROM used JOIN bnd ON bnd.msa_id = used.msa_id AND pos = me),
sw AS (SELECT msa_id, k, step, sum(weight) AS w FROM st GROUP BY ALL),
steps AS (SELECT msa_id, k, step, w, w / sum(w) OVER (PARTITION BY msa_id, k, substr(step, 1, 1)) AS frequency FROM sw)"""


@query("d14_transitions", f"WITH {_STEPS_SQL} SELECT msa_id, k, step, round(w, 6) + 0.0 AS w, round(frequency, 6) + 0.0 AS frequency FROM steps")
def d14_transitions(spark, sf_dir):
    own = cells(spark, sf_dir)
    return msa.transition_counts(own, msa.global_weights(own)).select("msa_id", "k", "step", r6(F.col("w")).alias("w"), r6(F.col("frequency")).alias("frequency"))


_ALPHA_ROWS = "(VALUES " + ", ".join(f"('{s}', {a!r}::DOUBLE)" for s, a in pr.TRANSITION_ALPHAS.items()) + ") AS a(step, alpha)"


@query("h1_dirichlet", f"""WITH {_STEPS_SQL}, g AS (SELECT m.msa_id, m.k, a.step, a.alpha, coalesce(s.frequency, 0) AS f FROM (SELECT DISTINCT msa_id, k FROM steps) m CROSS JOIN {_ALPHA_ROWS} LEFT JOIN steps s ON s.msa_id = m.msa_id AND s.k = m.k AND s.step = a.step),
p AS (SELECT msa_id, k, step, (f * 5 + alpha) / sum(f * 5 + alpha) OVER (PARTITION BY msa_id, k, substr(step, 1, 1)) AS p FROM g)
SELECT msa_id, k, step, round(p, 6) + 0.0 AS p, round(CASE WHEN p > 0 THEN ln(p) * CASE WHEN step[1] = 'M' THEN 1 ELSE 0.4 END ELSE -32768 END, 6) + 0.0 AS log_p, round(CASE WHEN p > 0 THEN pow(p, CASE WHEN step[1] = 'M' THEN 1 ELSE 0.4 END) ELSE 0 END, 6) + 0.0 AS powered FROM p""")
def h1_dirichlet(spark, sf_dir):
    own = cells(spark, sf_dir)
    p = pr.transition_posteriors(msa.transition_counts(own, msa.global_weights(own)), 5.0)
    log_p, powered = pr.log_transition(F.col("p"), F.col("step")), pr.reevaluated(F.col("p"), F.col("step"))
    return p.select("msa_id", "k", "step", r6(F.col("p")).alias("p"), r6(log_p).alias("log_p"), r6(powered).alias("powered"))


@query("d29_consensus", f"""WITH {CELLS_SQL}, c AS (SELECT msa_id, pos, code, count(*) AS n FROM cell WHERE code < 20 GROUP BY ALL)
SELECT msa_id, pos, substr('{ALPHABET}', code + 1, 1) AS residue, n FROM c QUALIFY row_number() OVER (PARTITION BY msa_id, pos ORDER BY n DESC, code) = 1""")
def d29_consensus(spark, sf_dir):
    return msa.consensus(cells(spark, sf_dir))


_JOINT_SQL = f"""{WEIGHTS_SQL}, rw AS (SELECT res.*, weight FROM res JOIN weights USING (msa_id, seq_id)),
j0 AS (SELECT a.msa_id, a.pos AS i, b.pos AS j, a.code AS a, b.code AS b, sum(a.weight) AS w FROM rw a JOIN rw b ON a.msa_id = b.msa_id AND a.seq_id = b.seq_id AND a.pos <= b.pos GROUP BY ALL),
j1 AS (SELECT *, w / sum(w) OVER (PARTITION BY msa_id, i, j) AS p FROM j0),
joint AS (SELECT *, sum(p) OVER (PARTITION BY msa_id, i, j, a) AS pa, sum(p) OVER (PARTITION BY msa_id, i, j, b) AS pb FROM j1)"""


@query("d27_cross_covariance", f"WITH {_JOINT_SQL} SELECT msa_id, i, j, count(*) AS n, round(sum(p - pa * pb), 6) + 0.0 AS total, round(sum((p - pa * pb) * (p - pa * pb)), 6) + 0.0 AS norm2 FROM joint GROUP BY ALL")
def d27_cross_covariance(spark, sf_dir):
    own = cells(spark, sf_dir)
    x = msa.cross_covariance(own, msa.global_weights(own))
    return x.groupBy("msa_id", "i", "j").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"), r6(F.sum(F.col("value") * F.col("value"))).alias("norm2"))


@query("d27_mutual_information", f"WITH {_JOINT_SQL} SELECT msa_id, i, j, round(sum(p * ln(p / (pa * pb))), 6) + 0.0 AS mi FROM joint GROUP BY ALL")
def d27_mutual_information(spark, sf_dir):
    own = cells(spark, sf_dir)
    return msa.mutual_information(own, msa.global_weights(own)).withColumn("mi", r6(F.col("mi")))


@query("d27_contingency", """WITH j AS (SELECT l_returnflag AS a, l_linestatus AS b, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), p AS (SELECT *, w / sum(w) OVER () AS p FROM j)
SELECT a, b, round(p, 6) + 0.0 AS p, round(p - sum(p) OVER (PARTITION BY a) * sum(p) OVER (PARTITION BY b), 6) + 0.0 AS covariance FROM p""")
def d27_contingency(spark, sf_dir):
    """Weighted joint distribution of two columns of a plain table, less the product of its marginals."""
    joint = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.sum("l_quantity").alias("w"))
    p = joint.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy()))
    value = F.col("p") - F.sum("p").over(Window.partitionBy("a")) * F.sum("p").over(Window.partitionBy("b"))
    return p.select("a", "b", r6(F.col("p")).alias("p"), r6(value).alias("covariance"))


@query("d1_purge")
def d1_purge(spark, sf_dir):
    """Sequences that survive redundancy removal at 15 % identity."""
    return msa.purge(cells(spark, sf_dir), identity=0.15)


@query("d4_low_complexity")
def d4_low_complexity(spark, sf_dir):
    """Residues left in each column after the low-complexity segments of every sequence are masked."""
    own = msa.without_low_complexity(cells(spark, sf_dir), low=2.4, high=2.7)
    return own.groupBy("msa_id", "pos").agg(F.count_if(F.col("code") < N_RESIDUES).alias("n_residues"), F.count_if(F.col("code") == 23).alias("n_masked"))


@query("d5_refined_columns")
def d5_refined_columns(spark, sf_dir):
    own = msa.refined_columns(cells(spark, sf_dir))
    return own.groupBy("msa_id", "pos").agg(F.count_if(F.col("code") == 23).alias("n_masked"))


_LOCAL_SQL = f"""{WEIGHTS_SQL}, {_SPAN_SQL}, mem AS (SELECT msa_id, pos, seq_id FROM cov WHERE pos BETWEEN lft AND rgt),
mcell AS (SELECT cell.* FROM cell JOIN col ON col.msa_id = cell.msa_id AND col.pos = cell.pos WHERE m = 1 AND code < 23),
lw AS (SELECT mem.msa_id, mem.pos, c.pos AS k, c.seq_id, c.code FROM mem JOIN ext ON ext.msa_id = mem.msa_id AND ext.pos = mem.pos JOIN mcell c ON c.msa_id = mem.msa_id AND c.seq_id = mem.seq_id AND c.pos BETWEEN "left" AND "right"),
lk AS (SELECT lw.msa_id, lw.pos, k FROM lw JOIN ext ON ext.msa_id = lw.msa_id AND ext.pos = lw.pos GROUP BY ALL HAVING count(*) >= floor(any_value(n_seqs) * 0.5)),
lc AS (SELECT lw.msa_id, lw.pos, lw.k, code, count(*) AS copies FROM lw JOIN lk USING (msa_id, pos, k) GROUP BY ALL), ld AS (SELECT *, count(*) OVER (PARTITION BY msa_id, pos, k) AS dist FROM lc),
lsum AS (SELECT lw.msa_id, lw.pos, seq_id, sum(1.0::DOUBLE / (copies * dist)) AS w FROM lw JOIN ld ON ld.msa_id = lw.msa_id AND ld.pos = lw.pos AND ld.k = lw.k AND ld.code = lw.code GROUP BY ALL),
lnorm AS (SELECT msa_id, pos, seq_id, w / sum(w) OVER (PARTITION BY msa_id, pos) AS w FROM lsum),
ln0 AS (SELECT msa_id, pos, count(*) AS n FROM lk GROUP BY ALL),
mode AS (SELECT ext.msa_id, ext.pos, "interval" >= 10 AND coalesce(n, 0) >= 10 AS is_local FROM ext LEFT JOIN ln0 USING (msa_id, pos)),
mw AS (SELECT c.msa_id, c.pos, c.code, sum(CASE WHEN is_local THEN coalesce(x.w, 0) ELSE g.weight END) AS w FROM mcell c JOIN mode USING (msa_id, pos) JOIN weights g ON g.msa_id = c.msa_id AND g.seq_id = c.seq_id LEFT JOIN lnorm x ON x.msa_id = c.msa_id AND x.pos = c.pos AND x.seq_id = c.seq_id GROUP BY ALL),
sw0 AS (SELECT msa_id, pos, code, w / sum(w) OVER (PARTITION BY msa_id, pos) AS weight FROM mw),
reach AS (SELECT msa_id, pos, seq_id FROM cov), nreach AS (SELECT msa_id, pos, count(*) AS n FROM reach GROUP BY ALL),
gk AS (SELECT r.msa_id, r.pos, c.pos AS k, c.code, sum(weight) AS w, count(*) AS n FROM reach r JOIN mcell c ON c.msa_id = r.msa_id AND c.seq_id = r.seq_id JOIN weights g ON g.msa_id = r.msa_id AND g.seq_id = r.seq_id GROUP BY ALL),
gp AS (SELECT *, w / sum(w) OVER (PARTITION BY msa_id, pos, k) AS p FROM gk),
gh AS (SELECT gp.msa_id, gp.pos, gp.k, round_even(least(exp(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)), 20), 0) AS bin FROM gp JOIN nreach nr ON nr.msa_id = gp.msa_id AND nr.pos = gp.pos GROUP BY ALL HAVING sum(gp.n) >= floor(any_value(nr.n) * 0.5)),
med AS (SELECT msa_id, pos, greatest(median(bin), 1) AS e FROM gh GROUP BY ALL),
wm AS (SELECT mem.msa_id, mem.pos, sum(weight) AS w FROM mem JOIN mcell c ON c.msa_id = mem.msa_id AND c.pos = mem.pos AND c.seq_id = mem.seq_id JOIN weights g ON g.msa_id = mem.msa_id AND g.seq_id = mem.seq_id GROUP BY ALL),
obs AS (SELECT msa_id, pos, greatest(1, least(20, e * exp(0.5 * (1 - w) * ln(w)))) AS n_obs FROM wm JOIN med USING (msa_id, pos))"""


@query("d11_state_weights", f"WITH {_LOCAL_SQL} SELECT msa_id, pos, code, round(weight, 6) + 0.0 AS weight, round(n_obs, 5) + 0.0 AS n_obs FROM sw0 JOIN obs USING (msa_id, pos) WHERE weight > 0")
def d11_state_weights(spark, sf_dir):
    """Residue weights and observations of every match column, by the sequences of its extent."""
    out = msa.state_weights(cells(spark, sf_dir)).select("msa_id", F.col("pos").cast("long").alias("pos"), F.posexplode("weights").alias("code", "weight"), "n_symbols")
    return out.filter("weight > 0").select("msa_id", "pos", "code", r6(F.col("weight")).alias("weight"), (F.round("n_symbols", 5) + F.lit(0.0)).alias("n_obs"))


@query("d17_observations", f"""WITH {_ENTROPY_SQL}, t AS (SELECT n, sum(1 - pow(1 - prior / {sum(BACKGROUND)!r}, n)) AS d FROM (SELECT unnest(generate_series(1, 400)) AS n) CROSS JOIN {BKG_ROWS} GROUP BY n),
p AS (SELECT n, d, lead(d) OVER (ORDER BY n) AS up FROM t)
SELECT msa_id, pos, round(CASE WHEN dist <= (SELECT min(d) FROM t) THEN 1 WHEN dist >= (SELECT max(d) FROM t) THEN 400 ELSE (SELECT n + (dist - d) / (up - d) FROM p WHERE d < dist AND dist <= up) END, 4) + 0.0 AS n_obs FROM kept""")
def d17_observations(spark, sf_dir):
    """Observations that explain the distinct residues of each column."""
    own = msa.column_entropy(cells(spark, sf_dir), msa.global_weights(cells(spark, sf_dir)))
    expected = msa.expected_distinct()

    @F.pandas_udf("double")
    def inverse(x: pd.Series) -> pd.Series:
        return x.map(lambda v: msa.observations_of(v, expected))

    return own.select("msa_id", "pos", (F.round(inverse("distinct"), 4) + F.lit(0.0)).alias("n_obs"))


@query("d32_selection")
def d32_selection(spark, sf_dir):
    """Sequences and residues that the selection pipeline leaves of each alignment."""
    own = msa.select_sequences(cells(spark, sf_dir), 0.15)
    return own.groupBy("msa_id").agg(F.count_distinct("seq_id").alias("n_seqs"), F.count_if(F.col("code") < N_RESIDUES).alias("n_residues"))


# ----------------------------------------------------------------- profiles


@query("d25_posteriors", f"WITH {PROFILES_SQL} SELECT profile_id, code, round(p, 6) + 0.0 AS p FROM post")
def d25_posteriors(spark, sf_dir):
    return pr.posteriors(profiles(spark, sf_dir)).withColumn("p", r6(F.col("p")))


@query("d24_background", f"""WITH {PROFILES_SQL}, x AS (SELECT l.profile_id, l.code, sum((4 * prior + least(n_obs, 20) * q) / (4 + least(n_obs, 20))) AS raw FROM longp l JOIN prof USING (profile_id, pos) JOIN {BKG_ROWS} ON b.code = l.code GROUP BY ALL)
SELECT profile_id, code, round(raw / sum(raw) OVER (PARTITION BY profile_id), 6) + 0.0 AS p FROM x""")
def d24_background(spark, sf_dir):
    return pr.recomputed_background(profiles(spark, sf_dir), 4.0).withColumn("p", r6(F.col("p")))


@query("d26_pssm", f"""WITH {PROFILES_SQL} SELECT profile_id, pos, code, round(ln(q / prior) / 0.5, 6) + 0.0 AS score FROM longp JOIN {BKG_ROWS} USING (code)""")
def d26_pssm(spark, sf_dir):
    score = pr.scores(F.col("trg"), F.array(*(F.lit(p) for p in BACKGROUND)), 0.5)
    return profiles(spark, sf_dir).select("profile_id", "pos", F.posexplode(score).alias("code", "score")).withColumn("score", r6(F.col("score")))


@query("h4_round_trip", f"WITH {PROFILES_SQL} SELECT profile_id, pos, code, round(q, 6) + 0.0 AS q FROM longp")
def h4_round_trip(spark, sf_dir):
    """Targets from scores from targets."""
    base = F.array(*(F.lit(p) for p in BACKGROUND))
    back = pr.targets_of_scores(pr.scores(F.col("trg"), base, 0.7), base, 0.7)
    return profiles(spark, sf_dir).select("profile_id", "pos", F.posexplode(back).alias("code", "q")).withColumn("q", r6(F.col("q")))


@query("h6_logit", f"WITH {PROFILES_SQL} SELECT profile_id, pos, round(list_sum(list_transform(trg[1:19], lambda x: ln(x / trg[20]))), 6) + 0.0 AS total, round(trg[7], 6) + 0.0 AS back FROM prof")
def h6_logit(spark, sf_dir):
    rows = profiles(spark, sf_dir).withColumn("y", pr.logit(F.col("trg")))
    return rows.select("profile_id", "pos", r6(pr.array_sum(F.col("y"))).alias("total"), r6(F.element_at(pr.inverse_logit(F.col("y")), 7)).alias("back"))


_COEFFICIENTS = pr.context_coefficients()


@query("h8_context_vectors", f"""WITH {PROFILES_SQL}, n AS (SELECT profile_id, max(pos) AS len FROM prof GROUP BY 1 HAVING max(pos) >= 15), k AS (SELECT unnest(generate_series(-7, 7))::INT AS k),
w AS (SELECT profile_id, pos, k, len, [{", ".join(map(repr, _COEFFICIENTS))}][k + 8] AS w, CASE WHEN pos + k < 1 THEN 2 - pos - k WHEN pos + k > len THEN 2 * len - pos - k ELSE pos + k END AS src FROM prof JOIN n USING (profile_id) CROSS JOIN k),
y AS (SELECT profile_id, pos, code AS c, ln(q / last) AS v FROM longp JOIN (SELECT profile_id, pos, trg[20] AS last FROM prof) USING (profile_id, pos) WHERE code < 19),
s AS (SELECT w.profile_id, w.pos, c, sum(w * v) AS v FROM w JOIN y ON y.profile_id = w.profile_id AND y.pos = w.src GROUP BY ALL),
m AS (SELECT *, v - avg(v) OVER (PARTITION BY profile_id, pos) AS x FROM s)
SELECT profile_id, pos, round(sum(x * x), 6) + 0.0 AS norm2, round(max(x), 6) + 0.0 AS largest FROM m GROUP BY ALL""")
def h8_context_vectors(spark, sf_dir):
    cv = pr.context_vectors(profiles(spark, sf_dir))
    return cv.select("profile_id", "pos", r6(F.col("norm2")).alias("norm2"), r6(F.array_max("cv")).alias("largest"))


@query("n1_vector_algebra", f"""WITH {PROFILES_SQL} SELECT profile_id, pos, round(list_min(cv), 6) + 0.0 AS low, round(list_max(cv), 6) + 0.0 AS high, round(list_sum(cv), 6) + 0.0 AS total,
round(sqrt(list_sum(list_transform(cv, lambda x: x * x))), 6) + 0.0 AS norm, round(list_sum(list_transform(generate_series(1, 19), lambda i: cv[i] * trg[i])), 6) + 0.0 AS inner_product FROM prof""")
def n1_vector_algebra(spark, sf_dir):
    c = F.col("cv")
    return profiles(spark, sf_dir).select(
        "profile_id", "pos", r6(F.array_min(c)).alias("low"), r6(F.array_max(c)).alias("high"), r6(pr.array_sum(c)).alias("total"),
        r6(F.sqrt(pr.dot(c, c))).alias("norm"), r6(pr.dot(c, F.slice("trg", 1, 19))).alias("inner_product"),
    )


@query("n5_cholesky")
def n5_cholesky(spark, sf_dir):
    """Log determinant and rank of the covariance of each profile's context vectors."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["cv"].to_numpy())
        c = np.cov(x.T) + 1e-6 * np.eye(x.shape[1])
        root = np.linalg.cholesky(c)
        return pd.DataFrame([[int(group["profile_id"].iloc[0]), round(float(2 * np.log(np.diag(root)).sum()), 6), round(float(np.linalg.slogdet(c)[1]), 6)]], columns=["profile_id", "log_det", "log_det_lu"])

    return profiles(spark, sf_dir).select("profile_id", "cv").groupBy("profile_id").applyInPandas(one, "profile_id long, log_det double, log_det_lu double")


#: Dishes of the mixture, whose parameters the driver holds.
DISHES = 32


@query("k1_mixture")
def k1_mixture(spark, sf_dir):
    """Most probable cluster of each position's context vector under a mixture of at most DISHES dishes, profiles dealt to them by number."""
    own = profiles(spark, sf_dir).select("profile_id", "pos", "cv")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group["cv"].to_numpy())
        centred = x - x.mean(axis=0)
        return pd.DataFrame({"profile_id": [group["profile_id"].iloc[0]], "n": [len(x)], "mean": [x.mean(axis=0)], "scatter": [(centred.T @ centred).ravel()]})

    # a dish's parameters are sums over its members: one row a dish, of which there are few
    parts = own.withColumn("profile_id", F.col("profile_id") % DISHES).groupBy("profile_id").applyInPandas(one, "profile_id long, n long, mean array<double>, scatter array<double>")
    rows = parts.orderBy("profile_id").collect()
    means = np.array([r["mean"] for r in rows])
    d = means.shape[-1]
    prior = (mu0, s0, kappa0, nu0) = (means.mean(axis=0), np.eye(d), 0.1, float(d + 2))
    dishes = [hdp.posterior(r["n"], mean, np.reshape(r["scatter"], (d, d)), mu0, s0, kappa0, nu0) for r, mean in zip(rows, means)]
    tables = [float(r["n"]) for r in rows]

    found = hdp.profile_memberships(own, dishes, tables, prior, top=1)
    return found.select("profile_id", "pos", F.element_at("dish", 1).alias("dish"), r6(F.element_at("p", 1)).alias("p"))


# ----------------------------------------------------------------- segments

_WINDOW_SQL = """w AS (SELECT user_id, ts, event_id, row_number() OVER o AS loc, count(*) OVER (PARTITION BY user_id) AS n, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS win FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
full_w AS (SELECT * FROM w WHERE loc - 6 >= 1 AND loc + 5 <= n),
sym AS (SELECT user_id, event_id, loc, unnest(win) AS s FROM full_w), cnt AS (SELECT user_id, event_id, loc, s, count(*) AS c FROM sym GROUP BY ALL),
ent AS (SELECT user_id, event_id, loc, -sum(c / 12.0::DOUBLE * log2(c / 12.0::DOUBLE)) AS entropy FROM cnt GROUP BY ALL)"""


@query("f2_window_entropy", f'''WITH {_WINDOW_SQL} SELECT user_id, event_id, loc AS "at", round(entropy, 6) + 0.0 AS entropy FROM ent''')
def f2_window_entropy(spark, sf_dir):
    return segments.window_entropy(symbols(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", F.col("at").cast("long").alias("at"), r6(F.col("entropy")).alias("entropy"))


@query("f5_islands", f"""WITH {_WINDOW_SQL}, i AS (SELECT *, loc - row_number() OVER (PARTITION BY user_id ORDER BY loc) AS run FROM ent WHERE round(entropy, 6) <= 1.9)
SELECT user_id, min(loc) AS "left", max(loc) AS "right", count(*) AS n FROM i GROUP BY user_id, run HAVING min(round(entropy, 6)) <= 1.6""")
def f5_islands(spark, sf_dir):
    rows = f2_window_entropy(spark, sf_dir)
    return segments.islands(rows, "user_id", "at", "entropy", 1.6, 1.9).select("user_id", "left", "right", "n")


@query("f9_merged_segments", """WITH iv AS (SELECT o_custkey, datediff('day', DATE '1990-01-01', o_orderdate::DATE) AS l, datediff('day', DATE '1990-01-01', o_orderdate::DATE) + 29 AS r FROM orders),
m AS (SELECT *, max(r) OVER (PARTITION BY o_custkey ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR l > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY l, r ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT o_custkey, min(l) AS "left", max(r) AS "right" FROM g GROUP BY o_custkey, run""")
def f9_merged_segments(spark, sf_dir):
    """Thirty-day intervals after each order, merged for each customer."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01")).cast("long")
    rows = table(spark, sf_dir, "orders").select("o_custkey", day.alias("left"), (day + 29).alias("right"))
    return segments.merged(rows, "o_custkey")


@query("f1_seg")
def f1_seg(spark, sf_dir):
    """Low-complexity segments of each user's event stream, five symbols."""
    rows = symbols(spark, sf_dir).withColumn("letter", F.upper(F.substring("event_type", 1, 1)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "letter"))), lambda x: x["letter"])
    streams = rows.groupBy("user_id").agg(F.array_join(ordered, "").alias("text"))
    return segments.seg_sequences(streams, "user_id", F.col("text"), "VSECP", low=1.2, high=1.5)


@query("f13_masked")
def f13_masked(spark, sf_dir):
    """Profiles with their low-complexity segments masked: positions and whether they are masked."""
    own = profiles(spark, sf_dir)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "aa"))), lambda x: x["aa"])
    lines = own.groupBy("profile_id").agg(F.array_join(ordered, "").alias("text"))
    found = segments.seg_sequences(lines, "profile_id", F.col("text"), ALPHABET[:N_RESIDUES], low=3.0, high=3.1)
    out = pr.masked(own, found)
    return out.select("profile_id", "pos", "masked", r6(F.array_max("trg")).alias("largest"))


# ------------------------------------------------------------------ scoring

_SCORES_SQL = f"""{PROFILES_SQL}, bkg AS (SELECT profile_id, list(p ORDER BY code) AS b FROM post GROUP BY 1), pb AS (SELECT prof.*, b FROM prof JOIN bkg USING (profile_id)),
sc AS (SELECT x.profile_id AS q_id, y.profile_id AS t_id, x.pos AS i, y.pos AS j, ln(list_sum(list_transform(generate_series(1, 20), lambda k: x.trg[k] * y.trg[k] / ((x.b[k] + y.b[k]) / 2)))) - 0.002 AS score FROM pb x JOIN pb y ON x.profile_id < y.profile_id)"""


def scored_positions(spark, sf_dir) -> DataFrame:
    """Positions of all profiles with what base scores need."""
    own = profiles(spark, sf_dir)
    return own.join(backgrounds(own), "profile_id").select("profile_id", "pos", "trg", "bkg")


@query("e5_base_scores", f"WITH {_SCORES_SQL} SELECT q_id, t_id, i, j, round(score, 6) + 0.0 AS score FROM sc")
def e5_base_scores(spark, sf_dir):
    """Base score of all pairs of positions of different profiles."""
    return pairs.scores(scored_positions(spark, sf_dir))


def score_histogram(spark, sf_dir) -> DataFrame:
    """Score histogram of each pair of profiles."""
    return sig.probabilities(pairs.counts(scored_positions(spark, sf_dir)), ["q_id", "t_id"])


@query("h9_histogram", f"WITH {_SCORES_SQL}, h AS (SELECT q_id, t_id, round_even(greatest(least(round(score, 6), 10), -10) * 32, 0)::INT AS bin, count(*) AS n FROM sc GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY q_id, t_id), 6) + 0.0 AS p FROM h")
def h9_histogram(spark, sf_dir):
    return score_histogram(spark, sf_dir).withColumn("p", r6(F.col("p")))


@query("h12_expected", f"""WITH {_SCORES_SQL}, h AS (SELECT q_id, t_id, round_even(greatest(least(round(score, 6), 10), -10) * 32, 0) / 32 AS s FROM sc)
SELECT q_id, t_id, round(avg(s), 6) + 0.0 AS expected, round(min(s), 6) + 0.0 AS min_score, round(max(s), 6) + 0.0 AS max_score FROM h GROUP BY ALL""")
def h12_expected(spark, sf_dir):
    keys = ["q_id", "t_id"]
    out = sig.expected(score_histogram(spark, sf_dir), keys)
    return out.select(*keys, *(r6(F.col(c)).alias(c) for c in ("expected", "min_score", "max_score")))


@query("h13_statistics")
def h13_statistics(spark, sf_dir):
    """lambda, relative entropy and K of all pairs of profiles."""
    keys = ["q_id", "t_id"]
    out = sig.statistics(score_histogram(spark, sf_dir), keys)
    return out.select(*keys, *(r6(F.col(c)).alias(c) for c in ("lambda", "h", "k")))


@query("h19_scaling")
def h19_scaling(spark, sf_dir):
    """Factor that brings each pair's scores to the reference lambda."""
    hist = h9_histogram(spark, sf_dir)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        _, factor = sig.scaled_scores(group["bin"].to_numpy() / sig.SCALE, group["n"].to_numpy() / group["n"].sum())
        return pd.DataFrame([[group["q_id"].iloc[0], group["t_id"].iloc[0], round(factor, 6)]], columns=["q_id", "t_id", "factor"])

    return hist.groupBy("q_id", "t_id").applyInPandas(one, "q_id long, t_id long, factor double")


@query("g20_segment_pairs", f"""WITH {_SCORES_SQL}, p AS (SELECT *, j - i AS d, i - row_number() OVER (PARTITION BY q_id, t_id, j - i ORDER BY i) AS run FROM sc WHERE round(score, 6) > 0.2)
SELECT q_id, t_id, d, min(i) AS i, count(*) AS length, round(sum(round(score, 6)), 4) + 0.0 AS total FROM p GROUP BY q_id, t_id, d, run HAVING count(*) >= 3""")
def g20_segment_pairs(spark, sf_dir):
    """High-scoring segment pairs: runs of at least three positive positions on one diagonal."""
    runs = pairs.segment_pairs(scored_positions(spark, sf_dir))
    return runs.select("q_id", "t_id", F.col("d").cast("int").alias("d"), F.col("i").cast("int").alias("i"), "length", (F.round("total", 4) + F.lit(0.0)).alias("total"))


@query("g7_bonus", f"""WITH {_SCORES_SQL}, d AS (SELECT q_id, t_id, i AS loc, round(score, 6) AS s FROM sc WHERE i = j), l AS (SELECT *, coalesce(lag(s, 1) OVER w, 0) + coalesce(lag(s, 2) OVER w, 0) + coalesce(lag(s, 3) OVER w, 0) + coalesce(lag(s, 4) OVER w, 0) AS b FROM d WINDOW w AS (PARTITION BY q_id, t_id ORDER BY loc DESC)),
r AS (SELECT q_id, t_id, sum(s * b) / 2 AS r FROM l GROUP BY ALL) SELECT q_id, t_id, round(sign(r) * sqrt(abs(r)), 5) + 0.0 AS bonus FROM r""")
def g7_bonus(spark, sf_dir):
    """Autocorrelation bonus along the main diagonal of each pair."""
    own = scored_positions(spark, sf_dir)
    one, two = (own.select(F.col("profile_id").alias(f"{s}_id"), F.col("pos").alias("at"), F.col("trg").alias(s), F.col("bkg").alias(f"{s}_bkg")) for s in "qt")
    score = r6(scoring.base_score(F.col("q"), F.col("t"), F.col("q_bkg"), F.col("t_bkg")))
    diagonal = one.join(two, "at").filter("q_id < t_id").select("q_id", "t_id", "at", score.alias("score"))
    return scoring.correlation_bonus(diagonal, ["q_id", "t_id"], "at", "score").withColumn("bonus", F.round("bonus", 5) + F.lit(0.0))


@query("e14_hdp_factor", f"""WITH {PROFILES_SQL}, m AS (SELECT profile_id, avg(eno) AS e, max(trg[1]) AS p FROM prof GROUP BY 1)
SELECT x.profile_id AS q_id, y.profile_id AS t_id, round((0.4 + 0.6 * exp(-1.5e-5 * (0.47 * pow(x.e - 23, 4) + 0.47 * pow(y.e - 23, 4) + 2 * 0.47 * pow(x.e - 23, 2) * pow(y.e - 23, 2))))
  * exp(-7.5 * (0.37 * pow(x.p - 1, 2) + 0.37 * pow(y.p - 1, 2) + 2 * 1.17 * (x.p - 1) * (y.p - 1))), 9) + 0.0 AS factor FROM m x JOIN m y ON x.profile_id <= y.profile_id""")
def e14_hdp_factor(spark, sf_dir):
    own = profiles(spark, sf_dir).groupBy("profile_id").agg(F.avg("eno").alias("e"), F.max(F.element_at("trg", 1)).alias("p"))
    one, two = (own.select(*(F.col(c).alias(f"{c}_{s}") for c in own.columns)) for s in "qt")
    pairs = one.join(two, F.col("profile_id_q") <= F.col("profile_id_t"))
    return pairs.select(F.col("profile_id_q").alias("q_id"), F.col("profile_id_t").alias("t_id"), (F.round(scoring.hdp_factor(F.col("e_q"), F.col("e_t"), F.col("p_q"), F.col("p_t")), 9) + F.lit(0.0)).alias("factor"))


@query("e19_step_lookup", f"""WITH {PROFILES_SQL}, k AS (SELECT profile_id, pos, greatest(least(round_even(round(cv[1], 6) * 2, 0) / 2, 5), -5) AS key FROM prof) SELECT profile_id, pos, key + 0.0 AS key, round(key * key / 10, 6) + 0.0 AS value FROM k""")
def e19_step_lookup(spark, sf_dir):
    """A half-unit step table joined to values; the table is a few rows."""
    keys = spark.range(-10, 11).select((F.col("id") / 2).alias("key"), r6(F.col("id") / 2 * F.col("id") / 2 / 10).alias("value"))
    rows = profiles(spark, sf_dir).select("profile_id", "pos", F.greatest(F.least(scoring.step_key(F.round(F.element_at("cv", 1), 6)), F.lit(5.0)), F.lit(-5.0)).alias("key"))
    return rows.withColumn("key", F.col("key") + F.lit(0.0)).join(F.broadcast(keys), "key").select("profile_id", "pos", "key", "value")


@query("e21_smoothing", """WITH d AS (SELECT date_trunc('day', ts) AS day, CASE WHEN count(*) % 7 <> 0 THEN sum(value) END AS v FROM events GROUP BY 1), p AS (SELECT day, v, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM d WHERE v IS NOT NULL),
c AS (SELECT *, least(greatest(k, 3), n - 2) AS mid FROM p), s AS (SELECT c.day, avg(o.v) AS s FROM c JOIN p o ON o.k BETWEEN mid - 2 AND mid + 2 GROUP BY 1)
SELECT d.day, round(v, 4) + 0.0 AS v, round(coalesce(s, (SELECT s.s FROM s WHERE s.day < d.day ORDER BY s.day DESC LIMIT 1)), 4) + 0.0 AS smooth FROM d LEFT JOIN s ON s.day = d.day""")
def e21_smoothing(spark, sf_dir):
    """Daily sums, some of them left out as missing, smoothed as a score table is."""
    daily = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.when(F.count("*") % 7 != 0, F.sum("value")).alias("v"))
    out = scoring.smoothed(daily, "day", "v")
    return out.select("day", (F.round("v", 4) + F.lit(0.0)).alias("v"), (F.round("smooth", 4) + F.lit(0.0)).alias("smooth"))


@query("e20_triangular", f"""WITH {PROFILES_SQL}, a AS (SELECT DISTINCT profile_id AS p FROM prof) SELECT x.p AS a, y.p AS b, greatest(x.p, y.p) * (greatest(x.p, y.p) + 1) // 2 + least(x.p, y.p) AS "at" FROM a x JOIN a y ON x.p <= y.p""")
def e20_triangular(spark, sf_dir):
    ids = profiles(spark, sf_dir).select("profile_id").distinct()  # one row a profile
    return ids.select(F.col("profile_id").alias("a")).join(ids.select(F.col("profile_id").alias("b")), F.col("a") <= F.col("b")).select("a", "b", scoring.triangular_index(F.col("a"), F.col("b")).alias("at"))


# ------------------------------------------------------------------- search


def packed_profiles(spark, sf_dir) -> DataFrame:
    own = profiles(spark, sf_dir)
    return search.packed(own.join(backgrounds(own), "profile_id").withColumn("trn", log_transitions()))


@query("g3_search")
def g3_search(spark, sf_dir):
    """All profiles against all: score, alignment, statistics, E-values, ranked."""
    own = packed_profiles(spark, sf_dir)
    size = own.agg(F.sum("len").alias("n"), F.count("*").alias("k")).first()
    found = search.with_evalues(search.hits(own, own), own, int(size["n"]), int(size["k"]))
    out = search.top_hits(found, cutoff=1e6)
    return out.select(
        "query_id", "target_id", "rank", *(F.round(c, 4).alias(c) for c in ("score", "positives", "log_evalue", "bit_score")), "q_from", "q_to", "t_from", "t_to",
        "aln_len", "n_ident", "n_gaps", "q_aln", "middle", "t_aln",
    )


@query("b13_json_results")
def b13_json_results(spark, sf_dir):
    """One JSON document a query."""
    return formats.json_results(g3_search(spark, sf_dir).drop("q_aln", "middle", "t_aln"))


@query("o1_multiple_alignment")
def o1_multiple_alignment(spark, sf_dir):
    """Hits of each query merged into an alignment over the query."""
    found = g3_search(spark, sf_dir).filter("aln_len > 0")
    found = written(found.select("query_id", "target_id", "q_from", "q_aln", "t_aln"), "hits")  # read three times, searched once
    return convert.multiple_alignment(found)


@query("o1_anchored_cells", """WITH p AS (SELECT doc_id, string_split(lower(lang || source), '') AS q, string_split(lower(source || lang), '') AS t FROM documents),
c AS (SELECT doc_id, unnest(q) AS q, unnest(t) AS t, generate_subscripts(q, 1) - 1 AS loc FROM p),
k AS (SELECT *, sum(CASE WHEN q <> 's' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY loc) AS k FROM c),
i AS (SELECT *, CASE WHEN q <> 's' THEN 0 ELSE sum(CASE WHEN q <> 's' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, k ORDER BY loc) END AS ins FROM k)
SELECT k AS q_pos, ins::INT AS ins, t AS residue, count(*) AS n FROM i GROUP BY ALL""")
def o1_anchored_cells(spark, sf_dir):
    """Cells of pairwise alignments made from two columns, with the letter s as the gap."""
    rows = table(spark, sf_dir, "documents").select(
        F.lit(0).alias("query_id"), F.col("doc_id").alias("target_id"), F.lit(1).alias("q_from"),
        F.translate(F.lower(F.concat("lang", "source")), "s", "-").alias("q_aln"), F.lower(F.concat("source", "lang")).alias("t_aln"),
    )
    return convert.anchored_cells(rows).groupBy("q_pos", "ins", "residue").agg(F.count("*").alias("n"))


@query("o9_secondary_structure", f"""WITH {PROFILES_SQL} SELECT profile_id, pos, substr('CEH', list_position(ss, list_max(ss))::INT, 1) AS state, floor(ss[1] * 10000)::INT AS pc, floor(ss[2] * 10000)::INT AS pe, floor(ss[3] * 10000)::INT AS ph FROM prof""")
def o9_secondary_structure(spark, sf_dir):
    own = profiles(spark, sf_dir)
    letter = F.substring(F.lit("CEH"), F.array_position("ss", F.array_max("ss")).cast("int"), F.lit(1))
    parts = [F.element_at("ss", i + 1).alias(c) for i, c in enumerate(("pc", "pe", "ph"))]
    return convert.with_ss(own.select("profile_id", "pos", "aa"), own.select("profile_id", "pos", "aa", letter.alias("state"), *parts)).drop("aa")


@query("h27_evalues", f"""WITH s AS (SELECT o_orderkey, o_totalprice / 20000 AS score, 1e6::DOUBLE AS space FROM orders), e AS (SELECT *, ln({sig.K_GAPPED} * space) - {sig.LAMBDA_GAPPED} * score AS le FROM s)
SELECT o_orderkey, round(le, 6) + 0.0 AS log_evalue, round((ln(space) - le) / ln(2), 6) + 0.0 AS bit_score, round(exp(le), 6) + 0.0 AS evalue, round(CASE WHEN exp(le) < 0.01 THEN exp(le) ELSE 1 - exp(-exp(le)) END, 6) + 0.0 AS pvalue FROM e""")
def h27_evalues(spark, sf_dir):
    """E-value, p-value and bit score of scores from a plain table."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 20000).alias("score"), F.lit(1e6).alias("space"))
    rows = rows.withColumn("le", sig.log_evalue(F.col("score"), F.col("space"))).withColumn("e", sig.evalue(F.col("le")))
    return rows.select("o_orderkey", r6(F.col("le")).alias("log_evalue"), r6(sig.bit_score(F.col("le"), F.col("space"))).alias("bit_score"), r6(F.col("e")).alias("evalue"), r6(sig.pvalue(F.col("e"))).alias("pvalue"))


@query("h29_pair_evalues", f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS score, l_tax * 10 - 0.1 AS lam, l_discount * 5 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN lam > 0 AND k > 0 THEN ln(k * 30000) - lam * score ELSE ln({sig.K_REF} * 30000) - {sig.LAMBDA_REF} * score END, 6) + 0.0 AS log_evalue,
round(CASE WHEN lam > 0 THEN lam * {sig.LAMBDA_GAPPED / sig.LAMBDA_REF!r} END, 6) + 0.0 AS lambda_gapped, round(CASE WHEN k > 0 THEN k * {sig.K_GAPPED / sig.K_REF!r} END, 6) + 0.0 AS k_gapped FROM s""")
def h29_pair_evalues(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("score"), (F.col("l_tax") * 10 - 0.1).alias("lam"), (F.col("l_discount") * 5).alias("k"))
    le = sig.log_pair_evalue(F.col("score"), F.lit(100), F.lit(300), F.col("lam"), F.col("k"))
    return rows.select("l_orderkey", "l_linenumber", r6(le).alias("log_evalue"), r6(sig.gapped_lambda(F.col("lam"))).alias("lambda_gapped"), r6(sig.gapped_k(F.col("k"))).alias("k_gapped"))


@query("h33_score_threshold", f"""SELECT doc_id, round(greatest(-ln(30.0::DOUBLE / {sig.K_GAPPED} / ((n_chars + 1)::DOUBLE * 1000000)) / {sig.LAMBDA_GAPPED}, 0), 6) + 0.0 AS many, round(greatest(-ln(0.1::DOUBLE * 1 / {sig.K_GAPPED} / ((n_chars + 1)::DOUBLE * 1000000)) / {sig.LAMBDA_GAPPED}, 0), 6) + 0.0 AS few FROM documents""")
def h33_score_threshold(spark, sf_dir):
    m, n = F.col("n_chars") + 1, F.lit(1000000)
    return table(spark, sf_dir, "documents").select("doc_id", r6(sig.score_threshold(10.0, m, n)).alias("many"), r6(sig.score_threshold(0.01, m, n)).alias("few"))


@query("h35_pair_probabilities", """WITH s AS (SELECT doc_id, length(text) - length(replace(lower(text), 'e', '')) AS e, n_chars AS len FROM documents),
b AS (SELECT (CASE WHEN e / 40.0 >= 3 THEN 1 ELSE 0 END + CASE WHEN e / 40.0 >= 5 THEN 1 ELSE 0 END + CASE WHEN e / 40.0 >= 7 THEN 1 ELSE 0 END + CASE WHEN e / 40.0 >= 9 THEN 1 ELSE 0 END + CASE WHEN e / 40.0 >= 11 THEN 1 ELSE 0 END + CASE WHEN e / 40.0 >= 13 THEN 1 ELSE 0 END) * 6
 + CASE WHEN len >= 75 THEN 1 ELSE 0 END + CASE WHEN len >= 150 THEN 1 ELSE 0 END + CASE WHEN len >= 300 THEN 1 ELSE 0 END + CASE WHEN len >= 500 THEN 1 ELSE 0 END + CASE WHEN len >= 700 THEN 1 ELSE 0 END AS bin FROM s),
p AS (SELECT bin, count(*) / sum(count(*)) OVER () AS p FROM b GROUP BY 1)
SELECT x.bin AS bin_a, y.bin AS bin_b, round(CASE WHEN x.bin = y.bin THEN x.p * y.p ELSE 2 * x.p * y.p END, 6) + 0.0 AS p FROM p x JOIN p y ON x.bin >= y.bin""")
def h35_pair_probabilities(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    e = (F.length("text") - F.length(F.replace(F.lower("text"), F.lit("e"), F.lit("")))) / 40.0
    return sig.pair_probabilities(docs.select(e.alias("eno"), F.col("n_chars").alias("len"))).withColumn("p", r6(F.col("p")))


@query("h23_network_inputs", f"""WITH {PROFILES_SQL}, m AS (SELECT profile_id, round(avg(eno), 6) AS e, count(*) AS n FROM prof GROUP BY 1), p AS (SELECT x.profile_id AS q_id, y.profile_id AS t_id, x.e AS e1, x.n AS n1, y.e AS e2, y.n AS n2, x.e < y.e OR (x.e = y.e AND x.n < y.n) AS sw FROM m x JOIN m y ON x.profile_id < y.profile_id)
SELECT q_id, t_id, round(CASE WHEN sw THEN e2 ELSE e1 END * 0.05, 6) + 0.0 AS x1, round(ln(CASE WHEN sw THEN n2 ELSE n1 END) / ln(1000), 6) + 0.0 AS x2, round(CASE WHEN sw THEN e1 ELSE e2 END * 0.05, 6) + 0.0 AS x3, round(ln(CASE WHEN sw THEN n1 ELSE n2 END) / ln(1000), 6) + 0.0 AS x4 FROM p""")
def h23_network_inputs(spark, sf_dir):
    own = profiles(spark, sf_dir).groupBy("profile_id").agg(F.round(F.avg("eno"), 6).alias("e"), F.count("*").alias("n"))
    one, two = (own.select(*(F.col(c).alias(f"{c}_{s}") for c in own.columns)) for s in "qt")
    x = sig.network_inputs(F.col("e_q"), F.col("n_q"), F.col("e_t"), F.col("n_t"))
    rows = one.join(two, F.col("profile_id_q") < F.col("profile_id_t")).select(F.col("profile_id_q").alias("q_id"), F.col("profile_id_t").alias("t_id"), x.alias("x"))
    return rows.select("q_id", "t_id", *(r6(F.element_at("x", i)).alias(f"x{i}") for i in range(1, 5)))


@query("h26_combined_evalues")
def h26_combined_evalues(spark, sf_dir):
    """E-values from the extreme-value and the positives' p-values, combined, for all hits."""
    own = packed_profiles(spark, sf_dir)
    found = search.hits(own, own, terms=scoring.Terms(realign=False)).select("query_id", "target_id", "query_len", "target_len", "score", "positives", "k")

    @F.pandas_udf("double")
    def combined(score: pd.Series, positives: pd.Series, m: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([sig.combined_log_evalue(s, p, a, b, 1e6, kk, 4.0, 1.6) for s, p, a, b, kk in zip(score, positives, m, n, k)])

    return found.select("query_id", "target_id", F.round(combined("score", "positives", "query_len", "target_len", "k"), 4).alias("log_evalue"))


@query("m1_special_functions")
def m1_special_functions(spark, sf_dir):
    """Special functions over a plain table's numbers."""

    @F.pandas_udf("struct<lgamma:double,digamma:double,trigamma:double,log_q:double,log_beta:double,zeta:double>")
    def values(size: pd.Series) -> pd.DataFrame:
        x = size.astype(float)
        return pd.DataFrame({
            "lgamma": special.log_gamma(x.to_numpy()), "digamma": [special.digamma(v) for v in x], "trigamma": [special.polygamma(1, v) for v in x],
            "log_q": [special.log_gamma_q(1.5, v) for v in x], "log_beta": [special.log_beta_i(v, 0.5, 0.6) for v in x], "zeta": [special.hurwitz_zeta(2.0, v) for v in x],
        })

    rows = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count("*").alias("n")).withColumn("v", values("p_size"))
    return rows.select("p_size", "n", *(F.round(f"v.{c}", 6).alias(c) for c in ("lgamma", "digamma", "trigamma", "log_q", "log_beta", "zeta")))


# ------------------------------------------------------- databases, ranking


@query("a21_database_sizes", f"WITH {PROFILES_SQL} SELECT CASE WHEN profile_id < 5 THEN 'a' ELSE 'b' END AS db, count(DISTINCT profile_id) AS n_profiles, count(*) AS n_positions FROM prof GROUP BY 1")
def a21_database_sizes(spark, sf_dir):
    """Two databases read as one, with their sizes."""
    own = profiles(spark, sf_dir)
    both = own.filter("profile_id < 5").withColumn("db", F.lit("a")).unionByName(own.filter("profile_id >= 5").withColumn("db", F.lit("b")))
    return both.groupBy("db").agg(F.count_distinct("profile_id").alias("n_profiles"), F.count("*").alias("n_positions"))


@query("j1_top_hits", """WITH r AS (SELECT o_custkey, o_orderkey, -ln(o_totalprice) AS log_evalue FROM orders WHERE -ln(o_totalprice) <= ln(10)) SELECT o_custkey, o_orderkey, round(log_evalue, 6) + 0.0 AS log_evalue, row_number() OVER (PARTITION BY o_custkey ORDER BY log_evalue, o_orderkey)::INT AS rank FROM r QUALIFY rank <= 3""")
def j1_top_hits(spark, sf_dir):
    """The three best rows of each key, as hits are limited for each query."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (-F.log("o_totalprice")).alias("log_evalue"))
    out = search.top_hits(rows, n_hits=3, key="o_custkey", tie="o_orderkey")
    return out.withColumn("log_evalue", r6(F.col("log_evalue")))


@query("j3_merged_hits", """WITH r AS (SELECT c_nationkey AS k, c_custkey AS id, -c_acctbal AS v FROM customer UNION ALL SELECT s_nationkey, s_suppkey + 1000000000, -s_acctbal FROM supplier) SELECT k, id, v, row_number() OVER (PARTITION BY k ORDER BY v, id)::INT AS rank FROM r WHERE v <= ln(1e300) QUALIFY rank <= 5""")
def j3_merged_hits(spark, sf_dir):
    """Ranked results of two sources merged for each key."""
    one = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), (-F.col("c_acctbal")).alias("v"))
    two = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") + 1000000000).alias("id"), (-F.col("s_acctbal")).alias("v"))
    return search.merged_hits([one, two], n_hits=5, cutoff=1e300, key="k", order="v", tie="id")


@query("l2_distinct_names", "SELECT DISTINCT lower(event_type) AS name FROM events UNION SELECT DISTINCT lower(r_name) FROM region")
def l2_distinct_names(spark, sf_dir):
    one = table(spark, sf_dir, "events").select(F.lower("event_type").alias("name"))
    return one.unionByName(table(spark, sf_dir, "region").select(F.lower("r_name").alias("name"))).distinct()


@query("a4_profile_text")
def a4_profile_text(spark, sf_dir):
    """Profiles written as condensed text and read back: the largest rounding error of each."""
    own = profiles(spark, sf_dir)
    rows = own.select(
        F.col("profile_id").cast("string").alias("name"), F.lit("from vectors").alias("description"), F.count("*").over(Window.partitionBy("profile_id")).cast("int").alias("len"),
        F.lit(10).alias("n_seqs"), F.round("eno", 1).alias("eff_nos"), "pos", "aa", "trg", F.array(*(F.lit(0.1) for _ in range(9))).alias("trn"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("mid"), F.lit(None).cast("string").alias("state"),
    ).withColumn("eff_nos", F.max("eff_nos").over(Window.partitionBy("name")))
    back = formats.profiles(formats.profile_text(rows)).select("name", "pos", F.col("aa").alias("aa2"), F.col("trg").alias("trg2"))
    error = F.array_max(F.zip_with("trg", "trg2", lambda a, b: F.abs(a - b)))
    return rows.join(back, ["name", "pos"]).groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("aa") == F.col("aa2")).alias("same"), (F.max(error) <= 0.00005).alias("exact"))


@query("a2_fasta", f"WITH {CELLS_SQL} SELECT msa_id::VARCHAR AS msa_id, count(DISTINCT seq_id) AS n_seqs, count(*) AS n_cells, sum(code) AS total FROM cell GROUP BY 1")
def a2_fasta(spark, sf_dir):
    """Alignments written as FASTA and read back."""
    own = msa.sequences(cells(spark, sf_dir)).withColumn("description", F.concat(F.lit("sequence "), F.col("seq_id").cast("string")))
    texts = formats.fasta_text(own).select(F.col("msa_id").cast("string").alias("name"), "value")
    back = formats.cells(formats.fasta_sequences(texts))
    return back.groupBy("msa_id").agg(F.count_distinct("seq_id").alias("n_seqs"), F.count("*").alias("n_cells"), F.sum("code").alias("total"))


@query("p1_windows", """SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY ALL""")
def p1_windows(spark, sf_dir):
    """The streaming window aggregation, run as a batch."""
    from seqlake.streaming.ingest import windowed_counts

    out = windowed_counts(table(spark, sf_dir, "events"))
    return out.withColumn("total", F.round("total", 4) + F.lit(0.0))
