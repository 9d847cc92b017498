"""Profile search: every query profile against every database profile.

The queries are packed once and sent to the executors while they are few;
the database stays partitioned and streams through one Arrow stage, which
scores, aligns, and keeps what passes the score threshold. A larger query set
is worked through in blocks. Ranking and limits are relational.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.operators import alignment as al
from seqlake.operators import significance as sig
from seqlake.operators.scoring import Terms, score_matrices

#: Bytes of packed queries that may be sent to every worker; more go in blocks.
QUERY_BYTES = 64 << 20
#: Cells of the score matrices that are aligned together.
BATCH_CELLS = 1 << 20
#: Cells of a pair whose matrices are never held whole.
LONG_CELLS = 1 << 19
#: Tasks a core that long pairs are dealt out to.
TASKS_A_CORE = 8
#: Score of the cells that a shorter target lacks.
ABSENT = -1e9

HIT = (
    "query_id long, target_id long, query_len int, target_len int, score double, positives int, bonus double, q_from int, q_to int, t_from int, t_to int, "
    "aln_len int, n_ident int, n_gaps int, q_aln string, middle string, t_aln string, lambda double, k double, entropy double, expected double, "
    "min_score double, max_score double, log_pair_evalue double, query_eno double, target_eno double"
)


#: Fields of a profile that some score terms need, packed by position where a profile has them.
EXTRA = {"ss": 3, "cv": 19, "norm2": 1, "prior": 1, "cluster": 1, "cluster_p": 1}


def packed(profiles: DataFrame) -> DataFrame:
    """One row for each profile: profile_id, len, residues, trg, bkg, trn, eno and the fields of EXTRA, arrays in order of position.

    ``trn`` has nine values for all positions, or a row more than the
    profile: the begin state's (``begin_trn``) first. Fields that the input
    lacks are null.
    """
    extra = [c for c in EXTRA if c in profiles.columns]
    by_position = "begin_trn" in profiles.columns
    row = F.struct("pos", "aa", "trg", *extra, *(["trn"] if by_position else []))
    eno = F.first("eno_profile").alias("eno") if "eno_profile" in profiles.columns else F.lit(None).cast("double").alias("eno")
    rows = profiles.groupBy("profile_id").agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.first("bkg").alias("bkg"), F.first("begin_trn" if by_position else "trn").alias("trn"), eno
    )

    def field(c: str):
        if c not in extra:
            return F.lit(None).cast("array<double>").alias(c)
        values = F.transform("rows", lambda r: r[c])
        whole = ~F.exists("rows", lambda r: r[c].isNull())
        return F.when(whole, F.flatten(values) if EXTRA[c] > 1 else F.transform(values, lambda v: v.cast("double"))).alias(c)

    trn = F.concat("trn", F.flatten(F.transform("rows", lambda r: r["trn"]))) if by_position else F.col("trn")
    return rows.select(
        "profile_id", F.size("rows").alias("len"), F.array_join(F.transform("rows", lambda r: r["aa"]), "").alias("residues"),
        F.flatten(F.transform("rows", lambda r: r["trg"])).alias("trg"), "bkg", trn.alias("trn"), "eno", *(field(c) for c in EXTRA),
    )


def _unpacked(row) -> dict:
    n = int(row["len"])
    trn = np.array(row["trn"], dtype=float)
    eno = None if pd.isna(row["eno"]) else row["eno"]
    out = {
        "id": int(row["profile_id"]), "len": n, "residues": row["residues"], "trg": np.array(row["trg"], dtype=float).reshape(n, 20),
        "bkg": np.array(row["bkg"], dtype=float), "trn": np.tile(trn, (n + 1, 1)) if trn.size == 9 else trn.reshape(n + 1, 9), "eno": eno,
    }
    for c, width in EXTRA.items():
        value = row[c]
        if value is not None:
            value = np.array(value, dtype=float)
            out[c] = value.reshape(n, width) if width > 1 else value.astype(int) if c == "cluster" else value
    return out


def score_counts(scores: np.ndarray, q: str, t: str) -> np.ndarray:
    """Counts of clamped scores in steps of 1 / SCALE; cells with an unknown residue (X) on either side don't count."""
    known = (np.frombuffer(q.encode(), "S1") != b"X")[:, None] & (np.frombuffer(t.encode(), "S1") != b"X")[None, :]
    clamped = np.clip(scores[known] if not known.all() else scores, -sig.SCORE_LIMIT, sig.SCORE_LIMIT)
    most = sig.SCORE_LIMIT * sig.SCALE
    return np.bincount(np.rint(clamped * sig.SCALE).astype(int).ravel() + most, minlength=2 * most + 1)


def count_statistics(counts: np.ndarray) -> tuple[float, float, float, float, float, float]:
    """lambda, K, relative entropy, expected, least and largest score of a pair's counts."""
    some = np.flatnonzero(counts)
    if not some.size:
        return -1.0, -1.0, -1.0, 0.0, 0.0, 0.0
    s, p = (some - sig.SCORE_LIMIT * sig.SCALE) / sig.SCALE, counts[some] / counts.sum()
    lam = sig.solve_lambda(s, p)
    h = sig.relative_entropy(s, p, lam)
    unit, back_to = np.unique(np.rint(s).astype(int), return_inverse=True)
    k = sig.solve_k(unit, np.bincount(back_to, p), lam, h)
    return lam, k, h, float((s * p).sum()), float(s.min()), float(s.max())


def pair_statistics(scores: np.ndarray, q: str, t: str) -> tuple[float, float, float, float, float, float]:
    """The same of a pair's whole matrix of scores."""
    return count_statistics(score_counts(scores, q, t))


def _part(x: dict, first: int, end: int) -> dict:
    """Some positions of an unpacked profile."""
    return x | {c: x[c][first:end] for c in ("trg", *EXTRA) if x.get(c) is not None}


def _path_scores(q: dict, t: dict, terms: Terms, path: list[tuple[int, int, int]]) -> dict:
    """Scores of the cells of a path, made in small blocks along it."""
    out = {}
    for at in range(0, len(path), 256):
        ys, xs = zip(*((y, x) for y, x, _ in path[at : at + 256]))
        y0, x0 = min(ys), min(xs)
        block = score_matrices(_part(q, y0, max(ys) + 1), _part(t, x0, max(xs) + 1), terms)[0]
        out.update(((y, x), float(block[y - y0, x - x0])) for y, x in zip(ys, xs))
    return out


def _record(q: dict, t: dict, score: float, extra: float, n_positive: int, stats: tuple, pair: float, steps: list, lines: tuple[str, str, str]) -> tuple:
    same = sum(a == b != "-" for a, b in zip(lines[0], lines[2]))
    ys, xs = [y for y, _, _ in steps], [x for _, x, _ in steps]
    lam, k, h, mean, low, high = stats
    return (
        q["id"], t["id"], q["len"], t["len"], score, n_positive, extra, min(ys, default=-1) + 1, max(ys, default=-1) + 1, min(xs, default=-1) + 1, max(xs, default=-1) + 1,
        len(steps), same, lines[0].count("-") + lines[2].count("-"), *lines, lam, k, h, mean, low, high, pair,
        float(q["eno"]) if q["eno"] is not None else None, float(t["eno"]) if t["eno"] is not None else None,
    )


def _log_pair_evalue(stats: tuple, score: float, area: int) -> float:
    lam, k = stats[:2]
    return math.log(k * area) - lam * score if lam > 0 and k > 0 else math.log(sig.K_REF * area) - sig.LAMBDA_REF * score


def long_hit(q: dict, t: dict, threshold: float, terms: Terms = Terms(), least: float = 0.28) -> tuple | None:
    """The hit of a pair whose matrices are too large to be held: scores are made strip by strip, again for each pass."""
    m, n = q["len"], t["len"]
    strip = lambda y0, y1: score_matrices(_part(q, y0, y1), t, terms)
    counts = np.zeros(2 * sig.SCORE_LIMIT * sig.SCALE + 1, dtype=np.int64)

    def counted(y0, y1):
        scores = strip(y0, y1)[0]
        counts[:] += score_counts(scores, q["residues"][y0:y1], t["residues"])
        return scores

    top, end, back = al.local_rows(counted, m, n, q["trn"], t["trn"])
    if top <= threshold:
        return None
    path = al.trace(back, end)
    del back
    own = _path_scores(q, t, terms, path)
    matched = [own[y, x] for y, x, step in path if step == al.DIAGONAL]
    extra = al.bonus(matched)
    score = top + extra
    if score <= threshold:
        return None
    stats = count_statistics(counts)
    pair = _log_pair_evalue(stats, score, m * n)
    steps, n_positive = path[::-1], al.positives(matched)
    if terms.realign:
        steps = al.accuracy_rows(lambda y0, y1: al.dynamic_scores(*strip(y0, y1), pair), m, n, q["trn"], t["trn"], least)
        own = _path_scores(q, t, terms, steps)
    lines = al.strings(steps, q["residues"], t["residues"], own)
    return _record(q, t, score, extra, lines[1].count("+") if terms.realign else n_positive, stats, pair, steps, lines)


def batch_hits(q: dict, targets: list[dict], threshold: float, terms: Terms = Terms(), least: float = 0.28) -> list[tuple]:
    """Hits of one query among some targets: score, statistics, alignment.

    All targets go through the recurrence together; only those whose score
    passes the threshold, before the bonus and with it, are realigned.
    """
    m, wide = q["len"], max(t["len"] for t in targets)
    if m * wide > LONG_CELLS:  # alone in its batch
        return [hit for t in targets if (hit := long_hit(q, t, threshold, terms, least)) is not None]
    made = [score_matrices(q, t, terms) for t in targets]
    scores = np.full((len(targets), m, wide), ABSENT)
    trn = np.full((len(targets), wide + 1, 9), 0.0)
    for i, t in enumerate(targets):
        scores[i, :, : t["len"]] = np.where(al.corners(m, t["len"]), al.CLOSED, made[i][0])
        trn[i, : t["len"] + 1] = t["trn"]
    tops, ends, back = al.local_batch(scores, q["trn"], trn)
    found = []
    for i, t in enumerate(targets):
        if tops[i] <= threshold:
            continue
        own = made[i][0]
        path = al.trace(back[i], ends[i])
        matched = [float(own[y, x]) for y, x, step in path if step == al.DIAGONAL]
        extra = al.bonus(matched)
        score = float(tops[i]) + extra
        if score <= threshold:
            continue
        stats = pair_statistics(own, q["residues"], t["residues"])
        pair = _log_pair_evalue(stats, score, m * t["len"])
        found.append((i, score, extra, al.positives(matched), stats, pair, path[::-1]))
    if terms.realign and found:
        dynamic = np.full((len(found), m, wide), ABSENT)
        for j, (i, *_, pair, _) in enumerate(found):
            dynamic[j, :, : targets[i]["len"]] = al.dynamic_scores(*made[i], pair)
        some = [f[0] for f in found]
        paths = al.accuracy_batch(dynamic, q["trn"], trn[some], np.array([targets[i]["len"] for i in some]), least)[1]
    out = []
    for j, (i, score, extra, n_positive, stats, pair, path) in enumerate(found):
        t, own = targets[i], made[i][0]
        steps = paths[j] if terms.realign else path
        lines = al.strings(steps, q["residues"], t["residues"], own)
        if terms.realign:  # the realigned path's: cells above 0 of unlike residues
            n_positive = lines[1].count("+")
        out.append(_record(q, t, score, extra, n_positive, stats, pair, steps, lines))
    return out


def pair_hit(q: dict, t: dict, threshold: float, terms: Terms = Terms(), least: float = 0.28):
    """The hit of one pair, or None."""
    return next(iter(batch_hits(q, [t], threshold, terms, least)), None)


def hits(queries: DataFrame, database: DataFrame, threshold: float = 0.0, terms: Terms = Terms(), cutoff: float | None = None, n_positions: int = 0, least: float = 0.28) -> DataFrame:
    """Hits of all pairs above the score threshold (both sides packed).

    With a ``cutoff`` E-value and the database's ``n_positions`` each query
    has a threshold of its own, by its length. Queries are sent to the
    executors in blocks of bounded size; within a partition of the database
    targets of like length are aligned together. Of long profiles that are
    fewer than the tasks, each goes out in copies, and each copy meets its
    slice of the queries.
    """
    spark = database.sparkSession
    size = queries.agg(F.sum(F.col("len") * 400 + 1600).alias("b"), F.count("*").alias("n"), F.max("len").alias("longest")).first()
    blocks = max(1, -(-int(size["b"] or 0) // QUERY_BYTES))
    # aligning costs far more than moving a profile: deal pairs out over all cores, whatever the profiles' number
    targets = database.agg(F.count("*").alias("n"), F.max("len").alias("longest")).first()
    slices, parts = 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if (size["longest"] or 0) * (targets["longest"] or 0) > LONG_CELLS:
        parts = max(parts, TASKS_A_CORE * spark.sparkContext.defaultParallelism)
        slices = max(1, min(int(size["n"]), -(-parts // int(targets["n"]))))
    database = database.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    database = database.repartitionByRange(parts, "slice", "profile_id") if slices > 1 else database.repartition(parts)
    names = [x.split()[0] for x in HIT.split(", ")]
    out = None
    for block in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("profile_id"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast([_unpacked(r) for r in part.toArrow().to_pandas().to_dict("records")])  # about QUERY_BYTES

        def search(batches, held=held):
            for batch in batches:
                everyone = sorted((_unpacked(r) | {"slice": r["slice"]} for r in batch.to_dict("records")), key=lambda t: t["len"])
                rows = []
                for k, q in enumerate(held.value):
                    own = max(threshold, sig.threshold_of(cutoff, q["len"], n_positions)) if cutoff is not None else threshold
                    targets = [t for t in everyone if t["slice"] == k % slices]
                    at = 0
                    while at < len(targets):
                        to = at + 1
                        while to < len(targets) and (to + 1 - at) * q["len"] * targets[to]["len"] <= BATCH_CELLS:
                            to += 1
                        rows += batch_hits(q, targets[at:to], own, terms, least)
                        at = to
                yield pd.DataFrame(rows, columns=names)

        found = database.mapInPandas(search, HIT)
        out = found if out is None else out.unionByName(found)
    return out


def search_spaces(queries: DataFrame, n_positions: int, n_profiles: int) -> DataFrame:
    """(query_len, space) of the queries' distinct lengths."""

    @F.pandas_udf("double")
    def space(n: pd.Series) -> pd.Series:
        return pd.Series([sig.search_space(int(x), n_positions, n_profiles) for x in n], dtype=float)

    return queries.select(F.col("len").cast("int").alias("query_len")).distinct().withColumn("space", space("query_len"))


def with_evalues(found: DataFrame, queries: DataFrame, n_positions: int, n_profiles: int, model: sig.ScoreModel | None = None) -> DataFrame:
    """Log E-value, E-value, p-value and bit score against a database of that size.

    Without a model (0) by the gapped reference statistics; with one (1 or 2)
    by its extreme-value parameters, combined with the number of positives.
    """
    scored = found.join(search_spaces(queries, n_positions, n_profiles), "query_len")
    if model is None:
        scored = scored.withColumn("log_evalue", sig.log_evalue(F.col("score"), F.col("space")))
    else:
        scored = sig.with_parameters(scored, model)
        log_e = sig.combined_column(*(F.col(c).cast("double") for c in ("score", "positives", "query_len", "target_len", "space", "k", "mu", "scale")), variant=model.variant)
        scored = scored.withColumn("log_evalue", log_e)
    return scored.withColumn("evalue", sig.evalue(F.col("log_evalue"))).withColumn("pvalue", sig.pvalue(F.col("evalue"))).withColumn(
        "bit_score", sig.bit_score(F.col("log_evalue"), F.col("space"))
    )


def top_hits(found: DataFrame, cutoff: float = 10.0, n_hits: int = 700, key: str = "query_id", order: str = "log_evalue", tie: str = "target_id") -> DataFrame:
    """The best hits of each query by E-value, up to the cutoff; equal ones by target."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order, tie))
    return found.filter(F.col(order) <= math.log(cutoff)).withColumn("rank", rank).filter(F.col("rank") <= n_hits)


def merged_hits(parts: list[DataFrame], n_hits: int = 700, **how) -> DataFrame:
    """Results of several databases, ranked as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_hits(out, n_hits=n_hits, **how)
