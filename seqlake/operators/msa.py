"""Reduction of multiple sequence alignments held as cells.

A cell is a row (msa_id, seq_id, pos, code): positions from 1, codes as in
``functions.alphabet``. Many alignments live in one DataFrame; the sequence
with the smallest id is the query of its alignment.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.functions.alphabet import AMBIGUOUS, BACKGROUND, GAP, N_RESIDUES, X, decode

CELL = ["msa_id", "seq_id", "pos"]


def residues(cells: DataFrame) -> DataFrame:
    """Cells of the twenty residues."""
    return cells.filter(F.col("code") < N_RESIDUES)


def sequences(cells: DataFrame) -> DataFrame:
    """Residue strings and their numbers of residues."""
    letters = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda c: decode(c["code"]))
    return cells.groupBy("msa_id", "seq_id").agg(F.array_join(letters, "").alias("residues"), F.count_if(F.col("code") < N_RESIDUES).alias("n_residues"))


def trimmed(cells: DataFrame) -> DataFrame:
    """First and last residue of each sequence, and the cells between them; the query keeps all its cells."""
    at = F.when(F.col("code") <= X, F.col("pos"))
    query = F.min("seq_id").over(Window.partitionBy("msa_id"))
    ends = cells.groupBy("msa_id", "seq_id").agg(F.min(at).alias("first_used"), F.max(at).alias("last_used"), F.max("pos").alias("n_cells"))
    ends = ends.withColumn("query", query)
    used = F.when(F.col("seq_id") == F.col("query"), F.col("n_cells")).otherwise(F.coalesce(F.col("last_used") - F.col("first_used") + 1, F.lit(0)))
    return ends.select("msa_id", "seq_id", "first_used", "last_used", used.alias("n_used"))


def query_cells(cells: DataFrame) -> DataFrame:
    first = cells.groupBy("msa_id").agg(F.min("seq_id").alias("seq_id"))
    return cells.join(first, ["msa_id", "seq_id"])


def match_columns(cells: DataFrame) -> DataFrame:
    """Cells of the columns where the query has a residue."""
    columns = query_cells(cells).filter(F.col("code") <= X).select("msa_id", "pos")
    return cells.join(columns, ["msa_id", "pos"], "left_semi")


def occupancy(cells: DataFrame) -> DataFrame:
    """Sequences with a residue, and gaps, of each column."""
    return cells.groupBy("msa_id", "pos").agg(F.count_if(F.col("code") < N_RESIDUES).alias("n_residues"), F.count_if(F.col("code") == GAP).alias("n_gaps"))


#: Sequences to a block, where the sequences of an alignment are compared.
BLOCK = 256


def _block_pairs(cells: DataFrame) -> DataFrame:
    """(msa_id, low, high, seq_id, block, at, codes): each sequence once for each pair of blocks that it is in.

    ``at`` and ``codes`` are the positions and codes of its residues.
    """
    own = residues(cells).groupBy("msa_id", "seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("r"))
    n = own.groupBy("msa_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = own.join(n, "msa_id").withColumn("block", F.pmod(F.xxhash64("seq_id"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(
        "msa_id", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.col("seq_id").cast("long").alias("seq_id"), "block",
        F.transform("r", lambda c: c["pos"].cast("int")).alias("at"), F.transform("r", lambda c: c["code"].cast("int")).alias("codes"),
    )


def _compared(group: pa.Table):
    """Sequence ids, residue counts, and matrices of equal and of shared residues of a block pair; pairs to leave out are False in the last."""
    n = group.num_rows
    at, codes = group.column("at").combine_chunks(), group.column("codes").combine_chunks()
    sizes = np.diff(at.offsets.to_numpy())
    row, pos, code = np.repeat(np.arange(n), sizes), at.flatten().to_numpy(), codes.flatten().to_numpy()
    columns, place = np.unique(pos, return_inverse=True)
    valid = np.zeros((n, len(columns)), dtype=np.float32)
    valid[row, place] = 1
    equal = np.zeros((n, n), dtype=np.float32)
    for a in np.unique(code):
        one = np.zeros((n, len(columns)), dtype=np.float32)
        some = code == a
        one[row[some], place[some]] = 1
        equal += one @ one.T
    ids, block = group.column("seq_id").to_numpy(), group.column("block").to_numpy()
    wanted = ids[:, None] != ids[None, :]
    if group.column("low")[0].as_py() != group.column("high")[0].as_py():
        wanted &= block[:, None] != block[None, :]
    return ids, sizes, equal.astype(np.int64), (valid @ valid.T).astype(np.int64), wanted


def identities(cells: DataFrame) -> DataFrame:
    """Equal residues of every pair of sequences (i < j) that has any, and their share of the columns where both have residues.

    Only match columns count. Blocks of sequences are compared as products of
    incidence matrices, so a conserved column isn't a hot key.
    """

    def one(group: pa.Table) -> pa.Table:
        ids, _, equal, overlap, wanted = _compared(group)
        x, y = np.nonzero(wanted & (equal > 0) & (ids[:, None] < ids[None, :]))
        both, total = equal[x, y], overlap[x, y]
        return pa.table({
            "msa_id": group.column("msa_id").combine_chunks().take(pa.array(np.zeros(len(x), np.int64))), "i": pa.array(ids[x]), "j": pa.array(ids[y]),
            "matches": pa.array(both), "overlap": pa.array(total), "identity": pa.array(both / np.maximum(total, 1)),
        })

    kind = dict(cells.dtypes)["msa_id"]
    return _block_pairs(match_columns(cells)).groupBy("msa_id", "low", "high").applyInArrow(one, f"msa_id {kind}, i long, j long, matches long, overlap long, identity double")


def neff(cells: DataFrame, thresholds: list[float]) -> DataFrame:
    """Effective number of sequences at each identity threshold: the sum of 1 / (1 + neighbours).

    Here the identity is the equal residues by the shorter sequence's residues.
    Each block pair returns a count of neighbours for each sequence.
    """
    thresholds = sorted(set(thresholds))
    names = [f"k{i}" for i in range(len(thresholds))]

    def one(group: pa.Table) -> pa.Table:
        ids, sizes, equal, _, wanted = _compared(group)
        share = equal / np.minimum(sizes[:, None], sizes[None, :])
        counts = [(wanted & (equal > 0) & (share >= t)).sum(axis=1) for t in thresholds]
        return pa.table({"msa_id": group.column("msa_id"), "seq_id": pa.array(ids), **{c: pa.array(k) for c, k in zip(names, counts)}})

    kinds = dict(cells.dtypes)
    found = _block_pairs(cells).groupBy("msa_id", "low", "high").applyInArrow(one, f"msa_id {kinds['msa_id']}, seq_id long, " + ", ".join(f"{c} long" for c in names))
    counts = found.groupBy("msa_id", "seq_id").agg(*(F.sum(c).alias(c) for c in names))
    every = cells.select("msa_id", F.col("seq_id").cast("long").alias("seq_id")).distinct().join(counts, ["msa_id", "seq_id"], "left")
    sums = every.groupBy("msa_id").agg(F.count("*").alias("n_seqs"), *(F.sum(1 / (1 + F.coalesce(c, F.lit(0)))).alias(f"s{c}") for c in names))
    rows = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"s{c}").alias("neff")) for c, t in zip(names, thresholds))))
    return sums.select("msa_id", "n_seqs", rows.alias("r")).select("msa_id", "n_seqs", "r.threshold", "r.neff")


def identity_order(cells: DataFrame) -> DataFrame:
    """(msa_id, seq_id, identity, rank): sequences in falling identity to the query, which comes first; equal ones by id."""
    own = residues(match_columns(cells)).select(*CELL, "code")
    first = cells.groupBy("msa_id").agg(F.min("seq_id").alias("query"))
    query = residues(query_cells(cells)).select("msa_id", "pos", F.col("code").alias("q"))
    shares = own.join(query, ["msa_id", "pos"]).groupBy("msa_id", "seq_id").agg((F.count_if(F.col("code") == F.col("q")) / F.count("*")).alias("identity"))
    every = cells.select("msa_id", "seq_id").distinct().join(shares, ["msa_id", "seq_id"], "left").join(first, "msa_id")
    rank = F.row_number().over(Window.partitionBy("msa_id").orderBy((F.col("seq_id") != F.col("query")).cast("int"), F.desc("identity"), "seq_id"))
    return every.withColumn("identity", F.coalesce("identity", F.lit(0.0))).select("msa_id", "seq_id", "identity", rank.alias("rank"))


def parse_thresholds(text: str) -> list[float]:
    """Identity thresholds of a comma-separated list, as shares or percents: sorted, each once."""
    parts = [x.strip() for x in text.split(",") if x.strip()]
    found = {float(x.rstrip("%")) / (100 if x.endswith("%") else 1) for x in parts}
    if any(not 0 < x <= 1 for x in found):
        raise ValueError(f"identity thresholds must be above 0 and at most 1: {text}")
    return sorted(found)


def background(cells: DataFrame, pseudocounts: float = 120.0, priors: tuple[float, ...] = BACKGROUND) -> DataFrame:
    """Residue probabilities of each query with pseudocounts spread by ``priors``."""
    query = residues(query_cells(cells)).groupBy("msa_id").pivot("code", list(range(N_RESIDUES))).count()
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(str(a)), F.lit(0)) for a in range(N_RESIDUES)))
    mass = sum(priors)
    each = [
        F.struct(F.lit(a).alias("code"), ((F.coalesce(F.col(str(a)), F.lit(0)) + F.lit(pseudocounts * priors[a] / mass)) / (total + pseudocounts)).alias("p"))
        for a in range(N_RESIDUES)
    ]
    return query.select("msa_id", F.explode(F.array(*each)).alias("r")).select("msa_id", "r.code", "r.p")


def global_weights(cells: DataFrame, least_length: int = 30) -> DataFrame:
    """Position-based weights: 1 / (copies of the residue * distinct residues) summed over columns, by length, normalised."""
    own = residues(cells)
    column = Window.partitionBy("msa_id", "pos")
    counts = own.groupBy("msa_id", "pos", "code").agg(F.count("*").alias("copies")).withColumn("distinct", F.count("*").over(column))
    sums = own.join(counts, ["msa_id", "pos", "code"]).groupBy("msa_id", "seq_id").agg(F.sum(1 / (F.col("copies") * F.col("distinct"))).alias("w"), F.count("*").alias("n"))
    every = cells.select("msa_id", "seq_id").distinct().join(sums, ["msa_id", "seq_id"], "left")
    raw = every.withColumn("w", F.coalesce(F.col("w") / F.greatest(F.col("n") + 1, F.lit(least_length)), F.lit(0.0)))
    return raw.select("msa_id", "seq_id", (F.col("w") / F.sum("w").over(Window.partitionBy("msa_id"))).alias("weight"))


def column_entropy(cells: DataFrame, weights: DataFrame, least_share: float = 0.5) -> DataFrame:
    """exp(entropy) of the weighted residues of each column that enough sequences occupy: expected distinct residues."""
    n = cells.select("msa_id", "seq_id").distinct().groupBy("msa_id").agg(F.count("*").alias("n_seqs"))
    mass = residues(cells).join(weights, ["msa_id", "seq_id"]).groupBy("msa_id", "pos", "code").agg(F.sum("weight").alias("w"), F.count("*").alias("k"))
    column = Window.partitionBy("msa_id", "pos")
    mass = mass.withColumn("p", F.col("w") / F.sum("w").over(column))
    columns = mass.groupBy("msa_id", "pos").agg(F.sum("k").alias("k"), F.exp(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))).alias("distinct"))
    return columns.join(n, "msa_id").filter(F.col("k") >= F.col("n_seqs") * least_share).select("msa_id", "pos", "distinct")


def histogram_median(values: DataFrame, key: str, value: str, scale: float = 1000.0) -> DataFrame:
    """Median of values quantised to 1 / scale; an even number of values averages with the next non-empty bin at the half."""
    bins = values.groupBy(key, F.rint(F.col(value) * scale).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(key).orderBy("bin")
    bins = bins.withColumn("cum", F.sum("n").over(upto)).withColumn("next", F.lead("bin").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(key)))
    half = bins.filter((F.col("cum") * 2 >= F.col("total")) & ((F.col("cum") - F.col("n")) * 2 < F.col("total")))
    even = (F.col("total") % 2 == 0) & (F.col("cum") * 2 == F.col("total")) & F.col("next").isNotNull()
    return half.select(key, (F.when(even, (F.col("bin") + F.col("next")) / 2).otherwise(F.col("bin").cast("double")) / scale).alias("median"))


def extents(cells: DataFrame, width: int = 10) -> DataFrame:
    """Reduced alignment of each match column: (msa_id, pos, n_seqs, left, right, interval).

    A sequence is in the extent of the columns from its first to its last
    residue, kept within the match columns. Of those that have residues at
    all match columns of a window of ``width`` around the column (one fewer
    to the left for even widths; at either end the window is shifted to
    lie within the match columns), the largest first and the smallest last
    position bound the extent. With fewer match columns than the window, all
    sequences of the column do. ``interval`` is its number of match columns.
    """
    used = trimmed(cells)
    columns = query_cells(cells).select("msa_id", "pos", (F.col("code") <= X).cast("int").alias("is_match"))
    upto = Window.partitionBy("msa_id").orderBy("pos")
    columns = columns.withColumn("ms", F.sum("is_match").over(upto))
    bounds = columns.filter("is_match = 1").groupBy("msa_id").agg(F.min("pos").alias("match_from"), F.max("pos").alias("match_to"), F.count("*").alias("n_match"))
    ends = used.filter("first_used IS NOT NULL").join(bounds, "msa_id").join(cells.groupBy("msa_id").agg(F.min("seq_id").alias("query")), "msa_id")
    ends = ends.select(
        "msa_id", "seq_id", "first_used", "last_used", "match_from", "match_to", "n_match", (F.col("seq_id") == F.col("query")).alias("is_query"),
        F.greatest("first_used", "match_from").alias("left"), F.least("last_used", "match_to").alias("right"),
    )
    own = cells.join(columns, ["msa_id", "pos"]).join(ends, ["msa_id", "seq_id"])
    held = ((F.col("code") <= X) & (F.col("is_match") == 1)).cast("int")
    sequence = Window.partitionBy("msa_id", "seq_id")
    own = own.withColumn("held", held).withColumn("mp", F.sum("held").over(sequence.orderBy("pos"))).withColumn("total", F.sum("held").over(sequence))
    own = own.filter(F.col("is_query") | F.col("pos").between(F.col("first_used"), F.col("last_used")))
    own = own.filter("is_match = 1")
    before, after = width // 2 - (1 - width % 2), width // 2
    at_left, at_right = F.col("ms") - 1 - before < 0, F.col("ms") + after > F.col("n_match")
    # the window in numbers of the sequence's own residues at match columns, from 0
    shifted = F.col("n_match") - F.col("ms") + F.col("mp") - F.col("held")
    low = F.when(at_right, shifted - width + 1).when(at_left, F.col("mp") - F.col("ms")).otherwise(F.col("mp") - 1 - before)
    high = F.when(at_right, shifted).when(at_left, F.col("mp") - F.col("ms") + width - 1).otherwise(F.col("mp") - 1 + after)
    inside = F.col("pos").between(F.col("left"), F.col("right"))
    covers = F.when(F.col("n_match") >= width, (low >= 0) & (high <= F.col("total") - 1)).otherwise(inside)
    found = own.groupBy("msa_id", "pos").agg(
        F.count_if(inside).alias("n_seqs"), F.max(F.when(covers, F.col("left"))).alias("left"), F.min(F.when(covers, F.col("right"))).alias("right"),
    )
    at = columns.select("msa_id", "pos", "ms")
    out = found.join(at.withColumnsRenamed({"pos": "left", "ms": "ms_left"}), ["msa_id", "left"], "left").join(at.withColumnsRenamed({"pos": "right", "ms": "ms_right"}), ["msa_id", "right"], "left")
    return out.select("msa_id", "pos", "n_seqs", "left", "right", (F.col("ms_right") - F.col("ms_left") + 1).alias("interval"))


def transition_counts(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted transitions at every match column: (msa_id, k, pos, step, w, frequency).

    ``k`` numbers the match columns from 1; 0 is the begin state. A residue at
    a match column is M, a gap D; residues between two match columns are I.
    Steps belong to the match column before them, and count for sequences
    that reach it: to the next match column directly, or through the first
    insertion, further ones (II), and out of the last. Past the last match
    column a sequence steps from its state there to M, the end. Frequencies
    are by source state.
    """
    columns = query_cells(cells).select("msa_id", "pos", (F.col("code") <= X).cast("int").alias("is_match"))
    columns = columns.withColumn("k", F.sum("is_match").over(Window.partitionBy("msa_id").orderBy("pos")).cast("long"))
    query = cells.groupBy("msa_id").agg(F.min("seq_id").alias("query"), F.min("pos").alias("from_pos"), F.max("pos").alias("to_pos"))
    ends = trimmed(cells).join(query, "msa_id").filter(F.col("first_used").isNotNull() | (F.col("seq_id") == F.col("query")))
    is_query = F.col("seq_id") == F.col("query")
    ends = ends.select("msa_id", "seq_id", F.when(is_query, F.col("from_pos")).otherwise(F.col("first_used")).alias("first"), F.when(is_query, F.col("to_pos")).otherwise(F.col("last_used")).alias("last"))
    own = cells.join(columns, ["msa_id", "pos"]).join(ends, ["msa_id", "seq_id"]).filter(F.col("pos").between(F.col("first"), F.col("last")))
    held = F.col("code") <= X
    runs = own.groupBy("msa_id", "seq_id", "k").agg(
        F.max(F.when(F.col("is_match") == 1, F.when(held, "M").otherwise("D"))).alias("at"), F.count_if((F.col("is_match") == 0) & held).alias("inserts")
    )
    # the begin state is a match of every sequence that reaches the first column or an insertion before it
    begin = ends.select("msa_id", "seq_id", F.lit(0).cast("long").alias("k"), F.lit("M").alias("begin"))
    runs = runs.join(begin, ["msa_id", "seq_id", "k"], "full").withColumn("at", F.coalesce("at", "begin")).fillna(0, ["inserts"]).drop("begin")
    order = Window.partitionBy("msa_id", "seq_id").orderBy("k")
    runs = runs.withColumn("next", F.when(F.lead("k").over(order) == F.col("k") + 1, F.lead("at").over(order)))
    last = columns.groupBy("msa_id").agg(F.max("k").alias("n_match"))
    runs = runs.filter("at IS NOT NULL").join(last, "msa_id").join(weights, ["msa_id", "seq_id"])
    ins, end = F.col("inserts") > 0, F.col("k") == F.col("n_match")
    step = lambda when, name, times=F.lit(1): F.struct(F.when(when, name).alias("step"), times.cast("double").alias("n"))
    steps = F.array(
        step(ins, F.concat("at", F.lit("I"))), step(F.col("inserts") > 1, F.lit("II"), F.col("inserts") - 1), step(ins & F.col("next").isNotNull(), F.concat(F.lit("I"), "next")),
        step(~ins & F.col("next").isNotNull(), F.concat("at", "next")), step(end & (F.col("k") > 0), F.concat("at", F.lit("M"))),
    )
    rows = runs.select("msa_id", "k", "weight", F.explode(steps).alias("s")).filter("s.step IS NOT NULL")
    sums = rows.groupBy("msa_id", "k", F.col("s.step").alias("step")).agg(F.sum(F.col("s.n") * F.col("weight")).alias("w"))
    source = Window.partitionBy("msa_id", "k", F.substring("step", 1, 1))
    sums = sums.withColumn("frequency", F.when(F.sum("w").over(source) > 0, F.col("w") / F.sum("w").over(source)).otherwise(0.0))
    places = columns.filter("is_match = 1").select("msa_id", "k", "pos")
    return sums.join(places, ["msa_id", "k"], "left").select("msa_id", "k", F.coalesce("pos", F.lit(0)).alias("pos"), "step", "w", "frequency")


def consensus(cells: DataFrame) -> DataFrame:
    """Most frequent residue of each column; ties go to the first in alphabet order."""
    counts = residues(cells).groupBy("msa_id", "pos", "code").agg(F.count("*").alias("n"))
    best = counts.groupBy("msa_id", "pos").agg(F.max(F.struct("n", (-F.col("code")).alias("k"))).alias("b"))
    return best.select("msa_id", "pos", decode(-F.col("b.k")).alias("residue"), F.col("b.n").alias("n"))


#: Columns to a block, where pairs of columns are compared.
COLUMN_BLOCK = 32


def _column_pairs(cells: DataFrame, weights: DataFrame, made, schema: str) -> DataFrame:
    """Blocks of columns against blocks of columns: ``made`` gets the column numbers of two blocks and the weighted joint sums (i, j, 20, 20)."""
    own = residues(cells).join(weights, ["msa_id", "seq_id"]).withColumn("block", F.floor((F.col("pos") - 1) / COLUMN_BLOCK).cast("int"))
    rows = own.groupBy("msa_id", "seq_id", "weight", "block").agg(F.collect_list(F.struct("pos", "code")).alias("r"))
    last = rows.groupBy("msa_id").agg(F.max("block").alias("last"))
    rows = rows.join(last, "msa_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = rows.select(
        "msa_id", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.col("seq_id").cast("long").alias("seq_id"), "weight", "block",
        F.transform("r", lambda c: c["pos"].cast("int")).alias("at"), F.transform("r", lambda c: c["code"].cast("int")).alias("codes"),
    )
    kind = dict(cells.dtypes)["msa_id"]

    def one(group: pa.Table) -> pa.Table:
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        ids, at = np.unique(group.column("seq_id").to_numpy(), return_inverse=True)
        block, weight = group.column("block").to_numpy(), group.column("weight").to_numpy()
        places, codes = group.column("at").combine_chunks(), group.column("codes").combine_chunks()
        sizes = np.diff(places.offsets.to_numpy())
        row, pos, code = np.repeat(np.arange(len(at)), sizes), places.flatten().to_numpy(), codes.flatten().to_numpy()

        def held(which: int) -> tuple[np.ndarray, np.ndarray]:
            some = block[row] == which
            columns, place = np.unique(pos[some], return_inverse=True)
            out = np.zeros((len(ids), len(columns) * N_RESIDUES))
            out[at[row[some]], place * N_RESIDUES + code[some]] = 1.0
            return columns, out

        by_sequence = np.zeros(len(ids))
        by_sequence[at] = weight
        (left, one_hot), (right, other) = held(low), held(high)
        joint = (one_hot * by_sequence[:, None]).T @ other
        joint = joint.reshape(len(left), N_RESIDUES, len(right), N_RESIDUES).transpose(0, 2, 1, 3) * (left[:, None] <= right[None, :])[:, :, None, None]
        found = made(left, right, joint)
        n = len(next(iter(found.values())))
        return pa.table({"msa_id": group.column("msa_id").combine_chunks().take(pa.array(np.zeros(n, np.int64))), **{c: pa.array(v) for c, v in found.items()}})

    return rows.groupBy("msa_id", "low", "high").applyInArrow(one, f"msa_id {kind}, {schema}")


def cross_covariance(cells: DataFrame, weights: DataFrame, covariance: bool = True) -> DataFrame:
    """Weighted joint frequencies of residues at every pair of columns (i <= j), less the product of the means.

    Rows exist for residue pairs that occur together; the weights of the
    sequences with residues in both columns are normalised.
    """

    def made(left, right, joint):
        total = joint.sum(axis=(2, 3), keepdims=True)
        p = joint / np.where(total > 0, total, 1.0)
        i, j, a, b = np.nonzero(p)
        own, pa_, pb = p[i, j, a, b], p.sum(axis=3)[i, j, a], p.sum(axis=2)[i, j, b]
        value = own - pa_ * pb if covariance else own
        return {"i": left[i].astype(np.int32), "j": right[j].astype(np.int32), "a": a.astype(np.int32), "b": b.astype(np.int32), "p": own, "pa": pa_, "pb": pb, "value": value}

    return _column_pairs(cells, weights, made, "i int, j int, a int, b int, p double, pa double, pb double, value double")


def mutual_information(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """Mutual information of every pair of columns, in nats."""

    def made(left, right, joint):
        total = joint.sum(axis=(2, 3), keepdims=True)
        p = joint / np.where(total > 0, total, 1.0)
        by = p.sum(axis=3)[..., :, None] * p.sum(axis=2)[..., None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            mi = np.where(p > 0, p * np.log(p / by), 0.0).sum(axis=(2, 3))
        i, j = np.nonzero(total[:, :, 0, 0])
        return {"i": left[i].astype(np.int32), "j": right[j].astype(np.int32), "mi": mi[i, j]}

    return _column_pairs(cells, weights, made, "i int, j int, mi double")


def purge(cells: DataFrame, identity: float = 0.9, sweep_from: float = 0.2, step: float = 0.01, small: int = 100, cover: int = 100, half_window: int = 27) -> DataFrame:
    """Greedy removal of redundant sequences: (msa_id, seq_id, kept).

    Sequences are taken in falling identity to the query. Alignments of at
    most ``small`` sequences are swept once at ``identity``; larger ones from
    ``sweep_from`` up in steps, where a column whose surroundings (55 columns)
    are covered by ``cover`` accepted sequences no longer raises its
    threshold. A sequence is accepted if its identity to each accepted one is
    below the mean threshold of its columns. The order makes it a sequential
    recurrence within an alignment, so each alignment is one group.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(group["seq_id"].unique())
        width = int(group["pos"].max())
        rows = np.full((len(ids), width), GAP, dtype=np.int16)
        rows[np.searchsorted(ids, group["seq_id"]), group["pos"].to_numpy() - 1] = group["code"]
        matched = rows[0] <= X  # columns where the query has a residue
        valid = (rows < N_RESIDUES) & matched
        sizes = valid.sum(axis=1)

        def same(k: int, others: np.ndarray) -> np.ndarray:
            shared = (valid[others] & valid[k]).sum(axis=1)
            return ((rows[others] == rows[k]) & valid[others]).sum(axis=1) / np.maximum(shared, 1)

        order = np.argsort(-same(0, np.arange(len(ids))), kind="stable")
        order = np.concatenate([[0], order[order != 0]])
        kept = [0]
        chosen = np.zeros(len(ids), dtype=bool)
        chosen[0] = True
        threshold = np.full(width, identity if len(ids) <= small else sweep_from)
        while True:
            for k in order[1:]:
                if chosen[k]:
                    continue
                limit = threshold[valid[k]].mean() if sizes[k] else 0.0
                if (same(k, np.array(kept)) < limit).all():
                    chosen[k] = True
                    kept.append(int(k))
            if len(ids) <= small:
                break
            depth = valid[kept].sum(axis=0)
            padded = np.pad(depth, half_window, constant_values=0)
            full = np.lib.stride_tricks.sliding_window_view(padded, 2 * half_window + 1).max(axis=1) >= cover
            rising = ~full & (threshold < identity - 1e-9)
            if not rising.any():
                break
            threshold[rising] += step
        return pd.DataFrame({"msa_id": group["msa_id"].iloc[0], "seq_id": ids, "kept": chosen})

    kind = dict(cells.dtypes)["msa_id"]
    own = cells.select(*CELL, "code")
    return own.groupBy("msa_id").applyInPandas(one, f"msa_id {kind}, seq_id long, kept boolean")




def _median_of(values: np.ndarray, most: int = N_RESIDUES) -> float:
    """Median of values rounded to whole numbers; an even number of them averages with the next larger one at the half."""
    counts = np.bincount(np.rint(np.minimum(values, most)).astype(int), minlength=most + 1)
    total, upto = counts.sum(), np.cumsum(counts)
    if not total:
        return 0.0
    at = int(np.searchsorted(upto * 2, total))
    if total % 2 == 0 and upto[at] * 2 == total:
        more = np.flatnonzero(counts[at + 1 :])
        if len(more):
            return (at + at + 1 + int(more[0])) / 2
    return float(at)


def state_weights(cells: DataFrame, width: int = 10, least_columns: int = 10, least_share: float = 0.5, cap: float = 20.0) -> DataFrame:
    """Residue weights and observations of each match column: (msa_id, pos, weights array(20), n_symbols, n_match, n_insert, n_delete).

    The sequences of a column's extent get position-based weights over the
    match columns of the extent that at least half of them occupy, or global
    weights where these are fewer than ``least_columns``; the residues' sums
    of weights are normalised. The expected number of distinct residues of the
    alignment, a median over columns, times exp(0.5 (1 - W) ln W), with W the
    global weight of the sequences in a state, gives the observations of the
    state, at most ``cap``; those of insertions are of the columns up to the
    next match column, by the mean weight of their residues.

    An alignment is one group: weights are shared by columns with the same
    members and extent, which is a recurrence along its columns.
    """
    spans = extents(cells, width).select("msa_id", "pos", "left", "right", "interval")
    rows = cells.select(*CELL, "code").join(global_weights(cells), ["msa_id", "seq_id"]).join(spans, ["msa_id", "pos"], "left")
    kind = dict(cells.dtypes)["msa_id"]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        ids, columns = np.sort(group["seq_id"].unique()), np.sort(group["pos"].unique())
        codes = np.full((len(ids), len(columns)), GAP, dtype=np.int16)
        row, col = np.searchsorted(ids, group["seq_id"]), np.searchsorted(columns, group["pos"])
        codes[row, col] = group["code"]
        weight = np.zeros(len(ids))
        weight[row] = group["weight"]
        left, right, interval = (np.full(len(columns), np.nan) for _ in range(3))
        for out, name in ((left, "left"), (right, "right"), (interval, "interval")):
            out[col] = group[name]
        match = codes[0] <= X
        if not match.any():
            return pd.DataFrame(columns=names)
        real = codes <= X
        first = np.where(real.any(axis=1), real.argmax(axis=1), len(columns))
        last = np.where(real.any(axis=1), len(columns) - 1 - real[:, ::-1].argmax(axis=1), -1)
        places = np.flatnonzero(match)
        begin, stop = np.maximum(first, places[0]), np.minimum(last, places[-1])
        valid = real & (codes != X)
        kept: dict = {}
        out, ins_weight, ins_count, before = [], 0.0, 0, None
        expected_of: dict = {}
        for p in range(len(columns)):
            member = (begin <= p) & (p <= stop)
            if not match[p]:
                some = member & valid[:, p]
                ins_weight += weight[some].sum()
                ins_count += int(some.sum())
                continue
            key = (member.tobytes(), left[p], right[p])
            if key not in kept:
                kept[key] = local_weights(codes, valid, match, member, columns, left[p], right[p], interval[p])
            own = kept[key]
            reach = (first <= p) & (p <= last)
            reach[0] = True
            if own is None:
                own, some = weight, reach & valid[:, p]
            else:
                some = member & valid[:, p]
            mass = np.bincount(codes[some, p], own[some], 24)
            mass = spread_pairs(mass / mass.sum() if mass.sum() else mass)
            seen = reach.tobytes()
            if seen not in expected_of:
                expected_of[seen] = max(1.0, _median_of(distinct(codes, valid, match, reach, weight)))
            expected = expected_of[seen]
            observed = lambda w: min(expected * float(np.exp(0.5 * (1 - w) * np.log(w))), cap) if w > 0 else 0.0
            in_match, in_gap = member & valid[:, p], member & (codes[:, p] == GAP)
            most = float(in_match.sum() + in_gap.sum())
            w_match = weight[in_match].sum()
            symbols = observed(w_match if w_match else 1.0)
            ins, dele = observed(ins_weight / ins_count) if ins_count else 0.0, observed(weight[in_gap].sum())
            bound = lambda n: max(min(n, most), 1.0) if n else 0.0
            if before is not None:
                out[before][5] = bound(ins)
            out.append([group["msa_id"].iloc[0], int(columns[p]), mass[:N_RESIDUES].tolist(), max(1.0, symbols), max(1.0, min(symbols, most)), 0.0, bound(dele)])
            before, ins_weight, ins_count = len(out) - 1, 0.0, 0
        if ins_count:  # insertions past the last match column
            out[before][5] = min(observed(ins_weight / ins_count), most)
        return pd.DataFrame(out, columns=names)

    def distinct(codes, valid, match, reach, weight) -> np.ndarray:
        """exp(entropy) of the globally weighted residues of the match columns that enough of the sequences occupy."""
        found = []
        least = int(reach.sum() * least_share)
        for k in np.flatnonzero(match):
            some = reach & valid[:, k]
            if some.sum() < least:
                continue
            mass = np.bincount(codes[some, k], weight[some], 24)
            if mass.sum():
                p = spread_pairs(mass / mass.sum())[:N_RESIDUES]
                p = p[p > 0]
                found.append(float(np.exp(-(p * np.log(p)).sum())))
        return np.array(found)

    def local_weights(codes, valid, match, member, columns, left, right, interval):
        """Position-based weights over an extent, or None for the global ones."""
        if not interval >= least_columns:
            return None
        own, n, total = np.zeros(len(codes)), 0, 0.0
        least = int(member.sum() * least_share)
        for k in np.flatnonzero(match & (columns >= left) & (columns <= right)):
            some = np.flatnonzero(member & valid[:, k])
            if len(some) < least:
                continue
            n += 1
            found, counts = np.unique(codes[some, k], return_counts=True)
            if len(found):
                share = 1.0 / (counts * min(len(found), N_RESIDUES))
                own[some] += share[np.searchsorted(found, codes[some, k])]
                total += 1.0
        return own / own.sum() if n >= least_columns and total else None

    names = ["msa_id", "pos", "weights", "n_symbols", "n_match", "n_insert", "n_delete"]
    schema = f"msa_id {kind}, pos int, weights array<double>, n_symbols double, n_match double, n_insert double, n_delete double"
    return rows.groupBy("msa_id").applyInPandas(one, schema)


def spread_pairs(mass: np.ndarray, priors: tuple[float, ...] = BACKGROUND) -> np.ndarray:
    """Weights (24 codes) with those of X, B, Z and J dealt out by the background; an empty column is the background."""
    base = np.array(priors)
    out = np.zeros(24)
    if not mass.sum():
        out[:N_RESIDUES] = base
        return out
    out[:N_RESIDUES] = mass[:N_RESIDUES] + mass[X] * base
    for code, pair in AMBIGUOUS.items():
        share = base[list(pair)]
        out[list(pair)] += mass[code] * share / share.sum()
    return out


def expected_distinct(n_max: int = 400, priors: tuple[float, ...] = BACKGROUND) -> list[float]:
    """Expected number of distinct residues among 1 .. n_max draws from the background."""
    total = sum(priors)
    return [sum(1 - (1 - p / total) ** n for p in priors) for n in range(1, n_max + 1)]


def observations_of(distinct: float, table: list[float]) -> float:
    """Draws that give so many distinct residues: the inverse, linear between entries."""
    if distinct <= table[0]:
        return 1.0
    if distinct >= table[-1]:
        return float(len(table))
    at = int(np.searchsorted(table, distinct))
    return at + (distinct - table[at - 1]) / (table[at] - table[at - 1])


def without_low_complexity(cells: DataFrame, **options) -> DataFrame:
    """Cells with the low-complexity segments of each ungapped sequence read as X."""
    from seqlake.functions.alphabet import ALPHABET
    from seqlake.operators.segments import seg_sequences

    own = Window.partitionBy("msa_id", "seq_id").orderBy("pos")
    real = residues(cells).withColumn("at", F.row_number().over(own))
    letters = F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda c: decode(c["code"]))
    texts = real.groupBy("msa_id", "seq_id").agg(F.array_join(letters, "").alias("text")).withColumn("key", F.to_json(F.struct("msa_id", "seq_id")))
    found = seg_sequences(texts, "key", F.col("text"), ALPHABET[:N_RESIDUES], **options)
    inside = found.select("key", F.explode(F.sequence("left", "right")).alias("at")).distinct().withColumn("low", F.lit(True))
    marked = real.withColumn("key", F.to_json(F.struct("msa_id", "seq_id"))).join(inside, ["key", "at"]).select(*CELL, "low")
    return cells.join(marked, CELL, "left").withColumn("code", F.when(F.col("low"), F.lit(X)).otherwise(F.col("code"))).drop("low")


def refined_columns(cells: DataFrame, edge: int = 40, **options) -> DataFrame:
    """Cells with high-complexity runs down the columns near either end read as X."""
    from seqlake.operators.segments import seg

    last = cells.groupBy("msa_id").agg(F.max("pos").alias("n_cols"))
    near = cells.join(last, "msa_id").filter((F.col("pos") <= edge) | (F.col("pos") > F.col("n_cols") - edge)).drop("n_cols")
    kinds = dict(cells.dtypes)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group[group["code"] < N_RESIDUES].sort_values("seq_id")
        runs = seg(group["code"].to_numpy().astype(int), inverted=True, **{"low": 3.4, "high": 3.3, **options}) if len(group) else []
        hit = np.zeros(len(group), dtype=bool)
        for a, b in runs:
            hit[a : b + 1] = True
        return group.loc[hit, CELL]

    marked = near.groupBy("msa_id", "pos").applyInPandas(one, ", ".join(f"{c} {kinds[c]}" for c in CELL)).withColumn("high", F.lit(True))
    return cells.join(marked, CELL, "left").withColumn("code", F.when(F.col("high"), F.lit(X)).otherwise(F.col("code"))).drop("high")


def select_sequences(cells: DataFrame, identity: float = 0.9, low_complexity: bool = True, high_complexity: bool = False) -> DataFrame:
    """The selection pipeline: ends trimmed, redundancy removed, low-complexity segments of sequences and (optional) high-complexity runs of columns masked, columns without residues dropped.

    Insert columns stay; which columns are matches follows from the query.
    """
    used = trimmed(cells).filter("n_used > 0").select("msa_id", "seq_id")
    own = cells.join(used, ["msa_id", "seq_id"], "left_semi")
    kept = purge(own, identity).filter("kept").select("msa_id", "seq_id")
    own = own.join(kept, ["msa_id", "seq_id"], "left_semi")
    if low_complexity:
        own = without_low_complexity(own)
    if high_complexity:
        own = refined_columns(own)
    some = own.groupBy("msa_id", "pos").agg(F.min("code").alias("c")).filter(F.col("c") <= X).select("msa_id", "pos")
    return own.join(some, ["msa_id", "pos"], "left_semi")
