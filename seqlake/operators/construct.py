"""From aligned sequences to profiles: the construction pipeline.

Selection, weights by extents, transitions at every match column, targets,
background and posterior probabilities, scores. Each step is an operator of
``msa`` or ``profiles``; this module only puts them together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.functions.alphabet import BACKGROUND, N_RESIDUES, decode
from seqlake.functions.tables import written
from seqlake.operators import convert, msa, search
from seqlake.operators import profiles as pr
from seqlake.sources import formats

#: Ratios that say nothing of pairs of residues: pseudocounts are the background.
NEUTRAL = [[1.0] * N_RESIDUES for _ in range(N_RESIDUES)]


def positions(cells: DataFrame, ratios: list[list[float]] = NEUTRAL, priors: tuple[float, ...] = BACKGROUND, lam: float = 1.0) -> DataFrame:
    """Match columns as profile positions: (profile_id, pos, column, aa, obs, trg, information, score, n_obs, mid, trn).

    ``trn`` holds the nine target transitions out of the position, in the
    order of ``TRANSITION_ALPHAS``; those out of the begin state are all to a match.
    """
    weights = msa.global_weights(cells)
    own = written(msa.state_weights(cells)).withColumn("k", F.row_number().over(Window.partitionBy("msa_id").orderBy("pos")).cast("long"))
    steps = pr.target_transitions(msa.transition_counts(cells, weights), own.select("msa_id", "k", "n_match", "n_insert", "n_delete"))
    order = {x: i for i, x in enumerate(pr.TRANSITION_ALPHAS)}
    place = F.create_map(*(F.lit(v) for item in order.items() for v in item))[F.col("step")]
    trn = steps.groupBy("msa_id", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("i"), "p"))), lambda x: x["p"]).alias("trn"))
    letters = msa.query_cells(cells).select("msa_id", "pos", decode(F.col("code")).alias("aa"))
    rows = own.join(trn, ["msa_id", "k"]).join(letters, ["msa_id", "pos"])
    rows = pr.target_estimates(rows, "weights", "n_symbols", ratios, priors, lam)
    return rows.select(
        F.col("msa_id").alias("profile_id"), F.col("k").cast("int").alias("pos"), F.col("pos").alias("column"), "aa", F.col("weights").alias("obs"), "trg",
        "information", "score", F.col("n_symbols").alias("n_obs"), F.array("n_match", "n_insert", "n_delete").alias("mid"), "trn",
    )


def constructed(cells: DataFrame, identity: float = 0.9, ratios: list[list[float]] = NEUTRAL, lam: float = 1.0, select: bool = True, **options) -> DataFrame:
    """Profiles of alignments: the positions and of each profile ``len``, ``n_seqs``, ``eff_nos``, ``bkg`` and ``post``."""
    own = written(msa.select_sequences(cells, identity, **options)) if select else cells
    rows = written(positions(own, ratios, lam=lam))
    seqs = own.groupBy(F.col("msa_id").alias("profile_id")).agg(F.count_distinct("seq_id").alias("n_seqs"))
    eff = msa.histogram_median(rows, "profile_id", "n_obs").withColumnRenamed("median", "eff_nos")
    rows = rows.join(eff, "profile_id").join(seqs, "profile_id")

    def packed(long: DataFrame, name: str) -> DataFrame:
        return long.groupBy("profile_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "p"))), lambda x: x["p"]).alias(name))

    bkg = packed(pr.recomputed_background(rows, F.col("eff_nos")), "bkg")
    rows = rows.join(bkg, "profile_id").join(packed(pr.posteriors(rows), "post"), "profile_id")
    return rows.withColumn("len", F.count("*").over(Window.partitionBy("profile_id")).cast("int"))


def searchable(rows: DataFrame) -> DataFrame:
    """Constructed profiles as the search packs them: targets, background, log transitions by position, context vectors, effective number.

    Transitions out of gap states are damped; profiles too short for a
    context window have none.
    """
    damping = [1.0 if x[0] == "M" else 0.4 for x in pr.TRANSITION_ALPHAS]
    damped = F.transform(F.arrays_zip("trn", F.array(*(F.lit(x) for x in damping)).alias("f")), lambda z: F.when(z["trn"] > 0, F.log(z["trn"]) * z["f"]).otherwise(F.lit(pr.LOG_ZERO)))
    begin = F.array(*(F.lit(0.0 if x[1] == "M" else pr.LOG_ZERO) for x in pr.TRANSITION_ALPHAS))
    cv = pr.context_vectors(rows).withColumn("prior", pr.context_prior(F.col("norm2")))
    own = rows.select("profile_id", "pos", "aa", "trg", "bkg", damped.alias("trn"), begin.alias("begin_trn"), F.col("eff_nos").alias("eno_profile"))
    return own.join(cv, ["profile_id", "pos"], "left")


def profiles_of(sequences: DataFrame, **options) -> DataFrame:
    """Constructed profiles of aligned sequences (msa_id, seq_id, residues), as readers give them, with the alignment's ``name`` and a number as id."""
    names = written(convert.numbered(sequences.select(F.col("msa_id").cast("string").alias("name")).distinct(), [F.col("name")], "id"), "names")
    own = sequences.withColumn("name", F.col("msa_id").cast("string")).join(names, "name").withColumn("msa_id", F.col("id").cast("long"))
    rows = constructed(formats.cells(own.select("msa_id", "seq_id", "residues")), **options)
    return rows.join(names.select("name", F.col("id").cast("long").alias("profile_id")), "profile_id")


def search_alignments(queries: DataFrame, database: DataFrame, cutoff: float = 10.0, terms: search.Terms = search.Terms(), model=None, **options) -> DataFrame:
    """The whole way: alignments (sequences of readers) of queries and of a database made profiles, searched and ranked, with names."""
    sides = [written(profiles_of(x, **options), "profiles") for x in (queries, database)]
    one, two = (written(search.packed(searchable(x)), "packed") for x in sides)
    size = two.agg(F.sum("len").alias("n"), F.count("*").alias("k")).first()
    found = search.hits(one, two, terms=terms, cutoff=cutoff, n_positions=int(size["n"] or 1))
    ranked = search.top_hits(search.with_evalues(found, one, int(size["n"] or 1), int(size["k"]), model), cutoff=cutoff)
    named = [x.select(F.col("profile_id").alias(f"{c}_id"), F.col("name").alias(f"{c}_name")).distinct() for x, c in zip(sides, ("query", "target"))]
    return ranked.join(named[0], "query_id").join(named[1], "target_id")
