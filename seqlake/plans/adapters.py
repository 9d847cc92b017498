"""Engine inputs derived from the driver's tables, whole tables throughout.

Each has a DataFrame and a DuckDB form (``*_SQL``), which give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake.functions.alphabet import ALPHABET, GAP, N_RESIDUES
from seqlake.operators import profiles as pr

#: Components from -0.3 up become residues in steps of 1/40, anything else a gap.
LOW, STEPS = 0.3, 40
#: Components are spread by this before they become probabilities.
SPREAD = 8.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(value: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned sequences from vectors: an alignment for each label, a sequence for each vector."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("msa_id"), F.col("vec_id").alias("seq_id"), F.posexplode("embedding").alias("at", "v")
    )
    code = F.floor((F.col("v").cast("double") + LOW) * STEPS).cast("int")
    return rows.select("msa_id", "seq_id", (F.col("at") + 1).alias("pos"), F.when(code.between(0, N_RESIDUES - 1), code).otherwise(GAP).alias("code"))


CELLS_SQL = f"""
cell AS (
  SELECT msa_id, seq_id, pos, CASE WHEN c BETWEEN 0 AND {N_RESIDUES - 1} THEN c ELSE {GAP} END AS code
  FROM (SELECT label::BIGINT AS msa_id, vec_id AS seq_id, pos, floor((v::DOUBLE + {LOW}) * {STEPS})::INT AS c
        FROM (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1)::INT AS pos FROM embeddings))
)"""

WEIGHTS_SQL = f"""{CELLS_SQL},
res AS (SELECT * FROM cell WHERE code < {N_RESIDUES}),
cnt AS (SELECT msa_id, pos, code, count(*) AS copies FROM res GROUP BY ALL),
cnt2 AS (SELECT *, count(*) OVER (PARTITION BY msa_id, pos) AS dist FROM cnt),
sums AS (SELECT msa_id, seq_id, sum(1.0::DOUBLE / (copies * dist)) AS w, count(*) AS n FROM res JOIN cnt2 USING (msa_id, pos, code) GROUP BY ALL),
raw AS (SELECT msa_id, seq_id, coalesce(w / greatest(n + 1, 30), 0) AS w FROM (SELECT DISTINCT msa_id, seq_id FROM cell) LEFT JOIN sums USING (msa_id, seq_id)),
weights AS (SELECT msa_id, seq_id, w / sum(w) OVER (PARTITION BY msa_id) AS weight FROM raw)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile positions from vectors: a profile for each label, its vectors in order of id.

    Components 1-20 give targets, 21-40 observed weights, 41-59 a context
    vector, 60-62 secondary-structure probabilities, 63 and 64 the
    observations and the effective number.
    """
    v = F.transform("embedding", lambda x: x.cast("double") * SPREAD)
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("profile_id"), "vec_id", v.alias("v"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("profile_id").orderBy("vec_id")))
    trg = pr.softmax(F.slice("v", 1, 20))
    rows = rows.select(
        "profile_id", "pos", trg.alias("trg"), pr.softmax(F.slice("v", 21, 20)).alias("obs"), F.slice("v", 41, 19).alias("cv"), pr.softmax(F.slice("v", 60, 3)).alias("ss"),
        (F.lit(1.0) + F.abs(F.element_at("v", 63)) * 3).alias("n_obs"), (F.lit(1.0) + F.abs(F.element_at("v", 64)) * 3).alias("eno"),
    )
    best = F.array_position("trg", F.array_max("trg"))
    return rows.withColumn("aa", F.substring(F.lit(ALPHABET), best.cast("int"), F.lit(1)))


def _softmax_sql(part: str) -> str:
    return f"list_transform({part}, lambda x: exp(x) / list_sum(list_transform({part}, lambda y: exp(y))))"


PROFILES_SQL = f"""
vec AS (SELECT label::BIGINT AS profile_id, vec_id, list_transform(embedding, lambda x: x::DOUBLE * {SPREAD}) AS v FROM embeddings),
prof AS (
  SELECT profile_id, row_number() OVER (PARTITION BY profile_id ORDER BY vec_id)::INT AS pos,
         {_softmax_sql("v[1:20]")} AS trg, {_softmax_sql("v[21:40]")} AS obs, v[41:59] AS cv, {_softmax_sql("v[60:62]")} AS ss,
         1.0 + abs(v[63]) * 3 AS n_obs, 1.0 + abs(v[64]) * 3 AS eno
  FROM vec
),
longp AS (SELECT profile_id, pos, unnest(trg) AS q, generate_subscripts(trg, 1)::INT - 1 AS code FROM prof),
meanp AS (SELECT profile_id, code, avg(q) AS p FROM longp GROUP BY ALL),
post AS (SELECT profile_id, code, p / sum(p) OVER (PARTITION BY profile_id) AS p FROM meanp)"""


def backgrounds(own: DataFrame) -> DataFrame:
    """(profile_id, bkg): posterior residue probabilities as an array."""
    rows = pr.posteriors(own).groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("code", "p"))).alias("r"))
    return rows.select("profile_id", F.transform("r", lambda x: x["p"]).alias("bkg"))


def log_transitions() -> Column:
    """Prior transitions as an array of damped logarithms, gap states at 0.4."""
    import math

    out = []
    for step, alpha in pr.TRANSITION_ALPHAS.items():
        total = sum(a for s, a in pr.TRANSITION_ALPHAS.items() if s[0] == step[0])
        out.append(math.log(alpha / total) * (1.0 if step[0] == "M" else 0.4) if alpha else pr.LOG_ZERO)
    return F.array(*(F.lit(x) for x in out))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of symbols for each user: the types of the events in order."""
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
