"""Conversions: pairwise hits to query-anchored alignments, secondary structure into profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlake.functions.tables import written


def anchored_cells(pairs: DataFrame) -> DataFrame:
    """Cells (query_id, target_id, q_pos, ins, residue) of pairwise alignments (query_id, target_id, q_from, q_aln, t_aln).

    ``ins`` is 0 in a query position and counts the target residues inserted after it.
    """
    letters = F.arrays_zip(F.split("q_aln", "").alias("q"), F.split("t_aln", "").alias("t"))
    cells = pairs.select("query_id", "target_id", "q_from", F.posexplode(letters).alias("at", "cell")).select("query_id", "target_id", "q_from", "at", "cell.q", "cell.t")
    upto = Window.partitionBy("query_id", "target_id").orderBy("at")
    is_query = F.when(F.col("q") != "-", 1).otherwise(0)
    cells = cells.withColumn("k", F.sum(is_query).over(upto))
    own = Window.partitionBy("query_id", "target_id", "k").orderBy("at")
    ins = F.when(F.col("q") != "-", 0).otherwise(F.sum(1 - is_query).over(own))
    return cells.select("query_id", "target_id", (F.col("q_from") + F.col("k") - 1).alias("q_pos"), ins.cast("int").alias("ins"), F.col("t").alias("residue"))


def multiple_alignment(pairs: DataFrame) -> DataFrame:
    """Aligned target strings over the columns of all hits of a query; gaps where a target has nothing.

    The columns of a query are its positions and, after each, as many insert
    columns as any of its hits needs.
    """
    cells = anchored_cells(pairs)
    columns = cells.select("query_id", "q_pos", "ins").distinct()
    targets = pairs.select("query_id", "target_id").distinct()
    grid = targets.join(columns, "query_id").join(cells, ["query_id", "target_id", "q_pos", "ins"], "left")
    row = F.struct("q_pos", "ins", F.coalesce("residue", F.lit("-")).alias("residue"))
    return grid.groupBy("query_id", "target_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda c: c["residue"]), "").alias("aligned"))


def conflicting_positions(pairs: DataFrame) -> DataFrame:
    """Query positions that different hits show with different residues."""
    cells = pairs.select("query_id", "target_id", "q_from", F.posexplode(F.split("q_aln", "")).alias("at", "q"))
    k = F.sum(F.when(F.col("q") != "-", 1).otherwise(0)).over(Window.partitionBy("query_id", "target_id").orderBy("at"))
    own = cells.withColumn("q_pos", F.col("q_from") + k - 1).filter("q <> '-'")
    return own.groupBy("query_id", "q_pos").agg(F.count_distinct("q").alias("n")).filter("n > 1")


def with_ss(profiles: DataFrame, prediction: DataFrame, scale: int = 10000) -> DataFrame:
    """Secondary-structure states and probabilities joined by position; residues must agree.

    Probabilities are cut, not rounded, to 1 / scale.
    """
    joined = profiles.join(prediction.withColumnRenamed("aa", "aa_ss"), ["profile_id", "pos"], "left")
    agree = F.col("aa_ss").isNull() | (F.col("aa") == F.col("aa_ss")) | (F.col("aa") == "X")
    checked = F.when(agree, F.col("state")).otherwise(F.raise_error(F.lit("residues of profile and prediction differ")).cast("string"))
    cut = [F.floor(F.col(c) * scale).cast("int").alias(c) for c in ("pc", "pe", "ph")]
    return joined.select(*profiles.columns, checked.alias("state"), *cut)


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Rows with their number in a total order, without a window over all rows.

    Rows are dealt out by range, numbered within each partition, and raised by
    the counts of the partitions before, a table of one row each.
    """
    part = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = part.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return part.withColumn("_own", own).join(F.broadcast(counts), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def with_query(aligned: DataFrame, queries: DataFrame) -> DataFrame:
    """Cells of hits (query_id, target_id, q_pos, ins, residue) and of the whole query (query_id, residues) itself, as target -1."""
    letters = queries.select("query_id", F.posexplode(F.split("residues", "")).alias("at", "residue"))
    own = letters.select("query_id", F.lit(-1).cast("long").alias("target_id"), (F.col("at") + 1).alias("q_pos"), F.lit(0).alias("ins"), "residue")
    return aligned.unionByName(own)


def query_anchored(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """Aligned strings of hits and, as target -1, of the whole query, over all query positions and the hits' insertions."""
    cells = with_query(anchored_cells(pairs).withColumn("target_id", F.col("target_id").cast("long")), queries)
    columns = cells.select("query_id", "q_pos", "ins").distinct()
    grid = cells.select("query_id", "target_id").distinct().join(columns, "query_id").join(cells, ["query_id", "target_id", "q_pos", "ins"], "left")
    row = F.struct("q_pos", "ins", F.coalesce("residue", F.lit("-")).alias("residue"))
    return grid.groupBy("query_id", "target_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda c: c["residue"]), "").alias("aligned"))


def aligned_text(rows: DataFrame, width: int = 60, style: str = "fasta") -> DataFrame:
    """(query_id, value): aligned strings (query_id, target_id, aligned) as FASTA, lines of ``width``, or in the general style, a numbered line each; the query first."""
    lines = F.regexp_replace("aligned", f"(.{{{width}}})(?=.)", "$1\n")
    fasta = F.concat(F.lit(">"), F.when(F.col("target_id") < 0, "query").otherwise(F.col("target_id").cast("string")), F.lit("\n"), lines, F.lit("\n"))
    plain = F.concat(F.format_string("%-10s ", F.when(F.col("target_id") < 0, "query").otherwise(F.col("target_id").cast("string"))), "aligned", F.lit("\n"))
    entry = F.struct("target_id", (fasta if style == "fasta" else plain).alias("e"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda r: r["e"]), "").alias("value"))
