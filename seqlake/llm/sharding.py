"""Hilbert-curve sharding: runs of rows along a space-filling curve.

Several metadata columns are quantised, their cells are put in the order of
a Hilbert curve, and the curve is cut into runs of equal row counts, so that
each shard spans a small box in every dimension and files can be pruned by
any of them. Only DataFrame expressions are used.

A row's place along the curve is the number of rows in earlier cells plus
its place in its own cell. Large cells are split by a hash of the id into
slices of bounded number, so no window holds a hot cell as a whole;
the counts that are summed in order are a table of cells and slices.

Defined cases: a null text has size 16 and the checksum of no bytes; null
metadata falls into cell 0; ties on the curve are ordered by a hash slice,
then checksum, id and size, so equal texts of a cell aren't neighbours
beyond a slice; repeated rows each get a slot of their own (which of two equal
rows has which is immaterial); fewer rows than shards leave shards empty;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake.llm.common import documents

N_SHARDS = 40
#: Bits of each of the three quantised dimensions: 2**(3 * 4) = 4096 cells.
BITS = 4
#: Cells are split into slices of at least so many rows, and into so many slices in all.
LEAST_SLICE_ROWS, MOST_SLICES = 512, 1 << 15
ROW_OVERHEAD = 16


def curve_position(coords: list[int], bits: int) -> int:
    """Place of a cell along the Hilbert curve.

    The transposed form of the index is made by undoing excess rotations from
    the highest bit down, Gray-encoding, and interleaving the bits (Skilling,
    "Programming the Hilbert curve", 2004).
    """
    x, n = list(coords), len(coords)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            if x[i] >> bit & 1:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = 0
    for bit in range(bits - 1, 0, -1):
        if x[-1] >> bit & 1:
            flip ^= (1 << bit) - 1
    return sum(((v ^ flip) >> bit & 1) << (bit * n + n - 1 - i) for i, v in enumerate(x) for bit in range(bits))


def hilbert_index(coords: list[Column], bits: int = BITS) -> Column:
    """Curve index of integer coordinates, each from 0 to 2**bits - 1.

    The curve over the 2**(bits * n) cells is worked out once, on the driver,
    and carried in the plan as one string literal of fixed-width hexadecimal
    numbers, which the expression cuts the cell's number out of.
    """
    n, side = len(coords), 1 << bits
    digits = -(-bits * n // 4)
    table = "".join(f"{curve_position([cell >> bits * (n - 1 - i) & (side - 1) for i in range(n)], bits):0{digits}x}" for cell in range(side**n))
    cell = reduce(lambda a, b: a * F.lit(side) + b.cast("int"), coords[1:], coords[0].cast("int"))
    return F.conv(F.substring(F.lit(table), cell * F.lit(digits) + F.lit(1), F.lit(digits)), 16, 10).cast("int")


def _name_code(name: Column, skipped: int) -> Column:
    """Seven bytes of a name from ``skipped`` on as a number, in the order of the names; 0 for null."""
    part = F.substring(name.cast("binary"), skipped + 1, 7)
    return F.coalesce(F.conv(F.rpad(F.hex(part), 14, "0"), 16, 10).cast("long"), F.lit(0))


def quantised(rows: DataFrame, bits: int = BITS) -> list[Column]:
    """Cells of the document metadata: language, source and size.

    Names go to cells in their order, cut where the rows of a cell are about
    equal (a name is never cut), so that a shard's least and largest name
    exclude the others. What all names begin with doesn't count. The size
    cell is its number of binary digits, kept within range. Two passes that
    return one row each find the names' common beginning and the cuts.
    """
    names, cells = ("lang", "source"), 1 << bits
    ends = rows.agg(*(f(c).alias(f"{c}{f.__name__}") for c in names for f in (F.min, F.max))).first()
    known = {c: [(ends[f"{c}{f}"] or "").encode() for f in ("min", "max")] for c in names}
    codes = {c: _name_code(F.col(c), len(commonprefix(known[c])) if known[c][0] else 0) for c in names}
    cuts = rows.agg(*(F.percentile_approx(codes[c], [i / cells for i in range(1, cells)], 10_000).alias(c) for c in names)).first()
    named = [reduce(lambda a, b: a + b, ((codes[c] > F.lit(x)).cast("int") for x in cuts[c] or [0])) for c in names]
    digits = F.length(F.bin(F.col("size"))) - F.lit(5)
    return [*named, F.least(F.greatest(digits, F.lit(0)), F.lit(cells - 1))]


def write_shards(df: DataFrame, path: str, n_shards: int = N_SHARDS, bits: int = BITS) -> None:
    """Store the rows' metadata by shard; the files' least and largest values then exclude most files of a filtered read."""
    hilbert_shards(df, n_shards, bits, ("lang", "source")).repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)


def hilbert_shards(df: DataFrame, n_shards: int = N_SHARDS, bits: int = BITS, extra: tuple[str, ...] = ()) -> DataFrame:
    """Shard and slot of every row, under the law of equal row counts; ``extra`` names metadata to return, too."""
    missing = [F.lit(None).cast("string").alias(c) for c in ("lang", "source") if c not in df.columns]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = df.select("*", *missing).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = rows.select("doc_id", "size", "text_crc32", *extra, hilbert_index(quantised(rows.select("lang", "source"), bits), bits).alias("hilbert"))
    cells = rows.groupBy("hilbert").agg(F.count("*").alias("cell_rows"))  # at most 2**(3 * bits) rows
    before = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "*",
        F.coalesce(F.sum("cell_rows").over(before), F.lit(0)).alias("cell_base"),
        F.sum("cell_rows").over(Window.partitionBy()).alias("total"),
    )
    slice_rows = F.greatest(F.lit(LEAST_SLICE_ROWS), F.col("total") / F.lit(MOST_SLICES))
    rows = rows.join(F.broadcast(cells), "hilbert").withColumn(
        "slice", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.ceil(F.col("cell_rows") / slice_rows))
    )
    in_cell = Window.partitionBy("hilbert").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy("hilbert", "slice").agg(F.count("*").alias("n"))  # at most MOST_SLICES more than cells
    slices = slices.select("hilbert", "slice", F.coalesce(F.sum("n").over(in_cell), F.lit(0)).alias("slice_base"))
    own = Window.partitionBy("hilbert", "slice").orderBy("text_crc32", "doc_id", "size")
    ranked = rows.withColumn("own", F.row_number().over(own)).join(F.broadcast(slices), ["hilbert", "slice"])
    rank = F.col("cell_base") + F.col("slice_base") + F.col("own") - F.lit(1)
    ranked = ranked.withColumn("rank", rank).withColumn("shard", F.floor(F.col("rank") * F.lit(n_shards) / F.col("total")).cast("long"))
    start = F.floor((F.col("shard") * F.col("total") + F.lit(n_shards - 1)) / F.lit(n_shards))
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert", *extra,
    )


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(documents(spark, sf_dir))
