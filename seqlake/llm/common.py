"""What the operators share: scratch tables, row spreading, byte-level text arrays."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that may be broadcast as a filter; beyond it the filter is a shuffled join.
BROADCAST_IDS = 1_000_000
#: Rows to an Arrow batch, as rows hold whole texts.
ARROW_ROWS = 2000
#: Bytes of an Arrow batch after which no row is added to it.
ARROW_BYTES = 8 << 20


# -------------------------------------------------------------- workers' memory


def released(made):
    """An Arrow function that gives freed memory back to the machine at the end of its partition.

    Workers outlive their tasks and wait beside those that work, so what they
    keep counts with the executor's memory.
    """

    def run(batches):
        yield from made(batches)
        import ctypes
        import gc

        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


# --------------------------------------------------------------- scratch tables


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir of the session.

    Where it is unset, a session on one machine (local[...], as in tests) gets
    a temporary folder; on a cluster it is an error, as executors would write
    to folders that nobody else reads.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="scratch-"))
    return context.getCheckpointDir().rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small: ARROW_ROWS rows and ARROW_BYTES bytes at most."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        own = re.fullmatch(r"(-?\d+)b?", spark.conf.get(key).lower())
        if own is None or not 0 < int(own[1]) <= most:
            spark.conf.set(key, str(most))


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None:
            return
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session has ended; its folder goes with it
            return

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write and read back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing will read again."""
        for name in names:
            self._remove(f"{self.root}/{name}")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out where the input has fewer splits than the cluster has cores.

    Large inputs keep the splits of their files, so that no text is shuffled.
    """
    bound_batches(df.sparkSession)
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_ids(df: DataFrame, scratch: Scratch) -> tuple[DataFrame, str, bool]:
    """The table with a number that tells its rows apart, the name of that column, and whether ids repeat.

    The number is the row's doc_id where no other row has that id; rows whose
    id repeats or is null get a hash of id and text, which equal rows share.
    """
    name, doc_id, text = free_name(df, "uid"), F.col("doc_id").cast("long"), F.col("text").cast("string")
    ids = df.select(doc_id.alias("again")).groupBy("again").agg(F.count("*").alias("n"))
    again = scratch.keep(ids.filter("n > 1 OR again IS NULL").select("again"), "repeated-ids")
    n = again.count()
    if not n:
        return df.withColumn(name, doc_id), name, False
    columns = [f"c{i}" for i in range(len(df.columns))]  # names that can't clash in the join
    own = df.select(*(F.col(f"`{c}`").alias(x) for c, x in zip(df.columns, columns)), doc_id.alias("own"), F.xxhash64(doc_id, text, F.octet_length(text)).alias("hash"))
    again = F.broadcast(again) if n <= BROADCAST_IDS else again
    marked = own.join(again.withColumn("twice", F.lit(True)), F.col("own").eqNullSafe(F.col("again")), "left")
    uid = F.when(F.col("twice").isNull(), F.col("own")).otherwise(F.col("hash"))
    return marked.select(*(F.col(x).alias(c) for c, x in zip(df.columns, columns)), uid.alias(name)), name, True


def only_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose key is in ids (distinct), broadcast only while ids are few."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


# ------------------------------------------------------------- byte-level arrays

_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base & _MASK, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), on a copy."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte, from the finaliser.
BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 7)
#: The same with A-Z read as a-z.
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
#: Bytes that separate words: 0x20 and 0x09-0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that separate plain words: white space, controls and ASCII punctuation.
IS_MARK = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


class Rolling:
    """Polynomial hashes (modulo 2**64) of any slice of a byte array."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values[data] * powers(_MULT, n), out=self.sums[1:])
        self.inverse = powers(_INV, n + 1)

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for each pair; length is not mixed in."""
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column and the n + 1 offsets of its rows.

    Null counts as empty.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def runs_by_bytes(offsets: np.ndarray, most: int):
    """(from, to) row ranges of about ``most`` bytes each; a longer row stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = IS_SPACE):
    """Start and end of every word (a run of bytes that don't separate) and the word count of each row.

    Words never cross rows.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~separators[data]
    breaks = np.zeros(n + 1, dtype=bool)
    breaks[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | breaks[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | breaks[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = IS_SPACE):
    """A 64-bit hash of every word, A-Z folded, and the word count of each row."""
    starts, ends, counts = word_spans(data, offsets, separators)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    rolled = Rolling(data, FOLDED_VALUES).slices(starts, ends)
    return mix(rolled ^ ((ends - starts).astype(np.uint64) << np.uint64(48))), counts


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = 5):
    """Distinct shingles of every row: row numbers and 64-bit hashes, sorted by both.

    A row with fewer than ``width`` words has its whole sequence as one
    shingle; a row without words has none.
    """
    words, counts = word_hashes(data, offsets)
    n_rows = len(counts)
    first = np.zeros(n_rows + 1, dtype=np.int64)
    np.cumsum(counts, out=first[1:])
    per_row = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    rows = np.repeat(np.arange(n_rows), per_row)
    if not len(rows):
        return rows, np.zeros(0, np.uint64)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row) + first[rows]
    span = np.minimum(counts[rows], width)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = np.zeros(len(rows), dtype=np.uint64)
    for i in range(width):
        term = padded[at + i] * np.uint64(pow(_MULT, 3 * i + 1, 1 << 64))
        total += np.where(span > i, term, np.uint64(0)) if (span <= i).any() else term
    total = mix(total + span.astype(np.uint64), 11)
    edge = 0
    for size in per_row.tolist():  # rows are in order; only the hashes of each are sorted
        if size > 1:
            total[edge : edge + size].sort()
        edge += size
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (total[1:] != total[:-1])
    return rows[fresh], total[fresh]
