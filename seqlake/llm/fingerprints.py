"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the K smallest distinct hashes of a text's five-word
shingles. Sketches of the parts of a text merge into that of the whole, and
two sketches give estimates of resemblance and containment; one gives the
number of distinct shingles. A text with at most K shingles has an exact
sketch.

For each document the query also sketches an edited text: its last quarter
of code points replaced by the first ones of the next document by id. The
rows are dealt out in runs of consecutive ids, cut at ids that exist, and the
first row of each run also goes to the run before it, so that one shuffle
brings every row together with its successor.

Defined cases: a null text counts as empty; texts without words have the
empty sketch, which is like itself (1.0) and unlike all others (0.0); rows
are ordered by id, then text, null ids first, so that repeated rows follow
one another; a single row is its own successor; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm.common import documents, shingle_hashes

#: Hashes in a sketch, and the bytes kept of each.
K, HASH_BYTES = 256, 5
WIDTH = 5
_SHIFT = np.uint64(64 - 8 * HASH_BYTES)
#: Runs of ids that each shuffle partition gets, to even out the hashing of run numbers.
RUNS_PER_PARTITION = 4
BATCH_CHARS = 1 << 20


def sketches(texts: list[bytes], k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """The sketch of each text: at most k hashes, rising."""
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    rows, hashes = shingle_hashes(data, offsets, width)
    edges = np.searchsorted(rows, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own = hashes[a : min(b, a + 2 * k)] >> _SHIFT
        out.append(np.unique(own)[:k] if b - a else own)
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts' union."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum()) / len(union)


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << 8 * HASH_BYTES) / float(a[k - 1] + np.uint64(1))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    union = distinct_shingles(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct_shingles(a, k))


def to_text(sketch: np.ndarray) -> str:
    """The hashes as base64, HASH_BYTES big-endian bytes each."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :].tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), dtype=np.uint8).reshape(-1, HASH_BYTES)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, 8 - HASH_BYTES :] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def with_successor(df: DataFrame) -> DataFrame:
    """Rows (doc_id, text) dealt out by runs of consecutive ids, sorted within runs.

    Each run ends with a copy of the first row of the next run (the last run
    with the first row of all), marked ``closing``.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_runs = parts * RUNS_PER_PARTITION
    known = rows.agg(
        F.min("doc_id").alias("low"),
        F.coalesce(F.max(F.col("doc_id").isNull()), F.lit(False)).alias("nulls"),
        F.percentile_approx("doc_id", [i / n_runs for i in range(1, n_runs)] or [0.5], 20 * n_runs).alias("cuts"),
    ).first()  # one row; its array has a cut for each run
    low, nulls = known["low"], known["nulls"]
    cuts = np.array(sorted({x for x in known["cuts"] or () if x > low}), dtype=np.int64)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        """Twice the run, plus one for a closing copy."""
        out = []
        none = ids.isna().to_numpy()
        value = ids.fillna(0).to_numpy().astype(np.int64)
        run = np.where(none, 0, np.searchsorted(cuts, value, side="right"))
        opens = np.isin(value, cuts) & ~none
        wraps = none if nulls else value == (0 if low is None else low)
        for r, o, w in zip(run.tolist(), opens.tolist(), wraps.tolist()):
            out.append([2 * r] + [2 * r - 1] * o + [2 * len(cuts) + 1] * w)
        return pd.Series(out)

    return (
        rows.withColumn("place", F.explode(places("doc_id")))
        .withColumn("run", F.floor(F.col("place") / 2).cast("int"))
        .repartition(parts, "run")
        .sortWithinPartitions("run", "place", F.col("doc_id").asc_nulls_first(), "text")
        .select("doc_id", "text", "run", (F.col("place") % 2 == 1).alias("closing"))
    )


def fingerprints(df: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Sketches of every text and of its edited text, and their likeness to each other and to the next text."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(pairs):
        """A batch for (id, text, next text) triples."""
        edited, sizes = [], []
        for _, text, after in pairs:
            n = len(text)
            edited.append((text[: n - n // 4] + after[: n // 4]).encode())
            sizes.append(n)
        n = len(pairs)
        # a row's successor is mostly the next row, whose sketch is made anyway
        texts = [p[1].encode() for p in pairs]
        last = [p[2].encode() for i, p in enumerate(pairs) if i + 1 == n or p[2] is not pairs[i + 1][1]]
        own = sketches(texts + last, k, width)
        changed = sketches(edited, k, width)
        rest = iter(own[n:])
        follow = [own[i + 1] if i + 1 < n and p[2] is pairs[i + 1][1] else next(rest) for i, p in enumerate(pairs)]
        columns = [
            pa.array([p[0] for p in pairs], pa.int64()),
            pa.array(sizes, pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
            pa.array([to_text(x) for x in own[:n]]),
            pa.array([to_text(x) for x in changed]),
            pa.array([resemblance(a, b, k) for a, b in zip(own, changed)], pa.float64()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, follow)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def sketched(batches):
        waiting = None  # the last row that still lacks its successor
        pairs, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if waiting is not None and row[2] == waiting[2]:
                    pairs.append((waiting[0], waiting[1], row[1]))
                    size += len(waiting[1])
                waiting = None if row[3] else row
                if size >= BATCH_CHARS:
                    yield finish(pairs)
                    pairs, size = [], 0
        if pairs:
            yield finish(pairs)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successor(df).mapInArrow(sketched, schema)


def op8_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
