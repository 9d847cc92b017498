"""Exact removal of repeated byte windows by a depth-limited radix sort of suffixes.

A suffix is only ordered through its first ``threshold`` bytes (its window);
suffixes that are still equal there are exactly the repeated windows. The
most significant digit comes first, and a suffix that is alone with its
digits so far leaves the sort. Two things keep the passes small:

* Suffixes go through a pass in runs. The first digit of a window is its
  anchor, the smallest of the hashes of its GRAM-byte pieces; equal windows
  have equal anchors at equal offsets. Neighbouring suffixes share an anchor,
  about half a window of them at a time, and so form one record.
* The next digits of a run are hashes of the bytes that all of its windows
  have (its core) and of the bytes that any of them has (its union). Runs
  with equal unions are repeated as a whole and done; of a run whose core
  is unique no window is repeated; the others are split into shorter runs
  (CELLS offsets each), down to single suffixes.

A done run stays in the sort as the partner of unfinished ones, one record
for all its copies. Every pass is a grouping that is pre-aggregated, and a
join of two written tables, whose hot keys Spark splits.

Removal is judged on the input: every byte under a repeated window goes, in
all its copies, overlaps included. With ``keep_first`` the first copy of each
window (by row number, then place) stays: of each class of equal runs all but
the first are repeated and leave, and the first goes on alone.

This is a sparse form of the sort: a suffix is a record of its own only where
its neighbours' windows differ in copies. With a record for each suffix a
pass moves at least twelve bytes (eight of a digit, four of a place) for each
byte of text, three times the disk that the operator may use.

Defined cases: a null or empty text has no bytes and keeps the checksum of
none; texts shorter than the threshold keep all; repeated rows are
occurrences of one another (with ``keep_first`` they count as one row); ids
may repeat or be null (see ``with_row_ids``); very long texts are read in
overlapping segments; an empty table gives an empty result; other columns are
ignored, or kept as they are by ``without_repeats``. Digits are 64-bit hashes,
a group is told by two of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm.common import BROADCAST_IDS, Rolling, Scratch, documents, free_name, mix, only_ids, released, runs_by_bytes, spread, text_bytes, with_row_ids

THRESHOLD = 400
#: Bytes of an anchor piece, and the offsets of a run in each later pass.
GRAM, CELLS = 24, (64, 8, 1)
BATCH_BYTES = 1 << 19
_POS_BITS = 23
_POS = np.uint64((1 << _POS_BITS) - 1)
#: Anchors of a text that are worked on together, when runs are split: those within 2**_PART_BITS bytes.
_PART_BITS = 22


def _joined(*parts: np.ndarray) -> np.ndarray:
    """One hash of several columns."""
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for i, part in enumerate(parts):
        out = mix(out ^ part.astype(np.uint64), 31 + i)
    return out


def anchored_runs(data: np.ndarray, offsets: np.ndarray, threshold: int = THRESHOLD):
    """Runs of windows with a common anchor, for the texts in ``data``.

    Returns arrays row, first start, last start, anchor position (the last
    three within the text), anchor hash, and the hash of the union.
    """
    n = len(data)
    sizes = np.diff(offsets)
    if n < threshold or not (sizes >= threshold).any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    rolled = Rolling(data)
    width = threshold - GRAM + 1
    at = np.arange(n - GRAM + 1)
    grams = mix(rolled.slices(at, at + GRAM))
    packed = (grams & ~_POS) | at.astype(np.uint64)
    full = -(-len(packed) // width) * width
    blocks = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[: len(packed)] = packed
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n_windows = n - threshold + 1
    anchor = (np.minimum(behind[:n_windows], ahead[width - 1 : width - 1 + n_windows]) & _POS).astype(np.int64)
    rows = np.flatnonzero(sizes >= threshold)
    opens, lasts = offsets[rows], offsets[rows + 1] - threshold
    valid = np.zeros(n_windows + 1, dtype=np.int8)
    valid[opens] += 1
    valid[lasts + 1] -= 1
    valid = np.cumsum(valid[:n_windows]).astype(bool)
    starts = valid.copy()
    starts[1:] &= anchor[1:] != anchor[:-1]
    starts[opens] = True
    first = np.flatnonzero(starts)
    row = np.searchsorted(offsets, first, side="right") - 1
    last = np.empty_like(first)
    last[:-1] = first[1:] - 1
    last[-1] = n_windows - 1
    last = np.minimum(last, offsets[row + 1] - threshold)
    place = anchor[first]
    union = _joined(rolled.slices(first, last + threshold), place - first, last - first)
    base = offsets[row]
    return row, first - base, last - base, place - base, grams[place], union


def _segments(texts, threshold: int):
    """(row numbers, byte offsets within the text, data, offsets) of bounded size; long texts overlap by a window less one."""
    _, offsets = text_bytes(texts)
    most = 1 << (_POS_BITS - 1)
    for a, b in runs_by_bytes(offsets, BATCH_BYTES):
        data, own = text_bytes(texts.slice(a, b - a))
        if len(data) <= most:
            yield a, 0, data, own
            continue
        for at in range(0, max(1, len(data) - threshold + 1), most):
            part = data[at : at + most + threshold - 1]
            yield a, at, part, np.array([0, len(part)], dtype=np.int64)


def _records(rows: DataFrame, threshold: int) -> DataFrame:
    names = ["uid", "m", "lo", "hi", "core", "union"]

    def made(batches):
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for base, shift, data, offsets in _segments(batch.column(1), threshold):
                row, first, last, place, core, union = anchored_runs(data, offsets, threshold)
                columns = [uids[base + row], (place + shift).astype(np.int32), (place - last).astype(np.int32), (place - first).astype(np.int32), core.view(np.int64), union.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return rows.select("uid", "text").mapInArrow(released(made), "uid long, m int, lo int, hi int, core long, union long")


def _split(texts: DataFrame, items: DataFrame, cell: int, threshold: int) -> DataFrame:
    """The items' runs cut at multiples of ``cell``, with the hashes of their cores and unions."""
    names = ["uid", "m", "lo", "hi", "done", "core", "union"]
    most = threshold - GRAM

    def cut(batches):
        for batch in batches:
            made = []
            for i in range(batch.num_rows):
                raw = np.frombuffer((batch.column(1)[i].as_py() or "").encode(), dtype=np.uint8)
                held = batch.column(2)[i].values
                m, lo, hi = (held.field(c).to_numpy().astype(np.int64) for c in ("m", "lo", "hi"))
                done = held.field("done").to_numpy(zero_copy_only=False)
                per = hi // cell - lo // cell + 1
                item = np.repeat(np.arange(len(m)), per)
                number = np.arange(len(item)) - np.repeat(np.cumsum(per) - per, per) + (lo // cell)[item]
                m, lo, hi, done = m[item], lo[item], hi[item], done[item]
                low, high = number * cell, np.minimum(number * cell + cell - 1, most)
                lo, hi = np.maximum(lo, low), np.minimum(hi, high)
                # only a bounded part of a long text is hashed at a time: the windows of the runs whose anchors lie in it
                order = np.argsort(m, kind="stable")
                edges = np.flatnonzero(np.diff(m[order] >> _PART_BITS, prepend=-1)).tolist()
                for a, b in zip(edges, [*edges[1:], len(order)]):
                    own = order[a:b]
                    base = int((m[own] - hi[own]).min())
                    rolled = Rolling(raw[base : int((m[own] - lo[own]).max()) + threshold])
                    at = m[own] - base
                    core = _joined(rolled.slices(at - low[own], at - high[own] + threshold), number[own])
                    union = _joined(rolled.slices(at - hi[own], at - lo[own] + threshold), lo[own], hi[own])
                    made.append((np.full(len(own), batch.column(0)[i].as_py()), *(x.astype(np.int32) for x in (m[own], lo[own], hi[own])), done[own], core.view(np.int64), union.view(np.int64)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], names=names)

    own = items.groupBy("uid").agg(F.collect_list(F.struct("m", "lo", "hi", "done")).alias("items"))
    return texts.join(own, "uid").select("uid", "text", "items").mapInArrow(
        released(cut), "uid long, m int, lo int, hi int, done boolean, core long, union long"
    )


def _pass(runs: DataFrame, scratch: Scratch, name: str, threshold: int, keep_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """One digit: the spans it finds repeated, and the runs that must be split further.

    ``runs`` has uid, m, lo, hi, done, core and union; a done run is known to
    be repeated and only serves as a partner. With ``keep_first`` no run is
    ever done: the first of a class goes on like any other.
    """
    groups = runs.groupBy("core").agg(F.count("*").alias("n"), F.min("done").alias("all_done"), F.min("union").alias("low"), F.max("union").alias("high"))
    groups = scratch.keep(groups.filter("n > 1 AND NOT all_done").select("core", (F.col("low") != F.col("high")).alias("mixed")), f"{name}-groups")
    alive = scratch.keep(runs.join(groups, "core"), f"{name}-alive")
    classes = alive.groupBy("core", "union").agg(
        (F.max("done") | (F.count("*") > 1)).alias("done"), F.max("mixed").alias("mixed"), F.min(F.struct("uid", "m", "lo", "hi")).alias("rep")
    )
    classes = scratch.keep(classes, f"{name}-classes")
    span = ["uid", (F.col("m") - F.col("hi")).alias("start"), (F.col("m") - F.col("lo") + F.lit(threshold)).alias("end")]
    if keep_first:
        later = alive.join(classes.filter("done").select("core", "union", "rep"), ["core", "union"]).filter(F.struct("uid", "m", "lo", "hi") != F.col("rep"))
        found = scratch.keep(later.select(*span), f"{name}-found")
        left = scratch.keep(classes.filter("mixed").select("rep.*", F.lit(False).alias("done")), f"{name}-left")
        scratch.drop(f"{name}-groups", f"{name}-alive", f"{name}-classes")
        return found, left
    found = alive.filter("NOT done").join(classes.filter("done").select("core", "union"), ["core", "union"])
    found = scratch.keep(found.select(*span), f"{name}-found")
    mixed = classes.filter("mixed")
    open_groups = scratch.keep(mixed.groupBy("core").agg(F.min("done").alias("all_done")).filter("NOT all_done").select("core"), f"{name}-open")
    left = scratch.keep(mixed.join(open_groups, "core").select("rep.*", "done"), f"{name}-left")
    scratch.drop(f"{name}-groups", f"{name}-alive", f"{name}-classes", f"{name}-open")
    return found, left


def repeated_spans(rows: DataFrame, scratch: Scratch, threshold: int = THRESHOLD, keep_first: bool = False) -> DataFrame:
    """(uid, spans) of every row (uid, text) with repeated windows; spans may overlap."""
    runs = scratch.keep(_records(rows, threshold), "records").withColumn("done", F.lit(False))
    found, left = _pass(runs, scratch, "anchor", threshold, keep_first)
    scratch.drop("records")
    uids = scratch.keep(left.select("uid").distinct(), "uids")
    texts = scratch.keep(only_ids(rows.select("uid", "text"), "uid", uids).dropDuplicates(["uid"]), "texts")
    for cell in CELLS:
        runs = scratch.keep(_split(texts, left, cell, threshold), f"runs{cell}")
        more, left = _pass(runs, scratch, f"cell{cell}", threshold, keep_first)
        scratch.drop(f"runs{cell}")
        found = found.unionByName(more)
    scratch.drop("texts", "uids")
    spans = found.distinct().groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return scratch.keep(spans, "spans")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = starts[1:] > ends[:-1]
    at = np.flatnonzero(fresh)
    return starts[at], ends[np.append(at[1:], len(starts)) - 1]


def _cut(raw: bytes, spans) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the runs they make up."""
    a, b = merged(spans.field("start").to_numpy().astype(np.int64), spans.field("end").to_numpy().astype(np.int64))
    kept, at = [], 0
    for x, y in zip(a.tolist(), b.tolist()):
        kept.append(raw[at:x])
        at = y
    kept.append(raw[at:])
    return b"".join(kept), int((b - a).sum()), len(a)


def _parts(df: DataFrame, threshold: int, key: str | None, keep_first: bool = False) -> tuple[DataFrame, DataFrame, str]:
    """Rows without repeated windows, rows with them and a column of their spans, and that column's name."""
    scratch = Scratch(df.sparkSession, "suffix")
    if key is None:
        df, key, _ = with_row_ids(df, scratch)
    name = free_name(df, "spans")
    rows = df.select(F.col(key).alias("uid"), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(spread(rows), scratch, threshold, keep_first).select(F.col("uid").alias(key), F.col("spans").alias(name))
    uids = spans.select(key)
    uids = F.broadcast(uids) if uids.count() <= BROADCAST_IDS else uids
    return df.join(uids, key, "left_anti"), df.join(uids, key, "left_semi").join(spans, key), name


def removal_digest(df: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Bytes, bytes and runs removed, and the checksum of what is kept, for every row."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole, cut, _ = _parts(rows, threshold, None)

    def digests(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            out = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = text.encode()
                kept, removed, n = _cut(raw, batch.column(2)[i].values)
                out.append((batch.column(0)[i].as_py(), len(raw), removed, n, hashlib.sha256(kept).hexdigest()))
            if out:
                kinds = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    text = F.coalesce("text", F.lit(""))
    same = whole.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return same.unionByName(cut.select("doc_id", "text", "spans").mapInArrow(released(digests), schema))


def without_repeats(df: DataFrame, threshold: int = THRESHOLD, keep_first: bool = False, key: str | None = None) -> DataFrame:
    """The rows with repeated windows cut out of their texts, in all places or all but the first; characters cut in half go too.

    ``key`` names a column of numbers that tell rows apart, which isn't returned.
    """
    whole, cut, spans = _parts(df, threshold, key, keep_first)
    columns = [F.col(f"`{c}`") for c in df.columns if c != key]

    @F.pandas_udf("string")
    def rest(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(text, spans):
            pairs = pa.StructArray.from_arrays([pa.array([x["start"] for x in own]), pa.array([x["end"] for x in own])], ["start", "end"])
            out.append(_cut(t.encode(), pairs)[0].decode("utf-8", "ignore"))
        return pd.Series(out)

    shorter = cut.withColumn("text", rest("text", spans))
    if "n_chars" in df.columns:
        shorter = shorter.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
    return whole.select(*columns).unionByName(shorter.select(*columns))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(documents(spark, sf_dir))
