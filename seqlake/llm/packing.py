"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Only the number of pieces of each length matters for a packing, so the plan
is made from a histogram of lengths, which has at most ``capacity`` rows at
any input size. Pieces longer than a third of the capacity are matched
greedily, at most two to a bin (the longest one that is left takes the
longest partner that fits); shorter ones, in falling length, go to the bin
whose gap fits them best. Bins that hold the same lengths are planned as one
pattern with a count. Each piece then finds its bin by its rank among the
pieces of its length.

Ranks are made without a global sort: a piece is numbered within the file
split that tokenised it, and the splits' counts by length are summed in
order. A length that a third of all pieces share is no hot key that way.

Defined cases: a null or empty text is the closing id alone (length 1);
repeated rows and ids are packed one by one; a null id stays null; texts of
any length are cut into pieces of ``capacity`` ids; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake.llm.common import Scratch, documents, released, runs_by_bytes, spread, text_bytes
from seqlake.llm.tokens import default_path, tokenizer

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
CLOSING_ID = 1
BATCH_BYTES = 4 << 20
#: Distinct words that a worker remembers, and their characters.
MEMORY_WORDS, MEMORY_CHARS = 800_000, 24_000_000

#: A mark between a composed letter and white space is a piece of its own.
_MARK = re.compile(r"(?<=[A-Za-zà-öø-ÿ])([.,])(?=[ \n]|$)")
#: Words that are one piece: lower-case letters that are composed already.
_PLAIN = re.compile(r"[a-zà-öø-ÿ]+")


class _Numbers(dict):
    """Word -> number, given in the order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _split(text: str) -> list[str]:
    """Words whose ids, in order, are those of the text.

    Texts of Latin-1 characters are folded first: the vocabulary folds them
    alike, and none of them composes with another. A special token's string
    is left as it is.
    """
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return _MARK.sub(r" \1", text).replace("\n", " ").split(" ")


class WordIds:
    """Token ids of whitespace-separated words, each distinct word encoded once.

    The vocabulary's pre-tokenizer drops white space and never joins over it,
    so a text's ids are those of its words in order. Plain words are encoded
    in bulk, as one text, and told apart by the word-end mark of each last id.
    """

    def __init__(self, path: str):
        self.path = path
        self.encode = tokenizer(path)
        ends = np.zeros(self.encode.get_vocab_size(with_added_tokens=True), dtype=bool)
        for token, i in self.encode.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends = ends
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.chars = 0
        self.flat = np.zeros(0, dtype=np.uint32)
        self.start = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words, joined in some order, and where each word's ids start and how many they are."""
        plain, other = [], []
        for i, w in enumerate(words):
            (plain if _PLAIN.fullmatch(w) else other).append(i)
        start, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        flat, at = [], 0
        for a in range(0, len(plain), 4000):
            some = plain[a : a + 4000]
            joined = " ".join([words[i] for i in some])
            ids = np.array(self.encode.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):  # a word of several pieces after all
                other += some
                continue
            start[some], length[some] = at + np.append(0, cuts[:-1]), np.diff(cuts, prepend=0)
            flat.append(ids)
            at += len(ids)
        if other:
            found = [done.ids for done in self.encode.encode_batch_fast([words[i] for i in other], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            start[other], length[other] = at + np.cumsum(sizes) - sizes, sizes
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())))
        return np.concatenate(flat or [np.zeros(0, np.uint32)]), start, length

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and the number of each text's ids."""
        if len(self.number) > MEMORY_WORDS or self.chars > MEMORY_CHARS:
            self.clear()
        before = len(self.number)
        numbered = self.number.__getitem__
        places: list[int] = []
        sizes = []
        for text in texts:
            words = _split(text)
            places.extend(map(numbered, words))
            sizes.append(len(words))
        missing = list(islice(self.number, before, None))
        if missing:
            flat, start, length = self._encode(missing)
            self.start = np.concatenate([self.start, len(self.flat) + start])
            self.length = np.concatenate([self.length, length])
            self.flat = np.concatenate([self.flat, flat])
        at = np.array(places, dtype=np.int64)
        each = self.length[at]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        out = self.flat[np.arange(total) + np.repeat(self.start[at] - ends + each, each)]
        sums = np.concatenate([[0], ends])
        edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.chars += sum(map(len, missing))
        return out, np.diff(sums[edges])


_words: dict[str, WordIds] = {}


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, closing: int = CLOSING_ID) -> DataFrame:
    """Every piece, the split that made it, and its number among that split's pieces of its length."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, split int, nth long"

    def made(batches):
        from pyspark import TaskContext

        words = _words.get(path) or _words.setdefault(path, WordIds(path))
        split = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            texts = batch.column(1)
            _, offsets = text_bytes(texts)
            doc_ids = batch.column(0).to_pylist()
            for a, b in runs_by_bytes(offsets, BATCH_BYTES):
                ids, sizes = words.ids([x or "" for x in texts.slice(a, b - a).to_pylist()])
                ids = ids.astype("<u4", copy=False)
                rows, at = [], 0
                for doc_id, size in zip(doc_ids[a:b], sizes.tolist()):
                    own = np.append(ids[at : at + size], np.uint32(closing))
                    at += size
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        n = len(part)
                        rows.append((doc_id, piece, start, n, zlib.crc32(part.tobytes()), split, int(seen[n])))
                        seen[n] += 1
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "split", "nth"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(released(made), schema)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """A packing of ``histogram`` (length -> pieces).

    Returns runs (length, first rank, pieces, first bin, offset) and the
    number of bins: the pieces of ``length`` with ranks from ``first rank`` on
    go one each to the bins from ``first bin`` on, at ``offset``. Steps are
    counted in lengths and patterns, not in pieces.
    """
    left = {n: c for n, c in histogram.items() if c}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of bins (first, number)
    order: list[int] = []  # gaps in rising order
    bins = 0

    def take(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    def put(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in gaps:
                bisect.insort(order, gap)
            gaps.setdefault(gap, []).append((first, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        length = large[-1]
        if length not in left:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - length) - 1
        while at >= 0 and large[at] not in left:
            large.pop(at)
            at = min(bisect.bisect_right(large, capacity - length) - 1, len(large) - 1)
        partner = large[at] if at >= 0 else None
        if partner == length:
            n = left[length] // 2
            if n:
                take(length, n, bins, 0)
                take(length, n, bins, length)
                put(capacity - 2 * length, bins, n)
                bins += n
            if left.get(length) == 1:
                lower = next((x for x in reversed(large[:at]) if x in left), None)
                take(length, 1, bins, 0)
                if lower:
                    take(lower, 1, bins, length)
                put(capacity - length - (lower or 0), bins, 1)
                bins += 1
            continue
        n = min(left[length], left[partner]) if partner else left[length]
        take(length, n, bins, 0)
        if partner:
            take(partner, n, bins, length)
        put(capacity - length - (partner or 0), bins, n)
        bins += n
    for length in sorted(left, reverse=True):
        while length in left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                per = capacity // length
                n, rest = divmod(left[length], per)
                for many, fill in ((n, per), (1 if rest else 0, rest)):
                    if many:
                        for slot in range(fill):
                            take(length, many, bins, slot * length)
                        put(capacity - fill * length, bins, many)
                        bins += many
                continue
            gap = order[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            fill = min(gap // length, max(1, left[length] // n))  # best fit stays with a bin while it fits
            many = min(n, left[length] // fill)
            for slot in range(fill):
                take(length, many, first, capacity - gap + slot * length)
            put(gap - fill * length, first, many)
            if many < n:
                put(gap, first + many, n - many)
    return runs, bins


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, closing: int = CLOSING_ID) -> DataFrame:
    """Sequence and offset of every piece of every document."""
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")
    made = scratch.keep(pieces(df, path, capacity, closing), "pieces")
    counts = scratch.keep(made.groupBy("split", "length").agg(F.count("*").alias("n")), "counts")
    # at most ``capacity`` rows, whatever the input
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan_bins(histogram, capacity)
    runs.sort()
    lengths = np.array([r[0] for r in runs], dtype=np.int64)
    ranks, first, offsets = (np.array([r[i] for r in runs], dtype=np.int64) for i in (1, 3, 4))
    before = Window.partitionBy("length").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("split", "length", "base")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def placed(batches):
        low = np.searchsorted(lengths, np.arange(capacity + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(3).to_numpy()
            rank = batch.column(5).to_numpy()
            at = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                own = length == n
                a, b = low[n], low[n + 1]
                at[own] = a + np.searchsorted(ranks[a:b], rank[own], side="right") - 1
            sequence = first[at] + rank - ranks[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offsets[at])], names=names)

    ranked = made.join(bases.hint("merge"), ["split", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(released(placed), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_path(VOCABULARY))
