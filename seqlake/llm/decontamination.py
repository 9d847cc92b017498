"""Benchmark decontamination by latent semantic retrieval.

1. Words (runs of anything but white space and ASCII punctuation, A-Z folded)
   that occur in the benchmark are its vocabulary; texts become sequences of
   vocabulary numbers. Words in more than a share of all passages carry no
   weight; the others are weighted by inverse passage frequency. An item that
   keeps too few words by that, as one that leaks often does, has the rarer
   half of its words weighted all the same.
2. A randomised SVD of the TF-IDF matrix of all passages of all texts (those
   with at least LEAST_WORDS weighted words) gives a latent space, by two
   passes. In the first each split sums A'(A Omega) over its passages; the
   sums are added up by word and made an orthonormal basis Q. In the second
   each split sums (A Q)'(A Q), whose eigenvectors turn Q to the singular
   directions, of which the first ones are kept.
3. Every passage is projected and held against every item by cosine, in
   blocks. Passages overlap by half, and each item meets passages of about its
   own length. Besides, every run of RUN words of an item (of all its words, if
   it has fewer) is looked up in the texts by its hash, so that verbatim leaks
   are candidates whatever their words weigh.
4. Candidates are confirmed on the words around the passage: the longest
   common subsequence must hold a share of the item's words, and also a share
   of its answer part, its last third. Word order, insertions, deletions and
   replacements are thus allowed for, common words by chance aren't enough.
   RUN words in a row are a match without that, whatever share they hold.

The benchmark is worked through in blocks of ITEMS_PER_BLOCK items, so that
what the driver holds (a block's items, its vocabulary and the word vectors of
that vocabulary) is bounded; texts are never collected.

Defined cases: a null or empty text, or an item without words, matches
nothing; an item of fewer than LEAST_WORDS words is found in texts that
consist of just its words, in its order; a text
shorter than a passage is one passage; repeated rows and repeated items each
get their rows; a null id stays null; an empty documents or benchmark table
gives an empty result; very long texts are searched whole; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm.common import IS_MARK, Scratch, documents, mix, released, runs_by_bytes, spread, text_bytes, with_row_ids, word_hashes

ITEMS_PER_BLOCK = 512
BATCH_BYTES = 2 << 20
#: Words to a block; passages of 2, 4, 8 ... blocks start at every half passage.
BLOCK = 16
#: Passages with fewer weighted words aren't rows of the matrix and no candidates.
LEAST_WORDS = 4
#: Share of the weighted words of an item (the one with the fewest, of those of its length) that a passage must number.
WEIGHTED_SHARE = 0.4
#: Words in more than this share of the passages, and in more than so many, carry no weight.
COMMON_SHARE, COMMON_LEAST = 0.005, 50
#: An item with a smaller share of weighted words, or fewer than so many, keeps the rarer half of its words.
KEPT_SHARE, KEPT_LEAST = 0.25, 2 * LEAST_WORDS
#: Words of a verbatim run that is looked up exactly.
RUN = 13
#: Directions of the latent space: so many at least, and so many for each item of a block.
RANK, ITEM_RANK, OVERSAMPLING, SEED = 112, 0.56, 16, 20
#: Passages that each item counts as in the matrix, so that its direction is part of the space: so many at least, and this share of all.
ITEM_ROWS, ITEM_SHARE = 50, 0.0004
COSINE = 0.25
#: Shares of the item's and of its answer's words in the longest common subsequence, and the least number of the former.
LCS_SHARE, ANSWER_SHARE, LCS_LEAST = 0.6, 0.5, 5


# ---------------------------------------------------------------- vocabulary


def run_hashes(words: np.ndarray, lengths: set[int]) -> dict[int, np.ndarray]:
    """Hashes of the runs of so many words that start at each word."""
    word = mix(words.astype(np.int64).view(np.uint64) + np.uint64(1))
    out, held = {}, np.zeros(len(word), dtype=np.uint64)
    for n in range(1, max(lengths, default=0) + 1):
        held = held[: max(0, len(word) - n + 1)] * np.uint64(0x9E3779B97F4A7C15) + word[n - 1 :]
        if n in lengths:
            out[n] = held
    return out


class Items:
    """A block of benchmark items as vocabulary numbers."""

    def __init__(self, item_ids: list, texts: list[str | None]):
        column = pa.array([x or "" for x in texts], pa.string())
        hashes, counts = word_hashes(*text_bytes(column), IS_MARK)
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        self.ids = item_ids
        self.words = np.split(numbers.astype(np.int32), np.cumsum(counts)[:-1])
        self.runs = self._runs()
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The vocabulary number of each hash, or -1."""
        out = np.full(len(hashes), -1, dtype=np.int32)
        some = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[some])
        at[at == len(self.vocabulary)] = 0
        hit = self.vocabulary[at] == hashes[some]
        out[some[hit]] = at[hit]
        return out

    def _runs(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Hashes of the runs of the items, sorted, and their items, by the number of words of a run."""
        found: dict[int, list] = {}
        for item, words in enumerate(self.words):
            n = min(RUN, len(words))
            if n:
                own = np.unique(run_hashes(words, {n})[n])
                found.setdefault(n, []).append((own, np.full(len(own), item)))
        out = {}
        for n, parts in found.items():
            hashes, owners = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            out[n] = hashes[order], owners[order]
        return out

    def verbatim(self, words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, first word in the batch) of each stretch of a text whose runs of words are an item's."""
        row = np.repeat(np.arange(len(counts)), counts)
        end = np.repeat(np.cumsum(counts), counts)
        # words from each on without one that isn't in the vocabulary, within the text
        place = np.arange(len(words))
        other = np.minimum.accumulate(np.where(words < 0, place, len(words))[::-1])[::-1]
        reach = np.minimum(other, end) - place
        found = []
        hashed = run_hashes(words, set(self.runs))
        for n, (hashes, owners) in self.runs.items():
            at = np.flatnonzero(reach[: len(hashed[n])] >= n)
            if n < LEAST_WORDS:  # so few words are a leak only where they are the whole text
                at = at[(counts[row[at]] == n) & (end[at] - at == n)]
            low, high = np.searchsorted(hashes, hashed[n][at], "left"), np.searchsorted(hashes, hashed[n][at], "right")
            times = high - low
            at, first = np.repeat(at, times), np.repeat(low, times)
            item = owners[first + np.arange(len(first)) - np.repeat(np.cumsum(times) - times, times)]
            order = np.lexsort((at, item))
            at, item = at[order], item[order]
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
            found += zip(row[at[fresh]].tolist(), item[fresh].tolist(), at[fresh].tolist())
        return found

    def times(self) -> np.ndarray:
        """How often each item has each word of the vocabulary; the last column stands for other words."""
        out = np.zeros((len(self.words), len(self.vocabulary) + 1), dtype=np.uint16)
        for item, words in enumerate(self.words):
            numbers, times = np.unique(words, return_counts=True)
            out[item, numbers] = np.minimum(times, 0xFFFF)
        return out

    def passage_blocks(self, item: int) -> int:
        """Blocks of the passages that an item is held against."""
        blocks = 2
        while blocks * BLOCK < len(self.words[item]):
            blocks *= 2
        return blocks


def enough(words: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray, times: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Which of the stretches words[low:high] have so many of the item's words that its common subsequence may be long enough.

    A common subsequence has no word more often than either side, so nothing
    is lost. ``times`` has a row for each item and its words' numbers as columns.
    """
    out = np.zeros(len(low), dtype=bool)
    if not len(low):
        return out
    width = int((high - low).max())
    place, none = np.arange(width), times.shape[1] - 1
    each = max(1, (1 << 19) // max(1, width))
    for at in range(0, len(low), each):
        a, b, own = low[at : at + each, None], high[at : at + each, None], item[at : at + each]
        part = words[np.minimum(a + place, len(words) - 1)]
        part = np.where((a + place < b) & (part >= 0), part, none)
        some = np.flatnonzero(np.count_nonzero(times[own[:, None], part], axis=1) >= needed[own])
        part = np.sort(part[some], axis=1)
        first = np.zeros(part.shape, dtype=np.int64)
        first[:, 1:] = np.where(part[:, 1:] != part[:, :-1], place[1:], 0)
        copies = place - np.maximum.accumulate(first, axis=1)
        held = np.count_nonzero(copies < times[own[some][:, None], part], axis=1)
        out[at + some[held >= needed[own[some]]]] = True
    return out


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel); negative words match nothing."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = masks.get(w, 0) if w >= 0 else 0
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


# ------------------------------------------------------------------ passages


def _encoded(rows: DataFrame, items: Items) -> DataFrame:
    """(uid, doc_id, words): every text as little-endian 32-bit vocabulary numbers, -1 for other words."""

    def made(batches):
        for batch in batches:
            _, offsets = text_bytes(batch.column(2))
            for a, b in runs_by_bytes(offsets, BATCH_BYTES):
                hashes, counts = word_hashes(*text_bytes(batch.column(2).slice(a, b - a)), IS_MARK)
                raw = items.numbers(hashes).astype("<i4")
                edges = np.concatenate([[0], np.cumsum(counts)]) * 4
                words = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), words], names=["uid", "doc_id", "words"])

    return rows.mapInArrow(released(made), "uid long, doc_id long, words binary")


def _word_batches(batches, most: int = 1 << 18):
    """(batch, first row, words, counts) of bounded size from batches of encoded texts; a longer text stands alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("words"))
        data, offsets = text_bytes(column)
        for a, b in runs_by_bytes(offsets, 4 * most):
            yield batch, a, np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), dtype="<i4"), np.diff(offsets[a : b + 1]) // 4


class Passages:
    """Passages of n blocks over the texts of a batch, as sums over blocks."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, weighted: np.ndarray):
        blocks = -(-counts // BLOCK)
        self.first_block = np.concatenate([[0], np.cumsum(blocks)])
        self.row_of_block = np.repeat(np.arange(len(counts)), blocks)
        row = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        keep = np.flatnonzero(words >= 0)
        keep = keep[weighted[words[keep]]]
        self.words = words[keep]
        self.block = self.first_block[row[keep]] + within[keep] // BLOCK  # never falls
        self.n_blocks = int(self.first_block[-1])

    def by_block(self, values: np.ndarray) -> np.ndarray:
        """Sums of the words' values (one or more columns) over each block."""
        out = np.zeros((self.n_blocks, *values.shape[1:]), dtype=values.dtype)
        if len(values):
            edges = np.flatnonzero(np.diff(self.block, prepend=-1))
            out[self.block[edges]] = np.add.reduceat(values, edges, axis=0)
        return out

    def starts(self, blocks: int, step: int) -> np.ndarray:
        """First blocks of the passages: every ``step`` blocks of a text."""
        within = np.arange(self.n_blocks) - self.first_block[self.row_of_block]
        size = np.diff(self.first_block)[self.row_of_block]
        # a passage that only repeats the end of the one before it is left out
        return np.flatnonzero((within % step == 0) & ((within == 0) | (within + blocks - step < size)))

    def sums(self, starts: np.ndarray, blocks: int, of_block: np.ndarray) -> np.ndarray:
        """Sums over the blocks of each passage, cut at the end of its text."""
        ends = self.first_block[self.row_of_block[starts] + 1]
        total = of_block[starts].copy()
        for i in range(1, blocks):
            inside = np.flatnonzero(starts + i < ends)
            total[inside] += of_block[starts[inside] + i]
        return total

    def within(self, starts: np.ndarray, blocks: int) -> np.ndarray:
        """Which of the words lie in a block of these passages."""
        wanted = np.zeros(self.n_blocks + blocks, dtype=bool)
        for i in range(blocks):
            wanted[starts + i] = True
        return np.flatnonzero(wanted[self.block])

    def by_block_of(self, values: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Sums over blocks of the vectors (rows of ``values``) of some of the words."""
        out = np.zeros((self.n_blocks, values.shape[1]), dtype=np.float32)
        block, word = self.block[some], self.words[some]
        place = np.arange(len(some)) - np.maximum.accumulate(np.where(np.diff(block, prepend=-1) != 0, np.arange(len(some)), 0))
        for k in range(int(place.max(initial=-1)) + 1):  # the k-th words of all blocks, BLOCK at most
            own = np.flatnonzero(place == k)
            out[block[own]] += values[word[own]]
        return out


def _frequencies(encoded: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Passages (of two blocks, side by side) that have each word, and passages in all."""

    def counted(batches):
        found, passages = np.zeros(size, dtype=np.int64), 0
        every = np.ones(size, dtype=bool)
        for _, _, words, counts in _word_batches(batches):
            own = Passages(words, counts, every)
            passages += own.n_blocks // 2 + 1
            pair = np.unique((own.block // 2) * size + own.words)
            found += np.bincount(pair % size, minlength=size)
        number = np.append(np.flatnonzero(found), -1)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.append(found[number[:-1]], passages))], names=["word", "n"])

    out, total = np.zeros(size, dtype=np.int64), 0
    for row in encoded.select("words").mapInArrow(released(counted), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        if row["word"] < 0:
            total = row["n"]
        else:
            out[row["word"]] = row["n"]
    return out, total


def _weights(frequency: np.ndarray, passages: int, items: Items) -> np.ndarray:
    """Inverse passage frequency, 0 for words that are too common unless an item would keep too few words."""
    limit = max(COMMON_LEAST, COMMON_SHARE * passages)
    common = frequency > limit
    kept = ~common
    for words in items.words:
        if np.count_nonzero(~common[words]) < min(len(words), max(KEPT_LEAST, KEPT_SHARE * len(words))) and len(words) >= LEAST_WORDS:
            half = max(-(-len(words) // 2), min(KEPT_LEAST, len(words)))
            kept[words[frequency[words] <= np.sort(frequency[words])[half - 1]]] = True
    return np.where(kept, np.log1p(passages / np.maximum(frequency, 1)), 0.0)


def _summed(parts: DataFrame, n_rows: int, width: int, scratch: Scratch, name: str) -> np.ndarray:
    """The sum of partial matrices given as rows (row, values), added up by row on the executors."""

    def added(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(raw, dtype="<f8")
                held[row] = held[row] + values if row in held else values
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["row", "raw"])

    few = min(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, n_rows // 256))
    out = np.zeros((n_rows, width))
    for row in scratch.keep(parts.repartition(few, "row").mapInArrow(released(added), "row long, raw binary"), name).collect():
        out[row["row"]] += np.frombuffer(row["raw"], dtype="<f8")
    return out


def space(n_items: int, passages: int) -> tuple[int, float]:
    """Rank of the latent space, and the passages that each item counts as."""
    return max(RANK, math.ceil(ITEM_RANK * n_items)), max(ITEM_ROWS, ITEM_SHARE * passages)


def latent_words(encoded: DataFrame, items: Items, weight: np.ndarray, passages: int, scratch: Scratch) -> np.ndarray:
    """Weighted words in the latent space: a randomised SVD of the passages' TF-IDF matrix, by two passes over it.

    The items are passages too, as often as ``space`` says.
    """
    rank, item_rows = space(len(items.words), passages)
    size, wide = len(weight), min(rank + OVERSAMPLING, len(weight))
    weighted = weight > 0

    def passages_of(batches, basis):
        for _, _, words, counts in _word_batches(batches):
            own = Passages(words, counts, weighted)
            starts = own.starts(2, 2)
            starts = starts[own.sums(starts, 2, own.by_block(np.ones(len(own.words)))) >= LEAST_WORDS]
            rows = own.sums(starts, 2, own.by_block_of(basis, own.within(starts, 2)))
            yield own, starts, rows

    def rows_of(matrix):
        kept = np.flatnonzero(matrix.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(kept), pa.array([matrix[i].tobytes() for i in kept], pa.binary())], names=["row", "raw"])

    plain = np.random.default_rng(SEED).standard_normal((size, wide))
    omega = plain * weight[:, None]

    def ranged(batches):
        total = np.zeros((size, wide))
        basis = omega.astype(np.float32)
        for own, starts, rows in passages_of(batches, basis):
            # A' times the rows: each word takes up the row of its passage
            row_of_block = np.full(own.n_blocks + 1, -1)
            row_of_block[starts + 1] = np.arange(len(starts))
            row_of_block[starts] = np.arange(len(starts))
            second = starts + 1
            crosses = (second < own.n_blocks) & (own.row_of_block[np.minimum(second, own.n_blocks - 1)] != own.row_of_block[starts])
            taken = np.zeros(own.n_blocks + 1, dtype=bool)
            taken[starts] = True
            row_of_block[second[crosses & ~taken[second]]] = -1
            at = row_of_block[own.block]
            some = np.flatnonzero(at >= 0)
            order = some[np.argsort(own.words[some], kind="stable")]
            word = own.words[order]
            if len(word):
                edges = np.flatnonzero(np.diff(word, prepend=-1))
                total[word[edges]] += np.add.reduceat(rows[at[order]], edges, axis=0)
        yield rows_of(total * weight[:, None])

    spread_rows = encoded.select("words")
    found = _summed(spread_rows.mapInArrow(released(ranged), "row long, raw binary"), size, wide, scratch, "range")
    for words in items.words:
        np.add.at(found, words, item_rows * weight[words, None] * omega[words].sum(axis=0))
    basis = np.linalg.qr(found)[0]
    weighted_basis = (basis * weight[:, None]).astype(np.float32)

    def turned(batches):
        total = np.zeros((basis.shape[1],) * 2)
        for _, _, rows in passages_of(batches, weighted_basis):
            total += rows.T @ rows
        yield rows_of(total)

    inner = _summed(spread_rows.mapInArrow(released(turned), "row long, raw binary"), basis.shape[1], basis.shape[1], scratch, "inner")
    for words in items.words:
        row = (basis[words] * weight[words, None]).sum(axis=0)
        inner += item_rows * np.outer(row, row)
    values, vectors = np.linalg.eigh(inner)
    directions = basis @ vectors[:, np.argsort(-values, kind="stable")[:rank]]
    return (directions * weight[:, None]).astype(np.float32)


# -------------------------------------------------------------------- search


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.where(size > 1e-6, x / np.maximum(size, 1e-6), 0.0).astype(np.float32)


def _matches(encoded: DataFrame, items: Items, vectors: np.ndarray, weighted: np.ndarray) -> DataFrame:
    """Confirmed matches: one row for each text and item, with the best passage."""
    by_blocks: dict[int, list[int]] = {}
    for i, words in enumerate(items.words):
        if len(words) >= LEAST_WORDS:
            by_blocks.setdefault(items.passage_blocks(i), []).append(i)
    # passages with too few weighted words for any of the items are passed over
    least = {n: max(LEAST_WORDS, math.ceil(WEIGHTED_SHARE * min(int(weighted[items.words[i]].sum()) for i in own))) for n, own in by_blocks.items()}
    queries = {n: _unit(np.array([vectors[items.words[i]].sum(axis=0) for i in own])) for n, own in by_blocks.items()}

    lengths = np.array([len(words) for words in items.words])
    needed = np.maximum(LCS_SHARE * lengths, np.minimum(LCS_LEAST, lengths))

    def confirmed(item: int, region: np.ndarray, verbatim: bool = False):
        words, region = items.words[item].tolist(), region.tolist()
        shared = lcs(words, region)
        if shared < needed[item] and not verbatim:
            return None
        answer = words[-max(1, -(-len(words) // 3)) :]
        held = lcs(answer, region)
        return (shared, held / len(answer)) if verbatim or held >= ANSWER_SHARE * len(answer) else None

    def searched(batches):
        times = items.times()
        for batch, base, words, counts in _word_batches(batches):
            own = Passages(words, counts, weighted)
            n_weighted = own.by_block(np.ones(len(own.words)))
            first_word = np.cumsum(counts) - counts
            best: dict[tuple[int, int], tuple] = {}
            for blocks, query in queries.items():
                starts = own.starts(blocks, blocks // 2)
                starts = starts[own.sums(starts, blocks, n_weighted) >= least[blocks]]
                projected = own.by_block_of(vectors, own.within(starts, blocks))
                for at in range(0, len(starts), 8192):
                    some = starts[at : at + 8192]
                    cosine = _unit(own.sums(some, blocks, projected)) @ query.T
                    p, q = np.nonzero(cosine >= COSINE)
                    item, row = np.array(by_blocks[blocks])[q], own.row_of_block[some[p]]
                    begin = (some[p] - own.first_block[row]) * BLOCK
                    low = first_word[row] + np.maximum(begin - lengths[item], 0)
                    high = first_word[row] + np.minimum(begin + blocks * BLOCK + lengths[item], counts[row])
                    kept = enough(words, low, high, item, times, needed)
                    for i, r, x, y, at_word, c in zip(*(v[kept].tolist() for v in (item, row, low, high, begin, cosine[p, q]))):
                        old = best.get((r, i))
                        if old is not None and old[0] == lengths[i]:
                            continue
                        found = confirmed(i, words[x:y])
                        if found and (old is None or found[0] > old[0]):
                            best[r, i] = (found[0], found[1], c, at_word)
            for row, item, at in items.verbatim(words, counts):
                length = len(items.words[item])
                old = best.get((row, item))
                if old is not None and old[0] == length:
                    continue
                first, last = int(first_word[row]), int(first_word[row] + counts[row])
                found = confirmed(item, words[max(first, at - length) : min(last, at + 2 * length)], length >= RUN)
                if found and (old is None or found[0] > old[0]):
                    passage = words[at : min(last, at + length)]
                    sums = _unit(np.array([vectors[passage[passage >= 0]].sum(axis=0), vectors[items.words[item]].sum(axis=0)]))
                    best[row, item] = (found[0], found[1], float(sums[0] @ sums[1]), at - first)
            if best:
                take = pa.array([base + row for row, _ in best])
                rest = list(zip(*best.values()))
                columns = [
                    batch.column(0).take(take), batch.column(1).take(take), pa.array([items.ids[i] for _, i in best], pa.int64()),
                    pa.array(rest[3], pa.int64()), pa.array(rest[0], pa.int64()),
                    pa.array([c / len(items.words[i]) for c, (_, i) in zip(rest[0], best)]), pa.array(rest[1]), pa.array(rest[2]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "item_id", "passage_word", "lcs", "lcs_share", "answer_share", "cosine"])

    schema = "uid long, doc_id long, item_id long, passage_word long, lcs long, lcs_share double, answer_share double, cosine double"
    return encoded.select("uid", "doc_id", "words").mapInArrow(released(searched), schema)


def contaminated(df: DataFrame, benchmark: DataFrame, key: str | None = None) -> DataFrame:
    """A row for each text that holds a benchmark item, exactly or paraphrased, and the item.

    ``key`` names a column of numbers that tell rows apart.
    """
    scratch = Scratch(df.sparkSession, "latent")
    if key is None:
        df, key, _ = with_row_ids(df, scratch)
    rows = df.select(F.col(key).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = spread(rows)
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = -(-asked.count() // ITEMS_PER_BLOCK) or 1
    asked = asked.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found: DataFrame | None = None
    for part in range(blocks):
        held = asked.filter(F.col("part") == part).orderBy("item_id", "text").collect()  # about ITEMS_PER_BLOCK items
        if not any((r["text"] or "").strip() for r in held):
            continue
        items = Items([r["item_id"] for r in held], [r["text"] for r in held])
        if not len(items.vocabulary):
            continue
        own = Scratch(df.sparkSession, f"latent{part}")
        encoded = own.keep(_encoded(rows, items), "encoded")
        frequency, passages = _frequencies(encoded, len(items.vocabulary))
        weight = _weights(frequency, passages, items)
        vectors = latent_words(encoded, items, weight, passages, own)
        matched = scratch.keep(_matches(encoded, items, vectors, weight > 0), f"matches{part}")
        own.drop("encoded", "range", "inner")
        found = matched if found is None else found.unionByName(matched)
    if found is None:
        schema = "uid long, doc_id long, item_id long, passage_word long, lcs long, lcs_share double, answer_share double, cosine double"
        return df.sparkSession.createDataFrame([], schema)
    return found


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("uid")
