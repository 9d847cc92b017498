"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

Symbols are bytes; a run of white space is one symbol, digits are one symbol,
and a word that repeats the one before it is a reserved symbol, which trusted
text hardly has. Each symbol is predicted from the ORDER - 1 symbols before
it, over the ends of words, so that the order of words counts. A byte n-gram
fits a long, so counts, contexts and suffixes are integer expressions.

Two models are made from the same counts: one of the trusted rows (quality 1
and not toxic) and one of all rows of quality 1, toxic ones included. A text
is rejected if

* its perplexity under the trusted model is out of the ordinary for its
  language: prose of another make, such as shouting, symbol noise, tables and
  repeated words; or
* one of its words is explained far better by the model that has also seen
  toxic text, which says the same of words with the stems of such words.

Both limits are quantiles of trusted rows of the language. They are taken over
a quarter of the trusted rows that the models haven't seen.

Counting: each split of the input is a shard, which gives the distinct
n-grams of its texts with their counts by label, so what is gathered grows
with the input. The model's probabilities are joined to the distinct n-grams
order by order, and go back to the shards that need them by a join on the
n-gram; a shard's n-grams, then its texts in compressed blocks, arrive sorted
in one stream. No part of the model is collected or broadcast.

Defined cases: a null or empty text, or one of white space only, has no
symbols, the perplexity and peak of its language's ordinary text, and is
kept; a null or unlabelled language is a language of its own, and one with
few trusted rows takes the limits of all; without any trusted row held out
every text is kept; repeated rows are judged alike; a null id has no label;
an id that is labelled twice counts as trusted only if all its labels do;
labels of unknown ids are ignored; an empty table gives an empty result;
very long texts and words are scored whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake.llm.common import BROADCAST_IDS, IS_SPACE, Rolling, Scratch, documents, mix, released, runs_by_bytes, spread, text_bytes, with_row_ids

ORDER = 5
START, END, AGAIN = 2, 3, 4
#: Bytes of text worked on at a time, and to a compressed block.
BATCH_BYTES, BLOCK_BYTES = 2 << 20, 1 << 18
#: Probability of a symbol that was never seen.
FLOOR = 1.0 / 256
#: Symbols of ordinary text that each document's mean is shrunk with.
PRIOR_SYMBOLS = 120
#: One in so many trusted rows is held out for the limits; a language with fewer such
#: rows takes the limits of all languages.
HELD_OUT, LEAST_HELD_OUT = 4, 20
#: The limits: quantiles of those rows' mean negative log probability a symbol, and of their peak a word.
MEAN_QUANTILE, PEAK_QUANTILE = 0.999, 0.999
#: Shards for each shuffle partition, where the input has no files to take them from.
SHARDS_PER_PARTITION = 4
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[48:58] = 48
_PLAIN[IS_SPACE] = END


# ------------------------------------------------------------------ n-grams


def symbol_grams(data: np.ndarray, offsets: np.ndarray):
    """The n-gram that ends at each symbol of the texts, where their words begin, and the row of each word.

    A word's symbols are its bytes and its end. Rows are preceded by ORDER - 1
    start symbols, which aren't predicted themselves.
    """
    n_rows, sizes = len(offsets) - 1, np.diff(offsets)
    flat = np.full(len(data) + ORDER * n_rows, START, dtype=np.uint8)
    flat[np.arange(len(data)) + np.repeat(ORDER * np.arange(n_rows) + ORDER - 1, sizes)] = _PLAIN[data]
    flat[offsets[1:] + ORDER * np.arange(1, n_rows + 1) - 1] = END  # each row ends with a separator
    first = offsets[:-1] + ORDER * np.arange(n_rows)  # of the rows, start symbols included
    is_end = flat == END
    keep = np.ones(len(flat), dtype=bool)
    keep[1:] = ~(is_end[1:] & (is_end[:-1] | (flat[:-1] == START)))  # one end for each word
    begins = np.cumsum(keep) - keep
    flat, first = flat[keep], begins[first]
    ends = np.flatnonzero(flat == END)
    row = np.searchsorted(first, ends, side="right") - 1
    starts = np.zeros(len(ends), dtype=np.int64)
    starts[1:] = ends[:-1] + 1
    opening = np.ones(len(ends), dtype=bool)
    opening[1:] = row[1:] != row[:-1]
    starts[opening] = first[row[opening]] + ORDER - 1
    hashes = mix(Rolling(flat).slices(starts, ends) ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))
    again = np.zeros(len(ends), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & ~opening[1:]
    if again.any():
        flat[starts[again]] = AGAIN
        change = np.zeros(len(flat) + 1, dtype=np.int32)
        np.add.at(change, starts[again] + 1, 1)
        np.add.at(change, ends[again], -1)
        keep = np.cumsum(change[:-1]) == 0
        begins = np.cumsum(keep) - keep
        flat, starts = flat[keep], begins[starts]
    gram = np.zeros(len(flat), dtype=np.uint64)
    for i in range(ORDER):
        gram[i:] |= flat[: len(flat) - i].astype(np.uint64) << np.uint64(8 * i)
    real = np.zeros(len(flat), dtype=bool)  # symbols of words
    if len(starts):
        real = flat != START
        real[: ORDER - 1] = False
    place = np.cumsum(real) - real
    return gram[real].view(np.int64), place[starts], row


def _summed(grams: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct n-grams and the sums of their counts."""
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    edges = np.flatnonzero(np.diff(grams, prepend=grams[:1] - 1)) if len(grams) else np.zeros(0, np.int64)
    return grams[edges], *(np.add.reduceat(c[order], edges) if len(edges) else c[:0] for c in counts)


def _gathered(rows: DataFrame) -> DataFrame:
    """(shard, gram, trusted, decent): the distinct n-grams of each shard, counted by label."""
    names = ["shard", "gram", "trusted", "decent"]

    def made(batches):
        held: dict[int, list] = {}

        def fold(shard):
            parts = held.pop(shard)
            return _summed(*(np.concatenate([p[i] for p in parts]) for i in range(3)))

        def given(shard):
            found = fold(shard)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), shard)), *map(pa.array, found)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            shards, labels = batch.column(0).to_numpy(), batch.column(2).fill_null(0).to_numpy()
            _, offsets = text_bytes(batch.column(1))
            cuts = np.concatenate([[0], np.flatnonzero(shards[1:] != shards[:-1]) + 1, [len(shards)]])
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                shard = int(shards[low])
                for a, b in runs_by_bytes(offsets[low : high + 1], BATCH_BYTES):
                    a, b = a + low, b + low
                    grams, words, row = symbol_grams(*text_bytes(batch.column(1).slice(a, b - a)))
                    if not len(grams):
                        continue
                    label = np.repeat(labels[a:b][row], np.diff(np.append(words, len(grams))))
                    parts = [(np.unique(grams), None, None)]
                    for value in (2, 1):
                        own, count = np.unique(grams[label == value], return_counts=True)
                        parts.append((own, count if value == 2 else np.zeros(len(own), np.int64), count))
                    zeros = np.zeros(len(parts[0][0]), dtype=np.int64)
                    parts[0] = (parts[0][0], zeros, zeros)
                    held.setdefault(shard, []).append(tuple(np.concatenate([p[i] for p in parts]) for i in range(3)))
                    if sum(len(p[0]) for p in held[shard]) > 2_000_000 or len(held[shard]) % 6 == 0:
                        held[shard] = [fold(shard)]
            while len(held) > 16:  # shards come in runs where the input has files
                yield given(next(iter(held)))
        for shard in list(held):
            yield given(shard)

    return rows.select("shard", "text", "label").mapInArrow(released(made), "shard long, gram long, trusted long, decent long")


# -------------------------------------------------------------- Kneser-Ney


def _low(gram: Column, n: int) -> Column:
    """The last n bytes of a gram."""
    return gram.bitwiseAND(F.lit((1 << 8 * n) - 1))


def _discounts(counted: DataFrame, names: tuple[str, ...]) -> dict:
    """Modified Kneser-Ney discounts (D1, D2, D3+) by order and model, from counts of counts."""
    asked = [F.count(F.when(F.col(c) == i, 1)).alias(f"{c}{i}") for c in names for i in (1, 2, 3, 4)]
    out = {}
    for row in counted.groupBy("n").agg(*asked).collect():  # one row an order
        for c in names:
            n1, n2, n3, n4 = (max(1, row[f"{c}{i}"]) for i in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2)
            raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
            out[row["n"], c] = [min(max(d, 0.1), i - 0.05) for i, d in enumerate(raw, 1)]
    return out


def kneser_ney(grams: DataFrame, scratch: Scratch, names: tuple[str, ...] = ("trusted", "decent")) -> tuple[DataFrame, DataFrame]:
    """(alpha, gamma) of every order: discounted probabilities of n-grams and back-off weights of contexts.

    ``grams`` has a row for each n-gram and a count for each model. Lower
    orders count the distinct symbols before an n-gram.
    """
    full = grams.select(F.lit(ORDER).alias("n"), "gram", *names)
    wide = grams.select("gram", *(F.col(c) > 0 for c in names)).toDF("gram", *names)
    lower = wide.select(
        F.explode(F.array(*(F.struct(F.lit(n).alias("n"), _low(F.col("gram"), n + 1).alias("gram")) for n in range(1, ORDER)))).alias("g"), *names
    ).select("g.*", *names)
    lower = lower.groupBy("n", "gram").agg(*(F.max(c).alias(c) for c in names))
    suffix = F.coalesce(*(F.when(F.col("n") == n, _low(F.col("gram"), n)) for n in range(1, ORDER)))
    lower = lower.groupBy("n", suffix.alias("gram")).agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in names))
    counted = scratch.keep(full.unionByName(lower).filter(" OR ".join(f"{c} > 0" for c in names)), "counted")
    found = _discounts(counted, names)

    def discount(c: str) -> Column:
        count = F.col(c)
        out = F.lit(0.0)
        for n in range(1, ORDER + 1):
            d1, d2, d3 = found.get((n, c), (0.5, 1.0, 1.5))
            own = F.when(count == 1, d1).when(count == 2, d2).when(count > 2, d3).otherwise(0.0)
            out = F.when(F.col("n") == n, own).otherwise(out)
        return out

    context = F.shiftrightunsigned(F.col("gram"), 8)
    taken = counted.select("n", "gram", context.alias("context"), *names, *(discount(c).alias(f"{c}_d") for c in names))
    sums = taken.groupBy("n", "context").agg(
        *(F.sum(c).alias(f"{c}_sum") for c in names), *(F.sum(f"{c}_d").alias(f"{c}_taken") for c in names)
    )
    sums = scratch.keep(sums, "sums")
    alpha = taken.join(sums, ["n", "context"]).select(
        "n", "gram", *(F.when(F.col(c) > 0, (F.col(c) - F.col(f"{c}_d")) / F.col(f"{c}_sum")).otherwise(0.0).alias(c) for c in names)
    )
    gamma = sums.select("n", "context", *(F.when(F.col(f"{c}_sum") > 0, F.col(f"{c}_taken") / F.col(f"{c}_sum")).otherwise(1.0).alias(c) for c in names))
    return scratch.keep(alpha, "alpha"), scratch.keep(gamma, "gamma")


def probabilities(asked: DataFrame, alpha: DataFrame, gamma: DataFrame, scratch: Scratch, names: tuple[str, ...] = ("trusted", "decent")) -> DataFrame:
    """(gram, a probability for each model) of the n-grams asked for, interpolated order by order, a written table for each."""
    before: DataFrame | None = None
    for n in range(1, ORDER + 1):
        own = asked.select(_low(F.col("gram"), n).alias("gram")).distinct()
        own = own.withColumn("context", F.shiftrightunsigned(F.col("gram"), 8)).withColumn("suffix", _low(F.col("gram"), n - 1))
        a = alpha.filter(F.col("n") == n).select("gram", *(F.col(c).alias(f"{c}_a") for c in names))
        g = gamma.filter(F.col("n") == n).select("context", *(F.col(c).alias(f"{c}_g") for c in names))
        own = own.join(a, "gram", "left").join(g, "context", "left")
        if before is None:
            own = own.select("*", *(F.lit(FLOOR).alias(c) for c in names))
        else:
            own = own.join(before.withColumnRenamed("gram", "suffix"), "suffix")
        mixed = [(F.coalesce(f"{c}_a", F.lit(0.0)) + F.coalesce(f"{c}_g", F.lit(1.0)) * F.col(c)).alias(c) for c in names]
        before = scratch.keep(own.select("gram", *mixed), f"probabilities{n}")
    return before


# ------------------------------------------------------------------ scoring


_ROW = "struct<uid:long,doc_id:long,lang:string,label:int>"


class _Model:
    """Log probabilities, and their log ratio to the other model's, looked up by n-gram through a hash table."""

    def __init__(self, grams: np.ndarray, trusted: np.ndarray, decent: np.ndarray):
        self.grams, logs = grams, np.log(trusted)
        self.values = np.stack([logs, np.log(decent) - logs], axis=1)
        self.bits = max(4, int(4 * len(grams)).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        left = np.arange(len(grams), dtype=np.int32)
        at = self._at(grams)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            placed = self.slots[at] == left
            left, at = left[~placed], (at[~placed] + 1) & (len(self.slots) - 1)

    def _at(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        """A row (log probability, log ratio) for each n-gram, all of which the model has."""
        at = self._at(asked)
        found = self.slots[at]
        other = np.flatnonzero(self.grams[found] != asked)
        while len(other):
            at[other] = (at[other] + 1) & (len(self.slots) - 1)
            found[other] = self.slots[at[other]]
            other = other[self.grams[found[other]] != asked[other]]
        return self.values[found]


def _scored(block: pa.RecordBatch, model: _Model) -> pa.RecordBatch:
    """Symbols, negative log probability and peak of every text of a block (row, text)."""
    n = block.num_rows
    grams, words, row = symbol_grams(*text_bytes(block.column(1)))
    symbols, total, top = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n)
    if len(grams):
        by_word = np.add.reduceat(model(grams), words, axis=0)
        symbols = np.bincount(row, np.diff(np.append(words, len(grams))), n).astype(np.int64)
        total = -np.bincount(row, by_word[:, 0], n)
        top = np.full(n, -np.inf)
        np.maximum.at(top, row, by_word[:, 1])
        top[symbols == 0] = 0.0
    return pa.RecordBatch.from_arrays([block.column(0), pa.array(symbols), pa.array(total), pa.array(top)], names=["row", "symbols", "nll", "peak"])


def _blocks(rows: DataFrame) -> DataFrame:
    """(shard, block): the rows of each shard as compressed blocks of about BLOCK_BYTES; a longer text is one of its own."""

    def made(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            shards = batch.column(0).to_numpy()
            _, offsets = text_bytes(batch.column(2))
            cuts = np.concatenate([[0], np.flatnonzero(shards[1:] != shards[:-1]) + 1, [len(shards)]])
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                for a, b in runs_by_bytes(offsets[low : high + 1], BLOCK_BYTES):
                    part = pa.RecordBatch.from_arrays([batch.column(i).slice(low + a, b - a) for i in (1, 2)], names=["row", "text"])
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                        writer.write_batch(part)
                    yield pa.RecordBatch.from_arrays([pa.array([int(shards[low])]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["shard", "block"])

    return rows.select("shard", F.struct("uid", "doc_id", "lang", "label").alias("row"), "text").mapInArrow(released(made), "shard long, block binary")


def _scored_by_shard(rows: DataFrame, needed: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """Scores with a model of any size: each shard gets the n-grams of its texts, then its texts."""
    model = needed.select("shard", "gram").join(known, "gram")
    model = model.select("shard", F.lit(None).cast("binary").alias("block"), "gram", F.col("trusted").cast("float"), F.col("decent").cast("float"))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("gram", "long"), ("trusted", "float"), ("decent", "float"))]
    texts = _blocks(rows).select("shard", "block", *none)

    def scored(batches):
        shard, parts, held = None, [], None
        for batch in batches:
            shards, is_text = batch.column(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero((shards[1:] != shards[:-1]) | (is_text[1:] != is_text[:-1])) + 1, [len(shards)]])
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if low == high:
                    continue
                part = batch.slice(low, high - low)
                if shards[low] != shard:
                    shard, parts, held = shards[low], [], None
                if not is_text[low]:
                    parts.append([part.column(i).to_numpy() for i in (2, 3, 4)])
                    continue
                if held is None:
                    held = _Model(*(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.int64, np.float32, np.float32))))
                    parts = []
                for block in part.column(1):
                    for texts in pa.ipc.open_stream(block.as_buffer()):
                        yield _scored(texts, held)

    # shards are numbered and dealt out in turn, so that none has several while others have none
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = scratch.keep(needed.select("shard").distinct(), "shards")
    numbers = numbers.select("shard", F.row_number().over(Window.orderBy("shard")).alias("number"))  # a row for each split of the input
    numbers = scratch.keep(numbers, "numbers")
    numbers = F.broadcast(numbers) if numbers.count() <= BROADCAST_IDS else numbers
    stream = model.unionByName(texts).join(numbers, "shard", "left").withColumn("number", F.coalesce("number", F.lit(0)))  # texts without symbols
    stream = stream.repartitionById(n, F.col("number")).select("shard", "block", "gram", "trusted", "decent")
    return stream.sortWithinPartitions("shard", F.col("block").isNotNull()).mapInArrow(released(scored), f"row {_ROW}, symbols long, nll double, peak double")


def scores(df: DataFrame, labels: DataFrame, scratch: Scratch, key: str | None = None) -> DataFrame:
    """(uid, doc_id, lang, label, symbols, nll, peak) of every row.

    Label 3 is trusted but held out, 2 trusted, 1 of quality, 0 anything else.
    ``key`` names a column of numbers that tell rows apart.
    """
    if key is None:
        df, key, _ = with_row_ids(df, scratch)
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).when(F.col("quality") == 1, 1).otherwise(0)).alias("label")
    )
    known = scratch.keep(known.filter("label > 0"), "labels")
    known = F.broadcast(known) if known.count() <= BROADCAST_IDS else known
    lang = F.col("lang").cast("string") if "lang" in df.columns else F.lit(None).cast("string")
    rows = df.select(F.col(key).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    split = F.xxhash64(F.input_file_name(), F.input_file_block_start())
    others = SHARDS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("shard", F.when(F.input_file_name() == "", F.pmod(F.xxhash64("uid"), F.lit(others))).otherwise(split))
    rows = rows.join(known, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    unseen = F.pmod(F.xxhash64("uid"), F.lit(HELD_OUT)) == 0
    rows = rows.withColumn("label", F.when((F.col("label") == 2) & unseen, F.lit(3)).otherwise(F.col("label")))
    rows = spread(rows)  # after the shards are named, which takes the splits of the files
    needed = scratch.keep(_gathered(rows), "needed")
    counts = needed.groupBy("gram").agg(F.sum("trusted").alias("trusted"), F.sum("decent").alias("decent"))
    counts = scratch.keep(counts, "counts")
    alpha, gamma = kneser_ney(counts, scratch)
    known_p = probabilities(counts.select("gram"), alpha, gamma, scratch)
    found = scratch.keep(_scored_by_shard(rows, needed, known_p, scratch).select("row.*", "symbols", "nll", "peak"), "scores")
    scratch.drop("needed", "counts", "alpha", "gamma", "counted", "sums", *(f"probabilities{n}" for n in range(1, ORDER + 1)))
    return found


def judged(df: DataFrame, labels: DataFrame, key: str | None = None) -> DataFrame:
    """Perplexity, peak and verdict of every row."""
    scratch = Scratch(df.sparkSession, "quality")
    found = scores(df, labels, scratch, key)
    trusted = found.filter("label >= 2 AND symbols > 0")
    ordinary = trusted.groupBy("lang").agg((F.sum("nll") / F.sum("symbols")).alias("usual"))
    overall = trusted.agg((F.sum("nll") / F.sum("symbols")).alias("usual_all"))
    usual = F.coalesce("usual", "usual_all", F.lit(0.0))
    found = found.join(ordinary.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(overall))
    found = found.withColumn("mean", (F.col("nll") + PRIOR_SYMBOLS * usual) / (F.col("symbols") + PRIOR_SYMBOLS)).drop("l", "usual", "usual_all")
    found = scratch.keep(found, "means")
    limits = [
        F.percentile_approx("mean", MEAN_QUANTILE, 100_000).alias("mean_limit"),
        F.percentile_approx("peak", PEAK_QUANTILE, 100_000).alias("peak_limit"),
    ]
    trusted = found.filter("label = 3 AND symbols > 0")
    by_lang = trusted.groupBy(F.col("lang").alias("l")).agg(*limits, F.count("*").alias("n")).filter(F.col("n") >= LEAST_HELD_OUT).drop("n")
    overall = trusted.agg(*(x.alias(n) for x, n in zip(limits, ("mean_all", "peak_all"))))
    found = found.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(overall))
    none = F.lit(float("inf"))
    mean_limit, peak_limit = F.coalesce("mean_limit", "mean_all", none), F.coalesce("peak_limit", "peak_all", none)
    return found.select(
        "uid", "doc_id", "lang", "symbols", F.exp("mean").alias("perplexity"), F.exp(mean_limit).alias("perplexity_limit"), "peak", peak_limit.alias("peak_limit"),
        ((F.col("mean") <= mean_limit) & (F.col("peak") <= peak_limit) | (F.col("symbols") == 0)).alias("kept"),
    )


def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("uid")
