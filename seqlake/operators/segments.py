"""Low- and high-complexity segments (SEG, Wootton & Federhen 1993).

Window entropies, trigger and extension, and interval unions are relational;
the recursive choice of the least probable sub-window runs per sequence.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_entropy(symbols: DataFrame, key: str, order: list[str], symbol: str, width: int = 12) -> DataFrame:
    """Composition entropy, in bits, of the window of ``width`` symbols that starts ``width // 2`` rows before each row.

    Rows near an end, without a full window, have none.
    """
    own = Window.partitionBy(key).orderBy(*order)
    numbered = symbols.select(key, *order, F.col(symbol).alias("symbol")).withColumn("at", F.row_number().over(own))
    numbered = numbered.withColumn("n", F.count("*").over(Window.partitionBy(key)))
    first = F.col("at") - width // 2
    frame = own.rowsBetween(-(width // 2), width - 1 - width // 2)
    windows = numbered.withColumn("window", F.collect_list("symbol").over(frame)).filter((first >= 1) & (first + width - 1 <= F.col("n")))
    distinct = F.array_distinct("window")
    count = lambda s: F.size(F.filter("window", lambda x: x == s)).cast("double")
    entropy = F.aggregate(distinct, F.lit(0.0), lambda a, s: a - count(s) / width * F.log2(count(s) / width))
    return windows.select(key, *order, "at", entropy.alias("entropy"))


def islands(rows: DataFrame, key: str, at: str, value: str, low: float, high: float) -> DataFrame:
    """Maximal runs of adjacent rows with value <= high that hold one with value <= low."""
    inside = rows.filter(F.col(value) <= high)
    group = F.col(at) - F.row_number().over(Window.partitionBy(key).orderBy(at))
    runs = inside.withColumn("run", group).groupBy(key, "run").agg(F.min(at).alias("left"), F.max(at).alias("right"), F.min(value).alias("least"), F.count("*").alias("n"))
    return runs.filter(F.col("least") <= low).select(key, "left", "right", "n", "least")


def merged(intervals: DataFrame, key: str) -> DataFrame:
    """Union of the intervals [left, right] of each key; touching ones are one.

    Null intervals come last, as in the SQL: they belong to the run before
    them, and without one each stays a row of nulls.
    """
    own = Window.partitionBy(key).orderBy(F.col("left").asc_nulls_last(), F.col("right").asc_nulls_last())
    reach = F.max("right").over(own.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("left") > reach + 1), 1).otherwise(0)
    numbered = intervals.withColumn("opens", opens).withColumn("run", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run").agg(F.min("left").alias("left"), F.max("right").alias("right")).select(key, "left", "right")


def entropy_of(counts: np.ndarray, width: int) -> float:
    """Bits of a composition."""
    p = counts[counts > 0] / width
    return float(-(p * np.log2(p)).sum())


def log_probabilities(counts: np.ndarray, width: int, alphabet: int) -> np.ndarray:
    """Log probability of each window's complexity state (a row of symbol counts): orderings, and assignments of its counts to symbols."""
    facts = log_factorials(max(width, alphabet))
    orderings = facts[width] - facts[counts].sum(axis=1)
    # the factorials of how many symbols share a count: a product of places within runs of the sorted counts
    ordered = np.sort(counts, axis=1)
    shared, place = np.zeros(len(counts)), np.ones(len(counts))
    logs = np.log(np.arange(1, alphabet + 1))
    for j in range(counts.shape[1]):
        place = np.where(ordered[:, j] == ordered[:, j - 1], place + 1, 1) if j else place
        shared += np.where(ordered[:, j] > 0, logs[place.astype(int) - 1], 0.0)
    unused = alphabet - np.count_nonzero(counts, axis=1)
    return orderings + facts[alphabet] - facts[unused] - shared - width * math.log(alphabet)


def log_factorials(n: int) -> np.ndarray:
    """ln 0! to ln n!."""
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def seg(codes: np.ndarray, alphabet: int = 20, width: int = 12, low: float = 2.2, high: float = 2.5, most: int = 100, inverted: bool = False) -> list[tuple[int, int]]:
    """Segments (first, last), from 0, of one sequence of codes; codes outside the alphabet spoil their windows.

    A window at or below ``low`` triggers, its neighbours at or below ``high``
    extend it; the least probable sub-window is the segment, and the part to
    its left is searched again. ``inverted`` looks for high complexity. Counts
    of any window are differences of running counts.
    """
    n = len(codes)
    if n < width:
        return []
    down = width // 2
    known = (codes >= 0) & (codes < alphabet)
    upto = np.zeros((n + 1, alphabet), dtype=np.int64)
    upto[np.flatnonzero(known) + 1, codes[known]] = 1
    upto = upto.cumsum(axis=0)
    counts = upto[width:] - upto[:-width]
    share = counts / width
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(counts > 0, share * np.log2(share), 0.0).sum(axis=1)
    value = np.full(n, np.nan)
    value[down : down + len(counts)] = np.where(counts.sum(axis=1) == width, np.round(entropy, 12), np.nan)
    sign = -1.0 if inverted else 1.0
    hits, extends = sign * value <= sign * low, sign * value <= sign * high
    found: list[tuple[int, int]] = []

    def search(left: int, right: int) -> None:
        at = left + down
        while at <= right - (width - 1 - down):
            if not hits[at]:
                at += 1
                continue
            a = b = at
            while a - 1 >= left + down and extends[a - 1]:
                a -= 1
            while b + 1 <= right - (width - 1 - down) and extends[b + 1]:
                b += 1
            begin, end = a - down, b + (width - 1 - down)
            best, choice = math.inf, (begin, end)
            size = end - begin + 1
            for span in range(size, max(0, size - most) if size > most else 0, -1):
                own = upto[begin + span : end + 2] - upto[begin : end + 2 - span]
                p = np.round(sign * log_probabilities(own, span, alphabet), 9)
                k = int(p.argmin())
                if p[k] < best:
                    best, choice = p[k], (begin + k, begin + k + span - 1)
            if choice[0] - left >= width and choice[0] > begin:
                search(left, choice[0] - 1)
            found.append(choice)
            left = choice[1] + 1
            at = max(b + 1, left + down)

    search(0, n - 1)
    found.sort()
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def seg_sequences(sequences: DataFrame, key: str, text: Column, letters: str, **options) -> DataFrame:
    """Segments (key, left, right), from 1, of strings over ``letters``."""
    kind = dict(sequences.dtypes)[key]

    def made(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch["text"]):
                codes = np.array([letters.find(c) for c in t or ""], dtype=int)
                rows += [(k, a + 1, b + 1) for a, b in seg(codes, len(letters), **options)]
            yield pd.DataFrame(rows, columns=[key, "left", "right"])

    return sequences.select(key, text.alias("text")).mapInPandas(made, f"{key} {kind}, left int, right int")


def greedy_classes(columns: np.ndarray, distance: float = 12.96) -> np.ndarray:
    """Classes of profile columns: each joins the first class whose founder is nearer than ``distance``."""
    founders: list[np.ndarray] = []
    out = np.empty(len(columns), dtype=int)
    for i, c in enumerate(columns):
        for k, f in enumerate(founders):
            if ((c - f) ** 2).sum() < distance * distance:
                out[i] = k
                break
        else:
            out[i] = len(founders)
            founders.append(c)
    return out


def seg_profiles(profiles: DataFrame, scale: float = 100.0, distance: float = 12.96, alphabet: int = 20, **options) -> DataFrame:
    """Segments (profile_id, left, right) of profiles (profile_id, pos, trg), whose columns are symbols by their classes.

    Columns count in whole parts of 1 / ``scale``; profiles with more classes
    than ``alphabet`` have an alphabet of that size.
    """
    kind = dict(profiles.dtypes)["profile_id"]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        codes = greedy_classes(np.rint(np.stack(group["trg"].to_numpy()) * scale), distance)
        found = seg(codes, max(alphabet, int(codes.max()) + 1), **options)
        return pd.DataFrame([(group["profile_id"].iloc[0], a + 1, b + 1) for a, b in found], columns=["profile_id", "left", "right"])

    return profiles.select("profile_id", "pos", "trg").groupBy("profile_id").applyInPandas(one, f"profile_id {kind}, left int, right int")
