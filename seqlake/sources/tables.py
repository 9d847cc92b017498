"""Readers of parameter files: statistics, score tables, substitution matrices, mixture parameters.

The files are small; each reader takes the text of one (as ``read_texts``
gives it) and returns plain values or numpy arrays, which operators send to
the executors with their functions.
"""

from __future__ import annotations

import configparser
import math
import re

import numpy as np

from seqlake.functions.alphabet import ALPHABET, N_RESIDUES


def statistics(text: str) -> dict[str, dict[str, float]]:
    """Sections of statistical parameters (``UNGAPPED``, ``GAPPED_A_1``): numbers by lower-case key."""
    found = configparser.ConfigParser(strict=False, comment_prefixes=("#",))
    found.read_string(text)
    return {name: {k: float(v) for k, v in found[name].items()} for name in found.sections()}


def _lines(text: str) -> list[str]:
    return [x.strip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]


def triangle(text: str) -> np.ndarray:
    """A symmetric score table: ``Cardinality = n``, then its lower triangle by rows; ``+`` is no score (-99)."""
    lines = _lines(text)
    at = next(i for i, x in enumerate(lines) if x.lower().startswith("cardinality"))
    n = int(lines[at].split("=")[1])
    values = [-99.0 if v == "+" else float(v) for x in lines[at + 1 :] for v in x.split()]
    if len(values) < n * (n + 1) // 2:
        raise ValueError(f"a table of {n} states needs {n * (n + 1) // 2} values, not {len(values)}")
    out = np.zeros((n, n))
    low = np.tril_indices(n)
    out[low] = values[: len(low[0])]
    return out + np.tril(out, -1).T


def smooth(values: np.ndarray) -> np.ndarray:
    """Five-point averages over the values that exist (not NaN); the two at either end take the nearest full window's, missing ones the one before."""
    known = np.flatnonzero(~np.isnan(values))
    own = values[known]
    if len(own) >= 5:
        means = np.convolve(own, np.full(5, 0.2), "valid")
        own = means[np.clip(np.arange(len(own)) - 2, 0, len(means) - 1)]
    out = values.copy()
    out[known] = own
    for i in range(1, len(out)):
        if np.isnan(out[i]):
            out[i] = out[i - 1]
    return out


def steps(text: str, smoothing: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of a step table: ``Cardinality = n``, then n keys and n values; ``+`` is a missing value. Keys come out half a unit apart."""
    lines = _lines(text)
    at = next(i for i, x in enumerate(lines) if x.lower().startswith("cardinality"))
    n = int(lines[at].split("=")[1])
    found = [math.nan if v == "+" else float(v) for x in lines[at + 1 :] for v in x.split()]
    keys, values = np.array(found[:n]), np.array(found[n : 2 * n])
    if len(values) < n or np.isnan(keys).any() or (np.diff(keys) <= 0).any():
        raise ValueError(f"a step table needs {n} rising keys and as many values")
    if smoothing:
        values = smooth(values)
    every = np.arange(round(2 * keys[0]), round(2 * keys[-1]) + 1) / 2
    return every, values[np.searchsorted(keys, every, side="right") - 1]


def levels(texts: dict[tuple[int, int], str]) -> dict[tuple[int, int], np.ndarray]:
    """Score tables by a pair of levels (lower first), one text each."""
    return {tuple(sorted(pair)): triangle(text) for pair, text in texts.items()}


def table_of(tables: dict[tuple[int, int], np.ndarray], bounds: list[float], eno1: float, eno2: float) -> np.ndarray | None:
    """The table of two effective numbers: each lies in the last level whose lower bound it reaches; None below the first."""
    place = [int(np.searchsorted(bounds, x, side="right")) - 1 for x in sorted((eno1, eno2))]
    return tables.get(tuple(place)) if place[0] >= 0 else None


def substitution_ratios(text: str, per_doubling: float = 2.0) -> list[list[float]]:
    """Frequency ratios (20 x 20, in code order) of a substitution matrix in the common text format: a line of letters, then a row of scores for each.

    ``per_doubling`` is the score units to a doubling of the ratio.
    """
    lines = _lines(text)
    letters = lines[0].split()
    rows = {x.split()[0]: dict(zip(letters, map(float, x.split()[1:]))) for x in lines[1:]}
    own = ALPHABET[:N_RESIDUES]
    return [[2.0 ** (rows[a][b] / per_doubling) for b in own] for a in own]


def matrix_named(name: str, known: dict[str, list[list[float]]], default: str) -> list[list[float]]:
    """The ratios of a matrix by name, in any case; an unknown name is the default's."""
    lower = {k.lower(): v for k, v in known.items()}
    return lower.get(name.lower(), lower[default.lower()])


def mixture(text: str) -> dict:
    """Prior and dishes of a mixture: ``key = value`` lines for numbers, and blocks ``name`` / rows of numbers / blank line for arrays.

    Keys and names are lower-cased; a block that repeats gives a list.
    """
    out: dict = {}
    for block in re.split(r"\n\s*\n", text):
        lines = _lines(block)
        while lines and "=" in lines[0]:
            key, _, value = lines.pop(0).partition("=")
            out[key.strip().lower()] = float(value)
        if lines:
            rows = np.array([[float(v) for v in x.split()] for x in lines[1:]])
            out.setdefault(lines[0].lower(), []).append(rows[0] if len(rows) == 1 else rows)
    return out
