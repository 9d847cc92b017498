"""Symbols: 20 residues, three ambiguity codes, the unknown residue and the gap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the file formats: residue letters in code order, and their background
# probabilities (Robinson & Robinson 1991).
ALPHABET = "ARNDCQEGHILKMFPSTWYVBZJX-"
N_RESIDUES = 20
X, GAP = 23, 24
#: Ambiguity codes B, Z and J, and the residues each stands for.
AMBIGUOUS = {20: (2, 3), 21: (5, 6), 22: (9, 10)}
BACKGROUND = (
    0.078050, 0.051290, 0.044870, 0.053640, 0.019250, 0.042640, 0.062950, 0.073770, 0.021990, 0.051420,
    0.090190, 0.057440, 0.022430, 0.038560, 0.052030, 0.071200, 0.058410, 0.013300, 0.032160, 0.064410,
)
#: Secondary-structure states in code order: coil, strand, helix.
SS_STATES = "CEH"


def encode(symbol: Column) -> Column:
    """Code of a letter, in either case; O and U count as X; any other character is an error."""
    upper = F.translate(symbol, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    known = F.translate(upper, "OU", "XX")
    at = F.instr(F.lit(ALPHABET), known)
    return F.when((F.length(symbol) == 1) & (at > 0), (at - 1).cast("int")).when(
        symbol.isNotNull(), F.raise_error(F.concat(F.lit("unrecognised residue "), symbol)).cast("int")
    )


def decode(code: Column) -> Column:
    """Letter of a code."""
    return F.substring(F.lit(ALPHABET), code + 1, F.lit(1))


def is_residue(code: Column) -> Column:
    """Any residue, unknown ones included."""
    return code <= X


def encode_ss(state: Column) -> Column:
    return F.nullif(F.instr(F.lit(SS_STATES), F.upper(state)), F.lit(0)) - 1


def decode_ss(code: Column) -> Column:
    return F.substring(F.lit(SS_STATES), code + 1, F.lit(1))
