"""Substitution matrices."""

from __future__ import annotations

import logging

import numpy as np

LOG = logging.getLogger(__name__)

# BLOSUM62 (Henikoff and Henikoff 1992), lower triangle of the twenty amino acids in the usual order.
AMINO_ACIDS = "ARNDCQEGHILKMFPSTWYV"
BLOSUM62 = """
 4
-1  5
-2  0  6
-2 -2  1  6
 0 -3 -3 -3  9
-1  1  0  0 -3  5
-1  0  0  2 -4  2  5
 0 -2  0 -1 -3 -2 -2  6
-2  0  1 -1 -3  0  0 -2  8
-1 -3 -3 -3 -1 -3 -3 -4 -3  4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""
# The same matrix's rows of the ambiguity codes against the twenty amino acids, and among themselves.
AMBIGUOUS = {
    "B": "-2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3",
    "Z": "-1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2",
    "X": " 0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2  0  0 -2 -1 -1",
}
AMBIGUOUS_PAIRS = {"BB": 4, "BZ": 1, "BX": -1, "ZZ": 4, "ZX": -1, "XX": -1}
STOP, STOP_STOP = -4, 1

#: Letters that any matrix gets; where it has none of its own they score 0 against everything.
EXTRA_LETTERS = "BXZJUO-."


def blosum62() -> dict[str, float]:
    """Scores by two letters, both ways."""
    out: dict[str, float] = {}

    def put(a: str, b: str, score: float) -> None:
        out[a + b] = out[b + a] = float(score)

    for a, row in zip(AMINO_ACIDS, BLOSUM62.strip().splitlines()):
        for b, score in zip(AMINO_ACIDS, row.split()):
            put(a, b, float(score))
    for a, row in AMBIGUOUS.items():
        for b, score in zip(AMINO_ACIDS, row.split()):
            put(a, b, float(score))
    for pair, score in AMBIGUOUS_PAIRS.items():
        put(*pair, score)
    for a in AMINO_ACIDS + "BZX":
        put(a, "*", STOP)
    put("*", "*", STOP_STOP)
    return out


def identity_matrix(match: float = 1.0, mismatch: float = 0.0, letters: str = AMINO_ACIDS + "BZX*") -> dict[str, float]:
    return {a + b: match if a == b else mismatch for a in letters for b in letters}


MATRICES = {"BLOSUM62": blosum62}


def named(name: str) -> dict[str, float]:
    """A matrix by name; an unknown name gives BLOSUM62 and a warning."""
    if name.upper() not in MATRICES:
        LOG.warning("no substitution matrix %s, BLOSUM62 is used", name)
        name = "BLOSUM62"
    return MATRICES[name.upper()]()


def parse_matrix(text: str) -> dict[str, float]:
    """A matrix in NCBI format: comment lines with #, a header of letters, a row per letter."""
    rows = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    return {row[0] + b: float(score) for row in rows[1:] for b, score in zip(rows[0], row[1:])}


def extend(matrix: dict[str, float], letters: str = EXTRA_LETTERS) -> dict[str, float]:
    """The matrix with every missing letter added, scoring 0 against all."""
    known = {p[0] for p in matrix}
    every = sorted(known | set(letters))
    return {a + b: matrix.get(a + b, 0.0) for a in every for b in every}


def as_table(matrix: dict[str, float]) -> tuple[str, np.ndarray]:
    """(letters, square array)."""
    letters = "".join(sorted({p[0] for p in matrix}))
    return letters, np.array([[matrix[a + b] for b in letters] for a in letters])
