"""Pairwise affine-gap alignment: configuration, kernel, and its Spark forms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrices
from ..functions.columns import SIMILAR

#: A batch of pairs is aligned at once while its traceback holds at most so many cells.
CELLS_AT_ONCE = 24_000_000


@dataclass(frozen=True)
class AlignConfig:
    """Scoring. Without match and mismatch the named matrix scores; letters unknown to it score 0 if in EXTRA_LETTERS."""

    mode: str = "global"
    substitution_matrix: str = "BLOSUM62"
    open_gap_score: float = -10.0
    extend_gap_score: float = -0.5
    match_score: float | None = None
    mismatch_score: float | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("global", "local"):
            raise ValueError("mode is global or local")

    def configured(self, **changes) -> "AlignConfig":
        """A changed copy; ValueError for a name that there isn't."""
        known = sorted(f.name for f in fields(self))
        if unknown := sorted(set(changes) - set(known)):
            raise ValueError(f"no such attribute: {', '.join(unknown)}; there are {', '.join(known)}")
        return replace(self, **changes)

    def table(self) -> tuple[str, np.ndarray]:
        if self.match_score is not None or self.mismatch_score is not None:
            found = matrices.identity_matrix(1.0 if self.match_score is None else self.match_score, self.mismatch_score or 0.0)
        else:
            found = matrices.named(self.substitution_matrix)
        return matrices.as_table(matrices.extend(found))

    def as_dict(self) -> dict:
        return asdict(self)


class Aligner:
    """Aligns batches of pairs by anti-diagonals, all pairs of a batch at once.

    Of equally good ways back the order of choice is: both letters, gap in the second, gap in the first.
    """

    def __init__(self, config: AlignConfig) -> None:
        self.config = config
        self.letters, table = config.table()
        n = len(self.letters)
        self.scores = np.zeros((n + 1, n + 1))  # the last letter pads
        self.scores[:n, :n] = table
        self.code = np.full(256, -1, np.int64)
        for i, c in enumerate(self.letters):
            self.code[ord(c)] = i
        classes = {c: k for k, s in enumerate(SIMILAR) for c in s}
        self.alike = [classes.get(c, -1 - i) for i, c in enumerate(self.letters)]
        self.gap = [c in "-." for c in self.letters]

    def encoded(self, text: str) -> np.ndarray:
        codes = self.code[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
        if (codes < 0).any():
            raise ValueError(f"a letter of {text[:40]!r} isn't in the matrix")
        return codes

    def align(self, pairs: list[tuple[str, str]]) -> list[tuple[float, float, float, int]]:
        """(score, identity, similarity, columns) of each pair of texts."""
        coded = [(self.encoded(a), self.encoded(b)) for a, b in pairs]
        out: list = [None] * len(pairs)
        order = sorted(range(len(pairs)), key=lambda i: (len(coded[i][0]) + len(coded[i][1]), len(coded[i][0])))
        while order:
            n, rows, diagonals = 0, 0, 0
            for i in reversed(order):
                a, b = coded[i]
                rows, diagonals = max(rows, len(a) + 1), max(diagonals, len(a) + len(b) + 1)
                if n and (n + 1) * rows * diagonals > CELLS_AT_ONCE:
                    break
                n += 1
            batch = order[-n:]
            order = order[:-n]
            for i, found in zip(batch, self.sweep([coded[i] for i in batch])):
                out[i] = found
        return out

    def sweep(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, float, float, int]]:
        count, local = len(pairs), self.config.mode == "local"
        la, lb = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
        rows, width = int(la.max()) + 1, int(lb.max())
        pad = len(self.letters)
        first = np.full((count, rows - 1), pad)
        second = np.full((count, width), pad)  # turned round, so that a diagonal reads both upwards
        for k, (a, b) in enumerate(pairs):
            first[k, : len(a)] = a
            second[k, width - len(b) :] = b[::-1]
        open_, more, low = self.config.open_gap_score, self.config.extend_gap_score, -np.inf
        total = rows + width
        # way[d][k, i]: bits 0-1 where both-letters came from, 2-3 gap in the second, 4-5 gap in the first; 6: a local start
        way = np.zeros((total, count, rows), np.uint8)
        both0, both1 = np.full((count, rows), low), np.full((count, rows), low)
        up0, left0 = np.full((count, rows), low), np.full((count, rows), low)
        best1 = np.full((count, rows), low)
        both0[:, 0] = 0.0
        origin = np.full((count, rows), low)
        before = {"both": both0, "up": up0, "left": left0}
        older_best, older_state = origin, np.zeros((count, rows), np.uint8)
        # older_best and older_state: the best of the three states two diagonals ago, and which it was
        top, at, end_state = np.full(count, 0.0 if local else low), np.zeros((count, 2), np.int64), np.zeros(count, np.int64)
        previous_best, previous_state = both0.copy(), np.zeros((count, rows), np.uint8)
        if not local:
            for k in np.flatnonzero((la + lb) == 0):
                top[k] = 0.0
        del both1, best1
        for d in range(1, total):
            lo, hi = max(0, d - width), min(rows - 1, d)
            both, up, left = (np.full((count, rows), low) for _ in range(3))
            mark = way[d]
            a, z = max(lo, 1), min(hi, d - 1)  # cells with a letter of either
            if a <= z:
                score = self.scores[first[:, a - 1 : z], second[:, width - d + a : width - d + z + 1]]
                came = older_best[:, a - 1 : z]
                state = older_state[:, a - 1 : z]
                if local:
                    fresh = came <= 0
                    came = np.where(fresh, 0.0, came)
                    state = np.where(fresh, 64, state)
                both[:, a : z + 1] = came + score
                mark[:, a : z + 1] |= state
            if hi >= 1:  # a letter of the first against a gap
                a = max(lo, 1)
                x, y, w = (before[n][:, a - 1 : hi] for n in ("both", "up", "left"))
                x, y, w = x + open_, y + more, w + open_
                state = np.where(y > x, 1, 0)
                value = np.maximum(x, y)
                state = np.where(w > value, 2, state)
                up[:, a : hi + 1] = np.maximum(value, w)
                mark[:, a : hi + 1] |= (state << 2).astype(np.uint8)
            z = min(hi, d - 1)
            if lo <= z:  # a letter of the second against a gap
                x, y, w = (before[n][:, lo : z + 1] for n in ("both", "left", "up"))
                x, y, w = x + open_, y + more, w + open_
                value = np.maximum(x, w)
                state = np.where(w > x, 1, 0)
                state = np.where(y > value, 2, state)
                left[:, lo : z + 1] = np.maximum(value, y)
                mark[:, lo : z + 1] |= (state << 4).astype(np.uint8)
            older_best, older_state = previous_best, previous_state
            previous_best = np.maximum(both, up)
            previous_state = np.where(up > both, 1, 0).astype(np.uint8)
            previous_state[left > previous_best] = 2
            previous_best = np.maximum(previous_best, left)
            before = {"both": both, "up": up, "left": left}
            if local:
                inside = (np.arange(rows) <= la[:, None]) & (d - np.arange(rows) <= lb[:, None])
                value = np.where(inside, both, low)
                i = value.argmax(1)
                found = value[np.arange(count), i]
                better = found > top
                top[better], at[better, 0], at[better, 1] = found[better], i[better], d
            else:
                for k in np.flatnonzero(la + lb == d):
                    top[k], at[k], end_state[k] = previous_best[k, la[k]], (la[k], d), previous_state[k, la[k]]
        for k, (a, b) in enumerate(pairs):
            yield (float(top[k]), *self.walk(way[:, k], a.tolist(), b.tolist(), int(at[k, 0]), int(at[k, 1]), int(end_state[k]), local))

    def walk(self, way: np.ndarray, a: list[int], b: list[int], i: int, d: int, state: int, local: bool) -> tuple[float, float, int]:
        """(identity, similarity, columns) of the path that ends in cell (i, d - i). Columns of two gap letters don't count."""
        same = alike = columns = 0
        while d:
            mark = int(way[d, i])
            if state == 0:
                x, y = a[i - 1], b[d - i - 1]
                if not (self.gap[x] and self.gap[y]):
                    columns += 1
                    if x == y:
                        same += 1
                    elif self.alike[x] == self.alike[y]:
                        alike += 1
                if mark & 64:
                    break
                state, i, d = mark & 3, i - 1, d - 2
            elif state == 1:
                columns += 1
                state, i, d = mark >> 2 & 3, i - 1, d - 1
            else:
                columns += 1
                state, d = mark >> 4 & 3, d - 1
        return (same / columns, (same + alike) / columns, columns) if columns else (0.0, 0.0, 0)


SCORES = "score double, identity double, similarity double, columns int"


def align_pairs(pairs: DataFrame, config: AlignConfig, a: str = "sequence_a", b: str = "sequence_b", cutoff: float | None = None) -> DataFrame:
    """All columns of pairs but the two sequences, with score, identity, similarity and columns.

    The cutoff is applied inside the kernel: a filter on the result could not be pushed below it and a deterministic
    function would be evaluated twice.
    """
    keep = [c for c in pairs.columns if c not in (a, b)]
    schema = ", ".join([f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep] + [SCORES])

    def run(batches):
        aligner = Aligner(config)
        for batch in batches:
            found = aligner.align(list(zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())))
            table = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *(pa.array([f[i] for f in found], k) for i, k in enumerate((pa.float64(), pa.float64(), pa.float64(), pa.int32())))],
                [*keep, "score", "identity", "similarity", "columns"],
            )
            yield table if cutoff is None else table.filter(pa.array([f[1] >= cutoff for f in found], pa.bool_()))

    return pairs.select(*keep, a, b).mapInArrow(run, schema)


def global_align_udf(config: AlignConfig = AlignConfig()):
    """A column function of two texts, struct<score, identity, similarity, columns>."""

    def compute(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(Aligner(config).align(list(zip(x, y))), columns=["score", "identity", "similarity", "columns"])

    return F.pandas_udf(compute, SCORES).asNondeterministic()


def register(spark: SparkSession, config: AlignConfig = AlignConfig()) -> None:
    """Makes global_align(a, b) known to SQL."""
    spark.udf.register("global_align", global_align_udf(config))
