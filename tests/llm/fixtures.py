"""Small tables with every odd case."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, ids string, id long, key string, n_lines int, removed string"


def table(spark, rows):
    """rows: (doc_id, text); the other columns clash with names that operators use inside."""
    full = [(i, t, "en", None, None if t is None else len(t), True, "x", 5, "k", 1, "r") for i, t in rows]
    return spark.createDataFrame(full, DOCS)


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def texts(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Documents with copies, near copies, shared passages and repeated lines, among them odd ones."""
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(1, 120)) for _ in range(n)]
    passage = words(rng, 30)
    out: list[tuple[int | None, str | None]] = []
    for i, w in enumerate(base):
        kind = i % 6
        if kind == 1 and i > 6:
            w = list(base[i - 1])  # an exact copy
        elif kind == 2 and i > 6:
            w = [x if rng.random() > 0.04 else "zz" for x in base[i - 2]]  # a near copy
        elif kind == 3:
            k = rng.randrange(len(w) + 1)
            w = w[:k] + passage + w[k:]
        elif kind == 4:
            w = w + w[: len(w) // 2]
        lines = [" ".join(w[k : k + 12]) for k in range(0, len(w), 12)]
        out.append((i, "\n".join(lines)))
    odd = [None, "", " \n\t ", "one", "A a A", "é ü 日本 🙂", "tab\tand\vfeed\fand\rreturn", "x" * 5000, "same " * 3000, "<|endoftext|> </s> ▁ \\ \x00", "nb\xa0sp and\x85nel", "\n\n\nw1 w2 w3 w4 w5 w6\n\n"]
    out += [(1000 + i, t) for i, t in enumerate(odd)]
    out += [(None, out[0][1]), (None, None), out[3], out[3]]  # null ids, repeated rows
    rng.shuffle(out)
    return out


def rows_by_id(frame, id_col="doc_id"):
    """id -> list of rows, in a fixed order."""
    found: dict = {}
    for r in frame.collect():
        found.setdefault(r[id_col], []).append(r)
    return found
