"""Byte-level BPE token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch are held as one ragged numpy array of symbol ids. In every round each sequence finds
its lowest-rank adjacent pair and all sequences apply theirs at once; the symbols that survive are counted. The counts
are those of the tokenizer file's own library with its defaults: special strings inside a text count as one token, no
begin or end tokens, no truncation or padding.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Batches, as_text, prepare, texts_of, tidied

#: Pre-tokens of the byte-level BPE family (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest from code point 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class RankMerger:
    """Counts the symbols left of each byte string once all its merges are done."""

    #: Longer sequences would keep a round of the whole array going for each of their merges.
    LONG = 512

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.size = max(vocab.values()) + 2
        self.base = np.array([vocab[c] for c in byte_alphabet()], np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        first = np.r_[True, np.diff(keys[order]) != 0]  # a repeated merge keeps its lowest rank
        self.keys, self.ranks, self.made = keys[order][first], order[first], made[order][first]
        self.none = len(pairs)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], self.none), self.made[at]

    @cached_property
    def table(self) -> dict[int, tuple[int, int]]:
        """key of a pair -> (rank, merged symbol)."""
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))

    def count_long(self, word: bytes) -> int:
        """The count of one long sequence, of which a round would change little: its pairs wait in a heap, by rank and place."""
        symbols = self.base[np.frombuffer(word, np.uint8)].tolist()
        table, size, n = self.table, self.size, len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(*found, i) for i in range(n - 1) if (found := table.get(symbols[i] * size + symbols[i + 1]))]
        heap = [(rank, i, made) for rank, made, i in heap]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j < 0 or table.get(symbols[i] * size + symbols[j], (0, -1))[1] != made:
                continue  # one of the two has been merged since
            symbols[i], symbols[j], left = made, -1, left - 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b >= 0 and (found := table.get(symbols[a] * size + symbols[b])):
                    heapq.heappush(heap, (found[0], a, found[1]))
        return left

    def count(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(lengths > self.LONG).tolist():
            out[i] = self.count_long(words[i])
        short = np.flatnonzero(lengths <= self.LONG)
        if len(short):
            out[short] = self.count_short([words[i] for i in short.tolist()])
        return out

    def count_short(self, words: list[bytes]) -> np.ndarray:
        lengths = np.array([len(w) for w in words], np.int64)
        out = lengths.copy()
        symbols = self.base[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(symbols) > 1:
            same = owner[:-1] == owner[1:]
            rank, made = self.pairs(symbols[:-1], symbols[1:])
            rank[~same] = self.none
            rank = np.append(rank, self.none)
            starts = np.flatnonzero(np.r_[True, ~same])
            best = np.minimum.reduceat(rank, starts)
            alive = best < self.none
            if not alive.any():
                break
            mine = np.repeat(best, np.diff(np.r_[starts, len(symbols)]))
            pick = (rank == mine) & (mine < self.none)
            # In a run of overlapping picks (as of "aaaa") the first, third, ... are applied.
            at = np.flatnonzero(pick)
            fresh = np.r_[True, np.diff(at) != 1]
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            symbols[at] = made[at]
            keep = np.repeat(alive, np.diff(np.r_[starts, len(symbols)]))
            keep[at + 1] = False
            np.subtract.at(out, owner[at], 1)
            symbols, owner = symbols[keep], owner[keep]
        return out


class TokenCounter:
    """Counts tokens of whole texts; keeps the counts of the pre-tokens seen, of short ones and up to a bounded number."""

    LIMIT, SHORT, LONG_TEXT = 200_000, 64, 1 << 20

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer without normalizer is needed")
        self.merger = RankMerger(model["vocab"], model["merges"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.words, self.known = regex.compile(PRE_TOKEN), {}

    def split(self, text: str) -> tuple[list[str] | Counter, int]:
        """Pre-tokens, of a long text with their numbers, and the number of special strings between them."""
        parts = self.special.split(text) if self.special is not None and self.special.search(text) else [text]
        if len(text) > self.LONG_TEXT:
            return Counter(m.group() for p in parts for m in self.words.finditer(p)), len(parts) - 1
        return [w for p in parts for w in self.words.findall(p)], len(parts) - 1

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.known) > self.LIMIT:
            self.known.clear()
        known, out, todo = self.known, [], []
        for text in texts:
            words, special = self.split(text)
            todo.append((words, special))
        new = list({w for words, _ in todo for w in words if w not in known})
        long = {}
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            for w, n in zip(part, self.merger.count([w.encode() for w in part]).tolist()):
                (known if len(w) <= self.SHORT else long)[w] = n
        for words, special in todo:
            if isinstance(words, Counter):
                out.append(special + sum(n * (known[w] if w in known else long[w]) for w, n in words.items()))
            else:
                out.append(special + sum(known[w] if w in known else long[w] for w in words))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows pass through, one row each; other
    columns are not read. No shuffle: each batch is counted where it is read.
    """
    prepare(docs.sparkSession)

    @tidied
    def run(batches: Batches):
        counts = counter(tokenizer_path)
        for b in batches:
            texts = texts_of(b.column(1))
            n = counts(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], as_text(docs, text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
