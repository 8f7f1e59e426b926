"""Benchmark decontamination: n-gram seeds and Smith-Waterman alignment.

The n-grams of the test items are the seeds, all of them: an edited copy may have left any few, also frequent ones. A
caller may keep each item's rarest share only, by counts over the whole corpus, at the price of missed copies. A seed
found in a document places the item along a diagonal of the passage around it; item and passage are aligned word by
word, so that edited and partly rewritten copies score too. An item's score is its best local alignment divided by the
score of a perfect copy.

The test items are the query side: they are held in memory in blocks of BLOCK_WORDS words, one after the other.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, added, prepare, texts_of, tidied
from .substring_dedup import Words, slices

MATCH, MISMATCH, GAP = 2, -1, 1
BLOCK_WORDS = 2_000_000
NO_PUNCTUATION = string.punctuation.encode()
HITS = "matched items"  # a column name that no SQL identifier without quotes can have
HIT_TYPE = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def normal(text: str) -> bytes:
    """Lower case, ASCII punctuation dropped; words stay apart by white space."""
    return text.lower().encode().translate(None, NO_PUNCTUATION)


def local_score(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, end of it in the passage). A row at a time; gaps along a row by a running maximum."""
    ramp = GAP * np.arange(len(passage) + 1)
    before, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        now = np.zeros(len(passage) + 1, np.int64)
        now[1:] = np.maximum(before[:-1] + np.where(passage == word, MATCH, MISMATCH), before[1:] - GAP)
        now = np.maximum.accumulate(np.maximum(now, 0) + ramp) - ramp
        if (top := int(now.max())) > best:
            best, end = top, int(now.argmax())
        before = now
    return best, end


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment in the passage; the start is the end of the reversed one."""
    score, end = local_score(item, passage)
    if not score:
        return 0, 0, 0
    back = local_score(item[::-1], passage[:end][::-1])[1]
    return score, end - back, end


class Items:
    """Test items of a block: word hashes, and seeds sorted by hash with their item and place.

    `short` has, by length, those that are shorter than a seed: their whole text is their seed.
    """

    def __init__(self, items: list[tuple[int, str]], seed_words: int) -> None:
        self.ids = [i for i, _ in items]
        self.seed_words = seed_words
        w = Words([normal(t) for _, t in items], seed_words, seed_words)
        bounds = [*w.first.tolist(), len(w.starts)]
        self.words = [w.hashes[a:b] for a, b in zip(bounds, bounds[1:])]
        runs, at = (w.runs(seed_words)[w.windows], w.windows) if len(w.windows) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.seeds, self.item = runs, w.doc[at] if len(at) else at
        self.place = at - w.first[self.item] if len(at) else at
        self.sort()
        self.short: dict[int, dict[int, list[int]]] = {}
        for k, words in enumerate(self.words):
            if 0 < len(words) < seed_words:
                self.short.setdefault(len(words), {}).setdefault(int(w.runs(len(words))[w.first[k]]), []).append(k)

    def sort(self) -> None:
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.item, self.place = self.seeds[order], self.item[order], self.place[order]

    def keep_rare(self, counts: dict[int, int], share: float) -> None:
        """Each item keeps its rarest `share` of seeds, at least one."""
        n = np.array([counts.get(s, 0) for s in self.seeds.tolist()], np.int64)
        order = np.lexsort((self.place, n, self.item))
        item = self.item[order]
        first = np.searchsorted(item, item)
        size = np.searchsorted(item, item, side="right") - first
        keep = order[np.arange(len(order)) - first < np.maximum(1, np.ceil(share * size))]
        self.seeds, self.item, self.place = self.seeds[keep], self.item[keep], self.place[keep]
        self.sort()

    def found(self, text: bytes | list[bytes]) -> tuple[Words, np.ndarray]:
        """The texts' words, and the first words of their n-grams that are seeds."""
        w = Words(text, self.seed_words, self.seed_words)
        if not len(w.windows) or not len(self.seeds):
            return w, np.zeros(0, np.int64)
        runs = w.runs(self.seed_words)[w.windows]
        at = np.minimum(np.searchsorted(self.seeds, runs), len(self.seeds) - 1)
        return w, w.windows[self.seeds[at] == runs]

    def matches(self, texts: list[bytes], least: float) -> list[list[tuple[int, float, int, int]]]:
        """For each text its (item, score, start, end) of at least `least`, best first; places are words of the normal text."""
        out: list[list[tuple[int, float, int, int]]] = []
        for _, part in slices(texts):
            w, at = self.found(part)
            runs = w.runs(self.seed_words) if len(at) else w.hashes
            lines: dict[tuple[int, int], list[int]] = {}
            low, high = np.searchsorted(self.seeds, runs[at]), np.searchsorted(self.seeds, runs[at], side="right")
            for i, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
                for s in range(a, b):
                    lines.setdefault((int(w.doc[i]), int(self.item[s])), []).append(i - int(self.place[s]))
            bounds = [*w.first.tolist(), len(w.starts)]
            for n, seeds in self.short.items() if len(w.hashes) else ():
                all_runs = w.runs(n)
                for i in np.flatnonzero(np.isin(all_runs, np.fromiter(seeds, np.uint64, len(seeds)))).tolist():
                    d = int(w.doc[i])
                    if i + n <= bounds[d + 1]:
                        for k in seeds[int(all_runs[i])]:
                            lines.setdefault((d, k), []).append(i)
            own: list[list[tuple[int, float, int, int]]] = [[] for _ in part]
            for (d, k), diagonals in lines.items():
                item, need = self.words[k], least * MATCH * len(self.words[k])
                slack = 2 + len(item) // 2
                best, region = (0, 0, 0), None
                for x in [*sorted(set(diagonals)), None]:
                    if region and (x is None or x - slack > region[1]):
                        a, b = max(bounds[d], region[0]), min(bounds[d + 1], region[1])
                        # No score is above that of all the item's words that the passage has.
                        able = MATCH * int(np.isin(item, w.hashes[a:b]).sum())
                        score, start, end = align(item, w.hashes[a:b]) if able >= need and able > best[0] else (0, 0, 0)
                        if score > best[0]:
                            best = (score, a + start - bounds[d], a + end - bounds[d])
                        region = None
                    if x is not None:
                        region = (region[0] if region else x - slack, x + len(item) + slack)
                if best[0] >= need:
                    own[d].append((self.ids[k], best[0] / (MATCH * len(item)), best[1], best[2]))
            out += [sorted(x, key=lambda m: (-m[1], m[0])) for x in own]
        return out


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """The items with an id and a text, dealt by hash into blocks of about BLOCK_WORDS words."""
    rows = benchmark.select(benchmark[id_col].cast("long").alias("id"), benchmark[text_col].cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    words = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(words / 6 / BLOCK_WORDS))
    return [rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k) for k in range(n)]


def seed_counts(docs: DataFrame, items: Items, text_col: str) -> dict[int, int]:
    """How often each seed is in the whole corpus: at most as many rows as there are seeds come back."""

    @tidied
    def run(batches: Batches):
        total = np.zeros(len(items.seeds), np.int64)
        for b in batches:
            for _, part in slices([normal(t) for t in texts_of(b.column(0))]):
                w, at = items.found(part)
                if len(at):
                    np.add.at(total, np.searchsorted(items.seeds, w.runs(items.seed_words)[at]), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(items.seeds[some].view(np.int64)), pa.array(total[some])], ["seed", "n"])

    rows = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()
    return {r["seed"] & ((1 << 64) - 1): r["n"] for r in rows}


def matched(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, seed_words: int = 4, rare_share: float = 1.0, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All columns of docs and HITS: array of (item, score, start, end) with score >= least, best first.

    A null or empty text matches nothing. Items with a null id or text, or with no word, are in no match; those of fewer
    than seed_words words match where their words occur unchanged. A copy without seed_words words in a row of its item
    is not found. Repeated items match each by themselves, repeated rows get equal results. An empty benchmark matches nothing.
    Each block of items takes a pass over docs, and one more if rare_share is under 1; no shuffle of docs.
    """
    prepare(docs.sparkSession)
    out = docs
    for k, block in enumerate(blocks_of(benchmark, item_col, item_text_col)):
        items = Items(sorted((r["id"], r["text"]) for r in block.collect()), seed_words)
        if rare_share < 1:
            items.keep_rare(seed_counts(docs, items, text_col), rare_share)

        @tidied
        def run(batches: Batches, items=items, more=k > 0):
            for b in batches:
                found = items.matches([normal(t) for t in texts_of(b.column(text_col))], least)
                if more:
                    old = [[tuple(m.values()) for m in x] for x in b.column(HITS).to_pylist()]
                    found = [sorted([*x, *y], key=lambda m: (-m[1], m[0])) for x, y in zip(old, found, strict=True)]
                    b = b.drop_columns([HITS])
                rows = [[dict(zip(("item", "score", "start", "end"), m)) for m in x] for x in found]
                kind = pa.list_(pa.struct([("item", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], [*b.schema.names, HITS])

        out = out.mapInArrow(run, added(docs, HITS, HIT_TYPE))
    return out


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per input row: id, n_items, best_item, best_score, items (best first), contaminated."""
    text = options.get("text_col", "text")
    rows = matched(docs.select(docs[id_col], docs[text]), benchmark, **options)
    hits = F.col(HITS)
    first = F.get(hits, F.lit(0))
    return rows.select(F.col(id_col), F.size(hits).cast("long").alias("n_items"), first["item"].alias("best_item"), F.round(first["score"], 6).alias("best_score"), F.transform(hits, lambda h: h["item"]).alias("items"), (F.size(hits) > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that match no item."""
    return matched(docs, benchmark, **options).where(F.size(F.col(HITS)) == 0).drop(HITS)
