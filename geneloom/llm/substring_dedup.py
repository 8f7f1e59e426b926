"""Removal of repeated word windows by suffix trees over groups of suffixes that share a prefix.

Each word covered by a window of `window` words that also starts in a document with a smaller id is removed. Windows
that can't repeat never leave their document:

1. Of a window's runs of `prefix` words the one with the least hash is its anchor; equal windows have equal anchors at
   equal places. Anchors go to groups by hash; those that only one document has are dropped.
2. The suffixes around the anchors that are left (the words from the first window of an anchor to the end of its last)
   are dealt by a prefix of variable length: the anchor's words or, where a sample over all partitions shows that these
   are very frequent, the shortest beginning of the window, in steps of PREFIX_STEP words, that isn't. The number of
   groups follows the counted bytes of the table.
3. Each group's suffixes are one subtree: sorted, with the words that neighbours share, which gives the inner nodes.
   Those at `window` words or deeper are the repeats that can't go on to the right; the shallowest of them above a
   suffix holds the least document id among all that begin with its window.

A window that a sample shows in a large share of all documents never goes to a group: its least document id comes from
a partial aggregate of at most HOT_WINDOWS rows, which each document is then held against.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, prepare, shuffle_partitions, tidied

HOT_WINDOWS = HOT_PREFIXES = 20_000
#: Words by which a frequent prefix grows.
PREFIX_STEP = 2
#: Bytes of text for each group of anchors or suffixes.
GROUP_BYTES = 32 << 20
SLICE_BYTES = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
STEP = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and STEP**-i modulo 2**64 for i < SLICE_BYTES."""
    inverse = pow(STEP, -1, 1 << 64)
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(SLICE_BYTES - 1, x, np.uint64)], dtype=np.uint64) for x in (STEP, inverse))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_spans(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words, in pieces of SLICE_BYTES, so that only these three grow with the text.

    A word's hash is that of a polynomial in STEP; parts of a word that pieces divide are put together.
    """
    data = np.frombuffer(buffer, np.uint8)
    up, down = powers()
    found: list[list[np.ndarray]] = []
    for begin in range(0, len(data), SLICE_BYTES):
        piece = data[begin : begin + SLICE_BYTES]
        word = np.zeros(len(piece) + 2, bool)
        word[1:-1] = ~IS_SPACE[piece]
        edge = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edge[::2], edge[1::2]
        values = piece.astype(np.uint64)
        values += np.uint64(1)
        values *= up[: len(piece)]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts]
        starts, ends = starts + begin, ends + begin
        if len(starts) and starts[0] == begin and found and found[-1][1][-1] == begin:  # the last word goes on
            last = found[-1]
            last[2][-1:] += h[:1] * np.uint64(pow(STEP, begin - int(last[0][-1]), 1 << 64))
            last[1][-1] = ends[0]
            starts, ends, h = starts[1:], ends[1:], h[1:]
        if len(starts):
            found.append([starts, ends, h])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, ends, h = (np.concatenate(x) if len(found) > 1 else x[0] for x in zip(*found))
    return starts, ends, mix(h)


class Words:
    """The words of some texts: byte spans, hashes, and for each window the place of its anchor.

    Without a window there are spans and hashes only. Takes 24 bytes a word, and up to 90 with a window, beside the text.
    """

    def __init__(self, texts: list[bytes], window: int = 0, prefix: int = 0) -> None:
        self.buffer = b"\n".join(texts)
        self.starts, self.ends, self.hashes = word_spans(self.buffer)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        n = len(self.starts)
        self.first = np.searchsorted(self.starts, np.r_[0, ends[:-1]])[: len(texts)]  # each text's first word
        if n == 0:
            self.hashes = self.windows = self.anchor = self.grams = self.doc = np.zeros(0, np.int64)
            return
        if not window:
            return
        self.doc = np.repeat(np.arange(len(texts)), np.diff(np.r_[self.first, n]))
        self.grams = self.runs(prefix)
        last = max(0, n - window + 1)
        least, at = self.grams[:last].copy(), np.arange(last)
        for j in range(1, window - prefix + 1):
            less = self.grams[j : j + last] < least
            least[less] = self.grams[j : j + last][less]
            at[less] = np.flatnonzero(less) + j
        self.windows = np.flatnonzero(self.doc[:last] == self.doc[window - 1 : window - 1 + last])  # first words of windows
        self.anchor = at[self.windows]

    def runs(self, length: int) -> np.ndarray:
        """A hash for the `length` words from each word on; of no use where these leave the document."""
        h = np.zeros(len(self.hashes), np.uint64)
        for j in range(length):
            part = self.hashes[j:] * np.uint64((2 * j + 3) * STEP & MASK)
            h[: len(part)] += part
        return mix(h)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1 of one document."""
        return self.buffer[self.starts[i] : self.ends[j - 1]]


def slices(texts: list[bytes]):
    """(first index, texts) in parts of about SLICE_BYTES; a longer text is a part of its own."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > SLICE_BYTES:
            yield begin, texts[begin:i]
            begin, total = i, 0
        total += len(t)
    if texts:
        yield begin, texts[begin:]


def pack(value: object, level: int = 6) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(value, protocol=5))


def unpack(value: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(value))


def canonical(words: bytes) -> bytes:
    return b" ".join(words.split())


class Plan:
    """What all tasks share: lengths, the number of groups, frequent prefixes, and the least ids of hot windows."""

    def __init__(self, window: int, prefix: int, parts: int) -> None:
        self.window, self.prefix, self.parts = window, prefix, parts
        self.hot_prefixes = np.zeros(0, np.uint64)
        self.hot_beginnings: dict[int, np.ndarray] = {}
        self.hot_windows: dict[bytes, int | None] = {}
        self.hot_hashes = np.zeros(0, np.uint64)

    def words(self, texts: list[bytes]) -> Words:
        return Words(texts, self.window, self.prefix)

    def extended(self, w: Words, windows: np.ndarray) -> np.ndarray:
        """A hash of each window's shortest beginning that isn't frequent, the whole window at most."""
        found, left = np.zeros(len(windows), np.uint64), np.arange(len(windows))
        for length in (*sorted(self.hot_beginnings), self.window):
            h = w.runs(length)[windows[left]]
            found[left] = mix(h + np.uint64(length))
            left = left[np.isin(h, self.hot_beginnings.get(length, ()))]
        return found

    def hot_at(self, w: Words, windows: np.ndarray) -> dict[int, bytes]:
        """Those of the windows that are hot, by first word; found by hash, confirmed by their words."""
        if not len(self.hot_hashes) or not len(windows):
            return {}
        found = windows[np.isin(w.runs(self.window)[windows], self.hot_hashes)]
        texts = {int(i): canonical(w.text(i, i + self.window)) for i in found}
        return {i: t for i, t in texts.items() if t in self.hot_windows}


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def spread_sample(base: DataFrame, rows: int, docs: int, chars: int) -> list[bytes]:
    """About `docs` of the `rows` texts, taken from all partitions, of at most `chars` characters each."""
    text = base.select("text").where(F.length("text") <= chars)
    return [r["text"].encode() for r in text.sample(min(1.0, docs / max(rows, 1)), seed=7).limit(2 * docs).collect()]


def plan_hot(base: DataFrame, plan: Plan, rows: int, sample_docs: int, share: float) -> None:
    """Prefixes and windows that at least `share` of a sample's documents have. They decide how rows are dealt, never the result."""
    length = plan.window

    def count(counter: Counter, w: Words, hashes: np.ndarray, at: np.ndarray) -> None:
        """Adds how many documents have each hash."""
        pairs = np.unique(np.stack([w.doc[at].astype(np.uint64), hashes[at]]), axis=1)[1]
        counter.update(dict(zip(*(x.tolist() for x in np.unique(pairs, return_counts=True)))))

    def frequent(counter: Counter) -> np.ndarray:
        return np.sort(np.array([h for h, c in counter.most_common(HOT_PREFIXES) if c >= least], np.uint64))

    prefixes, windows, texts = Counter(), Counter(), {}
    sample = spread_sample(base, rows, sample_docs, 1 << 14)
    least = max(3, int(np.ceil(share * len(sample))))
    for _, part in slices(sample):
        w = plan.words(part)
        if not len(w.windows):
            continue
        whole = w.runs(length)
        count(prefixes, w, w.grams, np.unique(w.anchor))
        count(windows, w, whole, w.windows)
        for i, h in zip(w.windows.tolist(), whole[w.windows].tolist()):
            if windows[h] > 1 and h not in texts:
                texts[h] = canonical(w.text(i, i + length))
    plan.hot_prefixes = frequent(prefixes)
    beginnings = {n: Counter() for n in range(plan.prefix + PREFIX_STEP, length, PREFIX_STEP)}
    for _, part in slices(sample) if len(plan.hot_prefixes) else ():
        w = plan.words(part)
        at = w.windows[np.isin(w.grams[w.anchor], plan.hot_prefixes)] if len(w.windows) else w.windows
        for n, counter in beginnings.items() if len(at) else ():
            count(counter, w, w.runs(n), at)
    plan.hot_beginnings = {n: frequent(c) for n, c in beginnings.items()}
    hot = [(h, texts[h]) for h, c in windows.most_common(HOT_WINDOWS) if c >= least]
    plan.hot_hashes = np.sort(np.array([h for h, _ in hot], np.uint64))
    plan.hot_windows = {t: None for _, t in hot}
    if not hot:
        return

    @tidied
    def least_ids(batches: Batches):
        ids: dict[bytes, int] = {}
        for b in batches:
            doc_ids = b.column("id").to_pylist()
            for begin, part in slices(texts_as_bytes(b.column("text"))):
                w = plan.words(part)
                for i, t in plan.hot_at(w, w.windows).items():
                    d = doc_ids[begin + w.doc[i]]
                    if d is not None and d < ids.get(t, 1 << 63):
                        ids[t] = d
        yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.binary()), pa.array(list(ids.values()), pa.int64())], ["text", "id"])

    rows = base.select("id", "text").mapInArrow(least_ids, "text binary, id long").groupBy("text").agg(F.min("id").alias("id")).collect()  # at most HOT_WINDOWS
    plan.hot_windows = {t: None for t in plan.hot_windows} | {bytes(r["text"]): r["id"] for r in rows}


def anchors(base: DataFrame, plan: Plan) -> DataFrame:
    """(id, key, at): anchors (by word number) which another document may have too."""
    width = np.uint64(plan.parts)

    @tidied
    def emit(batches: Batches):
        for b in batches:
            ids, keys, texts = b.column("id").to_pylist(), b.column("key").to_numpy(), texts_as_bytes(b.column("text"))
            hashes, rows, places = [], [], []
            for begin, part in slices(texts):
                w = plan.words(part)
                at = np.unique(w.anchor)
                keep = at[~np.isin(w.grams[at], plan.hot_prefixes)] if len(at) else at
                if len(keep):
                    hashes.append(w.grams[keep])
                    rows.append(w.doc[keep] + begin)
                    places.append(keep - w.first[w.doc[keep]])
            if not hashes:
                continue
            g, row, place = np.concatenate(hashes), np.concatenate(rows).astype(np.int32), np.concatenate(places).astype(np.int32)
            usable = np.array([i is not None for i in ids])[row]
            g, row, place = g[usable], row[usable], place[usable]
            ids = np.array([i or 0 for i in ids], np.int64)
            part = g % width
            order = np.lexsort((row, part))
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            out = []
            for chunk in np.split(order, cuts) if len(order) else ():
                used, index = np.unique(row[chunk], return_inverse=True)
                # five bytes of a hash are enough to drop most of what is not repeated
                short = ((g[chunk] // width) & np.uint64((1 << 40) - 1)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                out.append((int(part[chunk[0]]), pack((ids[used], keys[used], index.astype(np.uint32), place[chunk], short))))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["part", "data"])

    def repeated(chunks: pa.Table) -> pa.Table:
        ids, keys, rows, places, hashes, n = [], [], [], [], [], 0
        for c in chunks.column("data").to_pylist():
            i, k, row, place, short = unpack(c)
            wide = np.zeros((len(row), 8), np.uint8)
            wide[:, :5] = np.frombuffer(short, np.uint8).reshape(-1, 5)
            ids.append(i), keys.append(k), rows.append(row.astype(np.int64) + n), places.append(place), hashes.append(wide.view(np.uint64)[:, 0])
            n += len(i)
        ids, keys, rows, places, hashes = map(np.concatenate, (ids, keys, rows, places, hashes))
        order = np.argsort(hashes, kind="stable")
        rows, places, hashes = rows[order], places[order], hashes[order]
        cut = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        size = np.diff(np.r_[cut, len(hashes)])
        several = np.repeat(np.minimum.reduceat(ids[rows], cut) < np.maximum.reduceat(ids[rows], cut), size)
        rows, places = rows[several], places[several]
        order = np.argsort(rows, kind="stable")
        return per_document(ids, keys, rows[order], places[order], "at")

    packed = base.select("id", "key", "text").mapInArrow(emit, "part int, data binary")
    return packed.groupBy("part").applyInArrow(repeated, "id long, key long, at binary")


def per_document(ids: np.ndarray, keys: np.ndarray, rows: np.ndarray, values: np.ndarray, name: str) -> pa.Table:
    """One row for each run of equal rows: its id, key, and the values as packed int32."""
    if not len(rows):
        return pa.table({"id": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), name: pa.array([], pa.binary())})
    cut = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    bounds = (np.r_[cut, len(rows)] * 4).astype(np.int32)
    flat = values.astype("<i4").tobytes()
    held = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(flat)])
    return pa.table({"id": pa.array(ids[rows[cut]], pa.int64()), "key": pa.array(keys[rows[cut]], pa.int64()), name: held})


def repeats(candidates: DataFrame, plan: Plan) -> DataFrame:
    """(id, key, windows): first words of windows that start in a document with a smaller id, hot windows left out."""
    length = plan.window

    @tidied
    def emit(batches: Batches):
        for b in batches:
            ids, keys = b.column("id").to_pylist(), b.column("key").to_numpy()
            texts, wanted = texts_as_bytes(b.column("text")), b.column("at").to_pylist()
            rows, places, windows, parts, spans = [], [], [], [], []
            for begin, some in slices([t if ids[i] is not None else b"" for i, t in enumerate(texts)]):
                w = plan.words(some)
                if not len(w.windows):
                    continue
                listed = np.zeros(len(w.starts), bool)
                for d in range(len(some)):
                    for x in wanted[begin + d] or ():
                        listed[np.frombuffer(x, "<i4") + w.first[d]] = True
                hot = np.isin(w.grams[w.anchor], plan.hot_prefixes)
                left = listed[w.anchor] | hot
                skip = plan.hot_at(w, w.windows[left])
                left &= ~np.isin(w.windows, np.fromiter(skip, np.int64, len(skip)))
                at, anchor, hot = w.windows[left], w.anchor[left], hot[left]
                if not len(at):
                    continue
                new = np.r_[True, (np.diff(at) != 1) | (np.diff(anchor) != 0)] | hot
                cut = np.flatnonzero(new)
                first, count = at[cut], np.diff(np.r_[cut, len(at)])
                key = mix(w.grams[anchor[cut]])
                key[hot[cut]] = plan.extended(w, first[hot[cut]])
                rows.append(w.doc[first] + begin), places.append(first - w.first[w.doc[first]]), windows.append(count), parts.append(key % np.uint64(plan.parts))
                spans += [w.buffer[i:j] for i, j in zip(w.starts[first].tolist(), w.ends[first + count + length - 2].tolist())]
            if not rows:
                continue
            row, place, count, part = np.concatenate(rows), np.concatenate(places).astype(np.int32), np.concatenate(windows).astype(np.uint8 if length - plan.prefix < 255 else np.int32), np.concatenate(parts)
            order = np.lexsort((row, part))
            out, known = [], np.array([i or 0 for i in ids], np.int64)
            for chunk in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                used, index = np.unique(row[chunk], return_inverse=True)
                out.append((int(part[chunk[0]]), pack((known[used], keys[used], index.astype(np.uint32), place[chunk], count[chunk], b"\n".join(b" ".join(spans[i].split()) for i in chunk.tolist())))))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["part", "data"])

    def tree(chunks: pa.Table) -> pa.Table:
        ids, keys, rows, places, counts, sizes, n = [], [], [], [], [], [], 0
        numbers: dict[bytes, int] = {}
        leaves = []
        for c in chunks.column("data").to_pylist():
            i, k, row, place, count, text = unpack(c)
            ids.append(i), keys.append(k), rows.append(row.astype(np.int64) + n), places.append(place), counts.append(count.astype(np.int64))
            sizes.append(counts[-1] + length - 1)
            n += len(i)
            words = text.split()
            leaves.append(np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words)))
        ids, keys, rows, places, counts, sizes, leaves = map(np.concatenate, (ids, keys, rows, places, counts, sizes, leaves))
        begin = np.cumsum(sizes) - sizes
        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        subtree = Subtree(leaves, sizes, np.repeat(begin, counts) + nth)
        row, place = np.repeat(rows, counts)[subtree.order], (np.repeat(places, counts) + nth)[subtree.order]
        flagged = ids[row] > subtree.least_above(ids[row], length)
        row, place = row[flagged], place[flagged]
        order = np.lexsort((place, row))
        return per_document(ids, keys, row[order], place[order], "windows")

    packed = candidates.mapInArrow(emit, "part int, data binary")
    return packed.groupBy("part").applyInArrow(tree, "id long, key long, windows binary")


class Subtree:
    """The suffix tree of suffixes that end with their spans: their sorted order, and how many words neighbours share.

    words: numbers, of spans of the given sizes one after another; first: where the suffixes begin.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> None:
        stop = np.repeat(np.cumsum(sizes), sizes)
        place, rank, reach = np.arange(len(words)), np.asarray(words, np.int64) + 1, 1
        ranks = [rank.astype(np.int32)]  # by the next 1, 2, 4, ... words; an end is less than any word
        while reach < sizes.max():
            right = np.zeros_like(rank)
            right[:-reach] = rank[reach:]
            right[place + reach >= stop] = 0
            rank = np.unique(rank * (int(rank.max()) + 1) + right, return_inverse=True)[1] + 1
            ranks.append(rank.astype(np.int32))
            reach *= 2
        self.order = np.argsort(rank[first], kind="stable")
        at = np.asarray(first)[self.order]
        a, b, most = at[:-1], at[1:], np.minimum((stop[at] - at)[:-1], (stop[at] - at)[1:])
        shared = np.zeros(len(most), np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            live = np.flatnonzero(shared < most)
            equal = ranks[k][a[live] + shared[live]] == ranks[k][b[live] + shared[live]]
            shared[live[equal]] += 1 << k
            np.minimum(shared, most, out=shared)
        self.shared = np.r_[0, shared]  # of each suffix with the one before it

    def deep_nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The inner nodes at `depth` words or deeper: first and last + 1 of their suffixes in order, and depth; parents first."""
        found = [(np.zeros(0, np.int64),) * 3]
        for d in range(depth, int(self.shared.max(initial=0)) + 1):
            cut = np.flatnonzero(np.r_[True, self.shared[1:] < d])
            size = np.diff(np.r_[cut, len(self.shared)])
            lowest = np.minimum.reduceat(np.where(self.shared < d, np.iinfo(np.int64).max, self.shared), cut)
            own = (size > 1) & (lowest == d)
            found.append((cut[own], (cut + size)[own], np.full(own.sum(), d)))
        left, right, deep = map(np.concatenate, zip(*found))
        order = np.lexsort((-right, left))
        return left[order], right[order], deep[order]

    def least_above(self, values: np.ndarray, depth: int) -> np.ndarray:
        """For each suffix in order the least of the values below its shallowest deep node; its own where it has none."""
        left, right, _ = self.deep_nodes(depth)
        least = values.copy()
        if len(left):
            top = np.r_[True, left[1:] >= np.maximum.accumulate(right)[:-1]]
            left, right = left[top], right[top]
            low = np.minimum.reduceat(np.r_[values, values[-1]], np.stack([left, right], axis=1).ravel())[::2]
            size = right - left
            least[np.arange(size.sum()) + np.repeat(left - np.cumsum(size) + size, size)] = np.repeat(low, size)
        return least


def dedup(docs: DataFrame, window: int = 13, prefix: int = 5, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, sample_docs: int = 3000, hot_share: float = 0.005) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text (the kept words joined by one space), kept_sha256.

    Words are runs of other than ASCII white space. Windows are judged on the input. A null text has no words; a row
    with a null id is never removed from and never a reason to remove. Rows with the same id don't affect each other, repeated rows get equal results.
    Other columns are not read. An empty table gives no rows. sample_docs and hot_share only decide how frequent
    prefixes and windows are dealt.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("key", F.xxhash64("id", "text"))
    size = base.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    plan = Plan(window, prefix, parts or max(4 * shuffle_partitions(spark), -(-size["bytes"] // GROUP_BYTES)))
    plan_hot(base, plan, size["rows"], sample_docs, hot_share)
    dealt = base.repartition(shuffle_partitions(spark), "id", "key")  # used twice, shuffled once
    places = anchors(base, plan).groupBy("id", "key").agg(F.collect_list("at").alias("at"))
    flagged = repeats(dealt.join(places, ["id", "key"], "left"), plan).groupBy("id", "key").agg(F.collect_list("windows").alias("windows"))

    @tidied
    def apply(batches: Batches):
        for b in batches:
            ids, texts, windows = b.column("id").to_pylist(), texts_as_bytes(b.column("text")), b.column("windows").to_pylist()
            out = []
            for begin, part in slices(texts):
                w = plan.words(part) if plan.hot_windows else None
                hot: dict[int, list[int]] = {}
                for i, t in (plan.hot_at(w, w.windows) if w else {}).items():
                    d, least = int(w.doc[i]), plan.hot_windows[t]
                    if ids[begin + d] is not None and least is not None and ids[begin + d] > least:
                        hot.setdefault(d, []).append(i - int(w.first[d]))
                for d, text in enumerate(part):
                    words = text.split()
                    starts = [np.frombuffer(x, "<i4") for x in windows[begin + d] or ()] + ([np.array(hot[d], np.int32)] if d in hot else [])
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s in starts:
                        np.add.at(gone, s, 1)
                        np.add.at(gone, s + window, -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    kept = b" ".join(x for x, g in zip(words, gone.tolist()) if not g) if starts else b" ".join(words)
                    out.append((len(words), int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], ["id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    result = dealt.join(flagged, ["id", "key"], "left").mapInArrow(apply, "id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return result.withColumnRenamed("id", id_col)
