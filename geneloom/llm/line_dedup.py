"""Near-duplicate lines by an exact set-similarity join; later matches are removed.

A line is the set of its words. Its tokens are ordered by rarity, and only its prefix, as many of the rarest tokens as a
similar line must share one of, is dealt by token. Lines that share a prefix token are candidates if their sizes
(length filter), the tokens left behind the shared one (positional filter) and the tokens in which they differ at least
(the popcount of the XOR of their parity bitmaps) allow the wanted similarity. Candidates are confirmed on full sets. Lines of equal sets form a class, joined as one; a line goes if an earlier line is similar.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, materialise, prepare, shuffle_partitions, tidied
from .near_dedup import BROADCAST_IDS, confirm
from .substring_dedup import Words, mix, pack, slices, unpack

#: Tokens are counted in so many buckets; the order by (bucket's count, token hash) is the same for all lines.
BUCKETS = 1 << 17
#: Bitmaps have 64 bits; those of sets of so many words or more have 128, of which the first fold to 64.
WIDE_FROM = 56
#: Candidate pairs of a very frequent token are made in pieces of so many.
PAIRS_AT_ONCE = 1 << 20
PAIRS_A_BATCH = 100_000

#: Prefixes are packed by token for so many lines at once.
LINES_AT_ONCE = 100_000
#: A group has about so many prefix entries (some 40 bytes each), and a frequent token's sets come in blocks of so many.
GROUP_ENTRIES, BLOCK_ENTRIES = 400_000, 50_000


def gathered(batches: Batches, rows: int):
    """Batches put together to tables of about `rows` rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def lower_bytes(column: pa.Array) -> list[bytes]:
    return [(x.as_py() or "").lower().encode() for x in column]  # one text at a time as str


class Lines:
    """Distinct tokens of the lines of some texts, by line and, in a line, from the rarest on.

    The order is that of (bucket's count on a logarithmic scale, hash), the same for every line of the corpus.
    """

    def __init__(self, texts: list[bytes], rarity: np.ndarray) -> None:
        w = Words(texts)
        breaks = np.flatnonzero(np.frombuffer(w.buffer, np.uint8) == 10)
        line = np.searchsorted(breaks, w.starts)
        self.first_line = np.r_[0, np.cumsum([t.count(b"\n") + 1 for t in texts])]  # of each text
        rank = rarity[(w.hashes & np.uint64(BUCKETS - 1)).astype(np.int64)] if len(line) else line
        key = line.astype(np.uint64) << np.uint64(44) | rank.astype(np.uint64) << np.uint64(36) | w.hashes.astype(np.uint64) >> np.uint64(28)
        order = np.argsort(key)
        token, line, key = w.hashes[order], line[order], key[order]
        new = np.r_[True, (token[1:] != token[:-1]) | (line[1:] != line[:-1])] if len(order) else np.zeros(0, bool)
        if len(order) and (len(breaks) >= 1 << 20 or (new[1:] & (key[1:] == key[:-1])).any()):  # the short key doesn't tell all apart
            order = np.lexsort((token, rank[order], line))
            token, line = token[order], line[order]
            new = np.r_[True, (token[1:] != token[:-1]) | (line[1:] != line[:-1])]
        self.token, self.line = token[new], line[new]


def packed_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of tokens of each row, all tokens) of a binary column of packed tokens without nulls."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.diff(at) // 8, np.frombuffer(data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes(), "<u8")


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    """Of two sets as similar as wanted, each has a token of the other among so many of its rarest."""
    return n - -(-percent * n // 100) + 1


def by_bucket(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterable[np.ndarray]]) -> np.ndarray:
    """Numbers of hashes by bucket over all of df: at most BUCKETS rows come back."""

    @tidied
    def run(batches: Batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for h in hashes(b):
                total += np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    rows = df.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def token_counts(docs: DataFrame) -> np.ndarray:
    """Tokens of the whole corpus by bucket."""
    return by_bucket(docs.select("text"), lambda b: (Words(part).hashes.astype(np.uint64) for _, part in slices(lower_bytes(b.column(0)))))


class Deal:
    """How prefixes are dealt to groups: how many groups there are, and into how many blocks the sets of a frequent token are cut.

    Both follow from counts over all prefixes, so that a group has about GROUP_ENTRIES entries whatever the size of the
    corpus. Of a token with g blocks every set goes to the g groups of pairs of blocks that have its own, so that each two
    sets meet.
    """

    def __init__(self, lines: DataFrame) -> None:
        load = by_bucket(lines.where("prefix IS NOT NULL").select("prefix"), lambda b: [packed_tokens(b.column(0))[1]])
        usual = 4 * int(load.sum()) // BUCKETS
        self.blocks = np.maximum(1, -(-(load - usual) // BLOCK_ENTRIES))
        self.groups = max(shuffle_partitions(lines.sparkSession), -(-int((load * self.blocks).sum()) // GROUP_ENTRIES))

    def split(self, flat: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token or one that stands for it and a pair of blocks, index) of each copy of the entries; own: a number of the entry's set."""
        g = self.blocks[(flat & np.uint64(BUCKETS - 1)).astype(np.int64)]
        if not len(g) or g.max() == 1:
            return flat, np.arange(len(flat))
        at = np.repeat(np.arange(len(flat)), g)
        other = np.arange(len(at)) - np.repeat(np.cumsum(g) - g, g)
        block = own[at] % g[at]
        pair = (np.minimum(block, other) * g[at] + np.maximum(block, other)).astype(np.uint64)
        return np.where(g[at] > 1, mix(flat[at] ^ mix(pair + np.uint64(1))), flat[at]), at


def rarities(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of 0 to 255, eight steps for a doubling up to 2**24 and coarser beyond."""
    return np.minimum(255, np.where(counts < 1 << 24, 8 * np.log2(counts + 1), 192 + np.log2(counts + 1) - 24)).astype(np.uint8)


def lines_of(docs: DataFrame, rarity: np.ndarray, percent: int, least: int) -> DataFrame:
    """(k1, k2, bits, wide, n, id, key, line, again, prefix) per line of at least `least` distinct words.

    k1 and k2 are two hashes of the word set, bits its parity bitmap and wide the upper half of the unfolded one; again
    tells that the document has an earlier line with the set; the prefix (packed uint64, rarest first) is only
    given for a set's first line in a batch.
    """

    @tidied
    def run(batches: Batches):
        for b in batches:
            ids, keys = b.column("id").to_numpy(), b.column("key").to_numpy()
            seen = np.zeros(0, np.uint64)  # sets of this batch, by their two hashes made one
            for begin, part in slices(lower_bytes(b.column("text"))):
                x = Lines(part, rarity)
                if not len(x.line):
                    continue
                cut = np.flatnonzero(np.r_[True, x.line[1:] != x.line[:-1]])
                n = np.diff(np.r_[cut, len(x.line)])
                k1, k2 = (np.add.reduceat(v, cut) for v in (x.token * x.token, x.token))  # tokens are well mixed hashes
                bit = np.uint64(1) << (x.token >> np.uint64(57) & np.uint64(63))
                bits, wide = (np.bitwise_xor.reduceat(v, cut).view(np.int64) for v in (bit, np.where(x.token >> np.uint64(63), bit, np.uint64(0))))
                wide = np.where(n >= WIDE_FROM, wide, 0)
                line, long = x.line[cut], np.flatnonzero(n >= least)
                cut, n, k1, k2, bits, wide, line = (v[long] for v in (cut, n, k1, k2, bits, wide, line))
                doc = np.searchsorted(x.first_line, line, side="right") - 1
                either = k1 ^ mix(k2)
                order = np.lexsort((k2, k1))  # stable, so that copies stay in their order
                same = (k1[order[1:]] == k1[order[:-1]]) & (k2[order[1:]] == k2[order[:-1]])
                again, first = np.zeros(len(doc), bool), np.ones(len(doc), bool)
                first[order[1:]] = ~same
                again[order[1:]] = same & (doc[order[1:]] == doc[order[:-1]])
                first &= ~np.isin(either, seen)
                seen = np.r_[seen, either[first]]
                size = np.where(first, prefix_sizes(n, percent), 0)
                offsets = np.r_[0, np.cumsum(size)]
                tokens = x.token[np.repeat(cut - offsets[:-1], size) + np.arange(offsets[-1])]
                prefixes = pa.Array.from_buffers(pa.binary(), len(n), [pa.py_buffer(np.packbits(first, bitorder="little")), pa.py_buffer((8 * offsets).astype(np.int32)), pa.py_buffer(tokens.astype("<u8"))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(bits), pa.array(wide), pa.array(n), pa.array(ids[doc + begin]), pa.array(keys[doc + begin]), pa.array((line - x.first_line[doc]).astype(np.int32)), pa.array(again), prefixes],
                    ["k1", "k2", "bits", "wide", "n", "id", "key", "line", "again", "prefix"],
                )

    return docs.where("id IS NOT NULL").mapInArrow(run, "k1 long, k2 long, bits long, wide long, n long, id long, key long, line int, again boolean, prefix binary")


def candidates(lines: DataFrame, percent: int, deal: Deal, tokens: np.ndarray | None = None, every: bool = False) -> DataFrame:
    """(xb, xk, yb, yk, apart, more): earlier and later set, by bitmap and the low half of k1, of pairs that pass all filters.

    For each token only a later set's most promising earlier one is given (the fewest differing bits, `apart`, then the
    earliest); `more` tells that there are others. With `every`, lines have a column asks and all earlier sets of those
    that ask are given. tokens: only these are dealt. A pair may come several times.
    """
    parts = deal.groups

    @tidied
    def emit(batches: Batches):
        for b in gathered(batches, LINES_AT_ONCE):
            sizes, flat = packed_tokens(b.column("prefix").chunk(0))
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            if tokens is not None:
                held = np.isin(flat, tokens)
                flat, row, place = flat[held], row[held], place[held]
            bits, n, k = b.column("bits").to_numpy(), b.column("n").to_numpy().astype(np.int32), b.column("k").to_numpy().astype(np.int32)
            wide = b.column("wide").to_numpy()
            flat, held = deal.split(flat, k[row].astype(np.int64))
            row, place = row[held], place[held]
            ids, line, asks = (b.column(c).to_numpy() for c in ("id", "line", "asks"))
            part = flat % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            out = []
            for chunk in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
                short = (flat[chunk] // np.uint64(parts)).astype(np.uint32)  # pairs are confirmed, so half of a hash is enough
                r = row[chunk]
                out.append((int(part[chunk[0]]), pack((short, bits[r], k[r], n[r], place[chunk], np.diff(ids[r], prepend=0), line[r], asks[r], wide[r][n[r] >= WIDE_FROM]), 1)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["part", "data"])

    def join(batches: Batches) -> Batches:
        held = [unpack(x.as_py()) for b in batches for x in b.column("data")]
        token, bits, k, n, place, ids, line, asks, some = (np.concatenate([np.cumsum(x[i]) if i == 5 else x[i] for x in held]) for i in range(9))
        wide = np.zeros(len(n), np.int64)
        wide[n >= WIDE_FROM] = some
        when = np.empty(len(n), np.int64)
        small = ids.min() >= 0 and ids.max() < 1 << 40 and line.max() < 1 << 23
        order = np.argsort(ids << 23 | line) if small else np.lexsort((line, ids))
        when[order] = np.cumsum(np.r_[0, (np.diff(ids[order]) != 0) | (np.diff(line[order]) != 0)])
        order = np.lexsort((bits, token.astype(np.uint64) << np.uint64(32) | n.astype(np.uint64)))
        token, bits, k, n, place, when, asks, wide = (x[order] for x in (token, bits, k, n.astype(np.int64), place.astype(np.int64), when, asks, wide))
        # A set's copies from other batches go, its first place stays. Copies that another set with the same bits parts stay, and do no harm.
        new = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (bits[1:] != bits[:-1]) | (k[1:] != k[:-1]) | (n[1:] != n[:-1])])
        when = np.minimum.reduceat(when, new)
        token, bits, k, n, place, asks, wide = (x[new] for x in (token, bits, k, n, place, asks, wide))
        index = n - -(-2 * percent * n // (100 + percent)) + 1  # of the smaller set fewer tokens are enough
        # Rows are sorted by token and size: each is held against those after it with the same token and fitting sizes.
        here = np.arange(len(n))
        group = np.cumsum(np.r_[True, token[1:] != token[:-1]]).astype(np.int64)
        span = 2 * n.max() + 2
        limit = np.searchsorted(group * span + n, group * span + np.minimum(n * 100 // percent, span - 1), side="right")
        count = np.maximum(0, limit - here - 1)
        total, begin = np.cumsum(count), 0
        while begin < len(count):
            stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS_AT_ONCE, side="right")))
            m = count[begin:stop]
            x = np.repeat(here[begin:stop], m)
            y = x + 1 + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            both = n[x] + n[y]
            need = -(-percent * both // (100 + percent))
            fits = (place[x] < index[x]) & (np.minimum(n[x] - place[x], n[y] - place[y]) >= need)  # the shared token and those behind it
            x, y, room = x[fits], y[fits], (both - 2 * need)[fits]
            high, folded = wide[x] ^ wide[y], bits[x] ^ bits[y]
            split = np.minimum(n[x], n[y]) >= WIDE_FROM
            apart = np.bitwise_count(np.where(split, folded ^ high, folded).view(np.uint64)).astype(np.int64) + np.where(split, np.bitwise_count(high.view(np.uint64)), 0)
            fits = apart <= room
            x, y, apart = x[fits], y[fits], apart[fits]
            tied = when[x] == when[y]  # the order of rows with one id is only known later on
            x, y, apart = np.r_[np.where(when[x] <= when[y], x, y), y[tied]], np.r_[np.where(when[x] <= when[y], y, x), x[tied]], np.r_[apart, apart[tied]]
            if every:
                x, y, apart = x[asks[y]], y[asks[y]], apart[asks[y]]
                more = np.zeros(len(x), bool)
            else:
                order = np.lexsort((when[x], apart, y))
                x, y, apart = x[order], y[order], apart[order]
                first = np.r_[True, y[1:] != y[:-1]] if len(y) else np.zeros(0, bool)
                more = np.diff(np.r_[np.flatnonzero(first), len(y)]) > 1
                x, y, apart = x[first], y[first], apart[first]
            pairs = np.unique(np.stack([bits[x], k[x], bits[y], k[y], apart, more], 1), axis=0)
            for i in range(0, len(pairs), PAIRS_A_BATCH):
                part = pairs[i : i + PAIRS_A_BATCH]
                yield pa.RecordBatch.from_arrays([*(pa.array(part[:, i]) for i in range(5)), pa.array(part[:, 5] > 0)], ["xb", "xk", "yb", "yk", "apart", "more"])
            begin = stop

    packed = lines.where("prefix IS NOT NULL").select("k", "bits", "wide", "n", "id", "line", "asks", "prefix").mapInArrow(emit, "part int, data binary")
    return packed.groupBy("part").applyInArrow(join, "xb long, xk long, yb long, yk long, apart long, more boolean")


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if it has at most so many rows; it is a written table, so that counting is cheap."""
    return F.broadcast(df) if df.count() <= rows else df


def token_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles): the token sets of the wanted lines (class, id, key, line), under their class."""
    places = wanted.groupBy("id", "key").agg(F.collect_list(F.struct("line", "class")).alias("wanted"))
    if wanted.count() <= BROADCAST_IDS:
        places = F.broadcast(places)

    @tidied
    def run(batches: Batches):
        for b in batches:
            names, lines = [], []
            for t, some in zip(lower_bytes(b.column("text")), b.column("wanted").to_pylist()):
                own = t.split(b"\n")
                for x in some:
                    names.append(x["class"])
                    lines.append(own[x["line"]])
            sets = []
            for _, part in slices(lines):
                w = Words(part)
                bounds = [*w.first.tolist(), len(w.starts)]
                sets += [np.unique(w.hashes[i:j]).astype("<u8").tobytes() for i, j in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["id", "shingles"])

    # By id first: the key, a hash of the whole text, is then computed for the documents met only.
    met = docs.select("id", "text").join(places.withColumnRenamed("key", "wanted key"), "id").where(F.xxhash64("text") == F.col("wanted key"))
    return met.select("text", "wanted").mapInArrow(run, "id long, shingles binary")


#: Where the prefixes of the sets that are left to be searched again take so many bytes at most, only their tokens are dealt once more.
TOKEN_BYTES = 16 << 20
#: Hashes don't repeat, so that dictionaries of them only take memory and time.
PLAIN = {"parquet.enable.dictionary": "false"}
#: Tables of so many class rows at most (some 50 bytes each) are broadcast, larger ones are dealt.
BROADCAST_CLASSES = 300_000


def similar_later(docs: DataFrame, lines: DataFrame, pairs: DataFrame, percent: int, name: str) -> DataFrame:
    """(k1, k2, bits, k) of later sets which a confirmed pair shows to be similar to an earlier one."""
    named = materialise(pairs.select(F.col("xb").alias("bits"), F.col("xk").alias("k")).union(pairs.select("yb", "yk")).distinct(), f"{name}-named")
    known = lines.where("NOT again").join(sized(named, BROADCAST_CLASSES), ["bits", "k"], "left_semi").groupBy("bits", "k", "k1", "k2").agg(F.min(F.struct("id", "line", "key")).alias("first"))
    known = materialise(known.withColumn("class", F.monotonically_increasing_id()), f"{name}-classes")
    sets = materialise(token_sets(docs, known.select("class", "first.*")), f"{name}-sets")
    one = known.select(F.col("bits").alias("xb"), F.col("k").alias("xk"), F.col("class").alias("a"), F.col("first").alias("first_a"))
    two = known.select(F.col("bits").alias("yb"), F.col("k").alias("yk"), F.col("class").alias("b"), F.col("first").alias("first_b"))
    spread = pairs.join(one, ["xb", "xk"]).join(two, ["yb", "yk"]).where("a <> b AND first_a < first_b").select("a", "b")
    later = confirm(spread, sets, percent).select(F.col("b").alias("class")).distinct()
    return materialise(known.join(later, "class").select("k1", "k2", "bits", "k"), f"{name}-later")


def removals(docs: DataFrame, percent: int, least: int) -> DataFrame:
    """(id, key, gone): the numbers of the lines to remove, of documents (id, key, text) that have any."""
    lines = materialise(lines_of(docs, rarities(token_counts(docs)), percent, least), "lines", **PLAIN).withColumn("k", F.col("k1").bitwiseAND(0x7FFFFFFF)).withColumn("asks", F.lit(False))
    deal = Deal(lines)
    # Of each later set the most promising pair is tried first.
    tried = F.min_by(F.struct("xb", "xk"), F.struct("apart", "xb", "xk"))
    best = candidates(lines, percent, deal).groupBy("yb", "yk").agg(tried.alias("x"), (F.max("more") | (F.min(F.struct("xb", "xk")) < F.max(F.struct("xb", "xk")))).alias("more"))
    pairs = materialise(best.select("x.*", "yb", "yk", "more"), "line-pairs")
    later = similar_later(docs, lines, pairs, percent, "line")
    # Sets with untried earlier ones, whose tried one was not similar, are held against all.
    left = pairs.where("more").select(F.col("yb").alias("bits"), F.col("yk").alias("k"))
    left = materialise(left.join(later, ["bits", "k"], "left_anti"), "lines-left")
    if not left.isEmpty():
        asking = sized(left, BROADCAST_CLASSES).withColumn("asks", F.lit(True))
        again = lines.drop("asks").join(asking, ["bits", "k"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
        wanted = materialise(again.where("asks AND prefix IS NOT NULL").select("prefix").distinct(), "lines-asking")
        tokens = None
        if (wanted.agg(F.sum(F.length("prefix"))).first()[0] or 0) <= TOKEN_BYTES:
            tokens = np.unique(np.frombuffer(b"".join(wanted.toArrow().column("prefix").to_pylist()), "<u8"))
        rest = candidates(again, percent, deal, tokens, every=True).select("xb", "xk", "yb", "yk").distinct()
        later = later.union(similar_later(docs, lines, materialise(rest.join(pairs, ["xb", "xk", "yb", "yk"], "left_anti"), "line-pairs-left"), percent, "line-left"))
    # A line goes if its set is a later one, or if it isn't the first line with its set: in its document or in the corpus.
    classes = lines.groupBy("k1", "k2").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("size"))
    gone_classes = later.select("k1", "k2").distinct().withColumn("later", F.lit(True))
    touched = materialise(classes.join(gone_classes, ["k1", "k2"], "left").where("size > 1 OR later").select("k1", "k2", "first_id", F.coalesce("later", F.lit(False)).alias("later")), "classes-touched")
    gone = lines.select("k1", "k2", "id", "key", "line", "again").join(sized(touched, BROADCAST_CLASSES), ["k1", "k2"]).where("later OR again OR id > first_id")
    return gone.groupBy("id", "key").agg(F.collect_list("line").alias("gone"))


def dedup(docs: DataFrame, percent: int = 80, least: int = 1, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("n_lines", "removed")) -> DataFrame:
    """All columns of docs, with text_col replaced by the kept lines, and n_lines, removed (sorted line numbers), called by `names`.

    Lines are cut at \\n. A line of at least `least` distinct words (lower-cased, parts between ASCII white space) is
    removed if an earlier line of the corpus, in order of id and line number, has a set of words with
    100 * intersection >= percent * union, whether that earlier line stays or not; equal sets in rows of one id are only
    compared within their row. Lines of fewer words are never removed and remove nothing, nor are lines without a word.
    n_lines counts lines with a word. A null text stays null and has no lines. Rows with a null id are
    kept as they are and remove nothing. Repeated rows are one document: what goes from one goes from all. Existing columns
    of these names are replaced. An empty table gives no rows. Words stand as 64-bit hashes and sets of words as the
    sums of these and of their squares: among n distinct words or sets two are taken for one with a probability of about
    n**2 / 2**65 (for 10**9 words 0.03). A worker holds a text and some 12 bytes for each of its bytes at a time.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(*names)
    keyed = docs.select("*", F.col(id_col).cast("long").alias("line dedup id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("line dedup key"))
    plain = keyed.select(F.col("line dedup id").alias("id"), F.col("line dedup key").alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    gone = removals(plain, percent, least)
    joined = keyed.join(gone, (keyed["line dedup id"] == gone["id"]) & (keyed["line dedup key"] == gone["key"]), "left")
    # Only texts that lose a line are cut, and once, as the lines are a column of their own.
    lost = gone["gone"]
    joined = joined.select(*(keyed[c] for c in docs.columns), F.when(lost.isNotNull(), F.split(F.col(text_col).cast("string"), "\n", -1)).alias("line dedup parts"), lost.alias("line dedup gone"))
    parts, lost = F.col("line dedup parts"), F.col("line dedup gone")
    staying = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), lost)
    text = F.col(text_col).cast("string")
    kept = F.when(lost.isNull(), text).otherwise(F.array_join(F.transform(staying, lambda i: F.get(parts, i)), "\n"))
    worded = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D][^\n]*"))
    return joined.select(*(kept.alias(c) if c == text_col else F.col(c) for c in docs.columns), worded.cast("long").alias(names[0]), F.sort_array(F.coalesce(lost, F.array().cast("array<int>"))).alias(names[1]))
