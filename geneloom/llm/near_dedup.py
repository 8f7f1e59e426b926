"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

Documents are sets of two-word shingles. Equal sets form one class. Each class has HASHES MinHash samples: runs of ROWS
of them are its bands, and all of them, folded into a parity bitmap, its odd sketch: the popcount of the XOR of
two sketches estimates their similarity, most precisely where it is high. Classes that share a band are candidates:

1. In each bucket every class is held against the least one. Pairs whose sketches rule out the wanted similarity
   (by more than five standard errors) are dropped, the rest are confirmed on the full sets; the links' components
   are found.
2. Buckets that still hold several components are searched again, in rounds: each class outside the bucket's largest
   component is held against the one of another component with the most similar sketch, until a round finds no link;
   then against all of other components, by sketch and, where that allows it, by full set, in a kernel that returns at most
   the links that join components. Large buckets are cut into blocks of BLOCK classes.

A pair at the threshold shares no band with a probability of 6e-6, and a more similar one with less.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import Batches, materialise, prepare, tidied
from .substring_dedup import Words, mix, slices, texts_as_bytes

HASHES, ROWS, SKETCH_BITS = 240, 6, 512
BLOCK = 1_000
#: Sets of so many classes at most are fetched by a broadcast of their ids (8 bytes each).
BROADCAST_IDS = 1_000_000
_seed = np.random.default_rng(20240501)
MULTIPLY = _seed.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
FLIP = _seed.integers(0, 1 << 32, HASHES, dtype=np.uint32)
BAND = _seed.integers(0, 1 << 63, (HASHES // ROWS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def most_bits(least: float) -> int:
    """The largest popcount of a sketch XOR which an estimate of at least `least` has."""
    return math.floor(SKETCH_BITS / 2 * (1 - math.exp(-4 * HASHES * (1 - least) / SKETCH_BITS)))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased); shorter texts are one shingle, empty ones none."""
    out = []
    for _, part in slices([t.lower() for t in texts]):
        w = Words(part)
        runs = w.runs(words) if len(w.starts) else w.hashes
        bounds = [*w.first.tolist(), len(w.starts)]
        for a, b in zip(bounds, bounds[1:]):
            if b - a >= words:
                out.append(np.unique(runs[a : b - words + 1]))
            elif b > a:
                h = np.full(1, b - a, np.uint64)
                for i in range(a, b):
                    h = mix(h * np.uint64(31) + w.hashes[i : i + 1])
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES samples of a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 4096):
        part = x[i : i + 4096, None]
        for j in range(0, HASHES, 40):
            out[j : j + 40] = np.minimum(out[j : j + 40], ((part ^ FLIP[j : j + 40]) * MULTIPLY[j : j + 40]).min(0))
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the (number, sample) pairs, as int64 words."""
    at = mix(samples.astype(np.uint64) << np.uint64(16) | np.arange(HASHES, dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    odd = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def band_hashes(samples: np.ndarray) -> np.ndarray:
    bands = (samples.reshape(-1, ROWS).astype(np.uint64) * BAND).sum(1, dtype=np.uint64)
    return mix(bands + np.arange(len(bands), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def sums_of(shingles: np.ndarray) -> list[int]:
    """Two sums of differently mixed hashes, which stand for the set."""
    return [int(mix(shingles ^ np.uint64(c)).sum(dtype=np.uint64).astype(np.int64)) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]


def features(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, f1, f2, bands, sketch) per row with an id; the sums f1 and f2 stand for the set."""

    @tidied
    def run(batches: Batches):
        for b in batches:
            rows = []
            for s in shingle_sets(texts_as_bytes(b.column("text")), words):
                if not len(s):
                    rows.append((0, 0, 0, None, None))
                    continue
                m = minhash(s)
                rows.append((len(s), *sums_of(s), band_hashes(m), odd_sketch(m)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["id", "n", "f1", "f2", "bands", "sketch"])

    return docs.mapInArrow(run, "id long, n long, f1 long, f2 long, bands array<long>, sketch array<long>")


def class_of() -> Column:
    """The number of a row's class: all rows with its set."""
    return F.xxhash64("f1", "f2", "n").alias("class")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the wanted classes (class, first), by a document `first` that has the class's set; packed uint64.

    id is the class. Rows of one id may have other sets; these are left out.
    """
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    @tidied
    def run(batches: Batches):
        for b in batches:
            sets = shingle_sets(texts_as_bytes(b.column("text")), words)
            sums = [sums_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("class"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([x[i] for x in sums], pa.int64()) for i in (0, 1)), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                ["id", "n", "f1", "f2", "shingles"],
            )

    met = docs.join(wanted, docs["id"] == wanted["first"]).select("class", "text")
    found = met.mapInArrow(run, "id long, n long, f1 long, f2 long, shingles binary")
    return found.where(F.col("id") == class_of()).select("id", "shingles").dropDuplicates(["id"])


def shared(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with each of many."""
    flat = np.concatenate(many)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    hit = (one[at] == flat).astype(np.int64)
    ends = np.cumsum([len(x) for x in many])
    return np.diff(np.r_[0, np.r_[0, np.cumsum(hit)][ends]])


def similar(one: np.ndarray, many: list[np.ndarray], percent: int) -> np.ndarray:
    both = shared(one, many)
    union = len(one) + np.array([len(x) for x in many]) - both
    return 100 * both >= percent * union


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, kind: str = "long") -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar. Sets are dealt once per pair of blocks of ids, not per pair."""
    blocks = max(4, math.ceil(sets.count() / 1_000))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    dealt = pairs.select("a", "b", block("a").alias("p"), block("b").alias("q"))
    wanted = dealt.select("p", "q", F.col("a").alias("id")).union(dealt.select("p", "q", F.col("b").alias("id"))).distinct()

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        found = dict(zip(right.column("id").to_pylist(), (np.frombuffer(x, "<u8") for x in right.column("shingles").to_pylist())))
        by: dict[int, list[int]] = {}
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            by.setdefault(a, []).append(b)
        out = []
        for a, bs in by.items():
            for i in range(0, len(bs), 500):
                part = bs[i : i + 500]
                out += [(a, b) for b, yes in zip(part, similar(found[a], [found[b] for b in part], percent)) if yes]
        name = pa.int64() if kind == "long" else pa.string()
        return pa.table({"a": pa.array([x for x, _ in out], name), "b": pa.array([x for _, x in out], name)})

    needed = wanted.join(sets, "id").select(F.col("p").alias("p2"), F.col("q").alias("q2"), "id", "shingles")
    return dealt.groupBy("p", "q").cogroup(needed.groupBy("p2", "q2")).applyInArrow(check, f"a {kind}, b {kind}")


def open_buckets(bands: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """(bucket, id, component, n, sketch, main, blocks) of the classes of buckets with several components; main is the largest."""
    own = bands.join(labels.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    sizes = own.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    several = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("components")).where("components > 1")
    return own.join(several.select("bucket", "main", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "bucket").join(sketches, "id")


class Members:
    """The classes of a block of a bucket, as arrays."""

    def __init__(self, rows: pa.Table, percent: int, bits: int) -> None:
        self.percent, self.bits = percent, bits
        self.ids, self.comps, self.n, self.asks = (rows.column(c).to_numpy() for c in ("id", "component", "n", "asks"))
        self.sketch = self.matrix(rows, "sketch").view(np.uint64)

    @staticmethod
    def matrix(rows: pa.Table, name: str) -> np.ndarray:
        return rows.column(name).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)

    def partners(self, x: int, among: np.ndarray) -> np.ndarray:
        """Those in other components whose size and sketch allow the similarity, the most promising first."""
        n = self.n[among]
        at = among[(100 * np.minimum(n, self.n[x]) >= self.percent * np.maximum(n, self.n[x])) & (self.comps[among] != self.comps[x])]
        count = np.bitwise_count(self.sketch[at] ^ self.sketch[x]).sum(1)
        return at[np.lexsort((self.ids[at], count))][: int((count <= self.bits).sum())]


MEMBER = "bucket long, block int, asks boolean, id long, component long, n long, sketch array<long>"


def likely_partners(own: DataFrame, percent: int, bits: int, salt: int) -> DataFrame:
    """(a, b): each class outside its bucket's main component with its most promising partner in its block. Only sketches are dealt."""
    listed = own.withColumn("block", F.pmod(F.xxhash64("id", F.lit(salt)), F.col("blocks")).cast("int")).withColumn("asks", F.col("component") != F.col("main"))

    def best(rows: pa.Table) -> pa.Table:
        m = Members(rows.combine_chunks(), percent, bits)
        every = np.arange(len(m.ids))
        pairs = [(int(m.ids[x]), int(m.ids[at[0]])) for x in np.flatnonzero(m.asks).tolist() if len(at := m.partners(x, every))]
        return pa.table({"a": pa.array([min(p) for p in pairs], pa.int64()), "b": pa.array([max(p) for p in pairs], pa.int64())})

    return listed.select("bucket", "block", "asks", "id", "component", "n", "sketch").groupBy("bucket", "block").applyInArrow(best, "a long, b long").distinct()


def remaining_links(own: DataFrame, bands: DataFrame, sets: DataFrame, percent: int, bits: int) -> DataFrame:
    """(a, b): links that join all components of a bucket that are linked, a spanning choice for each block of a bucket.

    Classes outside the main component go to all blocks of their bucket. First, by sketch alone, only those with a
    partner stay; these then get their sets, and pairs are confirmed in place, each in the first bucket that its two
    classes share. No list of pairs is made.
    """
    asks = F.col("component") != F.col("main")
    every = own.where(asks).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    listed = own.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("asks", F.lit(False)).unionByName(every)

    def with_partner(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        m = Members(rows, percent, bits)
        among, keep = np.flatnonzero(~m.asks), np.zeros(rows.num_rows, bool)
        for x in np.flatnonzero(m.asks).tolist():
            at = m.partners(x, among)
            keep[at] = True
            keep[x] = len(at) > 0
        return rows.filter(pa.array(keep))

    def link(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        m = Members(rows, percent, bits)
        buckets, bucket = m.matrix(rows, "bands"), rows.column("bucket")[0].as_py()
        sets = [np.frombuffer(x.as_py(), "<u8") for x in rows.column("shingles")]
        among, asking, root = np.flatnonzero(~m.asks), set(m.ids[m.asks].tolist()), {}

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        out = []
        for x in np.flatnonzero(m.asks).tolist():
            at = m.partners(x, among)
            first = (buckets[at] == buckets[x]).argmax(1) if len(at) else at
            at = at[buckets[x][first] == bucket]
            at = np.array([y for y in at.tolist() if not (m.ids[y] < m.ids[x] and int(m.ids[y]) in asking)], np.int64)  # where both ask, once
            i, step = 0, 16
            while i < len(at):
                part = np.array([y for y in at[i : i + step].tolist() if find(int(m.comps[y])) != find(int(m.comps[x]))], np.int64)
                i, step = i + step, min(512, 2 * step)
                if len(part):
                    for y in part[similar(sets[x], [sets[y] for y in part], percent)].tolist():
                        p, q = find(int(m.comps[x])), find(int(m.comps[y]))
                        if p != q:
                            root[max(p, q)] = min(p, q)
                            out.append((int(m.ids[x]), int(m.ids[y])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    columns = ["bucket", "block", "asks", "id", "component", "n", "sketch"]
    wanted = materialise(listed.select(columns).groupBy("bucket", "block").applyInArrow(with_partner, MEMBER), "near-partners")
    return wanted.join(sets, "id").join(bands, "id").select(*columns, "bands", "shingles").groupBy("bucket", "block").applyInArrow(link, "a long, b long")


def joined(links: DataFrame, leaders: DataFrame, bands: DataFrame, sets: DataFrame, percent: int, bits: int) -> DataFrame:
    """(node, component) once all links are found: rounds of most promising partners, then all that are left."""
    labels = connected_components(links)
    for salt in itertools.count(1):
        own = materialise(open_buckets(bands, labels, leaders.select("id", "n", "sketch")), "near-open")
        if own.isEmpty():
            return labels
        more = materialise(confirm(likely_partners(own, percent, bits, salt), sets, percent), "near-more")
        if more.isEmpty():
            break
        links = links.union(more)
        labels = connected_components(links)
    more = materialise(remaining_links(own, leaders.select("id", "bands"), sets, percent, bits), "near-rest")
    return labels if more.isEmpty() else connected_components(links.union(more))


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the least id that can be reached by links), kept.

    Two documents are linked where 100 * intersection >= percent * union of their shingle sets. A null or empty text
    has no shingles and is linked with nothing. Rows with a null id are linked with nothing, have a null component
    and are kept. Rows with one id are one document, which has the links of each of its texts; a repeated row gets the same
    result. Other columns are not read. An empty table gives no rows. Shingles stand as 64-bit hashes and sets as two
    64-bit sums of them with their size: among n shingles of a pair's two texts two are taken for one with a probability
    of about n**2 / 2**65. A worker holds a text and several times its bytes at a time.
    """
    prepare(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    found = materialise(features(texts, words).withColumn("class", F.when(F.col("n") > 0, class_of())), "near-features")
    usable = found.where("id IS NOT NULL AND n > 0")
    classes = materialise(usable.groupBy("class").agg(F.min("id").alias("first")), "near-classes")
    leaders = usable.join(classes, (usable["id"] == classes["first"]) & (usable["class"] == classes["class"])).select(usable["class"].alias("id"), usable["n"], "bands", "sketch", "first").dropDuplicates(["id"])
    leaders = materialise(leaders, "near-leaders")
    bands = leaders.select("id", F.explode("bands").alias("bucket"))
    shared_buckets = bands.groupBy("bucket").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket", "least")
    bands = materialise(bands.join(shared_buckets, "bucket"), "near-buckets")
    stars = materialise(bands.where("least <> id").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), "near-stars")
    sketches = leaders.select("id", "n", "sketch")
    least = percent / 100 - 5 * math.sqrt(percent / 100 * (1 - percent / 100) / HASHES + (1.1 / math.sqrt(4 * HASHES)) ** 2 / 2)
    bits = most_bits(max(0.0, least))
    met = stars.select(F.col("a").alias("id")).union(stars.select(F.col("b").alias("id"))).distinct()
    wanted = materialise(leaders.select("id", "first").join(met, "id").select(F.col("id").alias("class"), "first"), "near-wanted")
    sets = materialise(sets_of(texts.where("id IS NOT NULL"), wanted, words), "near-sets")

    def side(name: str) -> DataFrame:
        return sketches.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))

    differing = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    likely = stars.join(side("a"), "a").join(side("b"), "b").where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (differing <= bits)).select("a", "b")
    # Classes of one id belong together, whatever their similarity.
    several = usable.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a < z")
    of_one = usable.select("id", F.col("class").alias("b")).join(several, "id").where("a <> b").select("a", "b").distinct()
    links = materialise(confirm(likely, sets, percent).union(of_one), "near-links")
    labels = joined(links, leaders, bands.select("id", "bucket"), sets, percent, bits).withColumnRenamed("node", "class")
    reached = labels.join(classes, "class").groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialise(labels.join(reached, "component").select("class", "component_id"), "near-components")
    placed = found.join(classes, "class", "left").join(named, "class", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "first", "id"))
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
