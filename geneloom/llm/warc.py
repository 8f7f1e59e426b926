"""WARC archives and their capture index.

Records are written as plain WARC/1.1 files in the shared folder, each file a run sorted by URL key and timestamp. The
reader parses whole files record by record. The index is merged externally: range splitters cut every sorted run into
slices, and each slice range is merged from its runs by a loser tree, so that the ranges in order hold the capture
history of all URL keys in global order.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, materialise, prepare, shared_dir, shuffle_partitions, tidied

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Custom header: a revisit's record has no payload, its length is kept here.
LENGTH_HEADER = "WARC-X-Payload-Length"
MAX_RECORDS_PER_FILE = 4_000
#: A table of so many repeated payloads at most (some 100 bytes each) is broadcast.
BROADCAST_PAYLOADS = 300_000
INDEX_SCHEMA = "url_key string, timestamp string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, file string, offset long, length long"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each five hexadecimal digits are four characters."""
    digits = F.sha1(payload)

    def group(k: Column) -> Column:
        value = F.conv(F.substring(digits, k * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*(F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), group), "")


def url_key(url: Column) -> Column:
    """Host labels reversed and joined by commas, ), then path and query in lower case; fragment, scheme and user are dropped."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[^/?#]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*", 0), r"^[^@]*@|^www\.|:(80|443)$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, r"^[^/?]*", ""))


def with_revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Adds record_type and refers_to. Of equal payloads of at least min_bytes the one with the largest page_id is the response.

    Equal payloads are found by digest and length; one partial aggregate of (digest, largest page_id) over digests and ids,
    of which the repeated payloads are joined back: up to BROADCAST_PAYLOADS of them by a broadcast, so that no payload is
    shuffled, more by digest.
    """
    first = pages.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("pages"))
    first = materialise(first.where("pages > 1").drop("pages"), "warc-repeated")
    if first.count() <= BROADCAST_PAYLOADS:
        first = F.broadcast(first)
    joined = pages.join(first, ["payload_digest", "payload_bytes"], "left")
    again = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("response_id"))).drop("response_id")


def record_text() -> Column:
    """One record without its last line feed, which the text writer adds."""
    crlf = "\r\n"
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(crlf * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    clean = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "")
    identity = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "), F.col("record_type"),
        F.lit(f"{crlf}WARC-Record-ID: "), identity,
        F.lit(f"{crlf}WARC-Date: "), F.col("timestamp"),
        F.lit(f"{crlf}WARC-Target-URI: "), clean,
        F.lit(f"{crlf}WARC-X-URL-Key: "), F.regexp_replace(F.col("url_key"), r"[\r\n]", ""),
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit(f"{crlf}{LENGTH_HEADER}: "), F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"{crlf}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{crlf}WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{crlf}Content-Type: application/http;msgtype=response{crlf}Content-Length: "), F.octet_length(block).cast("string"), F.lit(crlf * 2),
    )
    return F.concat(head, block, F.lit("\r\n\r"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> str:
    """Writes .warc files below path, each sorted by URL key, timestamp and page_id; returns path.

    pages: page_id (integer), url, html; a capture time is made of page_id, one second each from 2024 on. Null html is
    an empty payload, null url an empty one, null page_id is written as none and never answers for others unless all
    equal payloads have none. Rows with equal payload and page_id are all responses. Other columns are not read.
    """
    page = F.col("page_id")
    moment = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce(page, F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("payload"))
    rows = rows.select("*", url_key(F.col("url")).alias("url_key"), moment.alias("timestamp"), base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    rows = with_revisits(rows, min_bytes).sortWithinPartitions("url_key", "timestamp", "page_id")
    rows.select(record_text().alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).text(path)
    rename_parts(pages.sparkSession, path)
    return path


def rename_parts(spark: SparkSession, path: str) -> None:
    """part-*.txt to part-*.warc, by the file system that holds them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in fs.listStatus(where):
        name = f.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            fs.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(where, name[:-4] + ".warc"))


def records(data: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """(headers, offset, length, block) of each record; blocks are found by Content-Length alone."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} isn't ended where its length says")
        yield headers, at, stop + 4 - at, data[start:stop]
        at = stop + 4


def page_of(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return None if number in ("", "none") else int(number)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, in each file's order; a response's digest and length are computed from its payload."""
    prepare(spark)

    @tidied
    def run(batches: Batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for head, at, length, block in records(data.as_py()):
                    digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head[LENGTH_HEADER])
                    if head["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if (own, len(payload)) != (digest, size):
                            raise ValueError(f"{name}: the payload at byte {at} isn't the one that its header names")
                    rows.append((head["WARC-X-URL-Key"], head["WARC-Date"], page_of(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], page_of(head.get("WARC-Refers-To")), digest, size, name.rsplit("/", 1)[-1], at, length))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(INDEX_ARROW)], schema=INDEX_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(path)
    return files.select("path", "content").mapInArrow(run, INDEX_SCHEMA)


INDEX_ARROW = pa.schema([(name, {"string": pa.string(), "long": pa.int64()}[kind]) for name, kind in (x.split() for x in INDEX_SCHEMA.split(", "))])


class LoserTree:
    """K-way merge: inner nodes hold the losers, so that each next item takes one comparison a level."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        k = self.k = max(1, len(runs))
        winners = [-1] * k + list(range(k))
        self.losers = [-1] * k
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.before(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else 0

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) <= (y, b))

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node:
                if self.losers[node] >= 0 and self.before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def splitters(index: DataFrame, parts: int, sample_rows: int = 20_000) -> list[tuple[str, str, int]]:
    """parts - 1 keys at equal steps of a sample of about sample_rows rows; they only decide how evenly the work is dealt."""
    rows = index.count()
    key = F.struct("url_key", "timestamp", F.coalesce("page_id", F.lit(-1)).alias("page_id"))
    found = sorted(tuple(r["key"]) for r in index.select(key.alias("key")).sample(min(1.0, sample_rows / max(rows, 1)), seed=11).limit(4 * sample_rows).collect())
    return [found[len(found) * i // parts] for i in range(1, parts)] if found else []


def merge_index(index: DataFrame, parts: int | None = None) -> DataFrame:
    """The index rows with (part, position): ordered by these, all rows are in order of URL key, timestamp and page_id.

    Splitters are whole keys, timestamp and page_id included, so that the captures of one hot URL are cut too. Each
    file's rows are a sorted run. Null page_ids come first within a timestamp; repeated rows are kept.
    """
    parts = parts or max(2, 2 * shuffle_partitions(index.sparkSession))
    bounds = splitters(index, parts)
    names = [f.name for f in INDEX_ARROW]

    @tidied
    def slices(batches: Batches):
        for b in batches:
            keys = zip(b.column("url_key").to_pylist(), b.column("timestamp").to_pylist(), b.column("page_id").to_pylist())
            part = [bisect.bisect_right(bounds, (u, t, -1 if p is None else p)) for u, t, p in keys]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *b.columns], ["part", *names])

    def merge(batch: pa.Table) -> pa.Table:
        runs: dict[str, list[tuple]] = {}
        for i, (u, t, p, f, o) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("url_key", "timestamp", "page_id", "file", "offset")))):
            runs.setdefault(f, []).append((o, (u, t, -1 if p is None else p, f, o), i))
        lists = [[x[1:] for x in sorted(r)] for _, r in sorted(runs.items())]  # by offset: the file's own order, which is sorted
        order = [i for _, i in LoserTree([iter(r) for r in lists])]
        return batch.take(pa.array(order, pa.int64())).append_column("position", pa.array(range(len(order)), pa.int64())).combine_chunks()

    dealt = index.select(*names).mapInArrow(slices, f"part int, {INDEX_SCHEMA}")
    return dealt.groupBy("part").applyInArrow(merge, f"part int, {INDEX_SCHEMA}, position long")


def archive(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages as archives to the shared folder, reads them back and returns their merged index."""
    spark = pages.sparkSession
    path = write_archives(pages, shared_dir(spark, "warc"), min_bytes)
    runs = shared_dir(spark, "cdx-runs-" + uuid.uuid4().hex[:8])
    read_index(spark, path).write.parquet(runs)
    return merge_index(spark.read.parquet(runs))
