import base64
import hashlib
import heapq
import random

import pytest

from geneloom.llm import warc as W
from geneloom.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import DATA, connect, same

PAGES = "page_id long, url string, html string, payload string, record_type string, timestamp string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "p", "t", "s") for r in rows], PAGES)


ODD = "tricky\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nx\n\n"
ROWS = [
    (1, "http://b.example.com/x?q=1#f", "same"), (2, "https://a.example.com/y", "same"), (7, "http://b.example.com/x?q=1", "same"),
    (3, "http://a.example.com/", None), (4, None, ""), (5, "no scheme", ODD), (6, "http://user@WWW.Example.org:80/Path\r\nX: y", "é" * 3000), (8, "http://c.org", ODD),
    (9, "http://z.org", "once"), (9, "http://z.org", "once"), (None, "http://n.org", "lost"), (-3, "http://m.org", "minus"),
]


def brute(rows, least=0):
    top: dict = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= least and i is not None:
            top[p] = max(top.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = p in top and i != top[p]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", top[p] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    found = W.archive(pages(spark, ROWS), least)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found.collect()), key=str) == brute(ROWS, least)


def test_repeated_payloads_joined_by_digest(spark, monkeypatch):
    """More repeated payloads than may be broadcast give the same records."""
    monkeypatch.setattr(W, "BROADCAST_PAYLOADS", 0)
    test_round_trip(spark, 0)


def test_index_is_in_global_order(spark):
    rng = random.Random(1)
    rows = [(i, f"http://{rng.choice('abc')}.org/{rng.randrange(4)}", f"body {i}") for i in rng.sample(range(3000), 400)]
    rows += [(5000 + i, "http://hot.org/", "h") for i in range(300)]
    found = W.archive(pages(spark, rows)).orderBy("part", "position").collect()
    keys = [(r["url_key"], r["timestamp"], r["page_id"]) for r in found]
    assert keys == sorted(keys) and len(keys) == len(rows)
    hot = {r["part"] for r in found if r["url_key"] == "org,hot)/"}
    assert len(hot) > 1  # the captures of one URL are cut too


def test_records_can_be_read_at_their_offsets(spark, tmp_path):
    path = W.write_archives(pages(spark, ROWS), str(tmp_path / "archive"))
    index = W.read_index(spark, path).collect()
    for r in index:
        data = (tmp_path / "archive" / r["file"]).read_bytes()[r["offset"] : r["offset"] + r["length"]]
        ((head, at, length, block),) = list(W.records(data))
        assert at == 0 and length == len(data) and head["WARC-Target-URI"] == r["url"] and data.startswith(b"WARC/1.1\r\n")
        if r["record_type"] == "response":
            assert len(block[block.index(b"\r\n\r\n") + 4 :]) == r["payload_bytes"]
    for f in {r["file"] for r in index}:  # each file is a sorted run
        own = [(r["url_key"], r["timestamp"], -1 if r["page_id"] is None else r["page_id"]) for r in sorted(index, key=lambda r: r["offset"]) if r["file"] == f]
        assert own == sorted(own)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted((rng.randrange(20), i, j) for j in range(rng.randrange(0, 9))) for i in range(k)]
    assert list(W.LoserTree([iter(r) for r in runs])) == list(heapq.merge(*runs))


def test_url_key(spark):
    rows = spark.createDataFrame([("http://www.Example.com:80/A?b#c",), ("https://u@x.org",), (None,), ("plain",)], "u string")
    assert [r[0] for r in rows.select(W.url_key(rows["u"])).collect()] == ["com,example)/a?b", "org,x)", ")", "plain)"]


def test_damaged_archives_are_noticed():
    with pytest.raises(ValueError):
        list(W.records(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabcdefg"))
    with pytest.raises(ValueError):
        list(W.records(b"HTTP/1.1 200 OK\r\n\r\n"))


def test_empty_table(spark):
    assert W.archive(pages(spark, [])).collect() == []


def test_query_matches_sql(spark):
    same(QUERIES["op4_warc"](spark, DATA), connect(), ORACLE_SQL["op4_warc"])
