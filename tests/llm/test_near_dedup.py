import random
from itertools import combinations

import numpy as np
import pytest

from geneloom.llm import near_dedup as N
from geneloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.fixtures import rows_by_id, table, texts, words
from tests.oracle import DATA, connect, same


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n=2, percent=80):
    """{id: component}; an id has the links of each of its texts."""
    sets: dict = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, n))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if any(s and r and 100 * len(s & r) >= percent * len(s | r) for s in sets[a] for r in sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def check(spark, rows, words=2):
    expected = brute(rows, words)
    found = rows_by_id(N.near_duplicates(table(spark, rows), words))
    assert sum(map(len, found.values())) == len(rows)
    for i, group in found.items():
        assert sorted(r["n_shingles"] for r in group) == sorted(len(shingles(t, words)) for j, t in rows if j == i)
        for r in group:
            if i is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert (r["component_id"], r["kept"]) == (expected[i], expected[i] == i)


@pytest.mark.parametrize("size", [2, 5])
def test_matches_brute_force(spark, size):
    check(spark, texts(5), size)


def test_chain_and_star_of_near_copies(spark):
    """A long chain, and a group around one text whose members are often no near copies of each other."""
    rng = random.Random(6)
    rows, w = [], words(rng, 150, 5000)
    for i in range(25):
        rows.append((i, " ".join(w)))
        k = rng.randrange(len(w))
        w = w[:k] + [f"c{i}"] * 1 + w[k + 1 :]
        w = w[:-4] + [f"d{i}{j}" for j in range(4)] if i % 2 else w
    centre = words(rng, 200, 9000)
    for i in range(60):
        v = list(centre)
        for k in rng.sample(range(200), rng.randrange(0, 14)):
            v[k] = f"n{rng.randrange(10**6)}"
        rows.append((rng.randrange(10**6) + 100, " ".join(v)))
    check(spark, rows)


def test_rows_of_one_id_link_by_each_text(spark):
    rng = random.Random(9)
    one, two = words(rng, 100, 5000), words(rng, 100, 5000)
    near = lambda w: " ".join([*w[:-3], "x", "y"])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one)), (3, near(two)), (4, " ".join(two) + " z"), (1, ""), (5, " ".join(words(rng, 50, 5000)))]
    assert brute(rows) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    check(spark, rows)


def test_large_buckets_in_small_blocks(spark, monkeypatch):
    """Many variants of one text around an outlier that shares bands with all: links between blocks are found."""
    monkeypatch.setattr(N, "BLOCK", 5)
    rng = random.Random(10)
    centre, rows = words(rng, 120, 9000), []
    for i in range(50):
        v = list(centre)
        for k in rng.sample(range(120), rng.randrange(0, 16)):
            v[k] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(v)))
    check(spark, rows)


def test_links_that_no_most_promising_partner_gives(spark, monkeypatch):
    """Without rounds all links between components of a bucket come from the last search."""
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "likely_partners", lambda own, *_: own.selectExpr("id AS a", "id AS b").limit(0))
    rng = random.Random(11)
    centre, rows = words(rng, 150, 9000), []
    for i in range(60):
        v = list(centre)
        for k in rng.sample(range(150), rng.randrange(0, 20)):
            v[k] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(v)))
    check(spark, rows)


def test_sketch_estimates_high_similarity():
    rng = np.random.default_rng(3)
    for j in (0.8, 0.9, 0.95):
        errors = []
        for _ in range(20):
            shared, own = int(1000 * j), 1000 - int(1000 * j)
            base = rng.integers(0, 1 << 63, shared + own, dtype=np.uint64)
            a, b = np.unique(base[: shared + own // 2]), np.unique(np.r_[base[:shared], base[shared + own // 2 :]])
            x, y = N.odd_sketch(N.minhash(a)), N.odd_sketch(N.minhash(b))
            z = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
            errors.append(1 + N.SKETCH_BITS / (4 * N.HASHES) * np.log(1 - 2 * z / N.SKETCH_BITS) - j)
            assert z <= N.most_bits(j - 0.2)
        assert abs(np.mean(errors)) < 0.03
    assert N.most_bits(0.6) < N.SKETCH_BITS / 2


def test_exact_test_at_the_threshold(spark):
    four = " ".join("abcdefghij")  # nine shingles
    rows = [(1, four), (2, four + " k k"), (3, four + " k")]  # 9/11 and 9/10
    check(spark, rows)


def test_empty_table(spark):
    assert N.near_duplicates(table(spark, [])).collect() == []


def test_only_unlike_documents(spark):
    check(spark, [(i, " ".join(f"{i}x{k}" for k in range(10))) for i in range(5)])


def test_query_matches_sql(spark):
    same(QUERIES["op7_near_dedup"](spark, DATA), connect(), ORACLE_SQL["op7_near_dedup"])
