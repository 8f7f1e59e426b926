import hashlib
import random

import numpy as np
import pytest

from geneloom.llm import substring_dedup as S
from geneloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.fixtures import rows_by_id, table, texts
from tests.oracle import DATA, connect, same


def brute(rows, window=13):
    least: dict = {}
    for i, t in rows:
        w = (t or "").encode().split()
        if i is not None:
            for k in range(len(w) - window + 1):
                x = tuple(w[k : k + window])
                least[x] = min(least.get(x, i), i)
    out = {}
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if least[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.setdefault(i, set()).add((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, **options):
    found = rows_by_id(S.dedup(table(spark, rows), **options))
    assert {i: {(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in x} for i, x in found.items()} == brute(rows, options.get("window", 13))
    assert sum(map(len, found.values())) == len(rows)
    for x in found.values():
        for r in x:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


@pytest.mark.parametrize("hot_share", [0.005, 0.2, 1.0])
def test_matches_brute_force(spark, hot_share):
    """Whatever prefixes and windows are taken for frequent, results stay the same."""
    check(spark, texts(3), hot_share=hot_share)


def test_small_windows_and_vocabulary(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    check(spark, rows, window=6, prefix=3)


def test_rows_of_one_id_do_not_affect_each_other(spark):
    t = " ".join(f"w{i}" for i in range(20))
    check(spark, [(1, t), (1, t), (1, t + " more"), (2, "x " + t)])


def test_windows_do_not_cross_documents(spark):
    a, b = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]
    check(spark, [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a + b)), (4, " ".join(a + b))])


@pytest.mark.parametrize("depth", [1, 2, 5, 8, 13])
def test_deep_nodes_are_the_repeats_that_end_to_the_right(depth):
    """A node for each run of words that occurs again and isn't always followed by the same word."""
    rng = np.random.default_rng(1)
    leaves, sizes = rng.integers(0, 2, 400), np.array([100, 150, 150])
    stops = np.repeat(np.cumsum(sizes), sizes)
    tree = S.Subtree(leaves, sizes, np.arange(400))
    suffixes = [tuple(leaves[p : stops[p]].tolist()) for p in range(400)]
    assert [suffixes[i] for i in tree.order] == sorted(suffixes)
    next_words: dict = {}
    for x in suffixes:
        for k in range(depth, len(x) + 1):
            next_words.setdefault(x[:k], []).append(x[k] if k < len(x) else None)
    expected = {(x, len(n)) for x, n in next_words.items() if len(n) > 1 and (len(set(n)) > 1 or None in n)}
    assert {(suffixes[tree.order[i]][:d], j - i) for i, j, d in zip(*(x.tolist() for x in tree.deep_nodes(depth)))} == expected
    values = rng.permutation(400)
    least: dict = {}
    for i, v in zip(tree.order, values):
        x = suffixes[i][:depth]
        least[x] = min(least.get(x, v), v)
    assert tree.least_above(values, depth).tolist() == [least[suffixes[i][:depth]] if len(suffixes[i]) >= depth else v for i, v in zip(tree.order, values)]


def test_frequent_prefixes_are_extended(spark):
    """A prefix in every document, with few and with many different continuations."""
    rng = random.Random(5)
    rows = [(i, " ".join(["one", "two", "three", "four", "five", *(rng.choice("ab") for _ in range(12)), str(i % 7)] * 3)) for i in range(200)]
    check(spark, rows, hot_share=0.02)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    shared = [rng.choice("abcdefgh") for _ in range(13)]
    seen = set()
    for _ in range(50):
        before = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30))]
        after = [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 30))]
        w = S.Words([" ".join(before + shared + after).encode()], 13, 5)
        k = list(w.windows).index(len(before))
        seen.add(int(w.anchor[k]) - len(before))
    assert len(seen) == 1


def test_empty_table(spark):
    assert S.dedup(table(spark, [])).collect() == []


def test_query_matches_sql(spark):
    same(QUERIES["op3_substring_dedup"](spark, DATA), connect(), ORACLE_SQL["op3_substring_dedup"])
