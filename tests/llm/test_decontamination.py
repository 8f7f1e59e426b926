import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from geneloom.llm import decontamination as D
from tests.llm.fixtures import rows_by_id, table, texts


def scalar(item, passage):
    """Smith-Waterman by the plain recurrence."""
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    best = 0
    for i, x in enumerate(item, 1):
        for j, y in enumerate(passage, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (D.MATCH if x == y else D.MISMATCH), h[i - 1][j] - D.GAP, h[i][j - 1] - D.GAP)
            best = max(best, h[i][j])
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=15), st.lists(st.integers(0, 3), max_size=25))
def test_alignment_scores(item, passage):
    a, b = np.array(item, np.uint64), np.array(passage, np.uint64)
    score, start, end = D.align(a, b)
    assert score == scalar(item, passage)
    assert 0 <= start <= end <= len(passage)
    assert scalar(item, passage[start:end]) == score


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(rows, bench, least=0.5):
    """Every item against every whole text."""
    out = {}
    for i, t in rows:
        w = D.normal(t or "").split()
        own = set()
        for k, u in bench:
            v = D.normal(u or "").split()
            if len(v) >= 4 and scalar(v, w) >= least * D.MATCH * len(v):
                own.add(k)
        out.setdefault(i, []).append(own)
    return out


def test_matches_brute_force(spark):
    rng = random.Random(9)
    bench = [(k, " ".join(f"q{rng.randrange(300)}" for _ in range(rng.randrange(8, 25)))) for k in range(12)]
    bench += [(50, None), (51, ""), (52, "one two"), (None, "lost words of an item"), (3, bench[3][1])]
    rows = []
    for i in range(60):
        w = [f"p{rng.randrange(200)}" for _ in range(rng.randrange(0, 60))]
        if i % 2:
            v = bench[rng.randrange(12)][1].split()
            if i % 4 == 1:  # every sixth word goes, another comes in
                v = [x.upper() + "," if n % 6 else f"z{n}" for n, x in enumerate(v)]
            if i % 8 == 3:
                v = v[: len(v) // 3]  # too little of it
            w = w[:5] + v + w[5:]
        rows.append((i, " ".join(w)))
    rows += texts(2, 10)[-15:]
    found = rows_by_id(D.report(table(spark, rows), items(spark, bench), rare_share=1.0))
    expected = brute(rows, [b for b in bench if b[0] is not None])
    for i, group in found.items():
        assert sorted(set(r["items"]) for r in group) == sorted(expected[i])
        for r in group:
            assert r["contaminated"] == bool(r["items"]) and r["n_items"] == len(r["items"]) and (r["best_item"] in r["items"] if r["items"] else r["best_item"] is None)


def test_rare_seeds_find_copies_and_edits(spark):
    item = " ".join(f"u{i}" for i in range(24))
    common = " ".join(["of the and in"] * 6)
    words = item.split()
    edited = " ".join("changed" if i % 7 == 3 else w for i, w in enumerate(words))
    rows = [(1, "before " + item.upper() + " after"), (2, edited), (3, common * 20), (4, " ".join(words[:6])), (5, "clean text of no item at all")]
    found = {r["doc_id"]: r["contaminated"] for r in D.report(table(spark, rows), items(spark, [(7, item), (8, common + " tail words here")])).collect()}
    assert found == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_edited_copies_by_the_defaults(spark):
    """Only the seeds of an edited copy that the edits left are in the corpus, and so are the most frequent ones of the item."""
    rng = random.Random(5)
    bench = [(k, " ".join(f"e{k}x{i}" for i in range(38))) for k in range(20)]
    rows = []
    for i in range(160):
        w = bench[i % 20][1].split()
        every, share = 5, rng.choice((0.2, 0.25, 0.3))
        changed = range(4, 38, every) if i < 40 else rng.sample(range(38), round(share * 38))
        for j in changed:
            w[j] = f"z{i}y{j}"
        rows.append((i, " ".join(["before"] * 3 + w + ["after"] * 3)))
    rows.append((500, "a whole copy " + bench[0][1]))
    expected = brute(rows, bench)
    found = {r["doc_id"]: set(r["items"]) for r in D.report(table(spark, rows), items(spark, bench)).collect()}
    assert found == {i: x[0] for i, x in expected.items()}
    assert all(found[i] for i in range(40))


def test_items_shorter_than_a_seed(spark):
    bench = [(1, "Solo!"), (2, "two words"), (3, "three short words"), (4, "two words"), (5, ""), (6, "four whole words here")]
    rows = [(1, "a solo, then two words"), (2, "three short"), (3, "words three short words"), (4, "two"), (5, "words"), (6, "four whole words here"), (7, ""), (8, "of solo")]
    found = {r["doc_id"]: sorted(r["items"]) for r in D.report(table(spark, rows), items(spark, bench)).collect()}
    assert found == {1: [1, 2, 4], 2: [], 3: [3], 4: [], 5: [], 6: [6], 7: [], 8: [1]}
    assert [r["items"] for r in D.report(table(spark, [(1, ""), (2, None)]), items(spark, bench[:2])).collect()] == [[], []]


def test_seeds_are_the_rarest():
    one = D.Items([(1, "a b c d e f g h")], 4)
    counts = {s: n for n, s in enumerate(one.seeds.tolist())}
    one.keep_rare(counts, 0.5)
    assert sorted(counts[s] for s in one.seeds.tolist()) == [0, 1, 2]


def test_blocks_of_items(spark, monkeypatch):
    bench = [(k, " ".join(f"b{k}x{i}" for i in range(10))) for k in range(9)]
    rows = [(k, bench[k][1] + " and " + bench[(k + 1) % 9][1]) for k in range(9)]
    monkeypatch.setattr(D, "BLOCK_WORDS", 40)
    blocks = D.blocks_of(items(spark, bench), "item_id", "text")
    assert len(blocks) == 2 and sum(b.count() for b in blocks) == 9
    found = {r["doc_id"]: sorted(r["items"]) for r in D.report(table(spark, rows), items(spark, bench)).collect()}
    assert found == {k: sorted((k, (k + 1) % 9)) for k in range(9)}


def test_clean_keeps_columns(spark):
    item = " ".join(f"u{i}" for i in range(12))
    docs = table(spark, [(1, item), (2, "fine"), (None, None)])
    kept = D.clean(docs, items(spark, [(1, item)]))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, None}


def test_empty_tables(spark):
    assert D.report(table(spark, []), items(spark, [(1, "a b c d e")])).collect() == []
    assert [r["contaminated"] for r in D.report(table(spark, [(1, "a b c d e")]), items(spark, [])).collect()] == [False]
