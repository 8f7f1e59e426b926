from geneloom.llm import line_dedup as L
from geneloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.fixtures import rows_by_id, table, texts
from tests.oracle import DATA, connect, same


def brute(rows, percent=80, least=1):
    """Removed line numbers by (id, text): all pairs of lines, exactly."""
    docs = sorted({(i, t or "") for i, t in rows if i is not None})
    lines = [(i, n, t, frozenset(x.lower().encode().split())) for i, t in docs for n, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[3]) >= least]
    gone = {d: set() for d in docs}
    for i, n, t, s in lines:
        for j, m, u, r in lines:
            if ((j, m) < (i, n)) and 100 * len(s & r) >= percent * len(s | r):
                gone[i, t].add(n)
                break
    return gone


def check(spark, rows):
    expected = brute(rows)
    found = rows_by_id(L.dedup(table(spark, rows)))
    assert sum(map(len, found.values())) == len(rows)
    for i, t in rows:
        mine = [r for r in found[i] if r["n_chars"] == (None if t is None else len(t))]
        for r in mine:
            gone = sorted(expected[i, t or ""]) if i is not None else []
            assert r["removed"] == gone
            kept = [x for n, x in enumerate((t or "").split("\n")) if n not in gone]
            assert r["text"] == (None if t is None else "\n".join(kept))
            assert r["n_lines"] == sum(1 for x in (t or "").split("\n") if x.encode().split())


def test_matches_brute_force(spark):
    check(spark, texts(1))


def test_many_similar_lines(spark):
    """A group in which the most promising earlier line often isn't similar enough, so that the second search counts."""
    import random

    rng = random.Random(4)
    base = [f"t{i}" for i in range(20)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(20)] = f"u{rng.randrange(30)}"
        rows.append((i, " ".join(w) + "\n" + " ".join(f"x{rng.randrange(60)}" for _ in range(8))))
    check(spark, rows)


def test_short_lines_stay(spark):
    rows = [(1, "a b c\na b c"), (2, "a b c\nv w x y z\nz y x w v V")]
    found = {r["doc_id"]: r["removed"] for r in L.dedup(table(spark, rows), least=5).collect()}
    assert found == {1: [], 2: [2]}


def short_lines():
    """Repeats of lines of one to six distinct words, and pairs of four words against five at the threshold."""
    import random

    rng = random.Random(6)
    rows = [(i, "\n".join(" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(0, 7))) for _ in range(4))) for i in range(80)]
    return rows + [(100, "p q r s"), (101, "s r q p t\nLes."), (102, "les.\nLES. les."), (103, ""), (104, "u v w x y"), (105, "y x w v")]


def test_query_takes_short_lines(spark, tmp_path):
    table(spark, short_lines()).write.parquet(str(tmp_path / "documents.parquet"))
    expected = brute(short_lines(), least=1)
    found = {r["doc_id"]: r["removed"] for r in QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()}
    assert found == {i: ",".join(map(str, sorted(gone))) for (i, _), gone in expected.items()}


def test_frequent_tokens_are_cut_into_blocks(spark, monkeypatch):
    """Sets of a small vocabulary, so that each token has many: with tiny blocks and groups the result is the same."""
    import random

    monkeypatch.setattr(L, "BLOCK_ENTRIES", 20)
    monkeypatch.setattr(L, "GROUP_ENTRIES", 100)
    monkeypatch.setattr(L, "PAIRS_A_BATCH", 7)
    rng = random.Random(8)
    rows = [(i, "\n".join(" ".join(rng.sample("abcdefghijklmn", rng.randrange(1, 12))) for _ in range(3))) for i in range(200)]
    check(spark, rows)


def test_every_two_entries_of_a_frequent_token_meet():
    import numpy as np

    deal = L.Deal.__new__(L.Deal)
    deal.blocks = np.ones(L.BUCKETS, np.int64)
    deal.blocks[5] = 4
    flat = np.array([5] * 30 + [6] * 3, np.uint64)
    tokens, at = deal.split(flat, np.arange(33))
    groups = {}
    for t, i in zip(tokens.tolist(), at.tolist()):
        groups.setdefault(t, set()).add(i)
    assert all(any({i, j} <= g for g in groups.values()) for i in range(30) for j in range(30))
    assert max(len(g) for g in groups.values()) <= 16 and {30, 31, 32} in groups.values()


def test_order_of_tokens_is_global():
    import numpy as np

    rarity = L.rarities(np.arange(L.BUCKETS))
    one, two = L.Lines([b"c b a", b"x\nb c d"], rarity), L.Lines([b"b c", b"", b"a c"], rarity)
    order = [list(x.token[x.line == i]) for x in (one, two) for i in range(4)]
    rank = {t: (int(rarity[int(t % np.uint64(L.BUCKETS))]), int(t) >> 28) for s in order for t in s}
    assert all(s == sorted(s, key=rank.get) for s in order)


def test_empty_table(spark):
    assert L.dedup(table(spark, [])).collect() == []


def test_query_matches_sql(spark):
    same(QUERIES["op2_line_dedup"](spark, DATA), connect(), ORACLE_SQL["op2_line_dedup"])
