import time
from collections import Counter

import pytest

from geneloom.llm import quality_rules as Q
from geneloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.fixtures import rows_by_id, table, texts
from tests.oracle import DATA, connect, same


def brute(text):
    w = (text or "").encode().split()
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts, hit = Counter(windows), set()
    for i, x in enumerate(windows):
        if counts[x] > 1:
            hit |= {i, i + 1, i + 2}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(len(x.decode()) for x in w), symbols, dup, len(hit)


def test_counts_match_brute_force(spark):
    rows = texts()
    found = rows_by_id(Q.judge(table(spark, rows), counts=True))
    for i, t in rows:
        expected = brute(t)
        for r in found[i]:
            if i is not None:
                assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])
    assert sum(map(len, found.values())) == len(rows)


def test_order_of_rules_changes_no_verdict():
    cascade = (*Q.BASE_RULES, *Q.RULES)
    for _, t in texts(2):
        features = lambda: Q.Features(t or "")
        assert (Q.first_rejection(features(), cascade) is None) == (Q.first_rejection(features(), cascade[::-1]) is None)


def test_plan_puts_rejections_per_cost_first():
    rules = Q.RULES[:3]
    names = [r.name for r in Q.plan(rules, {rules[0].name: (1.0, 0.1), rules[1].name: (1.0, 0.5), rules[2].name: (0.1, 0.1)})]
    assert names == [rules[2].name, rules[1].name, rules[0].name]
    assert Q.plan(rules, {}) == rules


def test_short_circuit():
    calls = []
    rules = tuple(Q.Rule(n, lambda f, n=n: bool(calls.append(n)) or n == "b") for n in "abc")
    assert Q.first_rejection(Q.Features("x"), rules) == "b" and calls == ["a", "b"]


def test_verdicts_agree_in_both_forms(spark):
    rows = table(spark, texts())
    with_counts = {r["doc_id"]: r["kept"] for r in Q.judge(rows, counts=True).collect() if r["doc_id"] is not None}
    plain = Q.judge(rows)
    assert plain.columns.count("kept") == 1
    assert {r["doc_id"]: r["kept"] for r in plain.collect() if r["doc_id"] is not None} == with_counts


def test_rejects_junk_and_keeps_prose(spark):
    prose = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)} and" for i in range(80))
    junk = {1: " ".join(f"w{i}***" for i in range(80)), 2: " ".join(f"| w{i}" for i in range(80)), 3: prose.upper(), 4: "spam and eggs " * 60, 5: "few words", 6: " ".join(str(i) for i in range(1000, 1090))}
    found = {r["doc_id"]: r["kept"] for r in Q.judge(table(spark, [(0, prose), *junk.items()]), counts=True).collect()}
    assert found == {0: True, **{i: False for i in junk}}


def test_empty_table(spark):
    assert Q.judge(table(spark, []), counts=True).collect() == []
    assert Q.judge(table(spark, [])).collect() == []


def test_query_matches_sql(spark):
    same(QUERIES["op1_quality_rules"](spark, DATA), connect(), ORACLE_SQL["op1_quality_rules"])


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_windows_need_three_words(n):
    assert Q.Features("a " * n).n_repeat_words == 0


@pytest.mark.parametrize("text", ["7" * 1_000_000, "=" * 999_999 + "a", "é" * 400_000, "x " * 500_000])
def test_long_texts_take_time_in_proportion(text):
    """One word of a million characters: a search that starts again at each of them would never end."""
    f = Q.Features(text)
    began = time.perf_counter()
    Q.first_rejection(f, (*Q.RULES, *Q.BASE_RULES))
    assert Q.base_counts(f)[0] == len(text.split())
    assert f.n_letter_words == sum(1 for w in text.split() if any(c.isalpha() for c in w))
    assert time.perf_counter() - began < 20


def test_measure_leaves_out_what_the_base_rules_reject(spark):
    junk, prose = "few *** words", " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = table(spark, [(i, junk if i % 2 else prose) for i in range(200)])
    assert Q.measure(rows, Q.RULES, counted=True)["symbols"][1] == 0
    assert Q.measure(rows, Q.RULES)["symbols"][1] > 0
