import random

from hypothesis import given, settings
from hypothesis import strategies as st

from geneloom.llm import chat_format as C
from geneloom.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import DATA, connect, same

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<<SYS>>")
said = st.lists(st.sampled_from([*CONTROL, "\\", "<", "[", "]\n", "0a0", "1", "\n", "é", "🙂"]) | st.text(max_size=4), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(said)
def test_escape_is_reversible_and_breaks_control_strings(text):
    escaped = C.escape(text)
    assert C.unescape(escaped) == text
    assert not any(c in escaped for c in CONTROL)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "<s>"]), said), max_size=6))
def test_spans_cover_the_output_and_find_each_text(turns):
    output, found = C.spans(turns, C.marked_template)
    assert output == C.marked_template(turns) and C.parse_marked(output) == turns
    assert [s[0] for s in found] + [len(output)] == [0] + [s[1] for s in found]
    assert [C.unescape(output[a:b]) for _, _, a, b in found] == [t for _, t in turns]


def test_other_templates():
    plain = lambda turns: "BOS" + "".join(f"{r}: {t}\n" for r, t in turns)
    output, found = C.spans([("u", "hi"), ("a", "yo")], plain)
    assert output == "BOSu: hi\na: yo\n" and [output[a:b] for _, _, a, b in found] == ["hi", "yo"]


def test_templates_that_rewrite_history_are_found():
    forgets = lambda turns: "".join(f"<{r}>{t if i == len(turns) - 1 else '...'}" for i, (r, t) in enumerate(turns))
    assert C.spans([("u", "hi"), ("a", "yo")], forgets)[1] is None
    counts = lambda turns: f"{len(turns)} turns" + "".join(t for _, t in turns)
    assert C.spans([("u", "hi")], counts)[1] is None
    strips = lambda turns: "".join(f"<{r}>{t.strip()}|" for r, t in turns)
    assert C.spans([("u", " hi ")], strips)[1] is not None


SCHEMA = "conv_id long, turn long, role string, text string, formatted string, id long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_table(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (2, 0, "assistant", None), (3, 0, None, "x"), (3, 0, None, "x"), (3, None, "user", "first"), (None, 0, "assistant", "lost"), (4, 0, "assistant", "y" * 100_000)]
    random.Random(1).shuffle(rows)
    found = {r["conv_id"]: r for r in C.format_conversations(table(spark, rows)).collect()}
    assert {k: C.parse_marked(r["formatted"]) for k, r in found.items()} == {
        1: [("user", "a"), ("assistant", "b</s>")], 2: [("assistant", "")], 3: [("user", "first"), ("", "x"), ("", "x")], None: [("assistant", "lost")], 4: [("assistant", "y" * 100_000)],
    }
    loss = {k: [C.unescape(r["formatted"][a:b]) for a, b in zip(r["loss_starts"], r["loss_ends"])] for k, r in found.items()}
    assert loss == {1: ["b</s>"], 2: [""], 3: [], None: ["lost"], 4: ["y" * 100_000]}
    assert not any(r["rewrites_history"] for r in found.values())


def test_rewriting_template_gives_no_mask(spark):
    last = lambda turns: turns[-1][1] if turns else ""
    (r,) = C.format_conversations(table(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b")]), last).collect()
    assert r["rewrites_history"] and r["loss_starts"] is None and r["formatted"] == "b"


def test_empty_table(spark):
    assert C.format_conversations(table(spark, [])).collect() == []


def test_query_matches_sql(spark):
    frame = QUERIES["op5_chat_formatting"](spark, DATA)
    same(frame, connect(), ORACLE_SQL["op5_chat_formatting"])
    assert frame.where("conv_id = -7").first()["n_turns"] == 2
