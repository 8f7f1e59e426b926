"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string. The operator knows nothing else about it:
it renders the successive prefixes of a conversation, compares consecutive outputs to find the span that each turn
added, and probes the turn with two other texts to find where the turn's own text lies inside its span. A template whose
output for a longer prefix does not begin with the output for the shorter one rewrites history; it is reported, and
the conversation gets no loss mask.
"""

from __future__ import annotations

from collections.abc import Callable
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, prepare, tidied

Turns = list[tuple[str, str]]


def escape(text: str) -> str:
    r"""Breaks every control string: \ is doubled, and < and [ get a \ behind them, so that none of <s>, </s>, <|...|>, [INST] or [/INST] stays whole."""
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    """Inverse of escape: what follows a kept character in pairs is dropped."""
    out, i = [], 0
    while i < len(text):
        out.append(text[i])
        if text[i] in "\\<[":
            if text[i + 1 : i + 2] != "\\":
                raise ValueError("not an escaped text")
            i += 1
        i += 1
    return "".join(out)


def marked_template(turns: Turns) -> str:
    """The standard template: <s>[role] text </s> per turn, with escaped roles and texts."""
    return "".join(f"<s>[{escape(role)}]\n{escape(text)}</s>\n" for role, text in turns)


def parse_marked(output: str) -> Turns:
    """Reads the standard template's output back."""
    turns = []
    for part in output.split("</s>\n")[:-1]:
        head, _, body = part.partition("]\n")
        if not head.startswith("<s>["):
            raise ValueError("not the output of the marked template")
        turns.append((unescape(head[4:]), unescape(body)))
    return turns


def spans(turns: Turns, template: Callable[[Turns], str]) -> tuple[str, list[tuple[int, int, int, int]] | None]:
    """(output, a (start, end, text_start, text_end) per turn), or None for spans if the template rewrites history.

    Each prefix is rendered once with the turn's text and once with each of two probes that differ in their first and
    last characters; what the probes' outputs share at either end is the turn's frame, the rest is its text.
    """
    before, out = template([]), []
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        a, b = (template([*turns[:k], (role, probe)]) for probe in ("0a0", "1b1"))
        if not all(x.startswith(before) for x in (now, a, b)):
            return template(turns), None
        n = len(before)
        head = len(commonprefix([a[n:], b[n:]]))
        tail = len(commonprefix([a[n:][::-1], b[n:][::-1]]))
        if len(now) - n < head + tail or now[n : n + head] != a[n : n + head] or now[len(now) - tail :] != a[len(a) - tail :]:
            return template(turns), None
        out.append((n, len(now), n + head, len(now) - tail))
        before = now
    return before, out


def as_conversations(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns): the rows of each id in order of turn, ties by role and text; null roles and texts are empty."""
    turn = F.struct(rows["turn"].cast("long").alias("turn"), F.coalesce(rows["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(rows["text"].cast("string"), F.lit("")).alias("text"))
    return rows.select(rows[id_col].alias("id"), turn.alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def format_conversations(rows: DataFrame, template: Callable[[Turns], str] = marked_template, loss_role: str = "assistant", id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: id, formatted, starts/ends (each turn's span), loss_starts/loss_ends, rewrites_history.

    Input columns: id, turn, role, text; others are not read. Turns with null numbers come first; equal numbers are
    ordered by role and text, and repeated rows are kept as turns of their own. Null roles and texts are empty. Rows
    with a null id form one conversation. A conversation is one row and one unit of work, its length bounds the
    memory; the rows are dealt once, by id. An empty table gives no rows. If the template rewrites history, the span
    lists are null and rewrites_history is true.
    """
    prepare(rows.sparkSession)

    @tidied
    def run(batches: Batches):
        for b in batches:
            made = []
            for turns in b.column(1).to_pylist():
                pairs = [(t["role"], t["text"]) for t in turns]
                text, found = spans(pairs, template)
                loss = None if found is None else [(s, e) for (role, _), (_, _, s, e) in zip(pairs, found, strict=True) if role == loss_role]
                made.append((text, found, loss))
            lists = [pa.array([None if x is None else [y[i] for y in x] for x in column], pa.list_(pa.int64())) for column, i in (([m[1] for m in made], 0), ([m[1] for m in made], 1), ([m[2] for m in made], 0), ([m[2] for m in made], 1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([m[0] for m in made], pa.string()), *lists, pa.array([m[1] is None for m in made], pa.bool_())],
                [id_col, "formatted", "starts", "ends", "loss_starts", "loss_ends", "rewrites_history"],
            )

    kind = rows.schema[id_col].dataType.simpleString()
    return as_conversations(rows, id_col).mapInArrow(run, f"`{id_col}` {kind}, formatted string, starts array<long>, ends array<long>, loss_starts array<long>, loss_ends array<long>, rewrites_history boolean")
