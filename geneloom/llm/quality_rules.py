"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it, so the order of the rules never changes a verdict, only its cost. Each rule's
cost and rejection rate are measured on a bounded sample; the rules then run in the order of rejections per cost,
and a document leaves the cascade at the first rule that rejects it. Features shared by rules are computed once a
document, when first asked for.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Batches, added, as_text, bounded_sample, prepare, texts_of, tidied

SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LETTERS = UPPER + UPPER.lower()
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


class Features:
    """Counts of one whole text; each is computed when first used. Words are runs of other than ASCII white space."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\v\f\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> tuple[int, int]:
        """(lines with a word, those equal to an earlier line)."""
        lines = [x for x in self.raw.split(b"\n") if x and not x.isspace()]
        return len(lines), len(lines) - len(set(lines))

    @property
    def n_dup_lines(self) -> int:
        return self.lines[1]

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three words that the text holds twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        counts, covered, end = Counter(windows), 0, 0
        for i, x in enumerate(windows):
            if counts[x] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered

    @cached_property
    def upper(self) -> tuple[int, int]:
        """(A-Z, A-Z and a-z)."""
        n = len(self.raw)
        return n - len(self.raw.translate(None, UPPER)), n - len(self.raw.translate(None, LETTERS))

    @cached_property
    def n_letter_words(self) -> int:
        """Words with an ASCII letter or a character beyond ASCII."""
        return sum(1 for found in map(LETTER.search, self.words) if found)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


BASE_RULES = (
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
)
RULES = (
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("word_length", lambda f: not 3 * f.n_words <= f.word_chars <= 10 * f.n_words),
    Rule("repeated_lines", lambda f: 2 * f.lines[1] > f.lines[0]),
    Rule("upper_case", lambda f: 2 * f.upper[0] > f.upper[1]),
    Rule("letter_words", lambda f: 10 * f.n_letter_words < 8 * f.n_words),
)


def measure(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text", sample_rows: int = 400, counted: bool = False) -> dict[str, tuple[float, float]]:
    """Rule -> (seconds a document, share rejected) on a sample of at most sample_rows documents.

    Rules run on fresh features in turn, so that each bears the whole cost of what it needs. With `counted` the features
    that counts() reads are there already and documents that a base rule rejects are left out, as in judge with counts. The
    sample is the only bounded part: it decides the order of the rules and nothing else.
    """
    texts, found = bounded_sample(docs.select(as_text(docs, text_col)), sample_rows, 1 << 16), {}
    if counted:
        texts = [t for t in texts if first_rejection(Features(t), BASE_RULES) is None]
    for rule in rules if texts else ():
        seconds = rejected = 0.0
        for t in texts:
            f = Features(t)
            if counted:
                base_counts(f)
            began = time.perf_counter()
            rejected += rule.rejects(f)
            seconds += time.perf_counter() - began
        found[rule.name] = (seconds / len(texts), rejected / len(texts))
    return found


def plan(rules: tuple[Rule, ...], measured: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """Rules by rejections per cost, the most first; rules without figures keep their place at the end."""
    rate = {n: rejected / max(seconds, 1e-9) for n, (seconds, rejected) in measured.items()}
    return tuple(sorted(rules, key=lambda r: -rate.get(r.name, -1.0)))


def first_rejection(features: Features, cascade: tuple[Rule, ...]) -> str | None:
    return next((r.name for r in cascade if r.rejects(features)), None)


def base_counts(f: Features) -> tuple[int, int, int, int, int]:
    return f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words


def judge(docs: DataFrame, counts: bool = False, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 400, verdict_col: str = "kept") -> DataFrame:
    """All columns of docs and verdict_col; with counts, only the id, the counts, base_failed and kept.

    A null or empty text has no words and is rejected. Null ids, ties and repeated rows pass through, a verdict each.
    With counts, every count is computed for every row and only documents that pass the base rules enter the cascade
    of the others; else base rules are part of the cascade. No shuffle. An existing column of the verdict's
    name is replaced. The work on a text grows in proportion to its length, also if it is one word.
    """
    prepare(docs.sparkSession)
    rules = RULES if counts else (*BASE_RULES, *RULES)
    cascade = plan(rules, measure(docs, rules, text_col, sample_rows, counts))

    @tidied
    def verdicts(batches: Batches):
        for b in batches:
            kept = [first_rejection(Features(t), cascade) is None for t in texts_of(b.column(text_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kept, pa.bool_())], [*b.schema.names, verdict_col])

    @tidied
    def all_counts(batches: Batches):
        for b in batches:
            rows = []
            for t in texts_of(b.column(1)):
                f = Features(t)
                failed = any(r.rejects(f) for r in BASE_RULES)
                rows.append((*base_counts(f), failed, not failed and first_rejection(f, cascade) is None))
            kinds = (*[pa.int64()] * 5, pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    if counts:
        names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
        kind = docs.schema[id_col].dataType.simpleString()
        return docs.select(docs[id_col], as_text(docs, text_col)).mapInArrow(all_counts, f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
    docs = docs.drop(verdict_col)
    return docs.mapInArrow(verdicts, added(docs, verdict_col, T.BooleanType()))
