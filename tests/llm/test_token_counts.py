import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from geneloom.llm.token_counts import TokenCounter, count_tokens
from tests.llm.fixtures import rows_by_id, table, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(PATH)


def test_any_text_counts_as_the_library_counts(library, counter):
    pieces = st.sampled_from(["<|endoftext|>", " the", "aaaa", "'ll", "\n\n", "  ", "é", "日本", "🙂", "\x1c", "\xa0", "12", "!!"])
    text = st.lists(pieces | st.text(max_size=5), max_size=30).map("".join)

    @settings(max_examples=300, deadline=None)
    @given(text)
    def check(t):
        t = t.encode("utf-8", "ignore").decode()
        assert counter([t]) == [len(library.encode(t, add_special_tokens=False).ids)]

    check()


def test_table(spark, library):
    rows = texts()
    found = rows_by_id(count_tokens(table(spark, rows), PATH, limit=20))
    assert sum(map(len, found.values())) == len(rows)
    for i, t in rows:
        if i is not None:
            for r in found[i]:
                n = len(library.encode(t or "", add_special_tokens=False).ids)
                assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 20)


def test_long_texts_and_a_full_memory(counter, library):
    long = ["a" * 50_000, "ab" * 30_000 + " " * 900, "x y " * 20_000]
    counter.known = {str(i): 1 for i in range(counter.LIMIT + 1)}
    assert counter(long) == [len(e.ids) for e in library.encode_batch(long, add_special_tokens=False)]
    assert all(len(w) <= counter.SHORT for w in counter.known)


def test_long_sequences_merge_as_short_ones_do(counter):
    """The heap for one long sequence and the rounds for many short ones give the same counts."""
    import random

    rng = random.Random(2)
    words = ["".join(rng.choice("etaoin shr") for _ in range(rng.randrange(1, 200))).encode() for _ in range(200)] + [b"a" * n for n in range(1, 40)]
    assert [counter.merger.count_long(w) for w in words] == counter.merger.count_short(words).tolist()


def test_one_long_word_takes_time_in_proportion(counter, library):
    import random
    import time

    rng = random.Random(3)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    began = time.perf_counter()
    (n,) = counter([word])
    assert time.perf_counter() - began < 120
    part = word[:20_000]
    assert counter([part]) == [len(library.encode(part, add_special_tokens=False).ids)] and n > 300_000
    text = " ".join(word[i : i + 5] for i in range(0, 1_000_000, 5)) + "<|endoftext|>x"
    assert len(text) > counter.LONG_TEXT and counter([text]) == [len(library.encode(text, add_special_tokens=False).ids)]


def test_empty_table(spark):
    assert count_tokens(table(spark, []), PATH).collect() == []
