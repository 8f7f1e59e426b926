import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from geneloom.llm import sentence_pieces as P
from tests.llm.fixtures import rows_by_id, table, texts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return P.PieceModel(PATH)


@pytest.fixture(scope="module")
def library():
    """The same pieces and scores in the library's unigram mode."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def best_score(pieces, word):
    """The highest score of any segmentation, by plain recursion over ends."""
    best = [0.0]
    for end in range(1, len(word) + 1):
        options = [best[s] + pieces.scores[word[s:end]][0] for s in range(end) if word[s:end] in pieces.scores]
        if word[end - 1] not in pieces.scores:
            options.append(best[end - 1] + pieces.unknown)
        best.append(max(options))
    return best[-1]


def test_every_text_decodes_to_itself(pieces):
    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60))
    def check(t):
        t = t.encode("utf-8", "ignore").decode()
        (ids,) = pieces.encode([t])
        assert pieces.decode(ids) == t

    check()
    for t in ("", " ", "  a ", "▁", " ▁▁ x", "a\x00b", "\n", "\U0010fffe", "x" * 20_000, " " * 500):
        assert pieces.decode(pieces.encode([t])[0]) == t


def test_segmentations_are_the_best(pieces):
    @settings(max_examples=200, deadline=None)
    @given(st.text("theandior s.,'é\n9", min_size=1, max_size=14))
    def check(t):
        (ids,) = pieces.encode([t])
        marked = P.MARK + t.replace(" ", P.MARK)
        known = [i for i in ids.tolist() if i not in pieces.byte_of]
        unknown = sum(c not in pieces.scores for c in marked)
        assert sum(pieces.scores[pieces.pieces[i]][0] for i in known) + unknown * pieces.unknown == pytest.approx(best_score(pieces, marked))

    check()


def test_words_are_the_librarys_best(pieces, library):
    words = sorted({w for _, t in texts() for w in (t or "").split() if w.isascii() and len(w) < 30 and "\x00" not in w} | {"the", "theandon", "hestou", "internationalization", "don't", "3.14", "(abc)"})
    mine = [x.tolist() for x in pieces.encode(words)]
    assert mine == [library.nbest_encode_as_ids(w, 2)[0] for w in words]


def test_shared_prefixes_change_nothing(pieces):
    words = ["▁" + w for w in ("a", "ab", "abandon", "abandoned", "abc", "b", "the", "then", "theoretical")]
    together = dict(pieces.search(sorted(words)))
    assert all(dict(pieces.search([w]))[w] == together[w] for w in words)


def test_table(spark, pieces):
    rows = texts()
    encoded = P.encode(table(spark, rows), PATH)
    assert encoded.columns.count("ids") == 1
    found = rows_by_id(P.decode(encoded, PATH).withColumn("size", F.size("ids")))
    digests = rows_by_id(P.digests(table(spark, rows), PATH))
    for i, t in rows:
        if i is not None:
            ids = pieces.encode([t or ""])[0]
            for r, d in zip(found[i], digests[i]):
                assert r["ids"] == ids.tolist() and r["decoded"] == (t or "")
                assert d["n_ids"] == len(ids) and d["round_trip"] and d["ids_sha256"] == P.sha256_hex(ids.tobytes())


def test_empty_table(spark):
    assert P.encode(table(spark, []), PATH).collect() == [] and P.digests(table(spark, []), PATH).collect() == []
