"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

A text is marked (a space becomes U+2581, one is put before the text) and cut before each run of marks and before each
run of characters that no piece holds right after a letter; as no piece spans a cut, the best segmentation of a text is
that of its marked words. The distinct marked words of a batch are sorted, which walks their trie depth-first: each word goes on from the forward scores of the
prefix it shares with the word before. The segmentation is the one of the highest sum of piece scores, as
the model's own library finds in its unigram mode; characters without a piece become their UTF-8 byte pieces.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Batches, added, as_text, prepare, sha256_hex, texts_of, tidied

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model file
UNKNOWN_PENALTY = 10.0
#: Stands for a mark that the text itself holds, while it is cut: it is always written as bytes. A lone surrogate is in no text.
OWN_MARK = "\udc00"


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) pairs of a protocol buffer message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value, shift, i = value | (byte & 127) << shift, shift + 7, i + 1
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = number(i)
        if key & 7 == 0:
            value, i = number(i)
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            if size is None:
                size, i = number(i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


class PieceModel:
    """Pieces, scores and types of a model file."""

    LIMIT, SHORT, CHARS = 100_000, 48, 1 << 20

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            whole = list(fields(f.read()))
        raw = [dict(fields(v)) for n, v in whole if n == 1]
        normal = {k: v for n, v in whole if n == 3 for k, v in fields(v)}  # 2: character map, 3: space before, 4: spaces drawn together, 5: marks for spaces
        if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("the model's normalizer changes texts or sets no mark, which is not built here")
        self.pieces = [p[1].decode() for p in raw]
        kinds = [p.get(3, NORMAL) for p in raw]
        scores = [struct.unpack("<f", p[2])[0] for p in raw]
        self.scores = {p: (s, i) for i, (p, k, s) in enumerate(zip(self.pieces, kinds, scores)) if k in (NORMAL, USER)}
        if any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError("a piece holds a mark after another character; words can't be cut at marks")
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces, so decoding can't be exact")
        self.byte_of = {i: b for b, i in self.bytes.items()}
        #: What each id decodes to.
        self.said = [bytes([self.byte_of[i]]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode() for i, (p, k) in enumerate(zip(self.pieces, kinds))]
        self.trie: dict = {}
        for p, piece in self.scores.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = piece
        self.unknown = min(s for s, _ in self.scores.values()) - UNKNOWN_PENALTY
        self.words = self.cuts()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def cuts(self) -> re.Pattern:
        """What one marked word matches. Texts are cut before marks, and before what isn't a letter where no piece holds such a character right after a letter."""
        other = {c for p in self.scores for c in p if not c.isalpha()} - {MARK}
        if any(a != MARK and a not in other and b in other for p in self.scores for a, b in zip(p, p[1:])):
            return re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        odd = re.escape("".join(sorted(c for c in other if c.isalnum() and not c.isdecimal())))  # such as superscript digits
        letter, rest = rf"[^\W\d_{odd}]", rf"(?:[^\w{MARK}]|[\d_{odd}])"
        return re.compile(f"{MARK}+{rest}*{letter}*|{rest}+{letter}*|{letter}+")

    def search(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) for sorted words. Of equal scores the segmentation with the longer last piece wins."""
        root, unknown = self.trie, self.unknown
        best, back = [0.0], [(0, -1)]  # by end position: score, and (start, id) of the last piece; id -1 is unknown
        open_at: list[list[tuple[int, dict]]] = [[]]  # by end position: the pieces begun and not yet ended, longest first
        before = ""
        for word in words:
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del best[shared + 1 :], back[shared + 1 :], open_at[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                c, top, last, still = word[end - 1], None, None, []
                for start, node in (*open_at[-1], (end - 1, root)):
                    if child := node.get(c):
                        still.append((start, child))
                        if (piece := child.get("")) and (top is None or best[start] + piece[0] > top):
                            top, last = best[start] + piece[0], (start, piece[1])
                if (child := root.get(c)) is None or "" not in child:
                    if top is None or best[end - 1] + unknown > top:
                        top, last = best[end - 1] + unknown, (end - 1, -1)
                best.append(top)
                back.append(last)
                open_at.append(still)
            before, ids, end = word, [], len(word)
            while end:
                start, piece = back[end]
                if piece >= 0:
                    ids.append(piece)
                else:
                    ids += [self.bytes[b] for b in reversed((MARK if word[start] == OWN_MARK else word[start]).encode())]
                end = start
            yield word, ids[::-1]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """int32 ids of each text. The trie is that of all words of about CHARS characters of texts, a longer text being one such part."""
        out: list[np.ndarray] = []
        begin = total = 0
        for i, t in enumerate(texts):
            if total and total + len(t) > self.CHARS:
                out += self.encode_part(texts[begin:i])
                begin, total = i, 0
            total += len(t)
        return out + self.encode_part(texts[begin:])

    def encode_part(self, texts: list[str]) -> list[np.ndarray]:
        """The ids (as bytes) of short words used in the last parts are kept, up to two times LIMIT."""
        if len(self.known) > self.LIMIT:
            self.known, self.older = {}, self.known
        cut = [self.words.findall((MARK + t.replace(MARK, OWN_MARK).replace(" ", MARK)) if t else "") for t in texts]
        now, known, older = {}, self.known, self.older
        for words in cut:
            now.update(dict.fromkeys(words))
        new = []
        for w in now:
            if (ids := known.get(w) or older.get(w)) is None:
                new.append(w)
            else:
                now[w] = ids
        new.sort()
        for word, ids in self.search(new):
            now[word] = struct.pack(f"<{len(ids)}i", *ids)
        if len(now) <= self.LIMIT:  # an unusual batch isn't kept
            known.update((w, ids) for w, ids in now.items() if len(w) <= self.SHORT)
        return [np.frombuffer(b"".join([now[w] for w in words]), "<i4") for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text; ids of control and unknown pieces are dropped, byte pieces that are no UTF-8 become U+FFFD."""
        said = self.said
        text = b"".join([said[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """All columns of docs and ids_col (array<int>; an existing one is replaced).

    A null or empty text has no ids. U+2581 in a text is written as its bytes, so that every text decodes to itself
    (null to empty). Rows with null ids and repeated rows pass through. No shuffle; each batch holds its distinct
    words, a worker keeps the ids of a bounded number of short words.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(ids_col)

    @tidied
    def run(batches: Batches):
        for b in batches:
            ids = model(model_path).encode(texts_of(b.column(text_col)))
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, np.int32)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, flat)], [*b.schema.names, ids_col])

    return docs.mapInArrow(run, added(docs, ids_col, T.ArrayType(T.IntegerType())))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns of rows and text_col (an existing one is replaced); null ids decode to the empty text."""
    prepare(rows.sparkSession)
    rows = rows.drop(text_col)

    @tidied
    def run(batches: Batches):
        for b in batches:
            texts = [model(model_path).decode(np.array(x or [], np.int32)) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, text_col])

    return rows.mapInArrow(run, added(rows, text_col, T.StringType()))


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_ids, ids_sha256 (little-endian int32), decoded_sha256, round_trip (the ids decode to the text).

    A null or empty text has no ids and decodes to the empty text; null ids, ties and repeated rows pass through, one row
    each; other columns are not read. An empty table gives no rows. A worker holds a batch of texts, bounded by bytes, and
    some 80 bytes a word of about PieceModel.CHARS characters of it, or of one longer text.
    """
    prepare(docs.sparkSession)

    @tidied
    def run(batches: Batches):
        pieces = model(model_path)
        for b in batches:
            rows, texts = [], texts_of(b.column(1))
            for t, ids in zip(texts, pieces.encode(texts), strict=True):
                again = pieces.decode(ids)
                rows.append((len(ids), sha256_hex(ids.tobytes()), sha256_hex(again.encode()), again == t))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [id_col, "n_ids", "ids_sha256", "decoded_sha256", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], as_text(docs, text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_ids long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
