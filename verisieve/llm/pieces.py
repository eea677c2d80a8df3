"""SentencePiece encoding and decoding by streaming Viterbi.

The vocabulary is a byte-fallback BPE model.  For it a prefix of a text has
exactly one encoding, and whether a piece may end it depends on the piece
before alone: the two must be what the merges make of their joined letters.  So
a Viterbi pass keeps, for each boundary, a pointer to the one before, and needs
only the window of boundaries that a longest piece reaches back.  Whenever the
paths of all boundaries in that window meet in one boundary, the ids up to it
are final and are committed.

Texts are streamed in slices.  White space starts a piece and never stands
inside one, so at its boundaries all paths meet and the word before is
committed; a bounded memory of words answers most of them, and the window
passes over the others.  Where a vocabulary has pieces with inner white space,
the window passes over whole texts.

Defined results: a null text has null ids; an empty text has none; decoding
gives back every text exactly, except that U+2581, by which the vocabulary
writes a space, comes back as a space; repeated rows are encoded each; an empty
table gives an empty result; further columns, also ones named like the
results, do not matter.  Texts are encoded whole, in memory that a text's own
ids bound.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lists_of_ints, process_wide, with_arrow_columns

SPACE = "▁"
#: Bounds of the memory: of words, of a word's characters, and of pairs of pieces.
WORDS, WORD_CHARS, PAIRS = 300_000, 48, 500_000
#: Characters of a slice of a text.
SLICE = 1 << 16


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, their scores, and which are single bytes or control pieces."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    control: frozenset[int]
    dummy_prefix: bool = True


def load(model_file: str) -> Vocabulary:
    """Reads a model file of the sentencepiece library; one without normalisation and with byte fallback."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(model_file, "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or m.trainer_spec.model_type != pb.TrainerSpec.BPE or not m.trainer_spec.byte_fallback:
        raise ValueError("not a byte-fallback BPE model without normalisation")
    at = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == pb.ModelProto.SentencePiece.BYTE}
    control = frozenset(i for i, p in enumerate(m.pieces) if p.type != pb.ModelProto.SentencePiece.NORMAL)
    return Vocabulary(tuple(p.piece for p in m.pieces), tuple(p.score for p in m.pieces), tuple(at[b] for b in range(256)), control, m.normalizer_spec.add_dummy_prefix)


class Codec(dict):
    """Encodes and decodes; as a dict it is the bounded memory from words to their ids as bytes."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v = v
        self.ids = {p: i for i, p in enumerate(v.pieces) if i not in v.control}
        self.longest = max(map(len, self.ids))
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # every beginning of a piece, and whether it is a piece itself
        self.begins = {p[:k]: p[:k] in self.ids for p in self.ids for k in range(1, len(p) + 1)}
        self.older: dict[str, bytes] = {}
        # neighbours that some piece has: between others no merge can ever join
        self.joins = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.parts: dict[str, bytes] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.alone: dict[str, bool] = {}
        self.fallback = {}
        bytes_of = [b"" if i in v.control else p.replace(SPACE, " ").encode() for i, p in enumerate(v.pieces)]
        for b, i in enumerate(v.byte_ids):
            bytes_of[i] = bytes([b])
        self.bytes_of = bytes_of

    def merged(self, text: str) -> list[str]:
        """What the merges make of ``text``: the best-scored neighbours first, the left ones of equals."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        ids, scores = self.ids, self.v.scores
        heap = [(-scores[ids[a + b]], i, a + b) for i, (a, b) in enumerate(zip(text, text[1:])) if a + b in ids]
        heapify(heap)
        while heap:
            _, i, whole = heappop(heap)
            j = right[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j], right[i] = whole, None, right[j]
            if right[j] < len(parts):
                left[right[j]] = i
                if (n := whole + parts[right[j]]) in ids:
                    heappush(heap, (-scores[ids[n]], i, n))
            if left[i] >= 0 and (n := parts[left[i]] + whole) in ids:
                heappush(heap, (-scores[ids[n]], left[i], n))
        return [p for p in parts if p is not None]

    def may_begin(self, piece: str) -> bool:
        known = self.alone.get(piece)
        if known is None:
            known = self.alone[piece] = self.merged(piece) == [piece]
        return known

    def may_follow(self, a: str, b: str) -> bool:
        after = self.pairs.get(a)
        if after is None:
            after = self.pairs[a] = {}
        known = after.get(b)
        if known is None:
            if self.n_pairs > PAIRS:
                self.pairs.clear()
                self.n_pairs, after = 0, self.pairs.setdefault(a, {})
            known = after[b] = self.merged(a + b) == [a, b]
            self.n_pairs += 1
        return known

    def _ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [self.v.byte_ids[b] for b in piece.encode("utf-8", "replace")] if i is None else [i]

    def stream(self, slices: Iterable[str]) -> Iterator[bytes]:
        """Ids, as 32-bit integers, of a text in slices, each committed as soon as no later character can change it.

        Holds the word that a slice ends in, and of a long one only its window.
        """
        tail, window, begun = "", None, False
        for s in slices:
            if not s:
                continue
            if not self.apart or not self.v.dummy_prefix:
                if window is None:
                    window = Window(self)
                    s = (SPACE if self.v.dummy_prefix else "") + s
                yield window.feed(s.replace(" ", SPACE))
                continue
            begun = True
            s = s.replace(SPACE, " ")
            if window is not None:
                end = s.find(" ")
                yield window.feed(s if end < 0 else s[:end], end >= 0)
                if end < 0:
                    continue
                window, s = None, s[end + 1 :]
            words = (tail + s).split(" ")
            last = len(words) - 1
            while last and not words[last - 1]:  # spaces in a row go with the word behind them
                last -= 1
            yield self._words(words[:last])
            tail = " ".join(words[last:])
            if len(tail) > 4 * self.longest and tail[-1] != " ":
                window = Window(self)
                yield window.feed(SPACE + tail.replace(" ", SPACE))
                tail = ""
        if window is not None:
            yield window.feed("", True)
        elif begun:
            yield self._words(tail.split(" "))

    def _words(self, words: list[str]) -> bytes:
        """The ids of whole words, each with the space before it; an empty one is a space that goes with the next word."""
        if "" not in words:
            return b"".join(map(self.__getitem__, words))
        spaced = SPACE + SPACE.join(words)
        return b"".join(self[w[1:]] if w[1:2] != SPACE and len(w) > 1 else self._parted(w) for w in re.findall(f"{SPACE}+[^{SPACE}]*", spaced))

    def _pass(self, part: str) -> bytes:
        return Window(self).feed(part, True)

    def _parted(self, word: str) -> bytes:
        """The ids of a word, part by part: it is cut where no piece has both neighbours."""
        joins = self.joins
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joins]
        if not cuts:
            return self._pass(word)
        out, at = [], 0
        for end in [*cuts, len(word)]:
            part = word[at:end]
            got = self.parts.get(part)
            if got is None:
                got = self._pass(part)
                if len(part) <= WORD_CHARS:
                    if len(self.parts) >= WORDS:
                        self.parts.clear()
                    self.parts[part] = got
            out.append(got)
            at = end
        return b"".join(out)

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word) or self._parted(SPACE + word)
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS:  # words not asked for since the last time go
                self.older = dict(self)
                self.clear()
            self[word] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        """The ids of one whole text."""
        return np.frombuffer(b"".join(self.stream([text] if len(text) <= SLICE else (text[i : i + SLICE] for i in range(0, len(text), SLICE)))), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.v.dummy_prefix and text[:1] == " " else text


class Window:
    """The Viterbi pass over a stretch of characters: the boundaries that are not committed yet, each with the piece that ends there."""

    __slots__ = ("codec", "text", "last", "at")

    def __init__(self, codec: Codec):
        self.codec, self.text, self.at = codec, "", 0
        self.last: list[str | None] = [None]

    def feed(self, chars: str, final: bool = False) -> bytes:
        """Takes further characters; the ids that are committed, with ``final`` all of them."""
        c = self.codec
        ids, begins, pairs, longest = c.ids, c.begins.get, c.pairs, c.longest
        text = self.text = self.text + chars
        last, n = self.last, len(text)
        last.extend([None] * len(chars))
        out: list[int] = []
        # a boundary is passed once all pieces that begin there can be seen
        stop, i = n if final else n - longest, self.at
        while i < stop:
            if i >= 4 * longest and i % longest == 0:
                i = self._commit(i, out)
                text, last = self.text, self.last
                n, stop = len(text), stop - (n - len(text))
            if text[i] not in ids:
                last[i + 1] = text[i]
            before = last[i]
            after = pairs.get(before) if before is not None else None
            for j in range(i + 1, n + 1):
                piece = text[i:j]
                whole = begins(piece)
                if whole is None:
                    break
                if whole and last[j] is None:
                    if before is None:
                        if c.may_begin(piece):
                            last[j] = piece
                    else:
                        known = after.get(piece) if after is not None else None
                        if known or known is None and c.may_follow(before, piece):
                            last[j] = piece
            i += 1
        self.at = i
        if final:
            self._path(n, out)
            self.text, self.last, self.at = "", [None], 0
        return array("i", out).tobytes()

    def _path(self, end: int, out: list[int]) -> None:
        """Appends the ids of the pieces up to a boundary."""
        found = []
        while end > 0:
            piece = self.last[end]
            found.append(piece)
            end -= len(piece)
        for piece in reversed(found):
            i = self.codec.ids.get(piece)
            if i is None:
                out += self.codec._ids(piece)
            else:
                out.append(i)

    def _commit(self, at: int, out: list[int]) -> int:
        """Commits up to the boundary in which the paths of all that a later piece may begin at meet; where ``at`` is then."""
        alive = set(range(max(0, at - self.codec.longest + 1), at + 1))
        while len(alive) > 1:
            furthest = max(alive)
            alive.remove(furthest)
            alive.add(furthest - len(self.last[furthest]))
        (met,) = alive
        if met > 0:
            self._path(met, out)
            self.text, self.last = self.text[met:], self.last[met:]
        return at - met


def _codecs(docs: DataFrame, model_file: str) -> Callable[[], Codec]:
    vocabulary = load(model_file)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = hashlib.sha256(repr((vocabulary.pieces, vocabulary.scores, vocabulary.byte_ids, vocabulary.dummy_prefix)).encode("utf-8", "replace")).hexdigest()
    return lambda: process_wide(f"pieces {key}", lambda: Codec(shared.value))


def encode(docs: DataFrame, model_file: str, out: str = "ids", text: str = "text") -> DataFrame:
    """Adds ``out``: the ids of each whole text."""
    codec = _codecs(docs, model_file)

    def make() -> Callable[[list], list[pa.Array]]:
        c = codec()
        return lambda texts: [lists_of_ints([None if x is None else c.encode(x) for x in texts])]

    return with_arrow_columns(docs, text, [T.StructField(out, T.ArrayType(T.IntegerType()))], make)


def decode(docs: DataFrame, model_file: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds ``out``: the text of each row's ids."""
    codec = _codecs(docs, model_file)

    def make() -> Callable[[list], list[pa.Array]]:
        c = codec()
        return lambda rows: [pa.array([None if x is None else c.decode(x) for x in rows], pa.string())]

    return with_arrow_columns(docs, ids, [T.StructField(out, T.StringType())], make)


ENCODED = [T.StructField("n_ids", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]


def round_trip(docs: DataFrame, model_file: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The query's rows: the columns ``keep``, n_ids, ids_sha256 (of little-endian 32-bit ids), round_trip, ids.

    ``round_trip`` says whether decoding the ids gave the text back.
    """
    codec = _codecs(docs, model_file)

    def make() -> Callable[[list], list[pa.Array]]:
        c = codec()

        def both(texts: list) -> list[pa.Array]:
            ids = [None if x is None else c.encode(x) for x in texts]
            return [
                pa.array([None if i is None else len(i) for i in ids], pa.int64()),
                pa.array([None if i is None else hashlib.sha256(i.astype("<i4").tobytes()).hexdigest() for i in ids], pa.string()),
                pa.array([None if i is None else c.decode(i.tolist()) == x for i, x in zip(ids, texts)], pa.bool_()),
                lists_of_ints(ids),
            ]

        return both

    return with_arrow_columns(docs, "text", ENCODED, make, keep=list(keep))
