"""Streaming Viterbi against the sentencepiece library, and exact round trips."""

import random

import numpy as np
import pytest

from verisieve.llm import pieces
from verisieve.llm.queries import tokenizer_file

spm = pytest.importorskip("sentencepiece")
FILE = tokenizer_file()
ALPHABET = ["a", "b", "e", "t", "h", "▁", " ", "  ", "\n", "日", "é", "ñ", "\x00", "0", "---", "****", "ing", "tion", "THE", "=", "\t", "\U0001f600"]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.load(FILE))


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=FILE)


def streamed(codec, slices):
    return np.frombuffer(b"".join(codec.stream(slices)), np.int32).tolist()


def test_ids_equal_the_library_s(codec, library):
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 40)))
        want = library.encode(text)
        assert codec.encode(text).tolist() == want, text
        assert streamed(codec, (text[i : i + 3] for i in range(0, len(text), 3))) == want, text
        assert codec.decode(want) == text.replace("▁", " ") == library.decode(want)


@pytest.mark.parametrize("alphabet", ["abcdefgh ", "abcdefgh", "aab日", "x"])
def test_stream_commits_before_the_end_and_holds_a_window(codec, library, alphabet):
    rng = random.Random(6)
    text = "".join(rng.choice(alphabet) for _ in range(8000)).strip()
    got, read, held = [], 0, 0
    for s in (text[i : i + 50] for i in range(0, len(text), 50)):
        read += 1
        got.append(s)
    window, ids = pieces.Window(codec), []
    for s in ("▁" + text.replace(" ", "▁")[i : i + 50] if i == 0 else text.replace(" ", "▁")[i : i + 50] for i in range(0, len(text), 50)):
        ids.append(window.feed(s))
        held = max(held, len(window.text))
    ids.append(window.feed("", True))
    assert np.frombuffer(b"".join(ids), np.int32).tolist() == library.encode(text) == streamed(codec, got) == codec.encode(text).tolist()
    assert held < 10 * codec.longest + 50 and sum(map(bool, ids)) > 10


def test_slices_end_anywhere(codec, library, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(pieces, "SLICE", 37)
    for _ in range(200):
        text = "".join(rng.choice(ALPHABET + ["abcdefgh" * 30, "   "]) for _ in range(rng.randrange(0, 60)))
        assert codec.encode(text).tolist() == library.encode(text), text


def test_words_fall_out_of_a_full_memory(codec, library, monkeypatch):
    monkeypatch.setattr(pieces, "WORDS", 5)
    own = pieces.Codec(codec.v)
    text = "the cat and the dog saw nine other cats near the house " * 3 + "end"
    assert own.encode(text).tolist() == library.encode(text) and len(own) <= 5


def test_operator_on_odd_rows(spark, library):
    texts = [None, "", " ", "two  spaces ", "x" * 200_000, "a\nb\tc", "same", "same"]
    docs = spark.createDataFrame([(i, t, "n", "i") for i, t in enumerate(texts)], "doc_id long, text string, n_ids string, ids string")
    rows = {r["doc_id"]: r for r in pieces.round_trip(docs, FILE).collect()}
    assert rows[0]["ids"] is None and rows[0]["n_ids"] is None and rows[1]["ids"] == [] and rows[1]["round_trip"]
    for i, t in enumerate(texts[1:], 1):
        assert rows[i]["ids"] == library.encode(t) and rows[i]["n_ids"] == len(rows[i]["ids"]) and rows[i]["round_trip"]
    back = pieces.decode(pieces.encode(docs, FILE, out="code"), FILE, ids="code", out="back").orderBy("doc_id").collect()
    assert [r["back"] for r in back] == texts
    assert pieces.round_trip(docs.limit(0), FILE).count() == 0
