"""Repeated substrings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np

from verisieve.llm import substrings as s


def brute(texts):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - 199):
            if count[r[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(r)))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng):
    words = ["river", "stone", "é", "garden", "日本", "walk", "the", "of", "x"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    base = [prose(rng.randrange(1, 200)) for _ in range(30)]
    passage = prose(60)
    texts = [None, "", "short", "a" * 199, "a" * 200, "b" * 201, "c" * 1000, "ab" * 300, *base]
    texts += [base[3], base[4] + " tail", base[5].replace("the", "a", 3), prose(20) + passage + prose(30), passage, prose(5) + passage[:250] + prose(5) + passage[100:], base[6] * 3]
    texts += [prose(10) + passage[20:330] + prose(10) for _ in range(40)]
    return texts


def test_operator_matches_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    texts = corpus(rng)
    rows = [(i, t) for i, t in enumerate(texts)] + [(11, texts[11]), (11, "other text of one id"), (None, texts[12]), (None, texts[13])]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_bytes int, anchor string")
    want = sorted(zip([i for i, _ in rows], brute([t for _, t in rows])), key=str)
    got = lambda: sorted(((r["doc_id"], tuple(r)[1:]) for r in s.digest(docs).collect()), key=str)
    assert got() == want
    monkeypatch.setattr(s, "PART", 300)
    monkeypatch.setattr(s, "OFTEN", 4)
    monkeypatch.setattr(s, "LEADERS", 1)
    monkeypatch.setattr(s, "BUFFER", 2000)
    assert got() == want
    assert s.digest(docs.limit(0)).count() == 0
    whole = {r["doc_id"]: r for r in s.remove_repeats(docs).collect() if r["doc_id"] is not None}
    for i, t in rows[:50]:
        if i != 11:
            raw, at, kept = (t or "").encode(), 0, b""
            for x in whole[i]["spans"]:
                kept, at = kept + raw[at : x["start"]], x["end"]
            assert whole[i]["kept"] == kept + raw[at:] and hashlib.sha256(whole[i]["kept"]).hexdigest() == whole[i]["kept_sha256"]


def test_one_window_in_many_contexts(spark, monkeypatch):
    rng = random.Random(7)
    notice = "".join(rng.choice("abcdefghij ") for _ in range(200))
    letters = "klmnopqrstuvwxyz"
    context = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [context(rng.randrange(60)) + notice + context(rng.randrange(60)) for _ in range(3000)]
    texts += [context(150) + notice[:199] + context(100), notice[50:] + context(120), context(20) + notice[:150] + "kkk" + notice[150:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(enumerate(brute(texts)))
    for part, often in ((s.PART, s.OFTEN), (500, 20)):
        monkeypatch.setattr(s, "PART", part)
        monkeypatch.setattr(s, "OFTEN", often)
        assert sorted((r["doc_id"], tuple(r)[1:]) for r in s.digest(docs).collect()) == want


def test_no_part_grows_with_a_common_window(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    notice = bytes(rng.choice(b"abcdefghij ") for _ in range(200))
    context = lambda n: bytes(rng.choice(b"klmnopqrstuvwxyz") for _ in range(n))
    rows = [(5, i.to_bytes(16, "big"), context(rng.randrange(100)) + notice + context(rng.randrange(100)), 1, 20) for i in range(4000)]
    of_hot = spark.createDataFrame(rows, "anchor long, hash binary, stretch binary, n long, parts long")
    monkeypatch.setattr(s, "OFTEN", 200)
    sure = s._by_count(of_hot.coalesce(2))
    whole = {int(x) for x in s._windows(notice)}
    assert whole < set(sure.tolist())
    known = spark.sparkContext.broadcast(sure)
    batch = pa.RecordBatch.from_pydict({"anchor": [5] * 4000, "hash": [r[1] for r in rows], "stretch": [r[2] for r in rows], "n": [1] * 4000, "parts": [20] * 4000})
    judged = [x for b in s._judged_by_count(known)(iter([batch])) for x in b.to_pylist()]
    assert len(judged) == 4000 and all(notice[2:-2] in rows[int.from_bytes(x["hash"], "big")][2][lo : hi + 200] for x in judged for lo, hi in zip(x["ranges"][::2], x["ranges"][1::2]))
    sizes = Counter(p for b in s._dealt(known)(iter([batch])) for p in b.column("part").to_pylist())
    assert max(sizes.values()) <= 3 * sorted(sizes.values())[len(sizes) // 2]


def test_long_texts_are_cut_into_chunks(monkeypatch):
    monkeypatch.setattr(s, "CHUNK", 1000)
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcd") for _ in range(5000))
    row, anchor, first, count = s.stretches([text, b"x", text[700:2000]])
    own = [p for r, f, c in zip(row, first, count) if r == 0 for p in range(f, f + c)]
    assert own == list(range(4801))
    of = {(r, p): a for r, a, f, c in zip(row.tolist(), anchor.tolist(), first.tolist(), count.tolist()) for p in range(f, f + c)}
    assert all(of[2, p] == of[0, p + 700] for p in range(1300 - 199))


def test_sort_finds_equal_windows():
    rng = random.Random(3)
    buffer = b"".join(bytes(rng.choice(b"ab") for _ in range(20)) * 30 + bytes(rng.choice(b"abc") for _ in range(50)) for _ in range(6))
    starts = np.arange(len(buffer) - 199)
    count = Counter(buffer[i : i + 200] for i in starts)
    assert s.repeated(buffer, starts).tolist() == [count[buffer[i : i + 200]] > 1 for i in starts]


def test_blind_trie_orders_and_finds_equals():
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(200)]
    trie, first = s.BlindTrie(), {}
    for i, x in enumerate(strings):
        assert trie.add(x, i) == first.setdefault(x, i)
    assert list(trie.ordered()) == sorted(set(strings))


def test_rolling_hash_tells_strings_apart():
    raw = np.frombuffer(b"the cat the cat the dog", np.uint8)
    for n in (1, 3, 7, 8):
        h = s.rolling(raw, n).tolist()
        assert len(set(h)) == len({raw[i : i + n].tobytes() for i in range(len(raw) - n + 1)})
