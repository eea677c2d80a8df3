"""Spaced seeds against brute force."""

import itertools
import random

from verisieve.llm import decontaminate as d


def test_masks_are_complete():
    for gone in itertools.combinations(range(d.WINDOW), d.WINDOW - d.NEEDED):
        assert any(not set(o + k for k in m) & set(gone) for m in d.MASKS for o in range(d.WINDOW - m[-1]))


def brute(text, item):
    own, words = d.tokens(item), d.tokens(text)
    n = len(own)
    if not n:
        return False
    window = min(d.WINDOW, n)
    needed = -(-window * d.NEEDED // d.WINDOW)
    for shift in range(-n, len(words) + 1):
        same = [0 <= shift + j < len(words) and words[shift + j] == own[j] for j in range(n)]
        if any(sum(same[j : j + window]) >= needed for j in range(n - window + 1)):
            return True
    return False


def sample(rng):
    words = [f"w{i}" for i in range(30)] + ["-", "[w3]", "`w4`", "**w5**", "w6...", "{", "<w7>", "-w8-", "..."]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 8, 11, 12, 15, 30])))) for i in range(25)]
    texts = []
    for _ in range(60):
        t = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        own = rng.choice(items)[1].split()
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(len(own))] = "other"
        at = rng.randrange(len(t) + 1)
        texts.append(" ".join(t[:at] + own[rng.randrange(2) :] + t[at:]))
    return items, texts


def test_overlaps_match_brute_force():
    for seed in range(8):
        items, texts = sample(random.Random(seed))
        found = d.Seeds(items).overlaps(texts)
        for text, got in zip(texts, found):
            assert set(got) == {i for i, item in items if brute(text, item)}


def test_each_item_is_found_in_its_own_text():
    items, _ = sample(random.Random(9))
    for i, text in items:
        own = len(d.tokens(text))
        assert d.Seeds([(i, text)]).overlaps([text]) == [{i: (own, own)} if own else {}]


def test_many_items_with_one_beginning():
    items = [(i, "what is the best answer to this very simple question about " + f"x{i} y{i} z{i} end{i}") for i in range(3000)]
    found = d.Seeds(items).overlaps([items[7][1], "what is the best answer to this very simple question about nothing"])
    assert found[0][7] == (15, 15) and set(found[0]) == set(found[1]) == set(range(3000))


def test_broadcast_and_join_give_the_same_rows(spark):
    items, texts = sample(random.Random(4))
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (0, texts[0]), (902, "x " * 300_000 + items[8][1]), (None, texts[1])]
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id long, text string, item_id string, overlaps string, _text_key string")
    bench = spark.createDataFrame([*items, (None, items[3][1]), (77, None), (78, " .. "), (79, items[8][1]), (8, items[8][1])], "item_id long, text string")
    one, many = (sorted(str(r) for r in d.find_overlaps(docs, bench, block_bytes=n).collect()) for n in (10**6, 10))
    assert one == many and len(one) == len(rows) and sum("item_id=8" in r for r in one) > 1
    assert {r["item_id"] for r in d.leaks(docs, bench).collect() if r["doc_id"] == 902} >= ({8, 79} if d.tokens(items[8][1]) else set())


def test_empty(spark):
    docs, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert d.leaks(docs, some).count() == 0 and d.leaks(full, bench).count() == 0 and d.leaks(full, some).count() == 1


def test_texts_lose_the_same_punctuation_as_items():
    odd = ["[{}]", "`{}`", "*{}*", "**{}**", "<{}>", "{{{}}}", "-{}", "(({}", "{}...", "{}?!", "- {}", "* {} {{"]
    words = [f"w{i}" for i in range(36)]
    for form in odd:
        item = " ".join(form.format(w) if i % 3 == 0 else w for i, w in enumerate(words))
        for source in (item, " ".join(words)):
            for text in (item, " ".join(words)):
                assert d.Seeds([(1, source)]).overlaps([f"some - {text} more"]) == [{1: (36, 36)}], form
    assert d.Seeds([(1, "one [two] three")]).overlaps(["one - `two` (three", "- *", ""]) == [{1: (3, 3)}, {}, {}]
    bullets = " - ".join(words[:17])
    assert d.Seeds([(1, bullets)]).overlaps([bullets]) == [{1: (17, 17)}]


def test_sql_agrees_on_punctuation(spark):
    import pytest

    duckdb = pytest.importorskip("duckdb")
    items, texts = sample(random.Random(5))
    con = duckdb.connect()
    for name, rows in (("documents", [*enumerate(texts), (90, None), (91, "")]), ("benchmark", items)):
        con.execute(f"create table {name}({'doc_id' if name == 'documents' else 'item_id'} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    docs = spark.createDataFrame([*enumerate(texts), (90, None), (91, "")], "doc_id long, text string")
    want = sorted(con.execute(f"select doc_id, item_id, n_matched, n_tokens from ({d.oracle()})").fetchall())
    assert sorted(map(tuple, d.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect())) == want and len(want) > 60
