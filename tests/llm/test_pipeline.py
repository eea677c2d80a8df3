"""The pipeline's stages, each against a plain version."""

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verisieve.llm import decontaminate, quality, simhash
from verisieve.llm.queries import tokenizer_file

sentencepiece = pytest.importorskip("sentencepiece")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path):
    rng = random.Random(7)
    words = ["river", "stone", "and", "the", "of", "house", "garden", "walked", "slowly", "morning", "light", "people", "under", "bridge", "quiet", "music"]
    prose = lambda n: " ".join(rng.choice(words) + ("" if rng.random() < 0.7 else str(rng.randrange(99))) for _ in range(n)).capitalize() + "."
    item = prose(30)
    rows, labels = [], []
    for i in range(90):
        bad = i % 3 == 0
        text = " ".join(w.upper() + "!!" for w in prose(60).split()) if bad else prose(120)
        rows.append((i, text))
        labels.append((i, 0 if bad else 1, 0))
    good = [t for i, t in rows if i % 3]
    rows += [(200, good[0]), (201, good[1].replace(" the ", " a ", 1)), (202, prose(40) + " " + item + " " + prose(40)), (203, prose(100) + " mail joe@example.com or 4111 1111 1111 1111 now"), (204, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return dict(rows), item


def test_stages(spark, tmp_path):
    rows, item = write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/out{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/out{len(seen)}")
        seen.append({r["doc_id"]: r for r in docs.collect()})
    good = {i for i in rows if (i >= 200 and rows[i]) or i % 3 and i < 90}
    assert set(seen[0]) - {204} == good
    assert good - set(seen[1]) == {200, 201}
    assert set(seen[1]) - set(seen[2]) == {202} and decontaminate.Seeds([(1, item)]).overlaps([rows[202]])[0]
    assert seen[3][203]["text"].endswith("mail [EMAIL] or [CARD] now") and seen[3][203]["n_chars"] == len(seen[3][203]["text"])
    assert all(seen[3][i]["text"] == rows[i] for i in seen[3] if i != 203)
    assert set(seen[4]) == set(seen[3]) and all(r["round_trip"] for r in seen[4].values() if r["n_ids"] is not None)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen[4])
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][1] == "SimHash near-dedup"


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage's whole result over what its predecessor kept, row by row."""
    sys.path.insert(0, str(Path(__file__).parent))
    from test_decontaminate import brute as leaks
    from test_native import base_pii

    rows, item = write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = quality.learn(docs, labels)
    steps = [(stage, f"{tmp_path}/step{n}") for n, (_, stage) in enumerate(corpus_pipeline.STAGES)]
    got = []
    for stage, path in steps:
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        got.append({r["doc_id"]: r for r in docs.collect()})
    texts = {i: t for i, t in rows.items() if float(model.score(quality.features(t)[None])[0]) >= 0.5}
    assert {i: r["text"] for i, r in got[0].items()} == texts
    sets = {i: simhash.shingles(t, 5) for i, t in texts.items()}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if simhash.similarity(sets[i], sets[j]) >= 0.8:
                label = {k: min(label[i], label[j]) if x in (label[i], label[j]) else x for k, x in label.items()}
    texts = {i: t for i, t in texts.items() if label[i] == i}
    assert {i: r["text"] for i, r in got[1].items()} == texts
    texts = {i: t for i, t in texts.items() if not leaks(t, item)}
    assert {i: r["text"] for i, r in got[2].items()} == texts
    kinds = ("EMAIL", "IP", "CARD", "PHONE")
    for i, t in texts.items():
        for start, kind, end in sorted(base_pii(t), reverse=True):
            t = t[:start] + f"[{kinds[kind]}]" + t[end:]
        texts[i] = t
    assert {i: r["text"] for i, r in got[3].items()} == texts and all(r["n_chars"] == len(texts[i] or "") for i, r in got[3].items() if texts[i] is not None)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())
    assert {i: r["ids"] for i, r in got[4].items()} == {i: None if t is None else library.encode(t) for i, t in texts.items()}


def test_columns_with_the_operators_names(spark, tmp_path):
    write(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for c in ("_quality_score", "_overlaps", "_text_key", "_id", "fp", "component", "pii", "_spans", "score"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {r[c] for r in out.collect() for c in docs.columns[5:]} == {f"own {c}" for c in docs.columns[5:]}, name
