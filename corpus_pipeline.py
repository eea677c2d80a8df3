"""The corpus pipeline: five stages, each an operator over all that its predecessor kept.

``run`` applies the stages to ``documents``.  The driver's own runs write each
stage's result as Parquet and reread it; ``run`` does the same in the shared
folder.  SQL cannot express the classifier and the tokenizer, so ORACLE_SQL is
None and the tests hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisieve.llm import decontaminate, pieces, pii, quality, simhash
from verisieve.llm.common import discard, fresh, materialize, table
from verisieve.llm.queries import tokenizer_file


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches one half."""
    name = fresh(docs, "_quality_score")
    scored = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")), out=name)
    return scored.where(F.col(name) >= 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no item of the benchmark."""
    name = fresh(docs, "_overlaps")
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark"), out=name)
    return found.where(F.size(name) == 0).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in their texts."""
    return pii.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids: doc_id, lang, source, n_ids, ids_sha256, round_trip, ids."""
    return pieces.round_trip(docs, tokenizer_file(), keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("PII", redact_personal_data),
    ("SentencePiece encoding and decoding", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs, path = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, written = materialize(docs, f"stage{i}")
            if path:
                discard(spark, path)
            path = written
    return docs
