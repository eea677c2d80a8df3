"""Helpers shared by the operators: shared-folder tables, row keys, input."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where a session on one machine names none, as in tests, a temporary folder
    takes its place and is remembered in the session; on a cluster that fails,
    since each executor would write to a disk of its own.
    """
    for get in (lambda: spark.conf.get("spark.checkpoint.dir", None), lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        found = get()
        if found:
            return found
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="verisieve-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes ``df`` as a table in the shared folder; returns it reread, and its path.

    This cuts the lineage, and a lost executor costs nothing that is written.
    The shuffles of the writing query are of no use then, and go at its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/verisieve/{label}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that :func:`materialize` wrote and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def non_null_text(text: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that starts with ``stem`` and that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def process_wide(key: str, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once in a Python worker and kept for its later tasks.

    Functions are pickled by value here, so a module's own variables would start
    anew with each task.  ``key`` names all that the value depends on.
    """
    store = sys.modules.setdefault("_verisieve_process_wide", types.ModuleType("_verisieve_process_wide")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


#: Texts are handed to a function in slices of about so many bytes.
SLICE_BYTES = 4_000_000


def with_arrow_columns(docs: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[list], list[pa.Array]]], keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) and further columns that a function makes of slices of ``text``.

    ``make`` runs once a task.  A column of a new field's name is replaced.
    """
    new = {f.name for f in fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    source = fresh(docs, "_source")
    given = docs.select(*kept, F.col(text).alias(source))
    schema = T.StructType([*[given.schema[c] for c in kept], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.column(source).nbytes))
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                made = function(part.column(source).to_pylist())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *made], names=[*kept, *[f.name for f in fields]])

    return given.mapInArrow(run, schema)


def lists_of_ints(rows: list) -> pa.Array:
    """An Arrow column of lists of 32-bit integers from arrays and nulls."""
    import numpy as np

    lengths = np.array([0 if r is None else len(r) for r in rows], np.int64)
    values = np.concatenate([r for r in rows if r is not None]) if lengths.any() else np.empty(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    missing = pa.array([r is None for r in rows], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32), pa.int32()), mask=missing if missing.true_count else None)
