"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from functools import wraps
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six white-space characters that separate words, as a Java pattern.
SPACE = "[\\x20\\x09-\\x0D]"


def importable(job):
    """The job (spark, ...) with this package on the import path of Python workers, wherever the driver was started."""
    @wraps(job)
    def run(spark, *args):
        root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if root not in paths:
            env["PYTHONPATH"] = os.pathsep.join([*paths, root])
        return job(spark, *args)
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_column(text: Column) -> Column:
    """Words of a text: maximal runs of characters other than the six white-space ones."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def words_of(text: str | None) -> list[bytes]:
    """The same words as UTF-8; bytes.split cuts at exactly the six white-space characters."""
    return text.encode().split() if text else []


def text_batches(batches, text: str, key: str = "doc_id"):
    """(keys, texts) of each Arrow batch as Python lists; null texts become empty."""
    for b in batches:
        yield b.column(key).to_pylist(), [t or "" for t in b.column(text).to_pylist()]


def slices(batches, rows: int = 512):
    """Arrow batches cut to ``rows`` rows: a task turns no more of them into Python objects at once, however large Spark's batches are."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


_holder = [None, None]


def hold_tables(owner: str, clear) -> None:
    """Says that ``owner`` keeps tables in this worker from task to task. Only one operator does at a time: those of the one before
    are cleared, so that a worker that runs many operators holds no more than the largest of them."""
    if _holder[0] != owner:
        if _holder[1] is not None:
            _holder[1]()
        _holder[:] = [owner, clear]


def hold_nothing(owner: str) -> None:
    """Says that ``owner`` keeps no tables: those of the operator before are cleared."""
    hold_tables(owner, dict)


def keep_first(table: dict, most: int) -> None:
    """Bounds a table of known words: beyond ``most`` entries only the older half stays, as common words come early."""
    if len(table) >= most:
        for k in list(table)[most // 2:]:
            del table[k]


def crc_part(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a row."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where the frame has such a column."""
    out = []
    for n in names:
        while n in df.columns:
            n += "_"
        out.append(n)
    return out


def two_columns(df: DataFrame, key: str, value: str, kind: str) -> DataFrame:
    """Only the key and value columns, so that extra columns of the caller cannot clash with ours."""
    return df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(value).cast(kind).alias("text"))
