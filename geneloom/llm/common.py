"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import shared_dir, written  # noqa: F401
from ..plans.arrow import bound_batches

#: ASCII white space, the only word separator of every operator here.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


prepare = bound_batches
materialise = written


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def texts_of(column: pa.Array) -> list[str]:
    """Values of a string column, null as the empty string."""
    return [x or "" for x in column.to_pylist()]


@functools.cache
def libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def tidied(run):
    """For functions over batches: when they end, the worker, which goes on to other tasks, returns the memory it no longer uses."""

    @functools.wraps(run)
    def tidy(batches, *more, **options):
        try:
            yield from run(batches, *more, **options)
        finally:
            pa.default_memory_pool().release_unused()
            if libc() is not None and hasattr(libc(), "malloc_trim"):
                libc().malloc_trim(0)

    return tidy


def added(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """df's schema with one more column."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def as_text(df: DataFrame, column: str, alias: str = "text") -> "F.Column":
    return F.coalesce(df[column].cast("string"), F.lit("")).alias(alias)


def bounded_sample(texts: DataFrame, rows: int, chars: int) -> list[str]:
    """At most `rows` texts of at most `chars` characters each. take() reads a partition or a few, not the table.

    For decisions on cost and balance only: no result may depend on it.
    """
    text = F.col(texts.columns[0])
    return [r[0] for r in texts.where(F.length(text) <= chars).sample(0.25, seed=7).take(rows)]


Batches = Iterator[pa.RecordBatch]
