"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.sources.scratch import scratch_dir, shared_checkpoint

#: White space of the word rule ``[^\x20\x09-\x0D]+``; also what ``bytes.split()`` splits at.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Stands for a null doc_id where documents are ordered: later than any other.
LAST_ID = 2**63 - 1
#: Spark's setting that removes a query's shuffle files when it has ended.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(column: str = "doc_id") -> Column:
    """doc_id for comparisons: null is the largest and equal to itself."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def own_id(key: Column) -> Column:
    """Back from doc_key()."""
    return F.when(key != LAST_ID, key)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_remainder(n: int, column: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries planned within give the disk of their shuffles back as soon as they end."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the cluster's shared checkpoint folder."""
    with _shuffles_freed(df.sparkSession):
        return shared_checkpoint(df.select("*"))


def let_go() -> None:
    """Give memory that a Python worker no longer uses back to the machine.

    Workers outlive their tasks, and what one kept would be taken from the next stage's.
    """
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in a new folder under the shared one; smaller than cut() keeps."""
    path = scratch_dir(df.sparkSession, label)
    with _shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
