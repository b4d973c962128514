"""Draining a collector's chunk files of all tables, each row once, with closed collections.

A collector writes ``<benchmark>/<collection>/<table>.<chunk>.parquet``; the chunk named ``end``
is a table's last of that collection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.sources.commits import commit_table, read_committed
from tracelake.sources.layout import BENCHMARK
from tracelake.specs import COLLECTION
from tracelake.streaming.ingest import FILES_PER_BATCH, stream_chunks

#: Ledgers beside the tables: ends that were seen, and those whose chunks are all drained.
SEEN, CLOSED = "ends_seen", "ends_closed"
_CHUNK = "chunk"
_ENDS = T.StructType(
    [T.StructField(c, T.StringType()) for c in (BENCHMARK, COLLECTION, "table_name")]
)


def _run(stream: DataFrame, base: str, table: str, checkpoint: str, partitions: Sequence[str]) -> None:
    def commit(batch: DataFrame, number: int) -> None:
        # A batch that is run again has the same number and the same files.
        commit_table(batch, base, table, f"batch-{number}", partitions=partitions)

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def _ends(spark: SparkSession, path: str) -> DataFrame:
    """A row for each last chunk, also where it holds no rows."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.end.parquet")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    parts = F.split("path", "/")
    name = F.regexp_replace(F.element_at(parts, -1), r"\.end\.parquet$", "")
    return files.select(
        F.element_at(parts, -3).alias(BENCHMARK),
        F.element_at(parts, -2).alias(COLLECTION),
        name.alias("table_name"),
    )


def drain_tables(
    spark: SparkSession,
    path: str,
    schemas: Mapping[str, T.StructType | str],
    base: str,
    checkpoint: str,
    *,
    files_per_batch: int | None = FILES_PER_BATCH,
) -> None:
    """Take the chunks of every table that came since the last drain.

    Each micro-batch of a table is published whole under its number, so a drain that was
    killed at any point and is started again leaves each row once. Ends are read first, then
    the tables, whose streams then see all chunks that were there before: only after that
    the ends become closed ones. Rows carry the chunk's name besides benchmark and collection.
    """
    _run(_ends(spark, path), base, SEEN, f"{checkpoint}/{SEEN}", ())
    ends = read_committed(spark, base, SEEN, _ENDS)
    for table, schema in schemas.items():
        chunks = stream_chunks(
            spark, path, schema, glob=f"{table}.*.parquet", files_per_batch=files_per_batch, folder_ids=True
        )
        # ``table`` may be the beginning of another table's name, up to a dot.
        parts = F.split(F.col("_metadata.file_name"), r"\.")
        own = F.array_join(F.slice(parts, 1, F.size(parts) - 2), ".") == table
        chunks = chunks.where(own).withColumn(_CHUNK, F.element_at(parts, -2))
        _run(chunks, base, table, f"{checkpoint}/{table}", (BENCHMARK, COLLECTION))
    commit_table(ends.distinct(), base, CLOSED, "all", partitions=())


def closed_collections(spark: SparkSession, base: str, tables: Sequence[str]) -> DataFrame:
    """benchmark_name, collection_id of the collections that are drained to their end in all of
    these tables."""
    wanted = sorted(set(tables))
    ends = read_committed(spark, base, CLOSED, _ENDS).where(F.col("table_name").isin(wanted))
    whole = ends.groupBy(BENCHMARK, COLLECTION).agg(F.countDistinct("table_name").alias("n"))
    return whole.where(F.col("n") == len(wanted)).drop("n")


def read_drained(
    spark: SparkSession,
    base: str,
    table: str,
    schema: T.StructType | None = None,
    *,
    closed_in: Sequence[str] | None = None,
) -> DataFrame:
    """A drained table; with ``closed_in`` only collections that are complete in these tables."""
    rows = read_committed(spark, base, table, schema)
    if closed_in is None:
        return rows
    return rows.join(closed_collections(spark, base, closed_in), [BENCHMARK, COLLECTION], "left_semi")
