"""Reading chunk files as a stream and writing tables from it."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracelake.sources.layout import BENCHMARK
from tracelake.specs import COLLECTION

#: Files of a batch unless asked otherwise, so that a first drain is not one batch.
FILES_PER_BATCH = 1000
#: Held while a query starts under settings of its own.
_STARTING = Lock()
_SHUFFLE = "spark.sql.shuffle.partitions"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def stream_chunks(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    *,
    glob: str | None = None,
    files_per_batch: int | None = FILES_PER_BATCH,
    folder_ids: bool = False,
) -> DataFrame:
    """Chunk files below ``path`` as a stream; ``glob`` picks a table's files.

    Files are taken in order of modification time, ``files_per_batch`` in a batch (None: all
    new ones). ``folder_ids`` takes benchmark and collection from the two folders above a
    file, the collectors' layout, which a sink can then partition by.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    chunks = reader.parquet(path)
    if folder_ids:
        folders = F.split(F.col("_metadata.file_path"), "/")
        ids = {BENCHMARK: F.element_at(folders, -3), COLLECTION: F.element_at(folders, -2)}
        chunks = chunks.withColumns(ids)
    return chunks


def start_table_sink(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    *,
    partitions: tuple[str, ...] = (BENCHMARK, COLLECTION),
    interval: str | None = None,
    state_partitions: int | None = None,
    release_held: bool = False,
) -> StreamingQuery:
    """Append a stream to a Parquet table, each row exactly once.

    With ``interval`` (such as ``"1 minute"``) it keeps draining at that pace; without,
    it takes what is there and ends. State is kept in ``state_partitions`` parts from the
    first run on, which cannot be changed later; by default the session's shuffle partitions.
    ``release_held`` lets a drain end with a batch without data, after the watermark has moved.
    """
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    keys = [c for c in partitions if c in stream.columns]
    if keys:
        writer = writer.partitionBy(*keys)
    if interval is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=interval)
    spark = stream.sparkSession
    settings = {} if state_partitions is None else {_SHUFFLE: str(state_partitions)}
    if interval is None and not release_held:
        # A drain that ends needs no extra batch after the last one.
        settings[_EMPTY_BATCHES] = "false"
    with _STARTING:
        before = {key: spark.conf.get(key) for key in settings}
        try:
            for key, value in settings.items():
                spark.conf.set(key, value)
            # A started query keeps its own copy of the settings.
            return writer.start()
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)
