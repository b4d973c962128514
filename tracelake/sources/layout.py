"""Collection folders.

Two layouts are read. *Tables*: ``<base>/<table>/...parquet``, either our own output
with ``benchmark_name=`` and ``collection_id=`` folders, or flat files whose names start
with the collection id and may end in ``.<benchmark>.parquet``. *Chunks*: a collector's
``.../<benchmark>/<collection_id>/<table>.<chunk>.parquet``. The first is written.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.sources.files import (
    file_name_part,
    glob_text,
    matching,
    read_widened,
    subfolders,
)
from tracelake.specs import COLLECTION, spec, table_names

BENCHMARK = "benchmark_name"


def read_parquet_dir(
    spark: SparkSession, data_dir: str, *, benchmark_name: str | None = None
) -> dict[str, DataFrame]:
    """Every table folder of ``data_dir``, optionally only the files of one benchmark."""

    def wanted(df: DataFrame) -> DataFrame:
        return df if benchmark_name is None else df.where(_benchmark_column(df) == benchmark_name)

    def read(table: str) -> DataFrame:
        folder = f"{data_dir}/{table}"
        options: dict[str, str] = {}
        path = folder
        if benchmark_name is not None:
            # Only footers of files that can hold the benchmark are read, if there are any.
            name = glob_text(benchmark_name)
            if matching(spark, f"{folder}/{BENCHMARK}={name}"):
                path, options = f"{folder}/{BENCHMARK}={name}", {"basePath": folder}
            elif matching(spark, f"{folder}/*.{name}.*"):
                options = {"pathGlobFilter": f"*.{name}.*"}
        return read_widened(spark, path, each=wanted, **options)

    return {table: read(table) for table in subfolders(spark, data_dir)}


def _benchmark_column(df: DataFrame) -> Column:
    return F.col(BENCHMARK) if BENCHMARK in df.columns else file_name_part(2)


def read_collection(spark: SparkSession, data_dir: str, prefix: str) -> dict[str, DataFrame]:
    """The known tables of the one collection whose id starts with ``prefix``.

    In flat folders the file names are matched. A prefix that fits more than one
    collection (or flat file) of a table is an error. Tables without a match are left out.
    """
    out = {}
    known = set(table_names())
    for table in subfolders(spark, data_dir):
        if table not in known:
            continue
        folder, start = f"{data_dir}/{table}", glob_text(prefix)
        parted = f"{folder}/*/{COLLECTION}={start}*"
        options: dict[str, str] = {}
        if matching(spark, f"{folder}/*/{COLLECTION}=*"):
            path, options = parted, {"basePath": folder}
            found = bool(matching(spark, parted))
        else:
            # Flat files, or folders by collection alone, which are filtered below.
            path, flat = folder, matching(spark, f"{folder}/*.parquet")
            found = not flat or bool(matching(spark, f"{folder}/{start}*"))
            options = {"pathGlobFilter": f"{start}*"} if flat and found else {}
        if not found:
            continue
        df = read_widened(
            spark,
            path,
            each=lambda part: part.withColumn("__owner", _owner(part)).where(
                F.col("__owner").startswith(prefix)
            ),
            **options,
        )
        # Reads no data columns; at most two rows come back.
        owners = [r[0] for r in df.select("__owner").distinct().limit(2).collect()]
        if len(owners) > 1:
            raise ValueError(f"{prefix!r} fits several collections of {table}: {owners}")
        if owners:
            out[table] = spec(table).conform(df.drop("__owner"))
    return out


def _owner(df: DataFrame) -> Column:
    """What a collection prefix is compared with: the collection's folder or the file name."""
    parted = any(f"/{COLLECTION}=" in f for f in df.inputFiles()[:1])
    return F.col(COLLECTION) if parted else F.col("_metadata.file_name")


def read_chunks(spark: SparkSession, base: str, table: str) -> DataFrame:
    """All chunks of one table in the collectors' layout; benchmark and collection come
    from the folders."""

    def located(df: DataFrame) -> DataFrame:
        folders = F.split(F.col("_metadata.file_path"), "/")
        return df.withColumns(
            {
                BENCHMARK: F.element_at(folders, -3),
                COLLECTION: F.element_at(folders, -2),
                "file_modification_time": F.col("_metadata.file_modification_time"),
            }
        )

    return read_widened(
        spark,
        base,
        each=located,
        recursiveFileLookup="true",
        pathGlobFilter=f"{table}.*.parquet",
    )


def with_modification_time(df: DataFrame) -> DataFrame:
    """Add the modification time of each row's source file."""
    return df.withColumn("file_modification_time", F.col("_metadata.file_modification_time"))


def latest_collection(df: DataFrame) -> DataFrame:
    """Rows of the collection whose files are newest (by ``file_modification_time``)."""
    newest = df.agg(
        F.max(F.struct("file_modification_time", COLLECTION)).getField(COLLECTION).alias("c")
    )
    return df.where(F.col(COLLECTION) == newest.scalar()).drop("file_modification_time")


def write_table(df: DataFrame, base: str, table: str, *, mode: str = "append") -> str:
    """Write one table, split by benchmark and collection; returns its folder.

    Rows are rebalanced first: a large collection is spread over several files and small
    ones share a task, so that neither one task nor many tiny files result.
    """
    folder = f"{base}/{table}"
    keys = [BENCHMARK, COLLECTION]
    (
        df.hint("rebalance", *[F.col(k) for k in keys])
        .write.mode(mode)
        .partitionBy(*keys)
        .parquet(folder)
    )
    return folder


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Make tables queryable by name; an unknown name is an error."""
    unknown = sorted(set(tables) - set(table_names()))
    if unknown:
        raise KeyError(f"unknown tables: {unknown}")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def table_row_counts(
    tables: Mapping[str, DataFrame], *, benchmark_name: str | None = None
) -> DataFrame:
    """Rows per table and collection, optionally of one benchmark."""
    counts = []
    for name, df in sorted(tables.items()):
        if benchmark_name is not None:
            df = df.where(F.col(BENCHMARK) == benchmark_name)
        counts.append(
            df.groupBy(COLLECTION)
            .agg(F.count(F.lit(1)).alias("rows"))
            .select(F.lit(name).alias("table_name"), COLLECTION, "rows")
        )
    return reduce(DataFrame.unionByName, counts)
