"""File opens: admission, distinct files, first and last occurrence, build markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import fixed
from tracelake.functions.columns import uptime_sec
from tracelake.specs import COLLECTION, UPTIME


def file_open_admission(raw: DataFrame, created: Column | str = "created") -> DataFrame:
    """Opens worth keeping: of a created or non-empty file, by a thread other than pid 0."""
    was_created = F.col(created) if isinstance(created, str) else created
    return raw.where((was_created | (F.col("file_size_bytes") > 0)) & (F.col("pid") != 0))


def files_opened(table: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Number of distinct files opened per collection."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return table.groupBy(COLLECTION).agg(count("file_inode").alias("files_opened"))


def file_events_by_name(table: DataFrame, name: str) -> DataFrame:
    """Opens of the named file."""
    return table.where(F.col("file_name") == name)


def file_first_last(table: DataFrame) -> DataFrame:
    """First and last open of every file name per collection."""
    return table.groupBy(COLLECTION, "file_name").agg(
        F.min(UPTIME).alias("first_ts_uptime_us"), F.max(UPTIME).alias("last_ts_uptime_us")
    )


def build_markers(table: DataFrame, system_info: DataFrame) -> DataFrame:
    """Phase markers of kernel-build collections, in seconds since the start.

    Columns: collection_id, marker, occurrence, seconds.
    """
    builds = system_info.where(F.col("benchmark_name") == fixed.BUILD_BENCHMARK).select(
        COLLECTION, "uptime_sec"
    )
    marks = file_first_last(table.where(F.col("file_name").isin(*fixed.BUILD_MARKERS)))
    which = F.create_map(*[F.lit(x) for pair in fixed.BUILD_MARKERS.items() for x in pair])
    occurrence = which[F.col("file_name")]
    ts = F.when(occurrence == "first", F.col("first_ts_uptime_us")).otherwise(
        F.col("last_ts_uptime_us")
    )
    return marks.join(builds, COLLECTION, "inner").select(
        COLLECTION,
        F.col("file_name").alias("marker"),
        occurrence.alias("occurrence"),
        uptime_sec(ts, F.col("uptime_sec")).alias("seconds"),
    )
