"""Block IO: joining issue with completion, summaries, queue depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.columns import (
    block_4k_ios,
    bytes_to_mib,
    mean_of_ints,
    request_flags_label,
    us_to_ms,
)
from tracelake.plans.intervals import join_points_to_intervals
from tracelake.plans.ordered import TARGET_ROWS, ordered_scan, with_segment
from tracelake.specs import COLLECTION, UPTIME, spec

REQUEST = ["device", "sector", "segments", "block_io_bytes", "block_io_flags", COLLECTION]
_FINISH = "finish_ts_uptime_us"


def block_io_pairs(
    queue: DataFrame, latency: DataFrame, *, distinct_issues: bool = True
) -> DataFrame:
    """Every issue with every completion of the same request that can be its own:
    later than it, by less than the completion's block latency.

    Equal rows are reduced to one on both sides first, since copies of a request would
    otherwise all pair up; no later step tells them apart. ``distinct_issues=False`` saves a
    shuffle where ``dedup_pairs``, which makes equal issues one, follows: each copy of an
    issue then meets one completion.
    """
    ends = latency.select(
        *REQUEST,
        F.col(UPTIME).alias(_FINISH),
        "block_latency_us",
        "block_io_latency_us",
    )
    # 0 < finish - start < latency  is  finish - latency < start < finish.
    return join_points_to_intervals(
        queue.distinct() if distinct_issues else queue,
        ends.distinct(),
        REQUEST,
        UPTIME,
        F.col(_FINISH) - F.col("block_latency_us"),
        F.col(_FINISH),
        measured_on=ends,
    )


def dedup_pairs(pairs: DataFrame) -> DataFrame:
    """One completion per issue, the earliest; typed and labelled."""
    issue = ["cpu", *REQUEST, UPTIME]
    best = F.min(
        F.struct(
            _FINISH,
            "block_latency_us",
            "block_io_latency_us",
            "queue_length_segment_ios",
            "queue_length_4k_ios",
        )
    )
    out = (
        pairs.groupBy(*issue)
        .agg(best.alias("b"))
        .select(*issue, "b.*")
        .withColumns(
            {
                "measured_latency_us": F.col(_FINISH) - F.col(UPTIME),
                "block_io_flags_string": request_flags_label(F.col("block_io_flags")),
            }
        )
    )
    return out.select(*spec("block_io").columns)


def block_io_join(queue: DataFrame, latency: DataFrame, *, ordered: bool = False) -> DataFrame:
    """Issues joined with their completions, one row per issue.

    Issue rows equal in all but their queue lengths count as one. ``ordered=True`` sorts
    by start as the last step.
    """
    out = dedup_pairs(block_io_pairs(queue, latency, distinct_issues=False))
    return out.orderBy(UPTIME, *[c for c in out.columns if c != UPTIME]) if ordered else out


def block_io_summary(block_io: DataFrame) -> DataFrame:
    """Counts, sums, means and maxima of all IO per collection and device."""
    col = F.col
    return block_io.groupBy(COLLECTION, "device").agg(
        F.count(F.lit(1)).alias("disk_io_count"),
        F.sum("segments").alias("total_segments"),
        bytes_to_mib(F.sum("block_io_bytes")).alias("total_block_io_mb"),
        F.max("segments").alias("max_segments"),
        F.max("block_io_bytes").alias("max_block_io_bytes"),
        us_to_ms(F.sum("block_latency_us")).alias("total_block_latency_ms"),
        us_to_ms(F.sum("block_io_latency_us")).alias("total_io_block_latency_ms"),
        us_to_ms(F.sum("measured_latency_us")).alias("total_measured_latency_ms"),
        mean_of_ints(col("block_latency_us")).alias("avg_block_latency_us"),
        mean_of_ints(col("block_io_latency_us")).alias("avg_io_block_latency_us"),
        mean_of_ints(col("measured_latency_us")).alias("avg_measured_latency_us"),
        F.max("block_latency_us").alias("max_block_latency_us"),
        F.max("block_io_latency_us").alias("max_io_block_latency_us"),
        F.max("measured_latency_us").alias("max_measured_latency_us"),
        mean_of_ints(col("queue_length_segment_ios")).alias("avg_queue_length_segment_ios"),
        mean_of_ints(col("queue_length_4k_ios")).alias("avg_queue_length_4k_ios"),
        F.max("queue_length_segment_ios").alias("max_queue_length_segment_ios"),
        F.max("queue_length_4k_ios").alias("max_queue_length_4k_ios"),
    )


def queue_depth(raw: DataFrame, *, target_rows: int | None = TARGET_ROWS) -> DataFrame:
    """Outstanding segments and 4 KiB blocks of a device right after each issue.

    Raw rows: collection_id, ts_us, kind (``issue``, ``complete``), device, sector,
    segments, bytes, and where known cpu and block_io_flags, with which this is the
    ``block_io_queue_length`` table. An issue adds; a completion subtracts only while its sector has an
    open issue, that is when the sector's previous event is one. At equal times an issue
    goes before a completion.
    """
    sector, device = [COLLECTION, "device", "sector"], [COLLECTION, "device"]
    events = raw.withColumn("__done", (F.col("kind") != "issue").cast("int"))
    events = with_segment(events, device, "ts_us", target_rows, "__device_segment")
    events = with_segment(events, sector, "ts_us", target_rows, "__sector_segment")
    known = ordered_scan(
        events,
        sector,
        ["ts_us", "__done", "segments", "bytes"],
        previous={"__was_done": F.col("__done")},
        segment="__sector_segment",
    ).drop("__sector_segment")
    sign = F.when(F.col("__done") == 0, 1).when(F.col("__was_done") == 0, -1)
    moves = known.withColumn("__sign", sign).where(F.col("__sign").isNotNull())
    depth = ordered_scan(
        moves,
        device,
        ["ts_us", "__done", "sector", "segments", "bytes"],
        running={
            "queue_length_segment_ios": F.col("__sign") * F.col("segments"),
            "queue_length_4k_ios": F.col("__sign") * block_4k_ios(F.col("bytes")),
        },
        segment="__device_segment",
    )
    known = [c for c in ("cpu", "block_io_flags") if c in raw.columns]
    return depth.where(F.col("__done") == 0).select(
        COLLECTION,
        *known,
        "device",
        "sector",
        "segments",
        F.col("bytes").alias("block_io_bytes"),
        F.col("ts_us").alias(UPTIME),
        "queue_length_segment_ios",
        "queue_length_4k_ios",
    )


def completion_latency(raw: DataFrame) -> DataFrame:
    """The ``block_io_latency`` table from raw completions.

    Raw rows as for ``queue_depth``, with start_time_ns and io_start_time_ns: when the
    request was made and when the device got it.
    """
    now = F.col("ts_us") * 1000
    return raw.where(F.col("kind") != "issue").select(
        COLLECTION,
        "cpu",
        "device",
        "sector",
        "segments",
        F.col("bytes").alias("block_io_bytes"),
        F.col("ts_us").alias(UPTIME),
        F.floor((now - F.col("start_time_ns")) / 1000).cast("long").alias("block_latency_us"),
        F.floor((now - F.col("io_start_time_ns")) / 1000).cast("long").alias("block_io_latency_us"),
        "block_io_flags",
    )
