"""Chart data in long form: collection_id, series, x (seconds since start), y, y_axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import fixed
from tracelake.functions.columns import bytes_to_gib, uptime_sec, us_to_ms
from tracelake.operators.perf import perf_cdf, perf_rate
from tracelake.operators.procs import process_labels
from tracelake.operators.sched import QUEUED, RUN_LENGTH, top_k_queued, top_k_runtime, valid_quanta
from tracelake.specs import COLLECTION, UPTIME


def normalize_uptime(
    table: DataFrame, system_info: DataFrame, name: str = "uptime_since_start_sec"
) -> DataFrame:
    """Add seconds since the start of the row's collection.

    ``system_info`` has one row per collection. It carries no broadcast hint: Spark
    broadcasts it while it is small and otherwise splits a hot collection itself.
    """
    starts = system_info.select(COLLECTION, F.col("uptime_sec").alias("__start"))
    return (
        table.join(starts, COLLECTION, "inner")
        .withColumn(name, uptime_sec(F.col(UPTIME), F.col("__start")))
        .drop("__start")
    )


def _point(series: Column, y: Column, axis: str) -> Column:
    return F.struct(
        series.alias("series"), y.cast("double").alias("y"), F.lit(axis).alias("y_axis")
    )


def _points(table: DataFrame, system_info: DataFrame, *points: Column) -> DataFrame:
    """All points of every row, in one pass over the table."""
    timed = normalize_uptime(table, system_info, "x")
    return timed.select(COLLECTION, "x", F.explode(F.array(*points)).alias("p")).select(
        COLLECTION, "p.series", "x", "p.y", "p.y_axis"
    )


def _cpu_label() -> Column:
    return F.concat(F.lit("CPU "), F.col("cpu").cast("string"))


def series_block_queue(block_io: DataFrame, system_info: DataFrame) -> DataFrame:
    """Per device: queue length in segments and in 4K blocks, and IO latency on its own axis."""

    def label(text: str) -> Column:
        return F.concat(F.lit("Device "), F.col("device").cast("string"), F.lit(f" {text}"))

    return _points(
        block_io,
        system_info,
        _point(label("Segment IOs"), F.col("queue_length_segment_ios"), fixed.AXIS_QUEUE),
        _point(label("4K IOs"), F.col("queue_length_4k_ios"), fixed.AXIS_QUEUE),
        _point(label("Block IO Latency"), F.col("block_io_latency_us"), fixed.AXIS_IO_LATENCY),
    )


def series_memory(memory_usage: DataFrame, system_info: DataFrame) -> DataFrame:
    """Memory trends in GiB."""
    return _points(
        memory_usage,
        system_info,
        *[
            _point(F.lit(c.replace("bytes", "gb")), bytes_to_gib(F.col(c)), fixed.AXIS_MEMORY)
            for c in fixed.MEMORY_TREND_COLUMNS
        ],
    )


def series_quanta_runtime(table: DataFrame, system_info: DataFrame) -> DataFrame:
    """Run quanta per CPU in milliseconds."""
    rows = valid_quanta(table, "quanta_runtime")
    point = _point(_cpu_label(), us_to_ms(F.col(RUN_LENGTH)), fixed.AXIS_RUN_LENGTH)
    return _points(rows, system_info, point)


def series_quanta_queued(table: DataFrame, system_info: DataFrame) -> DataFrame:
    """Queue times per CPU in milliseconds."""
    rows = valid_quanta(table, "quanta_queued_time")
    point = _point(_cpu_label(), us_to_ms(F.col(QUEUED)), fixed.AXIS_QUEUED)
    return _points(rows, system_info, point)


def _counter_title(counter: str) -> str:
    component, event = fixed.COUNTERS.get(counter, (counter, "Count"))
    return f"{component} {event}"


def series_perf_rate(
    table: DataFrame,
    system_info: DataFrame,
    counter: str,
    memory_usage: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Counter rate per CPU and millisecond; with memory trends if that table is given."""
    rates = perf_rate(table, counter, **options)
    axis = f"{_counter_title(counter)}/msec"
    out = _points(rates, system_info, _point(_cpu_label(), F.col(f"{counter}_per_msec"), axis))
    if memory_usage is None:
        return out
    return out.unionByName(series_memory(memory_usage, system_info))


def series_perf_cumulative(
    table: DataFrame, system_info: DataFrame, counter: str, **options
) -> DataFrame:
    """Cumulative scaled counter per CPU."""
    curves = perf_cdf(table, counter, **options)
    return _points(
        curves, system_info, _point(_cpu_label(), F.col(counter), _counter_title(counter))
    )


def series_top_processes(
    table: DataFrame,
    system_info: DataFrame,
    metadata: DataFrame | None,
    k: int = 3,
    *,
    queued: bool = False,
) -> DataFrame:
    """Quanta of the k busiest (or longest waiting) processes and of the collector."""
    name, column, axis, top = (
        ("quanta_queued_time", QUEUED, fixed.AXIS_QUEUED, top_k_queued)
        if queued
        else ("quanta_runtime", RUN_LENGTH, fixed.AXIS_RUN_LENGTH, top_k_runtime)
    )
    collectors = system_info.select(COLLECTION, F.col("collection_pid").alias("pid"))
    chosen = top(table, k).select(COLLECTION, "pid").unionByName(collectors).distinct()
    labels = (
        process_labels(chosen, metadata, system_info)
        .join(
            system_info.select(COLLECTION, F.col("collection_pid").alias("__own")), COLLECTION, "left"
        )
        .select(
            COLLECTION,
            F.col("pid").alias("tgid"),
            F.when(F.col("pid") == F.col("__own"), F.lit(fixed.COLLECTOR_LABEL))
            .otherwise(F.substring("label", 1, fixed.PROCESS_LABEL_CHARS))
            .alias("__series"),
        )
    )
    rows = valid_quanta(table, name).join(labels, [COLLECTION, "tgid"], "inner")
    return _points(rows, system_info, _point(F.col("__series"), us_to_ms(F.col(column)), axis))


def collection_summary(system_info: DataFrame) -> DataFrame:
    """Key facts of every collection."""
    return system_info.select(
        COLLECTION,
        F.col("collection_pid").alias("pid"),
        F.col("benchmark_name").alias("benchmark"),
        F.col("uptime_sec").alias("start_uptime_sec"),
        F.col("collection_time_sec").alias("benchmark_time_sec"),
        F.col("cores").alias("cpus"),
    )
