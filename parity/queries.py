"""Every operator applied to the shared test tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parity.views import spark_view
from tracelake.functions.columns import device_major, device_minor, request_flags_label
from tracelake.operators import (
    blockio,
    experiments,
    features,
    files,
    hosts,
    memory,
    perf,
    procs,
    rss,
    sched,
    series,
    sketches,
    spans,
)
from tracelake.sources import commits, layout
from tracelake.sources.files import read_widened
from tracelake.sources.scratch import scratch_dir, shared_table
from tracelake.sources.text import read_log_lines
from tracelake.specs import COLLECTION, spec
from tracelake.streaming import counters, drain, ingest, stateful
from tracelake.streaming.block_io import read_block_io_pairs, start_block_io_sink

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
COUNTER = "dtlb_misses"
_CHUNKS = 3


def _on(*views: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function of the named views under its own name."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*[spark_view(spark, sf_dir, v) for v in views])

        QUERIES[fn.__name__.strip("_")] = query
        return fn

    return add


def _with_spark(fn: Query) -> Query:
    QUERIES[fn.__name__.strip("_")] = fn
    return fn


# --- scans, sources, sinks ---------------------------------------------------------


def _by_collection(df: DataFrame) -> DataFrame:
    """One benchmark per collection, as a partition column."""
    return df.withColumn(
        layout.BENCHMARK, F.concat(F.lit("b"), F.substr(COLLECTION, F.lit(2)))
    )


@_with_spark
def union_by_name_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = spark_view(spark, sf_dir, "fx_process_trace")
    folder = scratch_dir(spark, "widen") + "/process_trace"
    c0 = F.col(COLLECTION) == "c0"
    c2 = F.col(COLLECTION) == "c2"
    trace.where(c0).drop("name").withColumn("pid", F.col("pid").cast("int")).write.mode(
        "append"
    ).parquet(folder)
    trace.where(c2).withColumn("extra", F.lit(1)).write.mode("append").parquet(folder)
    trace.where(~c0 & ~c2).withColumn("pid", F.col("pid").cast("double")).write.mode(
        "append"
    ).parquet(folder)
    return read_widened(spark, folder)


@_with_spark
def scan_collection_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "prefix")
    trace = spark_view(spark, sf_dir, "fx_process_trace")
    layout.write_table(_by_collection(trace), base, "process_trace")
    return layout.read_collection(spark, base, "c2")["process_trace"]


@_with_spark
def latest_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "latest")
    trace = _by_collection(spark_view(spark, sf_dir, "fx_process_trace"))
    older, newest = F.col(COLLECTION) != "c3", F.col(COLLECTION) == "c3"
    layout.write_table(trace.where(older), base, "process_trace")
    layout.write_table(trace.where(newest), base, "process_trace")
    written = layout.with_modification_time(spark.read.parquet(f"{base}/process_trace"))
    return layout.latest_collection(written).drop(layout.BENCHMARK)


@_with_spark
def write_read_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch_dir(spark, "roundtrip")
    trace = _by_collection(spark_view(spark, sf_dir, "fx_process_trace"))
    layout.write_table(trace, base, "process_trace")
    return layout.read_parquet_dir(spark, base)["process_trace"]


@_with_spark
def committed_write_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a job, one of them made twice."""
    base = scratch_dir(spark, "committed")
    trace = _by_collection(spark_view(spark, sf_dir, "fx_process_trace"))
    for run in (0, 1, 1, 2):
        part = trace.where(F.pmod(F.xxhash64("pid", "ts_ns"), F.lit(_CHUNKS)) == run)
        commits.commit_table(part, base, "process_trace", f"run-{run}")
    return commits.read_committed(spark, base, "process_trace")


def _collector_files(spark: SparkSession, df: DataFrame, table: str, base: str, chunk: str) -> None:
    """A table's rows as chunks in a collector's layout."""
    jvm = spark._jvm
    path, conf = jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    made = f"{base}/made-{table}-{chunk}"
    df.write.partitionBy(layout.BENCHMARK, COLLECTION).parquet(made)
    system = path(made).getFileSystem(conf)
    for i, file in enumerate(system.globStatus(path(f"{made}/*/*/part-*"))):
        ids = [x.split("=")[1] for x in str(file.getPath().toString()).split("/")[-3:-1]]
        folder = "/".join([base, "in", *ids])
        system.mkdirs(path(folder))
        name = chunk if chunk == "end" else f"{chunk}-{i}"
        system.rename(file.getPath(), path(f"{folder}/{table}.{name}.parquet"))


@_with_spark
def drain_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables drained together, twice; rows of the collections that both have ended in."""
    base = scratch_dir(spark, "drain")
    tables = {
        "process_trace": _by_collection(spark_view(spark, sf_dir, "fx_process_trace")),
        "mm_rss_stat": _by_collection(spark_view(spark, sf_dir, "fx_mm_rss_stat")),
    }
    schemas = {t: df.drop(layout.BENCHMARK, COLLECTION).schema for t, df in tables.items()}
    for number in range(2):
        for table, df in tables.items():
            part = df.where(F.pmod(F.xxhash64("pid", "ts_ns"), F.lit(2)) == number)
            _collector_files(spark, part, table, base, str(number))
            if number:
                # The other table never ends in one collection.
                ends = df.where(F.lit(table == "process_trace") | (F.col(COLLECTION) != "c1"))
                ends = ends.groupBy(layout.BENCHMARK, COLLECTION).agg(F.first("ts_ns").alias("ts_ns"))
                _collector_files(spark, ends.where("ts_ns is not null").limit(99).coalesce(1), table, base, "end")
        drain.drain_tables(spark, f"{base}/in", schemas, f"{base}/out", f"{base}/state")
    names = list(tables)
    trace = drain.read_drained(spark, f"{base}/out", names[0], closed_in=names)
    return trace.where(F.col("chunk") != "end").drop("chunk", layout.BENCHMARK)


def _drain_chunks(
    spark: SparkSession,
    sf_dir: str,
    views: dict[str, str],
    job: Callable[..., DataFrame],
    partitions: tuple[str, ...] = (),
) -> DataFrame:
    """Feed a streaming job chunk by chunk, as a collector would, and return its table."""

    def drain(base: str, *streams: DataFrame) -> DataFrame:
        result = job(*streams)
        ingest.start_table_sink(
            result, f"{base}/out", f"{base}/state", partitions=partitions
        ).awaitTermination()
        return spark.read.schema(result.schema).parquet(f"{base}/out")

    return _fed_chunks(spark, sf_dir, views, drain)


def _fed_chunks(
    spark: SparkSession, sf_dir: str, views: dict[str, str], drain: Callable[..., DataFrame]
) -> DataFrame:
    """What ``drain``, given a folder and the streams of the views, returns after the last chunk.

    ``views`` maps view names to their time columns. Every chunk is a stretch of time,
    written by many tasks; after each the job runs from its checkpoint over what is new.
    """
    base = scratch_dir(spark, "stream")
    tables = {v: spark_view(spark, sf_dir, v) for v in views}
    edges = {}
    for view, at in views.items():
        at_part = [F.min(at) + (F.max(at) - F.min(at)) * k / _CHUNKS for k in range(_CHUNKS + 1)]
        edges[view] = [F.lit(x).cast("double") for x in tables[view].agg(*at_part).first()]
    for chunk in range(_CHUNKS):
        for view, at in views.items():
            table, low, high = tables[view], *edges[view][chunk : chunk + 2]
            part = F.col(at) >= low
            if chunk + 1 < _CHUNKS:
                part = part & (F.col(at) < high)
            table.where(part).write.mode("append").parquet(f"{base}/{view}")
        streams = [ingest.stream_chunks(spark, f"{base}/{v}", tables[v].schema) for v in views]
        result = drain(base, *streams)
    return result


@_with_spark
def stream_ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = {"fx_process_trace": "ts_ns"}
    return _drain_chunks(spark, sf_dir, views, lambda trace: trace, (COLLECTION,))


@_on("fx_process_trace", "fx_mm_rss_stat", "fx_quanta_runtime")
def table_row_counts(trace, rss_stat, quanta):
    tables = {"process_trace": trace, "mm_rss_stat": rss_stat, "quanta_runtime": quanta}
    return layout.table_row_counts(tables)


# --- projections, filters ----------------------------------------------------------


@_on("fx_perf")
def conform_schema(samples):
    text = samples.drop(COLLECTION).select(*[F.col(c).cast("string") for c in samples.drop(COLLECTION).columns])
    raw = text.withColumnRenamed("cumulative_dtlb_misses", "cumulative_count")
    return spec(COUNTER).conform(raw, "run-1")


@_on("fx_quanta_runtime")
def quanta_runtime_valid(quanta):
    return sched.valid_quanta(quanta, "quanta_runtime")


@_on("fx_quanta_queued")
def quanta_queued_valid(quanta):
    return sched.valid_quanta(quanta, "quanta_queued_time")


@_on("fx_process_snapshots")
def process_by_pid(snapshots):
    return procs.by_pid(procs.process_metadata(snapshots), [3, 5, 8, 13])


@_on("fx_process_snapshots", "fx_file_data")
def process_by_pid_table(snapshots, opens):
    """Of the processes that opened a kernel image."""
    return procs.by_pid(procs.process_metadata(snapshots), opens.where("file_name = 'vmlinux'"))


@_on("fx_file_data")
def file_events_by_name(table):
    return files.file_events_by_name(table, "vmlinux")


@_on("fx_system_info")
def flatten_system_info(info):
    nested = info.select(
        COLLECTION,
        F.struct("uptime_sec").alias("identification"),
        F.struct("cores", F.lit("x86_64").alias("architecture")).alias("hardware"),
    )
    facts = {
        "collection_time_sec": 60.0,
        "collection_pid": F.lit(4242).cast("long"),
        "benchmark_name": "redis",
    }
    flat = hosts.with_run_facts(hosts.flatten_structs(nested), facts, ["perf", "block_io"])
    return flat.withColumn("hooks", F.array_join("hooks", ","))


QUERIES["collection_summary"] = lambda s, d: series.collection_summary(
    spark_view(s, d, "fx_system_info")
)


# --- joins -------------------------------------------------------------------------


@_on("fx_process_trace")
def process_lifetimes(trace):
    return procs.process_lifetimes(trace)


@_on("fx_process_trace")
def process_lifetimes_basic(trace):
    return procs.process_lifetimes(trace, duration=False)


@_on("fx_process_trace")
def process_lifetimes_next_end(trace):
    return procs.process_lifetimes(trace, pairing="next_end")


@_on("fx_process_trace")
def nth_process_run(trace):
    return procs.nth_run(trace, "fork", 2)


@_on("fx_quanta_runtime", "fx_process_snapshots")
def process_labels(quanta, snapshots):
    pids = quanta.select(COLLECTION, F.col("tgid").alias("pid")).distinct()
    return procs.process_labels(pids, procs.process_metadata(snapshots))


@_on("fx_block_io_queue", "fx_block_io_latency")
def block_io_join(queue, latency):
    return blockio.block_io_join(queue, latency)


@_on("fx_collapse_raw", "fx_trace_collapse")
def collapse_pairing(calls, events):
    return memory.collapse_pairing(calls, events)


@_on("fx_collapse_raw", "fx_trace_collapse")
def collapse_pairing_asof(calls, events):
    return memory.collapse_pairing(calls, events, mode="asof")


@_on("fx_quanta_runtime", "fx_system_info")
def normalize_uptime(quanta, info):
    return series.normalize_uptime(quanta, info)


@_on("fx_probes", "fx_features")
def feature_lookup(probes, table):
    return features.feature_lookup(probes, table)


@_on("fx_features")
def feature_map_stats(table):
    return features.feature_map_stats(table)


# --- aggregations, distinct, top k -------------------------------------------------


@_on("fx_quanta_runtime")
def total_runtime(quanta):
    return sched.total_runtime(quanta)


@_on("fx_quanta_runtime")
def per_cpu_runtime(quanta):
    return sched.per_cpu_runtime(quanta)


@_on("fx_quanta_queued")
def total_queued(quanta):
    return sched.total_queued(quanta)


@_on("fx_quanta_queued")
def per_cpu_queued(quanta):
    return sched.per_cpu_queued(quanta)


@_on("fx_block_io_queue", "fx_block_io_latency")
def block_io_summary(queue, latency):
    return blockio.block_io_summary(blockio.block_io_join(queue, latency))


@_on("fx_perf")
def perf_total(samples):
    return perf.perf_total(samples, COUNTER)


@_on("fx_file_data")
def files_opened(table):
    return files.files_opened(table)


@_on("fx_file_data")
def file_first_last(table):
    return files.file_first_last(table)


@_on("fx_experiment_raw")
def experiment_averages(lines):
    return experiments.experiment_averages(lines)


@_on("fx_get_bench_raw")
def get_bench_stats(lines):
    return experiments.get_bench_stats(lines)


@_on("fx_get_bench_raw")
def get_bench_pivot(lines):
    return experiments.get_bench_pivot(lines, ["kmod-array", "ebpf-map", "user-mmap"])


@_on("fx_get_bench_raw")
def box_summary(lines):
    times = experiments.parse_get_bench(lines)
    return experiments.box_summary(times, ["system", "data_size"], "time_ns")


@_on("fx_file_data")
def files_opened_merged(table):
    """Distinct files from sketches of chunks, beside the exact number that they must be near."""
    chunk = F.pmod(F.xxhash64("pid", "ts_uptime_us"), F.lit(8))
    parts = sketches.distinct_sketches(table.withColumn("chunk", chunk), [COLLECTION, "chunk"], "file_inode")
    merged = sketches.merged_distinct(shared_table(parts, "sketches"), [COLLECTION], "__estimate")
    both = files.files_opened(table).join(merged, COLLECTION)
    off = F.abs(F.col("__estimate") - F.col("files_opened"))
    near = off <= 4 * sketches.distinct_error() * F.col("files_opened")
    return both.select(COLLECTION, "n", "files_opened", near.alias("estimate_is_near"))


@_on("fx_get_bench_raw")
def box_summary_merged(lines):
    """Quantiles from sketches of chunks, whose ranks among all values must be near."""
    keys = ["system", "data_size"]
    times = experiments.parse_get_bench(lines).withColumn("chunk", F.pmod(F.xxhash64("line_no"), F.lit(8)))
    parts = sketches.quantile_sketches(times, [*keys, "chunk"], "time_ns")
    merged = sketches.merged_quantiles(shared_table(parts, "sketches"), keys)
    same = [times[k].eqNullSafe(merged[k]) for k in keys]
    ranks = times.join(merged, same).groupBy(*[merged[k] for k in keys], "n", "min", "max")
    off, near = 3 * sketches.rank_error(), F.lit(True)
    tested = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    for name, q in tested.items():
        near &= F.col(f"__below_{name}") <= (q + off) * F.col("n")
        near &= F.col(f"__upto_{name}") >= (q - off) * F.col("n")
    counted = [F.count_if(F.col("time_ns") < F.col(c)).alias(f"__below_{c}") for c in tested]
    counted += [F.count_if(F.col("time_ns") <= F.col(c)).alias(f"__upto_{c}") for c in tested]
    return ranks.agg(*counted).select(*keys, "n", "min", "max", near.alias("ranks_are_near"))


@_on("fx_bar_lines")
def grouped_bar_long(lines):
    return experiments.grouped_bar_long(lines, 3)


@_on("fx_timing_lines")
def inference_latency_by_size(lines):
    return experiments.inference_latency_by_size(lines)


@_on("fx_timing_lines")
def log_lines_by_split(lines):
    """Log files that are read in splits; each line is numbered as it was written."""
    spark, by = lines.sparkSession, ["path", "line_no"]
    folder = scratch_dir(spark, "logs")
    text = F.concat_ws("\t", "path", F.col("line_no").cast("string"), "line")
    logs = lines.repartitionByRange(*by).sortWithinPartitions(*by).select(text.alias("value"))
    logs.write.text(folder)
    back = read_log_lines(spark, folder, whole_bytes=0)
    part = F.split("line", "\t")
    said = back.select(
        part[0].alias("path"),
        part[1].cast("long").alias("line_no"),
        part[2].alias("line"),
        "relative_path",
        F.col("line_no").alias("__number"),
    )
    place = F.row_number().over(Window.partitionBy("relative_path").orderBy(*by)) - 1
    return said.withColumn("in_place", F.col("__number") == place).drop("relative_path", "__number")


@_on("fx_process_snapshots")
def process_metadata_dedup(snapshots):
    return procs.process_metadata(snapshots)


@_on("fx_quanta_runtime")
def top_k_runtime(quanta):
    return sched.top_k_runtime(quanta, 3)


@_on("fx_quanta_queued")
def top_k_queued(quanta):
    return sched.top_k_queued(quanta, 5, per_collection=False)


# --- windows, fills ----------------------------------------------------------------


@_on("fx_perf")
def perf_pdf(samples):
    return perf.perf_pdf(samples, COUNTER)


@_on("fx_perf")
def perf_pdf_extrapolated(samples):
    """As counters of 32 bits, most of which wrap between two samples."""
    narrow = F.col(f"cumulative_{COUNTER}").bitwiseAND(F.lit((1 << 32) - 1))
    samples = samples.withColumn(f"cumulative_{COUNTER}", narrow)
    return perf.perf_pdf(samples, COUNTER, scaling="extrapolate", wrap_bits=32)


# A running sum of doubles may depend on the order of addition in its last digits, so it
# is compared at three decimals.
@_on("fx_perf")
def perf_cdf(samples):
    return perf.perf_cdf(samples, COUNTER).withColumn(COUNTER, F.round(COUNTER, 3))


@_on("fx_perf")
def perf_rate(samples):
    return perf.perf_rate(samples, COUNTER)


@_on("fx_mm_rss_stat")
def rss_total(samples):
    return rss.rss_total(samples)


@_on("fx_user_trace", "fx_mm_rss_stat")
def rss_clip(trace, samples):
    return rss.rss_clip(samples, rss.rss_windows(trace, "view_0", 0, "fork", 9)).select(
        COLLECTION, "tgid", "ts_ns", "count"
    )


@_on("fx_user_trace", "fx_mm_rss_stat", "fx_policies")
def rss_policy_comparison(trace, samples, policies):
    return rss.rss_policy_comparison(trace, samples, policies, "view_0", 0, "fork", 9)


# --- scalar functions --------------------------------------------------------------


@_on("fx_block_io_queue")
def block_io_flag_labels(queue):
    flags = F.col("block_io_flags")
    return queue.groupBy(flags).agg(F.count(F.lit(1)).alias("n")).select(
        flags, request_flags_label(flags).alias("block_io_flags_string"), "n"
    )


@_on("fx_span_raw")
def madvise_labels(raw):
    entries = raw.where(F.col("kind") == "entry").select(
        COLLECTION, F.col("tid").alias("tgid"), "ts_ns", "address", "length", "advice"
    )
    return memory.madvise_labels(entries)


@_on("fx_block_io_queue")
def device_major_minor(queue):
    device = ((F.col("device") + 8) * 1048576 + F.col("cpu")).alias("device")
    d = F.col("device")
    return queue.select(device).groupBy("device").agg(F.count(F.lit(1)).alias("n")).select(
        "device", device_major(d).alias("major"), device_minor(d).alias("minor"), "n"
    )


@_on("fx_meminfo_raw")
def meminfo_parse(raw):
    return memory.meminfo_parse(raw)


@_on("fx_meminfo_raw")
def meminfo_parse_raw_counts(raw):
    return memory.meminfo_parse(raw, hugepage_counts_raw=True)


# --- series ------------------------------------------------------------------------


@_on("fx_block_io_queue", "fx_block_io_latency", "fx_system_info")
def series_block_queue(queue, latency, info):
    return series.series_block_queue(blockio.block_io_join(queue, latency), info)


@_on("fx_meminfo_raw", "fx_system_info")
def series_memory(raw, info):
    return series.series_memory(memory.meminfo_parse(raw), info)


@_on("fx_quanta_runtime", "fx_system_info")
def series_quanta_runtime(quanta, info):
    return series.series_quanta_runtime(quanta, info)


@_on("fx_quanta_queued", "fx_system_info")
def series_quanta_queued(quanta, info):
    return series.series_quanta_queued(quanta, info)


@_on("fx_perf", "fx_system_info", "fx_meminfo_raw")
def series_perf_rate(samples, info, raw):
    return series.series_perf_rate(samples, info, COUNTER, memory.meminfo_parse(raw))


@_on("fx_perf", "fx_system_info")
def series_perf_cumulative(samples, info):
    curves = series.series_perf_cumulative(samples, info, COUNTER)
    return curves.withColumn("y", F.round("y", 3))


@_on("fx_quanta_runtime", "fx_system_info", "fx_process_snapshots")
def series_top_processes(quanta, info, snapshots):
    return series.series_top_processes(quanta, info, procs.process_metadata(snapshots))


@_on("fx_file_data", "fx_system_info")
def build_markers(table, info):
    return files.build_markers(table, info)


# --- raw events --------------------------------------------------------------------


@_on("fx_blk_raw")
def queue_depth(raw):
    return blockio.queue_depth(raw)


@_on("fx_sched_raw")
def sched_run_time(raw):
    return sched.sched_run_time(raw)


@_on("fx_sched_raw")
def sched_queue_time(raw):
    return sched.sched_queue_time(raw)


# Raw events to declared tables to answers.


@_on("fx_sched_full")
def raw_per_cpu_runtime(raw):
    return sched.per_cpu_runtime(spec("quanta_runtime").conform(sched.sched_run_time(raw)))


@_on("fx_sched_full")
def raw_top_k_runtime(raw):
    return sched.top_k_runtime(spec("quanta_runtime").conform(sched.sched_run_time(raw)), 3)


@_on("fx_sched_full")
def raw_per_cpu_queued(raw):
    return sched.per_cpu_queued(spec("quanta_queued_time").conform(sched.sched_queue_time(raw)))


@_on("fx_blk_full")
def raw_block_io_summary(raw):
    queue = spec("block_io_queue_length").conform(blockio.queue_depth(raw))
    latency = spec("block_io_latency").conform(blockio.completion_latency(raw))
    return blockio.block_io_summary(blockio.block_io_join(queue, latency))


@_on("fx_span_raw")
def raw_zswap_runtime(raw):
    raw = raw.withColumn("tgid", F.floor(F.col("tid") / 2))
    return spec("zswap_runtime").conform(
        spans.span_pairs_overwrite(raw, is_error=F.col("ret") < 0)
    )


@_on("fx_quanta_queued", "fx_system_info", "fx_process_snapshots")
def series_top_queued(quanta, info, snapshots):
    return series.series_top_processes(
        quanta, info, procs.process_metadata(snapshots), queued=True
    )


@_on("fx_span_raw")
def span_pairs_overwrite_errors(raw):
    """Returns with an error code neither end nor clear a call."""
    return spans.span_pairs_overwrite(raw, is_error=F.col("ret") < 0)


@_on("fx_span_raw")
def span_pairs_overwrite(raw):
    return spans.span_pairs_overwrite(raw)


@_on("fx_span_raw")
def span_pairs_keep_first(raw):
    return spans.span_pairs_keep_first(raw)


@_on("fx_decision_raw")
def decision_eager(raw):
    return spans.decision_eager(raw)


@_on("fx_decision_raw")
def decision_prezero(raw):
    return spans.decision_prezero(raw)


@_on("fx_file_opens_raw")
def file_open_admission(raw):
    return files.file_open_admission(raw)


@_on("fx_span_raw")
def rss_owner_attach(raw):
    page = F.shiftright("address", 12)
    return spans.rss_owner_attach(
        raw.select(
            COLLECTION,
            "tid",
            "ts_ns",
            F.when(F.col("kind") == "entry", "owner").otherwise("stat").alias("kind"),
            page.alias("owner_pid"),
            F.shiftright("address", 13).alias("owner_tgid"),
            (page % 4).alias("member"),
            F.col("length").alias("size"),
        )
    )


@_on("fx_span_raw")
def unmap_union(raw):
    ranges = raw.select(
        F.col("tid").alias("tgid"),
        "ts_ns",
        F.col("address").alias("start"),
        (F.col("address") + F.col("length")).alias("end"),
        COLLECTION,
        "name",
    )
    plain = F.col("name") == "madvise"
    return memory.unmap_union(ranges.where(plain).drop("name"), ranges.where(~plain).drop("name"))


# --- streams -----------------------------------------------------------------------


@_with_spark
def stream_block_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    def drain(base: str, queue: DataFrame, latency: DataFrame) -> DataFrame:
        # The fixture's latencies are at most 1 ms.
        start_block_io_sink(
            queue, latency, base, f"{base}/state", max_latency="1 second", delay="1 second"
        ).awaitTermination()
        return read_block_io_pairs(spark, base)

    views = dict.fromkeys(("fx_block_io_queue", "fx_block_io_latency"), "ts_uptime_us")
    return blockio.dedup_pairs(_fed_chunks(spark, sf_dir, views, drain))


def _drain_shuffled_samples(spark: SparkSession, sf_dir: str, drain: Callable[..., DataFrame]) -> DataFrame:
    """What ``drain``, given a folder and a stream, returns after the last chunk of counter samples.

    Chunks are cut by a time of arrival, up to an hour after the samples' own. A last one holds a sample of another collection, late enough to release all before it.
    """
    base, hour = scratch_dir(spark, "samples"), 3_600_000_000
    samples = spark_view(spark, sf_dir, "fx_perf")
    came = F.col("ts_uptime_us") + F.pmod(F.xxhash64(*samples.columns), F.lit(hour))
    low, high = samples.agg(F.min("ts_uptime_us"), F.max("ts_uptime_us") + hour).first()
    chunk = F.floor((came - low) * _CHUNKS / F.lit(high - low + 1))
    closing = samples.limit(1).withColumns(
        {COLLECTION: F.lit("closing"), "ts_uptime_us": F.lit(high + 2 * hour).cast("long")}
    )
    chunks = [samples.where(chunk == k) for k in range(_CHUNKS)] + [closing]
    for part in chunks:
        part.write.mode("append").parquet(f"{base}/in")
        stream = ingest.stream_chunks(spark, f"{base}/in", samples.schema)
        result = drain(base, stream)
    return result


@_with_spark
def stream_perf_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    def drain(base: str, stream: DataFrame) -> DataFrame:
        counters.start_pdf_sink(
            stream, COUNTER, base, f"{base}/state", delay="1 hour"
        ).awaitTermination()
        return counters.read_pdf(spark, base)

    return _drain_shuffled_samples(spark, sf_dir, drain)


@_with_spark
def stream_perf_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    def drain(base: str, stream: DataFrame) -> DataFrame:
        out = counters.stream_perf_cdf(stream, COUNTER, delay="1 hour")
        ingest.start_table_sink(
            out, f"{base}/out", f"{base}/state", partitions=(), release_held=True
        ).awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{base}/out")

    summed = _drain_shuffled_samples(spark, sf_dir, drain)
    return summed.withColumn(COUNTER, F.round(COUNTER, 3))


@_with_spark
def stream_spans_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = {"fx_span_raw": "ts_ns"}
    return _drain_chunks(spark, sf_dir, views, stateful.stream_spans_overwrite)


@_with_spark
def stream_spans_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = {"fx_span_raw": "ts_ns"}
    return _drain_chunks(spark, sf_dir, views, stateful.stream_spans_keep_first)


@_with_spark
def stream_sched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drain_chunks(spark, sf_dir, {"fx_sched_raw": "ts_us"}, stateful.stream_sched)


@_with_spark
def stream_queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drain_chunks(spark, sf_dir, {"fx_blk_raw": "ts_us"}, stateful.stream_queue_depth)


@_with_spark
def stream_raw_per_cpu_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared table from a stream of raw events, and a query on it."""
    rows = _drain_chunks(spark, sf_dir, {"fx_sched_full": "ts_us"}, stateful.stream_sched)
    queued = rows.where(F.col("what") == "queue").withColumnRenamed("length_us", "quanta_queued_time_us")
    return sched.per_cpu_queued(spec("quanta_queued_time").conform(queued))


@_with_spark
def stream_raw_block_io_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = _drain_chunks(spark, sf_dir, {"fx_blk_full": "ts_us"}, stateful.stream_queue_depth)
    latency = blockio.completion_latency(spark_view(spark, sf_dir, "fx_blk_full"))
    queue, latency = spec("block_io_queue_length").conform(depth), spec("block_io_latency").conform(latency)
    return blockio.block_io_summary(blockio.block_io_join(queue, latency))


# --- scoring -----------------------------------------------------------------------

# A fixed small network over the 64-wide embeddings: any weights serve, these follow a rule.
WIDTHS = (64, 8, 2)


def mlp_layers() -> list[tuple[np.ndarray, np.ndarray]]:
    layers = []
    for width_in, width_out in zip(WIDTHS, WIDTHS[1:]):
        i, o = np.meshgrid(np.arange(width_in), np.arange(width_out))
        layers.append((((7 * o + 3 * i) % 11 - 5) / 8.0, (np.arange(width_out) - 2) / 16.0))
    return layers


@_on("embeddings")
def score_mlp(vectors):
    scored = features.score_mlp(
        vectors, mlp_layers(), id_column="vec_id", vector_column="embedding"
    )
    return scored.select(
        "vec_id",
        F.round(F.col("scores")[0], 6).alias("score_0"),
        F.round(F.col("scores")[1], 6).alias("score_1"),
    )
