"""Hand-computed frames, one per rule."""

import math

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tracelake import register_counter, spec
from tracelake.functions.columns import (
    advice_label,
    block_4k_ios,
    device_id,
    device_major,
    device_minor,
    request_flags_label,
    rss_member,
    signed_sector,
)
from tracelake.operators import (
    blockio,
    experiments,
    features,
    files,
    memory,
    perf,
    procs,
    rss,
    sched,
    series,
    spans,
)

FAILURE = (PySparkException, Py4JJavaError)
TRACE = "pid long, tgid long, ts_ns long, name string, cap_type string, collection_id string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def trace(spark):
    return spark.createDataFrame(
        [
            # pid 1 is used twice; its last name is "redis"
            (1, 1, 10, "sh", "start", "c"), (1, 1, 20, "", "end", "c"),
            (1, 1, 30, "redis", "start", "c"), (1, 1, 50, "", "end", "c"),
            # pid 2 has only empty names
            (2, 2, 5, "", "start", "c"), (2, 2, 9, "", "end", "c"),
            # a thread
            (3, 1, 11, "thr", "start", "c"), (3, 1, 12, "thr", "end", "c"),
            # same pid in another collection, named by exec only
            (1, 1, 1, "fork", "start", "d"), (1, 1, 2, "make", "exec", "d"), (1, 1, 3, "", "end", "d"),
        ],
        TRACE,
    )


def test_lifetimes_pair_all(trace):
    got = rows(procs.process_lifetimes(trace), "collection_id", "pid", "start_ns", "end_ns", "full_name", "duration")
    assert got == [
        ("c", 1, 10, 20, "redis", 10), ("c", 1, 10, 50, "redis", 40),
        ("c", 1, 30, 20, "redis", -10), ("c", 1, 30, 50, "redis", 20),
        ("c", 2, 5, 9, "", 4), ("d", 1, 1, 3, "make", 2),
    ]
    assert "duration" not in procs.process_lifetimes(trace, duration=False).columns


def test_lifetimes_next_end(trace):
    got = rows(procs.process_lifetimes(trace, pairing="next_end"), "collection_id", "pid", "start_ns", "end_ns")
    assert got == [("c", 1, 10, 20), ("c", 1, 30, 50), ("c", 2, 5, 9), ("d", 1, 1, 3)]
    with pytest.raises(ValueError):
        procs.process_lifetimes(trace, pairing="other")


def test_nth_run(trace):
    runs = procs.process_lifetimes(trace)
    assert rows(procs.nth_process_run(runs, "redis", 1), "pid", "start_ns", "end_ns") == [(1, 10, 50)]
    assert procs.nth_process_run(runs, "redis", 4).count() == 0


def test_metadata_and_labels(spark):
    snaps = spark.createDataFrame(
        [("7", "cc1", "cc1", "100", "1", "0", "/", "c"), ("7", "make", "make -j4 all", "200", "1", "0", "/", "c")],
        "pid string, name string, cmdline string, start_time string, parent string, nice string,"
        " cgroup_path string, collection_id string",
    )
    meta = procs.process_metadata(snaps)
    assert rows(meta, "pid", "name", "start_time_unix_sec", "parent_pid") == [(7, "make", 200, 1)]
    pids = spark.createDataFrame([("c", 7), ("c", 8)], "collection_id string, pid long")
    assert rows(procs.process_labels(pids, meta), "pid", "label") == [(7, "make -j4 all "), (8, "PID: 8")]
    info = spark.createDataFrame([("c", 8)], "collection_id string, collection_pid long")
    assert rows(procs.process_labels(pids, None, info), "pid", "label") == [(7, "PID: 7"), (8, "Collector Process")]
    assert procs.by_pid(meta, 7).count() == 1
    assert procs.by_pid(meta, pids).count() == 1
    with pytest.raises(FAILURE):
        procs.process_metadata(snaps.withColumn("pid", F.lit("x"))).collect()


RSS = "pid long, tgid long, ts_ns long, member string, count long, collection_id string"


@pytest.mark.parametrize("target_rows", [None, 1])
def test_rss_members(spark, target_rows):
    data = [
        (5, 5, 1, "MM_SHMEMPAGES", 99, "c"), (5, 5, 2, "MM_FILEPAGES", 10, "c"),
        (5, 5, 3, "MM_ANONPAGES", 7, "c"), (6, 5, 4, "MM_FILEPAGES", 11, "c"),
        (9, 9, 4, "MM_SHMEMPAGES", 1, "c"),
    ]
    got = rss.rss_total(spark.createDataFrame(data, RSS), target_rows=target_rows)
    # swap never occurs (0); anon is first seen at 3 and filled back.
    assert rows(got, "tgid", "ts_ns", "count") == [(5, 1, 17), (5, 2, 17), (5, 3, 17), (5, 4, 18), (9, 4, 0)]


@pytest.mark.parametrize("target_rows", [None, 1])
def test_rss_clip_edges(spark, target_rows):
    data = [
        (5, 5, 10, "MM_FILEPAGES", 1, "c"), (5, 5, 20, "MM_FILEPAGES", 2, "c"), (5, 5, 30, "MM_FILEPAGES", 3, "c"),
        (6, 6, 5, "MM_ANONPAGES", 4, "c"), (6, 6, 99, "MM_ANONPAGES", 5, "c"),
        (7, 7, 50, "MM_ANONPAGES", 6, "c"),
    ]
    windows = spark.createDataFrame(
        [("c", 5, 10, 30), ("c", 6, 40, 60), ("c", 7, 10, 20), ("c", 8, 1, 2)],
        "collection_id string, tgid long, start_ns long, end_ns long",
    )
    got = rss.rss_clip(spark.createDataFrame(data, RSS), windows, target_rows=target_rows)
    assert rows(got, "tgid", "ts_ns", "count") == sorted(
        [
            # samples on both edges, each followed by the edge row
            (5, 10, 1), (5, 10, 1), (5, 20, 2), (5, 30, 3), (5, 30, 3),
            # none inside: value carried in; none before: value from after; none at all: null
            (6, 40, 4), (6, 60, 4), (7, 10, 6), (7, 20, 6), (8, 1, None), (8, 2, None),
        ],
        key=repr,
    )


def test_rss_policy_comparison(spark):
    trace = spark.createDataFrame(
        [(p, p, t, n, k, c) for c, off in (("a", 0), ("b", 100)) for p, t, n, k in [
            (1, off + 10, "runner", "start"), (1, off + 40, "", "end"),
            (2, off + 5, "server", "start"), (2, off + 90, "", "end")]],
        TRACE,
    )
    samples = spark.createDataFrame(
        [(2, 2, 20, "MM_ANONPAGES", 3, "a"), (2, 2, 120, "MM_ANONPAGES", 8, "b")], RSS
    )
    policies = spark.createDataFrame([("a", "4k"), ("b", "thp")], "collection_id string, policy string")
    got = rss.rss_policy_comparison(trace, samples, policies, "server", 0, "runner", 0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") <= 6  # the trace is not in it
    assert rows(got, "policy", "norm_ts_ns", "count") == [
        ("4k", 0, 3), ("4k", 10, 3), ("4k", 30, 3), ("thp", 0, 8), ("thp", 10, 8), ("thp", 30, 8),
    ]
    assert math.isclose(got.agg(F.max("norm_ts_mins")).first()[0], 30 / 1e9 / 60)


PERF = (
    "cpu long, pid long, tgid long, ts_uptime_us long, collection_id string,"
    " cumulative_dtlb_misses long, pmu_enabled_time_us long, pmu_running_time_us long"
)


@pytest.mark.parametrize("target_rows", [None, 1])
def test_perf_rules(spark, target_rows):
    table = spark.createDataFrame(
        [
            (0, 1, 1, 10, "c", 100, 20, 10), (0, 1, 1, 20, "c", 160, 40, 30),
            (0, 1, 1, 30, "c", 170, 40, 30), (1, 1, 1, 10, "c", 7, 10, 10),
        ],
        PERF,
    )
    pdf = perf.perf_pdf(table, "dtlb_misses", target_rows=target_rows)
    # first row against 0; no enabled time between samples gives null
    assert rows(pdf, "cpu", "ts_uptime_us", "dtlb_misses", "span_duration_us") == [
        (0, 10, 50.0, 10), (0, 20, 60.0, 20), (0, 30, None, 0), (1, 10, 7.0, 10),
    ]
    assert set(pdf.columns) == {"cpu", "pid", "tgid", "ts_uptime_us", "collection_id", "dtlb_misses", "span_duration_us"}
    cdf = perf.perf_cdf(table, "dtlb_misses", target_rows=target_rows)
    assert rows(cdf, "cpu", "ts_uptime_us", "dtlb_misses") == [
        (0, 10, 50.0), (0, 20, 110.0), (0, 30, 110.0), (1, 10, 7.0),
    ]
    rate = perf.perf_rate(table, "dtlb_misses", target_rows=target_rows)
    assert rows(rate, "ts_uptime_us", "cpu", "dtlb_misses_per_msec") == [
        (10, 0, 5000.0), (10, 1, 700.0), (20, 0, 3000.0), (30, 0, None),
    ]
    assert rows(perf.perf_total(table, "dtlb_misses"), "total_dtlb_misses") == [(177,)]
    wide = perf.perf_pdf(table, "dtlb_misses", scaling="extrapolate", target_rows=target_rows)
    assert (0, 10, 200.0) in rows(wide, "cpu", "ts_uptime_us", "dtlb_misses")


def test_perf_wrap_and_new_counter(spark):
    table = spark.createDataFrame(
        [(0, 1, 1, 1, "c", 2**32 - 5, 10, 10), (0, 1, 1, 2, "c", 3, 20, 20)],
        PERF.replace("dtlb_misses", "llc_misses"),
    )
    assert spec(register_counter("llc_misses").name).columns["cumulative_llc_misses"] == "bigint"
    assert (2, 8.0) in rows(perf.perf_pdf(table, "llc_misses", wrap_bits=32), "ts_uptime_us", "llc_misses")
    assert rows(perf.perf_pdf(table, "llc_misses"), "ts_uptime_us", "llc_misses")[1][1] < 0


def quanta(spark, column, values):
    data = [(i % 2, i, i // 2, i, v, "c") for i, v in enumerate(values)]
    return spark.createDataFrame(
        data, f"cpu long, pid long, tgid long, ts_uptime_us long, {column} long, collection_id string"
    )


def test_quanta_limits_and_totals(spark):
    runs = quanta(spark, "quanta_run_length_us", [59_999, 60_000, 100, 200])
    seen = Observation()
    assert sched.valid_quanta(runs, report=seen).count() == 3
    assert seen.get["removed"] == 1
    assert rows(sched.total_runtime(runs), "total_runtime_us") == [(60_299,)]
    assert rows(sched.per_cpu_runtime(runs), "cpu", "cpu_total_runtime_sec") == [(0, 0.060099), (1, 0.0002)]
    assert rows(sched.top_k_runtime(runs, 1), "pid", "quanta_run_length_us") == [(0, 59_999)]
    waits = quanta(spark, "quanta_queued_time_us", [999_999, 1_000_000, 1])
    assert rows(sched.total_queued(waits), "total_queued_time_us") == [(1_000_000,)]
    assert rows(sched.top_k_queued(waits, 5, per_collection=False), "pid") == [(0,), (1,)]


@pytest.mark.parametrize("target_rows", [None, 1])
def test_sched_gaps(spark, target_rows):
    raw = spark.createDataFrame(
        [
            (1, "wakeup", 4, None, "c"), (2, "wakeup_new", 4, None, "c"), (3, "wakeup", 0, None, "c"),
            # 4 runs from 5 to 9; 7 goes off without having run
            (5, "switch", 7, 4, "c"), (9, "switch", 4, 0, "c"),
            # 4 was queued at 9; 0 is never measured
            (12, "switch", 0, 4, "c"), (15, "switch", 4, 7, "c"),
        ],
        "ts_us long, kind string, prev_pid long, next_pid long, collection_id string",
    )
    run = sched.sched_run_time(raw, target_rows=target_rows)
    assert rows(run, "pid", "ts_uptime_us", "quanta_run_length_us") == [(4, 15, 3), (4, 9, 4)]
    wait = sched.sched_queue_time(raw, target_rows=target_rows)
    assert rows(wait, "pid", "ts_uptime_us", "quanta_queued_time_us") == [(4, 12, 3), (4, 5, 3)]


def block_tables(spark):
    queue = spark.createDataFrame(
        [
            (0, 8, 100, 1, 4096, 1000, 1, 3, 4, "c"), (0, 8, 100, 1, 4096, 1000, 1, 5, 6, "c"),
            (0, 8, 200, 1, 4096, 1000, 1, 1, 1, "c"), (0, 8, 300, 1, 4096, 1000, 1, 1, 1, "c"),
            (0, 8, 400, 1, 4096, 1000, 2049, 1, 1, "c"),
        ],
        spec("block_io_queue_length").schema,
    )
    latency = spark.createDataFrame(
        [
            (1, 8, 100, 1, 4096, 1090, 500, 90, 1, "c"), (1, 8, 100, 1, 4096, 1050, 500, 40, 1, "c"),
            (1, 8, 200, 1, 4096, 1000, 500, 1, 1, "c"),  # finish = start
            (1, 8, 300, 1, 4096, 1500, 500, 1, 1, "c"),  # took exactly the latency
            (1, 8, 400, 1, 4096, 90_001_000, 90_000_001, 1, 2049, "c"),  # a very long one
            (1, 8, 400, 1, 4096, 1001, 10, 1, 2049, "d"),  # other collection
        ],
        spec("block_io_latency").schema,
    )
    return queue, latency


def test_block_join_bounds(spark):
    joined = blockio.block_io_join(*block_tables(spark))
    assert rows(joined, "sector", "finish_ts_uptime_us", "measured_latency_us", "block_io_flags_string") == [
        (100, 1050, 50, "Write"), (400, 90_001_000, 90_000_000, "Sync-Write"),
    ]
    assert joined.columns == list(spec("block_io").columns)
    total = blockio.block_io_summary(joined).first()
    assert (total.disk_io_count, total.total_segments, total.max_measured_latency_us) == (2, 2, 90_000_000)
    assert blockio.block_io_join(*block_tables(spark), ordered=True).count() == 2


def test_block_join_of_many_copies(spark):
    queue, latency = block_tables(spark)
    copies = spark.range(3000).select(F.lit(1).alias("__x"))
    many = [t.where("sector = 100").crossJoin(copies).drop("__x") for t in (queue, latency)]
    assert blockio.block_io_pairs(*many).count() == 4
    assert blockio.block_io_join(*many).count() == 1


@pytest.mark.parametrize("target_rows", [None, 1])
def test_queue_depth_unmatched(spark, target_rows):
    raw = spark.createDataFrame(
        [
            (1, "complete", 8, 5, 9, 9, "c"),  # nothing issued
            (2, "issue", 8, 5, 2, 4097, "c"), (3, "issue", 8, 5, 1, 1, "c"),  # issued twice
            (4, "complete", 8, 5, 1, 1, "c"), (5, "complete", 8, 5, 1, 1, "c"),  # completed twice
            (6, "issue", 8, 6, 4, 8192, "c"),
        ],
        "ts_us long, kind string, device long, sector long, segments long, bytes long, collection_id string",
    )
    got = blockio.queue_depth(raw, target_rows=target_rows)
    names = ("ts_uptime_us", "queue_length_segment_ios", "queue_length_4k_ios")
    assert rows(got, *names) == [(2, 2, 2), (3, 3, 3), (6, 6, 4)]


def test_flags_and_codes(spark):
    every = sum(1 << b for b in (11, 12, 13, 14, 15, 17, 19, 20, 21))
    df = spark.createDataFrame([(every + 4,), (0,), (9,), (None,)], "f long")
    got = [r[0] for r in df.select(request_flags_label(F.col("f"))).collect()]
    assert got == [
        "NoWait-Background-ReadAhead-Idle-NoMerge-Priority-ForcedUnitAccess-Metadata-Sync-Unknown",
        "Read", "WriteZeros", None,
    ]
    one = spark.range(1).select(
        advice_label(F.lit(-1)).alias("a"), advice_label(F.lit(7)).alias("b"),
        rss_member(F.lit(2)).alias("m"), block_4k_ios(F.lit(4097)).alias("k"),
        signed_sector(F.lit("18446744073709551615")).alias("s"), signed_sector(F.lit("42")).alias("t"),
        device_id(F.lit(8), F.lit(3)).alias("d"),
    )
    r = one.withColumn("ma", device_major(F.col("d"))).withColumn("mi", device_minor(F.col("d"))).first()
    assert tuple(r) == ("MUNMAP", "UNKNOWN", "MM_SWAPENTS", 2, -1, 42, (8 << 20) | 3, 8, 3)


def test_conform_is_strict(spark):
    raw = spark.createDataFrame(
        [("1", "2", "3", "4", "5", "6", "7")],
        "cpu string, pid string, tgid string, ts_uptime_us string, cumulative_count string,"
        " pmu_enabled_time_us string, pmu_running_time_us string",
    )
    table = spec("dtlb_misses")
    assert table.conform(raw, "c").schema.simpleString() == table.schema.simpleString()
    with pytest.raises(FAILURE):
        table.conform(raw.withColumn("cpu", F.lit("x")), "c").collect()
    with pytest.raises(ValueError):
        table.conform(raw.drop("cpu"), "c")
    ends = spark.createDataFrame(
        [("18446744073709551615",), ("7",)], "sector string"
    ).withColumns({c: F.lit(1) for c in spec("block_io_latency").columns if c not in ("sector", "collection_id", "ts_uptime_us")})
    ends = ends.withColumn("block_io_end_uptime_us", F.lit(5))
    got = spec("block_io_latency").conform(ends, "c")
    assert rows(got, "sector", "ts_uptime_us") == [(-1, 5), (7, 5)]


COLLAPSE = "pid long, tgid long, start_ts_ns long, end_ts_ns long, mm string, referenced long, collection_id string"
OUTCOME = "pid long, tgid long, start_ts_ns long, end_ts_ns long, mm string, isolated boolean, status long, collection_id string"


@pytest.mark.parametrize("target_rows", [None, 1])
def test_collapse_pairing(spark, target_rows):
    calls = spark.createDataFrame(
        [(1, 1, t, t + 5, "m", t, c) for c, ts in (("c", (10, 20, 30)), ("d", (10, 20))) for t in ts], COLLAPSE
    )
    # In d the first event is earlier than the first call, so the first call is dropped.
    events = spark.createDataFrame(
        [(1, 1, t, t, "m", True, t, c) for c, ts in (("c", (11, 21, 31)), ("d", (9,))) for t in ts], OUTCOME
    )
    got = memory.collapse_pairing(calls, events, target_rows=target_rows)
    assert rows(got, "collection_id", "start_ts_ns", "status") == [("c", 10, 11), ("c", 20, 21), ("c", 30, 31), ("d", 20, 9)]
    asof = memory.collapse_pairing(calls, events, mode="asof", target_rows=target_rows)
    assert rows(asof, "collection_id", "start_ts_ns", "status") == [("c", 10, 11), ("c", 20, 21), ("c", 30, 31)]
    with pytest.raises(FAILURE):
        memory.collapse_pairing(calls.where("start_ts_ns < 30"), events, target_rows=target_rows).collect()
    with pytest.raises(FAILURE):
        memory.collapse_pairing(calls.where("collection_id = 'c'"), events, target_rows=target_rows).collect()


SPAN = "tid long, ts_ns long, kind string, name string, ret long, address long, length long, advice long, collection_id string"


@pytest.mark.parametrize("target_rows", [None, 1])
def test_span_modes(spark, target_rows):
    def row(ts, kind, ret=0, address=0):
        return (1, ts, kind, "m", ret, address, 10, 14, "c")

    raw = spark.createDataFrame(
        [row(1, "entry", 0, 100), row(2, "entry", 0, 200), row(3, "return"), row(4, "return"),
         row(5, "entry", 0, 300), row(6, "return", -22), row(7, "return")],
        SPAN,
    )
    over = spans.span_pairs_overwrite(raw, target_rows=target_rows)
    assert rows(over, "start_ts", "end_ts") == [(2, 3), (5, 6)]
    skip = spans.span_pairs_overwrite(raw, is_error=F.col("ret") < 0, target_rows=target_rows)
    assert rows(skip, "start_ts", "end_ts") == [(2, 3), (5, 7)]
    keep = spans.span_pairs_keep_first(raw, target_rows=target_rows)
    assert rows(keep, "tgid", "ts_ns", "address", "advice") == [(1, 1, 100, "MADV_HUGEPAGE")]


@pytest.mark.parametrize("target_rows", [None, 1])
def test_rss_owner(spark, target_rows):
    raw = spark.createDataFrame(
        [(9, 1, "owner", 50, 51, None, None, "c"), (9, 2, "owner", 60, 61, None, None, "c"),
         (9, 3, "stat", None, None, 1, 8193, "c"), (9, 4, "stat", None, None, 1, 8193, "c")],
        "tid long, ts_ns long, kind string, owner_pid long, owner_tgid long, member int, size long, collection_id string",
    )
    got = spans.rss_owner_attach(raw, target_rows=target_rows)
    assert rows(got, "pid", "tgid", "ts_ns", "member", "count") == [(50, 51, 3, "MM_ANONPAGES", 2)]


@pytest.mark.parametrize("target_rows", [None, 1])
def test_decisions(spark, target_rows):
    def row(ts, kind, action=None, v1=0, v2=0):
        return (1, ts, kind, action, v1, v2, "c")

    raw = spark.createDataFrame(
        [
            row(1, "eager_cost_benefit", v1=99, v2=99),  # before any estimate: ignored
            row(2, "mm_estimate_changes", "OTHER"), row(3, "mm_estimate_changes", "EAGER_PAGING"),
            row(4, "eager_cost_benefit", v1=1, v2=2), row(5, "eager_cost_benefit", v1=3, v2=4),
            row(6, "mm_estimate_changes", "RUN_PREZEROING"),  # the first estimate stays
            row(7, "mm_decide", v2=1), row(8, "mm_decide", v2=1),
            row(9, "mm_estimate_changes", "RUN_PREZEROING"), row(10, "daemon_cost", v1=64),
            row(11, "get_avenrun", v1=3 << 11), row(12, "mm_decide"),
        ],
        "tgid_pid long, ts_us long, kind string, action string, v1 long, v2 long, collection_id string",
    )
    eager = spans.decision_eager(raw, target_rows=target_rows)
    assert rows(eager, "freq_cycles", "greatest_range_benefit", "decision") == [(3, 4, True)]
    pre = spans.decision_prezero(raw, target_rows=target_rows).drop("collection_id")
    assert [tuple(r) for r in pre.collect()] == [(3, 1_000_000, 64, 100_000, 300, 0, 0, False)]


def test_meminfo_odd_lines(spark):
    dump = "MemTotal:   10 kB\nno colon here\nHugePages_Total:   3\nCached: 4 kB\nCached: 5 kB\nDirty: x kB\n"
    raw = spark.createDataFrame([(1, dump, "c")], "ts_uptime_us long, procfs_dump string, collection_id string")
    r = memory.meminfo_parse(raw).first()
    assert (r.mem_total_bytes, r.hugepages_total, r.cached_bytes, r.dirty_bytes, r.shmem_total_bytes) == (10240, 3072, 5120, None, 0)
    assert memory.meminfo_parse(raw, hugepage_counts_raw=True).first().hugepages_total == 3
    assert set(spec("memory_usage").columns) == set(memory.meminfo_parse(raw).columns)


def test_files(spark):
    table = spark.createDataFrame(
        [(0, 1, 1, t, i, 5, n, c) for t, i, n, c in [
            (5_000_000, 1, "make", "a"), (9_000_000, 1, "make", "a"), (7_000_000, 2, "vmlinux", "a"),
            (8_000_000, 3, "vmlinux", "a"), (1_000_000, 4, "make", "b")]],
        spec("file_data").schema,
    )
    info = spark.createDataFrame(
        [("a", "linux_build", 4.0), ("b", "redis", 0.0)], "collection_id string, benchmark_name string, uptime_sec double"
    )
    assert rows(files.files_opened(table), "collection_id", "files_opened") == [("a", 3), ("b", 1)]
    assert rows(files.build_markers(table, info), "marker", "occurrence", "seconds") == [
        ("make", "first", 1.0), ("vmlinux", "last", 4.0),
    ]
    assert files.file_events_by_name(table, "none").count() == 0
    opens = spark.createDataFrame(
        [(0, True, 5), (1, False, 0), (1, True, 0), (2, False, 3)], "pid long, created boolean, file_size_bytes long"
    )
    assert rows(files.file_open_admission(opens), "pid", "created") == [(1, True), (2, False)]


def test_experiments(spark):
    lines = spark.createDataFrame(
        [
            ("results/experiment_a/r1/x_results.txt", 1, " 1,000   instructions:k"),
            ("results/experiment_a/r1/x_results.txt", 2, " 3,000   instructions:k"),
            ("results/experiment_a/r2/x_results.txt", 1, "nothing here"),
            ("results/experiment_e_compressor_lz4/r1/x_results.txt", 1, "50 instructions:k"),
            ("results/experiment_b_memory/r1/x_results.txt", 1, "50 instructions:k"),
        ],
        "path string, line_no long, line string",
    )
    got = experiments.experiment_averages(lines).collect()
    assert [(r.short_name, r.runs, r.average_instructions) for r in got] == [
        ("zswap=default", 2, 1500.0), ("compressor=lz4", 1, 50.0),
    ]


def test_bench_and_sections(spark):
    text = "get_iterations {}\tmap_size 256\tvalue_size 8\tTime(ns) {}"
    lines = spark.createDataFrame(
        [("s-x", 1, text.format(10, 100)), ("s-x", 2, text.format(99, 300)), ("one", 1, text.format(10, 5))],
        "system string, line_no long, line string",
    )
    stats = {r.system: r for r in experiments.get_bench_stats(lines).collect()}
    assert (stats["s-x"].average_time_ns, stats["s-x"].variance, stats["s-x"].per_op_ns) == (200.0, 20000.0, 20.0)
    assert stats["one"].variance is None
    assert rows(experiments.get_bench_pivot(lines, ["s-x", "one"]), "data_size", "s_x", "one") == [(8, 20.0, 0.5)]
    log = ["===== SIZE 1 =====", "5", "7", "", "===== KERN SIZE 2 =====", "===== USER SIZE 3 =====", "9.5"]
    table = spark.createDataFrame([("f", i, x) for i, x in enumerate(log)], "path string, line_no long, line string")
    got = experiments.inference_latency_by_size(table)
    assert rows(got, "side", "size", "n", "mean", "median") == [("", 1, 2, 6.0, 6.0), ("USER", 3, 1, 9.5, 9.5)]


def test_grouped_bars(spark):
    lines = spark.createDataFrame(
        [("f", 0, "g1 g2"), ("f", 1, "1 2   x 0.5 "), ("f", 2, "3 4 y 0.1 0.2")], "path string, line_no long, line string"
    )
    got = experiments.grouped_bar_long(lines, 2)
    assert rows(got, "x", "group_label", "y", "error") == [
        ("x", "g1", 1.0, 0.5), ("x", "g2", 2.0, 0.0), ("y", "g1", 3.0, 0.1), ("y", "g2", 4.0, 0.2),
    ]
    plain = spark.createDataFrame([("f", 0, "1.5 x 2")], "path string, line_no long, line string")
    assert rows(experiments.grouped_bar_long(plain, 1), "x", "group_label", "y", "error") == [("x", "", 1.5, 2.0)]


def test_feature_lookup(spark):
    table = spark.createDataFrame([("m", 1, 5)], "map_name string, key long, value long")
    probes = spark.createDataFrame([("m", 1), ("m", 2), ("n", 1)], "map_name string, key long")
    assert rows(features.feature_lookup(probes, table), "map_name", "key", "value", "status") == [
        ("m", 1, 5, "ok"), ("m", 2, None, "no_key"), ("n", 1, None, "no_map"),
    ]


def test_top_processes_and_collector(spark):
    runs = quanta(spark, "quanta_run_length_us", [10, 20, 500, 600, 7, 8])
    info = spark.createDataFrame(
        [("c", 0.0, 2)], "collection_id string, uptime_sec double, collection_pid long"
    )
    got = series.series_top_processes(runs, info, None, k=1)
    assert rows(got.groupBy("series").count(), "series", "count") == [("Collector Process", 2), ("PID: 1", 2)]


def test_score_mlp(spark):
    import numpy as np

    vectors = [[0.5, -1.0, 2.0], [1.0, 1.0, 1.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, v array<double>")
    w1, b1 = np.array([[1.0, 2.0, 3.0], [-1.0, 0.0, 1.0]]), np.array([0.5, -4.0])
    w2, b2 = np.array([[1.0, -1.0]]), np.array([0.25])
    for act, fn in (("relu", lambda x: np.maximum(x, 0)), ("sigmoid", lambda x: 1 / (1 + np.exp(-x)))):
        got = features.score_mlp(df, [(w1, b1), (w2, b2)], id_column="id", vector_column="v", activation=act)
        want = fn(np.array(vectors) @ w1.T + b1) @ w2.T + b2
        have = [r.scores for r in got.orderBy("id").collect()]
        assert np.allclose(have, want, atol=1e-4, rtol=1e-4)
