"""Trace-shaped views over the shared test tables, one text for Spark and DuckDB.

``{name}`` stands for another view or a base table; ``{us}`` and ``{ship}`` for the
engine's way to get microseconds since 1970.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

BASE = ("events", "lineitem", "part", "embeddings", "orders")

_SPARK_US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})"
_DUCKDB_US = "epoch_us({})"

VIEWS = {
    "fx_events": """
        SELECT event_id, user_id, event_type, value, {us} - 1704067200000000 AS us, day(ts) AS d,
               'c' || CAST(user_id % 4 AS string) AS collection_id
        FROM {events}""",
    "fx_system_info": """
        SELECT collection_id, CAST(floor(min(us) / 1e6) AS double) AS uptime_sec,
               CAST(60 AS double) AS collection_time_sec, min(user_id) AS collection_pid,
               CASE collection_id WHEN 'c0' THEN 'linux_build' WHEN 'c1' THEN 'redis'
                    ELSE 'faux' END AS benchmark_name,
               CAST(8 AS bigint) AS cores
        FROM {fx_events} GROUP BY collection_id""",
    "fx_process_trace": """
        SELECT user_id * 31 + d AS pid,
               user_id * 31 + d + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS tgid,
               us * 1000 AS ts_ns,
               CASE event_type WHEN 'purchase' THEN '' WHEN 'signup' THEN 'fork'
                    ELSE event_type || '_' || CAST(event_id % 3 AS string) END AS name,
               CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end'
                    ELSE 'exec' END AS cap_type,
               collection_id
        FROM {fx_events}""",
    # Long-lived processes: one per user, with many runs each.
    "fx_user_trace": """
        SELECT user_id AS pid, user_id + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS tgid,
               us * 1000 AS ts_ns,
               CASE event_type WHEN 'purchase' THEN '' WHEN 'signup' THEN 'fork'
                    ELSE event_type || '_' || CAST(event_id % 3 AS string) END AS name,
               CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end'
                    ELSE 'exec' END AS cap_type,
               collection_id
        FROM {fx_events}""",
    "fx_mm_rss_stat": """
        SELECT user_id AS pid, user_id AS tgid, us * 1000 AS ts_ns,
               CASE event_type WHEN 'click' THEN 'MM_FILEPAGES' WHEN 'view' THEN 'MM_ANONPAGES'
                    WHEN 'purchase' THEN 'MM_SWAPENTS' ELSE 'MM_SHMEMPAGES' END AS member,
               CAST(round(value * 100) AS bigint) AS count, collection_id
        FROM {fx_events}""",
    "fx_policies": """
        SELECT DISTINCT collection_id, 'policy_' || collection_id AS policy FROM {fx_events}""",
    "fx_quanta_runtime": """
        SELECT user_id % 8 AS cpu, user_id AS pid, CAST(floor(user_id / 3) AS bigint) AS tgid,
               us AS ts_uptime_us, CAST(round(value * 1000) AS bigint) AS quanta_run_length_us,
               collection_id
        FROM {fx_events}""",
    "fx_quanta_queued": """
        SELECT user_id % 8 AS cpu, user_id AS pid, CAST(floor(user_id / 3) AS bigint) AS tgid,
               us AS ts_uptime_us, CAST(round(value * 10000) AS bigint) AS quanta_queued_time_us,
               collection_id
        FROM {fx_events}""",
    # A counter that grows with time, without a window over a whole CPU. Time shares are
    # quarters, so that scaled sums are exact in any order.
    "fx_perf": """
        SELECT user_id % 8 AS cpu, user_id AS pid, user_id AS tgid, us AS ts_uptime_us, collection_id,
               us + CAST(round(value * 100) AS bigint) AS cumulative_dtlb_misses,
               us * 4 AS pmu_enabled_time_us, us * (1 + user_id % 4) AS pmu_running_time_us
        FROM {fx_events}""",
    "fx_block_io_queue": """
        SELECT l_partkey % 8 AS cpu, l_suppkey % 4 AS device, l_orderkey AS sector,
               CAST(l_linenumber AS bigint) AS segments,
               CAST(l_quantity AS bigint) * 4096 AS block_io_bytes,
               CAST(floor({ship} / 1000) AS bigint) + l_partkey AS ts_uptime_us,
               l_partkey % 10 + CASE l_returnflag WHEN 'R' THEN 2048 WHEN 'A' THEN 4096 ELSE 0 END
                 + CASE l_linestatus WHEN 'O' THEN 2097152 ELSE 0 END AS block_io_flags,
               CAST(l_linenumber * 2 AS bigint) AS queue_length_segment_ios,
               CAST(l_quantity AS bigint) AS queue_length_4k_ios,
               'c' || CAST(l_orderkey % 4 AS string) AS collection_id
        FROM {lineitem}""",
    "fx_block_io_latency": """
        SELECT l_suppkey % 8 AS cpu, l_suppkey % 4 AS device, l_orderkey AS sector,
               CAST(l_linenumber AS bigint) AS segments,
               CAST(l_quantity AS bigint) * 4096 AS block_io_bytes,
               CAST(floor({ship} / 1000) AS bigint) + l_partkey
                 + CAST(round(l_extendedprice) AS bigint) % 1000 AS ts_uptime_us,
               CAST(round(l_discount * 10000) AS bigint) AS block_latency_us,
               CAST(round(l_discount * 5000) AS bigint) AS block_io_latency_us,
               l_partkey % 10 + CASE l_returnflag WHEN 'R' THEN 2048 WHEN 'A' THEN 4096 ELSE 0 END
                 + CASE l_linestatus WHEN 'O' THEN 2097152 ELSE 0 END AS block_io_flags,
               'c' || CAST(l_orderkey % 4 AS string) AS collection_id
        FROM {lineitem}""",
    "fx_file_data": """
        SELECT user_id % 8 AS cpu, user_id AS pid, user_id AS tgid, us AS ts_uptime_us,
               user_id * 7 + d AS file_inode, CAST(round(value * 100) AS bigint) AS file_size_bytes,
               CASE event_type WHEN 'click' THEN 'make' WHEN 'view' THEN 'bzImage'
                    WHEN 'purchase' THEN 'vmlinux.bin' WHEN 'signup' THEN 'vmlinux.o'
                    ELSE 'vmlinux' END AS file_name,
               collection_id
        FROM {fx_events}""",
    "fx_file_opens_raw": """
        SELECT user_id % 5 AS pid, us AS ts_uptime_us, user_id * 7 + d AS file_inode,
               CAST(round(value * 100) AS bigint) % 3 AS file_size_bytes,
               event_id % 7 = 0 AS created, collection_id
        FROM {fx_events}""",
    "fx_process_snapshots": """
        SELECT CAST(user_id AS string) AS pid, event_type AS name,
               event_type || CASE WHEN event_id % 3 = 0 THEN ''
                    ELSE ' -j' || CAST(event_id % 16 AS string) || ' all' END AS cmdline,
               CAST(1704067200 + CAST(floor(us / 1e6) AS bigint) AS string) AS start_time,
               CAST(user_id % 7 AS string) AS parent, CAST(event_id % 20 AS string) AS nice,
               '/sys' AS cgroup_path, collection_id
        FROM {fx_events}""",
    "fx_meminfo_raw": """
        SELECT us AS ts_uptime_us,
               'MemTotal:       ' || CAST(16000000 + event_id AS string) || ' kB' || chr(10) ||
               'Cached:  ' || CAST(event_id * 3 AS string) || ' kB' || chr(10) ||
               'AnonPages:  ' || CAST(user_id * 11 AS string) || ' kB' || chr(10) ||
               'HugePages_Total:       ' || CAST(event_id % 5 AS string) || chr(10) AS procfs_dump,
               collection_id
        FROM {fx_events}""",
    "fx_sched_raw": """
        SELECT us AS ts_us, CASE event_type WHEN 'click' THEN 'wakeup' WHEN 'signup' THEN 'wakeup_new'
                                 ELSE 'switch' END AS kind,
               user_id % 20 AS prev_pid, (user_id % 20 + 1 + event_id % 19) % 20 AS next_pid,
               collection_id
        FROM {fx_events}""",
    "fx_sched_full": """
        SELECT *, ts_us % 4 AS cpu FROM (
            SELECT CAST(floor(ts_us / 100000) AS bigint) AS ts_us, kind, prev_pid, next_pid, collection_id,
                   CAST(floor(prev_pid / 2) AS bigint) AS prev_tgid, CAST(floor(next_pid / 2) AS bigint) AS next_tgid
            FROM {fx_sched_raw})""",
    "fx_blk_full": """
        SELECT us AS ts_us, 'issue' AS kind, user_id % 3 AS device, user_id AS sector, event_id % 16 + 1 AS segments,
               CAST(round(value * 100) AS bigint) AS bytes, event_id % 4 AS cpu, event_id % 3 AS block_io_flags,
               CAST(NULL AS bigint) AS start_time_ns, CAST(NULL AS bigint) AS io_start_time_ns, collection_id
        FROM {fx_events}
        UNION ALL
        SELECT us + event_id % 5000 + 1, 'complete', user_id % 3, user_id, event_id % 16 + 1,
               CAST(round(value * 100) AS bigint), event_id % 4, event_id % 3,
               us * 1000 - 1500, us * 1000 - 500, collection_id
        FROM {fx_events} WHERE event_id % 7 <> 0""",
    "fx_span_raw": """
        SELECT user_id AS tid, us * 1000 AS ts_ns,
               CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'entry' ELSE 'return' END AS kind,
               CASE event_id % 3 WHEN 0 THEN 'zswap_store' WHEN 1 THEN 'zswap_load'
                    ELSE 'madvise' END AS name,
               CASE WHEN event_id % 5 = 0 THEN -22 ELSE 0 END AS ret,
               event_id * 4096 AS address, CAST(round(value) AS bigint) * 4096 AS length,
               event_id % 28 - 1 AS advice, collection_id
        FROM {fx_events}""",
    "fx_blk_raw": """
        SELECT us AS ts_us,
               CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'issue' ELSE 'complete' END AS kind,
               user_id % 3 AS device, user_id AS sector, event_id % 16 + 1 AS segments,
               CAST(round(value * 100) AS bigint) AS bytes, collection_id
        FROM {fx_events}""",
    "fx_collapse_raw": """
        SELECT user_id AS pid, user_id AS tgid, us * 1000 AS start_ts_ns, us * 1000 + 5 AS end_ts_ns,
               'mm' || CAST(user_id AS string) AS mm, event_id % 4 AS referenced,
               event_id % 3 AS unmapped, collection_id
        FROM {fx_events} WHERE event_type = 'click'""",
    "fx_trace_collapse": """
        SELECT user_id AS pid, user_id AS tgid, us * 1000 + 50 AS start_ts_ns, us * 1000 + 55 AS end_ts_ns,
               'mm' || CAST(user_id AS string) AS mm, event_id % 2 = 0 AS isolated,
               event_id % 6 AS status, collection_id
        FROM {fx_events} WHERE event_type = 'click'""",
    "fx_decision_raw": """
        SELECT user_id AS tgid_pid, us AS ts_us,
               CASE event_type WHEN 'click' THEN 'mm_estimate_changes' WHEN 'view' THEN 'eager_cost_benefit'
                    WHEN 'signup' THEN 'get_avenrun' WHEN 'error' THEN 'prezeroed_used'
                    ELSE 'mm_decide' END AS kind,
               CASE event_id % 3 WHEN 0 THEN 'EAGER_PAGING' WHEN 1 THEN 'RUN_PREZEROING'
                    ELSE 'OTHER' END AS action,
               CAST(round(value * 100) AS bigint) AS v1, event_id % 2 AS v2, collection_id
        FROM {fx_events}""",
    "fx_experiment_raw": """
        SELECT 'results/' || CASE user_id % 5 WHEN 0 THEN 'experiment_a' WHEN 1 THEN 'experiment_b_memory_2G'
                    WHEN 2 THEN 'experiment_c_accept_threshold_60' WHEN 3 THEN 'experiment_e_compressor_lz4'
                    ELSE 'experiment_k_cgroup_writeback_off' END
               || '/run_' || CAST(user_id AS string) || '/perf_results.txt' AS path,
               event_id AS line_no,
               '   ' || CAST(CAST(1 + event_id % 999 AS bigint) AS string) || ','
               || CAST(100 + user_id % 900 AS string) || '      ' ||
               CASE WHEN event_type = 'click' THEN 'instructions:k' ELSE 'cycles:k' END AS line
        FROM {fx_events}""",
    "fx_get_bench_raw": """
        SELECT CASE user_id % 3 WHEN 0 THEN 'kmod-array' WHEN 1 THEN 'ebpf-map' ELSE 'user-mmap' END AS system,
               event_id AS line_no,
               'get_iterations 100000' || chr(9) || 'map_size '
               || CASE WHEN event_id % 2 = 0 THEN '256' ELSE '512' END || chr(9) ||
               'value_size ' || CASE d % 3 WHEN 0 THEN '8' WHEN 1 THEN '64' ELSE '512' END || chr(9) ||
               'Time(ns) ' || CAST(CAST(round(value * 10000) AS bigint) AS string) AS line
        FROM {fx_events}""",
    # One timing log per user; sign-ups are its section headers.
    "fx_timing_lines": """
        SELECT 'logs/user_' || CAST(user_id AS string) || '.txt' AS path, event_id AS line_no,
               CASE WHEN event_type = 'signup'
                    THEN '============= ' || CASE event_id % 3 WHEN 0 THEN 'USER ' WHEN 1 THEN 'KERN '
                         ELSE '' END || 'SIZE ' || CAST(event_id % 4 + 1 AS string) || ' ================'
                    ELSE CAST(CAST(round(value * 100) AS bigint) AS string) END AS line
        FROM {fx_events}""",
    # One bar file per supplier: a header line, then a line per item.
    "fx_bar_lines": """
        SELECT DISTINCT 'bars/' || CAST(l_suppkey AS string) AS path, CAST(-1 AS bigint) AS line_no,
               'ga gb gc' AS line
        FROM {lineitem}
        UNION ALL
        SELECT 'bars/' || CAST(l_suppkey AS string), l_orderkey * 8 + l_linenumber,
               CAST(l_linenumber AS string) || ' ' || CAST(l_orderkey % 97 AS string) || '   '
               || CAST(l_partkey % 89 AS string) || ' x' || CAST(l_orderkey % 13 AS string)
               || CASE WHEN l_partkey % 2 = 0 THEN ' 1 2 3  ' ELSE '' END
        FROM {lineitem}""",
    "fx_features": """
        SELECT 'map' || CAST(p_size % 4 AS string) AS map_name, p_partkey AS key,
               CAST(round(p_retailprice * 100) AS bigint) AS value
        FROM {part}""",
    "fx_probes": """
        SELECT l_orderkey AS probe_id, l_linenumber AS probe_no,
               'map' || CAST(l_suppkey % 6 AS string) AS map_name, l_partkey AS key
        FROM {lineitem}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def needs(text: str) -> list[str]:
    """Names a text reads, in order of appearance."""
    return [n for n in dict.fromkeys(_NAME.findall(text)) if n not in ("us", "ship")]


def _closure(text: str) -> list[str]:
    """Views a text needs, each after those it needs itself."""
    out: list[str] = []
    for name in needs(text):
        if name in VIEWS:
            for inner in [*_closure(VIEWS[name]), name]:
                if inner not in out:
                    out.append(inner)
    return out


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view (or base table) as a Spark table over the files in ``sf_dir``."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name].replace("{us}", _SPARK_US.format("ts"))
    text = text.replace("{ship}", _SPARK_US.format("l_shipdate"))
    return spark.sql(text, **{n: spark_view(spark, sf_dir, n) for n in needs(text)})


@lru_cache
def duckdb_sql(query: str) -> str:
    """``query`` with every view it reads put in front as a common table."""
    parts = []
    for name in _closure(query):
        text = VIEWS[name].replace("{us}", _DUCKDB_US.format("ts"))
        text = text.replace("{ship}", _DUCKDB_US.format("l_shipdate"))
        parts.append(f"{name} AS ({_NAME.sub(r'\1', text).strip()})")
    body = _NAME.sub(r"\1", query).strip()
    if not parts:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
