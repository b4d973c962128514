"""The answer of every query in plain SQL, for DuckDB. ``{name}`` reads a view of views.py."""

from __future__ import annotations

from parity.views import duckdb_sql

LIFETIMES = """
    main AS (SELECT * FROM {fx_process_trace} WHERE tgid = pid),
    named AS (
        SELECT collection_id, pid, name AS full_name,
               row_number() OVER (PARTITION BY collection_id, pid ORDER BY ts_ns DESC, name DESC) AS rn
        FROM main WHERE name <> ''),
    lifetimes AS (
        SELECT s.collection_id, s.pid, s.ts_ns AS start_ns, coalesce(n.full_name, '') AS full_name,
               e.ts_ns AS end_ns, e.ts_ns - s.ts_ns AS duration
        FROM main s JOIN main e ON s.collection_id = e.collection_id AND s.pid = e.pid
             AND s.cap_type = 'start' AND e.cap_type = 'end'
        LEFT JOIN named n ON n.collection_id = s.collection_id AND n.pid = s.pid AND n.rn = 1)"""

# Resident total at each sample, from the rows of a table `samples`.
FILL = """
    marked AS (
        SELECT *, CASE WHEN member = 'MM_FILEPAGES' THEN count END AS f,
               CASE WHEN member = 'MM_ANONPAGES' THEN count END AS a,
               CASE WHEN member = 'MM_SWAPENTS' THEN count END AS s
        FROM samples),
    filled AS (
        SELECT *,
               coalesce(last_value(f IGNORE NULLS) OVER up, first_value(f IGNORE NULLS) OVER down, 0)
             + coalesce(last_value(a IGNORE NULLS) OVER up, first_value(a IGNORE NULLS) OVER down, 0)
             + coalesce(last_value(s IGNORE NULLS) OVER up, first_value(s IGNORE NULLS) OVER down, 0) AS total,
               count(member) OVER (PARTITION BY collection_id, tgid) AS n
        FROM marked
        WINDOW up AS (PARTITION BY collection_id, tgid ORDER BY ts_ns, edge
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               down AS (PARTITION BY collection_id, tgid ORDER BY ts_ns, edge
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""

RSS_WINDOW = (
    LIFETIMES.replace("fx_process_trace", "fx_user_trace")
    + """,
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY collection_id, full_name
                                     ORDER BY start_ns, end_ns, pid) AS run
        FROM lifetimes),
    win AS (
        SELECT t.collection_id, t.pid AS tgid, r.start_ns, r.end_ns
        FROM ranked t JOIN ranked r ON t.collection_id = r.collection_id
        WHERE t.full_name = 'view_0' AND t.run = 1 AND r.full_name = 'fork' AND r.run = 10),
    samples AS (
        SELECT m.collection_id, m.tgid, m.ts_ns, m.member, m.count, 0 AS edge
        FROM {fx_mm_rss_stat} m JOIN win USING (collection_id, tgid)
        UNION ALL
        SELECT collection_id, tgid, start_ns, NULL, NULL, 1 FROM win
        UNION ALL
        SELECT collection_id, tgid, end_ns, NULL, NULL, 1 FROM win),"""
    + FILL
    + """,
    clipped AS (
        SELECT f.collection_id, f.tgid, f.ts_ns, CASE WHEN n > 0 THEN total END AS count, w.start_ns
        FROM filled f JOIN win w USING (collection_id, tgid)
        WHERE f.ts_ns BETWEEN w.start_ns AND w.end_ns)"""
)

DELTAS = """
    lagged AS (
        SELECT *,
               lag(cumulative_dtlb_misses, 1, 0) OVER w AS c0,
               lag(pmu_enabled_time_us, 1, 0) OVER w AS e0,
               lag(pmu_running_time_us, 1, 0) OVER w AS r0
        FROM {fx_perf}
        WINDOW w AS (PARTITION BY collection_id, cpu ORDER BY ts_uptime_us)),
    deltas AS (
        SELECT cpu, pid, tgid, ts_uptime_us, collection_id,
               (cumulative_dtlb_misses - c0)
                 * (CAST(pmu_running_time_us - r0 AS double)
                    / nullif(CAST(pmu_enabled_time_us - e0 AS double), 0)) AS dtlb_misses,
               pmu_running_time_us - r0 AS span_duration_us
        FROM lagged),
    curve AS (
        SELECT cpu, pid, tgid, ts_uptime_us, collection_id, span_duration_us,
               sum(coalesce(dtlb_misses, 0)) OVER (PARTITION BY collection_id, cpu ORDER BY ts_uptime_us
                   ROWS UNBOUNDED PRECEDING) AS dtlb_misses
        FROM deltas)"""

_FLAG_NAMES = [
    ("NoWait", 21), ("Background", 20), ("ReadAhead", 19), ("Idle", 15), ("NoMerge", 14),
    ("Priority", 13), ("ForcedUnitAccess", 17), ("Metadata", 12), ("Sync", 11),
]
FLAG_TEXT = (
    " || ".join(
        f"CASE WHEN (block_io_flags >> {bit}) % 2 = 1 THEN '{name}-' ELSE '' END"
        for name, bit in _FLAG_NAMES
    )
    + """ || CASE block_io_flags % 256 WHEN 0 THEN 'Read' WHEN 1 THEN 'Write' WHEN 2 THEN 'Flush'
        WHEN 3 THEN 'Discard' WHEN 5 THEN 'SecureErase' WHEN 6 THEN 'ZoneReset'
        WHEN 7 THEN 'WriteSame' WHEN 9 THEN 'WriteZeros' ELSE 'Unknown' END"""
)

BLOCK_IO = f"""
    pairs AS (
        SELECT q.cpu, q.device, q.sector, q.segments, q.block_io_bytes, q.ts_uptime_us,
               l.ts_uptime_us AS finish_ts_uptime_us, l.block_latency_us, l.block_io_latency_us,
               q.block_io_flags, q.queue_length_segment_ios, q.queue_length_4k_ios, q.collection_id
        FROM {{fx_block_io_queue}} q JOIN {{fx_block_io_latency}} l
          ON q.device = l.device AND q.sector = l.sector AND q.segments = l.segments
         AND q.block_io_bytes = l.block_io_bytes AND q.block_io_flags = l.block_io_flags
         AND q.collection_id = l.collection_id
        WHERE l.ts_uptime_us - q.ts_uptime_us > 0
          AND l.ts_uptime_us - q.ts_uptime_us < l.block_latency_us),
    block_io AS (
        SELECT *, finish_ts_uptime_us - ts_uptime_us AS measured_latency_us,
               {FLAG_TEXT} AS block_io_flags_string
        FROM pairs
        QUALIFY row_number() OVER (
            PARTITION BY collection_id, cpu, device, sector, segments, block_io_bytes, ts_uptime_us,
                         block_io_flags
            ORDER BY finish_ts_uptime_us, block_latency_us, block_io_latency_us,
                     queue_length_segment_ios, queue_length_4k_ios) = 1)"""

ADVICE = (
    "CASE advice WHEN -1 THEN 'MUNMAP' WHEN 0 THEN 'MADV_NORMAL' WHEN 1 THEN 'MADV_RANDOM'"
    " WHEN 2 THEN 'MADV_SEQUENTIAL' WHEN 3 THEN 'MADV_WILLNEED' WHEN 4 THEN 'MADV_DONTNEED'"
    " WHEN 8 THEN 'MADV_FREE' WHEN 9 THEN 'MADV_REMOVE' WHEN 10 THEN 'MADV_DONTFORK'"
    " WHEN 11 THEN 'MADV_DOFORK' WHEN 12 THEN 'MADV_MERGEABLE' WHEN 13 THEN 'MADV_UNMERGEABLE'"
    " WHEN 14 THEN 'MADV_HUGEPAGE' WHEN 15 THEN 'MADV_NOHUGEPAGE' WHEN 16 THEN 'MADV_DONTDUMP'"
    " WHEN 17 THEN 'MADV_DODUMP' WHEN 18 THEN 'MADV_WIPEONFORK' WHEN 19 THEN 'MADV_KEEPONFORK'"
    " WHEN 20 THEN 'MADV_COLD' WHEN 21 THEN 'MADV_PAGEOUT' WHEN 22 THEN 'MADV_POPULATE_READ'"
    " WHEN 23 THEN 'MADV_POPULATE_WRITE' WHEN 24 THEN 'MADV_DONTNEED_LOCKED'"
    " WHEN 25 THEN 'MADV_COLLAPSE' WHEN 100 THEN 'MADV_HWPOISON' WHEN 101 THEN 'MADV_SOFT_OFFLINE'"
    " ELSE 'UNKNOWN' END"
)

METADATA = """
    metadata AS (
        SELECT CAST(pid AS bigint) AS pid, name, cmdline, CAST(start_time AS bigint) AS start_time_unix_sec,
               CAST(parent AS bigint) AS parent_pid, CAST(nice AS bigint) AS nice, cgroup_path, collection_id
        FROM {fx_process_snapshots}
        QUALIFY row_number() OVER (PARTITION BY collection_id, pid
            ORDER BY CAST(start_time AS bigint) DESC, name DESC, cmdline DESC, CAST(parent AS bigint) DESC,
                     CAST(nice AS bigint) DESC, cgroup_path DESC) = 1)"""

MEMINFO = """
    meminfo AS (
        SELECT ts_uptime_us,
               1024 * coalesce(try_cast(regexp_extract(procfs_dump, 'MemTotal: *([0-9]+)', 1) AS bigint), 0) AS mem_total_bytes,
               CAST(0 AS bigint) AS mem_free_bytes, CAST(0 AS bigint) AS mem_available_bytes,
               CAST(0 AS bigint) AS buffers_bytes,
               1024 * coalesce(try_cast(regexp_extract(procfs_dump, 'Cached: *([0-9]+)', 1) AS bigint), 0) AS cached_bytes,
               CAST(0 AS bigint) AS swap_total_bytes, CAST(0 AS bigint) AS swap_free_bytes,
               CAST(0 AS bigint) AS dirty_bytes, CAST(0 AS bigint) AS writeback_bytes,
               1024 * coalesce(try_cast(regexp_extract(procfs_dump, 'AnonPages: *([0-9]+)', 1) AS bigint), 0) AS anon_pages_total_bytes,
               CAST(0 AS bigint) AS anon_hugepages_total_bytes, CAST(0 AS bigint) AS mapped_total_bytes,
               CAST(0 AS bigint) AS shmem_total_bytes,
               1024 * coalesce(try_cast(regexp_extract(procfs_dump, 'HugePages_Total: *([0-9]+)', 1) AS bigint), 0) AS hugepages_total,
               CAST(0 AS bigint) AS hugepages_free, CAST(0 AS bigint) AS hugepages_reserved,
               CAST(0 AS bigint) AS hugepage_size_bytes, CAST(0 AS bigint) AS hardware_corrupted_bytes,
               collection_id
        FROM {fx_meminfo_raw})"""

MEMORY_SERIES = """
        SELECT m.collection_id, n AS series, m.ts_uptime_us / 1000000.0::double - i.uptime_sec AS x,
               v / 1073741824.0::double AS y, 'Memory (GB)' AS y_axis
        FROM (SELECT collection_id, ts_uptime_us, 'cached_gb' AS n, cached_bytes AS v FROM meminfo
              UNION ALL SELECT collection_id, ts_uptime_us, 'anon_pages_total_gb', anon_pages_total_bytes FROM meminfo
              UNION ALL SELECT collection_id, ts_uptime_us, 'anon_hugepages_total_gb', anon_hugepages_total_bytes FROM meminfo
              UNION ALL SELECT collection_id, ts_uptime_us, 'mapped_total_gb', mapped_total_bytes FROM meminfo
              UNION ALL SELECT collection_id, ts_uptime_us, 'shmem_total_gb', shmem_total_bytes FROM meminfo) m
        JOIN {fx_system_info} i USING (collection_id)"""

X = "t.ts_uptime_us / 1000000.0::double - i.uptime_sec"

# Scheduler marks per thread: 0 wake, 1 on, 2 off.
SCHED = """
    marks AS (
        SELECT collection_id, next_pid AS pid, ts_us, 1 AS step FROM {fx_sched_raw} WHERE kind = 'switch' AND next_pid <> 0
        UNION ALL
        SELECT collection_id, prev_pid, ts_us, 2 FROM {fx_sched_raw} WHERE kind = 'switch' AND prev_pid <> 0
        UNION ALL
        SELECT collection_id, prev_pid, ts_us, 0 FROM {fx_sched_raw} WHERE kind <> 'switch' AND prev_pid <> 0),
    switched AS (
        SELECT *, lag(step) OVER w AS step0, lag(ts_us) OVER w AS ts0 FROM marks WHERE step > 0
        WINDOW w AS (PARTITION BY collection_id, pid ORDER BY ts_us, step)),
    runs AS (
        SELECT collection_id, pid, ts_us AS ts_uptime_us, ts_us - ts0 AS quanta_run_length_us
        FROM switched WHERE step = 2 AND step0 = 1),
    waits AS (
        SELECT collection_id, pid, ts_us, step FROM switched WHERE step = 1 OR step0 = 1
        UNION ALL SELECT collection_id, pid, ts_us, step FROM marks WHERE step = 0),
    chained AS (
        SELECT *, lag(step) OVER w AS step0, lag(ts_us) OVER w AS ts0 FROM waits
        WINDOW w AS (PARTITION BY collection_id, pid ORDER BY ts_us, step)),
    queued AS (
        SELECT collection_id, pid, ts_us AS ts_uptime_us, ts_us - ts0 AS quanta_queued_time_us
        FROM chained WHERE step = 1 AND step0 <> 1)"""

KEEP_FIRST = f"""
    numbered AS (
        SELECT *, count(*) FILTER (WHERE kind = 'return') OVER (PARTITION BY collection_id, tid, name
                    ORDER BY ts_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g
        FROM {{fx_span_raw}}),
    firsts AS (
        SELECT * FROM numbered WHERE kind = 'entry'
        QUALIFY row_number() OVER (PARTITION BY collection_id, tid, name, g ORDER BY ts_ns) = 1),
    calls AS (
        SELECT f.collection_id, f.tid AS tgid, f.ts_ns, f.address, f.length, {ADVICE.replace('CASE advice', 'CASE f.advice')} AS advice
        FROM firsts f JOIN numbered r ON r.kind = 'return' AND r.g = f.g AND r.tid = f.tid
             AND r.name = f.name AND r.collection_id = f.collection_id
        WHERE r.ret = 0)"""

OVERWRITE = """
    followed AS (
        SELECT *, lag(kind) OVER w AS kind0, lag(ts_ns) OVER w AS ts0 FROM {fx_span_raw}
        WINDOW w AS (PARTITION BY collection_id, tid, name ORDER BY ts_ns)),
    spans AS (
        SELECT collection_id, tid AS pid, ts0 AS start_ts, ts_ns AS end_ts, name
        FROM followed WHERE kind = 'return' AND kind0 = 'entry')"""

DEPTH = """
    known AS (
        SELECT *, lag(kind) OVER (PARTITION BY collection_id, device, sector ORDER BY ts_us) AS kind0
        FROM {fx_blk_raw}),
    moves AS (
        SELECT *, CASE WHEN kind = 'issue' THEN 1 ELSE -1 END AS sgn FROM known
        WHERE kind = 'issue' OR kind0 = 'issue'),
    depth AS (
        SELECT *, CAST(sum(sgn * segments) OVER w AS bigint) AS queue_length_segment_ios,
               CAST(sum(sgn * ((bytes + 4095) // 4096)) OVER w AS bigint) AS queue_length_4k_ios
        FROM moves WINDOW w AS (PARTITION BY collection_id, device ORDER BY ts_us ROWS UNBOUNDED PRECEDING)),
    queue AS (
        SELECT collection_id, device, sector, segments, bytes AS block_io_bytes, ts_us AS ts_uptime_us,
               queue_length_segment_ios, queue_length_4k_ios
        FROM depth WHERE kind = 'issue')"""

# Raw events to declared tables: the same steps over fuller rows.
_IO_ORDER = "ORDER BY ts_us, kind DESC, sector, segments, bytes"
RAW_IO = (
    DEPTH.replace("{fx_blk_raw}", "{fx_blk_full}")
    .replace("ORDER BY ts_us", _IO_ORDER)
    .replace("SELECT collection_id, device, sector,", "SELECT collection_id, cpu, block_io_flags, device, sector,")
    + """,
    finished AS (
        SELECT collection_id, cpu, device, sector, segments, bytes AS block_io_bytes, ts_us AS ts_uptime_us,
               (ts_us * 1000 - start_time_ns) // 1000 AS block_latency_us,
               (ts_us * 1000 - io_start_time_ns) // 1000 AS block_io_latency_us, block_io_flags
        FROM {fx_blk_full} WHERE kind = 'complete'),"""
    + BLOCK_IO.replace("{fx_block_io_queue}", "queue").replace("{fx_block_io_latency}", "finished")
)
RAW_SCHED = SCHED.replace("{fx_sched_raw}", "{fx_sched_full}")
RAW_SPANS = OVERWRITE.replace(
    "FROM {fx_span_raw}", "FROM (SELECT * FROM {fx_span_raw} WHERE kind = 'entry' OR ret >= 0)"
)

DECISIONS = """
    numbered AS (
        SELECT *, count(*) FILTER (WHERE kind = 'mm_decide') OVER (PARTITION BY collection_id, tgid_pid
                    ORDER BY ts_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g
        FROM {fx_decision_raw}),
    opened AS (
        SELECT collection_id, tgid_pid, g, min(ts_us) AS t0, arg_min(action, ts_us) AS act
        FROM numbered WHERE kind = 'mm_estimate_changes' AND action IN ('EAGER_PAGING', 'RUN_PREZEROING')
        GROUP BY ALL),
    episodes AS (
        SELECT o.collection_id, o.act,
               arg_max(n.v1, n.ts_us) FILTER (WHERE n.kind = 'eager_cost_benefit') AS cost,
               arg_max(n.v2, n.ts_us) FILTER (WHERE n.kind = 'eager_cost_benefit') AS benefit,
               arg_max(n.v1, n.ts_us) FILTER (WHERE n.kind = 'get_avenrun') AS load,
               arg_max(n.v1, n.ts_us) FILTER (WHERE n.kind = 'prezeroed_used') AS used,
               max(n.v2) FILTER (WHERE n.kind = 'mm_decide') AS decided
        FROM opened o JOIN numbered n ON n.collection_id = o.collection_id AND n.tgid_pid = o.tgid_pid
             AND n.g = o.g AND n.ts_us > o.t0
        GROUP BY o.collection_id, o.tgid_pid, o.g, o.act)"""

EXPERIMENT_SHORT = r"regexp_replace(regexp_replace(experiment, 'experiment_[a-z]_', '', 'g'), '_([^_]*)$', '=\1')"

BENCH = r"""
    parsed AS (
        SELECT system, line_no,
               CAST(regexp_extract(line, 'get_iterations\s+(\d+)', 1) AS bigint) AS iterations,
               CAST(regexp_extract(line, 'map_size\s+(\d+)', 1) AS bigint) AS map_size,
               CAST(regexp_extract(line, 'value_size\s+(\d+)', 1) AS bigint) AS data_size,
               CAST(regexp_extract(line, 'Time\(ns\)\s+(\d+)', 1) AS bigint) AS time_ns
        FROM {fx_get_bench_raw}),
    sums AS (
        SELECT system, data_size, map_size, arg_min(iterations, line_no) AS iterations,
               count(*)::hugeint AS n, sum(time_ns)::hugeint AS s, sum(time_ns::hugeint * time_ns) AS ss
        FROM parsed GROUP BY ALL),
    stats AS (
        SELECT system, data_size, map_size, iterations, s::double / n::double AS average_time_ns,
               (n * ss - s * s)::double / nullif((n * (n - 1))::double, 0) AS variance
        FROM sums)"""

SECTIONS = r"""
    tagged AS (
        SELECT path, line_no, line,
               last_value(CASE WHEN line LIKE '=%' THEN line END IGNORE NULLS) OVER (
                   PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS head
        FROM {fx_timing_lines}),
    timed AS (
        SELECT regexp_extract(head, '(USER|KERN)', 1) AS side,
               CAST(regexp_extract(head, 'SIZE (\d+)', 1) AS bigint) AS size, CAST(line AS double) AS value
        FROM tagged WHERE line NOT LIKE '=%' AND head IS NOT NULL)"""


def _box(value: str) -> str:
    parts = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return ", ".join(f"quantile_cont({value}, {q}) AS {n}" for n, q in parts.items())


_CHUNKED = "SELECT pid, tgid, ts_ns, name, cap_type, collection_id FROM {fx_process_trace}"

ORACLES = {
    # scans, sinks
    "union_by_name_widen": """
        SELECT CAST(pid AS double) AS pid, tgid, ts_ns,
               CASE WHEN collection_id = 'c0' THEN NULL ELSE name END AS name,
               cap_type, CASE WHEN collection_id = 'c2' THEN 1 END AS extra, collection_id
        FROM {fx_process_trace}""",
    "scan_collection_prefix": _CHUNKED + " WHERE collection_id = 'c2'",
    "latest_collection": _CHUNKED + " WHERE collection_id = 'c3'",
    "write_read_roundtrip": _CHUNKED.replace("SELECT", "SELECT 'b' || substr(collection_id, 2) AS benchmark_name,"),
    "committed_write_read": _CHUNKED.replace("SELECT", "SELECT 'b' || substr(collection_id, 2) AS benchmark_name,"),
    "drain_tables": _CHUNKED + " WHERE collection_id <> 'c1'",
    "stream_ingest_chunks": _CHUNKED,
    "table_row_counts": """
        SELECT 'mm_rss_stat' AS table_name, collection_id, count(*) AS rows FROM {fx_mm_rss_stat} GROUP BY ALL
        UNION ALL
        SELECT 'process_trace', collection_id, count(*) FROM {fx_process_trace} GROUP BY ALL
        UNION ALL
        SELECT 'quanta_runtime', collection_id, count(*) FROM {fx_quanta_runtime} GROUP BY ALL""",
    # projections, filters
    "conform_schema": """
        SELECT cpu, pid, tgid, ts_uptime_us, 'run-1' AS collection_id, cumulative_dtlb_misses,
               pmu_enabled_time_us, pmu_running_time_us
        FROM {fx_perf}""",
    "quanta_runtime_valid": "SELECT * FROM {fx_quanta_runtime} WHERE quanta_run_length_us < 60000",
    "quanta_queued_valid": "SELECT * FROM {fx_quanta_queued} WHERE quanta_queued_time_us < 1000000",
    "process_by_pid": "WITH" + METADATA + "SELECT * FROM metadata WHERE pid IN (3, 5, 8, 13)",
    "process_by_pid_table": "WITH" + METADATA
    + """SELECT * FROM metadata
         WHERE (collection_id, pid) IN (SELECT (collection_id, pid) FROM {fx_file_data} WHERE file_name = 'vmlinux')""",
    "file_events_by_name": "SELECT * FROM {fx_file_data} WHERE file_name = 'vmlinux'",
    "flatten_system_info": """
        SELECT collection_id, uptime_sec, cores, 'x86_64' AS architecture,
               CAST(60 AS double) AS collection_time_sec, CAST(4242 AS bigint) AS collection_pid,
               'redis' AS benchmark_name, 'perf,block_io' AS hooks
        FROM {fx_system_info}""",
    "collection_summary": """
        SELECT collection_id, collection_pid AS pid, benchmark_name AS benchmark,
               uptime_sec AS start_uptime_sec, collection_time_sec AS benchmark_time_sec, cores AS cpus
        FROM {fx_system_info}""",
    # joins
    "process_lifetimes": "WITH" + LIFETIMES + "SELECT * FROM lifetimes",
    "process_lifetimes_basic": "WITH" + LIFETIMES
    + "SELECT collection_id, pid, start_ns, full_name, end_ns FROM lifetimes",
    "process_lifetimes_next_end": "WITH" + LIFETIMES
    + """SELECT * FROM lifetimes WHERE end_ns >= start_ns
         QUALIFY row_number() OVER (PARTITION BY collection_id, pid, start_ns ORDER BY end_ns) = 1""",
    "nth_process_run": "WITH" + LIFETIMES
    + """SELECT collection_id, pid, start_ns, end_ns FROM lifetimes WHERE full_name = 'fork'
         QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY start_ns, end_ns, pid) = 3""",
    "process_labels": "WITH" + METADATA
    + """SELECT p.collection_id, p.pid,
                coalesce(m.name || ' ' || substr(m.cmdline || ' ', instr(m.cmdline || ' ', ' ') + 1),
                         'PID: ' || CAST(p.pid AS string)) AS label
         FROM (SELECT DISTINCT collection_id, tgid AS pid FROM {fx_quanta_runtime}) p
         LEFT JOIN metadata m ON m.collection_id = p.collection_id AND m.pid = p.pid""",
    "block_io_join": "WITH" + BLOCK_IO + "SELECT * FROM block_io",
    "collapse_pairing": """
        WITH c AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY start_ts_ns) AS n FROM {fx_collapse_raw}),
             t AS (SELECT *, row_number() OVER (PARTITION BY collection_id ORDER BY start_ts_ns) AS n FROM {fx_trace_collapse})
        SELECT c.collection_id, c.start_ts_ns, c.pid, c.tgid, c.mm, c.referenced, c.unmapped, t.isolated, t.status
        FROM c JOIN t ON c.collection_id = t.collection_id AND c.n = t.n""",
    "collapse_pairing_asof": """
        SELECT c.collection_id, c.start_ts_ns, c.pid, c.tgid, c.mm, c.referenced, c.unmapped, t.isolated, t.status
        FROM {fx_trace_collapse} t ASOF JOIN {fx_collapse_raw} c
          ON t.collection_id = c.collection_id AND t.mm = c.mm AND t.start_ts_ns >= c.start_ts_ns""",
    "normalize_uptime": f"""
        SELECT t.*, {X} AS uptime_since_start_sec
        FROM {{fx_quanta_runtime}} t JOIN {{fx_system_info}} i USING (collection_id)""",
    "feature_lookup": """
        SELECT p.probe_id, p.probe_no, p.map_name, p.key, f.value,
               CASE WHEN f.key IS NOT NULL THEN 'ok'
                    WHEN p.map_name IN (SELECT map_name FROM {fx_features}) THEN 'no_key'
                    ELSE 'no_map' END AS status
        FROM {fx_probes} p LEFT JOIN {fx_features} f ON p.map_name = f.map_name AND p.key = f.key""",
    "feature_map_stats": """
        SELECT map_name, count(*) AS num_keys, CAST(8 AS bigint) AS value_size FROM {fx_features} GROUP BY map_name""",
    # aggregations
    "total_runtime": """
        SELECT collection_id, CAST(sum(quanta_run_length_us) AS bigint) AS total_runtime_us
        FROM {fx_quanta_runtime} WHERE quanta_run_length_us < 60000 GROUP BY ALL""",
    "per_cpu_runtime": """
        SELECT collection_id, cpu, sum(quanta_run_length_us)::double / 1000000.0::double AS cpu_total_runtime_sec
        FROM {fx_quanta_runtime} WHERE quanta_run_length_us < 60000 GROUP BY ALL""",
    "total_queued": """
        SELECT collection_id, CAST(sum(quanta_queued_time_us) AS bigint) AS total_queued_time_us
        FROM {fx_quanta_queued} WHERE quanta_queued_time_us < 1000000 GROUP BY ALL""",
    "per_cpu_queued": """
        SELECT collection_id, cpu, sum(quanta_queued_time_us)::double / 1000000.0::double AS cpu_total_queued_time_sec
        FROM {fx_quanta_queued} WHERE quanta_queued_time_us < 1000000 GROUP BY ALL""",
    "block_io_summary": "WITH" + BLOCK_IO
    + """SELECT collection_id, device, count(*) AS disk_io_count,
                CAST(sum(segments) AS bigint) AS total_segments,
                sum(block_io_bytes)::double / 1048576.0::double AS total_block_io_mb,
                max(segments) AS max_segments, max(block_io_bytes) AS max_block_io_bytes,
                sum(block_latency_us)::double / 1000.0::double AS total_block_latency_ms,
                sum(block_io_latency_us)::double / 1000.0::double AS total_io_block_latency_ms,
                sum(measured_latency_us)::double / 1000.0::double AS total_measured_latency_ms,
                avg(block_latency_us) AS avg_block_latency_us,
                avg(block_io_latency_us) AS avg_io_block_latency_us,
                avg(measured_latency_us) AS avg_measured_latency_us,
                max(block_latency_us) AS max_block_latency_us,
                max(block_io_latency_us) AS max_io_block_latency_us,
                max(measured_latency_us) AS max_measured_latency_us,
                avg(queue_length_segment_ios) AS avg_queue_length_segment_ios,
                avg(queue_length_4k_ios) AS avg_queue_length_4k_ios,
                max(queue_length_segment_ios) AS max_queue_length_segment_ios,
                max(queue_length_4k_ios) AS max_queue_length_4k_ios
         FROM block_io GROUP BY collection_id, device""",
    "perf_total": """
        SELECT collection_id, CAST(sum(m) AS bigint) AS total_dtlb_misses
        FROM (SELECT collection_id, cpu, max(cumulative_dtlb_misses) AS m FROM {fx_perf} GROUP BY ALL)
        GROUP BY ALL""",
    "files_opened": "SELECT collection_id, count(DISTINCT file_inode) AS files_opened FROM {fx_file_data} GROUP BY ALL",
    "file_first_last": """
        SELECT collection_id, file_name, min(ts_uptime_us) AS first_ts_uptime_us, max(ts_uptime_us) AS last_ts_uptime_us
        FROM {fx_file_data} GROUP BY ALL""",
    "experiment_averages": f"""
        WITH last_line AS (
            SELECT path, split_part(path, '/', 2) AS exp,
                   arg_max(CAST(replace(regexp_extract(line, '^ *([0-9,]+)', 1), ',', '') AS bigint), line_no)
                       FILTER (WHERE line LIKE '%instructions:k%') AS instr
            FROM {{fx_experiment_raw}}
            WHERE split_part(path, '/', 2) NOT LIKE '%experiment_b%' AND split_part(path, '/', 2) NOT LIKE '%experiment_k%'
            GROUP BY path),
        named AS (
            SELECT CASE WHEN exp = 'experiment_a' THEN 'experiment_a_zswap_default' ELSE exp END AS experiment,
                   coalesce(instr, 0) AS instr
            FROM last_line)
        SELECT experiment, count(*) AS runs, sum(instr)::double / count(*) AS average_instructions,
               {EXPERIMENT_SHORT} AS short_name, experiment LIKE '%zswap_default%' AS is_default
        FROM named GROUP BY experiment""",
    "get_bench_stats": "WITH" + BENCH
    + """SELECT *, average_time_ns / iterations AS per_op_ns, sqrt(variance) / iterations AS per_op_sd FROM stats""",
    "get_bench_pivot": "WITH" + BENCH
    + """SELECT data_size,
                max(average_time_ns / iterations) FILTER (WHERE system = 'kmod-array') AS kmod_array,
                max(average_time_ns / iterations) FILTER (WHERE system = 'ebpf-map') AS ebpf_map,
                max(average_time_ns / iterations) FILTER (WHERE system = 'user-mmap') AS user_mmap,
                max(sqrt(variance) / iterations) FILTER (WHERE system = 'kmod-array') AS kmod_array_sd,
                max(sqrt(variance) / iterations) FILTER (WHERE system = 'ebpf-map') AS ebpf_map_sd,
                max(sqrt(variance) / iterations) FILTER (WHERE system = 'user-mmap') AS user_mmap_sd
         FROM stats WHERE map_size = 256 GROUP BY data_size""",
    "box_summary": "WITH" + BENCH
    + f"SELECT system, data_size, count(*) AS n, {_box('time_ns::double')} FROM parsed GROUP BY ALL",
    "files_opened_merged": """
        SELECT collection_id, count(file_inode) AS n, count(DISTINCT file_inode) AS files_opened,
               TRUE AS estimate_is_near
        FROM {fx_file_data} GROUP BY ALL""",
    "box_summary_merged": "WITH" + BENCH
    + """SELECT system, data_size, count(time_ns) AS n, min(time_ns::double) AS min, max(time_ns::double) AS max,
                TRUE AS ranks_are_near
         FROM parsed WHERE time_ns IS NOT NULL GROUP BY ALL""",
    "grouped_bar_long": r"""
        WITH heads AS (SELECT path, min(line_no) AS h FROM {fx_bar_lines} GROUP BY path),
             rows AS (
                 SELECT b.path, b.line_no, regexp_split_to_array(rtrim(b.line), '\s+') AS f
                 FROM {fx_bar_lines} b JOIN heads USING (path) WHERE b.line_no > h)
        SELECT path, line_no, f[4] AS x, CAST(g AS bigint) AS group_no, ['ga', 'gb', 'gc'][g + 1] AS group_label,
               CAST(f[g + 1] AS double) AS y, coalesce(CAST(f[g + 5] AS double), 0) AS error
        FROM rows, (SELECT unnest([0, 1, 2]) AS g)""",
    "inference_latency_by_size": "WITH" + SECTIONS
    + f"SELECT side, size, count(*) AS n, {_box('value')}, sum(value::bigint)::double / count(*) AS mean FROM timed GROUP BY ALL",
    "log_lines_by_split": "SELECT path, line_no, line, TRUE AS in_place FROM {fx_timing_lines}",
    "process_metadata_dedup": "WITH" + METADATA + "SELECT * FROM metadata",
    # windows
    "perf_pdf": "WITH" + DELTAS + "SELECT * FROM deltas",
    "perf_cdf": "WITH" + DELTAS
    + """SELECT cpu, pid, tgid, ts_uptime_us, collection_id, span_duration_us, round(dtlb_misses, 3) AS dtlb_misses
         FROM curve""",
    "stream_perf_pdf": "WITH" + DELTAS + "SELECT * FROM deltas",
    "stream_perf_cdf": "WITH" + DELTAS
    + """SELECT cpu, pid, tgid, ts_uptime_us, collection_id, span_duration_us, round(dtlb_misses, 3) AS dtlb_misses
         FROM curve""",
    "perf_pdf_extrapolated": """
        WITH narrow AS (
            SELECT *, cumulative_dtlb_misses & 4294967295 AS c FROM {fx_perf}),
        lagged AS (
            SELECT *, c - lag(c, 1, 0) OVER w AS raw, pmu_enabled_time_us - lag(pmu_enabled_time_us, 1, 0) OVER w AS e,
                   pmu_running_time_us - lag(pmu_running_time_us, 1, 0) OVER w AS r
            FROM narrow WINDOW w AS (PARTITION BY collection_id, cpu ORDER BY ts_uptime_us))
        SELECT cpu, pid, tgid, ts_uptime_us, collection_id, r AS span_duration_us,
               (raw + CASE WHEN raw < 0 THEN 4294967296 ELSE 0 END) * (e::double / nullif(r::double, 0)) AS dtlb_misses
        FROM lagged""",
    "perf_rate": "WITH" + DELTAS
    + "SELECT *, dtlb_misses / nullif(span_duration_us / 1000.0::double, 0) AS dtlb_misses_per_msec FROM deltas",
    "rss_total": "WITH samples AS (SELECT *, 0 AS edge FROM {fx_mm_rss_stat}),"
    + FILL
    + "SELECT collection_id, tgid, ts_ns, total AS count FROM filled",
    "rss_clip": "WITH" + RSS_WINDOW + "SELECT collection_id, tgid, ts_ns, count FROM clipped",
    "rss_policy_comparison": "WITH" + RSS_WINDOW
    + """SELECT collection_id, policy, count, ts_ns - start_ns AS norm_ts_ns,
                (ts_ns - start_ns) / 1e9::double / 60 AS norm_ts_mins
         FROM clipped JOIN {fx_policies} USING (collection_id)""",
    # top k
    "top_k_runtime": """
        SELECT collection_id, tgid AS pid, CAST(sum(quanta_run_length_us) AS bigint) AS quanta_run_length_us
        FROM {fx_quanta_runtime} WHERE quanta_run_length_us < 60000 GROUP BY collection_id, tgid
        QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY sum(quanta_run_length_us) DESC, tgid) <= 3""",
    "top_k_queued": """
        SELECT collection_id, tgid AS pid, CAST(sum(quanta_queued_time_us) AS bigint) AS quanta_queued_time_us
        FROM {fx_quanta_queued} WHERE quanta_queued_time_us < 1000000 GROUP BY ALL
        ORDER BY 3 DESC, 1, 2 LIMIT 5""",
    # scalar functions
    "block_io_flag_labels": f"""
        SELECT block_io_flags, {FLAG_TEXT} AS block_io_flags_string, count(*) AS n
        FROM {{fx_block_io_queue}} GROUP BY ALL""",
    "madvise_labels": f"""
        SELECT collection_id, tid AS tgid, ts_ns, address, length, {ADVICE} AS advice
        FROM {{fx_span_raw}} WHERE kind = 'entry'""",
    "device_major_minor": """
        SELECT device, device // 1048576 AS major, device % 1048576 AS minor, count(*) AS n
        FROM (SELECT (device + 8) * 1048576 + cpu AS device FROM {fx_block_io_queue}) GROUP BY ALL""",
    "meminfo_parse": "WITH" + MEMINFO + "SELECT * FROM meminfo",
    "meminfo_parse_raw_counts": "WITH"
    + MEMINFO.replace("1024 * coalesce(try_cast(regexp_extract(procfs_dump, 'HugePages_Total",
                      "coalesce(try_cast(regexp_extract(procfs_dump, 'HugePages_Total")
    + "SELECT * FROM meminfo",
    # series
    "series_block_queue": "WITH" + BLOCK_IO
    + f"""SELECT t.collection_id, 'Device ' || CAST(t.device AS string) || s.label AS series, {X} AS x,
                CASE s.k WHEN 0 THEN queue_length_segment_ios WHEN 1 THEN queue_length_4k_ios
                     ELSE block_io_latency_us END::double AS y,
                CASE s.k WHEN 2 THEN 'IO Latency (us)' ELSE 'Queue Size' END AS y_axis
         FROM block_io t JOIN {{fx_system_info}} i USING (collection_id),
              (VALUES (0, ' Segment IOs'), (1, ' 4K IOs'), (2, ' Block IO Latency')) s(k, label)""",
    "series_memory": "WITH" + MEMINFO + MEMORY_SERIES,
    "series_quanta_runtime": f"""
        SELECT t.collection_id, 'CPU ' || CAST(t.cpu AS string) AS series, {X} AS x,
               quanta_run_length_us / 1000.0::double AS y, 'Quanta Run Length (msec)' AS y_axis
        FROM {{fx_quanta_runtime}} t JOIN {{fx_system_info}} i USING (collection_id)
        WHERE quanta_run_length_us < 60000""",
    "series_quanta_queued": f"""
        SELECT t.collection_id, 'CPU ' || CAST(t.cpu AS string) AS series, {X} AS x,
               quanta_queued_time_us / 1000.0::double AS y, 'Quanta Queued Time (msec)' AS y_axis
        FROM {{fx_quanta_queued}} t JOIN {{fx_system_info}} i USING (collection_id)
        WHERE quanta_queued_time_us < 1000000""",
    "series_perf_rate": "WITH" + DELTAS + "," + MEMINFO
    + f"""SELECT t.collection_id, 'CPU ' || CAST(t.cpu AS string) AS series, {X} AS x,
                dtlb_misses / nullif(span_duration_us / 1000.0::double, 0) AS y, 'dTLB Misses/msec' AS y_axis
         FROM deltas t JOIN {{fx_system_info}} i USING (collection_id)
         UNION ALL """
    + MEMORY_SERIES,
    "series_perf_cumulative": "WITH" + DELTAS
    + f"""SELECT t.collection_id, 'CPU ' || CAST(t.cpu AS string) AS series, {X} AS x,
                round(dtlb_misses, 3) AS y, 'dTLB Misses' AS y_axis
         FROM curve t JOIN {{fx_system_info}} i USING (collection_id)""",
    "series_top_processes": "WITH" + METADATA
    + f""", top AS (
            SELECT collection_id, tgid FROM {{fx_quanta_runtime}} WHERE quanta_run_length_us < 60000
            GROUP BY collection_id, tgid
            QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY sum(quanta_run_length_us) DESC, tgid) <= 3),
         chosen AS (SELECT collection_id, tgid FROM top UNION SELECT collection_id, collection_pid FROM {{fx_system_info}}),
         labels AS (
            SELECT c.collection_id, c.tgid,
                   CASE WHEN c.tgid = i.collection_pid THEN 'Collector Process'
                        ELSE substr(coalesce(m.name || ' ' || substr(m.cmdline || ' ', instr(m.cmdline || ' ', ' ') + 1),
                                             'PID: ' || CAST(c.tgid AS string)), 1, 35) END AS series
            FROM chosen c JOIN {{fx_system_info}} i USING (collection_id)
            LEFT JOIN metadata m ON m.collection_id = c.collection_id AND m.pid = c.tgid)
         SELECT t.collection_id, l.series, {X} AS x, quanta_run_length_us / 1000.0::double AS y,
                'Quanta Run Length (msec)' AS y_axis
         FROM {{fx_quanta_runtime}} t JOIN labels l USING (collection_id, tgid)
         JOIN {{fx_system_info}} i USING (collection_id)
         WHERE quanta_run_length_us < 60000""",
    "build_markers": """
        SELECT f.collection_id, file_name AS marker, CASE file_name WHEN 'make' THEN 'first' ELSE 'last' END AS occurrence,
               CASE file_name WHEN 'make' THEN min(ts_uptime_us) ELSE max(ts_uptime_us) END / 1000000.0::double
                 - any_value(uptime_sec) AS seconds
        FROM {fx_file_data} f JOIN {fx_system_info} i USING (collection_id)
        WHERE benchmark_name = 'linux_build' GROUP BY f.collection_id, file_name""",
    # raw events
    "raw_per_cpu_runtime": "WITH" + RAW_SCHED
    + """SELECT collection_id, ts_uptime_us % 4 AS cpu,
                sum(quanta_run_length_us)::double / 1000000.0::double AS cpu_total_runtime_sec
         FROM runs WHERE quanta_run_length_us < 60000 GROUP BY ALL""",
    "raw_top_k_runtime": "WITH" + RAW_SCHED
    + """SELECT collection_id, pid // 2 AS pid, CAST(sum(quanta_run_length_us) AS bigint) AS quanta_run_length_us
         FROM runs WHERE quanta_run_length_us < 60000 GROUP BY collection_id, pid // 2
         QUALIFY row_number() OVER (PARTITION BY collection_id
                                    ORDER BY sum(quanta_run_length_us) DESC, pid // 2) <= 3""",
    "raw_per_cpu_queued": "WITH" + RAW_SCHED
    + """SELECT collection_id, ts_uptime_us % 4 AS cpu,
                sum(quanta_queued_time_us)::double / 1000000.0::double AS cpu_total_queued_time_sec
         FROM queued WHERE quanta_queued_time_us < 1000000 GROUP BY ALL""",
    "raw_zswap_runtime": "WITH" + RAW_SPANS
    + "SELECT pid, pid // 2 AS tgid, start_ts, end_ts, name, collection_id FROM spans",
    "queue_depth": "WITH" + DEPTH + "SELECT * FROM queue",
    "sched_run_time": "WITH" + SCHED + "SELECT * FROM runs",
    "sched_queue_time": "WITH" + SCHED + "SELECT * FROM queued",
    "span_pairs_overwrite": "WITH" + OVERWRITE + "SELECT * FROM spans",
    "span_pairs_overwrite_errors": "WITH"
    + OVERWRITE.replace("FROM {fx_span_raw}", "FROM {fx_span_raw} WHERE kind = 'entry' OR ret >= 0")
    + "SELECT * FROM spans",
    "span_pairs_keep_first": "WITH" + KEEP_FIRST + "SELECT * FROM calls",
    "decision_eager": "WITH" + DECISIONS
    + """SELECT coalesce(cost, 0) AS freq_cycles, coalesce(benefit, 0) AS greatest_range_benefit,
                decided <> 0 AS decision, collection_id
         FROM episodes WHERE act = 'EAGER_PAGING' AND decided IS NOT NULL""",
    "decision_prezero": "WITH" + DECISIONS
    + """SELECT coalesce(load, 0) >> 11 AS load, CAST(0 AS bigint) AS daemon_cost, CAST(0 AS bigint) AS prezero_n,
                CAST(100000 AS bigint) AS nfree, CAST(300 AS bigint) AS critical_section_cost,
                CASE WHEN used IS NULL THEN 0 ELSE 1000000 END::bigint AS zeroing_per_page_cost,
                coalesce(used, 0) AS recent_used, decided <> 0 AS decision, collection_id
         FROM episodes WHERE act = 'RUN_PREZEROING' AND decided IS NOT NULL""",
    "file_open_admission": "SELECT * FROM {fx_file_opens_raw} WHERE (created OR file_size_bytes > 0) AND pid <> 0",
    "rss_owner_attach": """
        WITH numbered AS (
            SELECT *, count(*) FILTER (WHERE kind = 'return') OVER (PARTITION BY collection_id, tid
                        ORDER BY ts_ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g
            FROM {fx_span_raw}),
        firsts AS (
            SELECT * FROM numbered WHERE kind = 'entry'
            QUALIFY row_number() OVER (PARTITION BY collection_id, tid, g ORDER BY ts_ns) = 1)
        SELECT f.address // 4096 AS pid, f.address // 8192 AS tgid, r.ts_ns,
               ['MM_FILEPAGES', 'MM_ANONPAGES', 'MM_SWAPENTS', 'MM_SHMEMPAGES'][1 + (r.address // 4096) % 4] AS member,
               r.length // 4096 AS count, r.collection_id
        FROM firsts f JOIN numbered r ON r.kind = 'return' AND r.g = f.g AND r.tid = f.tid
             AND r.collection_id = f.collection_id""",
    "unmap_union": """
        SELECT tid AS tgid, ts_ns, address AS start, address + length AS "end", name <> 'madvise' AS is_huge, collection_id
        FROM {fx_span_raw}""",
    # streams
    "stream_block_io": "WITH" + BLOCK_IO + "SELECT * FROM block_io",
    "stream_spans_overwrite": "WITH" + OVERWRITE + "SELECT * FROM spans",
    "stream_spans_keep_first": "WITH" + KEEP_FIRST + "SELECT * FROM calls",
    "stream_sched": "WITH" + SCHED
    + """SELECT collection_id, pid, ts_uptime_us, 'run' AS what, quanta_run_length_us AS length_us FROM runs
         UNION ALL SELECT collection_id, pid, ts_uptime_us, 'queue', quanta_queued_time_us FROM queued""",
    "stream_queue_depth": "WITH" + DEPTH + "SELECT * FROM queue",
}


def _derived() -> dict[str, str]:
    """Answers that are another query's over other tables."""
    summary = ORACLES["block_io_summary"].replace(BLOCK_IO, RAW_IO)
    queued = (
        ORACLES["series_top_processes"]
        .replace("{fx_quanta_runtime}", "{fx_quanta_queued}")
        .replace("quanta_run_length_us < 60000", "quanta_queued_time_us < 1000000")
        .replace("quanta_run_length_us", "quanta_queued_time_us")
        .replace("Quanta Run Length (msec)", "Quanta Queued Time (msec)")
    )
    return {
        "raw_block_io_summary": summary,
        "stream_raw_block_io_summary": summary,
        "stream_raw_per_cpu_queued": ORACLES["raw_per_cpu_queued"],
        "series_top_queued": queued,
    }


def oracle_sql() -> dict[str, str]:
    return {name: duckdb_sql(text.replace("WITH\n", "WITH \n")) for name, text in (ORACLES | _derived()).items()}


def _score_mlp() -> str:
    """The network of the score_mlp query written out as SQL."""
    from parity.queries import mlp_layers

    (w1, b1), (w2, b2) = mlp_layers()
    hidden = ", ".join(
        f"greatest(list_dot_product(e, {[float(x) for x in w]}::double[]) + ({float(b)})::double, 0) AS h{i}"
        for i, (w, b) in enumerate(zip(w1, b1))
    )
    outs = ", ".join(
        "round("
        + " + ".join(f"h{i} * ({float(x)})::double" for i, x in enumerate(w))
        + f" + ({float(b)})::double, 6) AS score_{o}"
        for o, (w, b) in enumerate(zip(w2, b2))
    )
    return f"""
        SELECT vec_id, {outs}
        FROM (SELECT vec_id, {hidden} FROM (SELECT vec_id, embedding::double[] AS e FROM embeddings))"""


ORACLES["score_mlp"] = _score_mlp()
