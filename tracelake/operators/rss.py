"""Resident memory of a process over time, and its comparison between policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.columns import ns_to_min
from tracelake.operators.procs import nth_marked_run, run_marks
from tracelake.plans.ordered import TARGET_ROWS, ordered_scan, with_segment
from tracelake.sources.scratch import shared_table
from tracelake.specs import COLLECTION

_PROCESS = [COLLECTION, "tgid"]
_SEG = "__rss_segment"
_PARTS = {"file": "MM_FILEPAGES", "anon": "MM_ANONPAGES", "swap": "MM_SWAPENTS"}


def _filled_total(samples: DataFrame, keys: list[str], order: list[str], segment: str) -> DataFrame:
    """Add ``__total``: sum of the three parts, each filled forward, then backward, then 0.

    Filling backward only matters before a part is first seen, so it is the part's first
    value of the key. Without any sample the total is null.
    """
    part = {p: F.when(F.col("member") == m, F.col("count")) for p, m in _PARTS.items()}
    scan = ordered_scan(
        samples,
        keys,
        order,
        latest={f"__{p}": expr for p, expr in part.items()},
        first={f"__first_{p}": expr for p, expr in part.items()} | {"__any": F.col("member")},
        segment=segment,
    )
    total: Column = F.lit(0).cast("long")
    for p in _PARTS:
        total = total + F.coalesce(F.col(f"__{p}"), F.col(f"__first_{p}"), F.lit(0))
    return scan.withColumn("__total", F.when(F.col("__any").isNotNull(), total))


def rss_total(rss: DataFrame, *, target_rows: int | None = TARGET_ROWS) -> DataFrame:
    """Total resident pages (file + anonymous + swap) of every process at each sample.

    Every sample gives one row, shared-memory samples repeat the current total. Samples
    at the same time are taken in order of member, count and pid.
    """
    cut = with_segment(rss, _PROCESS, "ts_ns", target_rows, _SEG)
    filled = _filled_total(cut, _PROCESS, ["ts_ns", "member", "count", "pid"], _SEG)
    return filled.select(*_PROCESS, "ts_ns", F.col("__total").alias("count"))


def rss_clip(
    rss: DataFrame, windows: DataFrame, *, target_rows: int | None = TARGET_ROWS
) -> DataFrame:
    """Total resident pages inside a time window, with rows at both window ends.

    ``windows`` holds one row per (collection_id, tgid) with ``start_ns`` and ``end_ns``;
    its columns are carried along. Values at the ends continue the last value before
    them, or the first after; a window without samples has null counts.
    """
    # Only the processes asked for are scanned.
    samples = rss.select(*_PROCESS, "ts_ns", "member", "count", "pid")
    wanted = samples.join(windows, _PROCESS, "inner").withColumn("__edge", F.lit(0))
    edges = windows.select(
        *windows.columns,
        F.explode(F.array("start_ns", "end_ns")).alias("ts_ns"),
        F.lit(None).cast("string").alias("member"),
        F.lit(None).cast("long").alias("count"),
        F.lit(None).cast("long").alias("pid"),
        F.lit(1).alias("__edge"),
    )
    rows = with_segment(wanted.unionByName(edges), _PROCESS, "ts_ns", target_rows, _SEG)
    order = ["ts_ns", "__edge", "member", "count", "pid"]
    filled = _filled_total(rows, _PROCESS, order, _SEG)
    extra = [c for c in windows.columns if c not in _PROCESS]
    return filled.where(F.col("ts_ns").between(F.col("start_ns"), F.col("end_ns"))).select(
        *_PROCESS, "ts_ns", F.col("__total").alias("count"), *extra
    )


def rss_windows(
    trace: DataFrame, rss_name: str, rss_index: int, runner_name: str, runner_index: int
) -> DataFrame:
    """Per collection: the process whose memory is read and the run that gives the time.

    The trace is read once for both names when this is called, and the windows, one row a
    collection, are written as a table: what joins them knows their size.
    """
    marks = shared_table(run_marks(trace, sorted({rss_name, runner_name})), "run-marks")
    runner = nth_marked_run(marks, runner_name, runner_index)
    if (rss_name, rss_index) == (runner_name, runner_index):
        windows = runner.select(COLLECTION, F.col("pid").alias("tgid"), "start_ns", "end_ns")
    else:
        target = nth_marked_run(marks, rss_name, rss_index)
        windows = target.select(COLLECTION, F.col("pid").alias("tgid")).join(
            runner.select(COLLECTION, "start_ns", "end_ns"), COLLECTION, "inner"
        )
    return shared_table(windows, "rss-windows")


def rss_policy_comparison(
    trace: DataFrame,
    rss: DataFrame,
    policies: DataFrame,
    rss_name: str,
    rss_index: int,
    runner_name: str,
    runner_index: int,
    *,
    target_rows: int | None = TARGET_ROWS,
) -> DataFrame:
    """Resident pages of one process during a run, per policy, on a common time axis.

    ``policies`` maps ``collection_id`` to ``policy``. All collections go through one
    plan. Columns: collection_id, policy, count, norm_ts_ns, norm_ts_mins.
    """
    windows = rss_windows(trace, rss_name, rss_index, runner_name, runner_index)
    tagged = windows.join(policies, COLLECTION, "inner")
    clipped = rss_clip(rss, tagged, target_rows=target_rows)
    # The earliest row of a window is the one put at its start.
    since = F.col("ts_ns") - F.col("start_ns")
    return clipped.select(
        COLLECTION,
        "policy",
        "count",
        since.alias("norm_ts_ns"),
        ns_to_min(since).alias("norm_ts_mins"),
    )
