"""Scheduler quanta: validity, totals, top processes, and their making from raw events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tracelake.functions.columns import us_to_sec
from tracelake.plans.ordered import TARGET_ROWS, ordered_scan, with_segment
from tracelake.specs import COLLECTION, UPTIME, spec

RUN_LENGTH = "quanta_run_length_us"
QUEUED = "quanta_queued_time_us"


def valid_quanta(
    table: DataFrame, name: str = "quanta_runtime", report: Observation | None = None
) -> DataFrame:
    """Usable rows of a scheduler table. ``report`` receives ``removed`` when the query
    runs, without a second pass."""
    keep = spec(name).valid()
    if report is not None:
        removed = F.count(F.when(keep, None).otherwise(F.lit(1)))
        table = table.observe(report, removed.alias("removed"))
    return table.where(keep)


def _total(table: DataFrame, name: str, column: str, alias: str) -> DataFrame:
    return (
        valid_quanta(table, name).groupBy(COLLECTION).agg(F.sum(column).alias(alias))
    )


def total_runtime(table: DataFrame) -> DataFrame:
    """Run time recorded over all CPUs, per collection."""
    return _total(table, "quanta_runtime", RUN_LENGTH, "total_runtime_us")


def total_queued(table: DataFrame) -> DataFrame:
    """Queue time recorded over all CPUs, per collection."""
    return _total(table, "quanta_queued_time", QUEUED, "total_queued_time_us")


def _per_cpu(table: DataFrame, name: str, column: str, alias: str) -> DataFrame:
    return (
        valid_quanta(table, name)
        .groupBy(COLLECTION, "cpu")
        .agg(us_to_sec(F.sum(column)).alias(alias))
        .orderBy(COLLECTION, alias, "cpu")
    )


def per_cpu_runtime(table: DataFrame) -> DataFrame:
    """Run time per CPU in seconds, ascending."""
    return _per_cpu(table, "quanta_runtime", RUN_LENGTH, "cpu_total_runtime_sec")


def per_cpu_queued(table: DataFrame) -> DataFrame:
    """Queue time per CPU in seconds, ascending."""
    return _per_cpu(table, "quanta_queued_time", QUEUED, "cpu_total_queued_time_sec")


def _top_k(table: DataFrame, name: str, column: str, k: int, per_collection: bool) -> DataFrame:
    # The user-space process id is the thread group id.
    sums = (
        valid_quanta(table, name)
        .groupBy(COLLECTION, F.col("tgid").alias("pid"))
        .agg(F.sum(column).alias(column))
    )
    if not per_collection:
        return sums.orderBy(F.desc(column), COLLECTION, "pid").limit(k)
    rank = Window.partitionBy(COLLECTION).orderBy(F.desc(column), "pid")
    return (
        sums.withColumn("__rank", F.row_number().over(rank)).where(F.col("__rank") <= k)
    ).drop("__rank")


def top_k_runtime(table: DataFrame, k: int, *, per_collection: bool = True) -> DataFrame:
    """The k processes that ran longest, per collection or over all."""
    return _top_k(table, "quanta_runtime", RUN_LENGTH, k, per_collection)


def top_k_queued(table: DataFrame, k: int, *, per_collection: bool = True) -> DataFrame:
    """The k processes that waited longest, per collection or over all."""
    return _top_k(table, "quanta_queued_time", QUEUED, k, per_collection)


# Order of a thread's marks that share a time stamp.
_WAKE, _ON, _OFF = 0, 1, 2
_THREAD = [COLLECTION, "pid"]
_SEG = "__thread_segment"


def _thread_marks(raw: DataFrame, target_rows: int | None) -> DataFrame:
    """One row per thread and mark (wake, on, off). Pid 0, the idle task, has none.

    Raw rows: collection_id, ts_us, kind (``wakeup``, ``wakeup_new``, ``switch``),
    prev_pid, next_pid, and where known cpu, prev_tgid, next_tgid, which the marks then
    carry; a wakeup has the woken thread in prev_pid.
    """
    grouped = "prev_tgid" in raw.columns

    def mark(side: str, step: int) -> Column:
        tgid = [F.col(f"{side}_tgid").alias("tgid")] if grouped else []
        return F.struct(F.col(f"{side}_pid").alias("pid"), F.lit(step).alias("step"), *tgid)

    marked = F.when(
        F.col("kind") == "switch", F.array(mark("next", _ON), mark("prev", _OFF))
    ).when(F.col("kind").isin("wakeup", "wakeup_new"), F.array(mark("prev", _WAKE)))
    cpu = [c for c in ("cpu",) if c in raw.columns]
    marks = (
        raw.select(COLLECTION, "ts_us", *cpu, F.explode(marked).alias("m"))
        .select(COLLECTION, "ts_us", *cpu, "m.*")
        .where(F.col("pid") != 0)
    )
    cut = with_segment(marks, _THREAD, "ts_us", target_rows, _SEG)
    # The last on/off mark before each row tells whether the thread was running.
    state = F.when(F.col("step") != _WAKE, F.struct("step", "ts_us"))
    return ordered_scan(
        cut, _THREAD, ["ts_us", "step"], latest_before={"__state": state}, segment=_SEG
    )


def _carried(marks: DataFrame) -> list[str]:
    return [c for c in ("cpu", "tgid") if c in marks.columns]


def sched_run_time(raw: DataFrame, *, target_rows: int | None = TARGET_ROWS) -> DataFrame:
    """Run quanta from raw scheduler events: an off mark whose last on/off mark is an on.

    With cpu and tgid in the raw rows this is the ``quanta_runtime`` table.
    """
    marks = _thread_marks(raw, target_rows)
    return marks.where(
        (F.col("step") == _OFF) & (F.col("__state.step") == _ON)
    ).select(
        COLLECTION,
        "pid",
        *_carried(marks),
        F.col("ts_us").alias(UPTIME),
        (F.col("ts_us") - F.col("__state.ts_us")).alias(RUN_LENGTH),
    )


def sched_queue_time(raw: DataFrame, *, target_rows: int | None = TARGET_ROWS) -> DataFrame:
    """Queue times from raw scheduler events.

    Waiting begins with a wakeup or with the end of a run, a later one replacing the
    earlier, and ends with the next on mark. With cpu and tgid in the raw rows this is the
    ``quanta_queued_time`` table.
    """
    marks = _thread_marks(raw, target_rows).where(
        (F.col("step") != _OFF) | (F.col("__state.step") == _ON)
    )
    scan = ordered_scan(
        marks.drop("__state"),
        _THREAD,
        ["ts_us", "step"],
        previous={"__step": F.col("step"), "__ts": F.col("ts_us")},
        segment=_SEG,
    )
    return scan.where((F.col("step") == _ON) & (F.col("__step") != _ON)).select(
        COLLECTION,
        "pid",
        *_carried(marks),
        F.col("ts_us").alias(UPTIME),
        (F.col("ts_us") - F.col("__ts")).alias(QUEUED),
    )
