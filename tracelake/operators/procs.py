"""Process lifetimes, names, labels and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.columns import after_first_blank
from tracelake.functions.fixed import COLLECTOR_LABEL
from tracelake.plans.ordered import ordered_scan
from tracelake.sources.scratch import shared_table
from tracelake.specs import COLLECTION, spec

_PROC = [COLLECTION, "pid"]


def _main_rows(trace: DataFrame) -> DataFrame:
    return trace.where(F.col("tgid") == F.col("pid"))


def last_names(trace: DataFrame) -> DataFrame:
    """Last non-empty name of every process, by time (the larger name on a tie)."""
    named = _main_rows(trace).where(F.col("name") != "")
    return named.groupBy(*_PROC).agg(
        F.max(F.struct("ts_ns", "name")).getField("name").alias("full_name")
    )


def process_lifetimes(
    trace: DataFrame, *, duration: bool = True, pairing: str = "all"
) -> DataFrame:
    """Start and end of every process, under its last non-empty name ("" if none).

    ``pairing="all"`` pairs every start of a pid with every end of it, so a reused pid
    yields starts x ends. ``pairing="next_end"`` gives each start the first end at or
    after it, found with an ordered scan instead of a join.
    """
    main = _main_rows(trace)
    starts = main.where(F.col("cap_type") == "start")
    ends = main.where(F.col("cap_type") == "end")
    names = last_names(trace)
    if pairing == "all":
        # Names first: a later filter on the name then cuts the starts before they pair.
        spans = (
            starts.select(*_PROC, F.col("ts_ns").alias("start_ns"))
            .join(names, _PROC, "left")
            .join(ends.select(*_PROC, F.col("ts_ns").alias("end_ns")), _PROC, "inner")
        )
    elif pairing == "next_end":
        # Scanned backwards in time, the end that follows a start is the last one seen.
        marks = main.where(F.col("cap_type").isin("start", "end")).select(
            *_PROC,
            "ts_ns",
            (-F.col("ts_ns")).alias("__back"),
            (F.col("cap_type") == "start").cast("int").alias("__is_start"),
        )
        spans = (
            ordered_scan(
                marks,
                _PROC,
                ["__back", "__is_start"],
                latest={"end_ns": F.when(F.col("__is_start") == 0, F.col("ts_ns"))},
            )
            .where((F.col("__is_start") == 1) & F.col("end_ns").isNotNull())
            .select(*_PROC, F.col("ts_ns").alias("start_ns"), "end_ns")
            .join(names, _PROC, "left")
        )
    else:
        raise ValueError(f"unknown pairing {pairing!r}")
    out = spans.select(
        *_PROC,
        "start_ns",
        F.coalesce("full_name", F.lit("")).alias("full_name"),
        "end_ns",
    )
    if duration:
        out = out.withColumn("duration", F.col("end_ns") - F.col("start_ns"))
    return out


def nth_process_run(lifetimes: DataFrame, name: str, index: int) -> DataFrame:
    """Run number ``index`` (0-based, by start) of the named process, per collection.

    ``index`` is the small run number a user asks for; Spark keeps only the first
    ``index + 1`` rows per collection before shuffling.
    """
    order = Window.partitionBy(COLLECTION).orderBy("start_ns", "end_ns", "pid")
    return (
        lifetimes.where(F.col("full_name") == name)
        .withColumn("__run", F.row_number().over(order))
        .where(F.col("__run") <= index + 1)
        .where(F.col("__run") == index + 1)
        .select(COLLECTION, "pid", "start_ns", "end_ns")
    )


def run_marks(trace: DataFrame, names: list[str]) -> DataFrame:
    """Starts and ends of the processes of these last names ("" if none is known).

    Columns: collection_id, pid, full_name, cap_type, ts_ns.
    """
    marks = _main_rows(trace).where(F.col("cap_type").isin("start", "end"))
    known = last_names(trace)
    if "" in names:
        named = marks.join(known, _PROC, "left").withColumn("full_name", F.coalesce("full_name", F.lit("")))
        named = named.where(F.col("full_name").isin(names))
    else:
        named = marks.join(known.where(F.col("full_name").isin(names)), _PROC)
    return named.select(*_PROC, "full_name", "cap_type", "ts_ns")


def nth_marked_run(marks: DataFrame, name: str, index: int) -> DataFrame:
    """What nth_process_run() finds among all pairs of start and end in run_marks().

    A start stands for as many runs as its pid has ends. The run's start is found by adding
    these up along the starts, of which at most ``index + 1`` times matter; its end is the
    remaining place among the ends of the pids that start then. No pairs are made.
    """
    own = marks.where(F.col("full_name") == name)
    starts = own.where("cap_type = 'start'").select(*_PROC, F.col("ts_ns").alias("start_ns"))
    ends = own.where("cap_type = 'end'").select(*_PROC, F.col("ts_ns").alias("end_ns"))
    runs = starts.join(ends.groupBy(*_PROC).agg(F.count(F.lit(1)).alias("__ends")), _PROC)
    times = runs.groupBy(COLLECTION, "start_ns").agg(F.sum("__ends").alias("__n"))
    order = Window.partitionBy(COLLECTION).orderBy("start_ns")
    few = times.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= index + 1)
    upto = few.withColumn("__upto", F.sum("__n").over(order))
    chosen = upto.where((F.col("__upto") > index) & (F.col("__upto") - F.col("__n") <= index))
    chosen = chosen.select(
        COLLECTION, "start_ns", (F.lit(index + 1) - (F.col("__upto") - F.col("__n"))).alias("__run")
    )
    there = starts.join(chosen, [COLLECTION, "start_ns"]).join(ends, _PROC)
    rank = F.row_number().over(Window.partitionBy(COLLECTION).orderBy("end_ns", "pid"))
    return there.withColumn("__rank", rank).where(F.col("__rank") == F.col("__run")).select(
        COLLECTION, "pid", "start_ns", "end_ns"
    )


def nth_run(trace: DataFrame, name: str, index: int) -> DataFrame:
    """Run number ``index`` of the named process in each collection, without making pairs.

    The process's starts and ends are written once when this is called.
    """
    return nth_marked_run(shared_table(run_marks(trace, [name]), "run-marks"), name, index)


def process_metadata(snapshots: DataFrame) -> DataFrame:
    """One typed row per process from repeated snapshots: the latest started.

    Remaining ties go to the largest row. Numbers arriving as text are cast strictly.
    """
    table = spec("process_metadata")
    typed = table.conform(snapshots)
    rest = [c for c in table.columns if c not in _PROC]
    ranked = ["start_time_unix_sec", *[c for c in rest if c != "start_time_unix_sec"]]
    best = typed.groupBy(*_PROC).agg(F.max(F.struct(*ranked)).alias("__best"))
    return best.select(*[F.col(c) if c in _PROC else F.col(f"__best.{c}") for c in table.columns])


def by_pid(table: DataFrame, pids: int | list[int] | DataFrame) -> DataFrame:
    """Rows of the given process ids: a number, a list, or a table with a ``pid`` column
    (and ``collection_id``, if it has one)."""
    if isinstance(pids, DataFrame):
        on = [c for c in (COLLECTION, "pid") if c in pids.columns]
        return table.join(pids, on, "left_semi")
    return table.where(F.col("pid").isin([pids] if isinstance(pids, int) else list(pids)))


def process_labels(
    pids: DataFrame, metadata: DataFrame | None, system_info: DataFrame | None = None
) -> DataFrame:
    """Label of every (collection_id, pid) row in ``pids``.

    With metadata: name and arguments, or ``PID: n`` for an unknown process. Without:
    ``Collector Process`` for the collector's own pid (from ``system_info``), else
    ``PID: n``.
    """
    unknown = F.concat(F.lit("PID: "), F.col("pid").cast("string"))
    if metadata is not None:
        known = metadata.select(
            *_PROC,
            F.concat(F.col("name"), F.lit(" "), after_first_blank(F.col("cmdline"))).alias("__l"),
        )
        return pids.join(known, _PROC, "left").select(
            *pids.columns, F.coalesce("__l", unknown).alias("label")
        )
    if system_info is None:
        return pids.withColumn("label", unknown)
    owner = system_info.select(COLLECTION, "collection_pid")
    return pids.join(owner, COLLECTION, "left").select(
        *pids.columns,
        F.when(F.col("pid") == F.col("collection_pid"), F.lit(COLLECTOR_LABEL))
        .otherwise(unknown)
        .alias("label"),
    )
