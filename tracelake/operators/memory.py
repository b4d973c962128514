"""Memory tables: meminfo text, huge-page collapse pairing, advice names, unmap ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import fixed
from tracelake.functions.columns import advice_label
from tracelake.plans.ordered import TARGET_ROWS, ordered_scan
from tracelake.plans.spread import spread_join
from tracelake.specs import COLLECTION, UPTIME


def meminfo_parse(raw: DataFrame, *, hugepage_counts_raw: bool = False) -> DataFrame:
    """Memory usage columns from meminfo text (``procfs_dump``), in bytes.

    A missing key is 0, a value that is no number is null; of a repeated key the last
    line counts. Huge page counts are scaled by 1024 like every other value unless
    ``hugepage_counts_raw`` is set.
    """
    lines = F.filter(F.split("procfs_dump", "\r?\n"), lambda x: x.contains(":"))
    # Last line first, so that the first hit of a key is its last line.
    keys = F.reverse(F.transform(lines, lambda x: F.trim(F.substring_index(x, ":", 1))))
    values = F.reverse(F.transform(lines, lambda x: F.substr(x, F.instr(x, ":") + 1)))

    def number(key: Column) -> Column:
        at = F.array_position("__keys", key).cast("int")
        text = F.trim(F.regexp_replace(F.element_at("__values", at), "kB$", ""))
        return F.when(at == 0, F.lit(0).cast("long")).otherwise(text.try_cast("long"))

    # One lambda for all keys keeps the generated code of a row small.
    names = F.array(*[F.lit(k) for k in fixed.MEMINFO_COLUMNS.values()])
    counts = ("hugepages_total", "hugepages_free", "hugepages_reserved")
    columns = [
        (F.col("__found")[i] * (1 if hugepage_counts_raw and c in counts else 1024)).alias(c)
        for i, c in enumerate(fixed.MEMINFO_COLUMNS)
    ]
    ids = [c for c in (COLLECTION,) if c in raw.columns]
    return (
        raw.withColumns({"__keys": keys, "__values": values})
        .withColumn("__found", F.transform(names, number))
        .select(UPTIME, *columns, *ids)
    )


def madvise_labels(raw: DataFrame, code: str = "advice") -> DataFrame:
    """Replace the advice code by its name."""
    return raw.withColumn(code, advice_label(F.col(code)))


def unmap_union(page_ranges: DataFrame, huge_ranges: DataFrame) -> DataFrame:
    """Unmapped ranges of normal and huge pages as one table with ``is_huge``."""
    return page_ranges.withColumn("is_huge", F.lit(False)).unionByName(
        huge_ranges.withColumn("is_huge", F.lit(True))
    )


def collapse_pairing(
    collapse: DataFrame,
    trace: DataFrame,
    *,
    mode: str = "ordinal",
    target_rows: int | None = TARGET_ROWS,
) -> DataFrame:
    """Huge-page collapse calls with the outcome (isolated, status) of their trace event.

    ``mode="ordinal"`` pairs the n-th call with the n-th event of the collection, by
    start. When the first event is earlier than the first call, the first call is left
    out; counts that differ after that are an error. ``mode="asof"`` gives every event
    the latest call at or before it on the same mm.
    """
    details = [c for c in collapse.columns if c not in (COLLECTION, "start_ts_ns", "end_ts_ns")]
    outcome = [
        c
        for c in trace.columns
        if c not in ("pid", "tgid", "start_ts_ns", "end_ts_ns", "mm", COLLECTION)
    ]
    if mode == "asof":
        return _collapse_asof(collapse, trace, details, outcome, target_rows)
    if mode != "ordinal":
        raise ValueError(f"unknown mode {mode!r}")

    calls, events = (
        table.groupBy(COLLECTION).agg(
            F.min("start_ts_ns").alias(f"__first_{side}"),
            F.count(F.lit(1)).alias(f"__n_{side}"),
        )
        for table, side in ((collapse, "c"), (trace, "t"))
    )
    skip = F.when(F.col("__first_t") < F.col("__first_c"), 1).otherwise(0)
    n_calls = F.coalesce("__n_c", F.lit(0)) - skip
    n_events = F.coalesce("__n_t", F.lit(0))
    message = F.concat(F.lit("collapse and trace counts differ in "), F.col(COLLECTION))
    shifts = calls.join(events, COLLECTION, "full").select(
        COLLECTION, F.when(n_calls == n_events, skip).otherwise(F.raise_error(message)).alias("__s")
    )

    def numbered(table: DataFrame) -> DataFrame:
        order = ["start_ts_ns", *[c for c in table.columns if c not in (COLLECTION, "start_ts_ns")]]
        scan = ordered_scan(
            table,
            [COLLECTION],
            order,
            running={"__n": F.lit(1).cast("long")},
            target_rows=target_rows,
        )
        return spread_join(scan, shifts, [COLLECTION], F.col("__n"))

    left = numbered(collapse).withColumn("__n", F.col("__n") - F.col("__s")).where(F.col("__n") > 0)
    # Reading the shift here too makes events of a collection without calls an error.
    right = numbered(trace).where(F.col("__s") >= 0).select(COLLECTION, "__n", *outcome)
    return left.join(right, [COLLECTION, "__n"], "inner").select(
        COLLECTION, "start_ts_ns", *details, *outcome
    )


def _collapse_asof(
    collapse: DataFrame,
    trace: DataFrame,
    details: list[str],
    outcome: list[str],
    target_rows: int | None,
) -> DataFrame:
    calls = collapse.select(
        COLLECTION,
        "mm",
        F.col("start_ts_ns").alias("__at"),
        F.lit(0).alias("__event"),
        F.struct("start_ts_ns", *details).alias("__call"),
    )
    events = trace.select(
        COLLECTION,
        "mm",
        F.col("start_ts_ns").alias("__at"),
        F.lit(1).alias("__event"),
        F.struct(*outcome).alias("__outcome"),
    )
    rows = calls.unionByName(events, allowMissingColumns=True)
    scan = ordered_scan(
        rows,
        [COLLECTION, "mm"],
        ["__at", "__event", "__call"],
        latest={"__last": F.col("__call")},
        target_rows=target_rows,
    )
    return scan.where((F.col("__event") == 1) & F.col("__last").isNotNull()).select(
        COLLECTION, "__last.*", "__outcome.*"
    )
