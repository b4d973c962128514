"""Spans and records assembled from raw entry/return events of a thread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import fixed
from tracelake.functions.columns import advice_label, pages, rss_member
from tracelake.plans.ordered import TARGET_ROWS, ordered_scan
from tracelake.specs import COLLECTION

_CALL = [COLLECTION, "tid", "name"]


def span_pairs_overwrite(
    raw: DataFrame,
    *,
    is_error: Column | None = None,
    target_rows: int | None = TARGET_ROWS,
) -> DataFrame:
    """Call spans where a new entry replaces an open one (compressed-swap calls).

    Raw rows: collection_id, tid, ts_ns, kind (``entry``, ``return``), name, and where known
    tgid, with which this is the ``zswap_runtime`` table. A return
    pairs with the row before it if that is an entry. Returns marked ``is_error``
    neither end nor clear a call. At equal times an entry goes before a return.
    """
    rows = raw.withColumn("__ret", (F.col("kind") != "entry").cast("int"))
    if is_error is not None:
        rows = rows.where((F.col("__ret") == 0) | ~F.coalesce(is_error, F.lit(False)))
    group = [c for c in ("tgid",) if c in raw.columns]
    scan = ordered_scan(
        rows.select(*_CALL, *group, "ts_ns", "__ret"),
        _CALL,
        ["ts_ns", "__ret"],
        previous={"__prev_ret": F.col("__ret"), "__prev_ts": F.col("ts_ns")},
        target_rows=target_rows,
    )
    return scan.where((F.col("__ret") == 1) & (F.col("__prev_ret") == 0)).select(
        COLLECTION,
        F.col("tid").alias("pid"),
        *group,
        F.col("__prev_ts").alias("start_ts"),
        F.col("ts_ns").alias("end_ts"),
        "name",
    )


def _episodes(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], target_rows: int | None
) -> DataFrame:
    """Number the stretches between closing rows (``__close`` = 1); a closing row ends its
    own stretch. The count of closing rows before a row is its ``__episode``."""
    scan = ordered_scan(
        rows, keys, order, running={"__closed": F.col("__close")}, target_rows=target_rows
    )
    return scan.withColumn("__episode", F.col("__closed") - F.col("__close"))


def span_pairs_keep_first(
    raw: DataFrame, *, target_rows: int | None = TARGET_ROWS
) -> DataFrame:
    """Successful calls where an open entry is kept until its return (memory advice).

    Raw rows: collection_id, tid, ts_ns, kind, name, ret, address, length, advice. The
    first entry since the last return is the call; a return of 0 emits it, any other
    drops it. For unmap calls give ``advice`` -1 and ``length`` end - start. The owner is
    ``tgid`` if there is such a column, else the thread.
    """
    rows = raw.withColumn("__close", (F.col("kind") != "entry").cast("long"))
    cut = _episodes(rows, _CALL, ["ts_ns", "__close", "address", "length"], target_rows)
    owner = F.col("tgid" if "tgid" in raw.columns else "tid").alias("tgid")
    entry = F.struct("ts_ns", "address", "length", "advice", owner)
    # Each stretch is reduced map-side first, so one of any length stays cheap.
    calls = cut.groupBy(*_CALL, "__episode").agg(
        F.min(F.when(F.col("__close") == 0, entry)).alias("e"),
        F.max(F.when(F.col("__close") == 1, F.col("ret"))).alias("__ret"),
    )
    return calls.where(F.col("e").isNotNull() & (F.col("__ret") == 0)).select(
        COLLECTION,
        "e.tgid",
        "e.ts_ns",
        "e.address",
        "e.length",
        advice_label(F.col("e.advice")).alias("advice"),
    )


def rss_owner_attach(raw: DataFrame, *, target_rows: int | None = TARGET_ROWS) -> DataFrame:
    """Resident-memory samples with the process that owns the memory.

    Raw rows: collection_id, tid, ts_ns, kind (``owner``, ``stat``), owner_pid,
    owner_tgid (owner rows), member, size (stat rows). The first owner row since the
    thread's last stat row names the owner of the next stat row.
    """
    keys = [COLLECTION, "tid"]
    rows = raw.withColumn("__close", (F.col("kind") != "owner").cast("long"))
    cut = _episodes(rows, keys, ["ts_ns", "__close", "size"], target_rows)
    grouped = cut.groupBy(*keys, "__episode").agg(
        F.min(F.when(F.col("__close") == 0, F.struct("ts_ns", "owner_pid", "owner_tgid"))).alias("o"),
        F.max(F.when(F.col("__close") == 1, F.struct("ts_ns", "member", "size"))).alias("s"),
    )
    return grouped.where(F.col("o").isNotNull() & F.col("s").isNotNull()).select(
        F.col("o.owner_pid").alias("pid"),
        F.col("o.owner_tgid").alias("tgid"),
        F.col("s.ts_ns").alias("ts_ns"),
        rss_member(F.col("s.member")).alias("member"),
        pages(F.col("s.size")).alias("count"),
        COLLECTION,
    )


_THREAD = [COLLECTION, "tgid_pid"]


def _decisions(raw: DataFrame, action: str, target_rows: int | None) -> DataFrame:
    """Episodes of ``action``: struct per field kind with the last values set, and the
    decision. Only the first estimate since the last decision opens an episode, and only
    rows after it set fields."""
    kind = F.col("kind")
    opens = (kind == "mm_estimate_changes") & F.col("action").isin("EAGER_PAGING", "RUN_PREZEROING")
    rows = raw.withColumn("__close", (kind == "mm_decide").cast("long"))
    scan = ordered_scan(
        rows,
        _THREAD,
        ["ts_us", "__close", "kind", "v1", "v2"],
        running={"__closed": F.col("__close")},
        latest_before={
            "__mark": F.when(F.col("__close") == 1, F.lit(0)).when(opens, F.lit(1)),
        },
        target_rows=target_rows,
    )
    at = ("ts_us", "kind", "v1", "v2")
    is_open = F.col("__mark") == 1

    def last(of: str) -> Column:
        return F.max(F.when(is_open & (kind == of), F.struct(*at)))

    return (
        scan.withColumn("__episode", F.col("__closed") - F.col("__close"))
        .groupBy(*_THREAD, "__episode")
        .agg(
            F.min(F.when(opens, F.struct("ts_us", "kind", "v1", "v2", "action"))).alias("__first"),
            last("eager_cost_benefit").alias("cost"),
            last("daemon_cost").alias("daemon"),
            last("get_avenrun").alias("load"),
            last("prezeroed_used").alias("used"),
            last("mm_decide").alias("decide"),
        )
        .where((F.col("__first.action") == action) & F.col("decide").isNotNull())
    )


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("long"))


def decision_eager(raw: DataFrame, *, target_rows: int | None = TARGET_ROWS) -> DataFrame:
    """Eager-paging decisions with the cost and benefit they were based on.

    Raw rows: collection_id, tgid_pid, ts_us, kind, action, v1, v2. By kind:
    ``mm_estimate_changes`` (action), ``eager_cost_benefit`` (v1 cost, v2 benefit),
    ``daemon_cost`` (v1 pages to prezero), ``get_avenrun`` (v1 fixed-point load),
    ``prezeroed_used`` (v1 pages used), ``mm_decide`` (v2 decision).
    """
    d = _decisions(raw, "EAGER_PAGING", target_rows)
    return d.select(
        _or_zero(F.col("cost.v1")).alias("freq_cycles"),
        _or_zero(F.col("cost.v2")).alias("greatest_range_benefit"),
        (F.col("decide.v2") != 0).alias("decision"),
        COLLECTION,
    )


def decision_prezero(raw: DataFrame, *, target_rows: int | None = TARGET_ROWS) -> DataFrame:
    """Page prezeroing decisions with their inputs; raw rows as in :func:`decision_eager`."""
    d = _decisions(raw, "RUN_PREZEROING", target_rows)

    def if_seen(kind: str, value: int) -> Column:
        return F.when(F.col(kind).isNotNull(), F.lit(value)).otherwise(F.lit(0)).cast("long")

    return d.select(
        F.shiftright(_or_zero(F.col("load.v1")), fixed.LOAD_FRACTION_BITS).alias("load"),
        if_seen("daemon", fixed.DAEMON_COST).alias("daemon_cost"),
        _or_zero(F.col("daemon.v1")).alias("prezero_n"),
        F.lit(fixed.PREZERO_NFREE).cast("long").alias("nfree"),
        F.lit(fixed.CRITICAL_SECTION_COST).cast("long").alias("critical_section_cost"),
        if_seen("used", fixed.ZEROING_PER_PAGE_COST).alias("zeroing_per_page_cost"),
        _or_zero(F.col("used.v1")).alias("recent_used"),
        (F.col("decide.v2") != 0).alias("decision"),
        COLLECTION,
    )
