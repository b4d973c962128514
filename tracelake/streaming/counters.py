"""Hardware counter samples that arrive in chunks, out of order within a delay.

A sample's increase needs the sample before it, so samples of a CPU are held until the
watermark has passed them: no earlier one can come any more. They then go in order of time,
and only the last of each CPU is remembered. A CPU holds at most what it sampled within
``delay``. Samples that come later than that are dropped, as Spark counts them in
``numRowsDroppedByWatermark``. The rows are those of ``operators.perf`` over the same samples.

What the watermark has not reached at the end of a drain stays in state; a later sample of any
CPU releases it. ``start_table_sink(..., release_held=True)`` ends a drain by the batch that
takes out what its own samples release.

A CPU's held samples are one value of the streaming state, and one task's. ``start_pdf_sink`` keeps
them in a table instead, for chunks that are large beside the executors' memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.operators import perf
from tracelake.sources.commits import commit_table, read_committed
from tracelake.specs import COLLECTION, UPTIME
from tracelake.streaming.block_io import _micros, _open

_ENABLED, _RUNNING = "pmu_enabled_time_us", "pmu_running_time_us"
_WHO = ["pid", "tgid"]
_LAST = "count long, enabled long, running long, total double"
#: Tables of a sink: increases, and after each micro-batch the samples that are held, and those
#: that the next ones of a CPU are measured against.
PDF, HELD, LATEST = "increases", "held", "latest"


def stream_perf_pdf(
    table: DataFrame,
    counter: str,
    *,
    delay: str = "10 seconds",
    scaling: str = "as_sampled",
    wrap_bits: int | None = None,
) -> DataFrame:
    """``perf_pdf`` of a stream: counter increase since the CPU's previous sample, scaled.

    Of a table that is no stream nothing is held: all its samples are there.
    """
    if not table.isStreaming:
        timed = table.where(F.col(UPTIME).isNotNull())
        found = perf.perf_pdf(timed, counter, scaling=scaling, wrap_bits=wrap_bits)
        return found.select(COLLECTION, "cpu", *_WHO, UPTIME, counter, "span_duration_us")
    return _in_order(table, counter, delay, scaling, wrap_bits, summed=False)


def stream_perf_cdf(
    table: DataFrame,
    counter: str,
    *,
    delay: str = "10 seconds",
    scaling: str = "as_sampled",
    wrap_bits: int | None = None,
) -> DataFrame:
    """``perf_cdf`` of a stream: running sum of the increases of a CPU."""
    return _in_order(table, counter, delay, scaling, wrap_bits, summed=True)


def start_pdf_sink(
    table: DataFrame,
    counter: str,
    base: str,
    checkpoint: str,
    *,
    delay: str = "10 seconds",
    scaling: str = "as_sampled",
    wrap_bits: int | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Append ``stream_perf_pdf`` of a stream to a table below ``base``, each row exactly once.

    The rows are those of a sink that ends its drain by releasing what is held. A micro-batch's
    samples and those held before go through ``stream_perf_pdf`` as far as the watermark passes
    them, each CPU's behind the last that it released. That is an ordered scan, which spills and cuts a
    CPU with many samples, so memory grows neither with the chunks nor with ``delay``. With ``interval``
    it keeps draining at that pace; without, it takes what is there and ends.
    """
    if scaling not in ("as_sampled", "extrapolate"):
        raise ValueError(f"unknown scaling {scaling!r}")
    columns = [f"cumulative_{counter}", _ENABLED, _RUNNING]
    samples = table.select(COLLECTION, "cpu", *_WHO, UPTIME, *columns).where(F.col(UPTIME).isNotNull())

    place = [UPTIME, *columns, *_WHO]

    def release(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held, latest = (_open(spark, base, x, number, samples.schema) for x in (HELD, LATEST))
        wait = spark.range(1).select(F.expr(_micros(delay))).first()[0]
        before = _watermark(held.union(latest), wait)
        every = held.union(batch.where(F.col(UPTIME) > before))
        now = max(before, _watermark(every, wait))
        ready = latest.union(every.where(F.col(UPTIME) <= now))
        found = stream_perf_pdf(ready, counter, delay=delay, scaling=scaling, wrap_bits=wrap_bits)
        # The watermark has passed those of before, and no sample that it has passed is new.
        commit_table(found.where(F.col(UPTIME) > before), base, PDF, f"batch-{number}", partitions=())
        last = ready.groupBy(COLLECTION, "cpu").agg(F.max(F.struct(*place)).alias("last"))
        last = last.select(COLLECTION, "cpu", "last.*").select(samples.columns)
        commit_table(last, base, LATEST, f"batch-{number}", partitions=())
        commit_table(every.where(F.col(UPTIME) > now), base, HELD, f"batch-{number}", partitions=())

    writer = samples.writeStream.foreachBatch(release).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


def read_pdf(spark: SparkSession, base: str) -> DataFrame:
    """The increases that ``start_pdf_sink`` has written below ``base``."""
    return read_committed(spark, base, PDF)


def _watermark(samples: DataFrame, wait: int) -> int:
    """Microseconds that a stream's watermark stands at after these samples, in whole milliseconds."""
    last = samples.agg(F.max(UPTIME)).first()[0]
    return 0 if last is None else max(0, (last // 1000 - wait // 1000) * 1000)


def _since(values: pd.Series, before: int | None) -> pd.Series:
    """What each value adds to the one before it; nothing before counts 0."""
    first = pd.Series([0 if before is None else before], dtype="Int64")
    return values - pd.concat([first, values.iloc[:-1]], ignore_index=True).fillna(0)


def _kept(values: pd.Series) -> int | None:
    last = values.iloc[-1]
    return None if pd.isna(last) else int(last)


def _in_order(
    table: DataFrame, counter: str, delay: str, scaling: str, wrap_bits: int | None, summed: bool
) -> DataFrame:
    if scaling not in ("as_sampled", "extrapolate"):
        raise ValueError(f"unknown scaling {scaling!r}")
    cumulative = f"cumulative_{counter}"
    # Ties of time as in the batch operator.
    order = [UPTIME, cumulative, _ENABLED, _RUNNING, *_WHO]
    held_schema = ", ".join(f"held_{i} array<long>" for i in range(len(order)))
    output = "collection_id string, cpu long, pid long, tgid long, ts_uptime_us long"
    output += f", {counter} double, span_duration_us long"

    def scaled(ready: pd.DataFrame, last: tuple) -> tuple[np.ndarray, pd.Series]:
        raw = _since(ready[cumulative], last[0])
        if wrap_bits is not None:
            raw = raw.where(~(raw < 0).fillna(False), raw + (1 << wrap_bits))
        enabled, running = _since(ready[_ENABLED], last[1]), _since(ready[_RUNNING], last[2])
        part, whole = (running, enabled) if scaling == "as_sampled" else (enabled, running)
        part, whole = (x.to_numpy("float64", na_value=np.nan) for x in (part, whole))
        share = np.divide(part, whole, out=np.full(len(part), np.nan), where=whole != 0)
        return raw.to_numpy("float64", na_value=np.nan) * share, running

    def advance(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        last, parts = (None, None, None, 0.0), []
        if state.exists:
            last, held = state.get[:4], state.get[4:]
            parts.append(pd.DataFrame(dict(zip(order, held)), dtype="Int64"))
        if not state.hasTimedOut:
            parts += [b[order].astype("Int64") for b in batches]
        rows = pd.concat(parts, ignore_index=True).sort_values(order, na_position="first")
        passed = (rows[UPTIME] <= state.getCurrentWatermarkMs() * 1000).to_numpy(bool)
        ready, rest = rows[passed].reset_index(drop=True), rows[~passed]
        if len(ready):
            increase, span = scaled(ready, last)
            found = pd.Series(increase, dtype="Float64").mask(np.isnan(increase))
            total = last[3]
            if summed:
                sums = np.cumsum(np.concatenate([[total], np.nan_to_num(increase)]))[1:]
                found, total = pd.Series(sums), float(sums[-1])
            last = (*[_kept(ready[c]) for c in (cumulative, _ENABLED, _RUNNING)], total)
            yield pd.DataFrame(
                {COLLECTION: key[0], "cpu": key[1]}
                | {c: ready[c] for c in (*_WHO, UPTIME)}
                | {counter: found, "span_duration_us": span}
            )
        lists = [[None if pd.isna(x) else int(x) for x in rest[c]] for c in order]
        state.update((*last, *lists))
        if len(rest):
            # Comes up when the watermark has passed the first that is held.
            first = int(rest[UPTIME].iloc[0]) // 1000
            state.setTimeoutTimestamp(max(first, state.getCurrentWatermarkMs()) + 1)

    timed = table.where(F.col(UPTIME).isNotNull()).withColumn("__time", F.timestamp_micros(UPTIME))
    return (
        timed.withWatermark("__time", delay)
        .groupBy(COLLECTION, "cpu")
        .applyInPandasWithState(
            advance, output, f"{_LAST}, {held_schema}", "append", GroupStateTimeout.EventTimeTimeout
        )
    )
