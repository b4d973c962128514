"""Hardware counter samples: deltas, cumulative curves, rates, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.plans.ordered import TARGET_ROWS, ordered_scan, with_segment
from tracelake.specs import COLLECTION, UPTIME

_CPU = [COLLECTION, "cpu"]
_ENABLED, _RUNNING = "pmu_enabled_time_us", "pmu_running_time_us"
_SEG = "__counter_segment"


def _order(table: DataFrame, counter: str) -> list[str]:
    ties = [f"cumulative_{counter}", _ENABLED, _RUNNING, "pid", "tgid"]
    return [UPTIME, *[c for c in ties if c in table.columns]]


def _deltas(
    table: DataFrame,
    counter: str,
    scaling: str,
    wrap_bits: int | None,
    target_rows: int | None,
) -> DataFrame:
    """Scaled counter delta ``counter`` and ``span_duration_us``, segment column kept."""
    cumulative = f"cumulative_{counter}"
    cut = with_segment(table, _CPU, UPTIME, target_rows, _SEG)
    scan = ordered_scan(
        cut,
        _CPU,
        _order(table, counter),
        previous={
            "__count": F.col(cumulative),
            "__enabled": F.col(_ENABLED),
            "__running": F.col(_RUNNING),
        },
        segment=_SEG,
    )
    zero = F.lit(0).cast("long")
    raw = F.col(cumulative) - F.coalesce("__count", zero)
    if wrap_bits is not None:
        raw = F.when(raw < 0, raw + F.lit(1 << wrap_bits)).otherwise(raw)
    span = F.col(_RUNNING) - F.coalesce("__running", zero)
    enabled = F.col(_ENABLED) - F.coalesce("__enabled", zero)
    if scaling == "as_sampled":
        scale = F.try_divide(span.cast("double"), enabled.cast("double"))
    elif scaling == "extrapolate":
        scale = F.try_divide(enabled.cast("double"), span.cast("double"))
    else:
        raise ValueError(f"unknown scaling {scaling!r}")
    return scan.withColumns({counter: raw * scale, "span_duration_us": span}).drop(
        "__count", "__enabled", "__running"
    )


def perf_pdf(
    table: DataFrame,
    counter: str,
    *,
    scaling: str = "as_sampled",
    wrap_bits: int | None = None,
    target_rows: int | None = TARGET_ROWS,
) -> DataFrame:
    """Counter increase since the CPU's previous sample, scaled by running/enabled time.

    A CPU's first sample is measured against 0, so it holds the whole counter so far.
    No enabled time between two samples gives null. ``scaling="extrapolate"`` uses
    enabled/running, the usual correction for a counter that shares its hardware slot.
    ``wrap_bits=32`` adds 2^32 where a 32-bit counter wrapped.
    """
    out = _deltas(table, counter, scaling, wrap_bits, target_rows)
    return out.drop(_SEG, f"cumulative_{counter}", _ENABLED, _RUNNING)


def perf_cdf(
    table: DataFrame,
    counter: str,
    *,
    scaling: str = "as_sampled",
    wrap_bits: int | None = None,
    target_rows: int | None = TARGET_ROWS,
) -> DataFrame:
    """Running sum of :func:`perf_pdf` per CPU; a null increase counts 0."""
    deltas = _deltas(table, counter, scaling, wrap_bits, target_rows)
    summed = ordered_scan(
        deltas.withColumnRenamed(counter, "__delta"),
        _CPU,
        _order(table, counter),
        running={counter: F.coalesce("__delta", F.lit(0.0))},
        segment=_SEG,
    )
    return summed.drop("__delta", _SEG, f"cumulative_{counter}", _ENABLED, _RUNNING)


def perf_rate(table: DataFrame, counter: str, **options) -> DataFrame:
    """Counter increase per millisecond of running time; null for an empty span."""
    pdf = perf_pdf(table, counter, **options)
    return pdf.withColumn(
        f"{counter}_per_msec",
        F.try_divide(F.col(counter), F.col("span_duration_us") / F.lit(1_000.0)),
    )


def perf_total(table: DataFrame, counter: str) -> DataFrame:
    """Total count per collection: the highest value of each CPU, summed."""
    cumulative = f"cumulative_{counter}"
    per_cpu = table.groupBy(*_CPU).agg(F.max(cumulative).alias("__max"))
    return per_cpu.groupBy(COLLECTION).agg(F.sum("__max").alias(f"total_{counter}"))
