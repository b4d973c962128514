"""Exact interpolated quantiles without gathering a group's values in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.plans.ordered import TARGET_ROWS, ordered_scan, with_segment

_SEG = "__value_segment"


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    *,
    mean: str | None = None,
    measured_on: DataFrame | None = None,
    target_rows: int | None = TARGET_ROWS,
) -> DataFrame:
    """One row per key: ``n``, each named quantile (linear interpolation), the mean if named.

    Equal values are counted first (map-side), the counts are summed along the value
    axis with a segmented scan, and each quantile picks the one or two values whose
    rank range holds its position. ``measured_on`` is a cheaper table with the value
    column that holds at least the rows of ``df``, to size the segments by. The mean is in
    doubles, of any size; its last digits may depend on the order of addition.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    if measured_on is not None:
        measured_on = measured_on.withColumn("__v", F.col(value).cast("double"))
    cut = with_segment(counts, keys, "__v", target_rows, _SEG, measured_on)
    ranked = ordered_scan(
        cut,
        keys,
        ["__v"],
        running={"__upto": F.col("__c")},
        total={"n": F.col("__c")},
        segment=_SEG,
    ).withColumn("__from", F.col("__upto") - F.col("__c"))

    picks = []
    for name, q in quantiles.items():
        spot = F.lit(q) * (F.col("n") - 1)
        for side, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            inside = (F.col("__from") <= rank) & (rank < F.col("__upto"))
            picks.append(F.max(F.when(inside, F.col("__v"))).alias(f"__{name}_{side}"))
    if mean is not None:
        picks.append(F.sum(F.col("__v") * F.col("__c")).alias("__sum"))
    gathered = ranked.groupBy(*keys, "n").agg(*picks)
    out = []
    for name, q in quantiles.items():
        spot = F.lit(q) * (F.col("n") - 1)
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((lo + (hi - lo) * (spot - F.floor(spot))).alias(name))
    if mean is not None:
        out.append((F.col("__sum") / F.col("n")).alias(mean))
    return gathered.select(*keys, "n", *out)
