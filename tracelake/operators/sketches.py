"""Sketches of chunks: distinct counts and quantiles that merge over chunks and collections.

A chunk is read once, when it arrives, and leaves one small row for each group. Any set of
chunks is then summed up from these rows, without the data: counts, smallest and largest
values are exact, distinct counts and quantiles are within a bound that does not grow with
the data or with the number of merges. The exact operators (``files.files_opened``,
``experiments.box_summary``) stay the default.

Nulls (and NaN, of quantiles) are left out; a group of nothing else has 0 distinct values and no
row of quantiles.
Rows of a chunk must be summed up once: write them with ``sources.commits`` under the chunk's name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2^14 registers of a distinct count: a standard error of 0.8 %.
REGISTERS_LOG2 = 14
#: Size of a quantile sketch: ranks within 0.15 % at a confidence of 99 %.
QUANTILE_SIZE = 2000
_BOX = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def distinct_error(registers_log2: int = REGISTERS_LOG2) -> float:
    """Relative standard error of a merged distinct count."""
    return 1.04 / 2 ** (registers_log2 / 2)


def rank_error(size: int = QUANTILE_SIZE) -> float:
    """How far a quantile's rank may be off, as a part of all values, at a confidence of 99 %."""
    return 2.296 / size**0.9723


def distinct_sketches(
    rows: DataFrame, keys: Sequence[str], column: str, *, registers_log2: int = REGISTERS_LOG2
) -> DataFrame:
    """A row for each group: keys, n (values that are not null), sketch of the distinct ones."""
    value = F.col(column)
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"), F.hll_sketch_agg(value, registers_log2).alias("sketch")
    )


def merged_distinct(sketches: DataFrame, keys: Sequence[str], name: str = "n_distinct") -> DataFrame:
    """Distinct values over all sketches of a group, estimated, and n."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("__merged")
    )
    return merged.select(*keys, "n", F.hll_sketch_estimate("__merged").alias(name))


def quantile_sketches(
    rows: DataFrame, keys: Sequence[str], column: str, *, size: int = QUANTILE_SIZE
) -> DataFrame:
    """A row for each group: keys, n, min, max, and a sketch of the values as doubles."""
    value = F.col(column).cast("double")
    kept = rows.where(value.isNotNull() & ~F.isnan(value))
    return kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.kll_sketch_agg_double(value, size).alias("sketch"),
    )


def merged_quantiles(
    sketches: DataFrame,
    keys: Sequence[str],
    quantiles: Mapping[str, float] = _BOX,
    *,
    size: int = QUANTILE_SIZE,
) -> DataFrame:
    """n, min, max (exact) and quantiles (values that occur) over all sketches of a group."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch", size).alias("__merged"),
    )
    found = [
        F.kll_sketch_get_quantile_double("__merged", F.lit(float(q))).alias(name)
        for name, q in quantiles.items()
    ]
    return merged.select(*keys, "n", "min", "max", *found)
