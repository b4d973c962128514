"""Point-in-interval join on equal keys that does not pair up a whole hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels of blocks are so many powers of two apart.
_STEP = 2
# A level's points are dealt into up to _PARTS parts, its intervals copied to each, as long as
# the copies are a _COPIES-th of all intervals at most.
_PARTS, _COPIES = 64, 8


def _levels(spans: DataFrame) -> Column:
    """The levels in use, each with its number of parts: a map of a few entries.

    Few intervals are copied often, so that what is much longer than the rest, and has all
    points of a key in one block, does not meet them in one task.
    """
    counts = spans.groupBy(_level().alias("level")).agg(F.count("*").alias("n"))
    every = counts.agg(F.collect_list(F.struct("level", "n")).alias("x"), F.sum("n").alias("total"))

    def parts(x: Column) -> Column:
        share = F.floor(F.col("total") / (_COPIES * x["n"]))
        return F.least(F.lit(_PARTS), F.greatest(F.lit(1), share)).cast("int")

    entries = F.transform("x", lambda x: F.struct(x["level"].alias("level"), parts(x).alias("parts")))
    return every.select(F.map_from_entries(entries).alias("levels")).scalar()


def _level() -> Column:
    """The level whose blocks are the least that are not shorter than the interval."""
    bits = F.ceil(F.log2((F.col("__high") - F.col("__low")).cast("double")) / _STEP) * _STEP
    return bits.cast("int")


def _block(value: Column) -> Column:
    return F.call_function("shiftright", value, F.col("__level")).alias("__block")


def _parts(levels: Column) -> Column:
    return F.element_at(levels, F.col("__level"))


def listed_points(points: DataFrame, point: str, levels: Column) -> DataFrame:
    """Each point once for each level in use: in a block of it, and a part."""
    rows = points.withColumn("__level", F.explode(F.map_keys(levels)))
    part = F.pmod(F.xxhash64(point), _parts(levels)).cast("int")
    return rows.withColumn("__block", _block(F.col(point))).withColumn("__part", part)


def listed_intervals(spans: DataFrame, levels: Column) -> DataFrame:
    """Each interval in the one or two blocks of its own level, and all parts."""
    rows = spans.withColumn("__level", _level())
    blocks = F.sequence(_block(F.col("__low")), _block(F.col("__high")))
    rows = rows.withColumn("__block", F.explode(blocks))
    return rows.withColumn("__part", F.explode(F.sequence(F.lit(0), _parts(levels) - 1)))


def join_points_to_intervals(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    point: str,
    low: Column,
    high: Column,
    *,
    measured_on: DataFrame | None = None,
) -> DataFrame:
    """All (point, interval) pairs with equal ``on`` columns and low < point < high.

    ``point`` is a long; ``low`` and ``high`` are long expressions over ``intervals``.
    Time is cut into blocks on levels, each level's a power of two long. An interval is
    listed on the level of its own length, where it touches two blocks at most; a point is
    listed once for each level that some interval uses. So rows meet only where they are
    close by the measure of the interval itself, and one long interval among many short ones
    makes none of them meet more. Rare levels are dealt into parts (``_levels``).

    The levels are one scalar subquery, over ``measured_on`` if that is a cheaper table with
    the same columns and all of the intervals.
    """

    def with_ends(table: DataFrame) -> DataFrame:
        ends = table.withColumns({"__low": low, "__high": high})
        return ends.where(F.col("__high") - F.col("__low") > 1)

    spans = with_ends(intervals)
    levels = _levels(spans if measured_on is None else with_ends(measured_on))
    joined = listed_points(points, point, levels).join(
        listed_intervals(spans, levels), [*on, "__level", "__block", "__part"], "inner"
    )
    within = (F.col("__low") < F.col(point)) & (F.col(point) < F.col("__high"))
    return joined.where(within).drop("__level", "__block", "__part", "__low", "__high")
