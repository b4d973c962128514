"""Ordered scans (previous row, running sum, last known value) that survive hot keys.

A plain window puts every row of a key in one task. Keys with few rows are left to it. A
key with more is cut into segments of its own timeline, every segment is scanned on its
own, and what one segment hands to the next (last row, sum, last known value) is worked
out on one small row per segment.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.sources.scratch import shared_checkpoint

SEGMENT = "__segment"
TARGET_ROWS = 1 << 20
#: Parts of a group's range in one refinement, and refinements at most: the parts of all
#: refinements make a number of 60 bits.
_BINS = 1024
_LEVELS = 6
_UNCUT = "uncut"


def _attached(df: DataFrame, small: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """df with the other columns of ``small``, found by null-safe equality."""
    other = small.select(
        *[F.col(c).alias(f"__on_{c}") for c in columns],
        *[c for c in small.columns if c not in columns],
    )
    on = [F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in columns]
    joined = df.join(other, reduce(and_, on, F.lit(True)), how)
    return joined.drop(*[f"__on_{c}" for c in columns])


def _bin(position: Column) -> Column:
    """Part of its group's range (__low, __high) that a position lies in; null is first."""
    share = (position - F.col("__low")) / (F.col("__high") - F.col("__low"))
    place = F.floor(share * _BINS).cast("int")
    return F.coalesce(F.least(F.greatest(place, F.lit(0)), F.lit(_BINS - 1)), F.lit(0))


def _refined(df: DataFrame, position: Column, level: DataFrame, group: Sequence[str]) -> DataFrame:
    """df with __path a level longer; only groups in ``level`` are cut further."""
    found = _attached(df, level, group, "left")
    part = F.when(F.col("__parts").isNull(), 0).otherwise(F.get("__parts", _bin(position)))
    longer = F.col("__path") * _BINS + part.cast("long")
    return found.withColumn("__path", longer).drop("__low", "__high", "__parts")


def _levels(slim: DataFrame, known: Sequence[str], target_rows: int) -> list[DataFrame]:
    """Tables that cut the groups with over ``target_rows`` rows, one for each refinement.

    A group's own range is cut into bins, neighbouring bins are put together up to the
    target, and what is still too large is cut again within its own range. So a far row, a
    burst or hosts with other clocks do not make segments larger; only rows of one position
    stay together. Each table has a row for a group that is cut: at most one for each
    ``target_rows`` rows of the data.
    """
    group = [*known, "__path"]
    rows = slim.withColumn("__path", F.lit(0).cast("long"))
    tables: list[DataFrame] = []
    while len(tables) < _LEVELS:
        sizes = rows.groupBy(*group).agg(
            F.count(F.lit(1)).alias("__n"),
            F.min("__pos").alias("__low"),
            F.max("__pos").alias("__high"),
        )
        most = 2 * target_rows if tables else target_rows
        large = sizes.where((F.col("__n") > most) & (F.col("__high") > F.col("__low")))
        large = shared_checkpoint(large.drop("__n"))
        if large.isEmpty():
            break
        inside = _attached(rows, large, group, "inner")
        bins = inside.groupBy(*group, "__low", "__high", _bin(F.col("__pos")).alias("__bin"))
        counted = bins.agg(F.count(F.lit(1)).alias("__n"))
        steps = Window.partitionBy(*group).orderBy("__bin")
        upto = steps.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        filled = F.floor((F.sum("__n").over(upto) - 1) / target_rows)
        # A bin that is too large itself is a part of its own.
        full = (F.col("__n") > target_rows).cast("int")
        apart = 2 * F.sum(full).over(upto) - full
        parts = counted.withColumn("__filled", F.struct(apart, filled)).withColumn(
            "__part", F.dense_rank().over(Window.partitionBy(*group).orderBy("__filled")) - 1
        )
        ends = F.coalesce(F.lead("__bin").over(steps), F.lit(_BINS))
        parts = parts.withColumn("__end", ends)
        listed = F.array_sort(F.collect_list(F.struct("__bin", "__end", "__part")))
        repeated = F.transform(
            listed, lambda x: F.array_repeat(x["__part"], x["__end"] - x["__bin"])
        )
        level = parts.groupBy(*group, "__low", "__high").agg(F.flatten(repeated).alias("__parts"))
        tables.append(shared_checkpoint(level))
        rows = _refined(rows, F.col("__pos"), tables[-1], group)
    return tables


def with_segment(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    target_rows: int | None = TARGET_ROWS,
    name: str = SEGMENT,
    measured_on: DataFrame | None = None,
) -> DataFrame:
    """Add a segment number that grows with ``position`` (any numeric column) in each key.

    Keys with at most ``target_rows`` rows have one segment. Counting them is a job of its
    own over the key and position columns, run when this is called; if no key has more,
    the column says so and scans are plain windows. ``measured_on`` is a cheaper table to
    measure instead; it needs the position and may lack keys, which only makes segments
    narrower. ``target_rows=None`` turns the cutting off. Null keys are keys, null
    positions stand first.
    """
    uncut = df.withColumn(name, F.lit(0).cast("long").alias(name, metadata={_UNCUT: True}))
    if target_rows is None:
        return uncut
    measured = df if measured_on is None else measured_on
    known = [k for k in keys if k in measured.columns]
    slim = measured.select(*known, F.col(position).cast("double").alias("__pos"))
    tables = _levels(slim, known, target_rows)
    if not tables:
        return uncut
    cut = df.withColumn("__path", F.lit(0).cast("long"))
    for level in tables:
        cut = _refined(cut, F.col(position).cast("double"), level, [*known, "__path"])
    return cut.withColumn(name, F.col("__path")).drop("__path")


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    previous: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
    latest: Mapping[str, Column] | None = None,
    latest_before: Mapping[str, Column] | None = None,
    first: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    target_rows: int | None = TARGET_ROWS,
    segment: str | None = None,
) -> DataFrame:
    """Scan every key's rows in ``order`` and add columns.

    * ``previous``: value of the expression on the row before, null on a key's first row
    * ``running``: sum of the expression up to and including this row (nulls add nothing)
    * ``latest``: last non-null value up to and including this row
    * ``latest_before``: last non-null value strictly before this row
    * ``first``: first non-null value of the whole key, on every row
    * ``total``: sum over the whole key, on every row

    ``order[0]`` must be numeric; the others break ties. Pass ``segment`` (from
    :func:`with_segment` with the same keys) to share one shuffle between several scans;
    the column is then kept.
    """
    previous, running = dict(previous or {}), dict(running or {})
    latest, latest_before = dict(latest or {}), dict(latest_before or {})
    first, total = dict(first or {}), dict(total or {})
    seg = segment or SEGMENT
    if segment is None:
        df = with_segment(df, keys, order[0], target_rows, seg)

    if df.schema[seg].metadata.get(_UNCUT):
        kept = [c for c in df.columns if segment is not None or c != seg]
        return _plain_scan(
            df, kept, keys, order, previous, running, latest, latest_before, first, total
        )
    group = [*keys, seg]
    rows = Window.partitionBy(*group).orderBy(*order)
    upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)

    local: dict[str, Column] = {}
    totals: list[Column] = []
    if previous:
        packed = F.struct(*[e.alias(n) for n, e in previous.items()])
        local["__prev"] = F.lag(packed).over(rows)
        totals.append(F.max_by(packed, at).alias("__prev_out"))
    for name, expr in running.items():
        local[f"__run_{name}"] = F.sum(expr).over(upto)
        totals.append(F.sum(expr).alias(f"__run_out_{name}"))
    for name, expr in {**latest, **latest_before}.items():
        frame = upto if name in latest else before
        local[f"__last_{name}"] = F.last(expr, ignorenulls=True).over(frame)
        totals.append(F.max_by(expr, F.when(expr.isNotNull(), at)).alias(f"__last_out_{name}"))

    for name, expr in first.items():
        totals.append(F.min_by(expr, F.when(expr.isNotNull(), at)).alias(f"__first_out_{name}"))
    for name, expr in total.items():
        totals.append(F.sum(expr).alias(f"__total_out_{name}"))

    scanned = df.withColumns(local) if local else df
    steps = Window.partitionBy(*keys).orderBy(seg)
    earlier = steps.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = steps.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried: list[Column] = []
    if previous:
        carried.append(F.lag("__prev_out").over(steps).alias("__prev_in"))
    for name in running:
        carried.append(F.sum(f"__run_out_{name}").over(earlier).alias(f"__run_in_{name}"))
    for name in [*latest, *latest_before]:
        carried.append(
            F.last(f"__last_out_{name}", ignorenulls=True).over(earlier).alias(f"__last_in_{name}")
        )
    for name in first:
        carried.append(
            F.first(f"__first_out_{name}", ignorenulls=True).over(everywhere).alias(f"__first_{name}")
        )
    for name in total:
        carried.append(F.sum(f"__total_out_{name}").over(everywhere).alias(f"__total_{name}"))
    carry = df.groupBy(*group).agg(*totals).select(*group, *carried)

    joined = _attached(scanned, carry, group, "left")
    out: dict[str, Column] = {}
    for name in previous:
        out[name] = F.coalesce(F.col("__prev"), F.col("__prev_in"))[name]
    for name in running:
        here, then = F.col(f"__run_{name}"), F.col(f"__run_in_{name}")
        out[name] = F.when(here.isNull(), then).when(then.isNull(), here).otherwise(here + then)
    for name in [*latest, *latest_before]:
        out[name] = F.coalesce(F.col(f"__last_{name}"), F.col(f"__last_in_{name}"))
    for name in first:
        out[name] = F.col(f"__first_{name}")
    for name in total:
        out[name] = F.col(f"__total_{name}")
    kept = [c for c in df.columns if segment is not None or c != seg]
    return joined.select(*[c for c in kept if c not in out], *[c.alias(n) for n, c in out.items()])


def _plain_scan(
    df: DataFrame,
    kept: Sequence[str],
    keys: Sequence[str],
    order: Sequence[str],
    previous: Mapping[str, Column],
    running: Mapping[str, Column],
    latest: Mapping[str, Column],
    latest_before: Mapping[str, Column],
    first: Mapping[str, Column],
    total: Mapping[str, Column],
) -> DataFrame:
    """ordered_scan() of keys that each fit a task: window functions in one shuffle."""
    rows = Window.partitionBy(*keys).orderBy(*order)
    upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out: dict[str, Column] = {}
    if previous:
        packed = F.lag(F.struct(*[e.alias(n) for n, e in previous.items()])).over(rows)
        out |= {n: packed[n] for n in previous}
    out |= {n: F.sum(e).over(upto) for n, e in running.items()}
    out |= {n: F.last(e, ignorenulls=True).over(upto) for n, e in latest.items()}
    out |= {n: F.last(e, ignorenulls=True).over(before) for n, e in latest_before.items()}
    out |= {n: F.first(e, ignorenulls=True).over(whole) for n, e in first.items()}
    out |= {n: F.sum(e).over(whole) for n, e in total.items()}
    return df.select(*[c for c in kept if c not in out], *[c.alias(n) for n, c in out.items()])
