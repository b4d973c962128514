"""Finite-state machines over ordered rows, by composition of transition functions.

What a stretch of rows does to a machine is a small map, the state after it for each state
before it. Maps of neighbouring stretches compose, and composing is associative, so rows need
not be walked: a stretch is scanned in a logarithmic number of array steps, stretches of a key
are scanned apart and linked by their maps. The same machine serves batches and streams.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.plans.ordered import TARGET_ROWS
from tracelake.sources.scratch import scratch_dir


class Machine:
    """``table[symbol][state]`` is the state after a row with that symbol."""

    def __init__(self, table: Sequence[Sequence[int]]) -> None:
        self.table = np.asarray(table, np.int8)

    def maps(self, symbols: np.ndarray) -> np.ndarray:
        """For each row the state after it, by the state before the first row."""
        maps, step = self.table[symbols], 1
        while step < len(maps):
            # What happened up to ``step`` rows before, then what happened since.
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
            step *= 2
        return maps

    def before(self, symbols: np.ndarray, start: int) -> tuple[np.ndarray, int]:
        """The state before each row, and that after the last."""
        after = self.maps(symbols)[:, start] if len(symbols) else np.empty(0, np.int8)
        states = np.concatenate([[start], after]).astype(np.int8)
        return states[:-1], int(states[-1])


def last_place(mask: np.ndarray) -> np.ndarray:
    """For each row the place of the last row up to it that is in the mask; -1 if none is."""
    return np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1)) if len(mask) else np.empty(0, np.int64)


def place_before(mask: np.ndarray) -> np.ndarray:
    """As ``last_place``, of the rows before each."""
    return np.concatenate([[-1], last_place(mask)])[:-1]


_BLOCK, _SYMBOL, _START, _MAP = "__block", "__symbol", "__start", "__map"


def state_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    symbol: Column,
    machine: Machine,
    *,
    start: int = 0,
    state: str = "state",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """df with the state before each row, of a machine for each key that starts in ``start``.

    ``symbol`` is a row's row in the machine's table. Rows are ordered by ``order``; name all
    columns that tell rows apart, as it is by these that a key's rows are cut into blocks of
    some ``target_rows``: so a hot key is split even where its rows share one time. A block is
    one map of each key in it, a window over these maps (as many as a key has blocks) gives
    the state at the start of each block, and blocks are then scanned apart.
    """
    rows = df.withColumn(_SYMBOL, symbol.cast("int"))
    blocks = max(1, -(-df.count() // target_rows))
    cut = rows.repartitionByRange(blocks, *keys, *order).withColumn(_BLOCK, F.spark_partition_id())
    path = scratch_dir(df.sparkSession, "state-blocks")
    cut.write.parquet(path)
    cut = df.sparkSession.read.schema(cut.schema).parquet(path)
    by, names = [*keys, _BLOCK], df.columns

    def in_order(batch: pa.Table) -> pa.Table:
        return batch.sort_by([(c, "ascending") for c in order])

    def mapped(batch: pa.Table) -> pa.Table:
        ordered = in_order(batch)
        last = machine.maps(ordered[_SYMBOL].to_numpy())[-1].tolist()
        head = ordered.slice(0, 1).select(by)
        return head.append_column(_MAP, pa.array([last], pa.list_(pa.int32())))

    def scanned(batch: pa.Table) -> pa.Table:
        ordered = in_order(batch)
        found, _ = machine.before(ordered[_SYMBOL].to_numpy(), ordered[_START][0].as_py())
        out = ordered.select(names)
        return out.append_column(state, pa.array(found.astype(np.int32), pa.int32()))

    at_ends = T.StructType(
        [*(cut.schema[c] for c in by), T.StructField(_MAP, T.ArrayType(T.IntegerType()))]
    )
    small = cut.select(*keys, *[c for c in order if c not in keys], _SYMBOL, _BLOCK)
    maps = small.groupBy(*by).applyInArrow(mapped, at_ends)
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    started = F.aggregate(
        F.collect_list(_MAP).over(earlier), F.lit(start), lambda s, m: F.get(m, s)
    )
    starts = maps.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(by)], started.alias(_START))
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(by)]
    joined = cut.join(starts, same).drop(*[f"__{i}" for i in range(len(by))])
    full = T.StructType([*df.schema.fields, T.StructField(state, T.IntegerType())])
    return joined.groupBy(*by).applyInArrow(scanned, full)

