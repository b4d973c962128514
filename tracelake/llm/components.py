"""Connected components over a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import cut, let_go

#: So many edges or fewer are one partition and settled by one task. Rounds of queries would cost
#: the driver plans, threads and memory for a few rows.
PART = 100_000


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, itself included.

    ``links`` has columns a and b of one sortable type; order, repeats and self links do
    not matter, nodes without a link are not in the result. Every round hangs each node's
    larger neighbours, then each node itself, on the smallest node around (large star, small
    star), so the rounds grow with the logarithm of the longest path. The smallest
    neighbour is an aggregate that combines before the shuffle, and no neighbours are
    gathered, so a node with any number of links is no hot group. Up to PART edges are one
    partition, which needs no rounds.
    """
    edges = cut(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    before = _print(edges)
    for _ in range(rounds):
        if before[0] <= PART:
            kind = edges.schema["hi"].dataType.simpleString()
            return edges.coalesce(1).mapInArrow(_least_reached, f"node {kind}, root {kind}")
        both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("at")).agg(F.min("lo").alias("m"))
        least = least.select("at", F.least("at", "m").alias("m"))
        # Large star: what is larger than a node goes to the least around it; the node stays.
        large = edges.join(least, edges.lo == least.at).select("hi", F.col("m").alias("lo"))
        large = large.union(least.where("m < at").select(F.col("at").alias("hi"), F.col("m")))
        large = large.distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        low = large.groupBy(F.col("hi").alias("at")).agg(F.min("lo").alias("m"))
        small = large.join(low, large.hi == low.at).where("lo <> m")
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = small.union(low.select(F.col("at").alias("hi"), F.col("m")))
        new = cut(new.distinct())
        now = _print(new)
        if now == before:
            return new.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        edges, before = new, now
    raise RuntimeError(f"links did not settle in {rounds} rounds")


def _least_reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the few edges (hi, lo) of a partition; roots have no row, as after the rounds."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    ends = pa.chunked_array([b[side] for side in ("hi", "lo") for b in held])
    names = pc.unique(ends)
    names = names.take(pc.sort_indices(names))
    hi, lo = np.split(pc.index_in(ends, value_set=names).to_numpy(), 2)
    root = np.arange(len(names))
    while not np.array_equal(root[hi], root[lo]):
        # Roots that an edge joins hang on the lesser, then all names on their new roots.
        a, b = root[hi], root[lo]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root[root], root):
            root = root[root]
    others = pa.array(np.flatnonzero(root != np.arange(len(names))))
    yield pa.RecordBatch.from_arrays([names.take(others), names.take(pa.array(root)).take(others)], ["node", "root"])
    let_go()


def _print(edges: DataFrame) -> tuple:
    """Count and an order-free digest, which tell whether two edge tables are the same."""
    digest = F.expr("sum(cast(xxhash64(hi, lo) as decimal(38, 0)))")
    return tuple(edges.agg(F.count("*"), digest).first())
