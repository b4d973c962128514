"""Exact nearest neighbours by a block matrix join with int8 tiles (operator 9)."""

from __future__ import annotations

import heapq
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a tile that are multiplied together; bounds a task's product matrix.
_AT_ONCE = 128


class _Quantised:
    """Rows as int8 times a scale, with what the bound of a product needs."""

    def __init__(self, rows: np.ndarray) -> None:
        self.scale = np.abs(rows).max(axis=1) / 127
        #: Tiny vectors have no scale; the whole vector is then the error.
        safe = np.where(self.scale > 0, self.scale, 1)
        whole = np.where((self.scale > 0)[:, None], np.rint(rows / safe[:, None]), 0)
        self.ints = whole.astype(np.int8)
        held = self.ints * self.scale[:, None]
        self.held_norm = np.linalg.norm(held, axis=1)
        self.error_norm = np.linalg.norm(rows - held, axis=1)
        self.norm = np.linalg.norm(rows, axis=1)


def _tile(k: int, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """The k nearest rows of the tile for each of its queries, with exact products.

    |q·c - q'·c'| <= |q'| |c - c'| + |q - q'| |c| for the quantised q', c'. A row whose
    upper bound is below the k-th lower bound has k better ones in this very tile.
    """
    q, c = (np.stack(x["embedding"].to_list()).astype(np.float64) for x in (queries, rows))
    q_ids, c_ids = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
    q8, c8 = _Quantised(q), _Quantised(c)
    # Products of int8 are whole numbers; float32 holds them up to 2^24.
    exact = np.float32 if q.shape[1] * 127**2 < 2**24 else np.float64
    c_ints, c_columns = c8.ints.T.astype(exact), np.ascontiguousarray(c.T)
    found: list[tuple[int, int, float]] = []
    for at in range(0, len(q), _AT_ONCE):
        part = slice(at, at + _AT_ONCE)
        near = (q8.ints[part].astype(exact) @ c_ints).astype(np.float64)
        near *= q8.scale[part, None] * c8.scale
        slack = q8.held_norm[part, None] * c8.error_norm + q8.error_norm[part, None] * c8.norm
        slack += 1e-9 * q8.norm[part, None] * c8.norm  # rounding of the bounds themselves
        own = q_ids[part, None] == c_ids
        low = np.where(own, -np.inf, near - slack)
        kth = np.partition(low, -k, axis=1)[:, -k] if len(c) > k else np.full(len(near), -np.inf)
        may = (near + slack >= kth[:, None]) & ~own
        for i in range(len(near)):
            rest = np.flatnonzero(may[i])
            # Added up in the order of the components, so that equal vectors score equally.
            scores = np.cumsum(c_columns[:, rest] * q[at + i][:, None], axis=0)[-1]
            best = heapq.nsmallest(k, zip(-scores, c_ids[rest], strict=True))
            found += ((q_ids[at + i], vec_id, -score) for score, vec_id in best)
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])


def nearest(
    vectors: DataFrame,
    k: int = 20,
    query_every: int = 20,
    tile_rows: int = 8192,
    tile_queries: int = 1024,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query.

    Queries are the vectors whose vec_id is divisible by ``query_every``, candidates all
    others but the query's own id; ties go to the smaller vec_id. Vectors that are null,
    empty or zero or hold null or non-finite components, and rows without a vec_id, take no
    part. Of rows with one vec_id the smallest vector counts, so repeated rows count once.
    Only vectors of equal length are compared. An empty table gives an empty result.

    Both sides are dealt into blocks by a hash of the id and every query block meets every
    row block in a tile of its own, a task of fixed size. A tile hands on k rows for each
    query; a limited rank, for which Spark also keeps k rows before the shuffle, merges them.
    """
    usable = F.expr(
        "vec_id is not null and size(embedding) > 0"
        " and forall(embedding, x -> x is not null and abs(x) < double('Infinity'))"
        " and exists(embedding, x -> x <> 0)"
    )
    usable_vectors = vectors.select("vec_id", "embedding").where(usable)
    one = usable_vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n = usable_vectors.count()
    row_blocks = ceil(n / tile_rows) or 1
    query_blocks = ceil(n / query_every / tile_queries) or 1
    one = one.withColumn("dim", F.size("embedding"))

    def block(blocks: int, seed: int) -> F.Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(blocks))

    def every(blocks: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))

    rows = one.withColumn("rb", block(row_blocks, 1)).withColumn("qb", every(query_blocks))
    queries = one.where(F.col("vec_id") % query_every == 0)
    queries = queries.withColumn("qb", block(query_blocks, 2)).withColumn("rb", every(row_blocks))

    def tile(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _tile(k, queries, rows)

    key = ("dim", "qb", "rb")
    tiles = queries.groupBy(*key).cogroup(rows.groupBy(*key))
    best = tiles.applyInPandas(tile, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


NEAREST_SQL = """
WITH v AS (
    SELECT vec_id, CAST(min(embedding) AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    GROUP BY vec_id
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
    WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM pairs
) WHERE rank <= 20
"""
