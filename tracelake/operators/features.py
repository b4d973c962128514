"""Feature lookup by (map, key) and batch scoring of feature vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.plans.spread import spread_join


def feature_lookup(probes: DataFrame, features: DataFrame) -> DataFrame:
    """Value of every probe's key in its map, with ``status`` ``ok``, ``no_key`` or ``no_map``.

    ``features`` has at most one row per (map_name, key). Whether a map exists is looked up
    with the probes of each map dealt into parts, as maps are few and may be hot.
    """
    maps = features.select("map_name").distinct().withColumn("__map", F.lit(True))
    values = features.select("map_name", "key", F.col("value").alias("value"), F.lit(True).alias("__hit"))
    found = probes.join(values, ["map_name", "key"], "left")
    found = spread_join(found, maps, ["map_name"], F.col("key"))
    status = (
        F.when(F.col("__hit"), F.lit("ok"))
        .when(F.col("__map"), F.lit("no_key"))
        .otherwise(F.lit("no_map"))
    )
    return found.select(*probes.columns, "value", status.alias("status"))


def feature_map_stats(features: DataFrame, size: str = "value_size") -> DataFrame:
    """Number of keys and largest value size per map. Without a ``size`` column the size
    is that of a long."""
    width = F.col(size) if size in features.columns else F.lit(8).cast("long")
    return features.groupBy("map_name").agg(
        F.count(F.lit(1)).alias("num_keys"), F.max(width).cast("long").alias("value_size")
    )


def score_mlp(
    df: DataFrame,
    layers: Sequence[tuple[np.ndarray, np.ndarray]],
    *,
    id_column: str,
    vector_column: str,
    activation: str = "relu",
) -> DataFrame:
    """Outputs of a small multilayer network for every vector.

    ``layers`` holds (weights [out, in], bias [out]); ``activation`` (``relu`` or
    ``sigmoid``) follows every layer but the last. The weights travel with the task, the
    vectors go through in Arrow batches. Columns: id, scores.
    """
    if activation not in ("relu", "sigmoid"):
        raise ValueError(f"unknown activation {activation!r}")
    weights = [(np.asarray(w, dtype="float64"), np.asarray(b, dtype="float64")) for w, b in layers]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch[vector_column].to_numpy()).astype("float64")
            for i, (w, b) in enumerate(weights):
                x = x @ w.T + b
                if i + 1 < len(weights):
                    x = np.maximum(x, 0.0) if activation == "relu" else 1.0 / (1.0 + np.exp(-x))
            yield pd.DataFrame({id_column: batch[id_column], "scores": list(x)})

    id_type = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, vector_column).mapInPandas(
        run, f"{id_column} {id_type}, scores array<double>"
    )
