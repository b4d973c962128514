"""Runs without pairs, and joins on few hot keys."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import features, procs
from tracelake.plans.spread import spread_join


@pytest.mark.parametrize("name", ["x", ""])
def test_nth_run_is_the_nth_pair(spark, name):
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        pid = rng.randrange(12)
        kind = rng.choice(["start", "end", "exec"])
        rows.append(("c", pid, pid, rng.randrange(40), "x" if pid % 3 else "", kind))
    trace = spark.createDataFrame(
        rows, "collection_id string, pid long, tgid long, ts_ns long, name string, cap_type string"
    )
    lifetimes = procs.process_lifetimes(trace)
    for index in (0, 1, 7, 60, 10_000):
        want = procs.nth_process_run(lifetimes, name, index).collect()
        assert procs.nth_run(trace, name, index).collect() == want


def test_spread_join_and_lookup_status(spark):
    big = spark.range(1000).select(F.lit("hot").alias("m"), F.col("id").alias("key"))
    small = spark.createDataFrame([("hot", 1), ("cold", 2)], "m string, v int")
    got = spread_join(big, small, ["m"], F.col("key"))
    assert got.count() == 1000 and got.agg(F.sum("v")).first()[0] == 1000
    probes = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "map_name string, key long")
    values = spark.createDataFrame([("a", 1, 5)], "map_name string, key long, value long")
    found = {(r.map_name, r.key): (r.value, r.status) for r in features.feature_lookup(probes, values).collect()}
    assert found == {("a", 1): (5, "ok"), ("a", 2): (None, "no_key"), ("b", 1): (None, "no_map")}
