"""Segmented scans, interval joins and quantiles against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.plans import intervals
from tracelake.plans.intervals import join_points_to_intervals
from tracelake.plans.ordered import ordered_scan, with_segment
from tracelake.plans.quantiles import exact_quantiles

random.seed(7)
# Key "hot" holds most rows, and a burst of them in a short stretch.
ROWS = [
    ("hot" if random.random() < 0.7 else f"k{random.randrange(5)}",
     random.randrange(10_000) if random.random() < 0.5 else random.randrange(50),
     i,
     random.choice([None, random.randrange(100)]))
    for i in range(600)
]


def brute(rows):
    out, state = set(), {}
    for k, ts, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        s = state.setdefault(k, {"prev": None, "sum": None, "last": None})
        before = s["last"]
        if v is not None:
            s["sum"] = (s["sum"] or 0) + v
            s["last"] = v
        out.add((i, s["prev"], s["sum"], s["last"], before))
        s["prev"] = i
    return out


@pytest.mark.parametrize("target_rows", [None, 1 << 20, 40, 3, 1])
def test_ordered_scan_equals_brute_force(spark, target_rows):
    df = spark.createDataFrame(ROWS, "k string, ts long, i long, v long")
    got = ordered_scan(
        df, ["k"], ["ts", "i"],
        previous={"p": F.col("i")}, running={"s": F.col("v")},
        latest={"l": F.col("v")}, latest_before={"b": F.col("v")},
        first={"f": F.col("v")}, total={"t": F.col("v")},
        target_rows=target_rows,
    ).collect()
    assert len(got) == len(ROWS)
    assert {(r.i, r.p, r.s, r.l, r.b) for r in got} == brute(ROWS)
    for k in {r[0] for r in ROWS}:
        values = [r[3] for r in sorted((r for r in ROWS if r[0] == k), key=lambda r: r[1:3])]
        known = [v for v in values if v is not None]
        mine = {(r.f, r.t) for r in got if r.k == k}
        assert mine == {(known[0] if known else None, sum(known) if known else None)}


def test_hot_key_is_cut(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("ts"))
    sizes = with_segment(df, ["k"], "ts", 500).groupBy("k", "__segment").count()
    row = sizes.agg(F.max("count").alias("m"), F.count("*").alias("n")).first()
    assert row.m <= 520 and row.n >= 38


def _timelines(spark):
    n = 20_000
    hot = spark.range(n).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("ts"))
    year = 3.2e13
    other = hot.select(F.lit("late").alias("k"), (F.col("ts") + year).alias("ts"))
    return {
        "one far row": hot.union(spark.createDataFrame([("far", year)], hot.schema)),
        "far row of the key": hot.union(spark.createDataFrame([("hot", year)], hot.schema)),
        "two hosts a year apart": hot.union(other),
        "one key, two places": hot.union(other.select(F.lit("hot"), "ts")),
        "burst": hot.union(hot.select("k", 7 + F.col("ts") / 1e7)),
        "heavy tail": hot.select("k", F.pow((F.col("ts") + 1) / n, F.lit(-3.0)).alias("ts")),
        "null key": hot.select(F.lit(None).cast("string").alias("k"), "ts"),
    }


@pytest.mark.parametrize(
    "case",
    ["one far row", "far row of the key", "two hosts a year apart", "one key, two places",
     "burst", "heavy tail", "null key"],
)
def test_any_timeline_is_cut(spark, case):
    df = _timelines(spark)[case]
    cut = with_segment(df, ["k"], "ts", 500)
    assert cut.groupBy("k", "__segment").count().agg(F.max("count")).first()[0] <= 1000
    got = ordered_scan(df, ["k"], ["ts"], running={"n": F.lit(1)}, previous={"p": F.col("ts")}, target_rows=500)
    want = ordered_scan(df, ["k"], ["ts"], running={"n": F.lit(1)}, previous={"p": F.col("ts")}, target_rows=None)
    columns = ["k", "ts", "n", "p"]
    assert got.select(columns).exceptAll(want.select(columns)).count() == 0


def test_rows_of_one_position_stay_together(spark):
    df = spark.range(3000).select(F.lit("k").alias("k"), F.lit(5.0).alias("ts"))
    assert with_segment(df, ["k"], "ts", 500).select("__segment").distinct().count() == 1


def test_null_keys_and_positions_are_scanned(spark):
    rows = [(None, 1, 1), (None, 2, 2), ("a", None, 3), ("a", 1, 4), ("a", 2, 5)]
    df = spark.createDataFrame(rows, "k string, ts long, v long")
    for target in (None, 1):
        got = ordered_scan(df, ["k"], ["ts"], running={"s": F.col("v")}, target_rows=target)
        assert {(r.v, r.s) for r in got.collect()} == {(1, 1), (2, 3), (3, 3), (4, 7), (5, 12)}


def test_shared_segment_saves_a_shuffle(spark):
    df = spark.createDataFrame(ROWS, "k string, ts long, i long, v long")
    cut = with_segment(df, ["k"], "ts", 50, "seg")
    once = ordered_scan(cut, ["k"], ["ts", "i"], previous={"p": F.col("v")}, segment="seg")
    twice = ordered_scan(once, ["k"], ["ts", "i"], running={"s": F.col("p")}, segment="seg")
    want = ordered_scan(
        ordered_scan(df, ["k"], ["ts", "i"], previous={"p": F.col("v")}, target_rows=None),
        ["k"], ["ts", "i"], running={"s": F.col("p")}, target_rows=None,
    )
    cols = ["i", "p", "s"]
    assert {tuple(r) for r in twice.select(cols).collect()} == {
        tuple(r) for r in want.select(cols).collect()
    }


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, ts long, v long")
    assert ordered_scan(df, ["k"], ["ts"], running={"s": F.col("v")}).count() == 0


@pytest.mark.parametrize("long_ones", [False, True])
def test_interval_join_equals_brute_force(spark, long_ones):
    rnd = random.Random(3)
    points = [(rnd.choice("aab"), rnd.randrange(200_000), i) for i in range(300)]
    spans = []
    for i in range(300):
        low = rnd.randrange(-100, 200_000)
        length = rnd.choice([0, 1, 2, 5, 30, 90] + ([150_000] * (i % 40 == 0) if long_ones else []))
        spans.append((rnd.choice("aab"), low, low + length, i))
    want = {
        (p, s) for k, t, p in points for j, lo, hi, s in spans if k == j and lo < t < hi
    }
    got = join_points_to_intervals(
        spark.createDataFrame(points, "k string, t long, p long"),
        spark.createDataFrame(spans, "k string, lo long, hi long, s long"),
        ["k"], "t", F.col("lo"), F.col("hi"),
    ).collect()
    assert len(got) == len(want)
    assert {(r.p, r.s) for r in got} == want


def test_interval_join_without_intervals(spark):
    points = spark.createDataFrame([("a", 1)], "k string, t long")
    spans = spark.createDataFrame([("a", 5, 6)], "k string, lo long, hi long")
    assert join_points_to_intervals(points, spans, ["k"], "t", F.col("lo"), F.col("hi")).count() == 0


def test_one_long_interval_and_a_hot_key_are_spread(spark):
    # A request repeated all the time, short intervals, and one that covers all of it.
    points = spark.range(200_000).select(F.lit("hot").alias("k"), (F.col("id") * 50).alias("t"))
    spans = points.select("k", (F.col("t") - 30).alias("lo"), (F.col("t") + 30).alias("hi"))
    long = spark.createDataFrame([("hot", -5, 10_000_001)], "k string, lo long, hi long")
    ends = spans.union(long).withColumns({"__low": F.col("lo"), "__high": F.col("hi")})
    levels = intervals._levels(ends)
    at = ["__level", "__block", "__part"]
    met = intervals.listed_points(points, "t", levels).groupBy("k", *at).count()
    most = met.agg(F.max("count")).first()[0]
    assert most < 200_000 / 32
    assert intervals.listed_intervals(ends, levels).count() < 3 * 200_001
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = join_points_to_intervals(points, spans.union(long), ["k"], "t", F.col("lo"), F.col("hi"))
        assert got.count() == 400_000
        sizes = got.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert sizes.max() <= 2 * sizes.median()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("target_rows", [None, 5])
def test_quantiles_equal_numpy(spark, target_rows):
    rnd = random.Random(5)
    data = [("a", float(rnd.randrange(40))) for _ in range(301)] + [("b", 2.5)]
    got = exact_quantiles(
        spark.createDataFrame(data, "k string, x double"), ["k"], "x",
        {"q1": 0.25, "med": 0.5, "p9": 0.9}, mean="avg", target_rows=target_rows,
    )
    rows = {r.k: r for r in got.collect()}
    a = [x for k, x in data if k == "a"]
    assert rows["a"].n == 301
    assert np.allclose([rows["a"].q1, rows["a"].med, rows["a"].p9], np.quantile(a, [0.25, 0.5, 0.9]))
    assert np.isclose(rows["a"].avg, np.mean(a))
    assert (rows["b"].q1, rows["b"].med, rows["b"].avg) == (2.5, 2.5, 2.5)


def test_mean_of_tiny_and_huge_values(spark):
    data = [("tiny", 4e-7), ("tiny", 2e-7), ("tiny", 1.2e-6), ("huge", 1e25), ("huge", 3e25)]
    df = spark.createDataFrame(data, "k string, x double")
    got = {r.k: r.avg for r in exact_quantiles(df, ["k"], "x", {"m": 0.5}, mean="avg").collect()}
    assert np.isclose(got["tiny"], 6e-7, rtol=1e-12) and np.isclose(got["huge"], 2e25)


def test_variance_of_large_groups(spark):
    from tracelake.functions.columns import variance_of_ints

    df = spark.createDataFrame([("a", 2**62), ("a", 2**62 - 8), ("b", 1), ("b", 4)], "k string, x long")
    got = {r.k: r.v for r in df.groupBy("k").agg(variance_of_ints(F.col("x")).alias("v")).collect()}
    assert got["b"] == 4.5 and got["a"] >= 0
