"""Merged sketches against exact counts and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import sketches


def test_merged_distinct_is_near_the_exact_count(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 4)).alias("g"),
        (F.col("id") % 7).alias("chunk"),
        F.when(F.col("id") % 10 != 0, (F.col("id") * 7919) % 20_011).alias("v"),
    )
    parts = sketches.distinct_sketches(rows, ["g", "chunk"], "v")
    assert parts.count() == rows.select("g", "chunk").distinct().count()
    got = {r.g: r for r in sketches.merged_distinct(parts, ["g"]).collect()}
    want = rows.groupBy("g").agg(F.count("v").alias("n"), F.count_distinct("v").alias("d")).collect()
    assert len(got) == len(want)
    for r in want:
        assert got[r.g].n == r.n
        assert abs(got[r.g].n_distinct - r.d) <= 4 * sketches.distinct_error() * r.d
    over_all = sketches.merged_distinct(parts.withColumn("all", F.lit(1)), ["all"]).first()
    exact = rows.agg(F.count_distinct("v")).first()[0]
    assert abs(over_all.n_distinct - exact) <= 4 * sketches.distinct_error() * exact


def test_merged_quantiles_have_near_ranks(spark):
    rows = spark.range(50_000).select(
        (F.col("id") % 9).alias("chunk"),
        F.when(F.col("id") < 1_000, F.lit(5.0))  # ties
        .when(F.col("id") == 1_000, F.lit(None))
        .when(F.col("id") == 1_001, F.lit(float("nan")))
        .otherwise(F.pow((F.col("id") * 7919) % 50_021, 2))
        .alias("v"),
    )
    parts = sketches.quantile_sketches(rows, ["chunk"], "v").withColumn("all", F.lit(1))
    asked = {"low": 0.01, "mid": 0.5, "high": 0.99}
    got = sketches.merged_quantiles(parts, ["all"], asked).first()
    values = sorted(r.v for r in rows.where("v is not null and not isnan(v)").collect())
    assert (got.n, got.min, got.max) == (len(values), values[0], values[-1])
    off = 3 * sketches.rank_error()
    for name, q in asked.items():
        below = sum(v < got[name] for v in values) / len(values)
        upto = sum(v <= got[name] for v in values) / len(values)
        assert below - off <= q <= upto + off


def test_sketches_of_nothing(spark):
    rows = spark.createDataFrame([("a", 1, None)], "g string, chunk int, v long")
    distinct = sketches.merged_distinct(sketches.distinct_sketches(rows, ["g", "chunk"], "v"), ["g"])
    assert [tuple(r) for r in distinct.collect()] == [("a", 0, 0)]
    none = sketches.quantile_sketches(rows, ["g", "chunk"], "v")
    assert none.count() == 0 and sketches.merged_quantiles(none, ["g"]).count() == 0
