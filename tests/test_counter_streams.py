"""Counter samples in shuffled chunks against the batch operators over all of them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import perf
from tracelake.streaming import counters, ingest

SCHEMA = (
    "collection_id string, cpu long, pid long, tgid long, ts_uptime_us long, cumulative_llc_misses long,"
    " pmu_enabled_time_us long, pmu_running_time_us long"
)
SECOND = 1_000_000


def drained(spark, folder, chunks, job):
    for part in chunks:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = job(ingest.stream_chunks(spark, f"{folder}/in", SCHEMA))
        ingest.start_table_sink(
            out, f"{folder}/out", f"{folder}/state", partitions=(), release_held=True
        ).awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def bag(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("scaling", ["as_sampled", "extrapolate"])
def test_shuffled_chunks_equal_the_batch(spark, tmp_path, scaling):
    rng = random.Random(7)
    rows, close = [], ("closing", 0, 0, 0, 900 * SECOND, 0, 0, 0)
    for i in range(240):
        t = rng.randrange(1, 60) * SECOND // 2  # many samples share a time
        count = None if i % 50 == 0 else rng.randrange(1000)
        rows.append((rng.choice("ab"), i % 2, i % 5, i % 5, t, count, 4 * t, (1 + i % 3) * t))
    rows.append(rows[0])  # a repeated sample
    came = sorted(rows, key=lambda r: r[4] + rng.randrange(10 * SECOND))
    chunks = [came[k : k + 61] for k in range(0, len(came), 61)] + [[close]]
    batch = spark.createDataFrame(rows, SCHEMA)
    options = {"scaling": scaling, "wrap_bits": 32 if scaling == "extrapolate" else None}
    for name in ("perf_pdf", "perf_cdf"):
        stream = getattr(counters, f"stream_{name}")
        got = drained(spark, tmp_path / name, chunks, lambda s: stream(s, "llc_misses", **options))
        want = getattr(perf, name)(batch, "llc_misses", **options)
        places = [F.round("llc_misses", 6).alias("llc_misses")] if name == "perf_cdf" else []
        if places:
            got, want = got.withColumn("llc_misses", *places), want.withColumn("llc_misses", *places)
        assert bag(got) == bag(want)


def test_samples_wait_for_the_watermark(spark, tmp_path):
    def sample(t, count):
        return ("a", 0, 1, 1, t * SECOND, count, t, t)

    chunks = [[sample(20, 50)], [sample(12, 30)], [sample(100, 70)], [sample(5, 1)]]
    got = drained(spark, tmp_path, chunks, lambda s: counters.stream_perf_pdf(s, "llc_misses"))
    # The one at 100 is held, the one at 5 came too late.
    assert [(r.ts_uptime_us, r.llc_misses) for r in got.orderBy("ts_uptime_us").collect()] == [
        (12 * SECOND, 30.0), (20 * SECOND, 20.0),
    ]
    with pytest.raises(ValueError):
        counters.stream_perf_pdf(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "x", scaling="no")


@pytest.mark.parametrize("scaling", ["as_sampled", "extrapolate"])
def test_samples_that_a_table_holds_give_the_rows_of_the_stream(spark, tmp_path, scaling, monkeypatch):
    from tracelake.streaming import block_io

    rng = random.Random(11)
    rows, far, number = [], ("closing", 0, 0, 0, 900 * SECOND, 0, 0, 0), lambda: rng.choice([None, rng.randrange(900)])
    for i in range(200):
        t = rng.randrange(1, 60) * SECOND // 2 + rng.randrange(2) * 700
        who = (rng.choice(["a", "b", None]), rng.choice([0, 0, 0, 1, None]), i % 5, rng.choice([None, 3]))
        rows.append((*who, t, number(), rng.choice([None, 4 * t]), (1 + i % 3) * t))
    rows += [rows[0], (*rows[1][:4], None, 1, 1, 1)]  # a repeated sample, one without a time
    came = sorted(rows, key=lambda r: (r[4] or 0) + rng.randrange(14 * SECOND))  # some come too late
    chunks = [came[k : k + 61] for k in range(0, len(came), 61)] + [[far], [("closing", 0, 0, 0, 5, 1, 1, 1)]]
    options = {"scaling": scaling, "wrap_bits": 32 if scaling == "extrapolate" else None}
    want = drained(spark, tmp_path / "w", chunks, lambda s: counters.stream_perf_pdf(s, "llc_misses", **options))
    scans = []
    scan = counters.perf.perf_pdf
    monkeypatch.setattr(counters.perf, "perf_pdf", lambda t, c, **o: scans.append(t) or scan(t, c, target_rows=8, **o))
    base = f"{tmp_path}/t"
    for part in chunks:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = ingest.stream_chunks(spark, f"{tmp_path}/in", SCHEMA)
        counters.start_pdf_sink(stream, "llc_misses", base, f"{base}/state", **options).awaitTermination()
    got = counters.read_pdf(spark, base)
    assert got.columns == want.columns and bag(got) == bag(want)
    assert 150 < got.count() < len(rows) and len(scans) == len(chunks)
    held = block_io._open(spark, base, counters.HELD, len(chunks), got.schema)
    assert [r.ts_uptime_us for r in held.collect()] == [900 * SECOND]
    assert not list((tmp_path / "t" / "state").glob("state"))  # samples of a chunk are no state
    with pytest.raises(ValueError):
        counters.start_pdf_sink(stream, "llc_misses", base, f"{base}/state", scaling="no")
