"""File layouts, log text and streams."""

import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelake import table_names
from tracelake.operators import blockio, experiments, sched, spans
from tracelake.sources import layout
from tracelake.sources.files import read_widened
from tracelake.sources.scratch import scratch_dir
from tracelake.sources.text import read_log_lines
from tracelake.specs import spec
from tracelake.streaming import ingest, stateful
from tracelake.streaming.block_io import stream_block_io_pairs


def put(path: Path, **columns) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    pd.DataFrame(columns).to_parquet(path)


def test_scratch_uses_the_shared_folder(spark):
    assert scratch_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_widening_over_files(spark, tmp_path):
    put(tmp_path / "t/a.redis.parquet", x=pd.array([1], "int32"), y=["p"])
    put(tmp_path / "t/b.redis.parquet", x=pd.array([2**40], "int64"))
    put(tmp_path / "t/c.other.parquet", x=[1.5], y=pd.array([7], "int64"))
    df = read_widened(spark, str(tmp_path / "t"))
    assert dict(df.dtypes) == {"x": "double", "y": "string"}
    assert sorted(map(tuple, df.select("x", "y").collect()), key=repr) == [(1.0, "p"), (1.5, "7"), (float(2**40), None)]
    one = layout.read_parquet_dir(spark, str(tmp_path), benchmark_name="redis")
    assert list(one) == ["t"] and one["t"].count() == 2


@pytest.mark.parametrize("vectorized", ["true", "false"])
def test_numbers_widen_in_one_scan(spark, tmp_path, vectorized):
    put(tmp_path / "t/a b%20.parquet", x=pd.array([1], "int32"), z=pd.array([0.5], "float32"))
    put(tmp_path / "t/b.parquet", x=pd.array([2**40], "int64"), z=[0.1], w=pd.array([3], "int16"))
    put(tmp_path / "t/c.parquet", w=pd.array([70_000], "int32"), only=["c"])
    spark.conf.set("spark.sql.parquet.enableVectorizedReader", vectorized)
    try:
        df = read_widened(spark, str(tmp_path / "t"))
        assert dict(df.dtypes) == {"x": "bigint", "z": "double", "w": "int", "only": "string"}
        got = {tuple(r) for r in df.select("x", "z", "w", "only").collect()}
    finally:
        spark.conf.unset("spark.sql.parquet.enableVectorizedReader")
    assert got == {(1, 0.5, None, None), (2**40, 0.1, 3, None), (None, None, 70_000, "c")}
    assert "Union" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_forms_are_fewer_than_schemas(spark, tmp_path):
    for i in range(6):
        own = {f"extra{i}": [i]}
        x = [f"t{i}"] if i % 2 else pd.array([i], "int32")
        put(tmp_path / f"t/p=[{i}]/f {i}.parquet", x=x, **own)
    df = read_widened(spark, str(tmp_path / "t"))
    assert {(r.x, r.p) for r in df.collect()} == {(f"t{i}" if i % 2 else str(i), f"[{i}]") for i in range(6)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert {f"extra{i}" for i in range(6)} < set(df.columns)


def test_collection_prefix_on_flat_files(spark, tmp_path):
    for cid in ("run-aa1", "run-ab2"):
        put(tmp_path / f"process_trace/{cid}.redis.parquet", pid=[1], tgid=[1], ts_ns=[1], name=["a"], cap_type=["exec"], collection_id=[cid])
    put(tmp_path / "not_a_table/run-aa1.parquet", pid=[1])
    got = layout.read_collection(spark, str(tmp_path), "run-aa")
    assert list(got) == ["process_trace"]
    assert [r.collection_id for r in got["process_trace"].collect()] == ["run-aa1"]
    assert layout.read_collection(spark, str(tmp_path), "zzz") == {}
    with pytest.raises(ValueError):
        layout.read_collection(spark, str(tmp_path), "run-a")


def test_chunk_layout_and_latest(spark, tmp_path):
    for cid, chunk in (("old", "0"), ("old", "end"), ("new", "0")):
        put(tmp_path / f"curated/redis/{cid}/mm_rss_stat.{chunk}.parquet", count=[len(chunk)])
        put(tmp_path / f"curated/redis/{cid}/other.{chunk}.parquet", z=[1])
        time.sleep(0.05)
    df = layout.read_chunks(spark, str(tmp_path), "mm_rss_stat")
    assert df.count() == 3
    assert {(r.benchmark_name, r.collection_id) for r in df.collect()} == {("redis", "old"), ("redis", "new")}
    assert [r.collection_id for r in layout.latest_collection(df).collect()] == ["new"]


def test_write_prunes_and_counts(spark, tmp_path):
    df = spark.range(100).select(
        F.col("id").alias("pid"), F.lit("b").alias("benchmark_name"),
        F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("collection_id"),
    )
    folder = layout.write_table(df, str(tmp_path), "process_metadata")
    back = spark.read.parquet(folder)
    assert back.where("collection_id = 'c1'").count() == 33
    plan = back.where("collection_id = 'c1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collection_id" in plan
    counts = layout.table_row_counts({"process_metadata": back}, benchmark_name="b")
    assert counts.agg(F.sum("rows")).first()[0] == 100
    layout.register_views({"process_metadata": back})
    assert spark.sql("SELECT count(*) FROM process_metadata").first()[0] == 100
    with pytest.raises(KeyError):
        layout.register_views({"nothing_known": back})
    assert "mm_rss_stat" in table_names()


def test_log_lines_from_files(spark, tmp_path):
    for name, body in (("a", "===== SIZE 1 =====\n1\n2\n"), ("b", "===== SIZE 1 =====\n6\n")):
        (tmp_path / f"{name}.txt").write_text(body)
    lines = read_log_lines(spark, str(tmp_path), glob="*.txt")
    got = experiments.inference_latency_by_size(lines).first()
    assert (got.n, got["mean"], got["max"]) == (3, 3.0, 6.0)


def drain(spark, tmp_path, chunks, schema, job):
    """Run a streaming job after each chunk, from the same checkpoint."""
    for i, part in enumerate(chunks):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        out = job(ingest.stream_chunks(spark, f"{tmp_path}/in", schema))
        ingest.start_table_sink(out, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out")


def bag(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


SPAN = "tid long, ts_ns long, kind string, name string, ret long, address long, length long, advice long, collection_id string"


def span_rows():
    import random

    rnd = random.Random(11)
    return [
        (rnd.randrange(3), t * 1000, rnd.choice(["entry", "return"]), "m", rnd.choice([0, 0, -1]), t, 1, 4, "c")
        for t in range(60)
    ]


@pytest.mark.parametrize("cuts", [[30], [7, 41]])
def test_span_streams_equal_batch(spark, tmp_path, cuts):
    data = span_rows()
    edges = [0, *cuts, len(data)]
    chunks = [data[a:b] for a, b in zip(edges, edges[1:])]
    batch = spark.createDataFrame(data, SPAN)
    over = drain(spark, tmp_path / "o", chunks, SPAN, stateful.stream_spans_overwrite)
    assert bag(over) == bag(spans.span_pairs_overwrite(batch))
    keep = drain(
        spark, tmp_path / "k", chunks, SPAN,
        lambda s: stateful.stream_spans_keep_first(s, expire_after="1 hour"),
    )
    assert bag(keep) == bag(spans.span_pairs_keep_first(batch))


def test_sched_and_depth_streams_equal_batch(spark, tmp_path):
    import random

    rnd = random.Random(13)
    raw = [
        (t, rnd.choice(["switch", "switch", "wakeup", "wakeup_new"]), p := rnd.randrange(4), (p + 1 + rnd.randrange(3)) % 4, "c")
        for t in range(80)
    ]
    schema = "ts_us long, kind string, prev_pid long, next_pid long, collection_id string"
    both = drain(spark, tmp_path / "s", [raw[:33], raw[33:]], schema, stateful.stream_sched)
    batch = spark.createDataFrame(raw, schema)
    for what, fn in (("run", sched.sched_run_time), ("queue", sched.sched_queue_time)):
        part = both.where(F.col("what") == what).select("collection_id", "pid", "ts_uptime_us", "length_us")
        want = fn(batch).toDF("collection_id", "pid", "ts_uptime_us", "length_us")
        assert bag(part) == bag(want)

    raw = [(t, rnd.choice(["issue", "complete"]), 8, rnd.randrange(4), 1 + t % 3, 4096, "c") for t in range(60)]
    schema = "ts_us long, kind string, device long, sector long, segments long, bytes long, collection_id string"
    depth = drain(spark, tmp_path / "d", [raw[:20], raw[20:]], schema, stateful.stream_queue_depth)
    assert bag(depth) == bag(blockio.queue_depth(spark.createDataFrame(raw, schema)))


def test_io_across_chunks(spark, tmp_path):
    queue, latency = spec("block_io_queue_length").schema, spec("block_io_latency").schema
    starts = [(0, 8, 1, 1, 4096, 100, 1, 1, 1, "c"), (0, 8, 2, 1, 4096, 900, 1, 1, 1, "c")]
    ends = [(0, 8, 1, 1, 4096, 1100, 2000, 5, 1, "c"), (0, 8, 2, 1, 4096, 950, 60, 5, 1, "c")]
    # The first IO completes a chunk later than it was issued.
    for s, e in ((starts[:1], []), (starts[1:], ends)):
        spark.createDataFrame(s, queue).write.mode("append").parquet(f"{tmp_path}/q")
        spark.createDataFrame(e, latency).write.mode("append").parquet(f"{tmp_path}/l")
        pairs = stream_block_io_pairs(
            ingest.stream_chunks(spark, f"{tmp_path}/q", queue), ingest.stream_chunks(spark, f"{tmp_path}/l", latency)
        )
        ingest.start_table_sink(pairs, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = blockio.dedup_pairs(spark.read.schema(pairs.schema).parquet(f"{tmp_path}/out"))
    batch = blockio.block_io_join(spark.createDataFrame(starts, queue), spark.createDataFrame(ends, latency))
    assert bag(got) == bag(batch)
    assert got.count() == 2


def test_io_across_chunks_keeps_only_what_can_still_meet(spark, tmp_path):
    from tracelake.streaming import block_io

    queue, latency = spec("block_io_queue_length").schema, spec("block_io_latency").schema
    second = 1_000_000

    def issue(sector, at):
        return (0, 8, sector, 1, 4096, at, 1, 1, 1, "c")

    def end(sector, at, lasted):
        return (0, 8, sector, 1, 4096, at, lasted, 5, 1, "c")

    far = 100 * second
    chunks = [
        # Sector 1 is paired here, 2 in the next chunk, 3 is completed before its issue comes.
        ([issue(1, 10), *(issue(100 + i, i) for i in range(50)), issue(2, far), (None,) * 10],
         [end(1, 20, 60), end(3, far + 30, 60), (None,) * 10]),
        ([issue(3, far + 1), issue(2, far), issue(4, 3 * far)], [end(2, far + 400, 500), end(4, 3 * far, 900)]),
        # Equal to a pair of before; too late for what is kept; an issue kept twice meets again.
        ([issue(4, 3 * far - 5)], [end(1, 20, 60), end(4, 3 * far + 7, 900)]),
    ]
    for number, (starts, ends) in enumerate(chunks):
        spark.createDataFrame(starts, queue).write.mode("append").parquet(f"{tmp_path}/q")
        spark.createDataFrame(ends, latency).write.mode("append").parquet(f"{tmp_path}/l")
        streams = (ingest.stream_chunks(spark, f"{tmp_path}/{x}", s) for x, s in (("q", queue), ("l", latency)))
        block_io.start_block_io_sink(
            *streams, f"{tmp_path}/t", f"{tmp_path}/state", max_latency="1 second", delay="1 second"
        ).awaitTermination()
        if number == 0:
            kept = block_io._open(spark, f"{tmp_path}/t", block_io.OPEN_ISSUES, 1, queue)
            assert [r.sector for r in kept.collect()] == [2]
            kept = block_io._open(spark, f"{tmp_path}/t", block_io.OPEN_ENDS, 1, latency)
            assert [r.sector for r in kept.collect()] == [3]
    pairs = block_io.read_block_io_pairs(spark, f"{tmp_path}/t")
    got = sorted((r.sector, r.ts_uptime_us, r.finish_ts_uptime_us) for r in pairs.collect())
    assert got == sorted(
        [(1, 10, 20), (2, far, far + 400), (2, far, far + 400), (3, far + 1, far + 30)]
        + [(4, 3 * far, 3 * far + 7), (4, 3 * far - 5, 3 * far), (4, 3 * far - 5, 3 * far + 7)]
    )
    assert not list((tmp_path / "state").glob("state"))  # rows of a micro-batch are no state


def test_slow_completions_are_not_lost(spark):
    from tracelake.streaming.block_io import slow_completions

    rows = spark.createDataFrame([(1, 500), (2, 1_000_000), (3, 1_000_001)], "i long, block_latency_us long")
    assert [r.i for r in slow_completions(rows, "1 second").collect()] == [3]


def test_folder_ids_of_chunks(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tracelake.streaming.ingest import start_table_sink, stream_chunks

    folder = tmp_path / "in/b1/c1"
    folder.mkdir(parents=True)
    pq.write_table(pa.table({"v": pa.array([1, 2], pa.int64())}), folder / "t.1.parquet")
    chunks = stream_chunks(spark, f"{tmp_path}/in", "v long", glob="t.*.parquet", folder_ids=True)
    start_table_sink(chunks, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.benchmark_name, r.collection_id, r.v) for r in got} == {("b1", "c1", 1), ("b1", "c1", 2)}


def test_what_expires_is_a_row_without_an_end(spark, tmp_path):
    hour = 3600 * 10**9
    chunks = [
        [("c", 1, hour, "entry", "f", 0), ("c", 2, hour, "entry", "f", 0), ("c", 2, hour + 9, "return", "f", 0)],
        [("c", 3, 4 * hour, "entry", "f", 0)],
        [("c", 3, 4 * hour + 7, "return", "f", 0)],
    ]
    schema = "collection_id string, tid long, ts_ns long, kind string, name string, ret long"
    got = drain(
        spark, tmp_path / "x", chunks, schema,
        lambda s: stateful.stream_spans_overwrite(s, expire_after="1 hour"),
    )
    assert {(r.pid, r.start_ts, r.end_ts) for r in got.collect()} == {
        (1, hour, None), (2, hour, hour + 9), (3, 4 * hour, 4 * hour + 7),
    }
