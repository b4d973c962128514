"""Finite-state scans against walking the rows, in batch and in streams."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources_streams import bag, drain
from tracelake.operators import blockio, sched, spans
from tracelake.plans.states import Machine, last_place, place_before, state_scan
from tracelake.specs import spec
from tracelake.streaming import stateful

# Three states; symbol 2 goes round, 1 goes back, 0 stays.
TABLE = [[0, 1, 2], [0, 0, 1], [1, 2, 0]]


def walked(symbols, start=0):
    state, out = start, []
    for x in symbols:
        out.append(state)
        state = TABLE[x][state]
    return out, state


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_composed_maps_are_walks(n):
    rng = np.random.default_rng(n)
    symbols = rng.integers(0, 3, n)
    for start in range(3):
        got, last = Machine(TABLE).before(symbols, start)
        assert (got.tolist(), last) == walked(symbols, start)
    mask = symbols == 1
    want = [max([j for j in range(i + 1) if mask[j]], default=-1) for i in range(n)]
    assert last_place(mask).tolist() == want
    assert place_before(mask).tolist() == [-1, *want][:n]


@pytest.mark.parametrize("target_rows", [10**6, 40])
def test_hot_key_is_cut_within_one_time(spark, target_rows):
    rng = random.Random(7)
    # Most rows have one key and one time.
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), 5 if i % 4 else i, i, rng.randrange(3)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t long, i long, x int")
    got = state_scan(df, ["k"], ["t", "i"], F.col("x"), Machine(TABLE), state="s", target_rows=target_rows)
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])
        want |= {r[2]: s for r, s in zip(own, walked([r[3] for r in own])[0])}
    assert {r.i: r.s for r in got.collect()} == want
    assert got.columns == ["k", "t", "i", "x", "s"]
    assert state_scan(df.limit(0), ["k"], ["t"], F.col("x"), Machine(TABLE)).count() == 0


def test_streams_carry_the_declared_columns(spark, tmp_path):
    rng = random.Random(17)
    raw = [
        (t, rng.choice(["switch", "switch", "wakeup"]), p := rng.randrange(4), (p + 1 + rng.randrange(3)) % 4, "c", rng.randrange(3), 10 + p, 20 + p)
        for t in range(120)
    ]
    schema = "ts_us long, kind string, prev_pid long, next_pid long, collection_id string, cpu long, prev_tgid long, next_tgid long"
    both = drain(spark, tmp_path / "s", [raw[:33], raw[33:34], raw[34:]], schema, stateful.stream_sched)
    batch = spark.createDataFrame(raw, schema)
    for what, name, fn in (("run", "quanta_runtime", sched.sched_run_time), ("queue", "quanta_queued_time", sched.sched_queue_time)):
        want = fn(batch)
        length = next(c for c in want.columns if c not in both.columns)
        part = both.where(F.col("what") == what).drop("what").withColumnRenamed("length_us", length)
        assert bag(part) == bag(want) and want.count() > 20
        spec(name).conform(part).collect()

    raw = [(t, rng.choice(["issue", "complete"]), 8 + t % 2, rng.randrange(4), 1 + t % 3, 4096, "c", t % 5, t % 7) for t in range(90)]
    schema = "ts_us long, kind string, device long, sector long, segments long, bytes long, collection_id string, cpu long, block_io_flags long"
    depth = drain(spark, tmp_path / "d", [raw[:20], raw[20:25], raw[25:]], schema, stateful.stream_queue_depth)
    assert bag(depth) == bag(blockio.queue_depth(spark.createDataFrame(raw, schema)))
    spec("block_io_queue_length").conform(depth).collect()

    raw = [(t % 3, t * 1000, rng.choice(["entry", "return"]), "m", 0, 7 + t % 3, "c") for t in range(60)]
    schema = "tid long, ts_ns long, kind string, name string, ret long, tgid long, collection_id string"
    calls = drain(spark, tmp_path / "o", [raw[:31], raw[31:]], schema, stateful.stream_spans_overwrite)
    assert bag(calls) == bag(spans.span_pairs_overwrite(spark.createDataFrame(raw, schema)))
    spec("zswap_runtime").conform(calls).collect()


def test_what_expires_is_reported(spark, tmp_path):
    hour = 3600 * 10**9
    chunks = [
        [("c", 1, hour, "entry", "f", 0, 5, 6, 4), ("c", 2, hour, "entry", "f", 0, 5, 6, 4), ("c", 2, hour + 9, "return", "f", 0, 5, 6, 4)],
        [("c", 3, 4 * hour, "entry", "f", 0, 5, 6, 4)],
        [("c", 3, 4 * hour + 7, "return", "f", 0, 5, 6, 4)],
    ]
    schema = "collection_id string, tid long, ts_ns long, kind string, name string, ret long, address long, length long, advice long"
    got = drain(
        spark, tmp_path / "x", chunks, schema,
        lambda s: stateful.stream_spans_keep_first(s, expire_after="1 hour", report_unfinished=True),
    )
    assert {(r.tgid, r.ts_ns, r.finished) for r in got.collect()} == {
        (1, hour, False), (2, hour, True), (3, 4 * hour, True),
    }
    hour //= 1000
    chunks = [
        [("c", hour, "issue", 8, 1, 2, 8192), ("c", hour, "issue", 8, 3, 1, 4096), ("c", hour + 5, "complete", 8, 1, 2, 8192)],
        [("c", 4 * hour, "issue", 9, 1, 1, 4096)],
        [("c", 4 * hour + 1, "complete", 9, 1, 1, 4096)],
    ]
    schema = "collection_id string, ts_us long, kind string, device long, sector long, segments long, bytes long"
    got = drain(
        spark, tmp_path / "y", chunks, schema,
        lambda s: stateful.stream_queue_depth(s, expire_after="1 hour", report_unfinished=True),
    )
    left = [(r.device, r.sector, r.queue_length_segment_ios, r.queue_length_4k_ios) for r in got.collect() if not r.finished]
    assert left == [(8, 3, 1, 1)] and got.count() == 4
