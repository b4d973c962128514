"""State machines of many keys: groups hold many keys, each with a state and an end of its own."""

from __future__ import annotations

import random

import pytest

from tests.test_sources_streams import bag
from tracelake.operators import spans
from tracelake.streaming import ingest, stateful

SCHEMA = "collection_id string, tid long, ts_ns long, kind string, name string, ret long, address long, length long, advice long"


def drained(spark, base, chunks, job):
    for chunk in chunks:
        spark.createDataFrame(chunk, SCHEMA).write.mode("append").parquet(f"{base}/in")
        out = job(ingest.stream_chunks(spark, f"{base}/in", SCHEMA))
        query = ingest.start_table_sink(out, f"{base}/out", f"{base}/state", partitions=())
        query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out"), query.lastProgress["stateOperators"][0]


def test_many_keys_are_few_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "PARTS", 7)
    rng = random.Random(5)
    data = [
        (
            rng.choice(["c", "d", None]), rng.choice([*range(90), None]), t * 1000, rng.choice(["entry", "return"]),
            rng.choice(["f", "g", '"']), rng.choice([0, -1]), rng.choice([t, None]), 2, 3,
        )
        for t in range(4000)
    ]
    chunks = [data[:1500], data[1500:1501], data[1501:]]
    batch = spark.createDataFrame(data, SCHEMA)
    got, state = drained(spark, tmp_path / "o", chunks, stateful.stream_spans_overwrite)
    assert state["numRowsTotal"] <= 7
    assert bag(got) == bag(spans.span_pairs_overwrite(batch)) and got.count() > 500
    got, state = drained(spark, tmp_path / "k", chunks, stateful.stream_spans_keep_first)
    assert state["numRowsTotal"] <= 7
    assert bag(got) == bag(spans.span_pairs_keep_first(batch)) and got.count() > 300


@pytest.mark.parametrize("parts", [1, 50])
def test_keys_of_a_group_end_one_by_one(spark, tmp_path, monkeypatch, parts):
    monkeypatch.setattr(stateful, "PARTS", parts)
    hour = 3600 * 10**9
    chunks = [
        [("c", 1, hour, "entry", "f", 0, 5, 6, 4), ("c", 2, hour, "entry", "f", 0, 5, 6, 4), ("c", 9, 3 * hour, "entry", "f", 0, 5, 6, 4)],
        [("c", 2, 4 * hour, "return", "f", 0, 5, 6, 4), ("c", 3, 4 * hour, "entry", "f", 0, 5, 6, 4)],
        [("c", 3, 5 * hour, "return", "f", 0, 5, 6, 4), ("c", 4, 9 * hour, "entry", "f", 0, 5, 6, 4)],
        [("c", 4, 9 * hour + 1, "return", "f", 0, 5, 6, 4)],
    ]
    over, _ = drained(
        spark, tmp_path / "o", chunks, lambda s: stateful.stream_spans_overwrite(s, expire_after="1 hour")
    )
    ends = {(r.pid, r.start_ts, r.end_ts) for r in over.collect()}
    assert {(1, hour, None), (2, hour, 4 * hour), (3, 4 * hour, 5 * hour), (4, 9 * hour, 9 * hour + 1), (9, 3 * hour, None)} == ends
    keep, _ = drained(
        spark, tmp_path / "k", chunks,
        lambda s: stateful.stream_spans_keep_first(s, expire_after="1 hour", report_unfinished=True),
    )
    assert {(r.tgid, r.finished) for r in keep.collect()} == {(1, False), (2, True), (3, True), (4, True), (9, False)}
