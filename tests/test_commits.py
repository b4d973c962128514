"""Published runs, and drains that are killed and started again."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracelake.sources import commits
from tracelake.streaming import drain

ROWS = "benchmark_name string, collection_id string, v long"


def bag(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_run_counts_once_and_whole(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    first = spark.createDataFrame([("b", "007", 1), ("b", "c2", 2)], ROWS)
    again = spark.createDataFrame([("b", "007", 1), ("b", "c2", 3)], ROWS)
    other = spark.createDataFrame([("x", "c9", 9)], ROWS)
    commits.commit_table(first, base, "t", "job-1")
    commits.commit_table(other, base, "t", "job-2")
    assert bag(commits.read_committed(spark, base, "t")) == [("b", "007", 1), ("b", "c2", 2), ("x", "c9", 9)]
    # Killed after its rows were written: nothing changes for readers.
    with monkeypatch.context() as m:
        m.setattr(commits, "_replace", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            commits.commit_table(again, base, "t", "job-1")
    assert bag(commits.read_committed(spark, base, "t")) == [("b", "007", 1), ("b", "c2", 2), ("x", "c9", 9)]
    for _ in range(2):
        commits.commit_table(again, base, "t", "job-1")
    assert bag(commits.read_committed(spark, base, "t")) == [("b", "007", 1), ("b", "c2", 3), ("x", "c9", 9)]
    commits.commit_table(first.where(F.lit(False)), base, "t", "job-1")
    assert bag(commits.read_committed(spark, base, "t")) == [("x", "c9", 9)]
    assert commits.read_committed(spark, base, "nothing", first.schema).count() == 0
    with pytest.raises(FileNotFoundError):
        commits.read_committed(spark, base, "nothing")
    with pytest.raises(ValueError):
        commits.commit_table(first, base, "t", "a/b")


def chunk(tmp_path, collection, name, values):
    folder = tmp_path / "in/b1" / collection
    folder.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({"v": pa.array(values, pa.int64())}), folder / f"{name}.parquet")


def test_killed_drains_give_each_row_once(spark, tmp_path, monkeypatch):
    base, state = f"{tmp_path}/out", f"{tmp_path}/state"
    go = lambda: drain.drain_tables(spark, f"{tmp_path}/in", {"t": "v long", "u": "v long"}, base, state)
    chunk(tmp_path, "c1", "t.0", [1, 2])
    chunk(tmp_path, "c1", "t.end", [])
    chunk(tmp_path, "c1", "u.0", [10])
    chunk(tmp_path, "c1", "t.more.0", [77])
    plain = commits._replace

    def killed_at(table, before):
        def replace(spark, path, text):
            if f"/{table}/" in path and before:
                raise OSError("killed")
            plain(spark, path, text)
            if f"/{table}/" in path:
                raise OSError("killed")
        return replace

    # Before and after the rows are published, but before the stream knows of it.
    for table, before in (("u", True), ("t", False), ("u", False)):
        monkeypatch.setattr(commits, "_replace", killed_at(table, before))
        try:
            go()
        except Exception as error:
            assert "killed" in str(error)
    monkeypatch.setattr(commits, "_replace", plain)
    go()
    rows = lambda t, **how: bag(drain.read_drained(spark, base, t, **how).select("collection_id", "chunk", "v"))
    assert rows("t") == [("c1", "0", 1), ("c1", "0", 2)]
    assert rows("u") == [("c1", "0", 10)]
    assert rows("t", closed_in=["t"]) == rows("t") and rows("t", closed_in=["t", "u"]) == []
    chunk(tmp_path, "c2", "t.0", [5])
    chunk(tmp_path, "c1", "u.end", [11])
    go()
    go()
    assert rows("t", closed_in=["t", "u"]) == [("c1", "0", 1), ("c1", "0", 2)]
    assert rows("t")[-1] == ("c2", "0", 5)
    assert rows("u") == [("c1", "0", 10), ("c1", "end", 11)]
