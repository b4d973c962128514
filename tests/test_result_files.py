"""Result files on disk to tables, end to end."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tracelake.operators import experiments
from tracelake.sources.text import read_log_lines, read_result_lines


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_experiments_of_a_results_folder(spark, tmp_path):
    line = "   {:,}      instructions:k   # 1.0 insn per cycle\n"
    write(
        tmp_path / "my results" / "results",
        {
            "experiment_a/run_1/perf_results.txt": line.format(1000) + line.format(3000),
            "experiment_a/run_2/perf_results.txt": line.format(5000),
            "experiment_a/run_2/notes.txt": line.format(99),
            "experiment_b_memory_2G/run_1/perf_results.txt": line.format(1),
            "experiment_c_accept_threshold_60/run_1/perf_results.txt": "nothing counted\n",
            "experiment_k_off/results.txt": line.format(1),
        },
    )
    lines = read_result_lines(spark, str(tmp_path / "my results" / "results") + "/")
    got = experiments.experiment_averages(lines).collect()
    assert [(r.experiment, r.short_name, r.runs, r.average_instructions) for r in got] == [
        ("experiment_a_zswap_default", "zswap=default", 2, 4000.0),
        ("experiment_c_accept_threshold_60", "accept_threshold=60", 1, 0.0),
    ]


def test_map_get_files_name_system_and_sizes(spark, tmp_path):
    text = "get_iterations 10 map_size 32 value_size 8 Time(ns) {}\n"
    write(tmp_path, {"kmod-array-8-32.stats": text.format(100) + text.format(140), "ebpf-map-8-32.stats": text.format(50)})
    got = experiments.get_bench_stats(read_log_lines(spark, str(tmp_path))).collect()
    assert {(r.system, r.data_size, r.map_size, r.average_time_ns, r.variance) for r in got} == {
        ("kmod-array", 8, 32, 120.0, 800.0),
        ("ebpf-map", 8, 32, 50.0, None),
    }


def test_boxes_of_an_index_of_sample_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    samples = {f"{n}.txt": rng.random(31) for n in "abcd"}
    write(tmp_path / "samples", {n: "\n".join(map(str, v)) + "\n" for n, v in samples.items()})
    write(tmp_path, {"index": "left right\na.txt b.txt one\nc.txt d.txt two\n"})
    index = read_log_lines(spark, str(tmp_path / "index"))
    values = experiments.box_samples(index, read_log_lines(spark, str(tmp_path / "samples")), 2)
    got = experiments.box_summary(values, ["x", "group_label"], "value").collect()
    want = {("one", "left"): "a.txt", ("one", "right"): "b.txt", ("two", "left"): "c.txt", ("two", "right"): "d.txt"}
    assert {(r.x, r.group_label) for r in got} == set(want)
    for r in got:
        box = np.quantile(samples[want[r.x, r.group_label]], [0, 0.25, 0.5, 0.75, 1])
        assert np.allclose([r.min, r.q1, r.median, r.q3, r.max], box)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_large_logs_are_numbered_from_their_splits(spark, tmp_path, end):
    rng = random.Random(5)
    for name, n in (("big", 20_000), ("mid", 3_000), ("small", 3)):
        body = [f"===== SIZE {rng.randrange(9)} =====" if rng.random() < 0.01 else str(i) for i in range(n)]
        body[n // 2] = ""
        (tmp_path / f"{name}.log").write_bytes((end.join(body) + end * rng.choice([0, 1, 2])).encode())
    whole = read_log_lines(spark, str(tmp_path))
    assert whole.count() >= 23_003
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        cut = read_log_lines(spark, str(tmp_path), whole_bytes=1_000)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # The files are planned otherwise by now.
    assert sorted(cut.collect()) == sorted(whole.collect())
    sections = experiments.parse_sections(cut, target_rows=500)
    assert sorted(sections.collect()) == sorted(experiments.parse_sections(whole).collect())
    stored = cut.inputFiles()
    assert sum("log-lines" in f for f in stored) > 10  # many tasks read and wrote them


def test_log_of_one_split_and_none(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\ny")
    for size in (0, 100):
        lines = read_log_lines(spark, str(tmp_path / "a.txt"), whole_bytes=size)
        got = [(r.line_no, r.line, r.relative_path) for r in lines.orderBy("line_no").collect()]
        assert got == [(0, "x", "a.txt"), (1, "", "a.txt"), (2, "y", "a.txt")]
    assert read_log_lines(spark, str(tmp_path), glob="*.none").count() == 0
