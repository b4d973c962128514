"""The pipeline's stages and the registered queries."""

from __future__ import annotations

import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import check
import corpus_pipeline
from tracelake.llm import bpe, lines, queries, toxicity
from tracelake.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and what it wrote, by name."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns_of_documents(spark, stages):
    columns = table(spark, SF, "documents").dtypes
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name][1].dtypes == columns
    assert stages["encode"][1].columns == [*(c for c, _ in columns), "token_ids"]


def test_toxic_documents_go_and_others_stay(spark, stages):
    before, after = (texts(x) for x in stages["toxicity"])
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.learn(docs, labels)
    score = {r["doc_id"]: r["score"] for r in toxicity.with_toxicity(docs, model).collect()}
    assert set(after) == {i for i in before if score[i] < 0.7}
    assert all(after[i] == before[i] for i in after)


def test_lines_that_earlier_documents_have_go(stages):
    """Against alignment with each earlier document that shares a line."""
    before, after = (texts(x) for x in stages["line_dedup"])
    assert set(after) == set(before)
    own, places, holders = {}, {}, {}
    for i in sorted(before):
        own[i] = [x for x in map(str.strip, re.split("\n", before[i] or "")) if x]
        places[i] = {}
        for at, line in enumerate(own[i]):
            places[i].setdefault(line, []).append(at)
        for line in places[i]:
            holders.setdefault(line, []).append(i)
    some = 0
    for i in before:
        gone = set()
        for j in {j for line in places[i] for j in holders[line] if j < i}:
            shared = [
                {"first": j, "own": places[i][x], "theirs": places[j][x], "words": lines.line_words(x.encode())}
                for x in places[i]
                if x in places[j]
            ]
            gone |= set(lines.removed_places(shared))
        some += bool(gone)
        assert [x for at, x in enumerate(own[i]) if at not in gone] == [
            x for x in map(str.strip, (after[i] or "").split("\n")) if x
        ]
    assert some > 5


def test_one_of_each_group_stays(stages):
    from tests.llm.test_near import survivors

    before, after = (texts(x) for x in stages["near_dedup"])
    ids = sorted(before)
    kept = survivors([before[i] for i in ids])
    assert set(after) == {ids[i] for i in kept} and len(after) < len(before)


def test_documents_with_benchmark_items_go(spark, stages):
    before, after = (texts(x) for x in stages["decontamination"])
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    items = [words(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    def holds(w, item):
        want = bag(item)
        if not bag(w).keys() & want.keys():
            return False
        for at in range(len(w) - len(item) + 1):
            got = bag(w[at : at + len(item)])
            if 1.8 * (got & want).total() >= 0.8 * (got.total() + want.total()):
                return True
        return False
    leaking = {i for i, t in before.items() if any(holds(words(t), item) for item in items)}
    assert set(before) - set(after) == leaking


def test_ids_decode_to_the_text(stages):
    codec = bpe.bpe(None)
    for row in stages["encode"][1].collect():
        assert codec.decode(row["token_ids"]) == row["text"]


def test_run_is_the_stages_in_a_row(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == set(texts(stages["encode"][1]))


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert check.compare(spark, con, SF, name).startswith("ok ")


def test_every_operator_and_the_pipeline_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert {"pipeline", *queries.QUERIES} <= set(entry.queries())
