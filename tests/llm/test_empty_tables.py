"""Every operator and stage on a table without rows and on columns with clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import docs_of
from tracelake.llm import (
    bpe,
    counts,
    decontaminate,
    language,
    lines,
    nearest,
    pii,
    simhash,
    substrings,
    toxicity,
)

LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"
DOCS = ["a b c d e f g", "x y", None, "", (0, "a b c d e f g"), (None, "a b c d e f g")]
ONE_ROW_EACH = {
    "simhash": simhash.simhash_components,
    "pii": pii.with_personal_data,
    "toxicity": lambda docs: toxicity.with_toxicity(docs, toxicity.learn(docs, labels_of(docs, []))),
    "substrings": substrings.drop_repeats,
    "lines": lines.with_kept_lines,
    "language": lambda docs: language.identify(docs, language.dictionaries(docs)),
    "counts": counts.token_counts,
    "round_trip": bpe.round_trip,
    "token_ids": bpe.with_token_ids,
}


def labels_of(docs, rows):
    return docs.sparkSession.createDataFrame(rows, LABELS)


@pytest.fixture
def inputs(spark, tmp_path):
    """A folder with labels and benchmark items, for stages."""

    def written(labels, items):
        labels_of(spark.range(0), labels).write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return written


@pytest.mark.parametrize("name", list(ONE_ROW_EACH))
def test_rows_of_an_operator(spark, name):
    none = docs_of(spark, DOCS).where(F.lit(False))
    plain = ONE_ROW_EACH[name](docs_of(spark, DOCS))
    empty = ONE_ROW_EACH[name](none)
    assert empty.count() == 0 and empty.columns == plain.columns
    assert plain.count() == len(DOCS)
    assert ONE_ROW_EACH[name](docs_of(spark, DOCS, extra=True)).count() == len(DOCS)


def test_pairs_and_leaks_of_empty_tables(spark):
    docs, items = docs_of(spark, DOCS), spark.createDataFrame([(1, "a b c d e f g")], ITEMS)
    held = {r["doc_id"] for r in decontaminate.leaks(docs, items).collect()}
    assert held == {0, None}
    for d, i in ((docs.where("false"), items), (docs, items.where("false"))):
        assert decontaminate.leaks(d, i).count() == 0
    vectors = spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert nearest.nearest(vectors.where("false")).count() == nearest.nearest(vectors).count() == 0


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_on_empty_tables(spark, inputs, number):
    name, stage = corpus_pipeline.STAGES[number]
    sf_dir = inputs([], [])
    docs = docs_of(spark, DOCS, extra=True)
    for given in (docs.where("false"), docs):
        got = stage(spark, given, sf_dir)
        assert got.columns[: len(docs.columns)] == docs.columns
        rows = got.count()
        # No labels and no items: all but copies stay.
        assert rows == 0 if given is not docs else rows == (3 if name == "near_dedup" else len(DOCS)), (name, rows)
