"""Each stage of run() reads a table that the one before wrote."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.test_text_operators import DATA
from tracelake.sources.scratch import shared_root


def test_stages_read_stored_tables(spark, monkeypatch):
    given = []

    def stage(spark, docs, sf_dir):
        given.append(docs.inputFiles())
        return docs.limit(5)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage), ("three", stage)])
    assert corpus_pipeline.run(spark, DATA).count() == 5
    assert all(DATA in f for f in given[0])
    for files, name in zip(given[1:], ("one", "two"), strict=True):
        assert files and all(shared_root(spark) in f and f"stage-{name}" in f for f in files)
