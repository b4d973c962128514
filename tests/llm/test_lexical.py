"""Ranked search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import docs_of, odd_texts
from tracelake.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    total = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 75 + 25 * c.total() * len(held) // total
            score = 0
            for t, times in Counter(terms(text)).items():
                w = math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1)))
                score += times * w * (10**9 * c[t] // (1000 * c[t] + 12 * m)) if c[t] else 0
            if score > 0:
                scored.append((-score, 2**63 if i is None else i, i))
        out += [(item, rank, x[2], -x[0]) for rank, x in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, extra=False):
    rows = [d if isinstance(d, tuple) else (i, d) for i, d in enumerate(docs)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    if extra:
        asked = asked.withColumns({c: F.lit("x") for c in ("item", "row", "key", "term", "weight")})
    got = lexical.lexical_search(docs_of(spark, rows, extra=extra), asked)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return rows, sorted(map(tuple, got.collect()), key=repr)


def corpus(rng, n):
    pool = [f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(3000)]
    texts = [" ".join(rng.choices(pool, k=rng.choice([3, 20, 80, 200]))) for _ in range(n)]
    return texts + [texts[0]] * 60


@pytest.mark.parametrize("shard", [400_000, 900])
def test_best_are_those_of_all_scores(spark, monkeypatch, shard):
    monkeypatch.setattr(lexical, "SHARD", shard)
    monkeypatch.setattr(lexical, "BLOCK", 40 if shard == 900 else 10**6)
    rng = random.Random(12)
    docs = corpus(rng, 300)
    items = [(i, " ".join(rng.choices(docs[i].split(), k=30))) for i in range(12)] + [(50, docs[0]), (51, "w1 W1 w1")]
    rows, got = found(spark, docs, items)
    assert got == brute(rows, items)
    assert len(got) > 12 * 20


def test_odd_texts_repeats_and_other_columns(spark):
    docs = odd_texts() + ["ÀB àb naïve 3x", (3, "one two"), (3, "one two"), (None, "cat on the mat 42"), "... ! ?"]
    items = [(1, None), (1, "the cat, the CAT; sat"), (1, "the cat, the CAT; sat"), (2, "Àb ÀB 3X x"), (None, "one"), (7, "zzz"), (8, "--")]
    rows, got = found(spark, docs, items, extra=True)
    assert got == brute(rows, items)


def test_empty_tables(spark):
    for docs, items in (([], [(1, "a")]), (["a b"], []), ([], []), ([None, ""], [(1, "a")])):
        assert found(spark, docs, items)[1] == []


def test_terms_sent_or_joined_give_the_same(spark, monkeypatch):
    docs = corpus(random.Random(3), 50)
    items = [(i, docs[i]) for i in range(5)]
    rows, got = found(spark, docs, items)
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 0)
    assert found(spark, docs, items)[1] == got == brute(rows, items)


def test_an_interval_is_left_when_its_bound_is_too_low():
    # One document holds both rare terms, thousands hold a common one: few are scored.
    rng = np.random.default_rng(1)
    n = 20_000
    row = np.r_[np.arange(n), [500, 900], [500, 1700]]
    term = np.r_[np.zeros(n), [1, 1], [2, 2]].astype(np.int64)
    impact = np.r_[rng.integers(1, 1000, n), [900] * 4]
    shard = lexical.Shard(row, row, term, impact)
    seen = []
    bounds = shard._bounds
    shard._bounds = lambda *x: seen.append(len(x[2])) or bounds(*x)
    scores, found = shard.search(np.array([0, 1, 2]), np.array([1, 5000, 5000]), 1)
    assert found.tolist() == [500] and scores[0] == impact[500] + 9_000_000
    assert sum(seen) < 500
