"""MinHash near-duplicates against all pairs by brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import docs_of, odd_texts, rows_of
from tracelake.llm import minhash, queries
from tracelake.llm.common import table

SF = "/root/testdata/sf0.001"


def bag(text):
    words = (text or "").encode().lower().split()
    if len(words) < 2:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 2]) for i in range(len(words) - 1)}


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) of (doc_id, text); a null id is the last."""
    last = 2**63 - 1
    keys = [last if i is None else i for i, _ in rows]
    sets, root = [bag(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[top(i)] = top(j)
    least = {}
    for i, key in enumerate(keys):
        least[top(i)] = min(key, least.get(top(i), last))
    out = []
    for i, key in enumerate(keys):
        head = least[top(i)]
        out.append((rows[i][0], len(sets[i]), None if head == last else head, key == head))
    return sorted(out, key=repr)


COLUMNS = "doc_id", "n_shingles", "component_id", "kept"


def check(spark, texts, **how):
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    want = brute(rows)
    assert rows_of(minhash.minhash_components(docs_of(spark, texts, **how)), *COLUMNS) == want
    return want


def test_components_are_those_of_all_pairs(spark):
    rng = random.Random(41)
    new = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    texts = []
    for size, changes in [(3, 1), (6, 1), (12, 1), (40, 1), (40, 2), (150, 8), (300, 16), (800, 40)] * 3:
        base = new(size)
        texts.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            for at in rng.sample(range(size), changes):
                other[at] = f"v{rng.randrange(10**5)}"
            texts.append(" ".join(other))
    # Chains whose ends are unlike, and a passage in many texts that are otherwise unlike.
    base, common = new(100), new(60)
    for _ in range(12):
        base = base[6:] + new(6)
        texts.append(" ".join(base))
    texts += [" ".join(common + new(rng.randrange(0, 60))) for _ in range(90)]
    texts += [" ".join(common[rng.randrange(15) :]) for _ in range(20)]
    texts += ["a b c d", "A b C d", "ä B", "Ä b", "one", "ONE", "two"]
    rng.shuffle(texts)
    want = check(spark, texts)
    assert 40 < sum(not kept for *_, kept in want) < len(texts) - 60


def test_odd_texts_repeats_and_other_columns(spark):
    check(spark, odd_texts() + [(3, "one"), (2, "one two"), (2, "one two"), (None, "three four")], extra=True)
    empty = minhash.minhash_components(docs_of(spark, []))
    assert empty.count() == 0 and empty.columns == list(COLUMNS)
    check(spark, [None, "", " "])


@pytest.mark.parametrize("rounds", [0, 2])
def test_what_its_hubs_leave_apart_is_compared(spark, monkeypatch, rounds):
    # One bin for a band: unlike texts share buckets, most hubs are unlike their members.
    monkeypatch.setattr(minhash.Signer.__init__, "__defaults__", (40, 1))
    monkeypatch.setattr(minhash, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(minhash, "HUB_BLOCK", 300)
    monkeypatch.setattr(minhash, "MEMBER_BLOCK", 500)
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(pool, k=rng.choice([8, 30, 60]))) for _ in range(60)]
    for t in list(texts):
        words = t.split()
        words[rng.randrange(len(words))] = "x"
        texts.append(" ".join(words))
    check(spark, texts)


def test_blocks_are_compared_in_portions(spark, monkeypatch):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choices(pool, k=20)) for _ in range(30)]
    texts += [f"{t} {rng.choice(pool)}" for t in texts]
    docs = docs_of(spark, texts).select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("print"), "text")
    sets = [bag(t) for t in texts]
    rows = [(0, r["key"], len(sets[i]), 100 + r["key"]) for i, r in enumerate(docs.orderBy("key").collect())]
    first = min(r[1] for r in rows)
    rows = spark.createDataFrame(rows, "most long, node long, n long, root long")
    names = docs.select(F.col("key").alias("node"), "key", "print")
    stored, labels = minhash.stored, []

    def noted(df, label):
        labels.append(label)
        return stored(df, label)

    monkeypatch.setattr(minhash, "stored", noted)
    monkeypatch.setattr(minhash, "HUB_BLOCK", 100)
    monkeypatch.setattr(minhash, "MEMBER_BLOCK", 200)
    whole = minhash.FullSets(docs, names, lambda t: minhash._sets(t, 2))
    found = minhash.compared(rows.where(f"node < {first + 10}"), rows, whole)
    want = {
        (i, j)
        for i in range(10)
        for j in range(len(texts))
        if i != j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    }
    assert {(r["a"] - first, r["b"] - first) for r in found.collect()} == want and want
    # Each set meets several blocks, which were all sent at once.
    assert labels.count("minhash-links") > 1


def test_bins_agree_as_often_as_sets_do():
    rng, signer = np.random.default_rng(2), minhash.Signer()
    for size in (5, 10, 100, 3000):
        same = []
        for _ in range(200):
            h = rng.integers(0, 2**64, size, np.uint64, endpoint=False)
            a, b = np.sort(h[: size * 9 // 10]), np.sort(h[size // 10 :])
            same.append((signer.signature(a) == signer.signature(b)).mean())
        want = (size * 9 // 10 - size // 10) / size
        assert abs(np.mean(same) - want) < 0.03


def test_query_over_a_test_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert rows_of(queries.op13_minhash_near_dedup(spark, SF), *COLUMNS) == brute(rows)


def test_components_across_partitions_and_null_columns(spark):
    docs = table(spark, SF, "documents").withColumn("lang", F.lit(None).cast("string"))
    few, many = (rows_of(minhash.minhash_components(docs.repartition(n)), *COLUMNS) for n in (1, 7))
    assert few == many
