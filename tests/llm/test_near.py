"""Near copies against all pairs by brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import docs_of, rows_of
from tracelake.llm import near


def bag(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def survivors(texts):
    sets, root = [bag(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {top(i) for i in range(len(texts))}


@pytest.mark.parametrize("paired", [64, 3])
def test_all_pairs_at_the_similarity_are_linked(spark, monkeypatch, paired):
    monkeypatch.setattr(near, "PAIRED", paired)
    rng = random.Random(21)
    new = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    texts = [None, "", "a b", "A  b", "one two three four five six", "one two three four five seven"]
    for size, changes in [(150, 1), (300, 5), (1000, 10), (60, 1), (60, 2), (40, 1)] * 4:
        base = new(size)
        texts.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            for at in rng.sample(range(size), changes):
                other[at] = f"v{rng.randrange(10**5)}"
            texts.append(" ".join(other))
    # A chain whose ends are not alike, a passage in many texts, and words lost at an end.
    base, common = new(100), new(60)
    texts += [" ".join(base[i * 6 :] + new(i * 6)) for i in range(1, 12)]
    for i in range(8):
        base = base[4:] + new(4)
        texts.append(" ".join(base))
    texts += [" ".join(common + new(rng.randrange(0, 40))) for _ in range(60)]
    texts += [" ".join(common[rng.randrange(12) :]) for _ in range(30)]
    rng.shuffle(texts)
    want = survivors(texts)
    assert len(want) < len(texts) - 60
    assert {r[0] for r in rows_of(near.drop_near_copies(docs_of(spark, texts)), "doc_id")} == want


def test_near_copies_of_an_empty_table_and_repeats(spark):
    docs = docs_of(spark, ["a b c d e f", (0, "a b c d e f"), (None, "a b c d e f"), (None, "z")], extra=True)
    kept = near.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id", "text") == [(0, "a b c d e f"), (None, "z")]
    assert near.drop_near_copies(docs.where(F.lit(False))).count() == 0


def test_close_fingerprints_are_linked_before_shingles_meet(spark, monkeypatch):
    """Pairs are proposed by fingerprints and verified, besides those that shingles find."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**5)}" for _ in range(900)]
    # One word at the end changes one shingle of 896, which turns few bits if any.
    texts = [" ".join([*base[:-1], f"v{i}"]) for i in range(12)]
    texts.append(" ".join(f"x{i}" for i in range(900)))
    close = []
    found = near._fingerprint_pairs

    def pairs(nodes):
        close.append(found(nodes))
        return close[-1]

    monkeypatch.setattr(near, "_fingerprint_pairs", pairs)
    assert {r[0] for r in rows_of(near.drop_near_copies(docs_of(spark, texts)), "doc_id")} == {0, 12}
    fp = [near.of_hashes(near.shingle_set(t).view("u8")) for t in texts]
    want = [(i, j) for i in range(12) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2]
    assert want and close[0].count() >= len({i for i, _ in want})
    assert near.of_hashes(near.shingle_set("")) == 0


def test_stored_tables_leave_no_shuffle_setting_behind(spark):
    from tracelake.llm import common

    before = spark.conf.get(common._FREE, None)
    assert common.stored(spark.range(9).groupBy((F.col("id") % 3).alias("r")).count(), "t").count() == 3
    assert common.cut(spark.range(4).distinct()).count() == 4
    assert spark.conf.get(common._FREE, None) == before


def test_shingles_that_many_texts_share_meet_last_however_many_there_are(spark, monkeypatch):
    rng = random.Random(17)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(22_000))
    texts = [f"{passage} " + " ".join(f"v{i}x{j}" for j in range(7_500)) for i in range(64)]
    found = {}

    def stored(df, label):
        out = kept(df, label)
        found.setdefault(label, out.count())
        return out

    kept = near.stored
    monkeypatch.setattr(near, "stored", stored)
    assert near.drop_near_copies(docs_of(spark, texts)).count() == 64
    # A fifth of a text's shingles is looked up, and it has more that are its own.
    assert found["near-nodes"] == 64 and found["near-shared"] == 0
