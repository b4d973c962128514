"""Benchmark items at any place of a document, against all its windows."""

from __future__ import annotations

import random
from collections import Counter

from tests.llm.test_text_operators import docs_of
from tracelake.llm import decontaminate


def most_similar(words: list[str], item: list[str]) -> float:
    def bag(w):
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    windows = [words[i : i + len(item)] for i in range(max(1, len(words) - len(item) + 1))]
    common = [(sum((bag(w) & bag(item)).values()), max(1, len(w) - 4)) for w in windows]
    return max(c / (n + max(1, len(item) - 4) - c) for c, n in common)


def test_every_window_is_looked_at(spark):
    rng = random.Random(31)
    some = [f"t{i}" for i in range(60)]
    other = [f"o{i}" for i in range(80)]
    words = [
        other + some[30:] + some[:30] + other,  # the halves have changed places
        some[2:] + other,  # begins before the document
        other + some[:57],  # ends after it
        some[3:58],  # longer than the document
        some[9:],  # too much is gone
        other + some[:20] + some[22:] + other,
        other + some[:25] + ["x"] + some[25:] + other,
        some[30:] + other,
    ]
    words += [rng.choices(["a", "b"], k=30) + some[rng.randrange(9) :] + rng.choices(some, k=20) for _ in range(12)]
    items = [some, ["a", "b"] * 12]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = decontaminate.leaks(docs_of(spark, [" ".join(w) for w in words]), bench).collect()
    want = {(d, i): round(most_similar(w, x), 6) for d, w in enumerate(words) for i, x in enumerate(items)}
    first = min(r["doc_id"] for r in found)
    assert {(r["doc_id"] - first, r["item_id"]): r["similarity"] for r in found} == {
        k: v for k, v in want.items() if v >= 0.8
    }
    assert {0, 1, 2, 3, 5, 6} <= {r["doc_id"] - first for r in found}
    assert {r["n_words"] for r in found if r["doc_id"] - first == 3} == {55}


def test_fingerprints_of_more_words_than_a_lane_counts(spark):
    import xxhash

    def signed(w):
        return xxhash.xxh64_intdigest(w.encode(), 42)

    lists = [[f"w{i * j}" for i in range(n)] for j, n in ((1, 1), (2, 50), (3, 300), (5, 66_000))]
    frame = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "i int, w array<string>")
    got = {r["i"]: r["f"] for r in frame.select("i", decontaminate._fingerprint("w").alias("f")).collect()}
    for i, w in enumerate(lists):
        h = [signed(x) for x in w]
        bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i] % 2**64 == bits
