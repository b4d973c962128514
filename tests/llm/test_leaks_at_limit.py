"""Windows that just reach the similarity with a benchmark item."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tests.llm.test_text_operators import docs_of
from tracelake.llm import decontaminate


def test_items_changed_at_their_ends_up_to_the_limit(spark):
    """Changed words at either end spoil one shingle each: as many as 0.8 allows."""
    rng = random.Random(22)
    items, docs = [], []
    for i in range(1500):
        size, changes = ((40, 4), (100, 10))[i % 2]
        item = [f"t{rng.randrange(10**5)}" for _ in range(size)]
        window, front = list(item), rng.randrange(changes + 1)
        for at in [*range(front), *range(front - changes, 0)]:
            window[at] = f"v{rng.randrange(10**5)}"
        items.append((i, item, window))
        docs.append(" ".join(window))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w, _ in items], "item_id long, text string")
    found = decontaminate.leaks(docs_of(spark, docs), bench).where("doc_id = item_id")
    got = found.agg(F.count("*"), F.min("similarity")).first()
    # Beyond 14 bits lie two to three in a hundred.
    assert got[0] >= len(items) - 3 and got[1] < 0.81
