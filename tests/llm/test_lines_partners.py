"""Line dedup against alignment with every earlier document."""

from __future__ import annotations

import random

from tests.llm.test_text_operators import docs_of
from tracelake.llm import lines


def brute(texts):
    """Number of deleted lines of each text."""
    split = [[x.strip() for x in t.split("\n") if x.strip()] for t in texts]
    places = [{x: [i for i, y in enumerate(own) if y == x] for x in own} for own in split]
    out = []
    for i, own in enumerate(places):
        gone = set()
        for j in range(i):
            shared = [
                {"first": j, "own": own[x], "theirs": places[j][x], "words": lines.line_words(x.encode())}
                for x in own
                if x in places[j]
            ]
            gone |= set(lines.removed_places(shared))
        out.append(len(gone))
    return out


def removed(spark, texts):
    return [r["n_removed"] for r in lines.line_dedup(docs_of(spark, texts)).orderBy("doc_id").collect()]


def test_later_partners_count_besides_the_first(spark):
    a, b = "the first long line of text", "another long line of text"
    texts = [f"{a}\n{b}", f"{b}\n{a}", f"{b}\n{a}", "yes\nno", "L1\nyes\nL2\nL3", "L1\nyes\nL2\nL3"]
    # What is aligned with any earlier document goes, also beside other lines.
    texts += [f"{b}\nmy own line here\n{a}", f"{b}\nour very own line here\n{a}"]
    rng = random.Random(31)
    pool = [" ".join(["w%d" % rng.randrange(99)] * rng.choice([1, 1, 2, 4, 5])) for _ in range(25)]
    for _ in range(60):
        text = [rng.choice(pool) for _ in range(rng.randrange(1, 9))]
        texts.append("\n".join(text))
        if rng.random() < 0.4:
            base = rng.choice(texts).split("\n")
            texts.append("\n".join(base[rng.randrange(2) :] + [rng.choice(pool)]))
    want = brute(texts)
    assert want[2] == 2 and want[5] == 4 and want[7] == 2
    assert removed(spark, texts) == want
