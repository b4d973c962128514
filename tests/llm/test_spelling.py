"""Spelling variants against comparing all words."""

from __future__ import annotations

import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_text_operators import docs_of, odd_texts
from tracelake.llm import queries, spelling
from tracelake.llm.common import table

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {i: i + 32 for i in range(65, 91)}
COLUMNS = "word", "form", "root", "n", "n_near", "form_n"


def counted(rows):
    found = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def edits(word, letters):
    """All strings one edit away."""
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + x + word[i:] for x in letters}
        if i < len(word):
            out.add(word[:i] + word[i + 1 :])
            out |= {word[:i] + x + word[i + 1 :] for x in letters}
    return out - {word}


def one(a, b):
    """b is one edit away from a, of long words."""
    a, b = sorted((a, b), key=len)
    front = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[front + 1 :] == b[front + 1 :] if len(a) == len(b) else a[front:] == b[front + 1 :])


def brute(rows):
    n = counted(rows)
    letters, forms, near = set("".join(n)), {}, {}
    for w in n:
        near[w] = [x for x in edits(w, letters) if x in n] if len(w) < 99 else [x for x in n if one(w, x)]
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n[w], len(near[w]), n[forms[w]] if forms[w] else None))
    return sorted(out, key=repr)


def same(spark, texts, **how):
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    got = spelling.spelling_variants(docs_of(spark, texts, **how))
    assert tuple(got.columns) == COLUMNS
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    return want


def variants(rng, n):
    letters = "abcdeé÷"
    base = ["".join(rng.choices(letters, k=rng.choice([4, 5, 6, 6, 9]))) for _ in range(n)]
    words = base + [rng.choice(sorted(edits(w, letters))) for w in base for _ in range(3)]
    return [" ".join([w.title() if rng.random() < 0.2 else w] * int(rng.paretovariate(0.8)) * 2) for w in words]


@pytest.mark.parametrize("cell", [16_384, 60])
def test_variants_are_those_of_all_words(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "_LEAST_SAMPLE", 4)
    want = same(spark, variants(random.Random(8), 250))
    assert sum(form is not None for _, form, *_ in want) > 100
    assert any(root != form for _, form, root, *_ in want if form)


def test_worn_runs_and_capitals_beyond_ascii(spark):
    # Enough documents for some runs to lose a letter; É is not é.
    same(spark, ["Événement événement évènement naïveté word×word Straße STRASSE" for _ in range(400)])


def test_odd_texts_repeats_and_other_columns(spark):
    long = "b" * 40_000
    texts = odd_texts() + [(3, "mother father"), (3, "mother father"), (None, "mother fathers"), "fathers, fathers; fathers"]
    same(spark, texts + [f"{long} {long} {long} {long}c {long}c {long}c", "中文words words中 words"], extra=True)
    same(spark, [])
    same(spark, [None, "", "a b c"])


def test_words_in_every_cell_that_can_hold_near_ones(monkeypatch):
    monkeypatch.setattr(spelling, "CELL", 20)
    monkeypatch.setattr(spelling, "_LEAST_SAMPLE", 2)
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abcd", k=6)).encode() for _ in range(900)})
    counts = spelling.letter_counts(words)
    tree = spelling.UpperTree(6, counts[:200], len(words))
    assert tree.leaves > 8
    home = {int(i): leaf for leaf, some in tree.reach(counts, 0, 0) for i in some}
    assert len(home) == len(words)
    reached = {(int(i), leaf) for leaf, some in tree.reach(counts, 1, 1) for i in some}
    place = {w: i for i, w in enumerate(words)}
    for w, i in place.items():
        for x in edits(w.decode(), "abcd"):
            j = place.get(x.encode())
            assert j is None or (i, home[j]) in reached
    assert len(reached) < 0.8 * len(words) * tree.leaves


def test_near_in_a_cell_is_one_edit():
    rng = random.Random(6)
    for length in (5, 8, 300):
        base = "".join(rng.choices("ab", k=length))
        pool = {base, *rng.sample(sorted(edits(base, "abc")), 25)}
        members = sorted(w.encode() for w in pool if len(w) == length)
        asked = sorted(w.encode() for w in pool if len(w) in (length, length - 1))
        got = {(int(i), int(j)) for q, m in spelling.near_in_cell(members, asked) for i, j in zip(q, m, strict=True)}
        want = {
            (i, j)
            for i, a in enumerate(asked)
            for j, b in enumerate(members)
            if b.decode() in edits(a.decode(), "abc")
        }
        assert got == want
    short, longer = (np.array([list(w) for w in x], np.uint8) for x in ([b"abc", b"abd"], [b"abcd", b"bacd"]))
    assert np.array_equal(spelling.one_edit(short, longer), [[True, False], [True, False]])


def test_many_queries_of_a_cell_go_in_blocks(monkeypatch):
    rng = random.Random(8)
    members = sorted({"".join(rng.choices("abcde", k=6)).encode() for _ in range(300)})
    asked = [*members, *("".join(rng.choices("abcdexyz", k=rng.choice((5, 6)))).encode() for _ in range(60_000))]

    def found():
        met = spelling.near_in_cell(members, asked)
        return {(int(i), int(j)) for q, m in met for i, j in zip(q, m, strict=True)}

    tracemalloc.start()
    whole = found()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Letters of all queries at once took 2 KB for each, 120 MB.
    assert peak < 60e6
    place = {w: j for j, w in enumerate(members)}
    assert whole == {
        (i, place[x.encode()]) for i, w in enumerate(asked) for x in edits(w.decode(), "abcde") if x.encode() in place
    }
    monkeypatch.setattr(spelling, "_QUERIES", 1_000)
    monkeypatch.setattr(spelling, "_ROWS", 7)
    assert found() == whole


def test_query_over_a_test_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = queries.op11_spelling_variants(spark, SF).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
