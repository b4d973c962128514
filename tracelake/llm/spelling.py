"""Spelling variants by k-d trees over letter counts (operator 11).

One edit adds one letter, takes one away, or does both, so the count vectors of near words lie
within an L1 distance of two. Words of a length are cut into cells by the upper part of a k-d
tree; each word goes to the cells that a near word can lie in, where the lower part of the tree
is searched box by box and the order of letters verified.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import let_go, stored, whole_text

LEAST_LETTERS, LEAST_SEEN = 5, 3
#: A form has so many times the occurrences of its variant or more.
RATIO = 2
#: One in so many runs loses a letter, by its hash.
WEAR = 97
#: Words of a cell, about.
CELL = 16_384
#: The upper tree is fitted on so many words, those with the least hashes. They decide how even
#: the cells are, not what is found.
SAMPLE = 50_000
#: A cell is cut no further when fewer words of the sample lie in it.
_LEAST_SAMPLE = 24
#: Words of a box that is cut no further; letters, and words of a box, compared in one step.
_BUCKET, _STEP, _MEMBERS = 24, 2_000_000, 1_000
#: Words whose letters are counted in one step; queries that go through a cell's boxes at once.
_ROWS, _QUERIES = 4_096, 32_768
#: Different runs that a task counts before it hands them on.
_COUNTED = 200_000
#: Letters by their Latin-1 code: a-z, then all from U+00C0 on; A-Z become lower case.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256)
)
_DIMENSIONS = [*range(97, 123), *range(0xC0, 0x100)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n: runs of letters as they are after wear, counted over many texts."""
    counts: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in counts]
        arrays = [pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(arrays, ["word", "n"])

    for batch in batches:
        for name, text in zip(batch["name"], batch["text"], strict=True):
            start = zlib.crc32(f"{name.as_py()}:".encode())
            found = text.as_py().encode("latin-1", "replace").translate(_LETTERS).split()
            for run, n in Counter(found).items():
                plain = run if run.isascii() else run.decode("latin-1").encode()
                h = zlib.crc32(plain, start)
                if h % WEAR == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]  # noqa: PLW2901
                if len(run) >= LEAST_LETTERS:
                    counts[run] += n
            if len(counts) >= _COUNTED:
                yield flush()
    yield flush()
    let_go()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: runs of letters with LEAST_LETTERS letters and LEAST_SEEN occurrences or more."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name")
    runs = docs.select(name, whole_text().alias("text")).mapInArrow(_runs, "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEN)


def letter_counts(words: list[bytes]) -> np.ndarray:
    """A row of counts for each word, a column for each letter."""
    counts = np.empty((len(words), len(_DIMENSIONS)), np.int32)
    step = max(1, min(_ROWS, _STEP // max(map(len, words), default=1)))
    for begin in range(0, len(words), step):
        some = words[begin : begin + step]
        whose = np.repeat(np.arange(len(some)), [len(w) for w in some])
        at = whose * 256 + np.frombuffer(b"".join(some), np.uint8)
        own = np.bincount(at, minlength=len(some) * 256).reshape(len(some), 256)
        counts[begin : begin + step] = own[:, _DIMENSIONS]
    return counts


def _best_cut(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter and the count at which words are cut most evenly; None if all are equal."""
    cuts = counts.sum(axis=0) // len(counts)
    below = (counts <= cuts).sum(axis=0)
    even = np.minimum(below, len(counts) - below)
    letter = int(even.argmax()) if len(even) else 0
    return (letter, int(cuts[letter])) if len(even) and even[letter] else None


class UpperTree:
    """Cells of the words of one length; a cell is a path of cuts (letter, count)."""

    def __init__(self, length: int, sample: np.ndarray, words: int) -> None:
        self.length, self.leaves = length, 0
        self.root = self._grown(sample, words / max(len(sample), 1))

    def _grown(self, sample: np.ndarray, weight: float):
        if len(sample) * weight > CELL and len(sample) >= 2 * _LEAST_SAMPLE and (cut := _best_cut(sample)):
            below = sample[:, cut[0]] <= cut[1]
            return cut, self._grown(sample[below], weight), self._grown(sample[~below], weight)
        self.leaves += 1
        return self.leaves - 1

    def reach(self, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, rows of counts) for each cell that holds points to which counts rise by ``up``
        in all at most and fall by ``down`` at most."""
        n, letters = counts.shape
        every = np.arange(n)
        todo = [(self.root, every, np.full(n, up), np.full(n, down), counts)]
        while todo:
            node, rows, up_left, down_left, own = todo.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                yield node, rows
                continue
            (letter, cut), below, above = node
            # What is beyond the cut moves to it, and has spent that much.
            for child, gap, left in ((below, own[:, letter] - cut, down_left), (above, cut + 1 - own[:, letter], up_left)):
                gap = np.maximum(gap, 0)
                ok = gap <= left
                moved = own[ok].copy()
                sides = [up_left[ok], down_left[ok]]
                if child is below:
                    sides[1] = sides[1] - gap[ok]
                    moved[:, letter] -= gap[ok]
                else:
                    sides[0] = sides[0] - gap[ok]
                    moved[:, letter] += gap[ok]
                todo.append((child, rows[ok], *sides, moved))


def _routed(trees: dict[int, UpperTree]):
    """length, cell, member (the word's own cell), word, n."""

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.as_py().encode("latin-1") for w in batch["word"]]
            lengths = np.array([len(w) for w in words], np.int64)
            at, length, cell, member = [], [], [], []
            for own in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == own)
                counts = letter_counts([words[i] for i in rows])
                home = np.zeros(len(rows), np.int64)
                if own in trees:
                    for leaf, some in trees[own].reach(counts, 0, 0):
                        home[some] = leaf
                at.append(rows), length.append(np.full(len(rows), own)), cell.append(home)
                member.append(np.ones(len(rows), bool))
                for other, up, down in ((own, 1, 1), (own + 1, 1, 0)):
                    reached = trees[other].reach(counts, up, down) if other in trees else [(0, np.arange(len(rows)))]
                    for leaf, some in reached:
                        some = some[home[some] != leaf] if other == own else some
                        at.append(rows[some]), length.append(np.full(len(some), other))
                        cell.append(np.full(len(some), leaf)), member.append(np.zeros(len(some), bool))
            order = np.concatenate(at) if at else np.empty(0, np.int64)
            arrays = [pa.array(np.concatenate(x)) if at else pa.array([], k) for x, k in ((length, pa.int64()), (cell, pa.int64()), (member, pa.bool_()))]
            arrays += [batch["word"].take(pa.array(order)), batch["n"].take(pa.array(order))]
            yield pa.RecordBatch.from_arrays(arrays, ["length", "cell", "member", "word", "n"])

    return routed


def _matrix(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which words of a become which of b by one edit: (words of a, words of b).

    A row holds a word's letters. All of a have one length, all of b the same or one more.
    """
    if a.shape[1] == b.shape[1]:
        return (a[:, None] != b[None]).sum(axis=2, dtype=np.int32) == 1
    # The common parts at both ends make up the shorter word.
    front = np.logical_and.accumulate(a[:, None] == b[None, :, :-1], axis=2)
    back = np.logical_and.accumulate((a[:, None] == b[None, :, 1:])[:, :, ::-1], axis=2)
    return front.sum(axis=2, dtype=np.int32) + back.sum(axis=2, dtype=np.int32) >= a.shape[1]


def _boxes(points: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray, np.ndarray, list[int]]]:
    """(points, low, high, halves) of the box around all points, then of all that it is cut into.

    A box has either its points or its halves, as places in the list.
    """
    boxes: list[tuple[np.ndarray | None, np.ndarray, np.ndarray, list[int]]] = []
    todo = [(np.arange(len(points)), -1)]
    while todo:
        some, whole = todo.pop()
        box, at = points[some], len(boxes)
        cut = _best_cut(box) if len(some) > _BUCKET else None
        boxes.append((None if cut else some, box.min(axis=0), box.max(axis=0), []))
        if whole >= 0:
            boxes[whole][3].append(at)
        if cut:
            below = box[:, cut[0]] <= cut[1]
            todo += [(some[below], at), (some[~below], at)]
    return boxes


def near_in_cell(members: list[bytes], queries: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, members) that are near each other, as places in the lists.

    Members have one length, queries the same or one letter less. A box of members is left out
    if no query can get into it by its one letter more and its one letter less. Letters are counted
    for _QUERIES queries at a time, as a cell is sent many times its members.
    """
    if not members or not queries:
        return
    length = len(members[0])
    own_letters, points = _matrix(members), letter_counts(members)
    used = points.any(axis=0)
    wide = np.int16 if length < 2**14 else np.int32
    boxes = _boxes(points[:, used].astype(wide))
    for same in (True, False):
        side = np.array([i for i, q in enumerate(queries) if (len(q) == length) == same], np.int64)
        for begin in range(0, len(side), _QUERIES):
            places = side[begin : begin + _QUERIES]
            words = [queries[i] for i in places]
            letters, asked = _matrix(words), letter_counts(words)
            down = int(same) - asked[:, ~used].sum(axis=1)
            asked = asked[:, used].astype(wide)
            for rows, some in _boxes_met(boxes, asked, down):
                step = max(1, _STEP // (len(some) * length))
                for at in range(0, len(rows), step):
                    now = rows[at : at + step]
                    for first in range(0, len(some), _MEMBERS):
                        there = some[first : first + _MEMBERS]
                        i, j = np.nonzero(one_edit(letters[now], own_letters[there]))
                        if len(i):
                            yield places[now[i]], there[j]


def _boxes_met(boxes, asked: np.ndarray, down: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, points) of the boxes that are cut no further, with the queries that one letter
    more and ``down`` letters less take into them."""
    todo = [(0, np.flatnonzero(down >= 0))]
    while todo:
        box, rows = todo.pop()
        some, low, high, halves = boxes[box]
        own = asked[rows]
        ok = np.maximum(low - own, 0).sum(axis=1) <= 1
        ok &= np.maximum(own - high, 0).sum(axis=1) <= down[rows]
        rows = rows[ok]
        if not len(rows):
            continue
        if some is None:
            todo += [(half, rows) for half in halves]
        else:
            yield rows, some


def _best(whose: np.ndarray, n: np.ndarray, rank: np.ndarray, of: np.ndarray):
    """For each different ``whose``: how often it stands there, and the ``of`` with the greatest
    n, then the least rank."""
    order = np.lexsort((rank, -n, whose))
    ids, first, times = np.unique(whose[order], return_index=True, return_counts=True)
    return ids, times, of[order[first]]


_FOUND = "word string, n_near long, form_n long, form string"


def _searched(batch: pa.Table) -> pa.Table:
    """word, n_near, form_n, form: what a cell adds to its members and to words sent to it."""
    words = [w.encode("latin-1") for w in batch["word"].to_pylist()]
    n, member = batch["n"].to_numpy(), batch["member"].to_numpy(zero_copy_only=False)
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    own = np.flatnonzero(member)
    pairs = list(near_in_cell([words[i] for i in own], words)) if len(own) else []
    query = np.concatenate([np.empty(0, np.int64), *(q for q, _ in pairs)])
    other = own[np.concatenate([np.empty(0, np.int64), *(m for _, m in pairs)])] if len(own) else query
    # A shorter word is met here alone, so the longer one learns of it here as well.
    sizes = np.array([len(w) for w in words], np.int64)
    shorter = sizes[query] < sizes[other]
    left, right = np.r_[query, other[shorter]], np.r_[other, query[shorter]]
    ids, times, best = _best(left, n[right], rank[right], right)
    arrays = [
        batch["word"].take(pa.array(ids)),
        pa.array(times, pa.int64()),
        pa.array(n[best], pa.int64()),
        batch["word"].take(pa.array(best)),
    ]
    let_go()
    return pa.Table.from_arrays(arrays, ["word", "n_near", "form_n", "form"])


def upper_trees(words: DataFrame) -> dict[int, UpperTree]:
    """Trees of the lengths that have more words than a cell holds."""
    sizes = words.groupBy(F.length("word").alias("length")).count().where(F.col("count") > CELL)
    sizes = {r["length"]: r["count"] for r in sizes.collect()}
    if not sizes:
        return {}
    sample = words.where(F.length("word").isin(*sizes)).orderBy(F.xxhash64("word"), "word").limit(SAMPLE)
    by_length: dict[int, list[bytes]] = {}
    for r in sample.select("word").collect():
        by_length.setdefault(len(r["word"]), []).append(r["word"].encode("latin-1"))
    return {k: UpperTree(k, letter_counts(v), sizes[k]) for k, v in by_length.items()}


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, form_n, form of each word that has near words: how many, and the one with
    the most occurrences (the least word among equals)."""
    routed = words.mapInArrow(
        _routed(upper_trees(words)), "length long, cell long, member boolean, word string, n long"
    )
    found = routed.groupBy("length", "cell").applyInArrow(_searched, _FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow from each word of (word, form).

    Each round goes twice as far as the last; a form has RATIO times its variant's occurrences,
    so there are as many rounds as the logarithm of the longest chain, which is one itself.
    """
    ahead = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = ahead.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        new = stored(ahead.join(onward, "root", "left"), "spelling-onward")
        if new.where("onward is not null").isEmpty():
            return ahead
        ahead = new.select("word", F.coalesce("onward", "root").alias("root"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts.

    Runs of letters (A-Z, a-z, U+00C0 to U+00FF) are lower-cased in A-Z; one in WEAR, by the hash
    of doc_id and run, loses a letter. Words are the different results with LEAST_LETTERS letters
    and LEAST_SEEN occurrences. Near words differ by one inserted, deleted or replaced letter.
    The form is the near word with the most occurrences n (the first in code-point order among
    equals) if these are RATIO times the word's or more; the root is the end of the forms, the
    word itself if it has none.

    Null and empty texts have no runs; a null doc_id has an empty text for its hash; repeated
    rows count again. Very long runs are words as any others. An empty table, or one without
    words, gives an empty one. Columns besides doc_id and text are not read.

    The vocabulary is dealt by cells of some CELL words; no pairs of words leave a cell, only
    each word's count and best. More than SAMPLE / _LEAST_SAMPLE cells are not made: beyond some
    30 million words cells grow.
    """
    words = stored(vocabulary(docs), "spelling-words")
    near = stored(near_words(words), "spelling-near")
    forms = words.join(near, "word", "left").withColumn("has", F.col("form_n") >= RATIO * F.col("n"))
    forms = stored(
        forms.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("has"), F.col("form")).alias("form"),
            F.when(F.col("has"), F.col("form_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(forms.where("form is not null"))
    return forms.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
