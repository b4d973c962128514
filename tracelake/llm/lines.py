"""Line dedup by pairwise alignment (operator 6).

Documents that share a run of lines long enough to tell something overlap; runs are looked
up by their hash. Every later document is aligned with the earlier ones by patience diff,
and aligned common blocks are deleted from it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tracelake.llm.common import doc_key, let_go, stored, whole_text

#: Words of a block of lines that do not recur by chance; a line of as many is one.
RARE_WORDS = 4

#: Parts of the holders of a run of lines, of each of which the first is a partner.
PARTS = 32

#: Documents whose lines are listed together.
_AT_ONCE = 1000

#: Letters of scripts that put no spaces between words; two of them count as a word.
_UNSPACED = regex.compile(
    r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]"
)

Match = tuple[int, int]


def _longest_rising(pairs: list[Match]) -> list[Match]:
    """The longest part of pairs, in order of the first place, whose second places rise."""
    tops: list[int] = []
    top_at: list[int] = []
    before: list[int] = []
    for i, (_, place) in enumerate(pairs):
        pile = bisect_left(tops, place)
        before.append(top_at[pile - 1] if pile else -1)
        tops[pile : pile + 1] = [place]
        top_at[pile : pile + 1] = [i]
    chain, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        chain.append(pairs[i])
        i = before[i]
    return chain[::-1]


def aligned(lines: list[tuple[list[int], list[int]]]) -> list[Match]:
    """Patience diff of two documents by the lines that both have.

    ``lines`` has for each such line its places in either document. Lines that occur once in
    both are anchors if they lie on the longest rising chain; between two anchors the same
    is done with the lines that occur once there, until nothing is left.
    """
    todo, found = [lines], []
    while todo:
        held = todo.pop()
        once = sorted((a[0], b[0]) for a, b in held if len(a) == len(b) == 1)
        rest = [x for x in held if not len(x[0]) == len(x[1]) == 1]
        chain = _longest_rising(once)
        found += chain
        if chain:
            todo += _between(chain, rest)
        else:
            # Nothing is unique: equal lines are met in order from the front.
            found += _in_order(rest)
    return sorted(found)


def _between(chain: list[Match], lines: list[tuple[list[int], list[int]]]) -> list[list]:
    """Lines by the gap of the chain that they have places in, in both documents."""
    gaps: dict[int, list] = {}
    edges = list(zip(*chain, strict=True))
    for places in lines:
        sides: list[dict[int, list[int]]] = [{}, {}]
        for side, own, anchors in zip(sides, places, edges, strict=True):
            for place in own:
                side.setdefault(bisect_left(anchors, place), []).append(place)
        for gap in sides[0].keys() & sides[1].keys():
            gaps.setdefault(gap, []).append((sides[0][gap], sides[1][gap]))
    return list(gaps.values())


def _in_order(lines: list[tuple[list[int], list[int]]]) -> list[Match]:
    found: list[Match] = []
    last = -1
    for place, i in sorted((place, i) for i, (a, _) in enumerate(lines) for place in a):
        there = lines[i][1]
        j = bisect_right(there, last)
        if j < len(there):
            last = there[j]
            found.append((place, last))
    return found


def removed_places(shared: Iterable[dict]) -> list[int]:
    """Places of a document's lines that stand in aligned blocks with earlier documents.

    ``shared`` has for each line: first (the document that has it first), own and theirs
    (its places in both) and words. A block is a run of lines that follow each other in
    both; it is deleted if it has RARE_WORDS words.
    """
    by_first: dict[object, list[dict]] = {}
    for line in shared:
        by_first.setdefault(line["first"], []).append(line)
    gone: set[int] = set()
    for lines in by_first.values():
        words = {place: line["words"] for line in lines for place in line["own"]}
        block: list[Match] = []
        matches = aligned([(line["own"], line["theirs"]) for line in lines])
        for match in [*matches, (-9, -9)]:
            if block and (match[0] != block[-1][0] + 1 or match[1] != block[-1][1] + 1):
                if sum(words[p] for p, _ in block) >= RARE_WORDS:
                    gone.update(p for p, _ in block)
                block = []
            block.append(match)
    return sorted(gone)


def line_words(line: bytes) -> int:
    """Words between ASCII white space, or half the letters of scripts without spaces."""
    words = len(line.split())
    if line.isascii():
        return words
    return max(words, -(-len(_UNSPACED.findall(line.decode())) // 2))


def _distinct_lines(places: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each different line of each document, with its places among the others."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _AT_ONCE):
                yield _lines_of(batch.slice(at, _AT_ONCE), places)
        let_go()

    return listed


def _lines_of(batch: pa.RecordBatch, places: bool) -> pa.RecordBatch:
    digests, counts, words, own, sizes = [], [], [], [], []
    for text in batch["text"]:
        every = [x for x in map(bytes.strip, text.as_py().encode().split(b"\n")) if x]
        lines = list(dict.fromkeys(every))
        digests += map(xxhash.xxh3_128_digest, lines)
        counts.append(len(lines))
        if places:
            words += map(line_words, lines)
            if len(lines) == len(every):
                own += range(len(lines))
                sizes += [1] * len(lines)
            else:
                at: dict[bytes, list[int]] = {}
                for i, line in enumerate(every):
                    at.setdefault(line, []).append(i)
                for some in at.values():
                    own += some
                    sizes.append(len(some))
        total = 0
        for line in every:
            total += line_words(line)
            if total >= RARE_WORDS:
                # All lines as one, which no line can be: its place is the number of lines below 0.
                digests.append(xxhash.xxh3_128_digest(b"\n" + b"\n".join(every)))
                counts[-1] += 1
                words.append(total)
                own.append(-len(every))
                sizes.append(1)
                break
    whose = pa.array(np.repeat(np.arange(len(batch)), counts))
    h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    arrays = [batch["key"].take(whose), batch["print"].take(whose), pa.array(h[:, 0]), pa.array(h[:, 1])]
    if not places:
        return pa.RecordBatch.from_arrays(arrays, ["key", "print", "a", "b"])
    ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
    arrays += [pa.array(words, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(own, pa.int32()))]
    return pa.RecordBatch.from_arrays(arrays, ["key", "print", "a", "b", "words", "own"])


def runs(lines: Iterable[dict], gone: Iterable[int] = ()) -> list[tuple[int, int, int, int]]:
    """(first place, last place, hash, hash) of the least runs of lines with RARE_WORDS words.

    ``lines`` has h, words and own of the lines that others have too. From each place on, and
    back from each, as few lines as make up the words. A block that is common with another
    document consists of such runs. Runs that are all in ``gone`` are left out.
    """
    at = {p: (x["h"], x["words"]) for x in lines for p in x["own"]}
    taken, found = set(gone), set()
    for place in at:
        for step in (1, -1):
            end, words = place, at[place][1]
            while words < RARE_WORDS and end + step in at:
                end += step
                words += at[end][1]
            if words >= RARE_WORDS:
                found.add((min(place, end), max(place, end)))
    out = []
    for low, high in sorted(found):
        if all(p in taken for p in range(low, high + 1)):
            continue
        raw = b"".join(at[p][0].to_bytes(8, "little", signed=True) for p in range(low, high + 1))
        h = xxhash.xxh3_128_intdigest(raw)
        out.append((low, high, (h >> 64) - 2**63, (h & 2**64 - 1) - 2**63))
    return out


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different run of each document; size is how many shared lines it has."""
    for batch in batches:
        columns: tuple[list, ...] = ([], [], [], [], [])
        for row in range(len(batch)):
            key, print_, lines, gone = (c[row].as_py() for c in batch.columns)
            for a, b in {x[2:] for x in runs(lines or (), gone or ())}:
                for column, value in zip(columns, (key, print_, a, b, len(lines)), strict=True):
                    column.append(value)
        arrays = [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, ["key", "print", "a", "b", "size"])
    let_go()


def block_places(lines: Iterable[dict]) -> list[int]:
    """Places of all blocks of the lines, as alignment with the same lines finds them."""
    words = {p: x["words"] for x in lines for p in x["own"]}
    gone, block = [], []
    for place in [*sorted(words), -9]:
        if block and place != block[-1] + 1:
            if sum(words[p] for p in block) >= RARE_WORDS:
                gone += block
            block = []
        block.append(place)
    return gone


def _block_places(lines: Column) -> Column:
    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([block_places(x.as_py()) for x in batch], pa.list_(pa.int32()))
        let_go()

    return F.arrow_udf(places, ArrayType(IntegerType()))(lines)


def _common(own: list[dict], theirs: list[dict]) -> list[dict]:
    there = {line["h"]: line["own"] for line in theirs}
    return [
        {"first": 0, "own": x["own"], "theirs": there[x["h"]], "words": x["words"]}
        for x in own
        if x["h"] in there
    ]


def _removed(own: Column, theirs: Column) -> Column:
    def places(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            found = [
                removed_places(_common(x.as_py(), y.as_py())) for x, y in zip(left, right, strict=True)
            ]
            yield pa.array(found, pa.list_(pa.int32()))
        let_go()

    return F.arrow_udf(places, ArrayType(IntegerType()))(own, theirs)


def _gone(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """key, print, gone: places in blocks aligned with any of a document's partners."""
    theirs = profiles.select(
        F.col("key").alias("other"), F.col("print").alias("other_print"), F.col("lines").alias("theirs")
    )
    both = pairs.join(theirs, ["other", "other_print"]).join(profiles, ["key", "print"])
    found = both.select("key", "print", _removed(F.col("lines"), F.col("theirs")).alias("places"))
    found = found.where(F.size("places") > 0).groupBy("key", "print")
    return found.agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("gone"))


def _cut_out(text: str, gone: list[int]) -> str:
    drop, at, lines = set(gone), -1, []
    for line in text.split("\n"):
        blank = not line.encode().strip()
        at += not blank
        if blank or at not in drop:
            lines.append(line)
    return "\n".join(lines) if len(drop) <= at else ""


def _kept(text: Column, gone: Column) -> Column:
    """The text without the lines at the places in ``gone``; blank lines are not counted."""

    def cut_out(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        # Only changed texts go back.
        for texts, places in batches:
            yield pa.array(
                [
                    _cut_out(text.as_py(), gone.as_py()) if gone.is_valid and len(gone) else None
                    for text, gone in zip(texts, places, strict=True)
                ],
                pa.string(),
            )
        let_go()

    return F.coalesce(F.arrow_udf(cut_out, "string")(text, gone), text)


def with_kept_lines(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), gone (places of deleted lines), kept (what is left).

    A line is what stands between newlines, without white space at its ends; blank lines do
    not count and stay, but a text whose lines are all deleted is left empty. Earlier is a
    smaller doc_id (a null id comes last); rows with one doc_id do not count against each
    other, repeated rows get equal results. Null and empty texts have no lines. An empty table gives
    an empty one; columns of any name stand apart in row. A text is cut into
    lines by one task, and those that it shares, as hashes with their places, are one row that is
    aligned with one partner at a time: both grow with the longest text.

    A document whose lines are all those of an earlier one, in order, loses all; one whose
    shared lines are those of an earlier one, at the same places, loses all blocks of them. Any
    other is aligned, over all lines that both have, with each earlier document that can take a
    line from it: with the first holder of each of its runs of lines (``runs``); for runs that
    still stand, with the first holder of each size; for those that stand after that, with all
    holders. A line in a block that is aligned with any earlier document stands in such a run,
    so none stays for want of a partner.
    """
    keys = doc_key().alias("key"), F.xxhash64(whole_text()).alias("print")
    rows = docs.select(*keys, whole_text().alias("text"))
    kinds = "key long, print long, a long, b long"
    first = rows.mapInArrow(_distinct_lines(places=False), kinds)
    lines = rows.mapInArrow(_distinct_lines(places=True), f"{kinds}, words int, own array<int>")
    first = first.groupBy("a", "b").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    # Runs can be shared by rows of one doc_id only, which take nothing from each other.
    first = first.where("first < last").select("a", "b", "first")
    # Stored, so that both sides of the join are plain shuffles, which Spark splits if one is hot.
    first = stored(first, "first-lines")
    whole = F.col("own")[0] < 0
    shared = lines.join(first, ["a", "b"]).groupBy("key", "print").agg(
        F.max(F.when(whole & (F.col("key") > F.col("first")), -F.col("own")[0])).alias("copied"),
        F.collect_set(F.when(~whole, F.struct(F.col("a").alias("h"), "words", "own"))).alias("lines"),
    )
    shared = stored(shared, "shared-lines")
    copies = shared.where("copied is not null")
    copies = copies.select("key", "print", F.expr("sequence(0, copied - 1)").alias("gone"))
    lines = F.array_sort("lines").alias("lines")
    alike = F.xxhash64(F.array_sort("lines")).alias("c"), F.xxhash64(F.lit(1), F.array_sort("lines")).alias("d")
    profiles = shared.where("copied is null and size(lines) > 0").select("key", "print", lines, *alike)
    # Of documents whose shared lines and their places are the same only the first is aligned.
    heads = stored(profiles.groupBy("c", "d").agg(F.min("key").alias("head")), "line-heads")
    profiles = stored(profiles.join(heads, ["c", "d"]).drop("c", "d"), "line-profiles")
    again = profiles.where("key > head").select("key", "print", _block_places(F.col("lines")).alias("gone"))
    profiles = profiles.where("key = head").select("key", "print", "lines")

    kinds = "key long, print long, a long, b long, size long"
    nothing = F.lit(None).cast("array<int>").alias("gone")
    units = stored(profiles.select("*", nothing).mapInArrow(_runs_of, kinds), "line-runs")
    first = F.min(F.struct("key", "print")).alias("f")
    other = F.col("f.key").alias("other"), F.col("f.print").alias("other_print")
    holders = units.groupBy("a", "b").agg(first, F.max("key").alias("last")).where("f.key < last")
    holders = stored(holders.select("a", "b", *other), "first-runs")
    # The first holder by the size of what it shares: one that shares little has little to align
    # a run with, and cannot set it aside for a longer order of lines.
    # Others share little else with any one document, so that the first of each of some parts of
    # all holders are tried as well.
    level = F.floor(F.log2(F.col("size"))) + PARTS
    part = F.explode(F.array(level, F.pmod(F.xxhash64("key"), F.lit(PARTS)))).alias("part")
    few = units.join(holders.select("a", "b"), ["a", "b"]).select("a", "b", "key", "print", part)
    few = stored(few.groupBy("a", "b", "part").agg(first).select("a", "b", *other), "few-runs")
    every = units.select("a", "b", F.col("key").alias("other"), F.col("print").alias("other_print"))
    pair = ["key", "print", "other", "other_print"]
    standing, gone, tried = units, copies.union(again), None
    for partners in (holders, few, every):
        pairs = standing.join(partners, ["a", "b"]).where("key > other").select(pair).distinct()
        pairs = pairs if tried is None else pairs.join(tried, pair, "left_anti")
        pairs = stored(pairs, "line-pairs")
        tried = pairs if tried is None else tried.union(pairs)
        gone = gone.union(stored(_gone(pairs, profiles), "lines-gone"))
        found = gone.groupBy("key", "print").agg(F.flatten(F.collect_list("gone")).alias("gone"))
        if partners is not every:
            left = profiles.join(found, ["key", "print"], "left").select("key", "print", "lines", "gone")
            standing = left.mapInArrow(_runs_of, kinds).join(holders, ["a", "b"]).where("key > other")
            standing = stored(standing.select("key", "print", "a", "b"), "standing-runs")
    gone = found.select("key", "print", F.array_distinct("gone").alias("gone"))
    joined = docs.select(*keys, F.struct("*").alias("row")).join(gone, ["key", "print"], "left")
    return joined.select("row", "gone", _kept(F.col("row.text"), F.col("gone")).alias("kept"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept of every row of ``docs``; see ``with_kept_lines``."""
    found = with_kept_lines(docs.select("doc_id", whole_text().alias("text")))
    lines = F.filter(F.split("row.text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return found.select(
        "row.doc_id",
        F.size(lines).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
        "kept",
    )


def drop_lines(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts; n_chars follows where there is one."""
    found = with_kept_lines(docs)
    columns = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        changed = F.when(F.size("gone") > 0, F.length("kept")).otherwise(F.col("row.n_chars"))
        columns["n_chars"] = changed.cast(docs.schema["n_chars"].dataType)
    return found.select(*(c.alias(name) for name, c in columns.items()))
