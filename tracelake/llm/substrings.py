"""Removal of long passages that an earlier document holds too (operator 5).

Every sequence of 50 words is an edge of a de Bruijn graph. Consecutive edges of a document
that share their smallest 8-word hash are compacted to one path before anything is
shuffled, which makes about one row of 22. Where the graph does not branch, two documents
with a common passage have the same paths, and an aggregation over paths finds the first
document of each. Where paths with one anchor differ, at the ends of a passage, the edges
of the first document of each path are written out and joined alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import doc_key, own_id, stored, whole_text

#: Words of an anchor.
_ANCHOR = 8
#: Windows looked at together; bounds the memory for a long text.
SLICE = 1 << 17
#: Entries of a worker's table of word hashes; a full table is emptied.
_CACHE = 200_000
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_word_hashes = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd base and of its inverse, modulo 2^64."""
    both = []
    for b in (base, pow(base, -1, 2**64)):
        powers = np.ones(n + 1, np.uint64)
        powers[1:] = b
        both.append(np.multiply.accumulate(powers))
    return both[0], both[1]


class _Sums:
    """Polynomial hashes of any stretch of a sequence, from prefix sums."""

    def __init__(self, h: np.ndarray, base: int) -> None:
        size = 1 << max(10, len(h).bit_length())  # few sizes, so that powers are kept
        up, self.down = _powers(base, size)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=self.sums[1:])

    def of(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[begins]) * self.down[begins]


@dataclass
class _Paths:
    """Paths of one slice of a document; windows count from the document's start."""

    offset: int
    first: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    path_a: np.ndarray
    path_b: np.ndarray
    sums: tuple[_Sums, _Sums]
    width: int

    def edges(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of the chosen paths and their hashes."""
        n, begins = self.windows[chosen], self.first[chosen] - self.offset
        at = np.repeat(begins - np.cumsum(n) + n, n) + np.arange(n.sum())
        a, b = (_mixed(s.of(at, at + self.width)) for s in self.sums)
        return at + self.offset, a.view(np.int64), b.view(np.int64)


def _paths(words: list[bytes], width: int, at_once: int) -> Iterator[_Paths]:
    for offset in range(0, len(words) - width + 1, at_once):
        part = words[offset : offset + at_once + width - 1]
        h = np.fromiter(map(_word_hashes.__getitem__, part), np.uint64, len(part))
        sums = _Sums(h, _BASES[0]), _Sums(_mixed(h), _BASES[1])
        at, n = np.arange(len(h) - _ANCHOR + 1), len(h) - width + 1
        least, span, reach = _mixed(sums[0].of(at, at + _ANCHOR)), 1, width - _ANCHOR + 1
        while 2 * span <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[:n], least[reach - span : reach - span + n])
        begins = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        lengths = np.diff(np.r_[begins, n])
        ends = begins + lengths + width - 1
        salt = _mixed(lengths.astype(np.uint64))
        a, b = (_mixed(s.of(begins, ends) ^ salt).view(np.int64) for s in sums)
        yield _Paths(offset, begins + offset, lengths, least[begins].view(np.int64), a, b, sums, width)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes]]]:
    """Rows without their text, and its words."""
    for batch in batches:
        rest = batch.drop_columns(["text"])
        for i, text in enumerate(batch.column("text")):
            row = {name: rest.column(name)[i].as_py() for name in rest.schema.names}
            yield row, text.as_py().encode().split()


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Rows that hold arrays, joined to batches of ``most`` values or a little more."""
    kept: list[dict] = []
    n = 0
    for row in rows:
        kept.append(row)
        n += len(row[schema.names[-1]])
        if n >= most:
            yield _joined(kept, schema)
            kept, n = [], 0
    if kept:
        yield _joined(kept, schema)


def _joined(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    sizes = [len(r[schema.names[-1]]) for r in rows]
    columns = [
        np.repeat(np.array([r[c] for r in rows], np.int64), sizes)
        if not isinstance(rows[0][c], np.ndarray)
        else np.concatenate([r[c] for r in rows])
        for c in schema.names
    ]
    arrays = [pa.array(c.astype(np.int64)) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _longs(*names: str) -> tuple[pa.Schema, str]:
    return pa.schema([(n, pa.int64()) for n in names]), ", ".join(f"{n} long" for n in names)


def _keyed(docs: DataFrame) -> DataFrame:
    """key and print tell rows apart: rows with one id and one text are alike in all."""
    text = whole_text()
    return docs.select(doc_key().alias("key"), F.xxhash64(text).alias("print"), text.alias("text"))


def repeated_spans(docs: DataFrame, width: int = 50, at_once: int = SLICE) -> DataFrame:
    """key, print, spans: windows of each document that an earlier one holds too.

    A span is (first, windows): windows that start at words first to first + windows - 1,
    each of ``width`` words. Earlier is a smaller doc_id; see ``drop_repeats``.
    """
    keyed = _keyed(docs)
    schema, ddl = _longs("key", "print", "first", "windows", "anchor", "path_a", "path_b")

    def to_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row | {c: getattr(p, c) for c in schema.names[2:]}
            for row, words in _texts(batches)
            for p in _paths(words, width, at_once)
        )
        return _batches(rows, schema)

    paths = stored(keyed.mapInArrow(to_paths, ddl), "paths")
    # Anchors that only one document has cannot hold a common window.
    shared = paths.groupBy("anchor").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    shared = shared.where("lo < hi").select("anchor")
    paths = stored(paths.join(shared, "anchor", "left_semi"), "shared-paths")

    path = ["anchor", "path_a", "path_b"]
    firsts = stored(paths.groupBy(*path).agg(F.min("key").alias("least")), "first-paths")
    whole = paths.join(firsts, path).where("key > least").select("key", "print", "first", "windows")

    # Where an anchor has several paths, windows of different paths may be equal.
    forks = firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    forked = firsts.join(forks, "anchor", "left_semi")
    wanted = forked.groupBy(F.col("least").alias("key")).agg(F.collect_set("path_a").alias("wanted"))
    edge_schema, edge_ddl = _longs("key", "print", "first", "edge_a", "edge_b")

    def to_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for row, words in _texts(batches):
                chosen = np.array(row.pop("wanted"), np.int64)
                for p in _paths(words, width, at_once):
                    mine = np.isin(p.path_a, chosen)
                    if mine.any():
                        yield row | dict(zip(edge_schema.names[2:], p.edges(mine), strict=True))

        return _batches(rows(), edge_schema)

    edges = stored(keyed.join(wanted, "key").mapInArrow(to_edges, edge_ddl), "edges")
    heads = edges.groupBy("edge_a", "edge_b").agg(
        F.min("key").alias("least"), F.max("key").alias("last")
    )
    # Stored, so that both sides of the join are plain shuffles, which Spark splits if one is hot.
    heads = stored(heads.where("least < last").drop("last"), "first-edges")
    single = edges.join(heads, ["edge_a", "edge_b"]).where("key > least")
    single = single.select("key", "print", "first", F.lit(1).cast("long").alias("windows"))
    spans = whole.union(single).groupBy("key", "print")
    return spans.agg(F.collect_list(F.struct("first", "windows")).alias("spans"))


def drop_repeats(docs: DataFrame, width: int = 50, at_once: int = SLICE) -> DataFrame:
    """doc_id, n_words, n_removed, kept: texts without words that stand in repeated windows.

    Words are cut at ASCII white space and stay unchanged; a window is ``width`` consecutive
    words of one document; it is repeated if its words also start a window of a document
    with a smaller doc_id. All windows are judged on the input. kept is what is left, joined
    by one space. One row for each row: rows with one doc_id do not count against each other
    (a null id is later than any other), a null or empty text has no words, a text of fewer
    than ``width`` words stays whole. An empty table gives an empty one; columns besides doc_id
    and text are not read.
    """
    spans = repeated_spans(docs, width, at_once)
    keyed = _keyed(docs)
    schema = pa.schema(
        [("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]
    )

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, words in _texts(iter([batch])):
                n, drop = len(words), np.zeros(len(words) + 1, np.int64)
                for span in row["spans"] or ():
                    drop[span["first"]] += 1
                    drop[span["first"] + span["windows"] + width - 1] -= 1
                gone = np.cumsum(drop[:-1]) > 0
                if gone.any():
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((row["key"], n, n - len(words), b" ".join(words).decode()))
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            arrays = [pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    kept = keyed.join(spans, ["key", "print"], "left").select("key", "spans", "text")
    kept = kept.mapInArrow(cut_out, "key long, n_words long, n_removed long, kept string")
    return kept.select(own_id(F.col("key")).alias("doc_id"), "n_words", "n_removed", "kept")


SUBSTRING_SQL = r"""
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), starts AS (
    SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM words WHERE len(w) >= 50
), hashed AS (
    SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS h FROM starts
), firsts AS (
    SELECT h, min(doc_id) AS d FROM hashed GROUP BY h HAVING count(DISTINCT doc_id) > 1
), gone AS (
    SELECT DISTINCT doc_id, i FROM (
        SELECT doc_id, unnest(range(p, p + 50)) AS i FROM hashed JOIN firsts USING (h) WHERE doc_id > d
    )
), dropped AS (
    SELECT doc_id, list(i) AS gone_at FROM gone GROUP BY doc_id
), left_over AS (
    SELECT doc_id, len(w) AS n_words, coalesce(len(gone_at), 0) AS n_removed,
        CASE WHEN gone_at IS NULL THEN w ELSE list_transform(
            list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone_at, i)), lambda i: w[i]) END AS kept
    FROM words LEFT JOIN dropped USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM left_over
"""
