"""Ranked lexical search (operator 12).

Documents are dealt into shards. A shard holds the posting lists of the terms that are asked
for, with sparse tables for the largest impact in any range. For each item, intervals of a
shard's documents are visited by the largest score that they can hold, the sum of the lists'
range maxima; an interval is split at the document of the largest impact, which is scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import doc_key, let_go, own_id, stored, whole_text

TOP = 20
#: Postings of a shard, about; with its sparse tables it takes some 30 MB.
SHARD = 400_000
#: Terms of items that are searched for at a time; they are sent to every task.
BLOCK = 500_000
#: Terms are sent to every task for the join with the documents' terms up to so many bytes.
BROADCAST_BYTES = 32_000_000
#: (interval, term) pairs that are looked at in one step, and intervals.
_STEP, _INTERVALS = 65_536, 64
#: Documents whose terms are listed together.
_AT_ONCE = 500
#: Letters and digits of ASCII, A-Z in lower case, and all bytes beyond it; the rest are gaps.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in order, in UTF-8."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, key, n (terms of the text), term, tf: a row for each different term of a text.

    A text with terms also has a row for the empty term, which no text holds: tf is n there.
    """
    for batch in batches:
        for at in range(0, len(batch), _AT_ONCE):
            part = batch.slice(at, _AT_ONCE)
            terms, tfs, held, sizes = [], [], [], []
            for text in part["text"]:
                words = terms_of(text.as_py())
                counted = Counter(words)
                if words:
                    counted[b""] = len(words)
                terms += counted.keys()
                tfs += counted.values()
                held.append(len(counted))
                sizes.append(len(words))
            whose = pa.array(np.repeat(np.arange(len(part)), held))
            arrays = [
                part["row"].take(whose),
                part["key"].take(whose),
                pa.array(np.repeat(np.array(sizes, np.int64), held)),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array(tfs, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "key", "n", "term", "tf"])
    let_go()


def occurrences(texts: DataFrame, key: Column) -> DataFrame:
    rows = texts.select(F.monotonically_increasing_id().alias("row"), key.alias("key"), whole_text().alias("text"))
    return rows.mapInArrow(_occurrences, "row long, key long, n long, term string, tf long")


class Shard:
    """Posting lists of a part of the documents, one after the other, with their sparse tables."""

    def __init__(self, row: np.ndarray, key: np.ndarray, term: np.ndarray, impact: np.ndarray) -> None:
        rows, at = np.unique(row, return_index=True)
        by_id = np.lexsort((rows, key[at]))
        self.keys = key[at][by_id]
        place = np.empty(len(rows), np.int64)
        place[by_id] = np.arange(len(rows))
        doc = place[np.searchsorted(rows, row)]
        self.terms, list_of = np.unique(term, return_inverse=True)
        self.docs = len(rows)
        #: list * docs + doc, which rises: one search finds a document in any list.
        code = list_of * self.docs + doc
        order = np.argsort(code)
        self.code, self.impact = code[order], impact[order].astype(np.int64)
        self.doc = doc[order].astype(np.int32)
        self.start = np.searchsorted(self.code, np.arange(len(self.terms) + 1) * self.docs)
        longest = int(np.diff(self.start).max(initial=1))
        #: best[k][i]: the place of the first largest impact from i on, among 2 ** k. Those that
        #: reach beyond a list are never read.
        self.best = [np.arange(len(self.code), dtype=np.int32)]
        for k in range(longest.bit_length() - 1):
            left = self.best[-1]
            right = left[np.minimum(np.arange(len(left)) + (1 << k), len(left) - 1)]
            self.best.append(np.where(self.impact[right] > self.impact[left], right, left))
        self.best = np.stack(self.best)
        self.power = np.array([max(n.bit_length() - 1, 0) for n in range(longest + 1)], np.int64)

    def largest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest impact in each range of a list, and its place; 0 for an empty one."""
        length = high - low
        k = self.power[np.maximum(length, 0)]
        top = len(self.code) - 1
        left = self.best[k, np.minimum(low, top)]
        right = self.best[k, np.clip(high - (1 << k), 0, top)]
        place = np.where(self.impact[right] > self.impact[left], right, left)
        return np.where(length > 0, self.impact[place], 0), place

    def search(self, terms: np.ndarray, weights: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and documents (places by id) of the ``top`` best above 0; ties to the smaller id."""
        at = np.searchsorted(self.terms, terms)
        at = np.minimum(at, len(self.terms) - 1)
        have = self.terms[at] == terms
        base, weights = at[have] * self.docs, weights[have]
        scores, found = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(base):
            return scores, found
        many = max(1, min(_INTERVALS, _STEP // len(base)))
        cuts = np.unique(np.linspace(0, self.docs, min(many, self.docs) + 1).astype(np.int64))
        bound, first, end, split = self._bounds(base, weights, cuts[:-1], cuts[1:], None)
        least = (0, self.docs)
        while True:
            # What cannot beat the last of the best, or come before it at the same score, goes.
            open_ = (bound > least[0]) | ((bound == least[0]) & (first < least[1]) & (bound > 0))
            bound, first, end, split = (x[open_] for x in (bound, first, end, split))
            if not len(bound):
                return scores, found
            if len(bound) > many:
                order = np.argpartition(-bound, many - 1)
                now, later = order[:many], order[many:]
            else:
                now, later = np.arange(len(bound)), np.empty(0, np.int64)
            place = np.searchsorted(self.code, base + split[now, None])
            held = self.code[np.minimum(place, len(self.code) - 1)] == base + split[now, None]
            impact = np.where(held, self.impact[np.minimum(place, len(self.code) - 1)], 0)
            scores = np.concatenate([scores, impact @ weights])
            found = np.concatenate([found, split[now]])
            best = np.lexsort((found, -scores))[:top]
            scores, found = scores[best], found[best]
            if len(scores) == top:
                least = (scores[-1], found[-1])
            left = self._bounds(base, weights, first[now], split[now], (None, place))
            right = self._bounds(base, weights, split[now] + 1, end[now], (place + held, None))
            bound, first, end, split = (
                np.concatenate([old[later], x, y])
                for old, x, y in zip((bound, first, end, split), left, right, strict=True)
            )

    def _bounds(self, base, weights, first, end, places):
        """bound, first, end of intervals of documents, and where to split each."""
        low, high = places or (None, None)
        low = np.searchsorted(self.code, base + first[:, None]) if low is None else low
        high = np.searchsorted(self.code, base + end[:, None]) if high is None else high
        largest, place = self.largest(low, high)
        share = largest * weights
        most = share.argmax(axis=1)
        split = self.doc[place[np.arange(len(place)), most]].astype(np.int64)
        return share.sum(axis=1), first, end, split


def _searched(asked, top: int):
    """item, key, score: the best of each shard for each item of the block that was sent."""

    def searched(batch: pa.Table) -> pa.Table:
        item, term, weight = asked.value
        columns = (batch[c].to_numpy() for c in ("row", "key", "term", "impact"))
        shard = Shard(*columns)
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else []
        items, keys, scores = [], [], []
        for begin, stop in zip(starts, [*starts[1:], len(item)], strict=True):
            score, found = shard.search(term[begin:stop], weight[begin:stop], top)
            items.append(np.full(len(score), item[begin]))
            keys.append(shard.keys[found])
            scores.append(score)
        let_go()
        joined = (np.concatenate([np.empty(0, np.int64), *x]) for x in (items, keys, scores))
        return pa.Table.from_arrays([pa.array(x) for x in joined], ["item", "key", "score"])

    return searched


def lexical_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` highest-scoring documents of each item.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, only
    A-Z in lower case. The weight of a term falls with the documents that hold it, its impact
    in a document rises with its occurrences and falls with the document's length; the score is
    the sum of weight times impact over the item's terms, in whole numbers.

    Documents without terms (null, empty, only marks) do not count and are found by nothing;
    neither are documents with a score of 0, so an item without terms, or with none that a
    document holds, has no rows. Equal scores are ranked by doc_id, a null id last. Each row of
    either table is a document or an item of its own, also where ids or whole rows repeat. A
    long document is one posting for each of its terms. An empty table on either side gives an
    empty one; only doc_id, item_id and text are read.

    Work: an item that shares its terms with everything can visit every document of a shard,
    never more. Items go in blocks of BLOCK terms, each sent to every task.
    """
    spark = docs.sparkSession
    asked = items.select(F.monotonically_increasing_id().alias("item"), "item_id", whole_text().alias("text"))
    asked = stored(asked, "lexical-items")
    wanted = stored(occurrences(asked, F.col("item")), "lexical-terms")
    vocabulary = wanted.select("term").union(spark.createDataFrame([("",)], "term string")).distinct()
    vocabulary = stored(vocabulary.withColumn("id", F.monotonically_increasing_id()), "lexical-vocabulary")
    bytes_ = vocabulary.agg(F.sum(F.octet_length("term") + 24)).first()[0]
    known = F.broadcast(vocabulary) if bytes_ <= BROADCAST_BYTES else vocabulary
    held = occurrences(docs, doc_key()).join(known, "term")
    held = held.select("row", "key", "n", F.col("id").alias("term"), (F.col("term") != "").alias("own"), "tf")
    held = stored(held, "lexical-postings")
    total = held.where("not own").agg(F.count("*"), F.sum("tf")).first()
    held, wanted = held.where("own"), wanted.where("term <> ''")
    n_docs, n_terms = F.lit(total[0]), F.lit(total[1] or 1)

    often = held.groupBy(F.col("term").alias("id")).agg(F.count("*").alias("df"))
    often = vocabulary.join(often, "id").select("term", "id", "df")
    weight = F.floor(1000 * F.log((2 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighted = wanted.join(often, "term").select(
        F.col("key").alias("item"), F.col("id").alias("term"), (weight * F.col("tf")).alias("weight")
    )
    weighted = stored(weighted.where("weight > 0"), "lexical-weights")
    shards = max(1, -(-held.count() // SHARD))
    blocks = max(1, -(-weighted.count() // BLOCK))
    m = F.lit(75) + F.call_function("div", 25 * F.col("n") * n_docs, n_terms)
    impact = F.call_function("div", 1_000_000_000 * F.col("tf"), 1000 * F.col("tf") + 12 * m).cast("int")
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard")
    dealt = held.select(shard, "row", "key", "term", impact.alias("impact"))
    found = None
    for block in range(blocks):
        own = weighted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()
        own = own.sort_by([("item", "ascending"), ("term", "ascending")])
        sent = spark.sparkContext.broadcast(tuple(own[c].to_numpy() for c in ("item", "term", "weight")))
        part = dealt.groupBy("shard").applyInArrow(_searched(sent, top), "item long, key long, score long")
        found = part if found is None else found.union(part)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "key"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= top)
    return asked.select("item", "item_id").join(best, "item").select(
        "item_id", "rank", own_id(F.col("key")).alias("doc_id"), "score"
    )


_SQL_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
LEXICAL_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS terms FROM documents),
s AS (SELECT count(*) AS nd, sum(len(terms))::BIGINT AS nt FROM d WHERE len(terms) > 0),
p AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
i AS (SELECT row_number() OVER () AS i, item_id, {_SQL_TERMS} AS terms FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS qtf
      FROM (SELECT i, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
      FROM f, s WHERE term IN (SELECT term FROM q) GROUP BY term, nd),
e AS (SELECT i, item_id, r, doc_id,
             sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN f USING (term), s GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM e WHERE score > 0)
WHERE rank <= {TOP}
"""
