"""Benchmark items in documents by SimHash windows, in DataFrame functions (operator 10).

Every window of a document that is as long as an item, at any place, is given a fingerprint if
it shares enough shingles with one to reach the similarity. Fingerprints are looked up in an
index of the items' by blocks, which finds all within the radius, and the exact similarity of
shingles decides.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import doc_key, own_id, stored, whole_text

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of each block of a fingerprint, and how many of a block's may differ. Fingerprints
#: that differ in up to RADIUS bits differ in at most three bits in one of the five blocks.
BLOCKS = (13, 13, 13, 13, 12)
BLOCK_RADIUS = 3
RADIUS = len(BLOCKS) * (BLOCK_RADIUS + 1) - 1
#: Item shingles that are sent to every task at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Windows that are fingerprinted by a task.
TASK_WINDOWS = 2_000
_RUN = r"[\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_RUN), F.lit(0))


def _shingle_at(words: str, at: str, size: int) -> Column:
    """Hash of the ``size`` words from place ``at`` (from 0) of an array."""
    return F.expr(f"xxhash64({', '.join(f'{words}[{at} + {i}]' for i in range(size))})")


def _shingles(words: str, size: Column) -> Column:
    """All shingles of an array of words, repeats included; the whole of a shorter one."""
    return F.expr(
        f"transform(sequence(1, greatest(size({words}) - {SHINGLE - 1}, 1)),"
        f" i -> array_join(slice({words}, i, {SHINGLE}), ' '))"
    )


def _fingerprint(words: str) -> Column:
    """A bit is set if it is set in over half of the words' hashes.

    Bits are counted four at a time, in lanes of 16 bits of a long; those of more words than a
    lane counts, one at a time.
    """
    hashed = f"transform({words}, w -> xxhash64(w))"
    lanes = f"aggregate(h, 0L, (a, v) -> a + (shiftrightunsigned(v, i) & {0x0001000100010001}L))"
    counts = f"transform(sequence(0, 15), i -> {lanes})"
    packed = "shiftrightunsigned(c[i % 16], 16 * (i div 16)) & 65535"
    single = "size(filter(h, v -> getbit(v, i) = 1))"

    def bits(count: str) -> str:
        return f"aggregate(sequence(0, 63), 0L, (a, i) -> if(2 * ({count}) > size(h), a | shiftleft(1L, i), a))"

    few = f"transform(array({counts}), c -> {bits(packed.replace('i div 16', 'cast(i div 16 as int)'))})[0]"
    return F.expr(f"transform(array({hashed}), h -> if(size(h) < 65536, {few}, {bits(single)}))[0]")


def _block(fp: str, block: int) -> str:
    low = sum(BLOCKS[:block])
    return f"(shiftrightunsigned({fp}, {low}) & {(1 << BLOCKS[block]) - 1}L)"


def _balls(block: int) -> list[int]:
    """All ways to turn up to BLOCK_RADIUS bits of a block."""
    bits = [1 << i for i in range(BLOCKS[block])]
    turned = (combinations(bits, n) for n in range(BLOCK_RADIUS + 1))
    return [sum(some) for each in turned for some in each]


def _entries(fp: str, balls: bool) -> Column:
    """(block, value) under which a fingerprint stands; with the balls around each value."""
    parts = []
    for block in range(len(BLOCKS)):
        turns = ", ".join(f"{t}L" for t in (_balls(block) if balls else [0]))
        parts.append(
            f"transform(array({turns}), t -> named_struct('block', {block}, 'value', {_block(fp, block)} ^ t))"
        )
    return F.expr(f"concat({', '.join(parts)})")


def _similarity(a: str, b: str) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles, a shingle's weight its count."""
    counted = (
        f"aggregate(array_distinct({a}), 0, (n, s) -> n + least("
        f"size(filter({a}, x -> x = s)), size(filter({b}, x -> x = s))))"
    )
    # Where one of them repeats nothing, each common shingle counts once.
    common = f"if(size(array_distinct({b})) = size({b}), size(array_intersect({a}, {b})), {counted})"
    return F.expr(f"{common} / double(size({a}) + size({b}) - {common})")


def _item_table(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select("item_id", _words(whole_text()).alias("item_words"))
    return items.where("size(item_words) > 0").select(
        "item_id", "item_words", F.size("item_words").alias("m"), F.xxhash64("item_words").alias("g")
    )


def _starts(size: int) -> Column:
    """(at, lined) of all windows of a document that can reach the similarity to an item.

    With n shingles of the item and v of the window, the similarity needs 4 / 9 * (n + v) in
    common, so that many places of the window must have one of the item's. ``places`` are all
    such places of the document, in order. Of the windows in which place i is the first, those
    that reach the place as many later are named; ``lined`` has the windows in which some
    shingle stands where the item has it.
    """
    window = "least(m, total)"
    v = f"({window} - {size - 1})"
    need = f"((4 * (m - {size - 1} + {v}) + 8) div 9)"
    low = f"greatest(0, places[i + {need} - 1] - {v} + 1, if(i > 0, places[i - 1] + 1, 0))"
    high = f"least(places[i], total - {window})"
    return F.expr(
        f"if(size(places) < {need}, array(), flatten(transform("
        f"sequence(0, cast(size(places) - {need} as int)), i -> if({low} <= {high}, transform("
        f"sequence(cast({low} as int), {high}), at -> struct(at, array_contains(lined, at) as lined)), array()))))"
    )


def _windows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """key, print, g, m, at, lined, words: every window that can reach the similarity to item g.

    Windows stand at any place of a document, wherever the shingles stand in the item; they are
    as long as the item, or the whole document if that is shorter.
    """
    texts = docs.select(
        doc_key().alias("key"), F.xxhash64(whole_text()).alias("print"), _words(whole_text()).alias("words")
    )
    texts = texts.withColumn("total", F.size("words"))
    sizes = [r[0] for r in items.select(F.least("m", F.lit(SHINGLE))).distinct().collect()]
    found = None
    for size in sizes:  # one, unless items are shorter than a shingle
        own = items.where(F.least("m", F.lit(SHINGLE)) == size).select("g", "m", "item_words").distinct()
        own = own.select("g", "m", "item_words", F.explode(F.expr(f"sequence(0, m - {size})")).alias("j"))
        own = own.select("g", "m", "j", _shingle_at("item_words", "j", size).alias("shingle"))
        own = own.groupBy("g", "m", "shingle").agg(F.collect_set("j").alias("js"))
        few = own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        places = texts.where(F.col("total") >= size).select(
            "key", "print", "total", "words", F.explode(F.expr(f"sequence(0, total - {size})")).alias("p")
        )
        # Codegen reads a row's words in place; they are not copied.
        places = places.select("key", "print", "total", "p", _shingle_at("words", "p", size).alias("shingle"))
        hits = places.join(F.broadcast(own) if few else own, "shingle")
        hits = hits.withColumn("lined", F.expr("transform(js, j -> p - j)"))
        held = hits.groupBy("key", "print", "g", "m").agg(
            F.max("total").alias("total"),
            F.array_sort(F.collect_set("p")).alias("places"),
            F.array_distinct(F.flatten(F.collect_set("lined"))).alias("lined"),
        )
        part = held.select("key", "print", "g", "m", _starts(size).alias("starts")).where("size(starts) > 0")
        found = part if found is None else found.union(part)
    if found is None:
        nothing = "cast(null as long) as g", "0 as m", "0 as at", "false as lined", "words"
        return texts.selectExpr("key", "print", *nothing).where("false")
    found = stored(found, "window-starts")
    named = found.select("key", "print").distinct()
    few = named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    held = docs.select(doc_key().alias("key"), F.xxhash64(whole_text()).alias("print"), whole_text().alias("text"))
    held = held.join(F.broadcast(named) if few else named, ["key", "print"]).dropDuplicates(["key", "print"])
    held = held.select("key", "print", _words(F.col("text")).alias("words")).join(found, ["key", "print"])
    cut = "transform(starts, x -> struct(x.at, x.lined, slice(words, x.at + 1, m) as words))"
    return held.select("key", "print", "g", "m", F.inline(F.expr(cut)))


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, print, item_id, at, m, similarity: each item that a document holds, once.

    Words are runs of letters and digits in lower case; shingles are five words, repeats
    counted; a shorter item is one shingle. A window of a document has as many words as the
    item, at any place; a shorter document is one window. Of a document's windows the most
    similar to an item counts; of equals one in which a shingle stands where the item has it, then
    the first. ``m`` is the window's words. Items without words, null texts and empty tables
    match nothing; repeated documents are one (rows with one doc_id and one text).
    """
    items = _item_table(benchmark)
    windows = stored(_windows(docs, items), "windows")
    # Windows are short rows with much work, too small for Spark to deal them to many tasks.
    parts = 1 + windows.count() // TASK_WINDOWS
    contents = windows.select("m", "words").repartition(parts, "m", "words").distinct()
    contents = contents.withColumn("fp", _fingerprint("words"))
    items = items.withColumn("item_fp", _fingerprint("item_words"))
    probes = contents.select("m", "words", "fp", F.explode(_entries("fp", False)).alias("e"))
    index = items.select("m", "item_fp").distinct()
    index = index.select("m", "item_fp", F.explode(_entries("item_fp", True)).alias("e"))
    met = probes.join(index, ["m", "e"]).where(f"bit_count(fp ^ item_fp) <= {RADIUS}")
    met = met.select("m", "words", "item_fp").distinct().join(items, ["m", "item_fp"])
    scored = met.select(
        "m",
        "g",
        "words",
        "item_id",
        _shingles("words", F.col("m")).alias("a"),
        _shingles("item_words", F.col("m")).alias("b"),
    ).withColumn("similarity", _similarity("a", "b"))
    close = scored.where(F.col("similarity") >= SIMILARITY).select("m", "g", "words", "item_id", "similarity")
    every = windows.join(close, ["m", "g", "words"])
    best = every.groupBy("key", "print", "item_id").agg(
        F.max(F.struct("similarity", "lined", (-F.col("at")).alias("before"), F.size("words").alias("m"))).alias("best")
    )
    return best.select(
        "key", "print", "item_id", (-F.col("best.before")).alias("at"), F.col("best.m").alias("m"), "best.similarity"
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word (from 0), n_words, similarity: see ``contaminations``."""
    return contaminations(docs, benchmark).select(
        own_id(F.col("key")).alias("doc_id"),
        "item_id",
        F.col("at").alias("first_word"),
        F.col("m").alias("n_words"),
        F.round("similarity", 6).alias("similarity"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item; columns stay, repeated rows stay or go together."""
    held = contaminations(docs, benchmark).select("key", "print").distinct()
    keyed = docs.select(
        doc_key().alias("key"), F.xxhash64(whole_text()).alias("print"), F.struct("*").alias("row")
    )
    return keyed.join(held, ["key", "print"], "left_anti").select("row.*")


LEAKS_SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS b FROM benchmark
), items AS (
    SELECT item_id, b, len(b) AS m, least(5, len(b)) AS s FROM b WHERE len(b) > 0
), places AS (
    SELECT doc_id, s, unnest(range(1, len(w) - s + 2)) AS p, w FROM w, (SELECT DISTINCT s FROM items) WHERE len(w) >= s
), shingles AS (
    SELECT doc_id, s, p, array_to_string(w[p:p + s - 1], ' ') AS x FROM places
), own AS (
    SELECT item_id, b, m, s, j, array_to_string(b[j:j + s - 1], ' ') AS x
    FROM (SELECT *, unnest(range(1, m - s + 2)) AS j FROM items)
), windows AS (
    SELECT DISTINCT doc_id, p - j AS pos, m, item_id FROM shingles JOIN own USING (s, x)
    WHERE p >= j
), held AS (
    SELECT doc_id, pos, v.item_id, v.m, list_transform(range(pos + 1, pos + m - least(5, m) + 2),
        lambda i: array_to_string(w[i:i + least(5, m) - 1], ' ')) AS a
    FROM windows v JOIN w USING (doc_id) WHERE pos + m <= len(w)
), bags AS (
    SELECT item_id, list(x) AS c FROM own GROUP BY item_id
), scored AS (
    SELECT doc_id, pos, item_id, m, len(a) AS na, len(c) AS nc, list_sum(list_transform(list_distinct(a), lambda x:
        least(len(list_filter(a, lambda y: y = x)), len(list_filter(c, lambda y: y = x))))) AS n
    FROM held JOIN bags USING (item_id)
), best AS (
    SELECT *, n / (na + nc - n) AS similarity,
        row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n / (na + nc - n) DESC, pos) AS r
    FROM scored
)
SELECT doc_id, item_id, CAST(pos AS INTEGER) AS first_word, CAST(m AS INTEGER) AS n_words,
    round(similarity, 6) AS similarity
FROM best WHERE r = 1 AND similarity >= 0.8
"""
