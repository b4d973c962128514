"""Near copies by SimHash and exact similarity of shingles (the pipeline's near_dedup stage).

Every set of shingles has a SimHash fingerprint. Fingerprints within 2 bits meet by multi-index
lookup, as in operator 2, and what meets is verified on the whole sets and linked. At the limit
of similarity fingerprints differ in some 10 bits, so what these leave apart is found by shingles:
two sets of shingles whose Jaccard similarity reaches the limit share one of the first few
of each in any fixed order (prefix filter), so looking up by these finds every pair. Texts
that meet are first held against hubs, and only what these leave apart is paired in full;
every link is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import doc_key, let_go, stored, whole_text
from tracelake.llm.minhash import HUB_ROUNDS, FullSets, compared_rest, merged, still_apart
from tracelake.llm.simhash import close_pairs, of_hashes

WIDTH = 5
#: Similarity of a link, as a fraction, so that a pair that just reaches it is no rounding matter.
REACHED, OF = 4, 5
SEED = 42
#: Parts of the shingles' hashes, a power of two: pairs with too different counts in them are told
#: apart without their sets.
PARTS = 256
#: The order of shingles puts those last that several texts share, by how many: those that SEEN
#: or more in a sample of one text in SAMPLED have. Any order gives the same pairs; this one makes
#: few others meet. Counts are kept by cells of shingles, so that their table has a fixed size.
SAMPLED, SEEN = 16, 2
CELLS = 1 << 24
#: Names of texts, or shingles that are shared, that are sent to every task at most; more are
#: joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Texts under one shingle that are paired, those that hubs leave apart; more are compared in blocks.
PAIRED = 64
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted different hashes of a text's shingles; a text of fewer words is one shingle."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = max(1, len(words) - width + 1)
    begins = [0, *(gaps[: starts - 1] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(line)]
    pairs = zip(begins, ends, strict=True)
    hashes = np.fromiter((digest(line[b:e], SEED) for b, e in pairs), np.uint64, starts)
    return np.unique(hashes.view(np.int64))


def _sets(text: Column, width: int, kind: str = "array<long>") -> Column:
    """Hashes of a text's shingles, as an array or ``binary``, 8 bytes each."""

    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = (shingle_set(t.as_py(), width) for t in texts)
            if kind == "binary":
                yield pa.array([x.tobytes() for x in found], pa.binary())
            else:
                yield pa.array(list(found), pa.list_(pa.int64()))
        let_go()

    return F.arrow_udf(sets, kind)(text)


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) // np.uint64(2**64 // CELLS)).astype(np.int64)


def _shared_cells(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells with shingles that several texts of the sample have, and their ranks: 16 for each
    doubling of the most frequent one's texts."""
    part = texts.where(F.pmod(F.xxhash64("print"), F.lit(SAMPLED)) == 0).dropDuplicates(["print"])
    seen = part.select(F.explode(_sets(F.col("text"), width)).alias("t")).groupBy("t").count()
    cell = F.shiftrightunsigned("t", 65 - CELLS.bit_length()).cast("int").alias("cell")
    often = seen.where(F.col("count") >= SEEN).groupBy(cell).agg(F.max("count").alias("count"))
    found = often.select("cell", F.least(F.lit(255), F.round(16 * F.log2("count"))).cast("short").alias("rank")).toArrow()
    return found["cell"].to_numpy(), found["rank"].to_numpy().astype(np.uint8)


def _prefixes(cells: np.ndarray, ranks: np.ndarray, width: int):
    """key, print, node (names the set), n (its size), its fingerprint, the first shingles in the
    order, and how many of all lie in each of PARTS parts (255: or more)."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(CELLS, np.uint8)
        known[cells] = ranks
        for batch in batches:
            nodes, sizes, fps, heads, counts = [], [], [], [], []
            for text in batch["text"]:
                own = shingle_set(text.as_py(), width)
                length = len(own) - -(-REACHED * len(own) // OF) + 1 if len(own) else 0
                heads.append(own[np.lexsort((own, known[_cell(own)]))[:length]])
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()) - 2**63)
                sizes.append(len(own))
                fps.append(of_hashes(own))
                parts = np.bincount(own & (PARTS - 1), minlength=PARTS)
                counts.append(np.minimum(parts, 255).astype(np.uint8).tobytes())
            arrays = [
                batch["key"],
                batch["print"],
                pa.array(nodes, pa.int64()),
                pa.array(sizes, pa.int32()),
                pa.array(np.array(fps, np.uint64).view(np.int64)),
                pa.array(heads, pa.list_(pa.int64())),
                pa.array(counts, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "print", "node", "n", "fp", "head", "counts"])
        let_go()

    return prefixes


def _can_reach(a: Column, b: Column) -> Column:
    """Whether sets with these counts can reach the similarity: they have no more in common than
    the smaller count of each part."""

    def can(left: pa.Array, right: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64) for v in (left, right))
        most = np.minimum(x, y).sum(axis=1)
        over = ((x == 255) & (y == 255)).any(axis=1)
        return pa.array(over | (OF * most >= REACHED * (x.sum(axis=1) + y.sum(axis=1) - most)), pa.bool_())

    return F.arrow_udf(can, "boolean")(a, b)


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that connect all whose fingerprints are within 2 bits.

    Nodes with one fingerprint meet the least of them, and those of close fingerprints meet.
    """
    least = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")), "near-prints")
    equal = nodes.select("fp", "node").join(least, "fp").where("node > first")
    equal = equal.select(F.col("first").alias("a"), F.col("node").alias("b"))
    close = stored(close_pairs(least.select("fp")), "near-close")
    for x in "ab":
        own = least.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}"))
        close = close.join(own, x)
    close = close.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    return equal.union(close)


def near_nodes(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Rows (key, print, node) of all documents, and (node, root) of all linked nodes.

    Rows with equal sets are one node. Of the others, all whose sets reach the similarity get
    one root, however many share a shingle: those with close fingerprints are linked first, then a
    shingle's texts are held against one hub, then against others in HUB_ROUNDS rounds, and what
    still has several roots is paired.
    """
    texts = docs.select(
        doc_key().alias("key"), F.xxhash64(whole_text()).alias("print"), whole_text().alias("text")
    )
    cells, ranks = _shared_cells(texts, width)
    kinds = "key long, print long, node long, n int, fp long, head array<long>, counts binary"
    rows = stored(texts.mapInArrow(_prefixes(cells, ranks, width), kinds), "near-heads")
    least = rows.groupBy("node").agg(
        F.min(F.struct("key", "print")).alias("f"), *(F.first(c).alias(c) for c in ("n", "fp", "head", "counts"))
    )
    nodes = stored(least.select("node", "f.key", "f.print", "n", "fp", "head", "counts"), "near-nodes")
    sets = FullSets(texts, nodes.select("node", "key", "print"), lambda t: _sets(t, width, "binary"))
    at = nodes.select("node", "n", F.posexplode("head").alias("i", "t"))
    met = at.groupBy("t").agg(F.min(F.struct("node", "n", "i")).alias("h"), F.max("node").alias("last"))
    met = met.where("h.node < last")
    met = stored(met.select("t", F.expr("h.node as hub"), F.expr("h.n as m"), F.expr("h.i as j")), "near-met")
    few = met.count() <= BROADCAST_ROWS
    shared = stored(at.join(F.broadcast(met) if few else met, "t"), "near-shared")
    # Against the least node under each shingle; sizes alone rule out some. At the first common
    # shingle of a pair, what follows in both must be enough.
    fits = f"{OF} * least(n, m) >= {REACHED} * greatest(n, m)"
    enough = f"{OF + REACHED} * least(n - i, m - j) >= {REACHED} * (n + m)"
    star = shared.where("node > hub").where(fits).where(enough)
    star = star.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()

    def possible(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("counts").alias(f"c{x}")), x)
        return stored(pairs.where(_can_reach(F.col("ca"), F.col("cb"))).select("a", "b"), "near-possible")

    tried = stored(_fingerprint_pairs(nodes), "near-pairs")
    labels = merged(None, sets.confirmed(possible(tried)))
    for x in "ab":
        own = labels.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        star = star.join(own, x, "left")
    star = star.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")
    star = stored(star.join(tried, ["a", "b"], "left_anti"), "near-pairs")
    tried = tried.union(star)
    if not star.isEmpty():
        labels = merged(labels, sets.confirmed(possible(star)))
    members = shared.select(F.col("t").alias("bucket"), "node", "n", "i")
    for round_ in range(HUB_ROUNDS + 1):
        apart = still_apart(members, labels)
        if apart.isEmpty():
            break
        members = apart.select("bucket", "node", "n", "i")
        if round_ < HUB_ROUNDS:
            first = F.min(F.struct(F.xxhash64("node", F.lit(round_)), "node", "n", "i")).alias("hub")
            others = apart.where("root = most").groupBy("bucket").agg(first)
            others = others.select("bucket", "hub.node", "hub.n", "hub.i", F.lit(None).cast("long").alias("root"))
        else:
            # Large buckets make no pairs, their texts are compared in blocks.
            large = apart.where(F.col("size") > PAIRED)
            if not large.isEmpty():
                labels = merged(labels, compared_rest(large, sets))
            apart = apart.where(F.col("size") <= PAIRED)
            others = apart.select("bucket", "node", "n", "i", "root")
        names = {"node": "other", "n": "m", "i": "j", "root": "s"}
        met = apart.where("root <> most").join(others.withColumnsRenamed(names), "bucket")
        met = met.where("s is null or root <> s").where(fits).where(enough)
        pairs = met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
        pairs = stored(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "near-pairs")
        tried = tried.union(pairs)
        if not pairs.isEmpty():
            labels = merged(labels, sets.confirmed(possible(pairs)))
    return rows.select("key", "print", "node"), labels


def drop_near_copies(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One document of each component of near copies, that with the smallest id; columns stay.

    Words are lower-cased in A-Z and cut at ASCII white space. Texts are linked if the sets of
    their shingles, ``width`` words each, have a Jaccard similarity of 0.8 or more; texts
    without words (or null) are copies of each other. A null id is later than any other. Of
    rows with the smallest id in a component one stays.
    """
    rows, labels = near_nodes(docs, width)
    named = rows.join(labels, "node", "left")
    heads = named.groupBy(F.coalesce("root", "node")).agg(F.min(F.struct("key", "print")).alias("f"))
    keyed = docs.select(
        doc_key().alias("key"), F.xxhash64(whole_text()).alias("print"), F.struct("*").alias("row")
    )
    kept = keyed.join(heads.select("f.key", "f.print"), ["key", "print"], "left_semi")
    return kept.dropDuplicates(["key", "print"]).select("row.*")
