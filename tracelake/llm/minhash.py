"""Near-duplicates by one-permutation MinHash (operator 13).

One hash of each shingle fills all bins of a signature; empty bins are filled by optimal
densification. Signatures are cut into bands, documents with an equal band share a bucket,
and the members of a bucket are held against one of them, its hub, instead of each other.
Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import doc_key, let_go, own_id, stored, whole_text
from tracelake.llm.components import components

WIDTH = 2
#: Similarity of a link in percent.
REACHED = 80
#: A signature has BANDS bands of ROWS bins. At a similarity of 0.8 a pair shares none of them
#: with a probability of (1 - 0.8 ** ROWS) ** BANDS, 1.3e-7.
BANDS, ROWS = 40, 5
SEED = 13
#: Rounds in which each bucket that is still apart has one more hub, before its rest is compared.
HUB_ROUNDS = 2
#: Shingles of a block of hubs, and of a block of members, of a rest that is compared at once.
HUB_BLOCK, MEMBER_BLOCK = 250_000, 250_000
#: Sets whose documents' names are sent to every task at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Words whose hashes a task remembers.
_KNOWN = 500_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, SEED)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits, each of which depends on each bit of x (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int, known: _WordHashes) -> np.ndarray:
    """Sorted different hashes of a text's shingles; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), SEED + 1)], np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    folded = h[:n]
    for i in range(1, width):
        folded = _mixed(folded + np.uint64(i)) ^ h[i : i + n]
    return np.unique(_mixed(folded))


class Signer:
    """Signatures of ``bands`` * ``rows`` bins, and the hashes of their bands."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS) -> None:
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(SEED)
        # The order in which an empty bin looks for one to copy: its own, so that bins with the
        # same emptiness around them do not copy the same one (optimal densification).
        self.order = np.argsort(rng.random((self.bins, self.bins)), axis=1).astype(np.int32)
        self.odd = rng.integers(0, 2**63, (bands, rows), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """The least hash in each bin of the range of hashes, which are sorted and not empty."""
        at = ((hashes >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        full, first = np.unique(at, return_index=True)
        least = np.zeros(self.bins, np.uint64)
        filled = np.zeros(self.bins, bool)
        least[full], filled[full] = hashes[first], True
        empty = np.flatnonzero(~filled)
        if len(empty):
            order = self.order[empty]
            found = np.argmax(filled[order], axis=1)
            least[empty] = least[order[np.arange(len(empty)), found]]
        return least

    def band_hashes(self, signature: np.ndarray) -> np.ndarray:
        parts = _mixed(signature.reshape(self.bands, self.rows)) * self.odd
        return _mixed(parts.sum(axis=1, dtype=np.uint64)).view(np.int64)


def _signed(width: int):
    """key, print, node (the digest of the set, null if it is empty), n (its size), bands."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, signer = _WordHashes(), Signer()
        for batch in batches:
            nodes, sizes, bands = [], [], []
            for text in batch["text"]:
                own = shingle_set(text.as_py(), width, known)
                sizes.append(len(own))
                nodes.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                bands.append(signer.band_hashes(signer.signature(own)) if len(own) else None)
            arrays = [
                batch["key"],
                batch["print"],
                pa.array(nodes, pa.binary()),
                pa.array(sizes, pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "print", "node", "n", "bands"])
        let_go()

    return signed


def _sets(text: Column, width: int) -> Column:
    """The sorted hashes of a text's shingles, 8 bytes each."""

    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _WordHashes()
        for texts in batches:
            found = [shingle_set(t.as_py(), width, known).tobytes() for t in texts]
            yield pa.array(found, pa.binary())
        let_go()

    return F.arrow_udf(sets, "binary")(text)


def _alike(a: Column, b: Column) -> Column:
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        found = []
        for x, y in zip(left, right, strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            found.append(100 * common >= REACHED * (len(x) + len(y) - common))
        return pa.array(found, pa.bool_())

    return F.arrow_udf(alike, "boolean")(a, b)


#: Sets of n and m shingles can reach the similarity.
_FITS = f"100 * least(n, m) >= {REACHED} * greatest(n, m)"


def _links_of_block(batch: pa.Table) -> pa.Table:
    """a, b: links between the hubs and the members of a block that have different roots."""
    hub = batch["hub"].to_numpy(zero_copy_only=False)
    hubs, members = (batch.filter(pa.array(x)) for x in (hub, ~hub))
    own, other = (x["root"].to_pylist() for x in (hubs, members))
    of = {root: i for i, root in enumerate({*own, *other})}
    root = np.array([of[x] for x in other], np.int64)
    sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in members["s"]]
    sizes = np.array([len(x) for x in sets], np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(sets) and len(own):
        known, at = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        marks = np.zeros(len(known), np.int64)
        for i, v in enumerate(hubs["s"]):
            asked = np.frombuffer(v.as_buffer(), np.uint64)
            place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            place = place[known[place] == asked]
            marks[place] = 1
            common = np.add.reduceat(marks[at], starts)
            marks[place] = 0
            alike = 100 * common >= REACHED * (len(asked) + sizes - common)
            j = np.flatnonzero(alike & (root != of[own[i]]))
            found.append((np.full(len(j), i), j))
    let_go()
    i, j = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found) if found else ((), ())))
    return pa.Table.from_arrays(
        [hubs["node"].take(pa.array(i)), members["node"].take(pa.array(j))], ["a", "b"]
    )


class FullSets:
    """Full sets of the nodes that some pair needs, each made once.

    ``texts`` has key, print and text, ``names`` a key and print for each node; ``make`` gives a
    text's different hashes, 8 bytes each.
    """

    def __init__(self, texts: DataFrame, names: DataFrame, make: Callable[[Column], Column]) -> None:
        self.texts, self.names, self.make = texts, names, make
        self.made: list[DataFrame] = []

    def of(self, need: DataFrame) -> DataFrame:
        """(node, s) of the nodes in ``need``, and of others."""
        if self.made:
            made = reduce(DataFrame.union, [x.select("node") for x in self.made])
            need = need.join(made, "node", "left_anti")
        need = stored(need.join(self.names, "node"), "minhash-names")
        few = need.count() <= BROADCAST_ROWS
        held = self.texts.join(F.broadcast(need) if few else need, ["print", "key"])
        held = held.dropDuplicates(["node"]).select("node", self.make(F.col("text")).alias("s"))
        self.made.append(stored(held, "minhash-sets"))
        return reduce(DataFrame.union, self.made)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of the stored pairs (a, b) whose full sets reach the similarity."""
        every = self.of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        left, right = (every.select(F.col("node").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
        # The side that stands in many pairs comes last: its join is of stored rows, and split.
        both = pairs.join(right, "b").join(left, "a")
        return stored(both.where(_alike(F.col("sa"), F.col("sb"))).select("a", "b"), "minhash-links")


def still_apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that have several roots, with their roots, the bucket's most
    frequent one, and its members."""
    named = members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named, "minhash-named")
    often = named.groupBy("bucket", "root").count()
    often = often.groupBy("bucket").agg(
        F.max(F.struct("count", "root")).alias("most"),
        F.count("*").alias("roots"),
        F.sum("count").alias("size"),
    )
    often = often.where("roots > 1").select("bucket", F.col("most.root").alias("most"), "size")
    return stored(named.join(stored(often, "minhash-most"), "bucket"), "minhash-apart")


def compared_rest(apart: DataFrame, sets: FullSets) -> DataFrame:
    """Links of all pairs of a bucket with different roots.

    Members without the bucket's most frequent root are hubs; those of all buckets that have the
    root in common meet the members of these buckets at once.
    """
    hubs = stored(apart.where("root <> most").select("bucket", "most", "node", "n", "root"), "minhash-hubs")
    members = apart.select("bucket", "node", "n", "root").join(hubs.select("bucket", "most").distinct(), "bucket")
    return compared(hubs, members, sets)


def compared(hubs: DataFrame, members: DataFrame, sets: FullSets) -> DataFrame:
    """Links between hubs and members (most, node, n, root) with one ``most`` and two roots.

    They are compared in blocks of a fixed size, so that a set is sent once for each block
    that it meets instead of once for each pair. Blocks go in portions, one after the other: a
    portion sends about as much as all the sets once, and frees that before the next.
    """
    sides = []
    for side, size, hub in ((hubs, HUB_BLOCK, True), (members, MEMBER_BLOCK, False)):
        rows = stored(side.select("most", "node", "n", "root").distinct(), "minhash-side")
        blocks = rows.groupBy("most").agg(F.ceil(F.sum("n") / size).cast("int").alias("blocks"))
        sides.append((rows, stored(blocks, "minhash-blocks"), hub))
    tasks = None
    for (rows, own, hub), (_, others, _) in zip(sides, sides[::-1], strict=True):
        # Each block of hubs meets each block of members.
        dealt = rows.join(own, "most").withColumn("own", F.expr("pmod(xxhash64(node), blocks)")).drop("blocks")
        dealt = dealt.join(others, "most").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        at = ("own", "other") if hub else ("other", "own")
        part = dealt.select(
            "most",
            *(F.col(c).cast("long").alias(x) for c, x in zip(at, ("i", "j"), strict=True)),
            "node",
            "root",
            F.lit(hub).alias("hub"),
            "n",
        )
        tasks = part if tasks is None else tasks.union(part)
    tasks = stored(tasks, "minhash-tasks")
    each = tasks.groupBy("node").agg(F.max("n").alias("n"), F.count("*").alias("times"))
    sent = each.agg(F.ceil(F.sum(F.col("n") * F.col("times")) / F.sum("n")), F.sum("times")).first()
    portions = max(int(sent[0] or 0), 1)
    few = (sent[1] or 0) <= BROADCAST_ROWS * portions
    every = sets.of(tasks.select("node").distinct())
    kind = hubs.schema["node"].dataType.simpleString()
    links = []
    for portion in range(portions):
        now = tasks.where(F.pmod(F.xxhash64("most", "i", "j"), F.lit(portions)) == portion).drop("n")
        now = every.join(F.broadcast(now) if few else now, "node")
        found = now.groupBy("most", "i", "j").applyInArrow(_links_of_block, f"a {kind}, b {kind}")
        links.append(stored(found, "minhash-links"))
    return reduce(DataFrame.union, links)


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after more links: those link what the nodes at their ends stand for."""
    if labels is None:
        return stored(components(links), "minhash-roots")
    if links.isEmpty():
        return labels
    for side in "ab":
        own = labels.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
        links = links.join(own, side, "left").withColumn(side, F.coalesce(f"root_{side}", side))
    new = stored(components(links.select("a", "b")), "minhash-merged")
    onto = new.select(F.col("node").alias("root"), F.col("root").alias("onto"))
    moved = labels.join(onto, "root", "left").select("node", F.coalesce("onto", "root").alias("root"))
    added = new.join(labels, "node", "left_anti").select("node", "root")
    return stored(moved.union(added), "minhash-roots")


def linked_nodes(members: DataFrame, hubs: DataFrame, sets: FullSets) -> DataFrame:
    """(node, root) of linked nodes: all that share a bucket and reach the similarity have one.

    ``members`` (bucket, node, n) has all nodes of all buckets that hold several, ``hubs``
    (bucket, hub) the least (node, n) of each.

    * Each node is first held against the least hub of its buckets,
    * a bucket whose members still have several roots gets a hub from its most frequent root,
      which meets those that have another, HUB_ROUNDS times,
    * what is still apart is compared with all members of its bucket (``compared_rest``).

    Near copies make one pair or a few each; the last step makes none as rows.
    """
    star = members.join(hubs, "bucket").groupBy("node", "n").agg(F.min("hub").alias("hub"))
    star = star.where("node > hub.node").withColumn("m", F.col("hub.n")).where(_FITS)
    tried = stored(star.select(F.col("hub.node").alias("a"), F.col("node").alias("b")), "minhash-pairs")
    labels = merged(None, sets.confirmed(tried))
    for round_ in range(HUB_ROUNDS):
        apart = still_apart(members, labels)
        if apart.isEmpty():
            return labels
        first = F.min(F.struct(F.xxhash64("node", F.lit(round_)), "node", "n")).alias("hub")
        hubs = stored(apart.where("root = most").groupBy("bucket").agg(first), "minhash-hubs")
        pairs = apart.where("root <> most").join(hubs, "bucket").withColumn("m", F.col("hub.n")).where(_FITS)
        pairs = pairs.select(F.greatest("node", "hub.node").alias("b"), F.least("node", "hub.node").alias("a"))
        pairs = stored(pairs.distinct().join(tried, ["a", "b"], "left_anti").select("a", "b"), "minhash-pairs")
        tried = tried.union(pairs)
        if not pairs.isEmpty():
            labels = merged(labels, sets.confirmed(pairs))
        members = apart.select("bucket", "node", "n")
    apart = still_apart(members, labels)
    return labels if apart.isEmpty() else merged(labels, compared_rest(apart, sets))


def minhash_nodes(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Rows (key, print, node, n) of all documents, and (node, root) of all linked nodes.

    A node is a set of shingles, which copies share, so that copies make no pairs.
    """
    texts = docs.select(
        doc_key().alias("key"), F.xxhash64(whole_text()).alias("print"), whole_text().alias("text")
    )
    kinds = "key long, print long, node binary, n long, bands array<long>"
    rows = stored(texts.mapInArrow(_signed(width), kinds), "minhash-rows")
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min(F.struct("key", "print")).alias("f"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    nodes = stored(nodes.select("node", "f.key", "f.print", "n", "bands"), "minhash-nodes")
    sets = FullSets(texts, nodes.select("node", "key", "print"), lambda text: _sets(text, width))
    members = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    hubs = members.groupBy("bucket").agg(
        F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("last")
    )
    hubs = stored(hubs.where("hub.node < last").select("bucket", "hub"), "minhash-hubs")
    members = stored(members.join(hubs.select("bucket"), "bucket"), "minhash-buckets")
    return rows.select("key", "print", "node", "n"), linked_nodes(members, hubs, sets)


def minhash_components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``.

    Words are lower-cased in A-Z and cut at ASCII white space; a document's set holds its
    different shingles of ``width`` words, the whole sequence if it has fewer. Documents are
    linked if the intersection has REACHED percent of the union or more; component_id is the
    smallest doc_id reachable, itself included, and kept says whether it is the own one.

    Pairs that share no bucket are not seen, at most 1.3e-7 of those that reach the similarity
    (BANDS, ROWS); shingles are compared by 64-bit hashes, whole sets by 128-bit ones.

    A null or empty text, or one of white space, has an empty set, is linked with nothing and
    kept. Very long texts are one set in one task. Repeated rows stay repeated and get equal
    results. A null doc_id sorts after all others: it is a component's id (null) only if the
    component has no other, and then its rows are kept. An empty table gives an empty one;
    columns besides doc_id and text are not read.
    """
    rows, labels = minhash_nodes(docs, width)
    names = rows.where("node is not null").groupBy("node").agg(F.min("key").alias("first"))
    named = names.join(labels, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = stored(named, "minhash-named")
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    heads = stored(named.join(heads, "root").select("node", "head"), "minhash-heads")
    found = rows.join(heads, "node", "left").withColumn("head", F.coalesce("head", "key"))
    return found.select(
        own_id(F.col("key")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        own_id(F.col("head")).alias("component_id"),
        (F.col("key") == F.col("head")).alias("kept"),
    )
