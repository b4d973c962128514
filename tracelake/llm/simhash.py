"""Near-duplicates by SimHash fingerprints and multi-index hashing (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import cut, doc_key, let_go, own_id
from tracelake.llm.components import components

SEED = 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles whose bits are unpacked together; bounds the memory for a long text.
_BLOCK = 65_536


def of_hashes(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 if there are none."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(h), _BLOCK):
        bits = np.unpackbits(h[at : at + _BLOCK].view(np.uint8), bitorder="little").reshape(-1, 64)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * set_bits > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint(text: bytes, width: int) -> int:
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, SEED)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    begins = [0, *(gaps[: len(words) - width] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(line)]
    digest, set_bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(begins), _BLOCK):
        pairs = zip(begins[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)
        h = np.fromiter((digest(line[b:e], SEED) for b, e in pairs), np.uint64)
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * set_bits > len(begins)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    """64-bit SimHash of a text as a long, bit i as bit i.

    Words are lower-cased in A-Z and cut at ASCII white space. Shingles are ``width`` words,
    repeats included, joined by a space and hashed with XXH64; a text of fewer words is one
    shingle, a text without words (or null) has fingerprint 0. A bit is set if it is set in
    over half of the hashes.
    """

    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [_fingerprint((t.as_py() or "").encode(), width) for t in texts]
            yield pa.array(np.array(found, np.uint64).view(np.int64))
        let_go()

    return F.arrow_udf(prints, "long")(text)


def close_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect all fingerprints within 2 bits of each other.

    ``prints`` has distinct longs in a column fp. Each fingerprint has two segments of 32
    bits; around it stand the balls of radius 1 in either segment, 65 values with itself.
    Two fingerprints differ in at most two bits exactly if their balls share a value:
    whether the bits lie in one segment or one in each, the first with one of the bits
    turned is the second with the other turned. So matches are fetched by equality on
    whole values, under any of which at most 65 fingerprints can meet, however many lie
    close together. Those that meet are chained instead of paired with each other, and the
    complete distance of each link is verified.
    """
    flips = [F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64))]
    balls = prints.select("fp", F.explode(F.array(*flips)).alias("flip"))
    meet = balls.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    before = F.lag("fp").over(Window.partitionBy("at").orderBy("fp"))
    links = meet.select(F.col("fp").alias("a"), before.alias("b")).where("b is not null")
    return links.where("bit_count(a ^ b) <= 2").distinct()


def simhash_components(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (long), component_id of every row of ``docs``.

    component_id is the smallest doc_id reached over links of 2 or fewer differing bits.
    Repeated rows stay repeated; a null id sorts after all others and is a component's id
    only if it has no other; an empty table gives an empty one. Documents with equal
    fingerprints are one node, so copies are never paired.
    """
    prints = cut(
        docs.select(doc_key().alias("key"), fingerprint(F.col("text"), width).alias("fp"))
    )
    nodes = prints.groupBy("fp").agg(F.min("key").alias("first"))
    root = components(close_pairs(nodes.select("fp")))
    named = nodes.join(root, nodes.fp == root.node, "left").select(
        nodes.fp, "first", F.coalesce("root", "fp").alias("root")
    )
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    ids = named.join(heads, "root").select("fp", "head")
    return prints.join(ids, "fp").select(
        own_id(F.col("key")).alias("doc_id"), "fp", own_id(F.col("head")).alias("component_id")
    )


def drop_near_copies(docs: DataFrame, width: int = 5) -> DataFrame:
    """The pipeline's stage under its old name; see ``near.drop_near_copies``."""
    from tracelake.llm import near

    return near.drop_near_copies(docs, width)
