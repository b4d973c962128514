"""Byte-level BPE, encoding and decoding (operator 1).

A text is cut at special tokens, then into pieces by the vocabulary's own pattern. For
every prefix of a piece there is exactly one token that can stand last: one that ends the
prefix and may follow the last token of the prefix before it. The tokens that end each
prefix come from an automaton over the vocabulary; whether two tokens may be neighbours is
a test on the merges next to their border. Following the stored tokens back gives the ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tracelake.llm.common import let_go

#: Entries of a worker's caches; a full cache is emptied.
CACHE = 150_000
#: Pieces longer than this many bytes are not cached.
CACHED_BYTES = 64
#: Characters whose class is the same in every Unicode version that the libraries in use
#: follow. A text with any other is cut by the tokenizer library's own splitter.
_SETTLED = regex.compile(
    r"[\u0000-\u0557\u0590-\u088e\u0890-\u0c5b\u0cdd-\u208e\u20a0-\ua7cd\uab6e-\U000107ba"
    r"\U0001f300-\U0001f64f]*"
)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Lookup:
    """Map of whole numbers that answers arrays of keys; -1 for those it doesn't have."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, (8 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] < 0)
            _, one = np.unique(slots[free], return_index=True)
            here = free[one]
            self.keys[slots[here]], self.values[slots[here]] = keys[here], values[here]
            rest = np.ones(len(keys), bool)
            rest[here] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        held = self.keys[slots]
        found = np.where(held == keys, self.values[slots], -1)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & self.mask
            held = self.keys[slots[rest]]
            hit = held == keys[rest]
            found[rest[hit]] = self.values[slots[rest[hit]]]
            rest = rest[~hit & (held >= 0)]
        return found


class Bpe:
    """One vocabulary; made once in each worker."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import public_tokenizers
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        letters = _byte_letters()
        raw = lambda token: bytes(map(letters.__getitem__, token))
        vocab: dict[str, int] = told["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.bytes_of = {i: raw(t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        #: By id: the merge that makes the token (-1: none) and its two parts.
        size = max(self.bytes_of) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(told["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, token = vocab[a], vocab[b], vocab[a + b]
            self.merged[left, right] = rank
            if self.rank[token] < 0:
                self.rank[token], self.left[token], self.right[token] = rank, left, right
        self.never = len(self.merged) + 1
        self.ranks, self.lefts, self.rights = (
            np.array(x, np.int32) for x in (self.rank, self.left, self.right)
        )
        pairs = np.array([a << 16 | b for a, b in self.merged], np.int64)
        self.merged_at = _Lookup(pairs, np.fromiter(self.merged.values(), np.int32))
        self.fits: dict[tuple[int, int], bool] = {}
        #: Pairs tested last, by a hash, and whether they fit.
        self.tested = np.full(1 << 20, -1, np.int64)
        self.fitted = np.zeros(1 << 20, bool)
        usable = {
            i: b
            for i, b in self.bytes_of.items()
            if (len(b) == 1 or self._makes_itself(i)) and i not in self.special.values()
        }
        self.ends = ahocorasick.Automaton()
        steps: dict[int, int] = {}
        ends_at = {}
        for i, b in usable.items():
            self.ends.add_word(b.decode("latin-1"), (i, len(b)))
            state = 0
            for byte in b:
                state = steps.setdefault(state << 8 | byte, len(steps) + 1)
            ends_at[state] = i
        self.ends.make_automaton()
        self.step = _Lookup(np.fromiter(steps, np.int64), np.fromiter(steps.values(), np.int32))
        self.token_at = np.full(len(steps) + 1, -1, np.int32)
        self.token_at[list(ends_at)] = list(ends_at.values())
        self.sizes = np.zeros(size, np.int64)
        self.sizes[list(usable)] = [len(b) for b in usable.values()]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        alternatives = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.at_special = regex.compile(f"({alternatives})") if alternatives else None
        #: Piece of text -> its ids as little-endian unsigned 32-bit integers.
        self.pieces: dict[str, bytes] = {}

    def _quiet_until(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge of rank under ``limit`` joins a's right side with b's left.

        Seen backwards in time: undoing the later of the two merges that made what touches
        the border gives what touched it before. A pair that touched while its own merge
        was due would have been joined. Equal ranks: the pair further left goes first.
        """
        until_a = until_b = limit
        while True:
            due = self.merged.get((a, b), self.never)
            # a's next merge lies to the left of the border and so wins a tie; b's does not.
            if due < until_a and due <= until_b and due < limit:
                return False
            if self.rank[a] < 0 and self.rank[b] < 0:
                return True
            if self.rank[a] >= self.rank[b]:
                until_a, a = self.rank[a], self.right[a]
            else:
                until_b, b = self.rank[b], self.left[b]

    def _makes_itself(self, token: int) -> bool:
        """Whether the token's bytes are encoded as the token, given that its parts' are."""
        return self.rank[token] >= 0 and self._quiet_until(
            self.left[token], self.right[token], self.rank[token]
        )

    def may_follow(self, a: int, b: int) -> bool:
        fits = self.fits.get((a, b))
        if fits is None:
            if len(self.fits) >= 4 * CACHE:
                self.fits.clear()
            fits = self.fits[a, b] = self._quiet_until(a, b, self.never)
        return fits

    def piece_ids(self, piece: bytes) -> list[int]:
        """Ids of a piece; time grows with its length, whatever it holds."""
        n = len(piece)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for end, (token, length) in self.ends.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                before = end - length
                if before == 0 or last[before] >= 0 and self.may_follow(last[before], token):
                    last[end], size[end] = token, length
        ids: list[int] = []
        while n:
            ids.append(last[n])
            n -= size[n]
        return ids[::-1]

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """may_follow() for arrays."""
        pair = a.astype(np.int64) << 16 | b
        slot = (pair * 0x9E3779B1 >> 8) & (len(self.tested) - 1)
        fits = self.fitted[slot]
        new = np.flatnonzero(self.tested[slot] != pair)
        if len(new):
            fits[new] = self._quiet(a[new], b[new])
            self.tested[slot[new]], self.fitted[slot[new]] = pair[new], fits[new]
        return fits

    def _quiet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_quiet_until() for arrays, without a limit."""
        fits, at = np.ones(len(a), bool), np.arange(len(a))
        until_a = np.full(len(a), self.never)
        until_b = until_a.copy()
        while len(at):
            due = self.merged_at(a.astype(np.int64) << 16 | b)
            due[due < 0] = self.never
            joined = (due < until_a) & (due <= until_b)
            fits[at[joined]] = False
            rank_a, rank_b = self.ranks[a], self.ranks[b]
            go = np.flatnonzero(~joined & ((rank_a >= 0) | (rank_b >= 0)))
            at, a, b, rank_a, rank_b = at[go], a[go], b[go], rank_a[go], rank_b[go]
            first = rank_a >= rank_b
            until_a = np.where(first, rank_a, until_a[go])
            until_b = np.where(first, until_b[go], rank_b)
            a, b = np.where(first, self.rights[a], a), np.where(first, b, self.lefts[b])
        return fits

    def batch_ids(self, pieces: list[bytes]) -> list[bytes]:
        """piece_ids() of many short pieces, a prefix of all of them at a time."""
        lens = np.array([len(p) for p in pieces], np.int64)
        offs = np.cumsum(lens) - lens
        buf = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        pos = np.arange(len(buf)) - np.repeat(offs, lens)
        room = np.repeat(lens, lens) - pos
        # All tokens from all places, a byte longer in each step.
        at, state = np.arange(len(buf)), np.zeros(len(buf), np.int64)
        starts, tokens, sizes, k = [], [], [], 0
        while len(at):
            state = self.step(state << 8 | buf[at + k]).astype(np.int64)
            k += 1
            known = np.flatnonzero(state >= 0)
            at, state = at[known], state[known]
            token = self.token_at[state]
            whole = np.flatnonzero(token >= 0)
            starts.append(at[whole])
            tokens.append(token[whole])
            sizes.append(np.full(len(whole), k))
            longer = np.flatnonzero(room[at] > k)
            at, state = at[longer], state[longer]
        start, token, size = map(np.concatenate, (starts, tokens, sizes))
        prefix = pos[start] + size
        order = np.argsort(prefix.astype(np.uint8), kind="stable")
        bounds = np.cumsum(np.bincount(prefix, minlength=CACHED_BYTES + 2))
        # The last token of every prefix, from the shortest on.
        last = np.full(len(buf) + 1, -1, np.int64)
        for n in range(1, len(bounds)):
            ending = order[bounds[n - 1] : bounds[n]]
            if not len(ending):
                continue
            s, t = start[ending], token[ending]
            right = pos[s] == 0
            ask = np.flatnonzero(~right)
            right[ask] = self._fit(last[s[ask] - 1], t[ask])
            last[s[right] + size[ending][right] - 1] = t[right]
        # Back from the ends.
        at, who = offs + lens, np.arange(len(pieces))
        found, whose = [], []
        while len(who):
            t = last[at - 1]
            found.append(t)
            whose.append(who)
            at = at - self.sizes[t]
            more = np.flatnonzero(at > offs[who])
            at, who = at[more], who[more]
        counts = np.bincount(np.concatenate(whose), minlength=len(pieces))
        begins = np.cumsum(counts) - counts
        ids = np.zeros(counts.sum(), "<u4")
        for step, (who, t) in enumerate(zip(whose, found, strict=True)):
            ids[begins[who] + counts[who] - 1 - step] = t
        raw = ids.tobytes()
        return [raw[4 * b : 4 * (b + n)] for b, n in zip(begins.tolist(), counts.tolist(), strict=True)]

    def _cut(self, text: str) -> list[str]:
        if _SETTLED.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def _parts(self, text: str) -> list[str]:
        """A text cut at special tokens, which stand at the odd places."""
        if self.at_special is None or not any(t in text for t in self.special):
            return [text]
        return self.at_special.split(text)

    def _join(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, pieces))

    def encode_all(self, texts: list[str], special: bool = True) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; ``special``: whether
        special tokens that are written out in a text become their ids."""
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        parts = [self._parts(text) if special else [text] for text in texts]
        cuts = [[self._cut(p) if i % 2 == 0 else p for i, p in enumerate(ps)] for ps in parts]
        new = set().union(*(c[i] for c in cuts for i in range(0, len(c), 2))) - self.pieces.keys()
        raw = {p: p.encode() for p in new}
        short = [p for p, b in raw.items() if len(b) <= CACHED_BYTES]
        if short:
            ids = self.batch_ids([raw[p] for p in short])
            self.pieces.update(zip(short, ids, strict=True))
        long = [p for p, b in raw.items() if len(b) > CACHED_BYTES]
        for p in long:
            self.pieces[p] = np.array(self.piece_ids(raw[p]), "<u4").tobytes()
        special = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        out = [b"".join(special[p] if i % 2 else self._join(p) for i, p in enumerate(c)) for c in cuts]
        for p in long:
            del self.pieces[p]
        return out

    def encode(
        self, texts: Iterable[str], special: bool = True, most: int = 1 << 21
    ) -> Iterator[bytes]:
        """encode_all() in parts of about ``most`` characters."""
        some: list[str] = []
        n = 0
        for text in texts:
            some.append(text)
            n += len(text)
            if n >= most:
                yield from self.encode_all(some, special)
                some, n = [], 0
        if some:
            yield from self.encode_all(some, special)

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        try:
            raw = b"".join(map(self.table.__getitem__, ids))
        except IndexError:
            raw = b"".join(self.table[i] for i in ids if i < len(self.table))
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str | None) -> Bpe:
    return Bpe(path or default_path())


def forget() -> None:
    """Drop the vocabulary and its caches at the end of a task: a worker lives on."""
    bpe.cache_clear()
    let_go()


def encoded(text: Column, path: str | None = None) -> Column:
    """array<int> of the ids of a text; a null text is an empty one."""

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = bpe(path)
        for texts in batches:
            found = list(codec.encode(t.as_py() or "" for t in texts))
            ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
            flat = pa.array(np.frombuffer(b"".join(found), "<i4"))
            del found
            yield pa.ListArray.from_arrays(pa.array(ends), flat)
        del codec
        forget()

    return F.arrow_udf(ids, ArrayType(IntegerType()))(text)


def _lists(ids: pa.Array) -> Iterator[np.ndarray]:
    for one in ids:
        yield one.values.to_numpy(zero_copy_only=False) if one.is_valid else np.empty(0, np.int32)


def decoded(ids: Column, path: str | None = None) -> Column:
    """Text of an array of ids; null is an empty array."""

    def texts(arrays: pa.Array) -> pa.Array:
        codec = bpe(path)
        return pa.array([codec.decode(x.tolist()) for x in _lists(arrays)], pa.string())

    return F.arrow_udf(texts, "string")(ids)


def encoded_and_decoded(text: Column, path: str | None = None) -> Column:
    """Struct of ids (little-endian unsigned 32-bit integers) and of the text decoded from them."""

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = bpe(path)
        for texts in batches:
            ids, back = [], []
            for raw in codec.encode(t.as_py() or "" for t in texts):
                ids.append(raw)
                back.append(codec.decode(np.frombuffer(raw, "<u4").tolist()))
            arrays = [pa.array(ids, pa.binary()), pa.array(back, pa.string())]
            del ids, back
            yield pa.StructArray.from_arrays(arrays, ["ids", "back"])
        del codec
        forget()

    return F.arrow_udf(both, "ids binary, back string")(text)


def with_token_ids(docs: DataFrame, path: str | None = None, to: str = "token_ids") -> DataFrame:
    """Every document with its ids.

    One row for each row, in no shuffle. Null and empty texts have no ids, special tokens
    written out in a text become their ids, equal rows equal results. Other columns stay; a
    column with the name ``to`` is replaced.
    """
    return docs.withColumn(to, encoded(F.col("text"), path))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, digest of the ids, digest of the text decoded from the ids.

    One row for each row, a null text as an empty one; an empty table gives an empty one, columns
    besides doc_id and text are not read.
    """
    both = docs.select("doc_id", encoded_and_decoded(F.col("text"), path).alias("both"))
    return both.select(
        "doc_id",
        F.expr("octet_length(both.ids) div 4").alias("n_tokens"),
        F.sha2("both.ids", 256).alias("ids_sha256"),
        F.sha2("both.back", 256).alias("decoded_sha256"),
    )
