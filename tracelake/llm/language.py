"""Language identification by compression (operator 7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    StringType,
    StructField,
    StructType,
)

UNKNOWN = "und"
#: Bytes of sample text behind each language; with the number of languages, the size of
#: what every task gets.
DICTIONARY_BYTES = 128 * 1024
#: Documents drawn for each language, about; the learned sample is bounded by these.
SAMPLED_DOCS = 400
#: Passages that a labelled text too long to be taken whole gives, where short ones leave room.
PASSAGES = 8
#: More languages than this are refused: their dictionaries go to every task.
MAX_LANGUAGES = 500
#: Bytes of a text that are compressed together: long texts would else be their own model.
_CHUNK = 2048
_LETTER = regex.compile(r"\p{L}")
_NO_LETTERS = regex.compile(r"\P{L}+")
_FOUND = StructType(
    [
        StructField("lang_pred", StringType()),
        StructField("score", DoubleType()),
        StructField("margin", DoubleType()),
        StructField("rejected", BooleanType()),
    ]
)


def dictionaries(labelled: DataFrame) -> dict[str, bytes]:
    """Language -> raw content: whole sample texts and passages, at most DICTIONARY_BYTES.

    ``labelled`` has doc_id, text and lang; rows with a null among them teach nothing. About
    SAMPLED_DOCS documents of each language are drawn by a hash of doc_id, whatever the size
    of the table. Texts of up to an eighth of a dictionary are filled in whole, in the order of
    another hash; where they leave room, longer ones follow by PASSAGES passages each, at even
    distances over the whole text. What does not fit is passed over, equal texts count once. A
    language whose drawn texts hold no letters has its name as content. More frequent languages
    come first.
    """
    rows = labelled.select("doc_id", "text", "lang").na.drop()
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    counts = {r["lang"]: r["count"] for r in sizes.limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    steps = [F.lit(x) for lang, n in counts.items() for x in (lang, max(1, n // SAMPLED_DOCS))]
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.create_map(*steps)[F.col("lang")]) == 0
    eighth = DICTIONARY_BYTES // 8
    is_long = F.octet_length("text") > eighth
    letters = eighth // PASSAGES // 4  # a letter has four bytes at most
    starts = [(F.length("text") * i / PASSAGES).cast("int") + 1 for i in range(PASSAGES)]
    passages = F.concat_ws(" ", *[F.substring("text", at, F.lit(letters)) for at in starts])
    taken = F.when(is_long, passages).otherwise(F.col("text")).alias("text")
    order = [is_long, F.xxhash64("doc_id", F.lit(8)), "text"]
    sample = rows.where(drawn).orderBy(*order).select("lang", taken).collect()
    texts: dict[str, dict[bytes, None]] = {lang: {} for lang in counts}
    room = dict.fromkeys(counts, DICTIONARY_BYTES)
    for lang, text in sample:
        plain = _plain(text)
        if plain.strip() and plain not in texts[lang] and len(plain) < room[lang]:
            texts[lang][plain] = None
            room[lang] -= len(plain) + 1
    return {lang: b"\n".join(own) or lang.encode() for lang, own in texts.items()}


def _plain(text: str) -> bytes:
    """Lower-case letters only, a space for all between them."""
    return _NO_LETTERS.sub(" ", text).lower().encode()


def _compressors(contents: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    # Short matches count: what tells languages apart are pieces of words.
    params = zstandard.ZstdCompressionParameters(
        window_log=18,
        hash_log=17,
        chain_log=17,
        search_log=4,
        min_match=4,
        target_length=32,
        strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    made = []
    for raw in contents.values():
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=params)
        made.append(zstandard.ZstdCompressor(compression_params=params, dict_data=known))
    return made


def identified(text: Column, contents: dict[str, bytes], min_margin: float = 0.02) -> Column:
    """Struct of lang_pred, score, margin and rejected for a text.

    The whole text, its letters in lower case, is compressed, chunk by chunk, with each
    language's dictionary; the smallest total wins, the more frequent language at a tie.
    margin is by how much the second is larger, in parts of the smallest; below
    ``min_margin`` the guess is marked rejected. A null text, one without a letter, or no
    learned language give ``und`` with score 0, rejected.
    """

    def guess(texts: pa.Array) -> pa.Array:
        names, compressors = list(contents), _compressors(contents)
        out = []
        for text in texts.to_pylist():
            if not names or text is None or not _LETTER.search(text):
                out.append((UNKNOWN, 0.0, 0.0, True))
                continue
            raw = _plain(text)
            chunks = [raw[i : i + _CHUNK] for i in range(0, len(raw), _CHUNK)]
            sizes = np.array([sum(len(c.compress(x)) for x in chunks) for c in compressors])
            best = int(sizes.argmin())
            over = np.delete(sizes, best) - sizes[best]
            margin = float(over.min() / sizes[best]) if len(over) else 1.0
            # A byte of difference counts as two bits: neighbouring matches are not independent.
            score = float(1 / (1 + np.exp2(-2.0 * over).sum()))
            out.append((names[best], score, margin, margin < min_margin))
        columns = list(zip(*out, strict=True)) or [()] * len(_FOUND)
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        return pa.StructArray.from_arrays(arrays, names=_FOUND.names)

    return F.arrow_udf(guess, _FOUND)(text)


def identify(docs: DataFrame, contents: dict[str, bytes], min_margin: float = 0.02) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected of every row of ``docs``, in no shuffle.

    See ``identified`` for null, empty and long texts and ties. Repeated rows stay, an empty
    table gives an empty one; columns besides doc_id and text are not read.
    """
    found = docs.select("doc_id", identified(F.col("text"), contents, min_margin).alias("found"))
    return found.select("doc_id", "found.*")
