"""Token counts of documents in flat token files (operator 8).

A token file is 16-bit token ids one after the other, the end-of-document id after each
document; there is no index. Where files are written from a table, each document has one
before it that spells its id in NAME tokens, so that a file says by itself whose texts it
holds, however it was written or is read. Blocks of a file are searched for that id apart from each
other, and a running maximum and sum over blocks give each the place of the separator
before it and the number of documents before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.bpe import bpe, forget
from tracelake.llm.common import doc_key, let_go, own_id, whole_text
from tracelake.sources.scratch import scratch_dir

#: End-of-document id of the 50k vocabulary, and the type of the ids in a file.
END_ID = 50256
_ID = np.dtype("<u2")
#: Tokens that spell an id of 64 bits, to the base of the end id, least digit first.
NAME = 5
#: Documents of a file at most, by the longest text (in bytes) that such files take. A text has
#: a token for each of its bytes at most, so these files have 132 MB at most, except those of
#: texts that are longer than the last bound, one each. A file is read by one task.
DOCS_PER_FILE = {16_384: 4_000, 1_048_576: 60, None: 1}
#: Tokens of a block.
BLOCK = 1 << 20


def _spelled(key: int) -> list[int]:
    digits, rest = [], key % 2**64
    for _ in range(NAME):
        rest, digit = divmod(rest, END_ID)
        digits.append(digit)
    return digits


def _raw_ids(text: Column, key: Column, path: str | None) -> Column:
    """The document that spells the key, an end id, and the ids of a text, as in a file.

    Special tokens written out in a text are plain text.
    """

    def ids(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        codec = bpe(path)
        for texts, keys in batches:
            found = codec.encode((t.as_py() or "" for t in texts), special=False)
            names = (np.array([*_spelled(k.as_py()), END_ID], _ID).tobytes() for k in keys)
            rows = [n + np.frombuffer(x, "<u4").astype(_ID).tobytes() for n, x in zip(names, found, strict=True)]
            yield pa.array(rows, pa.binary())
        del codec
        forget()

    return F.arrow_udf(ids, "binary")(text, key)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Token files of a table's texts and ids, some series of files for each partition.

    Spark's text writer puts the separator after each row: the id's two bytes as characters.
    A null or empty text is a document without tokens; a null id is the largest long.
    """
    end = np.array([END_ID], _ID).tobytes().decode("latin-1")
    rows = docs.select(doc_key().alias("key"), whole_text().alias("text"))
    size, least = F.octet_length("text"), -1
    for most, many in DOCS_PER_FILE.items():
        part = rows.where(size > least) if most is None else rows.where((size > least) & (size <= most))
        values = part.select(_raw_ids(F.col("text"), F.col("key"), path).cast("string").alias("value"))
        options = {"lineSep": end, "encoding": "ISO-8859-1", "maxRecordsPerFile": many}
        values.write.mode("append").options(**options).text(folder)
        least = most


def _separators(block_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each block of a file the places of the end id, from the file's start, and what the
    NAME tokens before each spell."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch["file"], batch["content"], strict=True):
                ids = np.frombuffer(raw.as_buffer(), _ID, len(raw.as_buffer()) // _ID.itemsize)
                for block in range(-(-len(ids) // block_tokens)):
                    begin = block * block_tokens
                    at = np.flatnonzero(ids[begin : begin + block_tokens] == END_ID) + begin
                    spelled = np.zeros(len(at), np.uint64)
                    for i in range(1, NAME + 1):
                        spelled = spelled * np.uint64(END_ID) + ids[np.maximum(at - i, 0)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file.as_py()], pa.string()),
                            pa.array([block], pa.int64()),
                            pa.array([len(ids)], pa.int64()),
                            pa.array([at], pa.list_(pa.int64())),
                            pa.array([spelled.view(np.int64)], pa.list_(pa.int64())),
                        ],
                        ["file", "block", "tokens", "at", "spelled"],
                    )
        let_go()

    return search


def scan_token_files(spark: SparkSession, folder: str, block_tokens: int = BLOCK) -> DataFrame:
    """file, document (from 0), first_token, n_tokens, closed of each document of the files, and
    name: what the last NAME tokens of the document before it spell.

    The end id belongs to no document. Tokens after a file's last end id are a document that
    is not closed; a file without any token has none, nor has a last odd byte a meaning. A
    file may have 2 GB, what one row holds.
    """
    files = spark.read.format("binaryFile").load(folder).where("length >= 2")
    found = files.select(F.col("path").alias("file"), "content").mapInArrow(
        _separators(block_tokens), "file string, block long, tokens long, at array<long>, spelled array<long>"
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns(
        {
            "before": F.coalesce(F.max(F.array_max("at")).over(earlier), F.lit(-1)),
            "name_before": F.last(F.expr("try_element_at(spelled, -1)"), ignorenulls=True).over(earlier),
            "number": F.coalesce(F.sum(F.size("at")).over(earlier), F.lit(0)),
            "final": F.expr(f"block = (tokens - 1) div {block_tokens}"),
        }
    )
    # The end of the file closes what is open there.
    ends = F.expr("if(final and coalesce(array_max(at), before) < tokens - 1, concat(at, array(tokens)), at)")
    found = found.withColumn("ends", ends)
    each = found.select("*", F.posexplode("ends").alias("i", "end"))
    first = F.expr("if(i = 0, before, ends[i - 1]) + 1")
    return each.select(
        "file",
        (F.col("number") + F.col("i")).alias("document"),
        first.alias("first_token"),
        (F.col("end") - first).alias("n_tokens"),
        (F.col("end") < F.col("tokens")).alias("closed"),
        F.expr("if(i = 0, name_before, spelled[i - 1])").alias("name"),
    )


def token_counts(
    docs: DataFrame, path: str | None = None, block_tokens: int = BLOCK
) -> DataFrame:
    """doc_id, file, document, first_token, n_tokens of every row of ``docs``.

    The texts are written to token files in the shared folder, which are then scanned; each is
    named by the document before it. A null or empty text has no tokens, a null id stays null;
    repeated rows stay, each with its own place. An empty table gives an empty one; columns
    besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    folder = scratch_dir(spark, "tokens")
    write_token_files(docs, folder, path)
    found = scan_token_files(spark, folder, block_tokens).where("document % 2 = 1")
    return found.select(
        own_id(F.col("name")).alias("doc_id"),
        F.element_at(F.split("file", "/"), -1).alias("file"),
        F.expr("document div 2").alias("document"),
        "first_token",
        "n_tokens",
    )
