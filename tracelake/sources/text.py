"""Log files as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.sources.scratch import shared_table

#: A file of up to this many bytes is read and numbered as one row.
WHOLE_BYTES = 32 << 20


def read_log_lines(
    spark: SparkSession, path: str, *, glob: str | None = None, whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """Lines of all log files below ``path``: path, line_no (from 0), line, relative_path.

    relative_path is the file's place below ``path`` (its name, if ``path`` is the file).
    Files of up to ``whole_bytes`` are read whole and need no shuffle to be numbered. Larger
    ones are read in splits by many tasks (see ``numbered_splits``). An empty file is one
    empty line, if it is read whole.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    size = F.col("_metadata.file_size")
    whole = reader.text(path, wholetext=True).where(size <= whole_bytes)
    whole = whole.select(F.col("_metadata.file_path").alias("path"), "value")
    body = F.regexp_replace("value", r"(\r\n|\n|\r)\z", "")
    lines = whole.select("path", F.posexplode(F.split(body, r"\r?\n")).alias("line_no", "line"))
    lines = lines.withColumn("line_no", F.col("line_no").cast("long"))
    large = reader.text(path, lineSep="\n").where(size > whole_bytes)
    if not large.isEmpty():
        lines = lines.unionByName(numbered_splits(large))
    below = F.regexp_replace("path", "^[^:/]+:/+", "/")
    root = _root(spark, path)
    inside = F.substring(below, F.lit(len(root) + 2), F.length(below))
    relative = F.when(below.startswith(root + "/"), inside).otherwise(F.element_at(F.split(below, "/"), -1))
    return lines.select("path", "line_no", "line", relative.alias("relative_path"))


def numbered_splits(text: DataFrame) -> DataFrame:
    """Lines of a scan of text files with their number in the file: path, line_no, line.

    Each line is written with the split that it was read in and its place there, once, so that
    the numbers do not depend on how another scan would cut the files. A line's number is
    then its place after the first of its split, and the lines of the splits before, which a
    window adds up over one row for each split. No task holds a file.
    """
    placed = text.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("__split"),
        F.monotonically_increasing_id().alias("__place"),
        F.regexp_replace("value", r"\r\z", "").alias("line"),
    )
    kept = shared_table(placed, "log-lines")
    splits = kept.groupBy("path", "__split").agg(
        F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__lines")
    )
    earlier = Window.partitionBy("path").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        "path",
        "__split",
        (F.coalesce(F.sum("__lines").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    number = F.col("__place") + F.col("__shift")
    return kept.join(starts, ["path", "__split"]).select("path", number.alias("line_no"), "line")


def read_result_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the result files (``*results.txt``) below a results folder."""
    return read_log_lines(spark, path, glob="*results.txt")


def _root(spark: SparkSession, path: str) -> str:
    """The folder as it begins a file's path, without its scheme, as Spark writes it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop)
    text = full.toUri().toString()
    _, scheme, rest = text.partition(":")
    return ("/" + rest.lstrip("/") if scheme else text).rstrip("/")
