"""Tables whose writes are published whole, once for each run.

A run writes its rows to a folder of its own and then publishes it by renaming one small file
into place, which the file system does at once or not at all. Readers take the folders that
are published. A run that is repeated, because it was killed or because nobody knows whether it
ended, publishes again under the same name, and its earlier folder is read no more.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.sources.layout import BENCHMARK
from tracelake.specs import COLLECTION

_RUN, _ATTEMPT, _MANIFEST = "run", "attempt", "_manifest"


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Put a small file in place of what may be there, in one step."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    target = fs.Path(path)
    draft = fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    conf = spark._jsc.hadoopConfiguration()
    system = target.getFileSystem(conf)
    system.mkdirs(target.getParent())
    out = system.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    rename = getattr(fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    where = system.makeQualified(target)
    fs.FileContext.getFileContext(where.toUri(), conf).rename(
        system.makeQualified(draft), where, how
    )


def commit_table(
    df: DataFrame,
    base: str,
    table: str,
    run_id: str,
    *,
    partitions: Sequence[str] = (BENCHMARK, COLLECTION),
) -> str:
    """Write the rows of one run and publish them; returns their folder.

    Until the last step readers see what they saw before. Of several attempts under one
    ``run_id`` (letters, digits, ``.``, ``_``, ``-``) the one published last counts. Rows are
    rebalanced by the columns that split them, where df has such.
    """
    if not re.fullmatch(r"[\w.-]+", run_id):
        raise ValueError(f"not a run id: {run_id!r}")
    spark = df.sparkSession
    folder = f"{_RUN}={run_id}/{_ATTEMPT}={uuid.uuid4().hex}"
    keys = [c for c in partitions if c in df.columns]
    rows = df.hint("rebalance", *[F.col(k) for k in keys]) if keys else df
    writer = rows.write.partitionBy(*keys) if keys else rows.write
    writer.parquet(f"{base}/{table}/{folder}")
    entry = {"run": run_id, "folder": folder, "schema": df.schema.json(), "keys": keys}
    _replace(spark, f"{base}/{table}/{_MANIFEST}/{run_id}.json", json.dumps(entry))
    return f"{base}/{table}/{folder}"


def published(spark: SparkSession, base: str, table: str) -> DataFrame:
    """run, folder, schema, keys of the runs of a table; none if there is no such table."""
    shape = "run string, folder string, schema string, keys array<string>"
    manifest = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{table}/{_MANIFEST}")
    if not manifest.getFileSystem(spark._jsc.hadoopConfiguration()).exists(manifest):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).json(f"{base}/{table}/{_MANIFEST}/*.json")


def read_committed(
    spark: SparkSession, base: str, table: str, schema: T.StructType | None = None
) -> DataFrame:
    """The rows of all published runs; the columns of ``schema``, else those of the last run by
    name. Without any run the table is empty, and ``schema`` must be given."""
    runs = sorted((r["run"], r["folder"], r["schema"]) for r in published(spark, base, table).collect())
    if schema is None:
        if not runs:
            raise FileNotFoundError(f"nothing is published of {base}/{table}")
        schema = T.StructType.fromJson(json.loads(runs[-1][2]))
    if not runs:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", f"{base}/{table}")
    return reader.parquet(*(f"{base}/{table}/{folder}" for _, folder, _ in runs)).select(schema.names)
