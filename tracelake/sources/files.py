"""Parquet file sets: listing, schema widening, file-name parts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.sources.scratch import scratch_dir


def subfolders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders directly inside ``folder``, on any file system Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    entries = fs.listStatus(path)
    return sorted(
        e.getPath().getName()
        for e in entries
        if e.isDirectory() and not e.getPath().getName().startswith(("_", "."))
    )


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a glob pattern, on any file system Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [e.getPath().toString() for e in fs.globStatus(path) or ()]


def glob_text(text: str) -> str:
    """Text that stands for itself in a glob pattern."""
    return re.sub(r"([\\*?\[\]{},])", r"\\\1", text)


def file_name_part(from_end: int) -> Column:
    """Dot-separated part of the source file's name, 1 being the suffix."""
    return F.try_element_at(F.split(F.col("_metadata.file_name"), r"\."), F.lit(-from_end))


#: Types in which the Parquet reader itself can give a column of another type, without a loss.
_READ_AS = {
    "tinyint": {"smallint", "int", "bigint", "double"},
    "smallint": {"int", "bigint", "double"},
    "int": {"bigint", "double"},
    "float": {"double"},
}
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
#: Tasks that read footers, at most.
_FOOTER_TASKS = 1000


def read_widened(
    spark: SparkSession,
    path: str,
    *,
    each: Callable[[DataFrame], DataFrame] = lambda df: df,
    **options: str,
) -> DataFrame:
    """All Parquet files under ``path`` as one table, whatever their schemas.

    Missing columns become null and differing types are widened (numbers to the wider
    number, a number and text to text). Spark's own footer merge serves the usual case
    of equal types. On a type conflict tasks read the footers and the driver gets the
    different schemas. Files whose schemas the reader can give in one form are one scan;
    if that is all of them, no list of files is made. Otherwise there is a scan for each
    form, of which conflicting types make few. ``each`` is applied before scans are put
    together, while their ``_metadata`` can still be read.
    """
    reader = spark.read.options(**options)
    try:
        return each(reader.option("mergeSchema", "true").parquet(path))
    except (PySparkException, Py4JJavaError) as error:
        if "CANNOT_MERGE_SCHEMAS" not in str(error):
            raise
    footers = _footers(spark, path, options)
    found = sorted(r["schema"] for r in footers.select("schema").distinct().collect())
    schemas = {s: T.StructType.fromJson(json.loads(s)) for s in found}
    texts = _text_columns(list(schemas.values()))
    forms = _forms(schemas, texts)
    out: DataFrame | None = None
    for form, members in forms:
        if len(forms) == 1:
            scan = spark.read.options(**options).schema(form).parquet(path)
        else:
            files = footers.where(F.col("schema").isin(members)).select("path").orderBy("path")
            paths = [glob_text(r["path"]) for r in files.collect()]
            base = {"basePath": options.get("basePath", path)}
            scan = spark.read.options(**base).schema(form).parquet(*paths)
        part = each(scan)
        part = part.withColumns({c: F.col(c).cast("string") for c in part.columns if c in texts})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    assert out is not None
    return out


def _types(schemas: Iterable[T.StructType]) -> dict[str, set[str]]:
    """Types of each column in any of the schemas."""
    seen: dict[str, set[str]] = {}
    for schema in schemas:
        for f in schema.fields:
            seen.setdefault(f.name, set()).add(f.dataType.simpleString())
    return seen


def _text_columns(schemas: Iterable[T.StructType]) -> set[str]:
    """Columns that are text in some schema and something else in another."""
    return {c for c, types in _types(schemas).items() if "string" in types and len(types) > 1}


def _forms(
    schemas: dict[str, T.StructType], texts: set[str]
) -> list[tuple[T.StructType, list[str]]]:
    """Schemas to read files in, each with the names of the files' own schemas it serves.

    A number is read as the widest type of its column where the reader can do so. Columns
    that become text keep their own type: 7 is "7", not "7.0".
    """
    widest = {
        c: max(types, key=_NUMBERS.index)
        for c, types in _types(schemas.values()).items()
        if c not in texts and types <= set(_NUMBERS)
    }
    forms: list[tuple[dict[str, T.DataType], list[str]]] = []
    for name, schema in schemas.items():
        own: dict[str, T.DataType] = {}
        for f in schema.fields:
            wide = widest.get(f.name)
            readable = wide in _READ_AS.get(f.dataType.simpleString(), ())
            own[f.name] = T.DataType.fromDDL(wide) if readable else f.dataType
        for form, members in forms:
            if all(form.get(c, t).simpleString() == t.simpleString() for c, t in own.items()):
                form.update({c: t for c, t in own.items() if c not in form})
                members.append(name)
                break
        else:
            forms.append((own, [name]))
    return [(T.StructType([T.StructField(c, t) for c, t in form.items()]), m) for form, m in forms]


def _footers(spark: SparkSession, path: str, options: dict[str, str]) -> DataFrame:
    """path and schema (JSON) of every file, read by tasks and kept as a scratch table."""

    def schemas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import urlparse

        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark.sql.pandas.types import from_arrow_schema

        for batch in batches:
            found = []
            for uri in batch["path"]:
                scheme = urlparse(uri).scheme
                if scheme in ("", "file"):
                    schema = pq.read_schema("/" + uri.removeprefix(f"{scheme}:").lstrip("/"))
                else:
                    system, inner = fs.FileSystem.from_uri(uri)
                    schema = pq.read_schema(inner, filesystem=system)
                found.append(from_arrow_schema(schema).json())
            yield pd.DataFrame({"path": batch["path"], "schema": found})

    # Only names are asked for, so that no content is read.
    files = spark.read.format("binaryFile").options(**options).load(path).select("path")
    kept = scratch_dir(spark, "footers")
    found = files.coalesce(_FOOTER_TASKS).mapInPandas(schemas, "path string, schema string")
    found.write.parquet(kept)
    return spark.read.parquet(kept)
