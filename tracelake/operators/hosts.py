"""Host facts: nested machine description to one flat row per collection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_structs(df: DataFrame) -> DataFrame:
    """Replace every struct column by its fields (one level)."""
    out: list[str | Column] = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            out.extend(F.col(f"`{f.name}`.`{n}`").alias(n) for n in f.dataType.names)
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def with_run_facts(
    system_info: DataFrame, facts: Mapping[str, object], hooks: Sequence[str] | None = None
) -> DataFrame:
    """Add constant facts of the run (collection time, pid, benchmark) and its hook list."""
    out = system_info.withColumns(
        {name: v if isinstance(v, Column) else F.lit(v) for name, v in facts.items()}
    )
    if hooks is None:
        return out
    return out.withColumn("hooks", F.array(*[F.lit(h) for h in hooks]).cast("array<string>"))
