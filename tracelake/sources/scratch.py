"""Where intermediate tables and streaming checkpoints go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, as in tests, a folder in the warehouse, which they share as well.
    """
    own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return (spark.conf.get("spark.checkpoint.dir", None) or own).rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_root(spark)}/tracelake-{label}-{uuid.uuid4().hex}"


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors lose none of it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and read back; its size is known to the planner."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
