"""Joining block IO issues and completions that arrive in chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracelake.operators.blockio import REQUEST as _REQUEST
from tracelake.sources.commits import commit_table, published, read_committed
from tracelake.specs import UPTIME

#: Tables of a sink: its pairs, and the rows after each micro-batch that later ones can still meet.
PAIRS, OPEN_ISSUES, OPEN_ENDS = "pairs", "open_issues", "open_completions"


def _micros(interval: str) -> str:
    return f"CAST(unix_micros(timestamp_micros(0) + INTERVAL {interval}) AS bigint)"


def slow_completions(latency: DataFrame, max_latency: str) -> DataFrame:
    """Completions that the bounded join cannot pair, for a sink of their own.

    Written beside the pairs (see ``start_table_sink``) they tell what ``max_latency`` left
    out; the batch join over them and the issues gives the missing pairs.
    """
    return latency.where(F.col("block_latency_us") > F.expr(_micros(max_latency)))


def stream_block_io_pairs(
    queue: DataFrame,
    latency: DataFrame,
    *,
    max_latency: str | None = None,
    delay: str = "10 seconds",
) -> DataFrame:
    """Issue/completion pairs across chunk borders, as they become complete.

    The pairs are those of the batch join; pass the written result through
    ``dedup_pairs`` to keep one completion per issue. With ``max_latency`` an issue is
    forgotten once no completion that much later can come, given chunks at most
    ``delay`` out of order, and slower pairs are not found: send ``slow_completions`` to a
    table of their own. Without, all issues are kept and the result equals the batch join for
    any arrival order.
    """
    starts, ends = queue.alias("q"), latency
    ends = ends.select(
        *[F.col(c).alias(f"__{c}") for c in _REQUEST],
        F.col(UPTIME).alias("finish_ts_uptime_us"),
        "block_latency_us",
        "block_io_latency_us",
    )
    lasted = F.col("finish_ts_uptime_us") - F.col(UPTIME)
    match = (lasted > 0) & (lasted < F.col("block_latency_us"))
    for c in _REQUEST:
        match = match & (F.col(c) == F.col(f"__{c}"))
    if max_latency is not None:
        starts = starts.withColumn("__begun", F.timestamp_micros(UPTIME)).withWatermark(
            "__begun", delay
        )
        ends = ends.withColumn(
            "__ended", F.timestamp_micros("finish_ts_uptime_us")
        ).withWatermark("__ended", delay)
        match = match & F.expr(
            f"__ended >= __begun AND __ended <= __begun + INTERVAL {max_latency}"
        )
    joined = starts.join(ends, match, "inner")
    return joined.drop(*[f"__{c}" for c in _REQUEST], "__begun", "__ended")


def start_block_io_sink(
    queue: DataFrame,
    latency: DataFrame,
    base: str,
    checkpoint: str,
    *,
    max_latency: str,
    delay: str = "10 seconds",
    interval: str | None = None,
) -> StreamingQuery:
    """Append the pairs of two streams to a table below ``base``, each exactly once.

    The pairs are those of ``stream_block_io_pairs`` with the same bounds. A micro-batch is
    joined by a shuffle, which spills, and only what later ones can still meet is kept: issues
    until ``max_latency`` and completions until nothing after the watermark (``delay`` behind
    the stream that is less far) can be theirs. So memory does not grow with the chunks, and
    what is kept grows with the bounds alone. Rows later than ``delay`` are paired with what is
    still kept. With ``interval`` it keeps draining at that pace; without, it takes what is
    there and ends.
    """
    issue, end = (F.struct("*").alias(x) for x in ("issue", "end"))
    none = [F.lit(None).cast(T.StructType(s.schema.fields)) for s in (queue, latency)]
    both = queue.select(issue, none[1].alias("end")).union(latency.select(none[0].alias("issue"), end))

    def pair(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        issues, ends = (batch.where(f"{x} is not null").select(f"{x}.*") for x in ("issue", "end"))
        old_issues = _open(spark, base, OPEN_ISSUES, number, queue.schema)
        old_ends = _open(spark, base, OPEN_ENDS, number, latency.schema)
        every_issue, every_end = old_issues.union(issues), old_ends.union(ends)
        # What was open on both sides has met before.
        met = ((every_issue, ends), (issues, old_ends))
        pairs = [stream_block_io_pairs(a, b, max_latency=max_latency, delay=delay) for a, b in met]
        commit_table(reduce(DataFrame.union, pairs), base, PAIRS, f"batch-{number}", partitions=())
        last = [x.agg(F.max(UPTIME).alias(UPTIME)) for x in (every_issue, every_end)]
        seen = last[0].union(last[1]).agg(F.min(UPTIME), F.count(UPTIME)).first()
        if seen[1] == 2:
            mark = F.lit(seen[0]) - F.expr(_micros(delay))
            every_issue = every_issue.where(F.col(UPTIME) >= mark - F.expr(_micros(max_latency)))
            every_end = every_end.where(F.col(UPTIME) >= mark)
        commit_table(every_issue, base, OPEN_ISSUES, f"batch-{number}", partitions=())
        commit_table(every_end, base, OPEN_ENDS, f"batch-{number}", partitions=())

    writer = both.writeStream.foreachBatch(pair).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


def _open(spark: SparkSession, base: str, table: str, number: int, schema: T.StructType) -> DataFrame:
    """What the micro-batch before left open; a batch that is run again finds the same."""
    runs = published(spark, base, table).where(F.col("run") == f"batch-{number - 1}").collect()
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/{table}/{runs[0]['folder']}")


def read_block_io_pairs(spark: SparkSession, base: str) -> DataFrame:
    """The pairs that ``start_block_io_sink`` has written below ``base``."""
    return read_committed(spark, base, PAIRS)
