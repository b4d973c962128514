"""Benchmark result files as tables: experiment averages, map-get statistics, distributions.

Log text comes as lines: path (or another file key), line_no, line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.columns import mean_of_ints, variance_of_ints
from tracelake.plans.ordered import TARGET_ROWS, ordered_scan
from tracelake.plans.quantiles import exact_quantiles

_INSTRUCTIONS = "instructions:k"
_DEFAULT = "zswap_default"
_BOX = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}


def experiment_instructions(lines: DataFrame) -> DataFrame:
    """Kernel instructions of every result file: the last matching line, 0 without one.

    The experiment is the folder below the results root: the first element of
    ``relative_path`` (see ``read_result_lines``), else the second of ``path``, which then
    starts at the root. Settings b and k are left out and plain a is the default setting.
    """
    if "relative_path" in lines.columns:
        exp = F.try_element_at(F.split("relative_path", "/"), F.lit(1))
    else:
        exp = F.try_element_at(F.split("path", "/"), F.lit(2))
    counted = F.when(
        F.col("line").contains(_INSTRUCTIONS),
        F.struct(
            "line_no",
            F.regexp_replace(F.regexp_extract("line", r"^\s*(\S+)", 1), ",", "").alias("text"),
        ),
    )
    named = lines.withColumn("experiment", exp).where(
        ~F.col("experiment").contains("experiment_b") & ~F.col("experiment").contains("experiment_k")
    )
    return named.groupBy("path", "experiment").agg(F.max(counted).alias("__last")).select(
        "path",
        F.when(F.col("experiment") == "experiment_a", F.lit(f"experiment_a_{_DEFAULT}"))
        .otherwise(F.col("experiment"))
        .alias("experiment"),
        F.coalesce(F.col("__last.text").cast("long"), F.lit(0).cast("long")).alias("instructions"),
    )


def short_experiment_name(experiment: Column) -> Column:
    """Name without its ``experiment_x_`` part, the last underscore turned into ``=``."""
    bare = F.regexp_replace(experiment, "experiment_[a-z]_", "")
    return F.regexp_replace(bare, "_([^_]*)$", "=$1")


def experiment_averages(lines: DataFrame, *, ordered: bool = True) -> DataFrame:
    """Runs and mean kernel instructions per experiment, the default first, then by name."""
    out = (
        experiment_instructions(lines)
        .groupBy("experiment")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            mean_of_ints(F.col("instructions")).alias("average_instructions"),
        )
        .withColumns(
            {
                "short_name": short_experiment_name(F.col("experiment")),
                "is_default": F.col("experiment").contains(_DEFAULT),
            }
        )
    )
    return out.orderBy(F.desc("is_default"), "short_name", "experiment") if ordered else out


def parse_get_bench(lines: DataFrame) -> DataFrame:
    """Fields of ``get_iterations N map_size N value_size N Time(ns) N`` lines.

    Lines without a ``system`` column get it from the name of their file, as
    ``<system>-<data size>-<map size>.stats``, which also gives sizes that a line lacks.
    """
    named = r"([^/]+)-(\d+)-(\d+)\.stats$"
    from_file = "system" not in lines.columns

    def number(label: str, group: int = 0) -> Column:
        found = F.regexp_extract("line", rf"{label}\s+(-?\d+)", 1).try_cast("long")
        if not (from_file and group):
            return found
        return F.coalesce(found, F.regexp_extract("path", named, group).try_cast("long"))

    system = [F.regexp_extract("path", named, 1).alias("system")] if from_file else []
    return lines.select(
        *[c for c in lines.columns if c != "line"],
        *system,
        number("get_iterations").alias("iterations"),
        number("map_size", 3).alias("map_size"),
        number("value_size", 2).alias("data_size"),
        number(r"Time\(ns\)").alias("time_ns"),
    )


def get_bench_stats(lines: DataFrame) -> DataFrame:
    """Mean and sample variance of the time per (system, data size, map size), and the
    mean and deviation per operation. The operation count is that of the first line."""
    stats = (
        parse_get_bench(lines)
        .groupBy("system", "data_size", "map_size")
        .agg(
            F.min(F.struct("line_no", "iterations")).getField("iterations").alias("iterations"),
            mean_of_ints(F.col("time_ns")).alias("average_time_ns"),
            variance_of_ints(F.col("time_ns")).alias("variance"),
        )
    )
    return stats.withColumns(
        {
            "per_op_ns": F.try_divide("average_time_ns", "iterations"),
            "per_op_sd": F.try_divide(F.sqrt("variance"), F.col("iterations")),
        }
    )


def get_bench_pivot(lines: DataFrame, systems: list[str], map_size: int = 256) -> DataFrame:
    """Per data size, the time per operation of each system side by side, and its deviation."""
    stats = get_bench_stats(lines).where(F.col("map_size") == map_size)
    picks = []
    for value, suffix in (("per_op_ns", ""), ("per_op_sd", "_sd")):
        for s in systems:
            name = s.replace("-", "_") + suffix
            picks.append(F.max(F.when(F.col("system") == s, F.col(value))).alias(name))
    return stats.groupBy("data_size").agg(*picks)


def box_summary(
    samples: DataFrame, keys: list[str], value: str, *, target_rows: int | None = TARGET_ROWS
) -> DataFrame:
    """Five-number summary of ``value`` per group, exact."""
    return exact_quantiles(samples, keys, value, _BOX, target_rows=target_rows)


def box_samples(
    index: DataFrame, samples: DataFrame, groups: int, *, file_key: str = "relative_path"
) -> DataFrame:
    """Sample values named by an index file: x, group_no, group_label, value.

    A line of ``index`` holds for each of ``groups`` the name of a sample file and then the
    x label; with several groups the first line names them. ``samples`` are the lines of all
    sample files, one number each, with their file's name in ``file_key``.
    """
    fields = F.split(F.regexp_replace("line", r"\s+$", ""), r"\s+")
    cells = index.select("path", "line_no", fields.alias("f"))
    first = cells.groupBy("path").agg(F.min_by("f", "line_no").alias("labels"), F.min("line_no").alias("head"))
    if groups > 1:
        cells = cells.join(first, "path").where(F.col("line_no") > F.col("head"))
    else:
        cells = cells.withColumn("labels", F.array(F.lit("")))
    one = F.posexplode(F.slice("f", 1, groups)).alias("group_no", "file")
    named = cells.select(F.element_at("f", groups + 1).alias("x"), "labels", one).select(
        "x",
        F.col("group_no").cast("long").alias("group_no"),
        F.try_element_at("labels", F.col("group_no") + 1).alias("group_label"),
        "file",
    )
    values = samples.select(F.col(file_key).alias("file"), F.col("line").try_cast("double").alias("value"))
    return named.join(values.where("value is not null"), "file").drop("file")


def grouped_bar_long(lines: DataFrame, groups: int, *, file_key: str = "path") -> DataFrame:
    """Grouped bar rows as one row per (x, group).

    A data line holds ``groups`` y values, the x label, then optionally ``groups`` error
    values (0 when absent). With several groups the first line of a file names them.
    Columns: file key, line_no, x, group_no, group_label, y, error.
    """
    # Only trailing blanks are cut; a leading one makes an empty first field.
    fields = F.split(F.regexp_replace("line", r"\s+$", ""), r"\s+")
    parts = lines.select(file_key, "line_no", fields.alias("f"))
    if groups > 1:
        head = parts.groupBy(file_key).agg(
            F.min(F.struct("line_no", "f")).alias("h")
        ).select(file_key, F.col("h.line_no").alias("__head"), F.col("h.f").alias("__labels"))
        parts = parts.join(head, file_key, "inner").where(F.col("line_no") > F.col("__head"))
    else:
        parts = parts.withColumn("__labels", F.array(F.lit("")))
    one = F.posexplode(F.slice("f", 1, groups)).alias("group_no", "__y")
    at = F.col("group_no")
    error = F.try_element_at("f", at + 2 + groups)
    return parts.select(file_key, "line_no", "f", "__labels", one).select(
        file_key,
        "line_no",
        F.element_at("f", groups + 1).alias("x"),
        at.cast("long").alias("group_no"),
        F.try_element_at("__labels", at + 1).alias("group_label"),
        F.col("__y").cast("double").alias("y"),
        F.coalesce(error.cast("double"), F.lit(0.0)).alias("error"),
    )


def parse_sections(
    lines: DataFrame, *, file_key: str = "path", target_rows: int | None = TARGET_ROWS
) -> DataFrame:
    """Numbers of a sectioned timing log with the header they stand under.

    A header is ``===== [USER |KERN ]SIZE n =====``. Columns: file key, line_no, side
    (USER, KERN or ""), size, value. An empty section gives no rows.
    """
    pattern = r"^=+\s*(USER|KERN)?\s*SIZE\s+(\d+)\s*=+\s*$"
    is_head = F.col("line").rlike(pattern)
    head = F.when(
        is_head,
        F.struct(
            F.regexp_extract("line", pattern, 1).alias("side"),
            F.regexp_extract("line", pattern, 2).cast("long").alias("size"),
        ),
    )
    scan = ordered_scan(
        lines.select(file_key, "line_no", "line"),
        [file_key],
        ["line_no", "line"],
        latest={"__head": head},
        target_rows=target_rows,
    )
    body = ~is_head & (F.trim("line") != "") & F.col("__head").isNotNull()
    return scan.where(body).select(
        file_key,
        "line_no",
        "__head.side",
        "__head.size",
        F.trim("line").cast("double").alias("value"),
    )


def inference_latency_by_size(
    lines: DataFrame, *, file_key: str = "path", target_rows: int | None = TARGET_ROWS
) -> DataFrame:
    """Mean and five-number summary of inference time per side and model size."""
    values = parse_sections(lines, file_key=file_key, target_rows=target_rows)
    numbers = lines.select(F.col("line").try_cast("double").alias("value"))
    return exact_quantiles(
        values,
        ["side", "size"],
        "value",
        _BOX,
        mean="mean",
        measured_on=numbers.where(F.col("value").isNotNull()),
        target_rows=target_rows,
    )
