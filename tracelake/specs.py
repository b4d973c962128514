"""Registry of trace tables: name, columns, validity rule."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions import fixed
from tracelake.functions.columns import signed_sector

COLLECTION = "collection_id"
UPTIME = "ts_uptime_us"


@dataclass(frozen=True)
class TableSpec:
    """One named trace table.

    ``columns`` maps names to Spark SQL types; empty means any columns pass through.
    ``renames`` maps source column names to ours, ``fixes`` gives columns that need more
    than a cast. ``valid`` keeps usable rows.
    """

    name: str
    columns: Mapping[str, str] = field(default_factory=dict)
    renames: Mapping[str, str] = field(default_factory=dict)
    valid: Callable[[], Column] | None = None
    fixes: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField(n, T._parse_datatype_string(t)) for n, t in self.columns.items()]
        )

    def conform(self, df: DataFrame, collection_id: str | None = None) -> DataFrame:
        """Rename, stamp the collection and cast strictly (a bad value is an error)."""
        present = {old: new for old, new in self.renames.items() if old in df.columns}
        out = df.withColumnsRenamed(present) if present else df
        if collection_id is not None:
            out = out.withColumn(COLLECTION, F.lit(collection_id))
        if not self.columns:
            return out
        missing = [c for c in self.columns if c not in out.columns]
        if missing:
            raise ValueError(f"table {self.name} lacks columns {missing}")
        fixed_up = {c: fix(F.col(c)) for c, fix in self.fixes.items()}
        return out.select(
            *[fixed_up.get(c, F.col(c)).cast(t).alias(c) for c, t in self.columns.items()]
        )

    def filtered(self, df: DataFrame) -> DataFrame:
        """Rows that pass the validity rule."""
        return df if self.valid is None else df.where(self.valid())


_REGISTRY: dict[str, TableSpec] = {}


def register_table(table: TableSpec) -> TableSpec:
    """Make a table known by name."""
    _REGISTRY[table.name] = table
    return table


def register_counter(name: str) -> TableSpec:
    """Make a hardware counter table known; all counter operators then accept it."""
    return register_table(
        TableSpec(
            name,
            _longs("cpu pid tgid ts_uptime_us")
            | {COLLECTION: "string"}
            | _longs(f"cumulative_{name} pmu_enabled_time_us pmu_running_time_us"),
            renames={"cumulative_count": f"cumulative_{name}"},
        )
    )


def spec(name: str) -> TableSpec:
    return _REGISTRY[name]


def table_names() -> list[str]:
    return sorted(_REGISTRY)


def _longs(names: str) -> dict[str, str]:
    return dict.fromkeys(names.split(), "bigint")


def _register_all() -> None:
    cid = {COLLECTION: "string"}
    event = _longs("cpu pid tgid ts_uptime_us")
    register_table(
        TableSpec(
            "quanta_runtime",
            event | _longs("quanta_run_length_us") | cid,
            renames={"quanta_end_uptime_us": UPTIME},
            valid=lambda: F.col("quanta_run_length_us") < fixed.MAX_RUN_LENGTH_US,
        )
    )
    register_table(
        TableSpec(
            "quanta_queued_time",
            event | _longs("quanta_queued_time_us") | cid,
            renames={
                "quanta_end_uptime_us": UPTIME,
                "quanta_run_length_us": "quanta_queued_time_us",
            },
            valid=lambda: F.col("quanta_queued_time_us") < fixed.MAX_QUEUED_TIME_US,
        )
    )
    block = _longs("cpu device sector segments block_io_bytes ts_uptime_us")
    register_table(
        TableSpec(
            "block_io_queue_length",
            block
            | _longs("block_io_flags queue_length_segment_ios queue_length_4k_ios")
            | cid,
            renames={
                "block_io_start_uptime_us": UPTIME,
                "queue_length_segments": "queue_length_segment_ios",
                "queue_length_4ks": "queue_length_4k_ios",
            },
            fixes={"sector": signed_sector},
        )
    )
    register_table(
        TableSpec(
            "block_io_latency",
            block | _longs("block_latency_us block_io_latency_us block_io_flags") | cid,
            renames={"block_io_end_uptime_us": UPTIME},
            fixes={"sector": signed_sector},
        )
    )
    register_table(
        TableSpec(
            "block_io",
            block
            | _longs(
                "finish_ts_uptime_us block_latency_us block_io_latency_us"
                " measured_latency_us block_io_flags"
            )
            | {"block_io_flags_string": "string"}
            | _longs("queue_length_segment_ios queue_length_4k_ios")
            | cid,
        )
    )
    for counter in fixed.COUNTERS:
        register_counter(counter)
    register_table(
        TableSpec(
            "file_data",
            event | _longs("file_inode file_size_bytes") | {"file_name": "string"} | cid,
        )
    )
    register_table(
        TableSpec("memory_usage", _longs(UPTIME) | _longs(" ".join(fixed.MEMINFO_COLUMNS)) | cid)
    )
    register_table(
        TableSpec(
            "process_metadata",
            _longs("pid")
            | {"name": "string", "cmdline": "string"}
            | _longs("start_time_unix_sec parent_pid nice")
            | {"cgroup_path": "string"}
            | cid,
            renames={"parent": "parent_pid", "start_time": "start_time_unix_sec"},
        )
    )
    register_table(
        TableSpec(
            "process_trace",
            _longs("pid tgid ts_ns") | {"name": "string", "cap_type": "string"} | cid,
        )
    )
    register_table(
        TableSpec(
            "mm_rss_stat",
            _longs("pid tgid ts_ns") | {"member": "string"} | _longs("count") | cid,
        )
    )
    register_table(
        TableSpec("zswap_runtime", _longs("pid tgid start_ts end_ts") | {"name": "string"} | cid)
    )
    span = _longs("pid tgid start_ts_ns end_ts_ns") | {"mm": "string"}
    register_table(
        TableSpec(
            "collapse_huge_pages",
            span
            | _longs("referenced")
            | {"address": "string", "unmapped": "bigint", "cc": "string"}
            | cid,
        )
    )
    register_table(
        TableSpec(
            "trace_mm_collapse_huge_page",
            span | {"isolated": "boolean", "status": "bigint"} | cid,
        )
    )
    register_table(
        TableSpec(
            "trace_mm_khugepaged_scan_pmd",
            span
            | {"page": "string"}
            | _longs("writeable referenced none_or_zero status")
            | {"unmapped": "boolean"}
            | cid,
        )
    )
    register_table(TableSpec("collapse_hugepage"))
    # Addresses may pass 2^63, so they are kept as 20-digit decimals.
    wide = "decimal(20,0)"
    register_table(
        TableSpec(
            "madvise",
            _longs("tgid ts_ns") | {"address": wide, "length": wide, "advice": "string"} | cid,
        )
    )
    register_table(
        TableSpec(
            "unmap_range",
            _longs("tgid ts_ns") | {"start": wide, "end": wide, "is_huge": "boolean"} | cid,
        )
    )
    register_table(
        TableSpec(
            "cbmm_eager",
            _longs("freq_cycles greatest_range_benefit") | {"decision": "boolean"} | cid,
        )
    )
    register_table(
        TableSpec(
            "cbmm_prezero",
            _longs(
                "load daemon_cost prezero_n nfree critical_section_cost"
                " zeroing_per_page_cost recent_used"
            )
            | {"decision": "boolean"}
            | cid,
        )
    )
    # Host facts differ between collector versions, so any columns pass.
    register_table(TableSpec("system_info"))


_register_all()
