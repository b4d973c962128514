"""Names, codes, limits and formats that results must carry exactly."""

# Names of block request operations by code.
REQUEST_OPS = {
    0: "Read",
    1: "Write",
    2: "Flush",
    3: "Discard",
    5: "SecureErase",
    6: "ZoneReset",
    7: "WriteSame",
    9: "WriteZeros",
}

# Width of the operation code.
REQUEST_OP_BITS = 8

# Flag bits above it and their names, in the order in which the names are put
# before the operation, outermost first.
REQUEST_FLAGS = [
    (21, "NoWait"),
    (20, "Background"),
    (19, "ReadAhead"),
    (15, "Idle"),
    (14, "NoMerge"),
    (13, "Priority"),
    (17, "ForcedUnitAccess"),
    (12, "Metadata"),
    (11, "Sync"),
]

# Memory advice names by code; -1 stands for an unmap call.
ADVICE_NAMES = {
    -1: "MUNMAP",
    0: "MADV_NORMAL",
    1: "MADV_RANDOM",
    2: "MADV_SEQUENTIAL",
    3: "MADV_WILLNEED",
    4: "MADV_DONTNEED",
    8: "MADV_FREE",
    9: "MADV_REMOVE",
    10: "MADV_DONTFORK",
    11: "MADV_DOFORK",
    12: "MADV_MERGEABLE",
    13: "MADV_UNMERGEABLE",
    14: "MADV_HUGEPAGE",
    15: "MADV_NOHUGEPAGE",
    16: "MADV_DONTDUMP",
    17: "MADV_DODUMP",
    18: "MADV_WIPEONFORK",
    19: "MADV_KEEPONFORK",
    20: "MADV_COLD",
    21: "MADV_PAGEOUT",
    22: "MADV_POPULATE_READ",
    23: "MADV_POPULATE_WRITE",
    24: "MADV_DONTNEED_LOCKED",
    25: "MADV_COLLAPSE",
    100: "MADV_HWPOISON",
    101: "MADV_SOFT_OFFLINE",
}

# Resident-memory counter names by index.
RSS_MEMBERS = ["MM_FILEPAGES", "MM_ANONPAGES", "MM_SWAPENTS", "MM_SHMEMPAGES"]

# Memory usage columns and the meminfo keys they come from.
MEMINFO_COLUMNS = {
    "mem_total_bytes": "MemTotal",
    "mem_free_bytes": "MemFree",
    "mem_available_bytes": "MemAvailable",
    "buffers_bytes": "Buffers",
    "cached_bytes": "Cached",
    "swap_total_bytes": "SwapTotal",
    "swap_free_bytes": "SwapFree",
    "dirty_bytes": "Dirty",
    "writeback_bytes": "Writeback",
    "anon_pages_total_bytes": "AnonPages",
    "anon_hugepages_total_bytes": "AnonHugePages",
    "mapped_total_bytes": "Mapped",
    "shmem_total_bytes": "Shmem",
    "hugepages_total": "HugePages_Total",
    "hugepages_free": "HugePages_Free",
    "hugepages_reserved": "HugePages_Rsvd",
    "hugepage_size_bytes": "Hugepagesize",
    "hardware_corrupted_bytes": "HardwareCorrupted",
}

# Limits beyond which scheduler samples are taken as invalid.
MAX_RUN_LENGTH_US = 60_000
MAX_QUEUED_TIME_US = 1_000_000

# Constants of the page prezeroing cost model.
DAEMON_COST = 1_000_000
ZEROING_PER_PAGE_COST = 1_000_000
CRITICAL_SECTION_COST = 300
PREZERO_NFREE = 100_000
LOAD_FRACTION_BITS = 11

# Page size and device number layout.
PAGE_SHIFT = 12
DEVICE_MINOR_BITS = 20

# Files whose opens mark the phases of a kernel build, and which open counts.
BUILD_MARKERS = {
    "make": "first",
    "bzImage": "last",
    "vmlinux.bin": "last",
    "vmlinux.o": "last",
    "vmlinux": "last",
}
BUILD_BENCHMARK = "linux_build"

# Memory columns drawn as trends.
MEMORY_TREND_COLUMNS = [
    "cached_bytes",
    "anon_pages_total_bytes",
    "anon_hugepages_total_bytes",
    "mapped_total_bytes",
    "shmem_total_bytes",
]

# Hardware counters, the component each belongs to and the event it counts.
COUNTERS = {
    "dtlb_misses": ("dTLB", "Misses"),
    "itlb_misses": ("iTLB", "Misses"),
    "tlb_flushes": ("TLB", "Flushes"),
    "dtlb_walk_duration": ("dTLB", "Walk Durations"),
}

# Axis titles and the cut of process labels.
AXIS_QUEUE = "Queue Size"
AXIS_IO_LATENCY = "IO Latency (us)"
AXIS_MEMORY = "Memory (GB)"
AXIS_RUN_LENGTH = "Quanta Run Length (msec)"
AXIS_QUEUED = "Quanta Queued Time (msec)"
PROCESS_LABEL_CHARS = 35
COLLECTOR_LABEL = "Collector Process"
