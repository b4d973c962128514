"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import fixed


def _name_by_code(code: Column, names: dict[int, str], missing: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit(missing))


def request_flags_label(flags: Column) -> Column:
    """Text form of block request flags: set flag names, then the operation."""
    prefixes = [
        F.when(flags.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(name)) for bit, name in fixed.REQUEST_FLAGS
    ]
    op = flags.bitwiseAND(F.lit((1 << fixed.REQUEST_OP_BITS) - 1))
    text = F.concat_ws("-", *prefixes, _name_by_code(op, fixed.REQUEST_OPS, "Unknown"))
    return F.when(flags.isNotNull(), text)


def advice_label(code: Column) -> Column:
    """Name of a memory advice code, ``UNKNOWN`` when there is none."""
    return _name_by_code(code, fixed.ADVICE_NAMES, "UNKNOWN")


def rss_member(index: Column) -> Column:
    """Name of a resident-memory counter index; an unknown index is an error."""
    return F.element_at(F.array(*[F.lit(m) for m in fixed.RSS_MEMBERS]), index.cast("int") + 1)


def signed_sector(sector: Column) -> Column:
    """Sector as a signed long; the unsigned form of -1 (no sector) becomes -1."""
    wide = sector.cast("decimal(20,0)")
    return F.when(wide == F.lit("18446744073709551615").cast("decimal(20,0)"), F.lit(-1)).otherwise(
        F.when(wide < F.lit("18446744073709551615").cast("decimal(20,0)"), wide)
    ).cast("long")


def block_4k_ios(size_bytes: Column) -> Column:
    """Number of 4 KiB blocks that hold ``size_bytes``."""
    return F.shiftright(size_bytes + 4095, 12)


def pages(size_bytes: Column) -> Column:
    """Whole 4 KiB pages in ``size_bytes``."""
    return F.shiftright(size_bytes, fixed.PAGE_SHIFT)


def device_id(major: Column, minor: Column) -> Column:
    """Device number from its major and minor parts."""
    return F.shiftleft(major.cast("long"), fixed.DEVICE_MINOR_BITS).bitwiseOR(minor.cast("long"))


def device_major(device: Column) -> Column:
    return F.shiftright(device, fixed.DEVICE_MINOR_BITS)


def device_minor(device: Column) -> Column:
    return device.bitwiseAND(F.lit((1 << fixed.DEVICE_MINOR_BITS) - 1))


def uptime_sec(ts_uptime_us: Column, start_uptime_sec: Column) -> Column:
    """Seconds since the collection started."""
    return ts_uptime_us / F.lit(1_000_000.0) - start_uptime_sec


def us_to_sec(us: Column) -> Column:
    return us / F.lit(1_000_000.0)


def us_to_ms(us: Column) -> Column:
    return us / F.lit(1_000.0)


def bytes_to_mib(size: Column) -> Column:
    return size / F.lit(1024.0) / F.lit(1024.0)


def bytes_to_gib(size: Column) -> Column:
    return size / F.lit(1024.0**3)


def ns_to_min(ns: Column) -> Column:
    return ns / F.lit(10.0**9) / F.lit(60)


def after_first_blank(cmdline: Column) -> Column:
    """Arguments of a command line: the text after its first blank, one blank appended."""
    padded = F.concat(cmdline, F.lit(" "))
    return F.substr(padded, F.instr(padded, " ") + 1)


def mean_of_ints(value: Column) -> Column:
    """Mean from an exact integer sum, so that row order cannot change it."""
    return F.sum(value).cast("double") / F.count(value)


def variance_of_ints(value: Column) -> Column:
    """Sample variance, null below two values.

    From exact sums, so that order cannot change it, while count x sum of squares stays
    under 38 digits; of larger groups the variance that merges means, in doubles.
    """
    wide = "decimal(38,0)"
    n = F.count(value).cast(wide)
    total = F.try_sum(value.cast("decimal(20,0)")).cast(wide)
    square = F.try_multiply(value.cast("decimal(19,0)"), value.cast("decimal(19,0)"))
    squares = F.when(F.count(square) == F.count(value), F.try_sum(square)).cast(wide)
    left, right = F.try_multiply(n, squares), F.try_multiply(total, total)
    spread = F.try_subtract(left, right).cast("double")
    exact = F.try_divide(spread, n.cast("double") * (n.cast("double") - 1))
    return F.coalesce(exact, F.var_samp(value.cast("double")))
