"""Join of a big table with a small one on few key values, without a task for each value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of one key value are dealt into.
PARTS = 64


def spread_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], by: Column, how: str = "left"
) -> DataFrame:
    """``big`` joined with ``small``, which has a row for each value of ``on``.

    The big side is dealt by a hash of ``by`` within each value and the small side copied to
    each part, so that a value with a third of all rows is no hot key. Where Spark
    broadcasts the small side, as it does below its own limit, nothing is shuffled at all.
    """
    part = F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int")
    copies = small.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return big.withColumn("__part", part).join(copies, [*on, "__part"], how).drop("__part")
