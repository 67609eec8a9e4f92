"""Dense numbers in a global order without gathering the rows: ranges, numbers inside each range, and sums over the ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: monotonically_increasing_id() holds the partition above, and the row's place in it within, so many bits.
PLACE_BITS = 33


def numbered(df: DataFrame, order: list[str], name: str = "number", start: int = 1) -> DataFrame:
    """df with consecutive numbers from `start` in the given order (nulls first; rows that tie in all of it get numbers in any
    order). The rows are stored once, since a range's places hold for one run only; the only window is over the ranges."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = stored(ranged, "numbered")
    part, place = F.shiftright("__id", PLACE_BITS), F.col("__id").bitwiseAND((1 << PLACE_BITS) - 1)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("__part", before.alias("__base"))
    return rows.withColumn("__part", part).join(bases, "__part").withColumn(name, F.col("__base") + place + start).drop("__part", "__base", "__id")
