"""Row numbers within groups of any size: ranges in parallel, then the counts of the ranges before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fibra.functions.tables import frozen, small

#: Rows of one range; a table of fewer rows is one range.
RANGE_ROWS = 4_000_000


def numbered(df: DataFrame, keys: list[str], order: list[str], number: str = "sample", mean: str | None = None, rows: int | None = None) -> DataFrame:
    """Adds ``number``: 1, 2, ... within ``keys`` by ``order``; and ``_mean``, the keys' mean of a column ``mean``.

    The rows are divided into ranges of the whole order of keys and ``order``, so a hot key is many ranges; rows are
    numbered inside their range, and each part of a key starts where its parts in the ranges before end.  The ranges are
    kept before they are counted, since their borders come from a sample of the rows.  Rows that tie in ``order`` are
    numbered in any order: end it with columns that tell rows apart.  A table of one range is numbered in one pass.
    """
    rows = rows or RANGE_ROWS
    ranges = -(-df.count() // rows)
    if ranges <= 1:
        each = Window.partitionBy(*keys)
        out = df.withColumn(number, F.row_number().over(each.orderBy(*order)).cast("long"))
        return out if mean is None else out.withColumn("_mean", F.avg(mean).over(each))
    sorted_ = df.repartitionByRange(ranges, *keys, *order).sortWithinPartitions(*keys, *order)
    kept = frozen(sorted_.withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1)
    kept = kept.select("*", part, place.alias("_place"))
    sums = [] if mean is None else [F.sum(mean).alias("_s"), F.count(mean).alias("_c")]
    parts = kept.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_from"), *sums)
    every = Window.partitionBy(*keys)
    before = F.sum("_n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = [(F.coalesce(before, F.lit(0)) + 1 - F.col("_from")).alias("_add")]
    if mean is not None:
        total = F.sum("_c").over(every)
        starts.append(F.when(total > 0, F.sum("_s").over(every) / total).alias("_mean"))
    parts = frozen(parts.select("_part", *keys, *starts))
    out = kept.join(small(parts), ["_part", *keys]).withColumn(number, F.col("_place") + F.col("_add"))
    return out.select(*df.columns, number, *([] if mean is None else ["_mean"]))
