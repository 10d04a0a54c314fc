"""Exact quantiles of groups of any size, by histograms that are refined where the ranks fall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fibra.functions.tables import frozen, small

BINS = 1024
#: Values of a bin that are sorted in one go.
FEW = 1 << 16


#: Over the natural logarithm of every double's magnitude, with its sign turned.
DEEPEST = 750


def _within(value: Column, lo: Column, hi: Column, bins: int, logarithmic: bool) -> Column:
    """The bin of a value between lo and hi, by its share of the way; it grows with the value, lo is in the first and hi in the last.

    Halves keep the widest ranges finite; logarithmic bins part values of very different size.
    """
    share = (value / 2 - lo / 2) / (hi / 2 - lo / 2)
    if logarithmic:
        depth = lambda x: F.signum(x) * (F.log(F.when(x == 0, 1.0).otherwise(F.abs(x))) + DEEPEST)
        share = F.when(depth(hi) > depth(lo), (depth(value) - depth(lo)) / (depth(hi) - depth(lo))).otherwise(share)
    return F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int")


def quantiles(df: DataFrame, keys: list[str], column: str, bins: int = BINS, few: int = FEW, **shares: float) -> DataFrame:
    """keys and a column for each name=share: that quantile of ``column`` (NULLs left out), linear between the two nearest ranks.

    Each round counts the values of the ranges that hold a wanted rank in ``bins`` bins, and the bin of the rank, with
    its own least and greatest value, is the next range (bins of equal width and logarithmic ones take turns); it ends when ranges hold ``few`` values at most, or equal ones.
    So no group's values are ever held together, and all values count.
    """
    names = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(1))
    rows = frozen(rows.select(*names, F.col(column).cast("double").alias("_v")).where("_v is not null and not isnan(_v)"))
    place = lambda share: (F.col("_n") - 1) * F.lit(float(share))
    found = rows.groupBy(*names).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    groups = frozen(found)
    ranks = F.array_distinct(F.array(*[f(place(s)) for s in shares.values() for f in (F.floor, F.ceil)]))
    wanted = groups.select(*names, F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_held"))
    done, logarithmic = None, False
    while True:
        wanted = frozen(wanted) if done is not None else wanted
        ended = (F.col("_lo") == F.col("_hi")) | (F.col("_held") <= few)
        done = wanted.where(ended) if done is None else frozen(done.unionByName(wanted.where(ended)))
        open_ = wanted.where(~ended)
        if open_.isEmpty():
            break
        ranges = small(open_.select(*names, "_lo", "_hi").distinct())
        counts = rows.join(ranges, names).where("_v between _lo and _hi").groupBy(*names, "_lo", "_hi", _within(F.col("_v"), F.col("_lo"), F.col("_hi"), bins, logarithmic).alias("_bin"))
        counts = counts.agg(F.count("_v").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        before = F.sum("_c").over(Window.partitionBy(*names, "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("_before", F.coalesce(before, F.lit(0)))
        hit = open_.join(counts, [*names, "_lo", "_hi"]).withColumn("_at", F.col("_rank") - F.col("_below") - F.col("_before")).where("_at >= 0 and _at < _c")
        wanted = hit.select(*names, "_rank", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_below") + F.col("_before")).alias("_below"), F.col("_c").alias("_held"))
        logarithmic = not logarithmic
    ranges = small(done.where("_lo < _hi").select(*names, "_lo", "_hi").distinct())
    lists = rows.join(ranges, names).where("_v between _lo and _hi").groupBy(*names, "_lo", "_hi").agg(F.sort_array(F.collect_list("_v")).alias("_values"))
    values = done.join(lists, [*names, "_lo", "_hi"], "left")
    values = values.select(*names, "_rank", F.coalesce(F.get("_values", (F.col("_rank") - F.col("_below")).cast("int")), F.col("_lo")).alias("_value"))
    values = values.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at"))

    def between(share: float) -> Column:
        at = place(share)
        low, high = F.element_at("_at", F.floor(at)), F.element_at("_at", F.ceil(at))
        return F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return groups.join(values, names).select(*keys, *[between(s).alias(n) for n, s in shares.items()])
