"""Channels in chunks with halos, so that one long recording is many tasks.

A chunk is ``size`` samples of a channel.  ``chunked`` gives each chunk copies of the samples around
it, as many as a frame reaches; window functions then run inside chunks, and ``owned`` drops the
copies.  Samples are numbered 1, 2, ... without gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fibra.functions.tables import BROADCAST_ROWS, frozen
from fibra.sources.signals import KEYS

#: Samples of a chunk.
CHUNK = 1 << 16
CHUNK_KEYS = [*KEYS, "_chunk"]
#: Frames of more samples are put together from blocks.
NARROW = 64


def chunk_of(size: int) -> Column:
    return F.floor((F.col("sample") - 1) / size)


def chunked(samples: DataFrame, before: int = 0, after: int = 0, size: int | None = None) -> DataFrame:
    """Adds ``_chunk`` and ``_own``; a sample is copied to each chunk that begins up to ``before`` samples after it or ends up to ``after`` before it."""
    size = size or CHUNK
    at = F.col("sample") - 1
    if not before and not after:
        return samples.withColumns({"_chunk": chunk_of(size), "_own": F.lit(True)})
    first = F.greatest(F.lit(0).cast("long"), F.floor((at - after) / size))
    out = samples.withColumn("_chunk", F.explode(F.sequence(first, F.floor((at + before) / size))))
    return out.withColumn("_own", F.col("_chunk") == chunk_of(size))


def owned(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_chunk")


def by_chunk():
    return Window.partitionBy(*CHUNK_KEYS).orderBy("sample")


def per_chunk(levels: DataFrame, size: int | None = None, end: str = "_end") -> DataFrame:
    """A row of each channel's ``levels`` for each of its chunks (``end``: its number of samples), to be joined by ``CHUNK_KEYS``.

    So no key of a join is hotter than a chunk, and nothing has to be small.
    """
    last = F.floor((F.col(end) - 1) / (size or CHUNK))
    return levels.where(F.col(end) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop(end)


def attached(df: DataFrame, levels: DataFrame, samples: DataFrame, size: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Adds the columns of ``levels`` (a row for each channel of ``samples``) to ``df``, which is in chunks.

    Levels are kept and counted: few are broadcast, more are joined chunk by chunk.
    """
    keys = keys or KEYS
    kept = frozen(levels)
    if kept.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(kept), keys)
    ends = samples.groupBy(*keys).agg(F.max("sample").alias("_end"))
    return df.join(per_chunk(kept.join(ends, keys), size), [*keys, "_chunk"])


def with_levels(df: DataFrame, samples: DataFrame, size: int | None = None, **levels: Column) -> DataFrame:
    """Adds figures of whole channels of ``samples`` to ``df``, which is in chunks."""
    return attached(df, samples.groupBy(*KEYS).agg(*[c.alias(n) for n, c in levels.items()]), samples, size)


def moving(df: DataFrame, before: int, after: int, **columns: tuple[str, Column]) -> DataFrame:
    """Adds name=(how, value) over the frame from ``before`` rows back to ``after`` rows ahead; how: sum, count, avg or max.

    NULLs are skipped, and the frame shrinks at the ends of a channel.  ``df`` is in chunks with halos of at least this reach.
    A wide frame costs the same for each sample whatever its width: with blocks as long as the frame, it is the end of
    one block and the beginning of the next, each a running figure.  Only values of the frame are ever added up, so
    nothing is lost by subtraction.
    """
    inside = by_chunk()
    if before + after + 1 <= NARROW:
        frame = inside.rowsBetween(-before, after)
        fold = {"sum": F.sum, "count": F.count, "avg": F.avg, "max": F.max}
        return df.withColumns({name: fold[how](value).over(frame) for name, (how, value) in columns.items()})
    names = {name: f"_f{i}" for i, name in enumerate(columns)}
    df = df.withColumn("_block", F.floor((F.col("sample") - 1) / (before + after + 1)))
    block = Window.partitionBy(*CHUNK_KEYS, "_block")

    def running(order: Column) -> Column:
        w = block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        parts = [F.col("_block").alias("block")]
        for name, (how, value) in columns.items():
            f = names[name]
            if how in ("sum", "avg"):
                parts.append(F.sum(F.coalesce(value, F.lit(0.0))).over(w).alias(f"{f}s"))
            if how in ("sum", "avg", "count"):
                parts.append(F.count(value).over(w).alias(f"{f}n"))
            if how == "max":
                parts.append(F.max(value).over(w).alias(f"{f}m"))
        return F.struct(*parts)

    df = df.withColumn("_up", running(F.col("sample").asc())).withColumn("_down", running(F.col("sample").desc()))
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({"_l": F.lag("_down", before).over(inside), "_r": F.lead("_up", after).over(inside), "_first": F.first("_down").over(whole), "_last": F.last("_up").over(whole)})
    left, right = F.coalesce("_l", "_first"), F.coalesce("_r", "_last")
    one = left["block"] == right["block"]
    # within one block: cut off at the start of the channel it is what stands before, else what stands after
    pick = lambda f, both: F.when(one, F.when(F.col("_l").isNull(), right[f]).otherwise(left[f])).otherwise(both(left[f], right[f]))
    add = lambda a, b: a + b
    out = {}
    for name, (how, _) in columns.items():
        f = names[name]
        if how == "max":
            out[name] = pick(f"{f}m", F.greatest)
            continue
        n = pick(f"{f}n", add)
        out[name] = n if how == "count" else F.when(n > 0, pick(f"{f}s", add) / (n if how == "avg" else 1))
    return df.withColumns(out).drop("_block", "_up", "_down", "_l", "_r", "_first", "_last")


def stitched(pieces: DataFrame, first: str = "first", last: str = "last", **folds: Column) -> DataFrame:
    """Whole runs from pieces of runs in chunks (begins, ends: whether a piece does), with ``folds`` over a run's pieces.

    Pieces that begin and end are whole; only the others, two of a chunk at most, are put together channel by channel.
    """
    whole = F.col("begins") & F.col("ends")
    number = F.sum(F.col("begins").cast("int")).over(Window.partitionBy(*KEYS).orderBy(first))
    cut = pieces.where(~whole).withColumn("_run", number).groupBy(*KEYS, "_run")
    cut = cut.agg(F.min(first).alias(first), F.max(last).alias(last), *[c.alias(n) for n, c in folds.items()])
    return pieces.where(whole).select(*KEYS, first, last, *folds).unionByName(cut.select(*KEYS, first, last, *folds))
