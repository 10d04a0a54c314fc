"""Frames over samples and hopping windows, as plain window and Generate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fibra.sources.signals import KEYS


def by_sample():
    return Window.partitionBy(*KEYS).orderBy("sample")


def centered(half: int):
    return by_sample().rowsBetween(-half, half)


def geometry(window_sec: float, overlap: float, sr: float) -> tuple[int, int]:
    """Samples of a window and of a step; halves round to even."""
    if window_sec <= 0:
        raise ValueError("window_sec must be positive")
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be in [0, 1)")
    win = int(round(window_sec * sr))
    return max(1, win), max(1, int(round(win * (1 - overlap))))


def hopping(samples: DataFrame, win: int, step: int) -> DataFrame:
    """A row for each sample and window ``k`` (from 0) that holds it: samples k*step+1 to k*step+win.

    Group by recording, channel and k, and keep groups of ``win`` rows for complete windows.
    """
    at = F.col("sample") - 1
    first = F.greatest(F.lit(0), F.ceil((at - win + 1) / step)).cast("long")
    return samples.withColumn("k", F.explode(F.sequence(first, F.floor(at / step).cast("long")))) if step <= win else samples.withColumn("k", F.floor(at / step).cast("long")).where(at - F.col("k") * step < win)


def complete(grouped: DataFrame, win: int, count: str = "n") -> DataFrame:
    return grouped.where(F.col(count) == win).drop(count)


def runs(df: DataFrame, active: str) -> DataFrame:
    """The rows where ``active`` holds, with ``run``: the number of the unbroken stretch they are in."""
    w = by_sample()
    start = F.col(active) & ~F.coalesce(F.lag(active).over(w), F.lit(False))
    return df.withColumn("run", F.sum(start.cast("int")).over(w)).where(F.col(active))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.when(b != 0, a / b)
