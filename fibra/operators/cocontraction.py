"""Co-contraction of an agonist-antagonist pair, and a task summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fibra.functions.chunks import CHUNK, attached, chunk_of
from fibra.sources.signals import KEYS, check_channels

METHODS = ("falconer_winter", "rudolph", "frost")
#: Activity codes of the tasks.
TASKS = {"reaching": "d445", "drinking": "d560", "feeding": "d550", "dressing": "d540", "grooming": "d520"}


def _pair(samples: DataFrame, agonist: int, antagonist: int, assay: str) -> DataFrame:
    """Both channels of each sample side by side, rectified: one pre-aggregation, no self-join."""
    kept = samples.where(F.col("channel").isin(agonist, antagonist))
    value = lambda c: F.max(F.when(F.col("channel") == c, F.abs(assay)))
    return kept.groupBy("recording_id", "sample").agg(value(agonist).alias("a"), value(antagonist).alias("b"))


def _index(method: str):
    a, b = F.col("a"), F.col("b")
    both = a.isNotNull() & b.isNotNull()
    low = F.when(both, F.least(a, b))
    high = F.when(both, F.greatest(a, b))
    if method == "falconer_winter":
        total = F.sum(F.when(both, a + b))
        return F.when(total > 0, 200 * F.sum(low) / total).otherwise(0.0)
    if method == "rudolph":
        return F.avg(F.when(high > 0, low / high * (low + high)).when(both, 0.0))
    if method == "frost":
        return F.avg(F.when(a + b > 0, 2 * low / (a + b)).when(both, 0.0)) * 100
    raise ValueError(f"unknown method: {method}")


def cocontraction(
    samples: DataFrame,
    agonist: int | str,
    antagonist: int | str,
    method: str = "falconer_winter",
    normalize: bool = True,
    window: int | None = None,
    assay: str = "env",
    window_sec: float | None = None,
    sr: float | None = None,
    channels: DataFrame | None = None,
    chunk: int | None = None,
) -> DataFrame:
    """recording_id and index; with ``window`` (samples) or ``window_sec`` one row for each disjoint complete window, with time_sec where ``sr`` is given.

    With ``normalize`` both are divided by their largest value in the whole recording.  Channels are numbers, or labels
    of the table ``channels``; one without any sample is an error, a recording that lacks one has no index (NULL).
    """
    if window_sec is not None:
        if sr is None or window_sec <= 0:
            raise ValueError("window_sec must be positive and needs the sampling rate")
        window = max(1, int(round(window_sec * sr)))
    agonist, antagonist = check_channels(samples, agonist, antagonist, channels=channels)
    df = _pair(samples, agonist, antagonist, assay)
    if normalize:
        top = df.groupBy("recording_id").agg(F.max("a").alias("_ta"), F.max("b").alias("_tb"))
        df = attached(df.withColumn("_chunk", chunk_of(chunk or CHUNK)), top, df, chunk, ["recording_id"])
        for c, t in (("a", F.col("_ta")), ("b", F.col("_tb"))):
            df = df.withColumn(c, F.when(t > 0, F.col(c) / t).otherwise(F.col(c)))
    index = F.when((F.count("a") > 0) & (F.count("b") > 0), _index(method)).alias("index")
    if window is None:
        return df.groupBy("recording_id").agg(index)
    out = df.groupBy("recording_id", F.floor((F.col("sample") - 1) / window).alias("k")).agg(F.count(F.lit(1)).alias("n"), index)
    time = [] if sr is None else [(F.col("k") * window / sr).alias("time_sec")]
    return out.where(F.col("n") == window).select("recording_id", (F.col("k") + 1).alias("window"), *time, "index")


def task_summary(
    samples: DataFrame,
    agonist: int | str,
    antagonist: int | str,
    task: str,
    mvc: DataFrame | None = None,
    method: str = "falconer_winter",
    active_frac: float = 0.2,
    assay: str = "env",
    channels: DataFrame | None = None,
) -> DataFrame:
    """Index, peak, mean and active share of both muscles: of the envelope, or in percent of a reference's largest value if given."""
    if task not in TASKS:
        raise ValueError(f"task '{task}' not found")
    agonist, antagonist = check_channels(samples, agonist, antagonist, channels=channels)
    index = cocontraction(samples, agonist, antagonist, method, assay=assay)
    kept = samples.where(F.col("channel").isin(agonist, antagonist))
    level = kept.groupBy(*KEYS).agg(F.max(assay).alias("_max"), F.min(assay).alias("_min"))
    scale = F.lit(1.0)
    if mvc is not None:
        level = level.join(mvc.groupBy(*KEYS).agg(F.max(assay).alias("_ref")), KEYS, "left")
        scale = F.when(F.col("_ref") != 0, 100 / F.col("_ref"))
    # a reference below zero turns the order
    level = level.withColumn("_scale", scale).withColumn("_peak", F.greatest(F.col("_max") * F.col("_scale"), F.col("_min") * F.col("_scale")))
    scaled = attached(kept.withColumn("_chunk", chunk_of(CHUNK)), level, kept).withColumn("_v", F.col(assay) * F.col("_scale"))
    active = F.when(F.max("_peak") > 0, F.avg((F.col("_v") > active_frac * F.col("_peak")).cast("double")))
    each = scaled.groupBy(*KEYS).agg(F.max("_v").alias("peak"), F.avg("_v").alias("mean"), active.alias("active_fraction"))
    role = F.when(F.col("channel") == agonist, "agonist").otherwise("antagonist")
    unit = F.lit("%MVC" if mvc is not None else "envelope")
    return each.join(index, "recording_id").select("recording_id", F.lit(task).alias("task"), F.lit(TASKS[task]).alias("code"), role.alias("muscle"), F.col("index").alias("cci"), "peak", "mean", "active_fraction", unit.alias("unit"))
