"""Signals as long tables.

``samples``: recording_id, channel (1-based), sample (1-based, without gaps) and one DOUBLE column
per assay (``raw``, ``env``, ...).  NaN is turned to NULL on the way in, so aggregates and frames skip it.
"""

from __future__ import annotations

import inspect
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fibra.functions.numbering import numbered

KEYS = ["recording_id", "channel"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def clean(column: str | Column) -> Column:
    """A double column with NaN as NULL."""
    c = F.col(column) if isinstance(column, str) else column
    c = c.cast("double")
    return F.when(F.isnan(c), None).otherwise(c)


def from_table(df: DataFrame, channel: Column, order: list[Column], value: Column, recording: Column | None = None, rows: int | None = None) -> DataFrame:
    """Samples from any table: a channel number, the order of samples within it, and a value; ``raw`` is ``env`` less its channel's mean.

    ``rows``: of a range of samples that are numbered together (see ``numbered``).
    """
    keyed = df.select((recording if recording is not None else F.lit("r1")).alias("recording_id"), channel.cast("int").alias("channel"), clean(value).alias("env"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    out = numbered(keyed, KEYS, [f"_o{i}" for i in range(len(order))], mean="env", rows=rows)
    return out.withColumn("raw", F.col("env") - F.col("_mean")).select(*KEYS, "sample", "raw", "env")


def event_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type and its channel: its place in alphabetical order."""
    kinds = table(spark, sf_dir, "events").select("event_type").distinct()
    return kinds.select("event_type", F.row_number().over(Window.orderBy("event_type")).cast("int").alias("channel"))


def event_signal(spark: SparkSession, sf_dir: str, where: str | None = None, recording: Column | None = None, rows: int | None = None) -> DataFrame:
    """The events as a signal: a channel for each kind, samples by time, all one recording or one for each value of a column."""
    events = table(spark, sf_dir, "events")
    if where:
        events = events.where(where)
    events = events.join(F.broadcast(event_channels(spark, sf_dir)), "event_type")
    return from_table(events, F.col("channel"), [F.col("ts"), F.col("event_id")], F.col("value"), recording, rows)


def aligned(samples: DataFrame) -> DataFrame:
    """Samples up to the length of each recording's shortest channel (channels are counted, which needs no numbers)."""
    ends = samples.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).groupBy("recording_id").agg(F.min("_n").alias("_n"))
    # a row for each stretch of samples, so that one long recording is no hot key
    stretches = ends.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("_n", 16))))
    out = samples.withColumn("_part", F.shiftright("sample", 16)).join(stretches, ["recording_id", "_part"])
    return out.where("sample <= _n").select(*samples.columns)


def line_signal(spark: SparkSession, sf_dir: str, rows: int | None = None) -> DataFrame:
    """Order lines as a signal of seven channels, for volume."""
    t = table(spark, sf_dir, "lineitem")
    return from_table(t, F.col("l_linenumber"), [F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")], F.col("l_extendedprice"), rows=rows)


#: One row for each operator that made an assay, in order.
PROVENANCE = "step int, activity string, params map<string, string>, input_assay string, output_assay string, agent string"
AGENT = "fibra"


@dataclass(frozen=True)
class SignalFrame:
    """Samples with their channels, sampling rate and provenance; operators return a new one."""

    samples: DataFrame
    sampling_rate: float
    default_assay: str = "raw"
    channels: DataFrame | None = None
    provenance: tuple[dict, ...] = field(default=())

    def apply(self, operator, **kwargs) -> SignalFrame:
        """The frame with what ``operator(samples, ...)`` adds, and a step of its provenance.

        The sampling rate and the default assay are filled in where the operator asks for them (sr, assay) and they are
        not given (by name).  Recorded are the operator's name and its plain arguments, defaults included; what it calls itself is not.
        """
        asked = inspect.signature(operator).parameters
        if "sr" in asked:
            kwargs.setdefault("sr", self.sampling_rate)
        if "assay" in asked:
            kwargs.setdefault("assay", self.default_assay)
        bound = inspect.signature(operator).bind(self.samples, **kwargs)
        bound.apply_defaults()
        samples = operator(*bound.args, **bound.kwargs)
        params = {k: v for k, v in list(bound.arguments.items())[1:]}
        return self.with_assay(samples, operator.__name__, **params)

    def with_assay(self, samples: DataFrame, activity: str, **arguments) -> SignalFrame:
        kept = {k: v for k, v in arguments.items() if isinstance(v, (int, float, str, bool)) or v is None}
        return replace(self, samples=samples, provenance=(*self.provenance, {"activity": activity, **kept}))

    def history(self) -> DataFrame:
        """The provenance as a table (see ``PROVENANCE``)."""
        rows = []
        for i, step in enumerate(self.provenance):
            params = {k: str(v) for k, v in step.items() if k != "activity" and v is not None}
            rows.append((i + 1, step["activity"], params, params.get("assay"), params.get("out"), AGENT))
        return self.samples.sparkSession.createDataFrame(rows, PROVENANCE)

    def joined(self, other: SignalFrame) -> SignalFrame:
        """Both frames' assays on the samples that both have; of the other's steps those that this one lacks come after its own."""
        new = [c for c in other.samples.columns if c not in self.samples.columns]
        samples = self.samples.join(other.samples.select(*KEYS, "sample", *new), [*KEYS, "sample"])
        more = tuple(step for step in other.provenance if step not in self.provenance)
        return replace(self, samples=samples, provenance=(*self.provenance, *more))

    def save(self, path: str) -> None:
        """Writes samples, channels, provenance and the rate below ``path``; an existing one is an error."""
        path = path.rstrip("/")
        self.samples.write.parquet(f"{path}/samples")
        self.history().coalesce(1).write.parquet(f"{path}/provenance")
        if self.channels is not None:
            self.channels.write.parquet(f"{path}/channels")
        about = [(float(self.sampling_rate), self.default_assay, self.channels is not None)]
        self.samples.sparkSession.createDataFrame(about, "sampling_rate double, default_assay string, channels boolean").coalesce(1).write.parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SignalFrame:
        """What ``save`` wrote; parameters of its steps come back as text."""
        path = path.rstrip("/")
        about = spark.read.parquet(f"{path}/about").first()
        steps = spark.read.parquet(f"{path}/provenance").orderBy("step").collect()
        channels = spark.read.parquet(f"{path}/channels") if about["channels"] else None
        return cls(spark.read.parquet(f"{path}/samples"), about["sampling_rate"], about["default_assay"], channels, tuple({"activity": r["activity"], **r["params"]} for r in steps))

    def __repr__(self) -> str:
        assays = [c for c in self.samples.columns if c not in (*KEYS, "sample")]
        return f"SignalFrame({self.sampling_rate:g} Hz, assays {', '.join(assays)}, {len(self.provenance)} steps)"


def check_channels(samples: DataFrame, *wanted: int | str, channels: DataFrame | None = None) -> list[int]:
    """Channels by number, or by label where a table of ``channels`` (channel, label) is given; an error if one has no samples."""
    numbers = [w if isinstance(w, int) else channel_number(channels, w) if channels is not None else None for w in wanted]
    if None in numbers:
        raise ValueError(f"channel '{wanted[numbers.index(None)]}' not found: labels need the table of channels")
    there = samples.where(F.col("channel").isin(numbers)).select("channel").distinct().collect()
    for missing in set(numbers) - {r["channel"] for r in there}:
        raise ValueError(f"channel {missing} out of range")
    return numbers


def channel_number(channels: DataFrame, wanted: int | str) -> int:
    """A channel by number or label, checked against the channel table (one row a channel)."""
    if isinstance(wanted, str):
        found = [r["channel"] for r in channels.where(F.col("label") == wanted).select("channel").distinct().limit(2).collect()]
        if not found:
            raise ValueError(f"channel '{wanted}' not found")
        return found[0]
    if not channels.where(F.col("channel") == int(wanted)).limit(1).count():
        raise ValueError(f"channel {wanted} out of range")
    return int(wanted)
