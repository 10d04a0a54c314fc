"""Electrode catalog and annotations of channels."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Muscles of the published recommendation; all with 20 mm between electrodes.
MUSCLES = (
    "Trapezius descendens", "Trapezius transversalis", "Trapezius ascendens", "Deltoideus anterior",
    "Deltoideus medius", "Deltoideus posterior", "Biceps brachii", "Triceps brachii", "Brachioradialis",
    "Flexor carpi radialis", "Extensor carpi radialis", "Pectoralis major", "Latissimus dorsi",
    "Serratus anterior", "Rectus abdominis", "Obliquus externus", "Obliquus internus",
    "Erector spinae longissimus", "Erector spinae iliocostalis", "Multifidus", "Gluteus maximus",
    "Gluteus medius", "Rectus femoris", "Vastus lateralis", "Vastus medialis", "Biceps femoris",
    "Semitendinosus", "Tibialis anterior", "Gastrocnemius medialis", "Gastrocnemius lateralis", "Soleus",
    "Peroneus longus",
)
DISTANCE_MM = 20.0
FIELDS = ("muscle", "placement", "orientation", "ied_mm", "reference", "side")


def catalog(spark: SparkSession) -> DataFrame:
    """muscle, location, orientation, ied_mm; the published texts of location and orientation are not held here: NULL."""
    rows = [(m, None, None, DISTANCE_MM) for m in MUSCLES]
    return spark.createDataFrame(rows, "muscle string, location string, orientation string, ied_mm double")


def _key(c):
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def substring_distance(pattern: str, text: str) -> int:
    """The least number of insertions, deletions and substitutions that turn ``pattern`` into some stretch of ``text``."""
    row = [0] * (len(text) + 1)  # a stretch may begin anywhere
    for i, p in enumerate(pattern, 1):
        last, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j - 1] + (p != t), last[j] + 1, row[j - 1] + 1))
    return min(row)  # and end anywhere


def near_matches(muscle: str, share: float = 0.35) -> list[str]:
    """Muscles of the catalog with a stretch that differs from ``muscle`` in at most this share of its letters, rounded up; case aside."""
    return [m for m in MUSCLES if substring_distance(muscle.lower(), m.lower()) <= math.ceil(share * len(muscle))]


def annotate(channels: DataFrame, **fields) -> DataFrame:
    """Channels with muscle, placement, orientation, ied_mm, reference and side set.

    Each field is one value for all targeted channels or a list of one for each; ``channel`` names the targets
    (default: all).  Given values win, what is missing comes from the catalog; other channels stay as they are.
    An unknown muscle is kept, with a warning.
    """
    spark = channels.sparkSession
    all_ = [r["channel"] for r in channels.select("channel").distinct().orderBy("channel").collect()]
    target = fields.pop("channel", None) or all_
    target = [target] if isinstance(target, int) else list(target)
    if bad := [c for c in target if c not in all_]:
        raise ValueError(f"channel {bad[0]} out of range")
    if unknown := set(fields) - set(FIELDS):
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    each = {}
    for name in FIELDS:
        v = fields.get(name)
        v = v if isinstance(v, (list, tuple)) else [v] * len(target)
        if len(v) not in (1, len(target)):
            raise ValueError(f"{name} must have length 1 or {len(target)}")
        each[name] = list(v) * (len(target) if len(v) == 1 else 1)
    plain = {"".join(ch for ch in m.lower() if ch.isalpha()): m for m in MUSCLES}
    for m in each["muscle"]:
        if m is not None and "".join(ch for ch in m.lower() if "a" <= ch <= "z") not in plain:
            near = near_matches(m)
            warnings.warn(f"'{m}' is not in the electrode catalog" + (f"; did you mean {', '.join(near[:5])}?" if near else ""), stacklevel=2)
    rows = [(c, *(float(x) if n == "ied_mm" and x is not None else x for n, x in zip(FIELDS, values))) for c, *values in zip(target, *(each[n] for n in FIELDS))]
    given = spark.createDataFrame(rows, "channel int, muscle string, placement string, orientation string, ied_mm double, reference string, side string")
    known = catalog(spark).select(_key("muscle").alias("_key"), F.col("location").alias("_location"), F.col("orientation").alias("_orientation"), F.col("ied_mm").alias("_ied"))
    filled = given.withColumn("_key", _key("muscle")).join(F.broadcast(known), "_key", "left")
    filled = filled.select("channel", F.lit(True).alias("_set"), "muscle", F.coalesce("placement", "_location").alias("placement"), F.coalesce("orientation", "_orientation").alias("orientation"), F.coalesce("ied_mm", "_ied").alias("ied_mm"), "reference", "side")
    filled = filled.select("channel", "_set", *[F.col(c).alias(f"_{c}") for c in FIELDS])
    out = channels.join(F.broadcast(filled), "channel", "left")
    for c in FIELDS:
        before = F.col(f"seniam_{c}") if f"seniam_{c}" in channels.columns else F.lit(None).cast("double" if c == "ied_mm" else "string")
        out = out.withColumn(f"seniam_{c}", F.when(F.col("_set"), F.col(f"_{c}")).otherwise(before))
    return out.drop("_set", *(f"_{c}" for c in FIELDS))


def annotations(channels: DataFrame) -> DataFrame:
    """channel, label and the electrode fields, NULL where unset."""
    kinds = {"ied_mm": "double"}
    have = set(channels.columns)
    label = F.col("label") if "label" in have else F.concat(F.lit("ch"), F.col("channel"))
    return channels.select("channel", label.alias("label"), *[(F.col(f"seniam_{c}") if f"seniam_{c}" in have else F.lit(None).cast(kinds.get(c, "string"))).alias(c) for c in FIELDS])
