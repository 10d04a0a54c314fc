"""Small Spark helpers of the corpus operators: reading tables, cutting lineage, naming columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where a local session names none (tests), a temporary one is set for it; on a cluster that is
    an error, since a machine's own folder is not shared.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="fibra-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(there)
    return there


def frozen(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once into the shared folder: lost executors recompute nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Like ``frozen``, as Parquet, so that later reads prune columns."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/fibra-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has in any case: the given ones, with underscores before them as needed."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_of(column: str = "doc_id"):
    """crc32 of a column's decimal text; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
