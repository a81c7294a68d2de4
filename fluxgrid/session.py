"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted side is broadcast.
BROADCAST_ROWS = 200_000
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build(master: str = "local[*]", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master)
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share; a local one only where the master is local and none is set."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not place:
        now = sc._jsc.sc().getCheckpointDir()
        if now.isEmpty() and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = now.get() if now.isDefined() else tempfile.mkdtemp(prefix="fluxgrid-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(place)
    return place


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, read back: computed once, whatever happens to an executor.  For tables far smaller than the input."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> DataFrame:
    """The written table with a broadcast hint if it is counted to be small; else the planner decides."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
