"""Where tables between steps are written: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of `df`, written once, so that what depends on how they were dealt doesn't change."""
    fresh(df.sparkSession, "")
    return df.checkpoint(eager=True)


def fresh(spark: SparkSession, name: str) -> str:
    """A new path under the session's checkpoint folder.

    Where that is unset, a temporary one is set on a local master; on a cluster that is an error.
    """
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return f"{own.get()}/{name}-{uuid.uuid4().hex}"
