"""Tables that are cut off from their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; only a local master without that setting gets a folder of this machine."""
    sc = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(folder)
    elif sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut off from its lineage by files in the shared folder."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder of checkpoints."""
    shared_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder. A loop of many rounds needs this: what the optimiser knows of a checkpoint grows with each."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
