"""Reliable cuts of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; without one a local session gets its own, a cluster an error."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="inkgraph-cut-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table below the checkpoint folder and go on from there.

    Unlike a checkpoint's, a table's size is known from its files. A checkpoint takes over the size that was guessed for its plan, and as a join is guessed to
    have the product of its sides, the guesses of a chain of joins and checkpoints grow until planning takes minutes.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
