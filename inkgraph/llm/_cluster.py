"""Helpers that keep plans safe on a cluster: reliable cuts of lineage, joins on hot keys, components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with more than 1/HOT_KEYS of all rows are hot; so there are fewer than HOT_KEYS of them.
HOT_KEYS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; without one a local session gets its own, a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="inkgraph-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], count: str, how: str = "inner") -> DataFrame:
    """Join rows with groups, which has one row a key and in `count` its number of rows.

    Keys with over 1/HOT_KEYS of all rows are fewer than HOT_KEYS: these few are broadcast.
    The others are shuffled; none of them can fill a task. `key`, a column or several, is never null here.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(total // HOT_KEYS, 100)
    few = groups.where(hot)
    n_hot = few.count()
    if n_hot == 0:
        return rows.join(groups, key, how)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(groups.where(~hot), key, how)
    return rows.join(F.broadcast(few), key, "inner").unionByName(rest)


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node.

    labels: (node, label) with any label of the node's component that is not above node.
    links: (a, b), both directions, with a bounded number of links a node.
    Rounds of neighbour minimum and label jump; each round's labels are cut to the shared folder,
    so a lost executor costs no more than one round.
    """
    while True:
        near = links.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        low = labels.select("node", "label", F.col("label").alias("old")).unionByName(near).groupBy("node").agg(F.min("label").alias("low"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        moved = low.join(jump, "low", "left").select("node", "old", F.least("low", F.coalesce("far", "low")).alias("label"))
        new = cut(moved.select("node", "label", (F.col("label") != F.col("old")).alias("changed")))
        labels = new.select("node", "label")
        if not new.where("changed").head(1):
            return labels
