"""Connected components by grouped minima."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session takes one of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found and sc.master.split("[")[0] == "local":
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df computed once, written by checkpoint() to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df computed once, as a table in the shared folder, with a plan that holds nothing of what made it."""
    path = f"{shared_folder(df.sparkSession)}/seatrack-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): the least node that each node of edges(a, b) is connected to.

    Labels take the minimum over neighbours and then their label's label, until
    none changes. checkpoint() cuts the lineage of each round in the shared folder.
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = both.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"))
    for _ in range(max_rounds):
        reach = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("m"))
        lower = labels.join(reach, labels.node == reach.a).select("node", "root", F.least("root", "m").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("root").alias("far"))
        after = durable(lower.join(jump, "new", "left").select("node", F.col("root").alias("old"), F.least("new", F.coalesce("far", "new")).alias("root")))
        if after.where("old <> root").isEmpty():
            break
        labels = after.select("node", "root")
    else:
        raise RuntimeError("components did not settle")
    return after.select("node", "root")
