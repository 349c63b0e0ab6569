"""Connected components by min-label steps over edges, all in DataFrames."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir; only a single-machine session without it gets a folder of its own."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def components(edges: DataFrame) -> DataFrame:
    """edges: doc_id, a, b. Returns doc_id, node, root: the smallest node that edges of the document reach.

    Each round takes the smallest label among neighbours, then the label of that label, so long chains halve.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select("doc_id", "a", "b").union(edges.select("doc_id", "b", "a")).toDF("doc_id", "node", "other").distinct().checkpoint()
    labels = both.groupBy("doc_id", "node").agg(F.least(F.min("other"), F.first("node")).alias("root")).checkpoint()
    while True:
        near = both.join(labels.select("doc_id", F.col("node").alias("other"), "root"), ["doc_id", "other"]).groupBy("doc_id", "node").agg(F.min("root").alias("near"))
        low = labels.join(near, ["doc_id", "node"]).select("doc_id", "node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = low.select("doc_id", F.col("node").alias("root"), F.col("root").alias("next"))
        moved = low.join(jump, ["doc_id", "root"]).select("doc_id", "node", "was", F.least("root", "next").alias("root")).checkpoint()
        labels = moved.select("doc_id", "node", "root")
        if moved.where("was <> root").limit(1).count() == 0:
            return labels
