"""Stored results: content hashes, cache misses, upserts by partition, and cascading deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Part of every hash; a new version of the measures makes all cached results stale.
VERSION = "v2"


def _told(blk: DataFrame, name: str) -> Column:
    """A value with its length in front; nested values as JSON, null as a dash."""
    nested = blk.schema[name].dataType.typeName() in ("array", "struct", "map")
    value = F.to_json(name) if nested else F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def document_hashes(blk: DataFrame) -> DataFrame:
    """doc_id, hash: all that the measures read of the blocks, in order; the ids of the document and its project are no part of it.

    Each value counts with its length, so text can't move over the border of a field or a block unseen.
    """
    read = sorted(c for c in blk.columns if c not in ("project_id", "doc_id", "seq", "seg", "label", "n_segments", "chunked", "batch"))
    digests = blk.select("doc_id", "seq", F.sha2(F.concat(*[_told(blk, c) for c in read]), 256).alias("h"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("seq", "h"))), lambda x: x["h"])
    return digests.groupBy("doc_id").agg(F.sha2(F.concat(F.lit(VERSION), F.array_join(each, "")), 256).alias("hash"))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def cache_misses(hashes: DataFrame, stored: DataFrame, dimensions: int = 15) -> DataFrame:
    """Documents whose hash has no complete set of stored dimensions."""
    whole = stored.groupBy("input_hash").agg(F.countDistinct("dimension").alias("n")).where(F.col("n") >= dimensions)
    return hashes.join(whole, hashes["hash"] == whole["input_hash"], "left_anti")


def upsert(rows: DataFrame, path: str, *keys: str) -> None:
    """Replaces the partitions of the keys that occur in rows, and no others. Spark stages the files and renames them at the end."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def latest(reports: DataFrame) -> DataFrame:
    """The newest report of each project."""
    return reports.groupBy("project_id").agg(F.max_by(F.struct(*[c for c in reports.columns if c != "project_id"]), "created_at").alias("r")).select("project_id", "r.*")


def without_project(rows: DataFrame, project_id: str) -> DataFrame:
    """rows of the other projects; the registry of entities is kept apart and outlives projects."""
    return rows.where(F.col("project_id") != project_id)


def concerns_by_severity(concerns: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low")]), F.col("severity"))
    return concerns.orderBy("project_id", rank, "id")
