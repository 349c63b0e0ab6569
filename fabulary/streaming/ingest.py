"""New manuscripts as a stream: files that appear in a folder are split, measured and stored once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fabulary.plans.store import cache_misses, document_hashes, read_or_empty
from fabulary.sources import plaintext

RESULTS = "project_id STRING, dimension STRING, input_hash STRING, payload STRING"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, analyse: Callable[[DataFrame], DataFrame], dimensions: int = 1) -> StreamingQuery:
    """Analyses texts whose contents have no stored results and appends the results. analyse: blocks to rows of RESULTS."""
    files = spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY").option("recursiveFileLookup", "true").load(folder)

    def batch(new: DataFrame, batch_id: int) -> None:
        texts = plaintext.decoded_files(new)
        blk = plaintext.blocks(texts)
        missing = cache_misses(document_hashes(blk), read_or_empty(new.sparkSession, out, RESULTS), dimensions)
        analyse(blk.join(missing.select("doc_id"), "doc_id", "left_semi")).write.mode("append").parquet(out)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
