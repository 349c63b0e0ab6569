"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as every word rule of this subpackage knows it: blank and the bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, a null text as the empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def crc_mod(name: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % n


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names a shared folder in spark.checkpoint.dir; only a single-machine session without one gets its own."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there: what follows neither repeats the work nor needs the executors that did it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounds(values: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Where slices of at most so many bytes begin and end; one long value stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = done = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, to
        at, done = to, int(ends[to - 1])


def parts(batches: Iterator[pa.Array], most: int = 1 << 18) -> Iterator[pa.Array]:
    """The values of all batches, in slices of at most so many bytes (one long value alone): workers hold no more than that as Python objects."""
    for batch in batches:
        for at, to in bounds(batch, most):
            yield batch.slice(at, to - at)
    pa.default_memory_pool().release_unused()
