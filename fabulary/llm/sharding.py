"""Sharding: minimax contiguous partition of atomic groups.

Groups are equal texts. A group that is heavier than an even share gets a shard alone (there are fewer such groups
than shards). The others are ordered by a hash of their text; the smallest capacity under which a greedy walk needs
no more than the shards that are left is found by binary search, and the cuts are those of that walk.

The walk never sees all groups: it runs over cells, the sums of groups that share the leading bits of the hash. For
any capacity the cells bound each cut from both sides; only the cells between those bounds are split further, so the
driver holds a few hundred thousand sums whatever the number of documents, and the answer is exact.

Cases: a null text counts no bytes and is grouped with the empty one; repeated rows are rows of their own in one
group; with fewer groups than shards the last shards stay empty; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabulary.llm.common import cut, table, text_of

SHARDS, OVERHEAD = 24, 8
#: Leading hash bits of the first cells, and the bits that one refinement adds.
FIRST_BITS, MORE_BITS = 12, 8
#: Slots are numbered within so many spans of each shard, so that no task orders a whole shard.
SPANS = 512


def _cells(groups: DataFrame, bits: int, within: list[int] | None, parent_bits: int) -> list[tuple]:
    """(first key, weight, groups, cell) of the cells of that many leading bits, or of those inside some parent cells."""
    rows = groups
    if within is not None:
        rows = rows.where(F.shiftright("key", 64 - parent_bits).isin(within))
    made = rows.groupBy(F.shiftright("key", 64 - bits).alias("cell")).agg(F.min("key").alias("first"), F.sum("weight").alias("weight"), F.count("*").alias("n"))
    return [(r["first"], r["weight"], r["n"], r["cell"], bits) for r in made.collect()]


def _walk(ends: np.ndarray, capacity: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the greedy cuts: the last known boundary within reach, and the farthest that any boundary could be."""
    low, high, lows, highs = 0, 0, [], []
    for _ in range(shards):
        low = int(ends[np.searchsorted(ends, low + capacity, side="right") - 1])
        high = min(high + capacity, int(ends[-1]))
        lows.append(low)
        highs.append(high)
    return np.array(lows), np.array(highs)


def _capacity(ends: np.ndarray, least: int, shards: int) -> int:
    """The smallest capacity under which the walk over known boundaries ends within the shards."""
    low, high = least, int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        if _walk(ends, mid, shards)[0][-1] >= ends[-1]:
            high = mid
        else:
            low = mid + 1
    return low


def cut_keys(groups: DataFrame, shards: int) -> list[int]:
    """First keys of the second and later shards. groups: `key` LONG, in whose order they lie, and `weight`."""
    cells = sorted(_cells(groups, FIRST_BITS, None, 0))
    while cells:
        ends = np.concatenate([[0], np.cumsum([c[1] for c in cells])])
        least = max(-(-int(ends[-1]) // shards), max((c[1] for c in cells if c[2] == 1), default=0))
        best = _capacity(ends, least, shards)
        lows, highs = _walk(ends, least, shards)[0], _walk(ends, best, shards)[1]
        # A boundary inside a cell matters if the cell overlaps what some cut can reach.
        open_cells = set()
        for a, b in zip(lows.tolist(), highs.tolist()):
            first, last = np.searchsorted(ends, a, side="right") - 1, np.searchsorted(ends, b, side="left")
            open_cells.update(i for i in range(max(first, 0), min(last + 1, len(cells))) if cells[i][2] > 1 and cells[i][4] < 64)
        if not open_cells:
            starts = _walk(ends, best, shards)[0]
            return [cells[i][0] for i in np.searchsorted(ends, starts, side="left").tolist() if i < len(cells)]
        keep = [c for i, c in enumerate(cells) if i not in open_cells]
        for bits in sorted({cells[i][4] for i in open_cells}):
            keep += _cells(groups, min(bits + MORE_BITS, 64), [cells[i][3] for i in open_cells if cells[i][4] == bits], bits)
        cells = sorted(keep)
    return []


def assign(docs: DataFrame, shards: int = SHARDS, size: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. Equal texts share a shard; slots of a shard run from 0 without gaps."""
    size = F.octet_length(text_of()) + OVERHEAD if size is None else size
    base = cut(docs.select("doc_id", size.cast("long").alias("size"), F.crc32(text_of()).alias("text_crc32"), F.xxhash64(text_of()).alias("key")))
    groups = cut(base.groupBy("key").agg(F.sum("size").alias("weight")))
    total, left, alone = groups.agg(F.sum("weight")).first()[0] or 0, shards, []
    # At most `shards - 1` groups can be heavier than an even share; each round looks for those above what is left.
    while True:
        heavy = groups.where((F.col("weight") * left > total) & ~F.col("key").isin(alone)).orderBy(F.desc("weight"), "key").limit(left - 1).collect() if left > 1 else []
        if not heavy:
            break
        alone += [r["key"] for r in heavy]
        total, left = total - sum(r["weight"] for r in heavy), left - len(heavy)
    cuts = cut_keys(groups.where(~F.col("key").isin(alone)), left)
    shard = F.lit(len(alone))
    for key in cuts:
        shard = shard + (F.col("key") >= key).cast("int")
    for nth, key in enumerate(alone):
        shard = F.when(F.col("key") == key, F.lit(nth)).otherwise(shard)
    placed = base.withColumn("shard", shard).withColumn("span", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SPANS)))
    counts = placed.groupBy("shard", "span").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "span", (F.sum("n").over(Window.partitionBy("shard").orderBy("span")) - F.col("n")).alias("start"))
    nth = F.row_number().over(Window.partitionBy("shard", "span").orderBy("key", "doc_id"))
    # `starts` has at most shards x SPANS rows.
    return placed.withColumn("nth", nth).join(F.broadcast(starts), ["shard", "span"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).alias("slot"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts all documents into 24 shards of near equal bytes."""
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
