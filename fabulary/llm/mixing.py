"""Mixing sources to target weights by subset-sum budget fitting.

Weights go to the sources in code point order, null last, and repeat. The targets share a multiple of all sizes by
weight; a target stops at `cap` times its source's size and the excess goes to the others, again by weight: that is
one water level over the sources, found from running sums. Each source then takes whole passes over all its
documents and a budget that is left. Documents are counted by exact length; every length gives its proportional
share, and a bounded-knapsack dynamic programme over the lengths' remaining counts meets the rest to the word.
Which documents of a length are taken is decided by a seeded hash of the id, so reruns agree.

Cases: a null text has size 0; a null source is a source; sizes of 0 take nothing; a source without words has
target 0; an empty table gives no rows; repeated rows and rows without an id are documents of their own; columns
other than doc_id, source and text are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabulary.llm.common import WORD, cut, table, text_of

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2, 20_240_501
#: Words that the dynamic programme fits; budgets above are brought down to it by the lengths' largest remainders.
REACH = 1 << 16
#: Bits of the hash that spread one length of one source over bins, so that no task ranks a hot length alone.
BIN_BITS = 12


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, reach: int = REACH) -> np.ndarray:
    """How many documents of each length to take, each at most once, so that the lengths sum as near below budget as they can."""
    total = int((sizes * counts).sum())
    if total == 0 or budget <= 0:
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    share = counts * (budget / total)
    taken = np.minimum(np.floor(share).astype(np.int64), counts)
    while (left := budget - int((taken * sizes).sum())) < 0:  # only by a rounding of the share
        at = int(np.argmax(np.where(taken > 0, sizes, -1)))
        taken[at] -= 1
    for at in np.lexsort((sizes, -(share - taken))).tolist():
        if left <= reach:
            break
        if taken[at] < counts[at] and sizes[at] <= left - reach // 2:
            taken[at] += 1
            left -= int(sizes[at])
    for at in np.argsort(-sizes).tolist():  # lengths above the reach
        if left > reach and sizes[at]:
            more = min(int(counts[at] - taken[at]), (left - reach // 2) // int(sizes[at]))
            taken[at] += more
            left -= more * int(sizes[at])
    # Bounded knapsack: counts in binary parts; made_by names the part that first made a sum.
    made_by = np.full(min(left, reach) + 1, -1, np.int64)
    made_by[0] = 0
    parts: list[tuple[int, int]] = [(0, 0)]
    for at in np.argsort(-sizes).tolist():
        size, more = int(sizes[at]), int(counts[at] - taken[at])
        more = min(more, (len(made_by) - 1) // size) if size else 0
        many = 1
        while more > 0 and made_by[-1] < 0:
            many = min(many, more)
            step = size * many
            if step < len(made_by):
                fresh = (made_by[:-step] >= 0) & (made_by[step:] < 0)
                parts.append((at, many))
                made_by[step:][fresh] = len(parts) - 1
            more, many = more - many, many * 2
        if made_by[-1] >= 0:
            break
    best = int(np.flatnonzero(made_by >= 0)[-1])
    while best > 0:
        at, many = parts[made_by[best]]
        taken[at] += many
        best -= int(sizes[at]) * many
    return taken


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources: one row per source with `source` and `source_size`. Adds `target`. The windows run over sources, not documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = F.col("source_size") * float(cap)
    by_level = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    upto, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum(full).over(upto), F.lit(0.0))) / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    # `rest` is the level if this source and all behind it stay below their caps; the first source where that holds sets the level, and none behind it gives a higher one.
    levels = sources.withColumn("weight", weight).withColumn("full", full).withColumn("rest", rest)
    level = F.max(F.when(F.col("rest") * F.col("weight") <= F.col("full"), F.col("rest"))).over(everything)
    return levels.withColumn("target", F.least("full", F.coalesce(level * F.col("weight"), F.col("full")))).drop("weight", "full", "rest")


def _plan(lengths: pd.DataFrame, cap: float) -> pd.DataFrame:
    """One source's lengths: passes over all documents, and the documents of each length that are taken once more."""
    sizes, counts = lengths["size"].to_numpy(np.int64), lengths["n"].to_numpy(np.int64)
    total, target = int(lengths["source_size"].iloc[0]), float(lengths["target"].iloc[0])
    passes = min(int(target // total), int(cap)) if total else 0
    extra = fit(sizes, counts, round(target - passes * total)) if passes < cap else np.zeros_like(counts)
    return pd.DataFrame({"source_rank": lengths["source_rank"], "size": sizes, "passes": passes, "extra": extra})


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix takes the document)."""
    base = cut(docs.select("doc_id", "source", word_count(text_of()).alias("size")))
    sources = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    sources = cut(sources.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    known = base.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("doc_id", "b.source", "size", "source_rank", "source_size", "target")
    hashed = known.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bin", F.shiftrightunsigned("h", 64 - BIN_BITS))
    bins = hashed.groupBy("source_rank", "size", "bin").agg(F.count("*").alias("n"), F.max("source_size").alias("source_size"), F.max("target").alias("target"))
    lengths = bins.groupBy("source_rank", "size").agg(F.sum("n").alias("n"), F.max("source_size").alias("source_size"), F.max("target").alias("target"))
    plan = lengths.groupBy("source_rank").applyInPandas(lambda x: _plan(x, cap), "source_rank int, size long, passes int, extra long")
    before = F.sum("n").over(Window.partitionBy("source_rank", "size").orderBy("bin")) - F.col("n")
    quota = bins.select("source_rank", "size", "bin", before.alias("before")).join(plan, ["source_rank", "size"]).select("source_rank", "size", "bin", "passes", (F.col("extra") - F.col("before")).alias("quota"))
    nth = F.row_number().over(Window.partitionBy("source_rank", "size", "bin").orderBy("h", "doc_id"))
    ranked = hashed.withColumn("nth", nth).join(quota, ["source_rank", "size", "bin"])
    return ranked.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") + (F.col("nth") <= F.col("quota")).cast("int")).alias("copies"))


def repeat(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """docs with each row as often as the mix takes it.

    Rows that share id, source and size are alike to the mix and differ by one copy at most, so their sums say enough;
    the key is a struct, in which nulls are equal.
    """
    key = lambda size: F.struct(F.col("doc_id"), F.col("source"), size.alias("size"))
    plan = mix(docs, weights, share, cap, seed).groupBy(key(F.col("size")).alias("_mix_key"))
    plan = plan.agg(F.min("copies").alias("_mix_low"), (F.sum("copies") - F.min("copies") * F.count("*")).alias("_mix_more"))
    nth = F.row_number().over(Window.partitionBy("_mix_key").orderBy("text"))
    ranked = docs.withColumn("_mix_key", key(word_count(text_of()))).withColumn("_mix_nth", nth).join(plan, "_mix_key")
    copies = F.col("_mix_low") + (F.col("_mix_nth") <= F.col("_mix_more")).cast("int")
    return ranked.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes from it, repeats counted."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
