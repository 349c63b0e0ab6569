"""Dialogue: spoken units, their share of the text, and long runs with or without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions.text import dash_units, quote_units, ratio, visible_chars
from fabulary.operators.segments import runs

# Fixed values.
MIN_SEGMENT, SILENT, FLOODED, DOMINANT, SPARSE, HEAVY, MONOLOGUE, SAMPLES, EXCERPT = 300, 0.05, 0.80, 0.5, 0.12, 0.55, 300, 8, 40

UNIT_BUCKETS = (("1-9", 1, 9), ("10-29", 10, 29), ("30-99", 30, 99), ("100-299", 100, 299), ("300+", 300, 2**31 - 1))


def units(blk: DataFrame) -> DataFrame:
    """One row per spoken unit: doc_id, seq, nth, kind (quote or dash), chars and the start of what is said."""
    kinds = lambda c, k: F.transform(c, lambda u: F.struct(F.lit(k).alias("kind"), visible_chars(u).alias("chars"), F.substring(F.trim(u), 1, EXCERPT).alias("excerpt")))
    both = F.concat(kinds(quote_units(F.col("content")), "quote"), kinds(dash_units(F.col("content")), "dash"))
    keep = [c for c in ("doc_id", "seq", "seg", "label") if c in blk.columns]
    return blk.select(*keep, F.posexplode(both).alias("nth", "u")).select(*keep, "nth", "u.kind", "u.chars", "u.excerpt")


def block_shares(blk: DataFrame) -> DataFrame:
    """Visible and spoken characters of each block, and the share of the latter."""
    spoken = lambda c: F.aggregate(F.transform(c, visible_chars), F.lit(0), lambda a, x: a + x)
    said = spoken(quote_units(F.col("content"))) + spoken(dash_units(F.col("content")))
    chars = visible_chars(F.col("content"))
    keep = [c for c in ("doc_id", "seq", "seg", "label", "n_segments") if c in blk.columns]
    return blk.select(*keep, chars.alias("chars"), F.least(said, chars).alias("dialogue_chars"), ratio(F.least(said, chars), chars).alias("share"))


def longest_run(shares: DataFrame, flag: str, name: str) -> DataFrame:
    """The longest run of blocks for which the flag holds, the one with more characters of equals."""
    each = runs(shares, flag, "seq").groupBy("doc_id", "run").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    best = each.groupBy("doc_id").agg(F.max(F.struct("n", "chars")).alias("m"))
    return best.select("doc_id", F.col("m.n").alias(f"longest_{name}_run"), F.col("m.chars").alias(f"longest_{name}_chars"))


def curve(shares: DataFrame) -> DataFrame:
    """One point per segment that holds a block."""
    made = shares.groupBy("doc_id", "seg", "label").agg(F.sum("chars").alias("char_count"), F.sum("dialogue_chars").alias("dialogue_chars"), F.count("*").alias("blocks"), F.sum((F.col("dialogue_chars") > 0).cast("int")).alias("blocks_with_dialogue"))
    return made.withColumn("share", ratio(F.col("dialogue_chars"), F.col("char_count")))


def segment_extremes(points: DataFrame) -> DataFrame:
    """Over segments long enough: silent and flooded ones, the peak (last of equals), the quietest (first of equals) and the spread."""
    long = points.where(F.col("char_count") >= MIN_SEGMENT)
    return long.groupBy("doc_id").agg(
        F.sum((F.col("share") < SILENT).cast("int")).alias("silent_segments"),
        F.sum((F.col("share") > FLOODED).cast("int")).alias("flooded_segments"),
        F.max_by("label", F.struct("share", "seg")).alias("peak_section"),
        F.min_by("label", F.struct("share", "seg")).alias("quietest_section"),
        (F.max("share") - F.min("share")).alias("spread"),
    )


def verdict(share: Column, unit_count: Column) -> Column:
    return F.when(unit_count == 0, "none").when(share < SPARSE, "sparse").when(share > HEAVY, "heavy").otherwise("balanced")


def stats(blk: DataFrame) -> DataFrame:
    """One row per document. Dialogue has no score."""
    shares = block_shares(blk)
    total = shares.groupBy("doc_id").agg(F.sum("chars").alias("char_count"), F.sum("dialogue_chars").alias("dialogue_chars"), F.count("*").alias("blocks"), F.sum((F.col("dialogue_chars") > 0).cast("int")).alias("blocks_with_dialogue"))
    u = units(blk).groupBy("doc_id").agg(F.count("*").alias("unit_count"), F.sum((F.col("kind") == "quote").cast("int")).alias("quoted_units"), F.sum((F.col("kind") == "dash").cast("int")).alias("dash_units"), F.avg("chars").alias("avg_unit_chars"), F.max("chars").alias("longest_unit"))
    d = total.join(u, "doc_id", "left").join(longest_run(shares, f"share >= {DOMINANT}", "dialogue"), "doc_id", "left").join(longest_run(shares, "dialogue_chars = 0", "quiet"), "doc_id", "left")
    d = d.fillna(0, ["unit_count", "quoted_units", "dash_units", "avg_unit_chars", "longest_unit", "longest_dialogue_run", "longest_dialogue_chars", "longest_quiet_run", "longest_quiet_chars"])
    d = d.withColumn("dialogue_share", ratio(F.col("dialogue_chars"), F.col("char_count")))
    return d.withColumn("verdict", verdict(F.col("dialogue_share"), F.col("unit_count")))


def unit_buckets(blk: DataFrame) -> DataFrame:
    """doc_id, bucket, n: spoken units by length; all five buckets of each document that speaks."""
    counts = units(blk).groupBy("doc_id").agg(*[F.count_if(F.col("chars").between(low, high)).alias(f"n{i}") for i, (_, low, high) in enumerate(UNIT_BUCKETS)])
    each = F.array(*[F.struct(F.lit(name).alias("bucket"), F.col(f"n{i}").alias("n")) for i, (name, *_) in enumerate(UNIT_BUCKETS)])
    return counts.select("doc_id", F.inline(each))


def samples(blk: DataFrame, k: int = SAMPLES) -> DataFrame:
    """The longest units, the first of equals."""
    return units(blk).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("chars"), "seq", "nth"))).where(F.col("rank") <= k)
