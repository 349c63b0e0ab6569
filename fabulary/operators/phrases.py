"""Stock phrases and explicit language: what a lexicon finds, by pattern, segment and tier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions.lexicon import hits
from fabulary.functions.lexicons import EXPLICIT_TERMS, STOCK_PHRASES
from fabulary.functions.text import ratio, visible_chars
from fabulary.operators.segments import by_segment, densely

# Fixed values.
PHRASE_FULL, EXPLICIT_FULL, LIGHT, HEAVY, CLEAN, REPEATED, MIN_CHARS, MOST, MOST_HITS = 40.0, 30.0, 10.0, 25.0, 4.0, 3, 1000, 20, 60
TIERS = ("mild", "moderate", "strong")
#: (category, kind, least tier)
ADVISORIES = (
    ("self_harm", "self_harm", "moderate"), ("sexual_violence", "sexual_violence", "strong"), ("hate", "hate_slur", "strong"),
    ("sexual", "sexual_content", "strong"), ("violence", "gore", "strong"), ("substance", "substance", "strong"),
)


def phrase_hits(seg: DataFrame, lexicon: Sequence[tuple] = STOCK_PHRASES) -> DataFrame:
    return hits(seg.select("doc_id", "seq", "seg", "label", "n_segments", "content"), lexicon).drop("content")


def explicit_hits(seg: DataFrame, lexicon: Sequence[tuple] = EXPLICIT_TERMS) -> DataFrame:
    return phrase_hits(seg, lexicon)


def first_hits(found: DataFrame, k: int = MOST_HITS) -> DataFrame:
    """The first hits in document order."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "start"))).where(F.col("rank") <= k)


def tallies(found: DataFrame, k: int = MOST) -> DataFrame:
    """Patterns by count: share, variants (busiest first, then by first appearance), segments touched."""
    forms = found.groupBy("doc_id", "pattern", "category", "tier", "matched").agg(F.count("*").alias("n"), F.min(F.struct("seq", "start")).alias("first"))
    variants = forms.groupBy("doc_id", "pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "first", "matched"))), lambda x: F.struct(x["matched"].alias("matched"), (-x["k"]).alias("n"))).alias("variants"))
    each = found.groupBy("doc_id", "pattern", "category", "tier").agg(
        F.count("*").alias("n"), F.countDistinct("seg").alias("segments_touched"), (F.countDistinct("seg") / F.max("n_segments")).alias("coverage"), F.min("seg").alias("first_seg"), F.max("seg").alias("last_seg")
    )
    each = each.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("doc_id"))).join(variants, ["doc_id", "pattern"])
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "pattern"))).where(F.col("rank") <= k)


def curve(seg: DataFrame, found: DataFrame, full: float = PHRASE_FULL) -> DataFrame:
    """Hits per ten thousand characters of each segment, and its busiest pattern (ties by pattern)."""
    by = found.groupBy("doc_id", "seg", "pattern").agg(F.count("*").alias("n"))
    top = by.groupBy("doc_id", "seg").agg(F.sum("n").alias("hits"), F.min_by("pattern", F.struct(-F.col("n"), "pattern")).alias("top_pattern"))
    chars = by_segment(seg, F.sum(visible_chars(F.col("content"))).alias("char_count"))
    points = densely(chars.join(top, ["doc_id", "seg"], "left"), "char_count", "hits").fillna("", ["top_pattern"])
    rate = ratio(F.col("hits"), F.col("char_count"), 10000.0)
    return points.withColumn("per_10k", rate).withColumn("intensity", F.least(rate / full, F.lit(1.0)) * 100.0)


def phrase_stats(seg: DataFrame, found: DataFrame) -> DataFrame:
    """One row per document. The score is null for short texts."""
    chars = seg.groupBy("doc_id").agg(F.sum(visible_chars(F.col("content"))).alias("char_count"))
    by = found.groupBy("doc_id", "pattern").agg(F.count("*").alias("n"), F.sum(F.col("in_dialogue").cast("int")).alias("said"))
    some = by.groupBy("doc_id").agg(
        F.sum("n").alias("total_hits"), F.count("*").alias("distinct_phrases"), F.sum("said").alias("dialogue_hits"), F.max("n").alias("most"),
        F.sum((F.col("n") >= REPEATED).cast("int")).alias("repeated_phrases"), F.sum(F.when(F.col("n") >= REPEATED, F.col("n")).otherwise(0)).alias("repeat_hits"),
    )
    names = ["total_hits", "distinct_phrases", "dialogue_hits", "most", "repeated_phrases", "repeat_hits"]
    d = chars.join(some, "doc_id", "left").fillna(0, names)
    c = F.col
    d = d.withColumn("per_10k", ratio(c("total_hits"), c("char_count"), 10000.0)).withColumn("top_share", ratio(c("most"), c("total_hits"))).drop("most")
    lost = F.when(c("per_10k") > CLEAN, F.least((c("per_10k") - CLEAN) * 2.5, F.lit(45.0))).otherwise(0.0) + F.least(c("repeat_hits"), F.lit(20)) + F.when((c("total_hits") >= 8) & (c("top_share") >= 0.25), 10.0).otherwise(0.0)
    verdict = F.when(c("total_hits") == 0, "none").when(c("per_10k") < LIGHT, "light").when(c("per_10k") > HEAVY, "heavy").otherwise("moderate")
    return d.withColumn("verdict", verdict).withColumn("cliche_score", F.when(c("char_count") >= MIN_CHARS, F.greatest(100.0 - lost, F.lit(0.0))))


def tier_counts(found: DataFrame) -> DataFrame:
    """doc_id, mild, moderate, strong and advisory, the strongest tier that occurs. There is no score by design."""
    some = found.groupBy("doc_id").agg(*[F.sum((F.col("tier") == t).cast("int")).alias(t) for t in TIERS])
    return some.withColumn("advisory", F.when(F.col("strong") > 0, "strong").when(F.col("moderate") > 0, "moderate").when(F.col("mild") > 0, "mild").otherwise("none"))


def advisories(found: DataFrame) -> DataFrame:
    """Families that call for a warning: hits, and the segment that holds most of them (ties by label)."""
    known = found.sparkSession.createDataFrame([(c, k, TIERS.index(t), n) for n, (c, k, t) in enumerate(ADVISORIES)], "category string, kind string, least int, ord int")
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier")) - 1
    kept = found.withColumn("t", rank).join(F.broadcast(known), "category").where("t >= least")
    by = kept.groupBy("doc_id", "ord", "kind", "label").agg(F.count("*").alias("n"))
    return by.groupBy("doc_id", "ord", "kind").agg(F.sum("n").alias("hits"), F.min_by("label", F.struct(-F.col("n"), "label")).alias("section"))
