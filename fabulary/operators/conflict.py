"""Conflict: families of terms counted along the segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions.lexicons import CONFLICT_TERMS
from fabulary.functions.text import clamp, count_term, count_terms, ratio, visible_chars
from fabulary.operators.segments import by_segment, densely, runs
from fabulary.operators.words import top_k

# Fixed values.
FULL, THIN, HEAVY, ABSENT_MIN, MIN_SHAPE, MIN_MIX, TOP_TERMS = 8.0, 2.0, 8.0, 3, 5, 10, 10


def term_hits(seg: DataFrame, families: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, seg, kind, term, hits (above 0). Every term is counted alone, in one projection over each block."""
    families = CONFLICT_TERMS if families is None else families
    counted = [F.struct(F.lit(k).alias("kind"), F.lit(t).alias("term"), count_term(F.col("content"), t).alias("hits")) for k, ts in families.items() for t in ts]
    found = seg.select("doc_id", "seg", F.explode(F.filter(F.array(*counted), lambda x: x["hits"] > 0)).alias("h"))
    return found.groupBy("doc_id", "seg", "h.kind", "h.term").agg(F.sum("h.hits").alias("hits"))


def curve(seg: DataFrame, families: dict[str, list[str]] | None = None) -> DataFrame:
    """One point per segment: hits, density per thousand characters, intensity and the dominant family."""
    families = CONFLICT_TERMS if families is None else families
    text, kinds = F.col("content"), list(families)
    per_kind = [F.sum(count_terms(text, families[k])).alias(f"k{i}") for i, k in enumerate(kinds)]
    each = F.array(*[F.col(f"k{i}") for i in range(len(kinds))])
    first = F.array_position(each, F.array_max(each))
    points = by_segment(seg, F.sum(visible_chars(text)).alias("char_count"), *per_kind)
    points = points.withColumn("hits", F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x))
    points = points.withColumn("dominant", F.when(F.col("hits") > 0, F.element_at(F.array(*[F.lit(k) for k in kinds]), first.cast("int"))))
    full = densely(points.drop(*[f"k{i}" for i in range(len(kinds))]), "char_count", "hits").fillna("", ["dominant"])
    density = ratio(F.col("hits"), F.col("char_count"), 1000.0)
    return full.withColumn("density", density).withColumn("intensity", F.least(density / FULL, F.lit(1.0)) * 100.0)


def families_of(seg: DataFrame, families: dict[str, list[str]] | None = None, k: int = TOP_TERMS) -> DataFrame:
    """Families by hits, with their share and top terms."""
    terms = term_hits(seg, families).groupBy("doc_id", "kind", "term").agg(F.sum("hits").alias("hits"))
    best = top_k(terms, k, "hits", "term", by=("doc_id", "kind")).groupBy("doc_id", "kind").agg(F.sort_array(F.collect_list(F.struct("rank", "term", "hits"))).alias("top_terms"))
    total = terms.groupBy("doc_id", "kind").agg(F.sum("hits").alias("hits"))
    return total.withColumn("share", F.col("hits") / F.sum("hits").over(Window.partitionBy("doc_id"))).join(best, ["doc_id", "kind"])


def absent_runs(points: DataFrame, least: int = ABSENT_MIN) -> DataFrame:
    """Runs of segments without any hit."""
    made = runs(points, "hits = 0").groupBy("doc_id", "run").agg(F.min("seg").alias("from_seg"), F.max("seg").alias("to_seg"), F.count("*").alias("sections"), F.sum("char_count").alias("char_count"))
    return made.where(F.col("sections") >= least).drop("run")


def stats(seg: DataFrame, families: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document. The score is null where no term occurs."""
    points = curve(seg, families)
    n = F.col("n_segments")
    tail = F.col("seg") >= n - F.ceil(n / 3.0)
    d = points.groupBy("doc_id").agg(
        F.max("n_segments").alias("segment_count"),
        F.sum("hits").alias("total_hits"),
        F.sum("char_count").alias("char_count"),
        F.max("intensity").alias("peak_intensity"),
        F.max_by("label", F.struct("intensity", -F.col("seg"))).alias("peak_section"),
        F.max_by("seg", F.struct("intensity", -F.col("seg"))).alias("peak_seg"),
        F.avg(F.when(tail, F.col("intensity"))).alias("tail_intensity"),
        F.max("hits").alias("most_hits"),
    )
    mix = families_of(seg, families).groupBy("doc_id").agg(F.max("share").alias("dominant_share"), F.min_by("kind", F.struct(-F.col("hits"), "kind")).alias("dominant_type"))
    absent = absent_runs(points, 1).groupBy("doc_id").agg(F.max("sections").alias("longest_absent_run"))
    c = F.col
    d = d.join(mix, "doc_id", "left").join(absent, "doc_id", "left").fillna(0, ["longest_absent_run", "dominant_share"])
    d = d.withColumn("density", ratio(c("total_hits"), c("char_count"), 1000.0)).withColumn("concentration", ratio(c("most_hits"), c("total_hits")))
    d = d.withColumn("peak_position", F.when(c("segment_count") > 1, c("peak_seg") / (c("segment_count") - 1)).otherwise(0.0))
    shaped = c("segment_count") >= MIN_SHAPE
    lost = (
        F.when(c("density") < THIN, (THIN - c("density")) / THIN * 30.0).otherwise(0.0)
        + F.when(c("total_hits") >= MIN_MIX, clamp((c("dominant_share") - 0.8) / 0.2 * 15.0, 0.0, 15.0)).otherwise(0.0)
        + F.when(c("longest_absent_run") >= ABSENT_MIN, F.least((c("longest_absent_run") - ABSENT_MIN + 1) * 5.0, F.lit(20.0))).otherwise(0.0)
        + F.when(shaped & (c("peak_position") < 1 / 3) & (c("tail_intensity") < c("peak_intensity") * 0.5), 20.0).otherwise(0.0)
        + F.when(shaped & (c("concentration") > 0.5), F.least((c("concentration") - 0.5) * 60.0, F.lit(15.0))).otherwise(0.0)
    )
    verdict = F.when(c("density") <= 0, "none").when(c("density") < THIN, "thin").when(c("density") > HEAVY, "heavy").otherwise("present")
    return d.withColumn("verdict", verdict).withColumn("conflict_score", F.when(c("total_hits") > 0, clamp(100.0 - lost, 0.0, 100.0))).drop("most_hits", "peak_seg")
