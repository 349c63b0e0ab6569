"""Setting: scenes between changes of place, places over the segments, and the vocabulary of surroundings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions.lexicons import ENVIRONMENT_TERMS
from fabulary.functions.text import clamp, count_terms, quoted_chars, ratio, visible_chars
from fabulary.operators.segments import by_segment, densely

# Fixed values.
ENV_FULL, THIN, HEAVY, MIN_PLACE, MOST_PLACES, MOST_SCENES, ABSENT, UNANCHORED, CROWDED, RECURRING = 12.0, 2.0, 10.0, 2, 12, 40, 3, 3.0, 4, 3


def anchors(ment: DataFrame, kinds: tuple[str, ...] = ("LOCATION", "FACILITY")) -> DataFrame:
    """doc_id, seq, anchor (the place a block names most, the first of equals) and the places it names."""
    named = ment.where(F.col("category").isin(*kinds)).groupBy("doc_id", "seq", "text").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    return named.groupBy("doc_id", "seq").agg(F.max_by("text", F.struct("n", -F.col("first"))).alias("anchor"), F.count("*").alias("places"), F.collect_set("text").alias("named"))


def segment_places(seg: DataFrame, ment: DataFrame, kinds: tuple[str, ...] = ("LOCATION", "FACILITY")) -> DataFrame:
    """place_count and dominant_place of each segment: the place that most of its blocks name, the first named of equals."""
    named = ment.where(F.col("category").isin(*kinds)).groupBy("doc_id", "seq", "text").agg(F.min("nth").alias("first"))
    each = seg.select("doc_id", "seq", "seg").join(named, ["doc_id", "seq"]).groupBy("doc_id", "seg", "text").agg(F.count("*").alias("n"), F.min(F.struct("seq", "first")).alias("first"))
    top = each.groupBy("doc_id", "seg").agg(F.count("*").alias("place_count"), F.min_by("text", F.struct(-F.col("n"), "first")).alias("dominant_place"))
    return densely(by_segment(seg).join(top, ["doc_id", "seg"], "left"), "place_count").fillna("", ["dominant_place"])


def facts(seg: DataFrame, ment: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """What each block says of its surroundings."""
    made = seg.join(anchors(ment), ["doc_id", "seq"], "left")
    return made.select(
        "doc_id", "seq", "seg", "label", "n_segments", "block_type",
        F.coalesce("anchor", F.lit("")).alias("anchor"),
        F.coalesce("places", F.lit(0)).alias("places"),
        "named",
        visible_chars(F.col("content")).alias("char_count"),
        quoted_chars(F.col("content")).alias("quoted"),
        count_terms(F.col("content"), ENVIRONMENT_TERMS if terms is None else terms).alias("env_hits"),
    )


def scene_ids(rows: DataFrame, key: str = "doc_id", order: str = "seq", anchor: str = "anchor", opens: str = "block_type = 'title'") -> DataFrame:
    """rows with `scene`: a new one at the first row, where `opens` holds, and where a known place differs from the scene's.

    The scene's place is the last known one since the last opening, so two windows suffice.
    """
    by = Window.partitionBy(key).orderBy(order)
    opened = rows.withColumn("_open", F.expr(opens).cast("int")).withColumn("_group", F.sum("_open").over(by))
    place = F.when(F.col(anchor) != "", F.col(anchor))
    before = F.last(place, ignorenulls=True).over(Window.partitionBy(key, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    new = (F.row_number().over(by) == 1) | (F.col("_open") == 1) | F.coalesce(place != before, F.lit(False))
    return opened.withColumn("_new", new.cast("int")).withColumn("scene", F.sum("_new").over(by) - 1).drop("_open", "_group", "_new")


def scenes(fact: DataFrame) -> DataFrame:
    """One row per scene."""
    s = scene_ids(fact).groupBy("doc_id", "scene").agg(
        F.min("seq").alias("first_seq"),
        F.min_by("label", "seq").alias("section"),
        F.coalesce(F.min_by("anchor", F.when(F.col("anchor") != "", F.col("seq"))), F.lit("")).alias("anchor"),
        F.count("*").alias("blocks"),
        F.sum("char_count").alias("char_count"),
        F.sum("env_hits").alias("env_hits"),
        F.sum("quoted").alias("quoted"),
    )
    density = ratio(F.col("env_hits"), F.col("char_count"), 1000.0)
    return s.select("*", density.alias("env_density"), ratio(F.col("quoted"), F.col("char_count")).alias("dialogue_share"), ((F.col("anchor") == "") & (density < UNANCHORED)).alias("unanchored"))


def absences(visits: DataFrame, key: str = "doc_id", place: str = "place", order: str = "seg") -> DataFrame:
    """visits: one row per place and segment that names it, with n and n_segments. Totals, longest absence and returns of each place."""
    w = Window.partitionBy(key, place).orderBy(order)
    gaps = visits.withColumn("gap", F.coalesce(F.col(order) - F.lag(order).over(w) - 1, F.lit(0)))
    return gaps.groupBy(key, place).agg(
        F.sum("n").alias("mentions"),
        F.count("*").alias("segments_touched"),
        (F.count("*") / F.max("n_segments")).alias("coverage"),
        F.min(order).alias("first_seg"),
        F.max(order).alias("last_seg"),
        F.max("gap").alias("longest_absence"),
        F.sum(F.when(F.col("gap") >= ABSENT, 1).otherwise(0)).alias("returns"),
    )


def places(seg: DataFrame, ment: DataFrame, k: int = MOST_PLACES) -> DataFrame:
    """The places that most blocks name."""
    named = ment.where(F.col("category").isin("LOCATION", "FACILITY")).select("doc_id", "seq", F.col("text").alias("place")).distinct()
    visits = named.join(seg.select("doc_id", "seq", "seg", "n_segments"), ["doc_id", "seq"]).groupBy("doc_id", "place", "seg").agg(F.count("*").alias("n"), F.max("n_segments").alias("n_segments"))
    kept = absences(visits).where(F.col("mentions") >= MIN_PLACE)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("mentions"), "place"))).where(F.col("rank") <= k)


def stats(fact: DataFrame, place: DataFrame) -> DataFrame:
    """One row per document. The score is null without places and surroundings."""
    total = fact.groupBy("doc_id").agg(F.sum("env_hits").alias("total_env_hits"), F.sum("char_count").alias("char_count"), F.max(F.col("places") > 0).alias("places_measured"))
    apart = fact.select("doc_id", "seg", F.explode("named").alias("place")).groupBy("doc_id", "seg").agg(F.countDistinct("place").alias("p"))
    crowd = apart.groupBy("doc_id").agg(F.sum((F.col("p") >= CROWDED).cast("int")).alias("crowded"))
    scene = scenes(fact).groupBy("doc_id").agg(F.count("*").alias("scene_count"), F.sum(F.col("unanchored").cast("int")).alias("unanchored_scenes"))
    some = place.groupBy("doc_id").agg(F.count("*").alias("place_count"), F.sum((F.col("mentions") >= RECURRING).cast("int")).alias("recurring_places"))
    d = total.join(scene, "doc_id").join(crowd, "doc_id", "left").join(some, "doc_id", "left").fillna(0, ["crowded", "place_count", "recurring_places"])
    c = F.col
    d = d.withColumn("env_density", ratio(c("total_env_hits"), c("char_count"), 1000.0)).withColumn("unanchored_share", c("unanchored_scenes") / c("scene_count"))
    lost = (
        F.when(c("unanchored_share") > 0.3, F.least((c("unanchored_share") - 0.3) * 60.0, F.lit(25.0))).otherwise(0.0)
        + F.when(c("env_density") < THIN, (THIN - c("env_density")) / THIN * 20.0).otherwise(0.0)
        + F.when((c("recurring_places") > 0) | (c("env_density") >= HEAVY), 0.0).otherwise(20.0)
        + F.least(c("crowded") * 5.0, F.lit(15.0))
    )
    verdict = F.when(c("total_env_hits") == 0, "none").when(c("env_density") < THIN, "thin").when(c("env_density") > HEAVY, "heavy").otherwise("present")
    return d.withColumn("verdict", verdict).withColumn("setting_score", F.when((c("place_count") > 0) | (c("total_env_hits") > 0), clamp(100.0 - lost, 0.0, 100.0)))
