"""Plot: threads of subjects through the sections, and where the set of threads turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions.text import clamp

# Fixed values.
MIN_MENTIONS, MOST, MAIN_COVERAGE, SUSTAINED, LATE, EARLY, MIN_SECTIONS, TURNS, NAMES, LISTED = 3, 12, 0.25, 0.5, 0.8, 0.2, 3, 3, 8, 10
ENTITIES = ("PERSON", "ORGANIZATION", "LOCATION", "FACILITY", "PRODUCT")


def subjects(blk: DataFrame, ment: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Presence of each subject in each section, in the form that threads() reads, with the subject's kind.

    Subjects are the mentions of plot entities and the noun signals (doc_id, seq, nth, text); each mention counts, blank
    ones don't. Sections are full paths in order of appearance. The kind is the category that the text has first: in
    the order of blocks, and entities before signals within a block. Only keys and subjects are shuffled, no contents.
    """
    found = ment.where(F.col("category").isin(*ENTITIES)).select("doc_id", "seq", "nth", "text", "category", F.lit(0).alias("late"))
    if signals is not None:
        found = found.unionByName(signals.select("doc_id", "seq", "nth", "text", F.lit("SIGNAL").alias("category"), F.lit(1).alias("late")))
    order = Window.partitionBy("doc_id").orderBy("first_seq")
    paths = blk.groupBy("doc_id", "section_path").agg(F.min("seq").alias("first_seq"))
    axis = paths.select("doc_id", "section_path", (F.row_number().over(order) - 1).alias("section"), F.count("*").over(Window.partitionBy("doc_id")).cast("int").alias("n_sections"))
    at = blk.select("doc_id", "seq", "section_path").join(axis, ["doc_id", "section_path"]).drop("section_path")
    named = found.where(F.trim("text") != "").join(at, ["doc_id", "seq"])
    first = F.struct("seq", "late", "nth", "category")
    made = named.groupBy("doc_id", F.col("text").alias("subject"), "section", "n_sections").agg(F.count("*").alias("n"), F.min(first).alias("_first"))
    return made.withColumn("kind", F.min("_first").over(Window.partitionBy("doc_id", "subject"))["category"]).drop("_first")


def threads(presence: DataFrame) -> DataFrame:
    """presence: doc_id, subject, section (index), n_sections, n. One row per subject with enough mentions."""
    order = Window.partitionBy("doc_id", "subject").orderBy("section")
    gaps = presence.withColumn("gap", F.coalesce(F.col("section") - F.lag("section").over(order) - 1, F.lit(0)))
    t = gaps.groupBy("doc_id", "subject").agg(
        F.sum("n").alias("mentions"),
        F.count("*").alias("sections_touched"),
        F.min("section").alias("first_section"),
        F.max("section").alias("last_section"),
        F.max("gap").alias("longest_gap"),
        F.max("n_sections").alias("n_sections"),
    )
    t = t.where(F.col("mentions") >= MIN_MENTIONS).withColumn("coverage", F.col("sections_touched") / F.col("n_sections"))
    c, last = F.col, F.col("n_sections") - 1
    shape = (
        F.when((c("n_sections") >= 3) & (c("first_section") >= LATE * last), "late_arrival")
        .when((c("n_sections") >= 3) & (c("last_section") <= EARLY * last), "setup_only")
        .when(c("coverage") >= SUSTAINED, "sustained")
        .when(c("longest_gap") >= 2, "intermittent")
        .when((c("sections_touched") <= 2) & (c("mentions") >= 6), "burst")
        .otherwise("minor")
    )
    return t.withColumn("shape", shape)


def plotlines(presence: DataFrame, k: int = MOST) -> DataFrame:
    """The leading threads, with the main ones marked."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("coverage"), F.desc("mentions"), "subject")
    ranked = threads(presence).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("is_main", (F.col("rank") <= 3) & (F.col("coverage") >= MAIN_COVERAGE))


def turning_points(presence: DataFrame, k: int = TURNS) -> DataFrame:
    """Sections whose set of threads differs most from that of the section before: Jaccard distance, with the names that changed."""
    kept = presence.join(threads(presence).select("doc_id", "subject"), ["doc_id", "subject"], "left_semi")
    sets = kept.groupBy("doc_id", "section").agg(F.sort_array(F.collect_set("subject")).alias("now"))
    axis = presence.groupBy("doc_id").agg(F.max("n_sections").alias("n")).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("section"))
    dense = axis.join(sets, ["doc_id", "section"], "left").withColumn("now", F.coalesce("now", F.array().cast("array<string>")))
    pair = dense.withColumn("was", F.lag("now").over(Window.partitionBy("doc_id").orderBy("section"))).where(F.col("was").isNotNull())
    came, went = F.array_sort(F.array_except("now", "was")), F.array_sort(F.array_except("was", "now"))
    change = F.try_divide(F.size(came) + F.size(went), F.size(F.array_union("now", "was")).cast("double"))
    turns = pair.select("doc_id", "section", change.alias("change"), F.slice(came, 1, NAMES).alias("appeared"), F.slice(went, 1, NAMES).alias("dropped")).where(F.col("change") > 0)
    return turns.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("change"), "section"))).where(F.col("rank") <= k)


def unresolved(presence: DataFrame, shape: str = "setup_only", k: int = LISTED) -> DataFrame:
    """Threads that stop early (setup_only) or begin late (late_arrival), the busiest first."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("mentions"), "subject")
    found = threads(presence).where((F.col("shape") == shape) & (F.col("n_sections") >= MIN_SECTIONS))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def single_section(presence: DataFrame, k: int = LISTED) -> DataFrame:
    """Threads that one section alone mentions, whatever their shape, the busiest first."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("mentions"), "subject")
    found = threads(presence).where((F.col("sections_touched") == 1) & (F.col("n_sections") >= MIN_SECTIONS))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def coherence(presence: DataFrame) -> DataFrame:
    """coherence_score of each document: what dropped, late and broken threads cost."""
    t = threads(presence)
    made = t.groupBy("doc_id").agg(
        F.max("n_sections").alias("section_count"),
        F.count("*").alias("thread_count"),
        F.sum(F.when(F.col("shape").isin("setup_only", "late_arrival"), 8.0).otherwise(0.0) + F.when(F.col("longest_gap") >= 3, 5.0).otherwise(0.0)).alias("lost"),
        F.max(F.col("coverage") >= SUSTAINED).alias("sustained"),
    )
    docs = presence.groupBy("doc_id").agg(F.max("n_sections").alias("n"))
    d = docs.join(made, "doc_id", "left")
    score = clamp(100.0 - F.col("lost") - F.when(F.col("sustained"), 0.0).otherwise(15.0), 0.0, 100.0)
    return d.select("doc_id", F.col("n").alias("section_count"), F.coalesce("thread_count", F.lit(0)).alias("thread_count"), F.when((F.col("n") < MIN_SECTIONS) | F.col("thread_count").isNull(), 100.0).otherwise(score).alias("coherence_score"))
