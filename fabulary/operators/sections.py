"""T1: sections, block types, characters, co-occurrence and the narrative arc."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions.text import class_chars, quoted_chars, ratio, sentence_lengths, visible_chars
from fabulary.operators.segments import by_segment, densely, with_segments
from fabulary.operators.words import top_k

# Fixed values.
TOP_CHARACTERS, TOP_PARTNERS, TOP_PAIRS, SHORT_SENTENCE = 20, 5, 30, 12
ARC_WEIGHTS = {"dialogue": 0.35, "exclaim": 0.25, "short": 0.20, "entities": 0.20}


def section_sizes(blk: DataFrame) -> DataFrame:
    """Sections of full path in reading order, with blocks and bytes."""
    return blk.groupBy("doc_id", "section_path").agg(F.min("seq").alias("first_seq"), F.count("*").alias("block_count"), F.sum(F.octet_length("content")).alias("byte_count"))


def extreme_sections(blk: DataFrame) -> DataFrame:
    """Longest section (the last of equals) and shortest (the first of equals) of each document."""
    return section_sizes(blk).groupBy("doc_id").agg(
        F.count("*").alias("section_count"),
        F.max_by("section_path", F.struct("byte_count", "first_seq")).alias("longest_section"),
        F.min_by("section_path", F.struct("byte_count", "first_seq")).alias("shortest_section"),
    )


def block_types(blk: DataFrame) -> DataFrame:
    return blk.groupBy("doc_id", "block_type").agg(F.count("*").alias("n"))


def characters(blk: DataFrame, ment: DataFrame, k: int = TOP_CHARACTERS) -> DataFrame:
    """Persons by the blocks that name them, where they first and last appear, and how much of the document they span."""
    place = blk.select("doc_id", "seq", "section_path", (F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1).alias("idx"), F.count("*").over(Window.partitionBy("doc_id")).alias("n_blocks"))
    named = ment.where("category = 'PERSON'").select("doc_id", "seq", F.col("text").alias("name")).distinct()
    made = named.join(place, ["doc_id", "seq"]).groupBy("doc_id", "name").agg(
        F.count("*").alias("mentions"),
        F.min_by("section_path", "idx").alias("first_section"),
        F.max_by("section_path", "idx").alias("last_section"),
        ((F.max("idx") - F.min("idx") + 1) / F.max("n_blocks")).alias("span_ratio"),
    )
    return top_k(made, k, "mentions", "name")


def cooccurrence(ment: DataFrame) -> DataFrame:
    """doc_id, a, b (a < b), n: blocks that name both. Pairs come from each block's own sorted names, not from a join."""
    names = ment.groupBy("doc_id", "seq").agg(F.sort_array(F.collect_set("text")).alias("names"))
    pairs = F.flatten(F.transform("names", lambda a, i: F.transform(F.slice("names", i + 2, F.size("names")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return names.select("doc_id", F.explode(pairs).alias("p")).groupBy("doc_id", "p.a", "p.b").agg(F.count("*").alias("n"))


def top_pairs(ment: DataFrame, k: int = TOP_PAIRS) -> DataFrame:
    return top_k(cooccurrence(ment).withColumn("label", F.concat_ws(" ↔ ", "a", "b")), k, "n", "label")


def partners(ment: DataFrame, k: int = TOP_PARTNERS) -> DataFrame:
    """The names that each name shares most blocks with."""
    pairs = cooccurrence(ment.where("category = 'PERSON'"))
    both = pairs.select("doc_id", F.col("a").alias("name"), F.col("b").alias("partner"), "n").union(pairs.select("doc_id", "b", "a", "n"))
    return top_k(both, k, "n", "partner", by=("doc_id", "name"))


def arc(blk: DataFrame, ment: DataFrame) -> DataFrame:
    """Intensity of each segment: four signals, each scaled to 0-1 over the document, weighted."""
    seg = blk if "seg" in blk.columns else with_segments(blk)
    content = F.col("content")
    said = sentence_lengths(content)
    named = ment.groupBy("doc_id", "seq").agg(F.count("*").alias("entities"))
    sums = {
        "char_count": visible_chars(content),
        "quoted": quoted_chars(content),
        "marks": class_chars(content, "!！?？"),
        "sentences": F.size(said),
        "short": F.size(F.filter(said, lambda x: x <= SHORT_SENTENCE)),
        "entities": F.coalesce("entities", F.lit(0)),
    }
    full = densely(by_segment(seg.join(named, ["doc_id", "seq"], "left"), *[F.sum(v).alias(k) for k, v in sums.items()]), *sums)
    c = F.col
    signals = {"dialogue": ratio(c("quoted"), c("char_count")), "exclaim": ratio(c("marks"), c("char_count"), 1000.0), "short": ratio(c("short"), c("sentences")), "entities": ratio(c("entities"), c("char_count"), 1000.0)}
    full = full.select("doc_id", "seg", "label", "char_count", *[v.alias(f"s_{k}") for k, v in signals.items()])
    doc = Window.partitionBy("doc_id")
    scaled = lambda k: ratio(c(f"s_{k}") - F.min(f"s_{k}").over(doc), F.max(f"s_{k}").over(doc) - F.min(f"s_{k}").over(doc))
    total = F.lit(0.0)
    for k, w in ARC_WEIGHTS.items():
        total = total + w * scaled(k)
    return full.select("doc_id", "seg", "label", "char_count", total.alias("intensity"))


def arc_shape(points: DataFrame) -> DataFrame:
    """mountain, rising, falling or steady, from the means of the thirds."""
    doc = Window.partitionBy("doc_id")
    at = points.withColumn("n", F.count("*").over(doc))
    third = F.greatest(F.floor(F.col("n") / 3), F.lit(1))
    mean = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("intensity"))), F.lit(0.0))
    thirds = at.groupBy("doc_id").agg(
        F.max("n").alias("n"), mean(F.col("seg") < third).alias("front"), mean((F.col("seg") >= third) & (F.col("seg") < F.col("n") - third)).alias("middle"), mean(F.col("seg") >= F.col("n") - third).alias("back")
    )
    shape = (
        F.when(F.col("n") < 3, "steady")
        .when((F.col("middle") > F.col("front") + 0.05) & (F.col("middle") > F.col("back") + 0.05), "mountain")
        .when((F.col("back") > F.col("front") + 0.05) & (F.col("back") >= F.col("middle") - 0.05), "rising")
        .when((F.col("front") > F.col("back") + 0.05) & (F.col("front") >= F.col("middle") - 0.05), "falling")
        .otherwise("steady")
    )
    return thirds.select("doc_id", shape.alias("shape"))
