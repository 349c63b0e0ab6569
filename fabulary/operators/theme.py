"""Themes: terms that recur over segments, joined into clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions.lexicons import THEME_STOP_TERMS
from fabulary.functions.text import clamp
from fabulary.operators.components import components

# Fixed values.
NOUN_POS = ("NN", "NNS", "n", "nz", "noun")
MIN_MENTIONS, MIN_SEGMENTS, MOST, MEMBERS, COOC_MIN = 3, 2, 8, 8, 3
SUSTAINED, RECURRING, OVER_CONCENTRATED, SCATTERED, SINGLETON_HEAVY, THIRD_HEAVY = 0.5, 0.2, 0.35, 0.12, 0.5, 0.6


def normalized(term: Column) -> Column:
    """The term trimmed in lower case, null if it is too short, generic or without a letter."""
    t = F.lower(F.trim(term))
    return F.when((F.length(t) >= 2) & ~t.isin(THEME_STOP_TERMS) & t.rlike(r"\p{L}"), t)


def candidates(terms: DataFrame) -> DataFrame:
    """terms: doc_id, seq, seg, term. One row per document, block, segment and normalised term: a block counts once."""
    return terms.select("doc_id", "seq", "seg", normalized(F.col("term")).alias("term")).where("term is not null").distinct()


def edges(cand: DataFrame, containment: bool = True) -> DataFrame:
    """doc_id, a, b: terms that share enough blocks, and terms of which one holds the other.

    Containment candidates meet on the first two characters of the shorter term, which the longer one must hold, so no
    term meets all others.
    """
    blocks = cand.groupBy("doc_id", "seq").agg(F.sort_array(F.collect_set("term")).alias("t"))
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    met = blocks.select("doc_id", F.explode(pairs).alias("p")).groupBy("doc_id", "p.a", "p.b").agg(F.count("*").alias("n")).where(F.col("n") >= COOC_MIN).select("doc_id", "a", "b")
    if not containment:
        return met
    words = cand.select("doc_id", "term").distinct()
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("term") - 1), lambda i: F.substring(F.col("term"), i, F.lit(2))))
    held = words.select("doc_id", F.col("term").alias("b"), F.explode(grams).alias("g"))
    short = words.select("doc_id", F.col("term").alias("a"), F.substring("term", 1, 2).alias("g"))
    inside = short.join(held, ["doc_id", "g"]).where((F.col("a") != F.col("b")) & F.col("b").contains(F.col("a")))
    return met.union(inside.select("doc_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def clusters(cand: DataFrame, containment: bool = True) -> DataFrame:
    """doc_id, term, root: every term with the name of its cluster."""
    found = components(edges(cand, containment))
    words = cand.select("doc_id", "term").distinct()
    return words.join(found.withColumnRenamed("node", "term"), ["doc_id", "term"], "left").select("doc_id", "term", F.coalesce("root", "term").alias("root"))


def themes(cand: DataFrame, axis: DataFrame, containment: bool = True) -> DataFrame:
    """All themes of each document, ranked. axis: the segment table."""
    size = axis.groupBy("doc_id").agg(F.max("n_segments").alias("n_segments"))
    members = cand.join(clusters(cand, containment), ["doc_id", "term"])
    busiest = members.groupBy("doc_id", "root", "term").agg(F.count("*").alias("n")).groupBy("doc_id", "root").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "term"))), 1, MEMBERS).alias("m"))
    curve = members.groupBy("doc_id", "root", "seg").agg(F.countDistinct("seq").alias("n"))
    order = Window.partitionBy("doc_id", "root").orderBy("seg")
    lagged = curve.join(size, "doc_id").withColumn("gap", F.col("seg") - F.coalesce(F.lag("seg").over(order), F.lit(-1)) - 1)
    third = F.greatest(F.floor(F.col("n_segments") / 3), F.lit(1))
    made = lagged.groupBy("doc_id", "root").agg(
        F.sum("n").alias("mentions"),
        F.count("*").alias("sections_touched"),
        F.min("seg").alias("first_seg"),
        F.max("seg").alias("last_seg"),
        F.greatest(F.max("gap"), F.max("n_segments") - F.max("seg") - 1).alias("longest_gap"),
        F.max("n_segments").alias("n_segments"),
        F.sum(F.when(F.col("seg") < third, F.col("n")).otherwise(0)).alias("front"),
        F.sum(F.when(F.col("seg") >= F.col("n_segments") - third, F.col("n")).otherwise(0)).alias("back"),
    )
    made = made.where((F.col("mentions") >= MIN_MENTIONS) & (F.col("sections_touched") >= MIN_SEGMENTS)).join(busiest, ["doc_id", "root"])
    c = F.col
    made = made.withColumn("coverage", c("sections_touched") / c("n_segments")).withColumn("share", c("mentions") / F.sum("mentions").over(Window.partitionBy("doc_id")))
    middle = c("mentions") - c("front") - c("back")
    heavy = lambda x: x >= THIRD_HEAVY * c("mentions")
    made = made.withColumn("concentration", F.when(heavy(c("back")), "back").when(heavy(middle), "middle").when(heavy(c("front")), "front").otherwise("even"))
    made = made.withColumn("reach", F.when(c("sections_touched") <= 2, "episodic").when(c("coverage") >= SUSTAINED, "sustained").when(c("coverage") >= RECURRING, "recurring").otherwise("occasional"))
    made = made.withColumn("term", F.element_at("m", 1)["term"]).withColumn("members", F.transform("m", lambda x: x["term"])).drop("m", "root", "front", "back")
    return made.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("mentions"), F.desc("coverage"), "term")))


def score(ranked: DataFrame, cand: DataFrame) -> DataFrame:
    """theme_score of each document, null without candidates."""
    seen = cand.groupBy("doc_id", "term").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.count("*").alias("candidate_count"), F.sum("n").alias("total_mentions"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once"))
    top = ranked.groupBy("doc_id").agg(F.max(F.when(F.col("rank") == 1, F.col("share"))).alias("top_share"), F.sum(F.when(F.col("rank") <= 3, F.col("share"))).alias("top3_share"), F.max(F.col("coverage") >= RECURRING).alias("thread"))
    d = seen.join(top, "doc_id", "left").fillna(0.0, ["top_share", "top3_share"]).withColumn("singleton_share", F.col("once") / F.col("total_mentions"))
    c = F.col
    lost = (
        F.when(F.coalesce("thread", F.lit(False)), 0.0).otherwise(25.0)
        + clamp((c("top_share") - OVER_CONCENTRATED) / 0.2 * 15.0, 0.0, 15.0)
        + F.when(c("top3_share") < SCATTERED, (SCATTERED - c("top3_share")) / SCATTERED * 20.0).otherwise(0.0)
        + F.when(c("singleton_share") > SINGLETON_HEAVY, F.least((c("singleton_share") - SINGLETON_HEAVY) * 50.0, F.lit(25.0))).otherwise(0.0)
    )
    return d.withColumn("theme_score", clamp(100.0 - lost, 0.0, 100.0)).drop("once", "thread")
