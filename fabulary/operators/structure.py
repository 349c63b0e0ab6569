"""Story structure: landmarks of the tension curve matched to the beats of three models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions.lexicons import BEATS

# Fixed values.
TURN_MIN, BAND, TOLERANCE, MOST_LANDMARKS = 0.15, 8.0, 0.12, 24


def positions(points: DataFrame) -> DataFrame:
    """points with `position`: the middle of each segment by cumulative characters."""
    doc = Window.partitionBy("doc_id")
    upto = F.coalesce(F.sum("char_count").over(doc.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("char_count").over(doc)
    return points.withColumn("position", F.coalesce(F.try_divide(upto + F.col("char_count") / 2.0, total.cast("double")), F.lit(0.0)))


def landmarks(points: DataFrame, turns: DataFrame | None = None, k: int = MOST_LANDMARKS) -> DataFrame:
    """doc_id, kind, seg, position, strength. points: the pacing curve; turns: doc_id, section (segment) and change."""
    w = Window.partitionBy("doc_id").orderBy("seg")
    doc = Window.partitionBy("doc_id")
    p = positions(points).select(
        "doc_id", "seg", "position", "tension", F.lag("tension").over(w).alias("was"), F.lead("tension").over(w).alias("next"), F.avg("tension").over(doc).alias("mean"),
        F.stddev_pop("tension").over(doc).alias("spread"), F.row_number().over(doc.orderBy(F.desc("tension"), "seg")).alias("nth"), F.min("seg").over(doc).alias("first"),
    )
    c = F.col
    higher = (c("was").isNull() | (c("tension") > c("was"))) & (c("next").isNull() | (c("tension") > c("next")))
    lower = (c("was").isNull() | (c("tension") < c("was"))) & (c("next").isNull() | (c("tension") < c("next")))
    rest = (c("nth") != 1) | (c("spread") < 5.0)
    row = lambda kind, strength: F.struct(F.lit(kind).alias("kind"), strength.cast("double").alias("strength"))
    kinds = F.array_compact(
        F.array(
            F.when(c("seg") == c("first"), row("opening", c("tension"))),
            F.when((c("nth") == 1) & (c("spread") >= 5.0), row("climax", c("tension"))),
            F.when(rest & higher & (c("tension") >= c("mean") + BAND), row("peak", c("tension") - c("mean"))),
            F.when(rest & lower & (c("tension") <= c("mean") - BAND), row("trough", c("mean") - c("tension"))),
        )
    )
    if turns is not None:
        changes = turns.where(c("change") >= TURN_MIN).groupBy("doc_id", c("section").cast("int").alias("seg")).agg(F.collect_list("change").alias("changes"))
        p = p.join(changes, ["doc_id", "seg"], "left")
        kinds = F.concat(kinds, F.transform(F.coalesce("changes", F.array().cast("array<double>")), lambda x: row("turn", x)))
    found = p.select("doc_id", "seg", "position", F.explode(kinds).alias("l")).select("doc_id", "l.kind", "seg", "position", "l.strength")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("seg", "kind"))).where(F.col("rank") <= k)


def beats(marks: DataFrame, table: list[tuple] | None = None) -> DataFrame:
    """Every beat of every model for each document: found in its window, displaced near it, or missing. A climax answers for a peak.

    The beats are a fixed table of a few rows, met by a range join on position.
    """
    rows = [(m, b, i, lo, hi, kind, k) for i, (m, b, lo, hi, kinds) in enumerate(table or BEATS) for k, kind in enumerate(kinds)]
    known = F.broadcast(marks.sparkSession.createDataFrame(rows, "model string, beat string, ord int, low double, high double, want string, pref int"))
    answers = marks.select("doc_id", F.explode(F.when(F.col("kind") == "climax", F.array(F.lit("climax"), F.lit("peak"))).otherwise(F.array("kind"))).alias("want"), "kind", "seg", "position", "strength")
    away = F.greatest(F.col("low") - F.col("position"), F.col("position") - F.col("high"), F.lit(0.0))
    met = answers.join(known, "want").withColumn("away", away).where(F.col("away") <= TOLERANCE)
    order = Window.partitionBy("doc_id", "ord").orderBy((F.col("away") > 0).cast("int"), F.when(F.col("away") > 0, F.col("away")).otherwise(F.col("pref").cast("double")), F.desc("strength"), "position", "pref")
    best = met.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("doc_id", "ord", F.when(F.col("away") > 0, "displaced").otherwise("found").alias("status"), "kind", "seg", "position")
    all_beats = marks.select("doc_id").distinct().withColumn("b", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(b).alias("beat"), F.lit(i).alias("ord")) for i, (m, b, *_) in enumerate(table or BEATS)])))
    return all_beats.select("doc_id", "b.model", "b.beat", "b.ord").join(best, ["doc_id", "ord"], "left").fillna("missing", ["status"])


def model_fit(matched: DataFrame) -> DataFrame:
    """matched at three quarters of the beats found, partial at half, else unclear."""
    d = matched.groupBy("doc_id", "model").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("found", "displaced", "missing")])
    part = F.col("found") / (F.col("found") + F.col("displaced") + F.col("missing"))
    return d.withColumn("fit", F.when(part >= 0.75, "matched").when(part >= 0.5, "partial").otherwise("unclear"))


def acts(points: DataFrame, turns: DataFrame) -> DataFrame:
    """Three acts cut at the two strongest turns, with share and tension of each; nothing where there are fewer turns."""
    best = turns.where("change > 0").groupBy("doc_id", "section").agg(F.max("change").alias("change"))
    two = best.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("change"), "section"))).where("r <= 2")
    cuts = two.groupBy("doc_id").agg(F.sort_array(F.collect_list("section")).alias("cuts")).where(F.size("cuts") == 2)
    act = F.when(F.col("seg") < F.col("cuts")[0], 1).when(F.col("seg") < F.col("cuts")[1], 2).otherwise(3)
    made = points.join(cuts, "doc_id").groupBy("doc_id", act.alias("act")).agg(F.min("seg").alias("from_seg"), F.max("seg").alias("to_seg"), F.sum("char_count").alias("char_count"), F.avg("tension").alias("mean_tension"), F.min("tension").alias("min_tension"), F.max("tension").alias("max_tension"))
    return made.withColumn("share", F.col("char_count") / F.sum("char_count").over(Window.partitionBy("doc_id")))
