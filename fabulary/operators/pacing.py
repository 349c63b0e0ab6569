"""Pacing: the tension curve, stretches where it doesn't move, and sections that drag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions.text import TERMINATORS, class_chars, clamp, quoted_chars, ratio, sentence_lengths, visible_chars
from fabulary.operators.segments import by_segment, densely

# Fixed values.
SHORT, DIALOGUE_FULL, PUNCT_FULL, ENTITY_FULL = 12, 0.5, 8.0, 12.0
DRAG_RATIO, FLAT_BAND, FLAT_RUN_MIN, FLAT_STDEV, SPIKY_STDEV, VARIETY_FLOOR, MOST_DRAG = 1.8, 8.0, 4, 5.0, 22.0, 6.0, 10
#: How far a tension must lie below the mean; sums of doubles round equal ones apart by less.
BELOW = 1e-9

_SUMS = ("char_count", "quoted", "marks", "sentence_count", "short", "entities", "length_sum", "length_squares")


def tension(dialogue: Column, short: Column, punct: Column, entity: Column) -> Column:
    part = lambda x, full: F.least(x / full, F.lit(1.0))
    return 100.0 * (0.35 * part(dialogue, DIALOGUE_FULL) + 0.30 * short + 0.20 * part(punct, PUNCT_FULL) + 0.15 * part(entity, ENTITY_FULL))


def deviation(total: Column, squares: Column, n: Column) -> Column:
    """Population standard deviation from exact integer sums, 0 under two values. Their products may exceed a long."""
    wide = lambda x, digits: x.cast(f"decimal({digits},0)")
    spread = F.greatest((wide(squares, 20) * wide(n, 17) - wide(total, 18) * wide(total, 18)).cast("double"), F.lit(0.0))
    return F.when(n >= 2, F.sqrt(spread) / n).otherwise(0.0)


def curve(seg: DataFrame, ment: DataFrame | None = None, terminators: str = TERMINATORS) -> DataFrame:
    """One point per segment. seg: blocks with segments; ment: mentions, where there are any."""
    text, said = F.col("content"), sentence_lengths(F.col("content"), terminators)
    blocks = seg
    if ment is not None:
        blocks = seg.join(ment.groupBy("doc_id", "seq").agg(F.count("*").alias("entities")), ["doc_id", "seq"], "left")
    total = lambda a, x: a + x
    per_block = blocks.select(
        "doc_id",
        "seg",
        "label",
        "n_segments",
        "chunked",
        visible_chars(text).alias("char_count"),
        quoted_chars(text).alias("quoted"),
        class_chars(text, "!！?？").alias("marks"),
        (F.coalesce("entities", F.lit(0)) if ment is not None else F.lit(0)).alias("entities"),
        said.alias("said"),
    ).select(
        "*",
        F.size("said").alias("sentence_count"),
        F.size(F.filter("said", lambda x: x <= SHORT)).alias("short"),
        F.aggregate("said", F.lit(0).cast("long"), total).alias("length_sum"),
        F.aggregate(F.transform("said", lambda x: x.cast("long") * x), F.lit(0).cast("long"), total).alias("length_squares"),
    )
    full = densely(by_segment(per_block, *[F.sum(c).alias(c) for c in _SUMS]), *_SUMS)
    chars = F.greatest(F.col("char_count"), F.lit(1))
    dialogue, short = F.col("quoted") / chars, ratio(F.col("short"), F.col("sentence_count"))
    entity = F.col("entities") / chars * 1000.0
    return full.select(
        "*",
        ratio(F.col("length_sum"), F.col("sentence_count")).alias("avg_sentence_chars"),
        deviation(F.col("length_sum"), F.col("length_squares"), F.col("sentence_count")).alias("sentence_stdev"),
        dialogue.alias("dialogue_share"),
        entity.alias("entity_density"),
        tension(dialogue, short, F.col("marks") / chars * 1000.0, entity).alias("tension"),
    )


def _spread(values: Column) -> Column:
    """Population standard deviation of an array in its order, 0 under two values.

    Spark's own adds rows as they come, so where a document lies on a bound the last digits would decide by chance.
    """
    state = "struct<n:double,mean:double,squares:double>"

    def step(s: Column, x: Column) -> Column:
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1.0)
        return F.struct((s["n"] + 1.0).alias("n"), mean.alias("mean"), (s["squares"] + (x - mean) * (x - s["mean"])).alias("squares")).cast(state)

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares")).cast(state)
    return F.aggregate(values, start, step, lambda s: F.when(s["n"] > 1, F.sqrt(s["squares"] / s["n"])).otherwise(0.0))


def _flat_runs(curve: Column, band: float = FLAT_BAND, strict: bool = False) -> Column:
    """ARRAY<STRUCT<first, last>>: the runs of a document's curve, an array of points in order. See flat_stretches."""
    state = "struct<low:double,high:double,first:int,open:boolean,runs:array<struct<first:int,last:int>>>"

    def step(s: Column, p: Column) -> Column:
        low, high = F.least(s["low"], p["tension"]), F.greatest(s["high"], p["tension"])
        breaks = s["open"] & (high - low > band)
        last = p["seg"] - (1 if strict else 0)
        ended = F.array(F.struct(s["first"].alias("first"), last.cast("int").alias("last")))
        fresh = breaks | ~s["open"]
        return F.struct(
            F.when(fresh, p["tension"]).otherwise(low).alias("low"),
            F.when(fresh, p["tension"]).otherwise(high).alias("high"),
            F.when(fresh, p["seg"]).otherwise(s["first"]).cast("int").alias("first"),
            F.lit(True).alias("open"),
            F.when(breaks, F.concat(s["runs"], ended)).otherwise(s["runs"]).alias("runs"),
        ).cast(state)

    start = F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).alias("first"), F.lit(False).alias("open"), F.array().cast("array<struct<first:int,last:int>>").alias("runs")).cast(state)
    close = lambda s: F.concat(s["runs"], F.array(F.struct(s["first"].alias("first"), (F.size(curve) - 1).cast("int").alias("last"))))
    return F.aggregate(curve, start, step, close)


def flat_stretches(points: DataFrame, band: float = FLAT_BAND, least: int = FLAT_RUN_MIN, strict: bool = False) -> DataFrame:
    """Greedy runs whose whole range stays within the band.

    A run restarts where its range breaks, which no window can say, so each document's curve (a few hundred points) is
    folded in order. The segment that broke a run is counted with the run it ended, and also begins the next; strict
    leaves it to the next alone.
    """
    docs = points.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seg", "tension", "char_count", "label"))).alias("curve"))
    each = docs.select("doc_id", "curve", F.explode(_flat_runs(F.col("curve"), band, strict)).alias("run"))
    inside = F.slice("curve", F.col("run.first") + 1, F.col("run.last") - F.col("run.first") + 1)
    sizes = F.size(inside)
    return each.where(F.col("run.last") - F.col("run.first") + 1 >= least).select(
        "doc_id",
        F.element_at(inside, 1)["label"].alias("from_section"),
        F.element_at(inside, -1)["label"].alias("to_section"),
        sizes.alias("sections"),
        (F.aggregate(inside, F.lit(0.0), lambda a, p: a + p["tension"]) / sizes).alias("mean_tension"),
        F.aggregate(inside, F.lit(0).cast("long"), lambda a, p: a + p["char_count"]).alias("char_count"),
    )


def drag_sections(points: DataFrame, k: int = MOST_DRAG) -> DataFrame:
    """Segments much longer than the mean whose tension lies below it; the longest first."""
    doc = Window.partitionBy("doc_id")
    mean_chars, mean_tension = F.avg("char_count").over(doc), F.avg("tension").over(doc)
    slow = points.select("doc_id", "seg", "label", "char_count", "tension", (F.col("char_count") / mean_chars).alias("length_ratio"), mean_tension.alias("mean"))
    slow = slow.where((F.col("length_ratio") >= DRAG_RATIO) & (F.col("tension") < F.col("mean") - BELOW)).drop("mean")
    return slow.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("length_ratio"), "seg"))).where(F.col("rank") <= k)


def stats(points: DataFrame) -> DataFrame:
    """One row per document: spread, verdict and score. The curve is gathered once, so the points are computed once."""
    d = points.groupBy("doc_id").agg(
        F.count("*").alias("segment_count"),
        F.max("chunked").alias("chunked"),
        deviation(F.sum("length_sum"), F.sum("length_squares"), F.sum("sentence_count")).alias("sentence_stdev"),
        F.min("tension").alias("min_tension"),
        F.max("tension").alias("max_tension"),
        F.avg("char_count").alias("mean_section_chars"),
        F.avg("tension").alias("mean_tension"),
        F.sort_array(F.collect_list(F.struct("seg", "tension", "char_count"))).alias("curve"),
    )
    sizes = F.filter(F.transform(_flat_runs(F.col("curve")), lambda r: r["last"] - r["first"] + 1), lambda n: n >= FLAT_RUN_MIN)
    slow = F.filter("curve", lambda x: (x["char_count"] / F.col("mean_section_chars") >= DRAG_RATIO) & (x["tension"] < F.col("mean_tension") - BELOW))
    d = d.withColumn("tension_stdev", _spread(F.col("curve.tension"))).withColumn("longest_flat_run", F.coalesce(F.array_max(sizes), F.lit(0))).withColumn("drag_count", F.least(F.size(slow), F.lit(MOST_DRAG))).drop("curve", "mean_tension")
    c = F.col
    lost = (
        F.when(c("tension_stdev") < FLAT_STDEV, (FLAT_STDEV - c("tension_stdev")) / FLAT_STDEV * 30.0).otherwise(0.0)
        + F.when(c("longest_flat_run") >= FLAT_RUN_MIN, F.least((c("longest_flat_run") - FLAT_RUN_MIN + 1) * 6.0, F.lit(24.0))).otherwise(0.0)
        + F.least(c("drag_count") * 8.0, F.lit(24.0))
        + F.when(c("sentence_stdev") < VARIETY_FLOOR, (VARIETY_FLOOR - c("sentence_stdev")) / VARIETY_FLOOR * 18.0).otherwise(0.0)
    )
    verdict = F.when(c("tension_stdev") < FLAT_STDEV, "flat").when(c("tension_stdev") > SPIKY_STDEV, "spiky").otherwise("varied")
    return d.withColumn("verdict", verdict).withColumn("pace_score", F.when(c("chunked"), 100.0).otherwise(clamp(100.0 - lost, 0.0, 100.0)))
