"""Roll-ups: rule tables over the measures of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabulary.functions.text import clamp, ratio

# Fixed values: (id, group, severity) in firing order.
CHECKLIST = [
    ("plot-unresolved", "consistency", "high"), ("plot-late", "consistency", "high"), ("timeline-backstep", "consistency", "medium"),
    ("timeline-unreadable", "consistency", "low"), ("setting-unanchored", "consistency", "medium"), ("entity-alias", "consistency", "low"),
    ("structure-issue", "structure", "high"), ("structure-unreadable", "structure", "low"), ("pacing-drag", "structure", "medium"),
    ("conflict-absent", "structure", "medium"), ("dialogue-silent", "structure", "low"), ("cliche-hits", "language", "medium"),
    ("t0-repeat", "language", "low"), ("t0-adverb", "language", "low"), ("t0-readability", "language", "medium"),
    ("voice-quotes", "language", "medium"), ("voice-hedging", "language", "low"), ("explicit-advisory", "advisory", "high"),
    ("explicit-self-harm", "advisory", "high"),
]
UNANCHORED, ABSENT_RUN, ADVERB_OVERUSE, READABLE = 0.3, 3, 20, 60.0
GROUPS = ("consistency", "structure", "language", "advisory")


def section_balance(sizes: DataFrame) -> DataFrame:
    """sizes: doc_id, section_path, byte_count. Largest top-level section over the lower median; null under two sections."""
    top = sizes.groupBy("doc_id", F.split("section_path", " / ")[0].alias("top")).agg(F.sum("byte_count").alias("b"))
    d = top.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("b").alias("most"), F.expr("percentile_disc(0.5) within group (order by b)").alias("median"), F.max_by("top", F.struct("b", "top")).alias("largest"))
    return d.select("doc_id", F.when(F.col("n") >= 2, ratio(F.col("most"), F.col("median"))).alias("max_ratio"), "largest")


def assessment(wide: DataFrame) -> DataFrame:
    """wide: one row per document with readability, long_share, adverb_ratio, top_adverb, repeat_ratio and max_ratio. Five scores and their mean."""
    c = F.col
    scores = {
        "readability": c("readability"),
        "rhythm": clamp(100.0 - 400.0 * c("long_share"), 0.0, 100.0),
        "word_choice": clamp(100.0 - 500.0 * F.greatest(c("adverb_ratio") - 0.04, F.lit(0.0)) - F.least(c("top_adverb") / 20.0, F.lit(20.0)), 0.0, 100.0),
        "repetition": clamp(100.0 - 1000.0 * F.greatest(c("repeat_ratio") - 0.02, F.lit(0.0)), 0.0, 100.0),
        "balance": F.when(c("max_ratio").isNull(), 100.0).otherwise(clamp(100.0 - 20.0 * F.greatest(c("max_ratio") - 1.5, F.lit(0.0)), 0.0, 100.0)),
    }
    made = wide.withColumns({f"{k}_score": v for k, v in scores.items()})
    return made.withColumn("overall", sum((c(f"{k}_score") for k in scores), F.lit(0.0)) / len(scores))


def recommendations(wide: DataFrame) -> DataFrame:
    """One row per rule that fires: severity, dimension and rule; the severest first, then in rule order."""
    c = F.col
    rules: list[tuple[str, str, str, Column]] = [
        ("high", "readability", "hard_to_read", c("readability") < 60),
        ("high", "rhythm", "many_long_sentences", c("long_share") > 0.15),
        ("medium", "rhythm", "some_long_sentences", (c("long_share") > 0.05) & (c("long_share") <= 0.15)),
        ("medium", "word_choice", "one_adverb_overused", c("top_adverb") > 100),
        ("low", "word_choice", "many_adverbs", c("adverb_ratio") > 0.06),
        ("medium", "repetition", "one_phrase_repeated", c("top_phrase") > 30),
        ("medium", "balance", "one_section_too_long", c("max_ratio") > 3),
    ]
    fired = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(("high", "medium", "low").index(s) * 10 + i).alias("ord"), F.lit(s).alias("severity"), F.lit(d).alias("dimension"), F.lit(r).alias("rule"))) for i, (s, d, r, cond) in enumerate(rules)]))
    return wide.select("doc_id", F.explode(fired).alias("r")).select("doc_id", "r.ord", "r.severity", "r.dimension", "r.rule")


def checklist_conditions() -> dict[str, Column]:
    """When each of the nineteen rules fires, over the columns that bundle.review_inputs() gathers."""
    c = F.col
    return {
        "plot-unresolved": c("unresolved") > 0,
        "plot-late": c("late_arrivals") > 0,
        "timeline-backstep": c("backsteps") > 0,
        "timeline-unreadable": ~c("time_readable") & (c("entity_dates") > 0),
        "setting-unanchored": (c("scene_count") > 0) & c("places_measured") & (c("unanchored_share") >= UNANCHORED),
        "entity-alias": c("entities") > 0,
        "structure-issue": c("structure_issues") > 0,
        "structure-unreadable": ~c("structure_readable"),
        "pacing-drag": c("drag_count") > 0,
        "conflict-absent": (c("conflict_hits") > 0) & (c("longest_absent_run") >= ABSENT_RUN),
        "dialogue-silent": c("silent_segments") > 0,
        "cliche-hits": c("cliche_hits") > 0,
        "t0-repeat": c("repeated") > 0,
        "t0-adverb": c("top_adverb") >= ADVERB_OVERUSE,
        "t0-readability": (c("sentence_count") > 0) & (c("readability") < READABLE),
        "voice-quotes": c("open_quotes") != c("close_quotes"),
        "voice-hedging": c("stance") == "hedging",
        "explicit-advisory": c("explicit_hits") > 0,
        "explicit-self-harm": c("self_harm") > 0,
    }


def checklist(wide: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row per document and rule that fires, in firing order. conditions: a column for each id of CHECKLIST that can be decided."""
    rows = [F.when(F.coalesce(conditions[i], F.lit(False)), F.struct(F.lit(n).alias("ord"), F.lit(i).alias("id"), F.lit(g).alias("group"), F.lit(s).alias("severity"))) for n, (i, g, s) in enumerate(CHECKLIST) if i in conditions]
    return wide.select("doc_id", F.explode(F.array_compact(F.array(*rows))).alias("x")).select("doc_id", "x.ord", "x.id", "x.group", "x.severity")


def checklist_groups(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, group, n: groups without items are kept with 0."""
    every = docs.select("doc_id").distinct().withColumn("group", F.explode(F.array(*[F.lit(g) for g in GROUPS])))
    return every.join(items.groupBy("doc_id", "group").agg(F.count("*").alias("n")), ["doc_id", "group"], "left").fillna(0, ["n"])


def coverage(blk: DataFrame, tok: DataFrame | None = None, ment: DataFrame | None = None) -> DataFrame:
    """What was measured for each document, and the dimensions that can't be read without it."""
    d = blk.select("doc_id").distinct()
    for name, rows in (("has_tokens", tok), ("has_entities", ment)):
        if rows is None:
            d = d.withColumn(name, F.lit(False))
        else:
            d = d.join(rows.select("doc_id").distinct().withColumn(name, F.lit(True)), "doc_id", "left").fillna(False, [name])
    unread = F.array_compact(F.array(F.when(~F.col("has_tokens"), F.lit("t0")), F.when(~F.col("has_entities"), F.lit("plot")), F.when(~F.col("has_tokens"), F.lit("theme")), F.when(~F.col("has_entities"), F.lit("setting"))))
    return d.withColumn("is_full", F.col("has_tokens") & F.col("has_entities")).withColumn("unreadable", F.array_join(unread, ","))
