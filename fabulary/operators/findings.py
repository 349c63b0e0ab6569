"""Findings: what the measures of a document give reason to look at.

Every list has doc_id, rank (1 comes first), kind, section ('' for the whole document) and value, the number the rule
judged. A rule that holds for the document as a whole is a condition over one wide row; one that holds for a place is a
filter over the rows of that measure. Documents without a finding have no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions.lexicons import ASSERTIVE, FESTIVALS, FUNCTION_GROUPS, HEDGING, MARKS, PERSONS, SOLAR_TERMS, WEEKDAYS
from fabulary.functions.text import TERMINATORS, class_chars, count_term, ratio, round_half_up, visible_chars
from fabulary.operators import dialogue, phrases, setting, timeline, voice
from fabulary.operators.segments import by_segment, segment_table

# Fixed values.
MOST, MOST_VOICE, MOST_STRUCTURE, MOST_REPEATED = 12, 10, 8, 6
DENSE_PHRASES, DENSE_EXPLICIT, MIN_HITS, ONE_NOTE = 30.0, 20.0, 8, 0.25
QUIET_RUN, TELEGRAPHIC, MIN_TELEGRAPHIC, MIN_DASHES, UNEVEN, MIN_SILENT_CHARS = 6, 8.0, 20, 10, 0.6, 200
MIN_VOICE_CHARS, LONG_SENTENCE, SHORT_SENTENCE, VARIED, EVEN, COMMAS = 600, 45.0, 14.0, 0.55, 0.30, 3.5
SHORT_PARAGRAPH, SNIPPETS, MIN_SENTENCES, MIN_PRONOUNS, FIRST_PERSON, CLASSICAL, FLAT_MARKS = 90.0, 0.4, 20, 10, 0.6, 3.0, 0.4
MIN_STRUCTURE_CHARS, MIN_LANDMARKS, LONG_FIRST_ACT, SHORT_LAST_ACT = 1500, 4, 0.50, 0.10
MIN_TIME_CHARS = 600


def _rule(rows: DataFrame, part: int, kind: str, value: Column, section: Column | None = None, place: Column | None = None) -> DataFrame:
    """rows as findings of one kind: part orders the kinds, place the findings of one kind."""
    zero, nowhere = F.lit(0.0), F.lit("")
    at = (zero if place is None else place).cast("double").alias("place")
    return rows.select("doc_id", F.lit(part).alias("part"), at, F.lit(kind).alias("kind"), (nowhere if section is None else section).alias("section"), value.cast("double").alias("value"))


def _listed(found: list[DataFrame], most: int | None) -> DataFrame:
    every = reduce(DataFrame.unionByName, found)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "place", "kind", "section")))
    return (ranked if most is None else ranked.where(F.col("rank") <= most)).drop("part", "place")


def _first(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col("_nth") <= k)


def _whole(wide: DataFrame, rules: list[tuple], most: int | None) -> DataFrame:
    """rules: kind, condition, value and, where it isn't the whole document, section over one row per document, in order."""
    fired = [F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(kind).alias("kind"), (at[0] if at else F.lit("")).alias("section"), value.cast("double").alias("value"))) for kind, holds, value, *at in rules]
    each = F.array_compact(F.array(*fired))
    rows = wide.select("doc_id", F.posexplode(each if most is None else F.slice(each, 1, most)).alias("rank", "f"))
    return rows.select("doc_id", "f.kind", "f.section", "f.value", (F.col("rank") + 1).alias("rank"))


def setting_issues(seg: DataFrame, ment: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Scenes without an anchor, segments that name many places, places away for long, few words for surroundings. Each kind is cut at 12."""
    fact = setting.facts(seg, ment, terms)
    place = setting.places(seg, ment)
    labels = segment_table(seg).select("doc_id", F.col("seg").alias("first_seg"), "label")
    loose = _first(setting.scenes(fact).where("unanchored"), MOST, "scene")
    crowded = _first(setting.segment_places(seg, ment).where(F.col("place_count") >= setting.CROWDED), MOST, "seg")
    away = _first(place.where("returns > 0").join(labels, ["doc_id", "first_seg"]), MOST, "rank")
    total = fact.groupBy("doc_id").agg(ratio(F.sum("env_hits"), F.sum("char_count"), 1000.0).alias("env_density"))
    found = [
        _rule(loose, 1, "unanchored", F.col("env_density"), F.col("section"), F.col("scene")),
        _rule(crowded, 2, "crowded", F.col("place_count"), F.col("label"), F.col("seg")),
        _rule(away, 3, "long_absence", F.col("longest_absence"), F.col("label"), F.col("rank")),
        _rule(total.where(F.col("env_density") < setting.THIN), 4, "thin_environment", F.col("env_density")),
    ]
    return _listed(found, None)


def cliche_issues(seg: DataFrame, found: DataFrame, speech: str = "speech_tag") -> DataFrame:
    """Phrases that come back, segments full of them, one phrase or the tags of speech that make up a quarter. found: phrase_hits(seg)."""
    points = phrases.curve(seg, found)
    by = found.groupBy("doc_id", "pattern", "category").agg(F.count("*").alias("n"), F.min("seg").alias("seg"))
    often = _first(by.where(F.col("n") >= phrases.REPEATED), MOST_REPEATED, F.desc("n"), "pattern").join(points.select("doc_id", "seg", "label"), ["doc_id", "seg"])
    total = by.groupBy("doc_id").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum(F.when(F.col("category") == speech, F.col("n")).otherwise(0)).alias("speech")).where(F.col("n") >= MIN_HITS)
    one, tags = F.col("most") / F.col("n"), F.col("speech") / F.col("n")
    return _listed(
        [
            _rule(often, 1, "repeated", F.col("n"), F.col("label"), F.col("_nth")),
            _rule(points.where((F.col("hits") > 0) & (F.col("per_10k") >= DENSE_PHRASES)), 2, "dense_segment", F.col("per_10k"), F.col("label"), F.col("seg")),
            _rule(total.where(one >= ONE_NOTE), 3, "one_note", one),
            _rule(total.where(tags >= ONE_NOTE), 4, "speech_tags", tags),
        ],
        MOST,
    )


def explicit_issues(seg: DataFrame, found: DataFrame) -> DataFrame:
    """Families that call for a warning, in the order of their table, with the segment that holds most; then dense segments."""
    family = phrases.advisories(found).select("doc_id", F.lit(1).alias("part"), F.col("ord").cast("double").alias("place"), "kind", "section", F.col("hits").cast("double").alias("value"))
    dense = phrases.curve(seg, found, phrases.EXPLICIT_FULL).where(F.col("per_10k") >= DENSE_EXPLICIT)
    return _listed([family, _rule(dense, 2, "dense_segment", F.col("per_10k"), F.col("label"), F.col("seg"))], MOST)


def dialogue_issues(seg: DataFrame) -> DataFrame:
    """No speech, speech without marks, very short or uneven speech, long silence; then segments and long speeches in reading order."""
    shares = dialogue.block_shares(seg)
    points = dialogue.curve(shares)
    size = shares.groupBy("doc_id").agg(F.max("n_segments").alias("n_segments"))
    d = dialogue.stats(seg).join(size, "doc_id").join(dialogue.segment_extremes(points), "doc_id", "left")
    c = F.col
    rules = [
        ("no_dialogue", (c("unit_count") == 0) & (c("char_count") >= MIN_SILENT_CHARS), c("char_count")),
        ("unquoted", (c("quoted_units") == 0) & (c("dash_units") >= MIN_DASHES), c("dash_units")),
        ("telegraphic", (c("unit_count") >= MIN_TELEGRAPHIC) & (c("avg_unit_chars") < TELEGRAPHIC) & (c("verdict") != "none"), c("avg_unit_chars")),
        ("uneven", (c("spread") >= UNEVEN) & (c("n_segments") >= 3), c("spread")),
        ("silent_segment", c("longest_quiet_run") >= QUIET_RUN, c("longest_quiet_run")),
    ]
    whole = _whole(d, rules, None).select("doc_id", F.lit(1).alias("part"), F.col("rank").cast("double").alias("place"), "kind", "section", "value")
    long = points.where(c("char_count") >= dialogue.MIN_SEGMENT)
    shaped = [_rule(long.where(holds), 2, kind, c("share"), c("label"), c("seg")) for kind, holds in (("silent_segment", c("share") < dialogue.SILENT), ("flooded_segment", c("share") > dialogue.FLOODED))]
    said = _first(dialogue.units(seg).where(c("chars") >= dialogue.MONOLOGUE), MOST, "seq", "nth")
    return _listed([whole, *shaped, _rule(said, 3, "monologue", c("chars"), c("label"), c("_nth"))], MOST)


def voice_findings(
    blk: DataFrame, terminators: str = TERMINATORS, raised: tuple[str, ...] = tuple(m for m, name in MARKS if name in ("问号", "叹号")),
    classical: str = dict(FUNCTION_GROUPS)["文言虚词"], persons: dict[str, str] = PERSONS, hedging: list[str] = HEDGING, assertive: list[str] = ASSERTIVE,
) -> DataFrame:
    """Fourteen observations on the voice, without a score; of a short text only that it is short."""
    text, c = F.col("content"), F.col
    rate = lambda part: round_half_up(ratio(part, F.sum(visible_chars(text)), 1000.0), 2)
    marks = sum((rate(F.sum(count_term(text, m))) for m in raised), F.lit(0.0))
    rates = blk.groupBy("doc_id").agg(marks.alias("raised"), rate(F.sum(class_chars(text, classical))).alias("classical"))
    d = voice.rhythm(blk, terminators).join(voice.pronouns(blk, persons), "doc_id").join(voice.stance(blk, hedging, assertive), "doc_id").join(rates, "doc_id")
    first = next(iter(persons))
    enough, timed, parts = c("char_count") >= MIN_VOICE_CHARS, c("sentence_count") >= MIN_SENTENCES, c("paragraph_count") >= 5
    snippets = round_half_up(ratio(c("single_sentence_paragraphs"), c("paragraph_count")), 2)
    rules = [
        ("too_short", ~enough, c("char_count")),
        ("long_sentences", enough & timed & (c("avg_sentence_chars") >= LONG_SENTENCE), c("avg_sentence_chars")),
        ("short_sentences", enough & timed & (c("avg_sentence_chars") <= SHORT_SENTENCE), c("avg_sentence_chars")),
        ("varied_rhythm", enough & timed & (c("sentence_cv") >= VARIED), c("sentence_cv")),
        ("even_rhythm", enough & timed & (c("sentence_cv") <= EVEN), c("sentence_cv")),
        ("comma_run", enough & (c("clauses_per_sentence") >= COMMAS), c("clauses_per_sentence")),
        ("short_paragraphs", enough & parts & (c("avg_paragraph_chars") <= SHORT_PARAGRAPH), c("avg_paragraph_chars")),
        ("snippet_paragraphs", enough & parts & (snippets >= SNIPPETS), snippets),
        ("no_pronouns", enough & (c("total") < MIN_PRONOUNS), c("total")),
        ("first_person", enough & (c("total") >= MIN_PRONOUNS) & (c(f"{first}_share") >= FIRST_PERSON), c(f"{first}_share")),
        ("hedging", enough & (c("verdict") == "hedging"), c("hedging_per_10k")),
        ("assertive", enough & (c("verdict") == "assertive"), c("assertive_per_10k")),
        ("classical", enough & (c("classical") >= CLASSICAL), c("classical")),
        ("flat_marks", enough & (c("raised") < FLAT_MARKS), c("raised")),
    ]
    return _whole(d, rules, MOST_VOICE)


def structure_readable(points: DataFrame) -> DataFrame:
    """doc_id, readable: whether a document is long enough for its curve to be held against a model."""
    return points.groupBy("doc_id").agg((F.sum("char_count") >= MIN_STRUCTURE_CHARS).alias("readable"))


def structure_issues(points: DataFrame, marks: DataFrame, acts: DataFrame | None = None, band: float = 8.0) -> DataFrame:
    """Six gaps in the shape of a readable document. points: the pacing curve; marks: its landmarks; acts: its acts, where it has three."""
    c = F.col
    ends = points.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("char_count").alias("chars"), F.max("tension").alias("highest"), F.max_by("tension", "seg").alias("last"), F.max_by("label", "seg").alias("last_label"), F.map_from_entries(F.collect_list(F.struct("seg", "label"))).alias("labels"))
    seen = marks.groupBy("doc_id").agg(
        F.count("*").alias("landmarks"),
        F.max(c("kind").isin("turn", "peak", "climax") & (c("position") <= 0.25)).alias("early"),
        F.max(c("position").between(0.40, 0.62)).alias("middle"),
        F.max(F.when(c("kind") == "climax", c("position"))).alias("climax"),
        F.max(F.when(c("kind") == "climax", c("seg"))).alias("climax_seg"),
    )
    d = ends.where(c("chars") >= MIN_STRUCTURE_CHARS).join(seen, "doc_id")
    if acts is None:
        d = d.withColumn("first_act", F.lit(None).cast("double")).withColumn("last_act", F.lit(None).cast("double"))
    else:
        own = acts.groupBy("doc_id").agg(F.max(F.when(c("act") == 1, c("share"))).alias("first_act"), F.max(F.when(c("act") == 3, c("share"))).alias("last_act"))
        d = d.join(own, "doc_id", "left")
    uneven = c("first_act").isNotNull() & c("last_act").isNotNull() & ((c("first_act") > LONG_FIRST_ACT) | (c("last_act") < SHORT_LAST_ACT))
    rules = [
        ("no_early_turn", ~c("early"), F.lit(0.25)),
        ("missing_midpoint", ~c("middle"), F.lit(0.5)),
        ("climax_early", c("climax") < 0.60, c("climax"), c("labels")[c("climax_seg")]),
        ("no_descent", (c("n") >= 3) & (c("last") >= c("highest") - band), c("last"), c("last_label")),
        ("act_imbalance", uneven, c("first_act")),
        ("too_few_landmarks", c("landmarks") < MIN_LANDMARKS, c("landmarks")),
    ]
    return _whole(d, rules, MOST_STRUCTURE)


def timeline_issues(seg: DataFrame, found: DataFrame) -> DataFrame:
    """What the dates of a text leave open. found: anchored(markers(seg)).

    A text without expressions, or too short to be judged, has this one finding. Only dates that name a month are put in order.
    """
    c = F.col
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    named = c("text").isin([*SOLAR_TERMS, *FESTIVALS, *WEEKDAYS]) | c("text").startswith("周")
    dated = found.where(c("date").isNotNull() & c("precision").isin(*timeline.ORDERED))
    per = found.groupBy("doc_id").agg(
        F.count("*").alias("markers"), count(c("date").isNotNull() & c("precision").isin(*timeline.ORDERED)).alias("dated"), count((c("form") == "ganzhi_year") & c("date").isNull()).alias("wheel"),
        count((c("form") == "era_year") & c("date").isNull()).alias("era"), count(c("precision") == "lunar_day").alias("lunar"), count((c("form") == "term") & named).alias("named"),
    )
    docs = seg.groupBy("doc_id").agg(F.sum(visible_chars(c("content"))).alias("chars")).join(per, "doc_id", "left").fillna(0, ["markers"])
    open_ = docs.where((c("markers") > 0) & (c("chars") >= MIN_TIME_CHARS))
    moved = timeline.steps(dated).join(found.select("doc_id", "marker", "label"), ["doc_id", "marker"]).join(open_.select("doc_id"), "doc_id", "left_semi")
    back = _first(moved.where("step = 'backstep'"), timeline.MOST_STEPS, "marker")
    ahead = _first(moved.where("step = 'jump'"), timeline.MOST_STEPS, F.desc("days"), "from_date", "to_date", "marker")
    axis = segment_table(seg).join(open_.select("doc_id"), "doc_id", "left_semi")
    bare = timeline.unmarked(axis, found).join(axis.select("doc_id", c("seg").alias("from_seg"), "label"), ["doc_id", "from_seg"])
    judged = (c("markers") > 0) & (c("chars") >= MIN_TIME_CHARS)
    rules = [
        ("no_markers", c("markers") == 0, c("markers")),
        ("too_short", (c("markers") > 0) & (c("chars") < MIN_TIME_CHARS), c("chars")),
        *[(kind, judged & (c(n) > 0), c(n)) for kind, n in (("unanchored_ganzhi", "wheel"), ("ambiguous_era", "era"), ("calendar_note", "lunar"), ("term_collision", "named"))],
        ("no_order", judged & (c("dated") < 2), c("markers")),
    ]
    whole = _whole(docs, rules, None).select("doc_id", F.lit(4).alias("part"), c("rank").cast("double").alias("place"), "kind", "section", "value")
    placed = [
        _rule(back, 1, "backstep", c("days"), c("label"), c("_nth")),
        _rule(ahead, 2, "long_jump", c("days"), c("label"), c("_nth")),
        _rule(bare, 3, "unmarked_stretch", c("n"), c("label"), c("from_seg")),
    ]
    return _listed([*placed, whole], None)


def curly_quotes(blk: DataFrame) -> DataFrame:
    """doc_id, open_quotes, close_quotes: the one pair of marks that must balance."""
    return blk.groupBy("doc_id").agg(F.sum(count_term(F.col("content"), "“")).alias("open_quotes"), F.sum(count_term(F.col("content"), "”")).alias("close_quotes"))
