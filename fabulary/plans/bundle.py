"""The whole review of a corpus: fifteen dimensions of each document, and the rows in which they are stored.

All dimensions are frames keyed by doc_id over one block table with segments; nothing is collected. What a rule of the
checklist needs from another dimension travels as one narrow row per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions.calendar import SOME_ERAS
from fabulary.functions.lexicons import ADVERB_STOP_WORDS, ASSERTIVE, EXPLICIT_TERMS, HEDGING, PERSONS, STOCK_PHRASES
from fabulary.functions.text import TERMINATORS, ratio
from fabulary.operators.components import ensure_checkpoint_dir
from fabulary.operators import conflict, dialogue, findings, pacing, phrases, plot, sections, segments, setting, structure, theme, timeline, voice, words
from fabulary.plans import rollups

#: Dimension, tier, and the column of its score where it has one.
DIMENSIONS = (
    ("t0", "t0", None), ("t1", "t1", None), ("plot", "t1", "coherence_score"), ("pacing", "t1", "pace_score"), ("conflict", "t1", "conflict_score"),
    ("theme", "t1", "theme_score"), ("setting", "t1", "setting_score"), ("cliche", "t1", "cliche_score"), ("dialogue", "t1", None),
    ("explicit", "t1", None), ("structure", "t1", None), ("timeline", "t1", None), ("voice", "t1", None), ("checklist", "t1", None), ("assessment", "t1", "overall"),
)


def _tagged_adverb() -> Column:
    return F.col("pos").isin(*words.ADVERB_POS) & ~F.col("text").isin(ADVERB_STOP_WORDS)


@dataclass(frozen=True)
class Lexicons:
    """The word lists of a review; the defaults are those for Chinese prose."""

    terminators: str = TERMINATORS
    conflict: dict[str, list[str]] | None = None
    stock: Sequence[tuple] = field(default_factory=lambda: STOCK_PHRASES)
    explicit: Sequence[tuple] = field(default_factory=lambda: EXPLICIT_TERMS)
    surroundings: list[str] | None = None
    persons: dict[str, str] = field(default_factory=lambda: PERSONS)
    hedging: list[str] = field(default_factory=lambda: HEDGING)
    assertive: list[str] = field(default_factory=lambda: ASSERTIVE)
    adverb: Callable[[], Column] = _tagged_adverb
    eras: Sequence[tuple] = field(default_factory=lambda: SOME_ERAS)


def word_use(blk: DataFrame, tok: DataFrame | None, repeated: DataFrame | None, lex: Lexicons) -> DataFrame:
    """words, adverb_ratio, top_adverb, repeat_ratio, top_phrase and repeated (how many phrases) of each document; 0 where nothing is known."""
    d, names = blk.select("doc_id").distinct(), ["words", "adverbs", "top_adverb", "repeats", "top_phrase", "repeated"]
    if tok is not None:
        # Only adverbs are told apart: the other words of a document are one row.
        each = tok.groupBy("doc_id", F.when(lex.adverb(), F.col("text")).alias("adverb")).agg(F.count("*").alias("n"))
        some = F.when(F.col("adverb").isNotNull(), F.col("n")).otherwise(0)
        d = d.join(each.groupBy("doc_id").agg(F.sum("n").alias("words"), F.sum(some).alias("adverbs"), F.max(some).alias("top_adverb")), "doc_id", "left")
    if repeated is not None:
        d = d.join(repeated.groupBy("doc_id").agg(F.sum("n").alias("repeats"), F.max("n").alias("top_phrase"), F.count("*").alias("repeated")), "doc_id", "left")
    d = d.select("doc_id", *[F.coalesce(n, F.lit(0)).alias(n) if n in d.columns else F.lit(0).alias(n) for n in names])
    return d.withColumn("adverb_ratio", ratio(F.col("adverbs"), F.col("words"))).withColumn("repeat_ratio", ratio(F.col("repeats"), F.col("words"))).drop("adverbs", "repeats")


def theme_source(signals: DataFrame | None, tok: DataFrame | None) -> DataFrame | None:
    """doc_id, seq, term: the noun signals of a document, or its nouns where it has none."""
    nouns = None if tok is None else tok.where(F.col("pos").isin(*theme.NOUN_POS)).select("doc_id", "seq", F.col("text").alias("term"))
    if signals is None:
        return nouns
    own = signals.select("doc_id", "seq", F.col("text").alias("term"))
    return own if nouns is None else own.unionByName(nouns.join(own.select("doc_id").distinct(), "doc_id", "left_anti"))


def measure(seg: DataFrame, tok: DataFrame | None = None, ment: DataFrame | None = None, signals: DataFrame | None = None, repeated: DataFrame | None = None, lex: Lexicons | None = None, only: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """A frame for each of the fifteen dimensions: those of review(), and the themes. `only`: the dimensions to plan, by default all.

    Themes need the connected components of terms, which run as jobs of their own while this plan is made. Without terms
    they have no rows.
    """
    wanted = None if only is None else set(only)
    found = review(seg, tok, ment, signals, repeated, lex, wanted)
    if wanted is not None and "theme" not in wanted:
        return found
    terms = theme_source(signals, tok)
    if terms is None:
        found["theme"] = seg.select("doc_id", F.lit(None).cast("double").alias("theme_score")).where("false")
    else:
        cand = theme.candidates(terms.join(seg.select("doc_id", "seq", "seg"), ["doc_id", "seq"]))
        found["theme"] = theme.score(theme.themes(cand, segments.segment_table(seg)), cand)
    return found


def checkpointed(rows: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()


class Plans(dict):
    """Frames by name, each planned when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        super().__init__()
        self.makers = makers

    def __missing__(self, name: str) -> DataFrame:
        self[name] = made = self.makers[name]()
        return made


def review(seg: DataFrame, tok: DataFrame | None = None, ment: DataFrame | None = None, signals: DataFrame | None = None, repeated: DataFrame | None = None, lex: Lexicons | None = None, only: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """All dimensions but the themes, and the lists that belong to them under names of their own; no job is run.

    seg: blocks with segments; ment: mentions with category and nth; signals: doc_id, seq, nth, text; repeated: the
    repeated phrases, by default those of the tokens. What can't be told without tokens, mentions or signals is 0 or null.
    With `only`, nothing is planned but what those frames need.
    """
    p = plans(seg, tok, ment, signals, repeated, lex)
    names = [n for n in p.makers if not n.startswith("_")]
    return {n: p[n] for n in names if only is None or n in only}


def plans(seg: DataFrame, tok: DataFrame | None = None, ment: DataFrame | None = None, signals: DataFrame | None = None, repeated: DataFrame | None = None, lex: Lexicons | None = None, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Plans:
    """The frames of review(); names with a leading underscore are what several of them share.

    keep: what becomes of the frames that others are made of, by default nothing. Writing them down (`checkpointed`) has
    each read the text once, where one plan of all would read it again for every use, and keeps the plans small.
    """
    lex = lex or Lexicons()
    spark = seg.sparkSession
    if ment is None:
        ment = spark.createDataFrame([], "doc_id string, seq int, nth int, text string, category string").select(F.col("doc_id").cast(seg.schema["doc_id"].dataType), "seq", "nth", "text", "category")
    if repeated is None and tok is not None:
        repeated = words.repeated_phrases(tok)

    def turns() -> DataFrame:
        # Turns are sections by full path; the segment of a section is that of its first block.
        path = seg.groupBy("doc_id", "section_path").agg(F.min(F.struct("seq", "seg")).alias("f"))
        order = F.row_number().over(Window.partitionBy("doc_id").orderBy("f.seq")) - 1
        made = plot.turning_points(p["_presence"]).join(path.select("doc_id", order.alias("section"), F.col("f.seg").alias("seg")), ["doc_id", "section"])
        return made.select("doc_id", F.col("seg").alias("section"), "change")

    p = Plans({
        "_points": lambda: keep(pacing.curve(seg, ment, lex.terminators)),
        "_presence": lambda: keep(plot.subjects(seg, ment, signals)),
        "_turns": turns,
        "_acts": lambda: structure.acts(p["_points"], p["_turns"]),
        "_stock": lambda: keep(phrases.phrase_hits(seg, lex.stock).drop("excerpt")),
        "_strong": lambda: keep(phrases.explicit_hits(seg, lex.explicit).drop("excerpt")),
        "t0": lambda: keep(words.sentence_stats(seg, lex.terminators).join(words.readability(seg, lex.terminators), "doc_id").join(word_use(seg, tok, repeated, lex), "doc_id")),
        "t1": lambda: sections.extreme_sections(seg),
        "plot": lambda: plot.coherence(p["_presence"]),
        "pacing": lambda: keep(pacing.stats(p["_points"])),
        "conflict": lambda: keep(conflict.stats(seg, lex.conflict)),
        "setting": lambda: keep(setting.stats(setting.facts(seg, ment, lex.surroundings), setting.places(seg, ment))),
        "cliche": lambda: keep(phrases.phrase_stats(seg, p["_stock"])),
        "dialogue": lambda: dialogue.stats(seg),
        "explicit": lambda: phrases.tier_counts(p["_strong"]),
        "structure": lambda: structure.model_fit(structure.beats(p["landmarks"])),
        "timeline": lambda: keep(timeline.anchored(timeline.markers(seg, [name for name, *_ in lex.eras]), spark.createDataFrame(list(lex.eras), "name string, start_year int, end_year int"))),
        "voice": lambda: voice.rhythm(seg, lex.terminators),
        "landmarks": lambda: keep(structure.landmarks(p["_points"], p["_turns"])),
        "threads": lambda: plot.plotlines(p["_presence"]),
        "setting_issues": lambda: findings.setting_issues(seg, ment, lex.surroundings),
        "cliche_issues": lambda: findings.cliche_issues(seg, p["_stock"]),
        "explicit_issues": lambda: findings.explicit_issues(seg, p["_strong"]),
        "dialogue_issues": lambda: findings.dialogue_issues(seg),
        "structure_issues": lambda: keep(findings.structure_issues(p["_points"], p["landmarks"], p["_acts"])),
        "timeline_issues": lambda: findings.timeline_issues(seg, p["timeline"]),
        "_wide": lambda: keep(review_inputs(seg, p, p["_presence"], p["_points"], ment, p["_strong"], lex)),
        "checklist": lambda: rollups.checklist(p["_wide"], rollups.checklist_conditions()),
        "assessment": lambda: rollups.assessment(p["_wide"]),
        "recommendations": lambda: rollups.recommendations(p["_wide"]),
    })
    return p


def review_inputs(seg: DataFrame, found: dict[str, DataFrame], presence: DataFrame, points: DataFrame, ment: DataFrame, strong: DataFrame, lex: Lexicons) -> DataFrame:
    """One row per document with all that the checklist, the assessment and the recommendations judge."""
    c = F.col
    counted = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    moved = timeline.steps(found["timeline"].where(c("date").isNotNull() & c("precision").isin(*timeline.ORDERED))).where("step = 'backstep'")
    chars = seg.groupBy("doc_id").agg(F.sum(findings.visible_chars(c("content"))).alias("time_chars"))
    parts = [
        found["t0"].select("doc_id", c("score").alias("readability"), "sentence_count", ratio(c("above_100"), c("sentence_count")).alias("long_share"), "adverb_ratio", "top_adverb", "repeat_ratio", "top_phrase", "repeated"),
        rollups.section_balance(sections.section_sizes(seg)).select("doc_id", "max_ratio"),
        counted(plot.single_section(presence), "unresolved"),
        counted(plot.unresolved(presence, "late_arrival"), "late_arrivals"),
        counted(moved, "backsteps"),
        counted(found["timeline"], "markers").join(chars, "doc_id", "right"),
        counted(ment.where("category in ('DATE', 'TIME')"), "entity_dates"),
        counted(ment, "entities"),
        found["setting"].select("doc_id", "scene_count", "places_measured", "unanchored_share"),
        counted(found["structure_issues"], "structure_issues"),
        findings.structure_readable(points).withColumnRenamed("readable", "structure_readable"),
        found["pacing"].select("doc_id", "drag_count"),
        found["conflict"].select("doc_id", c("total_hits").alias("conflict_hits"), "longest_absent_run"),
        dialogue.segment_extremes(dialogue.curve(dialogue.block_shares(seg))).select("doc_id", "silent_segments"),
        found["cliche"].select("doc_id", c("total_hits").alias("cliche_hits")),
        findings.curly_quotes(seg),
        voice.stance(seg, lex.hedging, lex.assertive).select("doc_id", c("verdict").alias("stance")),
        counted(strong, "explicit_hits"),
        counted(phrases.advisories(strong).where("kind = 'self_harm'"), "self_harm"),
    ]
    wide = seg.select("doc_id").distinct()
    for part in parts:
        wide = wide.join(part, "doc_id", "left")
    counts = [f.name for f in wide.schema.fields if f.dataType.typeName() in ("long", "integer") and f.name != "doc_id"]
    wide = wide.fillna(0, counts).fillna(False, ["places_measured", "structure_readable"]).fillna(0.0, ["unanchored_share"])
    return wide.withColumn("time_readable", (c("markers") > 0) & (c("time_chars") >= findings.MIN_TIME_CHARS))


def dimension_rows(found: dict[str, DataFrame], hashes: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """doc_id, input_hash, dimension, tier, score, data: fifteen rows for each document of hashes (doc_id, hash), or those of `only`.

    data is the JSON of a document's rows of that dimension, in the order of their columns, '[]' without any. The score
    is null where a dimension has none or nothing to measure. Without an assessment there is nothing to store: an error.
    """
    wanted = [d for d in DIMENSIONS if only is None or d[0] in only]
    missing = [name for name, *_ in wanted if name not in found]
    if missing:
        raise ValueError(f"no rows for the dimensions {missing}")
    rows = None
    for name, tier, score in wanted:
        frame = found[name]
        columns = [n for n in frame.columns if n != "doc_id"]
        value = F.max(F.col(score).cast("double")) if score else F.lit(None).cast("double")
        data = frame.groupBy("doc_id").agg(value.alias("score"), F.sort_array(F.collect_list(F.to_json(F.struct(*columns)))).alias("items"))
        one = hashes.join(data, "doc_id", "left").select("doc_id", F.col("hash").alias("input_hash"), F.lit(name).alias("dimension"), F.lit(tier).alias("tier"), "score", F.concat(F.lit("["), F.coalesce(F.array_join("items", ","), F.lit("")), F.lit("]")).alias("data"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def concerns(recommended: DataFrame) -> DataFrame:
    """The recommendations as stored concerns: an unknown severity counts as medium; they name no place in the text."""
    severity = F.when(F.col("severity").isin("high", "low"), F.col("severity")).otherwise("medium")
    none = F.lit(None).cast("string")
    return recommended.select("doc_id", F.col("ord").alias("id"), severity.alias("severity"), F.col("rule").alias("title"), F.col("dimension").alias("description"), none.alias("section_path"), none.alias("suggestion"))
