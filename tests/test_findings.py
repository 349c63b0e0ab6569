"""Findings, the checklist and the stored bundle on planted texts."""

import json
import re

import pytest
from pyspark.sql import functions as F

from fabulary.functions import lexicon
from fabulary.functions.lexicons import ADVERB_STOP_WORDS
from fabulary.operators import dialogue, findings, phrases, plot, segments, timeline, words
from fabulary.plans import api, bundle, rollups
from fabulary.plans.store import document_hashes
from tests.test_measures import blocks


def kinds(rows, doc="d"):
    return [(r.kind, r.section) for r in rows.where(F.col("doc_id") == doc).orderBy("rank").collect()]


def mentions(spark, *rows):
    return spark.createDataFrame([("d", *r) for r in rows], "doc_id string, seq int, nth int, text string, category string")


def test_presence_counts_each_mention_and_takes_the_first_kind(spark):
    blk = blocks(spark, "a", "b", "c", sections_=["s1", "s2", "s1"])
    ment = mentions(spark, (1, 0, "沈默", "PERSON"), (2, 0, "沈默", "PERSON"), (2, 1, "沈默", "LOCATION"), (2, 2, " ", "PERSON"), (0, 0, "昨天", "DATE"))
    sig = spark.createDataFrame([("d", 0, 0, "沈默"), ("d", 1, 0, "雨")], "doc_id string, seq int, nth int, text string")
    got = {(r.subject, r.section): (r.n, r.n_sections, r.kind) for r in plot.subjects(blk, ment, sig).collect()}
    assert got == {("沈默", 0): (3, 2, "SIGNAL"), ("沈默", 1): (1, 2, "SIGNAL"), ("雨", 1): (1, 2, "SIGNAL")}
    assert {(r.subject, r.kind) for r in plot.subjects(blk, ment).collect()} == {("沈默", "PERSON")}


def test_entities_and_signals_are_ranked_with_ties_by_name(spark):
    ment = mentions(spark, (0, 0, "乙", "PERSON"), (0, 1, "甲", "PERSON"), (1, 0, "京", "LOCATION"))
    assert [(r.category, r.n) for r in words.entity_counts(ment).orderBy("rank").collect()] == [("PERSON", 2), ("LOCATION", 1)]
    assert [r.term for r in words.top_texts(ment, 2).orderBy("rank").collect()] == ["乙", "京"]


def test_dialogue_issues_in_order(spark):
    seg = segments.with_segments(blocks(spark, *["旁白" * 60] * 7, "“" + "话" * 400 + "”", "字" * 350, sections_=["a"] * 7 + ["b", "c"]))
    assert kinds(findings.dialogue_issues(seg)) == [("uneven", ""), ("silent_segment", ""), ("silent_segment", "a"), ("flooded_segment", "b"), ("silent_segment", "c"), ("monologue", "b")]
    assert kinds(findings.dialogue_issues(segments.with_segments(blocks(spark, *["— 走"] * 10)))) == [("unquoted", "")]
    assert {r.bucket: r.n for r in dialogue.unit_buckets(seg).collect()} == {"1-9": 0, "10-29": 0, "30-99": 0, "100-299": 0, "300+": 1}


def test_phrases_that_come_back(spark):
    seg = segments.with_segments(blocks(spark, "aa aa aa bb", "bb" * 3 + " cc", sections_=["x", "y"]))
    found = phrases.phrase_hits(seg, [("aa", "k"), ("bb", "speech_tag"), ("cc", "k")])
    assert kinds(findings.cliche_issues(seg, found)) == [("repeated", "1/10"), ("repeated", "1/10"), ("dense_segment", "1/10"), ("dense_segment", "2/10"), ("one_note", ""), ("speech_tags", "")]


def test_short_texts_have_one_voice_finding(spark):
    blk = blocks(spark, "他说好。").unionByName(blocks(spark, *["我" * 50 + "。" for _ in range(24)], doc="e"))
    found = findings.voice_findings(blk)
    assert kinds(found) == [("too_short", "")]
    assert [k for k, _ in kinds(found, "e")] == ["long_sentences", "even_rhythm", "short_paragraphs", "snippet_paragraphs", "first_person", "flat_marks"]


def test_matches_go_without_their_text(spark):
    text = "“aa”aa「aa x\naa」 aa\"aa"
    seg = segments.with_segments(blocks(spark, text, "aa", "“", "aa", sections_=["s"] * 4))
    found = phrases.phrase_hits(seg, [("aa", "k"), ('(x|”)', "l")])
    got = sorted((r.seq, r.start, r.matched, r.in_dialogue) for r in found.collect())
    each = seg.select("seq", F.explode(lexicon.occurrences(F.col("content"), ["aa", '(x|”)'])).alias("m")).select("seq", "m.start", "m.matched", "m.in_dialogue")
    assert len(got) == 10 and got == sorted(map(tuple, each.collect()))
    lines = found.drop("excerpt")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = [line for at, line in enumerate(lines) if "_nth" in line and "Window" in lines[at - 1]]
    assert below and not any(re.search(r"[\[ ]content#\d+[,\]]", line) for line in below)


def test_only_phrases_that_come_back_become_rows(spark):
    blk = blocks(spark, *["ab cd ef"] * 3, "ab cd, ab cd", "gh ij " * 4 + "gh", "ab-cd").unionByName(blocks(spark, "", doc="e"))
    made = words.text_phrases(blk)
    assert [(r.phrase, r.n, r["rank"]) for r in made.orderBy("rank").collect()] == [("ab cd", 6, 1)]
    assert [(r.phrase, r.n) for r in words.text_phrases(blk, 4).orderBy("rank").collect()] == [("ab cd", 6), ("gh ij", 4), ("gh ij gh", 4), ("ij gh", 4)]
    assert {(r.phrase, r.n) for r in words.text_phrases(blk, 1, 99).collect()} >= {("ab cd ef", 3), ("gh ij gh", 4), ("ij gh ij", 3), ("cd ef", 3)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("collect_list")  # rows are made above the gathering of a document


def test_words_are_counted_without_a_row_for_each(spark):
    tok = spark.createDataFrame([("d", w, p) for w, p in (("很", "AD"), ("很", "AD"), ("很", "NN"), ("快", "AD"), ("不", "AD"), ("走", None))], "doc_id string, text string, pos string")
    use = bundle.word_use(blocks(spark, "a").unionByName(blocks(spark, "b", doc="e")), tok, None, bundle.Lexicons())
    got = {r.doc_id: (r.words, r.top_adverb) for r in use.collect()}
    assert got["d"][0] == 6 and got["e"] == (0, 0) and got["d"][1] == (2 if "很" not in ADVERB_STOP_WORDS else 1)


def test_time_issues_search_the_texts_once(spark):
    from fabulary.plans import reviews

    plan = reviews.timeline_issues(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # the expressions are read where they were written down
    seg = segments.with_segments(blocks(spark, "a\x01b1920年3月1日，2月30日，9999年99月1日，甲丑年，1921年。", sections_=["x"]))
    found = timeline.markers(seg)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") < 30  # no condition repeats the forms
    assert [(r.marker, r.text, r.start) for r in found.orderBy("marker").collect()] == [(0, "1920年3月1日", 3), (1, "2月30日", 13), (2, "1921年", 34)]


def test_time_issues_of_planted_texts(spark):
    pad = "字" * 150
    said = ["1920年3月1日，" + pad, "1918年5月2日，" + pad, "1925年1月1日，" + pad, "清明前后，" + pad]
    blk = blocks(spark, *said, sections_=list("abcd")).unionByName(blocks(spark, "没有时间", doc="n")).unionByName(blocks(spark, "1920年3月1日", doc="s"))
    seg = segments.with_segments(blk)
    found = findings.timeline_issues(seg, timeline.anchored(timeline.markers(seg)))
    assert kinds(found) == [("backstep", "b"), ("long_jump", "c"), ("term_collision", "")]
    assert kinds(found, "n") == [("no_markers", "")] and kinds(found, "s") == [("too_short", "")]


def test_structure_gaps(spark):
    points = spark.createDataFrame([("d", i, f"s{i}", 400, t) for i, t in enumerate([10.0, 60.0, 10.0, 10.0, 58.0])], "doc_id string, seg int, label string, char_count long, tension double")
    marks = spark.createDataFrame([("d", "opening", 0, 0.1, 10.0), ("d", "climax", 1, 0.3, 60.0)], "doc_id string, kind string, seg int, position double, strength double")
    assert kinds(findings.structure_issues(points, marks)) == [("no_early_turn", ""), ("missing_midpoint", ""), ("climax_early", "s1"), ("no_descent", "s4"), ("too_few_landmarks", "")]
    acts = spark.createDataFrame([("d", 1, 0.6), ("d", 2, 0.2), ("d", 3, 0.2)], "doc_id string, act int, share double")
    assert ("act_imbalance", "") in kinds(findings.structure_issues(points, marks, acts))
    assert findings.structure_issues(points.withColumn("char_count", F.lit(10)), marks).count() == 0


QUIET = dict(
    unresolved=0, late_arrivals=0, backsteps=0, time_readable=True, entity_dates=0, scene_count=0, places_measured=False, unanchored_share=0.0, entities=0, structure_issues=0, structure_readable=True, drag_count=0,
    conflict_hits=0, longest_absent_run=0, silent_segments=0, cliche_hits=0, repeated=0, top_adverb=0, sentence_count=0, readability=0.0, open_quotes=0, close_quotes=0, stance="balanced", explicit_hits=0, self_harm=0,
)
FIRED = {
    "plot-unresolved": dict(unresolved=1), "plot-late": dict(late_arrivals=1), "timeline-backstep": dict(backsteps=1), "timeline-unreadable": dict(time_readable=False, entity_dates=1),
    "setting-unanchored": dict(scene_count=2, places_measured=True, unanchored_share=0.3), "entity-alias": dict(entities=1), "structure-issue": dict(structure_issues=1), "structure-unreadable": dict(structure_readable=False),
    "pacing-drag": dict(drag_count=1), "conflict-absent": dict(conflict_hits=1, longest_absent_run=3), "dialogue-silent": dict(silent_segments=1), "cliche-hits": dict(cliche_hits=1), "t0-repeat": dict(repeated=1), "t0-adverb": dict(top_adverb=20),
    "t0-readability": dict(sentence_count=1, readability=59.9), "voice-quotes": dict(open_quotes=2, close_quotes=1), "voice-hedging": dict(stance="hedging"), "explicit-advisory": dict(explicit_hits=1), "explicit-self-harm": dict(self_harm=1),
}


def test_each_rule_of_the_checklist_fires_alone(spark):
    rows = [{"doc_id": rule, **QUIET, **change} for rule, change in FIRED.items()] + [{"doc_id": "quiet", **QUIET}]
    wide = spark.createDataFrame(rows, ", ".join(f"{k} {'string' if isinstance(v, str) else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'long'}" for k, v in rows[0].items()))
    items = rollups.checklist(wide, rollups.checklist_conditions())
    assert {(r.doc_id, r.id) for r in items.collect()} == {(rule, rule) for rule in FIRED}
    assert {(r.group, r.n) for r in rollups.checklist_groups(wide, items).where("doc_id = 'quiet'").collect()} == {(g, 0) for g in rollups.GROUPS}


def test_fifteen_rows_for_each_document(spark, tmp_path):
    blk = blocks(spark, *["他说：“走吧。”风很大，众人都不作声。" * 8] * 6, sections_=list("aabbcc")).unionByName(blocks(spark, "短。", doc="e"))
    found = api.analyse(blk)
    rows = bundle.dimension_rows(found, document_hashes(blk))
    got = rows.collect()
    assert len(got) == 30 and {r.dimension for r in got} == {name for name, *_ in bundle.DIMENSIONS}
    assert all(isinstance(json.loads(r.data), list) for r in got)
    # Without mentions and signals no thread can be traced, which leaves plot without a score.
    scored = {r.dimension for r in got if r.doc_id == "d" and r.score is not None}
    assert scored >= {"pacing", "assessment"} and not scored & {"plot", "theme", "t0", "voice"}
    with pytest.raises(ValueError, match="assessment"):
        bundle.dimension_rows({k: v for k, v in found.items() if k != "assessment"}, document_hashes(blk))


def test_concerns_keep_unknown_severities_as_medium(spark):
    rec = spark.createDataFrame([("d", 0, "high", "x", "r"), ("d", 1, "odd", "x", "s")], "doc_id string, ord int, severity string, dimension string, rule string")
    assert {r.title: r.severity for r in bundle.concerns(rec).collect()} == {"r": "high", "s": "medium"}
