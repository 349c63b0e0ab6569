"""The measures on small frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fabulary.functions import calendar, lexicon, text
from fabulary.operators import components, conflict, pacing, phrases, plot, sections, segments, setting, structure, theme, timeline, voice, words
from fabulary.plans import graph, rollups
from fabulary.sources import corpus

BLK = "project_id string, doc_id string, seq int, content string, section_path string, block_type string, title string"


def blocks(spark, *contents, doc="d", sections_=None, types=None):
    rows = [("p", doc, i, c, (sections_ or [""] * len(contents))[i], (types or ["paragraph"] * len(contents))[i], None) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, BLK)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c"))).first()[0]


def test_text_primitives(spark):
    assert one(spark, "他说。　\n好！a;b", text.sentences) == ["他说", "好", "a", "b"]
    assert one(spark, " 你　好\n😀", text.visible_chars) == 3
    assert one(spark, "“你好”他说「是 的」", text.quoted_chars) == 4
    assert one(spark, '他说"一二"又说"三', text.quote_units) == ["一二", "三"]
    assert one(spark, "—— 走吧\n旁白\n— “引”", text.dash_units) == [" 走吧"]
    assert one(spark, "进退两难两难", lambda c: text.count_terms(c, ["两难", "进退两难"])) == 3
    assert one(spark, "beautiful", text.syllables) == 3
    assert one(spark, "  ＡＢ　 c ", text.identity_key) == "ab c"


def test_lexicon_expands_and_scans(spark):
    assert lexicon.expand("(a|bc)d(e)?") == ["bcde", "ade", "bcd", "ad"]
    got = one(spark, "“微笑”微微一笑，一笑", lambda c: lexicon.occurrences(c, ["微微一笑", "(微笑|一笑)"]))
    assert [(m["start"], m["matched"], m["in_dialogue"]) for m in got] == [(1, "微笑", True), (4, "微微一笑", False), (9, "一笑", False)]


def test_segments_fall_back_to_tenths(spark):
    few = segments.with_segments(blocks(spark, *"abcd", sections_=["A", "A", "B", "B"]))
    assert [(r.seg, r.label) for r in few.orderBy("seq").collect()] == [(0, "1/10"), (1, "2/10"), (2, "3/10"), (3, "4/10")]
    assert segments.segment_table(few).count() == 10
    three = segments.with_segments(blocks(spark, *"abcd", sections_=["B / x", "A", "B / y", "C"]))
    assert [(r.seg, r.label) for r in three.orderBy("seq").collect()] == [(0, "B"), (1, "A"), (0, "B"), (2, "C")]


def test_flat_stretch_counts_its_breaker(spark):
    curve = spark.createDataFrame([("d", i, t, 10, str(i)) for i, t in enumerate([10.0, 11.0, 12.0, 13.0, 40.0, 41.0])], "doc_id string, seg int, tension double, char_count long, label string")
    got = [(r.from_section, r.to_section, r.sections) for r in pacing.flat_stretches(curve).collect()]
    assert got == [("0", "4", 5)]
    assert [(r.from_section, r.to_section) for r in pacing.flat_stretches(curve, strict=True).collect()] == [("0", "3")]


def test_pacing_of_repeated_and_empty_text(spark):
    s = pacing.stats(pacing.curve(segments.with_segments(blocks(spark, *["一句话。"] * 5, sections_=list("ABCDE"))))).first()
    assert (s.verdict, s.longest_flat_run, s.tension_stdev) == ("flat", 5, 0.0)
    assert pacing.stats(pacing.curve(segments.with_segments(blocks(spark)))).count() == 0


def test_a_very_long_sentence_drags(spark):
    seg = segments.with_segments(blocks(spark, "字" * 50_000 + "。", "“走！”", "“来！”", sections_=list("ABC")))
    points = pacing.curve(seg)
    assert {r.seg: r.length_squares for r in points.collect()} == {0: 50_000**2, 1: 5, 2: 5}
    assert [(r.seg, r.char_count) for r in pacing.drag_sections(points).collect()] == [(0, 50_001)]


def test_sentence_deviation_beyond_a_long(spark):
    n, long = 2_000_001, 6_000_000  # one long sentence among two million of one character: squares times n is 7.2e19
    row = spark.createDataFrame([(n - 1 + long, n - 1 + long * long, n), (7, 49, 1)], "total long, squares long, n long")
    got = [r[0] for r in row.select(pacing.deviation(*map(F.col, row.columns))).collect()]
    assert got == [pytest.approx(math.sqrt((n - 1 + long * long) * n - (n - 1 + long) ** 2) / n), 0.0]
    points = pacing.curve(segments.with_segments(blocks(spark, "字" * 50_000 + "。短。", sections_=["A"])))
    assert pacing.stats(points).first().sentence_stdev == pytest.approx(24_999.5)


def test_a_tension_equal_to_the_mean_is_not_below_it(spark):
    assert (0.1 + 0.1 + 0.1) / 3 > 0.1
    curve = spark.createDataFrame([(d, i, str(i), n, t) for d, low in (("d", 0.1), ("e", 0.09)) for i, (n, t) in enumerate([(100, low), (10, 0.1), (10, 0.1)])], "doc_id string, seg int, label string, char_count long, tension double")
    assert [(r.doc_id, r.seg, r["rank"]) for r in pacing.drag_sections(curve).collect()] == [("e", 0, 1)]


def test_pacing_stats_on_their_bounds(spark):
    schema = "doc_id string, seg int, label string, chunked boolean, char_count long, tension double, length_sum long, length_squares long, sentence_count long"
    point = lambda doc, i, chars, tension: (doc, i, str(i), False, chars, tension, 10, 100, 1)
    alike = [point("d", i, n, 0.1) for i, n in enumerate([100, 10, 10])]
    assert pacing.stats(spark.createDataFrame(alike, schema)).first().drag_count == 0
    # Nine zeros and 50/3 deviate by 5: in this order a step by step mean says so to the last digit or just below, whatever the order of the rows.
    tension = [0.0, 0.0, 50 / 3, *[0.0] * 7]
    n, mean, squares = 0, 0.0, 0.0
    for x in tension:
        n, was = n + 1, mean
        mean = was + (x - was) / n
        squares += (x - mean) * (x - was)
    rows = [point("b", i, 10, t) for i, t in enumerate(tension)]
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        got = pacing.stats(spark.createDataFrame(rows, schema)).first()
        assert got.tension_stdev == math.sqrt(squares / n) and got.verdict == ("flat" if got.tension_stdev < 5 else "varied")


def test_conflict_has_no_score_without_terms(spark):
    seg = segments.with_segments(blocks(spark, "平静", "战斗战斗", "安宁", sections_=list("ABC")))
    s = conflict.stats(seg).first()
    assert (s.total_hits, s.dominant_type, s.peak_section) == (2, "interpersonal", "B")
    assert conflict.stats(segments.with_segments(blocks(spark, "平静"))).first().conflict_score is None


def test_plot_shapes(spark):
    rows = [("d", "main", s, 10, 1) for s in range(10)] + [("d", "late", 9, 10, 3)] + [("d", "early", 0, 10, 4)] + [("d", "rare", 5, 10, 2)]
    presence = spark.createDataFrame(rows, "doc_id string, subject string, section int, n_sections int, n int")
    assert {r.subject: r["shape"] for r in plot.threads(presence).collect()} == {"main": "sustained", "late": "late_arrival", "early": "setup_only"}
    assert [r.subject for r in plot.unresolved(presence).collect()] == ["early"]
    assert plot.turning_points(presence).orderBy("rank").first().section == 1
    assert plot.coherence(presence).first().coherence_score == 100 - 8 - 8


def test_scenes_follow_known_places(spark):
    def scalar(rows):
        out, scene, place = [], -1, ""
        for i, (anchor, title) in enumerate(rows):
            if i == 0 or title or (anchor and place and anchor != place):
                scene, place = scene + 1, anchor
            elif anchor and not place:
                place = anchor
            out.append(scene)
        return out

    rng = random.Random(3)
    for _ in range(5):
        rows = [(rng.choice(["", "", "x", "y"]), rng.random() < 0.15) for _ in range(60)]
        df = spark.createDataFrame([("d", i, a, "title" if t else "paragraph") for i, (a, t) in enumerate(rows)], "doc_id string, seq int, anchor string, block_type string")
        assert [r.scene for r in setting.scene_ids(df).orderBy("seq").collect()] == scalar(rows)


def test_themes_join_terms(spark):
    rows = [("d", i, i % 4, t) for i in range(8) for t in ("城市", "城市建设", "河")] + [("d", 9, 1, "什么")]
    cand = theme.candidates(spark.createDataFrame(rows, "doc_id string, seq int, seg int, term string"))
    assert {r.term: r.root for r in theme.clusters(cand).collect()} == {"城市": "城市", "城市建设": "城市"}
    axis = spark.createDataFrame([("d", s, str(s), 4, False) for s in range(4)], "doc_id string, seg int, label string, n_segments int, chunked boolean")
    t = theme.themes(cand, axis).first()
    assert (t.term, t.mentions, t.reach, t.longest_gap) == ("城市", 8, "sustained", 0)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([("d", i, i + 1) for i in range(40)] + [("e", 7, 9)], "doc_id string, a int, b int")
    got = {(r.doc_id, r.root) for r in components.components(edges).collect()}
    assert got == {("d", 0), ("e", 7)}


def test_stock_phrases_and_tiers(spark):
    seg = segments.with_segments(blocks(spark, "他微微一笑，微微一笑。", "嘴角勾起", sections_=["A", "B"]))
    found = phrases.phrase_hits(seg)
    top = phrases.tallies(found).orderBy("rank").first()
    assert (top.pattern, top.n, top.variants[0]["matched"]) == ("微微一笑", 2, "微微一笑")
    assert phrases.phrase_stats(seg, found).first().cliche_score is None
    tiers = phrases.tier_counts(phrases.explicit_hits(seg, [("微微一笑", "hate", "strong")])).first()
    assert (tiers.strong, tiers.advisory) == (2, "strong")


def test_voice_blocks_pronouns_inside_words(spark):
    p = voice.pronouns(blocks(spark, "我和其他人，他们")).first()
    assert (p.first, p.third) == (1, 1)
    assert voice.stance(blocks(spark, "也许可能")).first().verdict == "hedging"


def test_time_markers(spark):
    seg = segments.with_segments(blocks(spark, "2003年3月5日出发，三天后到。", "2003-02-30不算，甲子年与甲丑年，第二天春天。", "1998年"))
    got = timeline.anchored(timeline.markers(seg)).orderBy("marker").collect()
    assert [(r.text, r.kind, r.precision) for r in got] == [("2003年3月5日", "absolute", "day"), ("三天后", "relative", "offset"), ("甲子年", "absolute", "ganzhi_year"), ("第二天", "relative", "deictic"), ("春天", "vague", "vague"), ("1998年", "absolute", "year")]
    assert got[1].offset_days == 3.0 and str(got[2].date) == "1984-01-01"
    assert timeline.span(timeline.anchored(timeline.markers(seg))).first().backsteps == 1


def test_calendar(spark):
    df = spark.createDataFrame([(1984, "甲子"), (1983, "癸亥"), (2000, "甲丑")], "y int, t string")
    got = df.select(calendar.pair_of(calendar.wheel_index(F.col("y"))), calendar.index_of_pair(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("甲子", 0), ("癸亥", 59), ("庚辰", None)]
    assert [one(spark, s, calendar.number) for s in ("二十三", "十", "十二", "2003", "一九九八", "两")] == [23, 10, 12, 2003, 1998, 2]
    eras = spark.createDataFrame(calendar.SOME_ERAS, "name string, start_year int, end_year int")
    reigns = spark.createDataFrame([("至元", 3), ("至元", 20), ("开元", 99)], "name string, regnal int")
    assert {(r.name, r.regnal): r.years for r in calendar.era_years(reigns, eras).collect()} == {("至元", 3): [1266, 1337], ("至元", 20): [1283], ("开元", 99): []}


def test_beats_are_found_displaced_or_missing(spark):
    marks = spark.createDataFrame([("d", "opening", 0, 0.05, 50.0), ("d", "climax", 8, 0.99, 90.0), ("d", "turn", 3, 0.25, 0.5)], "doc_id string, kind string, seg int, position double, strength double")
    got = {(r.model, r.beat): r.status for r in structure.beats(marks).collect()}
    assert got["three_act", "setup"] == "found" and got["three_act", "climax"] == "displaced" and got["three_act", "midpoint"] == "missing"
    assert len(got) == 17


def test_words_and_phrases(spark):
    tok = corpus.tokens(blocks(spark, "red fox ran red fox ran red fox ran red fox ran red fox ran"))
    got = {r.phrase: r.n for r in words.repeated_phrases(tok, gap=1).collect()}
    assert got == {"red fox": 5, "fox ran": 5, "red fox ran": 5}
    assert [(r.term, r.n) for r in words.top_words(tok).orderBy("rank").collect()] == [("fox", 5), ("ran", 5), ("red", 5)]


def test_fast_forms_equal_the_plain_ones(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aebc  \n\n.!?。　\u00a0é́，\"—A") for _ in range(rng.randrange(0, 120))) for _ in range(150)] + [None, "", "\n \n"]
    docs = spark.createDataFrame([(f"d{i}", "s", t) for i, t in enumerate(texts)], "doc_id string, source string, text string")
    made, plain = corpus.segmented(docs), segments.with_segments(corpus.blocks(docs))
    key = lambda df: sorted(map(str, df.select(*sorted(plain.columns)).collect()))
    assert set(made.columns) == set(plain.columns) and key(made) == key(plain)
    for ends in (text.TERMINATORS, ".!?;"):
        lengths = docs.where("text IS NOT NULL").select(text.sentence_lengths(F.col("text"), ends).alias("a"), F.transform(text.sentences(F.col("text"), ends), text.visible_chars).alias("b"))
        assert all(r.a == r.b for r in lengths.collect())
    word = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    each = F.aggregate(F.transform(word, lambda w: F.greatest(F.regexp_count(F.lower(w), F.lit("[aeiouy]+")), F.lit(1))), F.lit(0), lambda a, x: a + x)
    assert docs.where(text.syllables(F.col("text")) != each).count() == 0
    blk = corpus.blocks(docs)
    phrases_ = lambda df: sorted(map(str, df.select("doc_id", "phrase", "n", "rank").collect()))
    assert phrases_(words.text_phrases(blk, 1)) == phrases_(words.repeated_phrases(corpus.tokens(blk), gap=1, least=1))


def test_arc_shape(spark):
    pts = lambda v: spark.createDataFrame([("d", i, x) for i, x in enumerate(v)], "doc_id string, seg int, intensity double")
    shape = lambda v: sections.arc_shape(pts(v)).first()["shape"]
    assert [shape(v) for v in ([0.1, 0.9, 0.1], [0.1, 0.5, 0.9], [0.9, 0.5, 0.1], [0.5, 0.5], [0.5, 0.5, 0.5])] == ["mountain", "rising", "falling", "steady", "steady"]


def test_graph_checks(spark):
    node = spark.createDataFrame([("p", "a", "A", 1, "PERSON", 0.5), ("p", "a", "B", 9, "PERSON", 2.0)], "project_id string, id string, label string, layer int, type string, weight double")
    edge = spark.createDataFrame([("p", "e", "a", "z", 0.5)], "project_id string, id string, source string, target string, strength double")
    assert {r.issue for r in graph.validate(node, edge).collect()} == {"duplicate_node", "layer", "weight", "missing_end"}


def test_recommendations_and_groups(spark):
    wide = spark.createDataFrame([("d", 50.0, 0.2, 0.1, 120.0, 0.0, 0.0, 4.0)], "doc_id string, readability double, long_share double, adverb_ratio double, top_adverb double, repeat_ratio double, top_phrase double, max_ratio double")
    assert [r.rule for r in rollups.recommendations(wide).orderBy("ord").collect()] == ["hard_to_read", "many_long_sentences", "one_adverb_overused", "one_section_too_long", "many_adverbs"]
    items = rollups.checklist(wide, {"t0-readability": F.col("readability") < 60})
    assert {r.group: r.n for r in rollups.checklist_groups(wide, items).collect()} == {"consistency": 0, "structure": 0, "language": 1, "advisory": 0}


def test_same_rows_whatever_the_partitions(spark):
    blk = blocks(spark, *[f"Line {i}, some words! More? Yes." for i in range(30)], sections_=[f"s{i // 5}" for i in range(30)])
    a = sorted(map(tuple, pacing.curve(segments.with_segments(blk)).collect()), key=str)
    b = sorted(map(tuple, pacing.curve(segments.with_segments(blk.repartition(7))).collect()), key=str)
    assert a == b


def test_narratives_stand_in_their_shells_and_link_to_nodes(spark):
    threads = [("p", s, shape, main, 0.9, i) for i, (s, shape, main) in enumerate([("Ann", "sustained", True), ("Bob", "burst", True), ("Cid", "minor", False), ("Dan", "late_arrival", False), ("Eve", "setup_only", False), ("Flo", "sustained", False)] + [(f"T{k}", "burst", False) for k in range(30)])]
    lines = spark.createDataFrame(threads, "project_id string, subject string, shape string, is_main boolean, coverage double, rank int")
    turns = spark.createDataFrame([("p", "c2", 1.5, ["bob", "nobody", "ANN"], 1)], "project_id string, section string, change double, appeared array<string>, rank int")
    themes = spark.createDataFrame([("p", "sea", 0.5, 1), ("p", "unborne", 0.5, 2)], "project_id string, term string, coverage double, rank int")
    names = ["Ann", "Bob", "Dan", "Sea"]
    node = spark.createDataFrame([("p", f"n{i}", n, 1, "PERSON", 0.5) for i, n in enumerate(names)], "project_id string, id string, label string, layer int, type string, weight double")
    got = {r.label: r for r in graph.narratives(lines, node, turns, themes).collect()}
    assert {k: got[k].type for k in ("Ann", "Bob", "Dan", "Eve", "c2", "sea")} == {"Ann": "rain_band", "Bob": "tethered_balloon", "Dan": "satellite", "Eve": "free_balloon", "c2": "tornado", "sea": "cloud"}
    assert not {"Cid", "Flo", "unborne"} & set(got) and got["c2"].links == ["n1", "n0"] and got["c2"].stability == 0.0 and got["Eve"].links == []
    for i, label in enumerate(["Ann", "Bob", "Dan", "Eve"] + [f"T{k}" for k in range(30)] + ["c2", "sea"]):
        r = got[label]
        radius, polar, turn = graph.SHELLS[r.type], 0.7 + 0.15 * (i % 4), i * graph.GOLDEN_ANGLE
        assert r.nth == i and (r.x, r.y, r.z) == pytest.approx((radius * math.sin(polar) * math.cos(turn), radius * math.cos(polar), radius * math.sin(polar) * math.sin(turn)))
    edge = spark.createDataFrame([], "project_id string, id string, source string, target string, strength double")
    fine = graph.narratives(lines, node, turns, themes)
    project = spark.createDataFrame([("p", graph.VERSION, "Book")], "project_id string, version string, name string")
    assert graph.validate(node, edge, fine, project).collect() == []
    broken = fine.limit(1).withColumns({"x": F.lit(99.0), "stability": F.lit(2.0), "links": F.array(F.lit("none"))})
    bad = spark.createDataFrame([("q", "0.9", " "), ("r", None, None)], "project_id string, version string, name string")
    issues = sorted((r.project_id, r.issue) for r in graph.validate(node, edge, fine.union(broken), bad).collect())
    assert issues == [("p", "altitude"), ("p", "dangling_link"), ("p", "duplicate_narrative"), ("p", "stability"), ("q", "name"), ("q", "version"), ("r", "name"), ("r", "version")]
