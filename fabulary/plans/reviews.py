"""Queries for presence, entities and findings, and SQL for measures that queries.py registers; part of its tables of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabulary.operators import conflict, dialogue, findings, pacing, phrases, plot, sections, segments, setting, structure, timeline, words
from fabulary.plans import bundle, rollups
from fabulary.plans import queries as q
from fabulary.plans.queries import ORACLE, STOPS, doc_blocks, doc_segments, query
from fabulary.sources import corpus

#: The word lists of the review over the tables, which hold no Chinese.
LATIN = bundle.Lexicons(
    terminators=STOPS, conflict=q.LATIN_CONFLICT, stock=q.LATIN_PHRASES, explicit=q.LATIN_TIERS, surroundings=q.LATIN_ENV, persons=q.LATIN_PERSONS,
    hedging=["ou", "ea"], assertive=["tion"], adverb=lambda: F.col("text").rlike(q.ADVERB),
)
SIGNAL = r"\p{L}{9,}"


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    return rows.select(*[F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in rows.schema.fields])


def signals(blk: DataFrame) -> DataFrame:
    """Long words as stand-ins for noun signals."""
    return blk.select("doc_id", "seq", F.posexplode(F.regexp_extract_all("content", F.lit(SIGNAL), F.lit(0))).alias("nth", "text"))


def named(blk: DataFrame) -> DataFrame:
    """Mentions of two categories: longer names stand for places."""
    return corpus.mentions(blk).withColumn("category", F.when(F.length("text") >= 7, "LOCATION").otherwise("PERSON"))


def placed(blk: DataFrame) -> DataFrame:
    return corpus.mentions(blk).withColumn("category", F.lit("LOCATION"))


def _issues(rows: str, most: int | None) -> str:
    """SQL: findings in order. rows: doc_id, part, place, kind, section and value."""
    cut = f" WHERE rank <= {most}" if most else ""
    return f"SELECT doc_id, kind, section, round(CAST(value AS DOUBLE), 6) AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part, place, kind, section) AS rank FROM ({rows})){cut}"


def _vis(x: str) -> str:
    return rf"length(regexp_replace({x}, '\s', '', 'g'))"


def _half_up(x: str, digits: int) -> str:
    return f"floor(({x}) * CAST(1{'0' * digits} AS DOUBLE) + 0.5) / CAST(1{'0' * digits} AS DOUBLE)"


_SIGNALS = rf""", sig AS (SELECT doc_id, seq, unnest(regexp_extract_all(content, '{SIGNAL}')) AS text, unnest(range(len(regexp_extract_all(content, '{SIGNAL}')))) AS nth FROM blocks)"""
_NAMED = ", named AS (SELECT *, CASE WHEN length(text) >= 7 THEN 'LOCATION' ELSE 'PERSON' END AS category FROM ment)"


# --- entities, signals, presence


@query("entity_counts", f"{q._BLOCKS}{q._MENT}{_NAMED} SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, category) AS rank FROM (SELECT doc_id, category, count(*) AS n FROM named GROUP BY ALL)")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.entity_counts(named(doc_blocks(spark, sf_dir)))


@query("top_entities", f"{q._BLOCKS}{q._MENT}, c AS (SELECT doc_id, text AS term, count(*) AS n FROM ment GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 50")
def top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.top_texts(corpus.mentions(doc_blocks(spark, sf_dir)))


@query(
    "top_noun_signals",
    f"""{q._BLOCKS}{_SIGNALS}, c AS (SELECT doc_id, text AS term, count(*) AS n FROM sig GROUP BY ALL), t AS (SELECT doc_id, count(*) AS noun_signal_count FROM sig GROUP BY doc_id)
SELECT doc_id, term, n, rank, noun_signal_count FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM c) JOIN t USING (doc_id) WHERE rank <= 50""",
)
def top_noun_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals(doc_blocks(spark, sf_dir))
    return words.top_texts(found).join(words.signal_totals(found), "doc_id")


@query(
    "average_words",
    f"{q._BLOCKS} SELECT doc_id, count(*) AS block_count, sum(len(regexp_extract_all(content, '\\p{{L}}+'))) AS word_count, round(sum(len(regexp_extract_all(content, '\\p{{L}}+'))) / count(*), 6) AS avg_sentence_length FROM blocks GROUP BY doc_id",
)
def average_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    blk = doc_blocks(spark, sf_dir)
    return rounded(words.average_words(blk, corpus.terms(blk)))


_SUBJECTS = f"""{q._BLOCKS}{q._MENT}{_SIGNALS}{_NAMED}, sub AS (SELECT doc_id, seq, nth, text, category, 0 AS late FROM named UNION ALL SELECT doc_id, seq, nth, text, 'SIGNAL', 1 FROM sig),
sec AS (SELECT doc_id, section_path, row_number() OVER (PARTITION BY doc_id ORDER BY min(seq)) - 1 AS section, count(*) OVER (PARTITION BY doc_id) AS n_sections FROM blocks GROUP BY doc_id, section_path),
kinds AS (SELECT doc_id, text, first(category ORDER BY seq, late, nth) AS kind FROM sub GROUP BY ALL),
pres AS (SELECT sub.doc_id, sub.text AS subject, section, n_sections, count(*) AS n FROM sub JOIN blocks ON blocks.doc_id = sub.doc_id AND blocks.seq = sub.seq JOIN sec ON sec.doc_id = sub.doc_id AND sec.section_path = blocks.section_path GROUP BY ALL)"""


@query("plot_presence", f"{_SUBJECTS} SELECT pres.doc_id, subject, section, n_sections, n, kind FROM pres JOIN kinds ON kinds.doc_id = pres.doc_id AND kinds.text = subject")
def plot_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    blk = doc_blocks(spark, sf_dir)
    return plot.subjects(blk, named(blk), signals(blk))


_THREADS = f"""{_SUBJECTS}, g AS (SELECT *, coalesce(section - lag(section) OVER (PARTITION BY doc_id, subject ORDER BY section) - 1, 0) AS gap FROM pres),
t AS (SELECT doc_id, subject, sum(n) AS mentions, count(*) AS touched, min(section) AS f, max(section) AS l, max(gap) AS gap, max(n_sections) AS k FROM g GROUP BY ALL HAVING sum(n) >= 3),
late AS (SELECT doc_id, subject, mentions, row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, subject) AS rank FROM t WHERE k >= 3 AND f >= 0.8 * (k - 1)),
single AS (SELECT doc_id, subject, mentions, row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, subject) AS rank FROM t WHERE k >= 3 AND touched = 1)"""


@query("unresolved_threads", f"{_THREADS} SELECT doc_id, 'single_section' AS list, subject, mentions, rank FROM single WHERE rank <= 10 UNION ALL SELECT doc_id, 'late_arrival', subject, mentions, rank FROM late WHERE rank <= 10")
def unresolved_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    blk = doc_blocks(spark, sf_dir)
    presence = plot.subjects(blk, named(blk), signals(blk))
    lists = {"single_section": plot.single_section(presence), "late_arrival": plot.unresolved(presence, "late_arrival")}
    once, late = (rows.select("doc_id", F.lit(name).alias("list"), "subject", "mentions", "rank") for name, rows in lists.items())
    return once.unionByName(late)


# --- dialogue


_UNITS = rf"""{q._SEG}, u AS (SELECT doc_id, seq, seg, label, n_segments, visible, list_filter(regexp_extract_all(content, '[“「『"]([^”」』"\n]*)["”」』\n]?', 1), lambda x: {_vis("x")} > 0) AS q,
  CASE WHEN regexp_matches(content, '^\s*[—–]+') AND NOT regexp_matches(content, '[“「『"]') THEN list_filter([regexp_replace(content, '^\s*[—–]+', '')], lambda x: {_vis("x")} > 0) ELSE [] END AS d FROM seg),
unit AS (SELECT doc_id, seq, label, 'quote' AS kind, unnest(list_transform(q, lambda x: {_vis("x")})) AS chars, unnest(range(len(q))) AS nth FROM u UNION ALL SELECT doc_id, seq, label, 'dash', unnest(list_transform(d, lambda x: {_vis("x")})), unnest(range(len(d))) FROM u),
share AS (SELECT doc_id, seq, seg, label, n_segments, visible AS chars, least(visible, coalesce(list_sum(list_transform(list_concat(q, d), lambda x: {_vis("x")})), 0)) AS said FROM u),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS nth_block FROM share),
loud AS (SELECT doc_id, run, count(*) AS n, sum(chars) AS chars FROM (SELECT *, nth_block - row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM placed WHERE said / chars >= 0.5) GROUP BY ALL),
quiet AS (SELECT doc_id, run, count(*) AS n, sum(chars) AS chars FROM (SELECT *, nth_block - row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM placed WHERE said = 0) GROUP BY ALL),
ll AS (SELECT doc_id, max(n) AS longest_dialogue_run, max_by(chars, n * 10000000 + chars) AS longest_dialogue_chars FROM loud GROUP BY doc_id),
ql AS (SELECT doc_id, max(n) AS longest_quiet_run, max_by(chars, n * 10000000 + chars) AS longest_quiet_chars FROM quiet GROUP BY doc_id),
us AS (SELECT doc_id, count(*) AS unit_count, sum(CASE WHEN kind = 'quote' THEN 1 ELSE 0 END) AS quoted_units, sum(CASE WHEN kind = 'dash' THEN 1 ELSE 0 END) AS dash_units, avg(chars) AS avg_unit_chars, max(chars) AS longest_unit FROM unit GROUP BY doc_id),
ds AS (SELECT doc_id, sum(chars) AS char_count, sum(said) AS dialogue_chars, count(*) AS blocks, sum(CASE WHEN said > 0 THEN 1 ELSE 0 END) AS blocks_with_dialogue, max(n_segments) AS n_segments FROM share GROUP BY doc_id),
st AS (SELECT ds.*, coalesce(unit_count, 0) AS unit_count, coalesce(quoted_units, 0) AS quoted_units, coalesce(dash_units, 0) AS dash_units, coalesce(avg_unit_chars, 0) AS avg_unit_chars, coalesce(longest_unit, 0) AS longest_unit, coalesce(longest_dialogue_run, 0) AS longest_dialogue_run,
  coalesce(longest_dialogue_chars, 0) AS longest_dialogue_chars, coalesce(longest_quiet_run, 0) AS longest_quiet_run, coalesce(longest_quiet_chars, 0) AS longest_quiet_chars, dialogue_chars / char_count AS dialogue_share FROM ds LEFT JOIN us USING (doc_id) LEFT JOIN ll USING (doc_id) LEFT JOIN ql USING (doc_id)),
pt AS (SELECT doc_id, seg, label, sum(chars) AS chars, sum(said) / sum(chars) AS share FROM share GROUP BY ALL), ex AS (SELECT doc_id, max(share) - min(share) AS spread FROM pt WHERE chars >= 300 GROUP BY doc_id)"""


@query(
    "dialogue_stats",
    f"""{_UNITS} SELECT * EXCLUDE (n_segments, avg_unit_chars, dialogue_share), round(avg_unit_chars, 6) AS avg_unit_chars, round(dialogue_share, 6) AS dialogue_share,
  CASE WHEN unit_count = 0 THEN 'none' WHEN dialogue_share < 0.12 THEN 'sparse' WHEN dialogue_share > 0.55 THEN 'heavy' ELSE 'balanced' END AS verdict FROM st""",
)
def dialogue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dialogue.stats(doc_blocks(spark, sf_dir)))


@query(
    "dialogue_buckets",
    f"""{_UNITS}, b(bucket, low, high) AS (VALUES ('1-9', 1, 9), ('10-29', 10, 29), ('30-99', 30, 99), ('100-299', 100, 299), ('300+', 300, 2147483647))
SELECT us.doc_id, bucket, (SELECT count(*) FROM unit WHERE unit.doc_id = us.doc_id AND chars BETWEEN low AND high) AS n FROM us, b""",
)
def dialogue_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.unit_buckets(doc_blocks(spark, sf_dir))


@query(
    "dialogue_issues",
    _UNITS
    + " "
    + _issues(
        """SELECT doc_id, 1 AS part, 1 AS place, 'no_dialogue' AS kind, '' AS section, CAST(char_count AS DOUBLE) AS value FROM st WHERE unit_count = 0 AND char_count >= 200
UNION ALL SELECT doc_id, 1, 2, 'unquoted', '', dash_units FROM st WHERE quoted_units = 0 AND dash_units >= 10 UNION ALL SELECT doc_id, 1, 3, 'telegraphic', '', avg_unit_chars FROM st WHERE unit_count >= 20 AND avg_unit_chars < 8
UNION ALL SELECT doc_id, 1, 4, 'uneven', '', spread FROM st JOIN ex USING (doc_id) WHERE spread >= 0.6 AND n_segments >= 3 UNION ALL SELECT doc_id, 1, 5, 'silent_segment', '', longest_quiet_run FROM st WHERE longest_quiet_run >= 6
UNION ALL SELECT doc_id, 2, seg, CASE WHEN share < 0.05 THEN 'silent_segment' ELSE 'flooded_segment' END, label, share FROM pt WHERE chars >= 300 AND (share < 0.05 OR share > 0.8)
UNION ALL SELECT doc_id, 3, row_number() OVER (PARTITION BY doc_id ORDER BY seq, nth), 'monologue', label, chars FROM unit WHERE chars >= 300""",
        12,
    ),
)
def dialogue_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(findings.dialogue_issues(doc_segments(spark, sf_dir)))


# --- phrases and explicit language


_HITS = f"""{q._SEG}{q._hit_sql(q.LATIN_PHRASES)}, t AS (SELECT doc_id, pattern, category, count(*) AS n, min(seg) AS seg FROM hits GROUP BY ALL), lab AS (SELECT doc_id, seg, max(label) AS label, sum(visible) AS chars FROM seg GROUP BY ALL),
h AS (SELECT doc_id, seg, count(*) AS hits FROM hits GROUP BY ALL), tot AS (SELECT doc_id, sum(n) AS n, max(n) AS most, sum(CASE WHEN category = 'opening' THEN n ELSE 0 END) AS speech FROM t GROUP BY doc_id HAVING sum(n) >= 8)"""


@query(
    "cliche_issues",
    _HITS
    + " "
    + _issues(
        """SELECT doc_id, 1 AS part, rank AS place, 'repeated' AS kind, label AS section, CAST(n AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pattern) AS rank FROM t WHERE n >= 3) JOIN lab USING (doc_id, seg) WHERE rank <= 6
UNION ALL SELECT doc_id, 2, seg, 'dense_segment', label, hits * 10000 / chars FROM h JOIN lab USING (doc_id, seg) WHERE hits * 10000 / chars >= 30
UNION ALL SELECT doc_id, 3, 0, 'one_note', '', most / n FROM tot WHERE most / n >= 0.25 UNION ALL SELECT doc_id, 4, 0, 'speech_tags', '', speech / n FROM tot WHERE speech / n >= 0.25""",
        12,
    ),
)
def cliche_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = doc_segments(spark, sf_dir)
    return rounded(findings.cliche_issues(seg, phrases.phrase_hits(seg, q.LATIN_PHRASES), "opening"))


_TIERS = f"""{q._SEG}, found AS (SELECT doc_id, seg, label, unnest(regexp_extract_all(content, 'idiot|moron|worthless|clown')) AS matched FROM seg),
hate AS (SELECT doc_id, label, count(*) AS n FROM found WHERE matched = 'moron' GROUP BY ALL), fam AS (SELECT doc_id, sum(n) AS hits, first(label ORDER BY n DESC, label) AS section FROM hate GROUP BY doc_id),
chars AS (SELECT doc_id, seg, sum(visible) AS chars FROM seg GROUP BY ALL), dense AS (SELECT doc_id, seg, label, count(*) * 10000 / max(chars) AS r FROM found JOIN chars USING (doc_id, seg) GROUP BY ALL)"""


@query("explicit_advisories", f"{_TIERS} SELECT doc_id, 2 AS ord, 'hate_slur' AS kind, hits, section FROM fam")
def explicit_advisories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.advisories(phrases.explicit_hits(doc_segments(spark, sf_dir), q.LATIN_TIERS))


@query("explicit_issues", f"{_TIERS} " + _issues("SELECT doc_id, 1 AS part, 2 AS place, 'hate_slur' AS kind, section, CAST(hits AS DOUBLE) AS value FROM fam UNION ALL SELECT doc_id, 2, seg, 'dense_segment', label, r FROM dense WHERE r >= 20", 12))
def explicit_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = doc_segments(spark, sf_dir)
    return rounded(findings.explicit_issues(seg, phrases.explicit_hits(seg, q.LATIN_TIERS)))


# --- voice


_VOICE = rf"""{q._BLOCKS}, b AS (SELECT doc_id, visible, {q._LENS} AS l, coalesce(list_sum(list_transform({q._SENT}, lambda x: length(regexp_replace(x, '[^，、；：,]', '', 'g')) + 1)), 0) AS c, list_transform(regexp_extract_all(content, '[\p{{L}}\p{{Nd}}\p{{Mn}}_]+'), lambda x: lower(x)) AS w,
  length(regexp_replace(content, '[^?]', '', 'g')) AS ask, length(regexp_replace(content, '[^!]', '', 'g')) AS cry, length(regexp_replace(content, '[^xyz]', '', 'g')) AS xyz,
  (length(content) - length(replace(content, 'ou', ''))) // 2 + (length(content) - length(replace(content, 'ea', ''))) // 2 AS hedging, (length(content) - length(replace(content, 'tion', ''))) // 4 AS assertive FROM blocks),
s AS (SELECT doc_id, sum(visible) AS chars, count(*) AS pars, sum(len(l)) AS n, sum(coalesce(list_sum(l), 0)) AS total, sum(coalesce(list_sum(list_transform(l, lambda x: x * x)), 0)) AS squares, sum(c) AS clauses, sum(CASE WHEN len(l) = 1 THEN 1 ELSE 0 END) AS single,
  sum(len(list_filter(w, lambda x: x IN ('is', 'as')))) AS first_, sum(len(list_filter(w, lambda x: x IN ('is', 'as', 'of', 'on', 'the', 'that')))) AS pron, sum(ask) AS ask, sum(cry) AS cry, sum(xyz) AS xyz, CAST(sum(hedging) AS DOUBLE) AS hedging, CAST(sum(assertive) AS DOUBLE) AS assertive FROM b GROUP BY doc_id),
m AS (SELECT *, coalesce({_half_up("total / nullif(n, 0)", 1)}, 0) AS mean FROM s),
v AS (SELECT *, {_half_up("sqrt(greatest(coalesce((squares - 2 * mean * total + mean * mean * n) / nullif(n, 0), 0), 0))", 1)} AS stdev, coalesce({_half_up("clauses / nullif(n, 0)", 2)}, 0) AS cps, {_half_up("chars / pars", 1)} AS par, {_half_up("single / pars", 2)} AS snip,
  coalesce({_half_up("first_ / nullif(pron, 0)", 3)}, 0) AS fshare, {_half_up("hedging * 10000 / chars", 2)} AS h, {_half_up("assertive * 10000 / chars", 2)} AS a, {_half_up("ask * 1000 / chars", 2)} + {_half_up("cry * 1000 / chars", 2)} AS raised, {_half_up("xyz * 1000 / chars", 2)} AS xr FROM m),
r AS (SELECT *, coalesce({_half_up("stdev / nullif(mean, 0)", 2)}, 0) AS cv FROM v)"""


def _voice_rules() -> str:
    rules = [
        ("too_short", "chars < 600", "chars"), ("long_sentences", "n >= 20 AND mean >= 45", "mean"), ("short_sentences", "n >= 20 AND mean <= 14", "mean"), ("varied_rhythm", "n >= 20 AND cv >= 0.55", "cv"),
        ("even_rhythm", "n >= 20 AND cv <= 0.3", "cv"), ("comma_run", "cps >= 3.5", "cps"), ("short_paragraphs", "pars >= 5 AND par <= 90", "par"), ("snippet_paragraphs", "pars >= 5 AND snip >= 0.4", "snip"), ("no_pronouns", "pron < 10", "pron"),
        ("first_person", "pron >= 10 AND fshare >= 0.6", "fshare"), ("hedging", "h >= 6 AND h > a * 1.5", "h"), ("assertive", "NOT (h >= 6 AND h > a * 1.5) AND a >= 6 AND a > h * 1.5", "a"), ("classical", "xr >= 3", "xr"), ("flat_marks", "raised < 0.4", "raised"),
    ]
    return " UNION ALL ".join(f"SELECT doc_id, {i} AS part, 0 AS place, '{k}' AS kind, '' AS section, CAST({value} AS DOUBLE) AS value FROM r WHERE {'' if i == 0 else 'chars >= 600 AND '}{holds}" for i, (k, holds, value) in enumerate(rules))


@query("voice_findings", f"{_VOICE} {_issues(_voice_rules(), 10)}")
def voice_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(findings.voice_findings(doc_blocks(spark, sf_dir), STOPS, ("?", "!"), "xyz", LATIN.persons, LATIN.hedging, LATIN.assertive))


# --- scenes and places


_SCENES = f"""{q._SEG}{q._MENT}, nm AS (SELECT doc_id, seq, text, count(*) AS n, min(nth) AS f FROM ment GROUP BY ALL), an AS (SELECT doc_id, seq, first(text ORDER BY n DESC, f) AS anchor FROM nm GROUP BY doc_id, seq),
fa AS (SELECT s.doc_id, s.seq, s.seg, s.label, s.n_segments, block_type, visible, {q._QUOTED} AS quoted, coalesce(anchor, '') AS anchor, (length(content) - length(replace(content, 'ea', ''))) // 2 + (length(content) - length(replace(content, 'hand', ''))) // 4 + (length(content) - length(replace(content, 'the', ''))) // 3 AS env FROM seg s LEFT JOIN an ON an.doc_id = s.doc_id AND an.seq = s.seq),
sb AS (SELECT *, sum(CASE WHEN block_type = 'title' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS grp, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rn FROM fa),
sc AS (SELECT *, last_value(nullif(anchor, '') IGNORE NULLS) OVER (PARTITION BY doc_id, grp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM sb),
sn AS (SELECT *, sum(CASE WHEN rn = 1 OR block_type = 'title' OR (anchor <> '' AND before_ IS NOT NULL AND anchor <> before_) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS scene FROM sc),
sm AS (SELECT doc_id, scene, min(seq) AS first_seq, arg_min(label, seq) AS section, coalesce(arg_min(anchor, CASE WHEN anchor <> '' THEN seq END), '') AS anchor, count(*) AS blocks, sum(visible) AS char_count, sum(env) AS env_hits, sum(quoted) AS quoted FROM sn GROUP BY doc_id, scene),
scenes AS (SELECT *, env_hits * 1000 / char_count AS env_density, quoted / char_count AS dialogue_share, anchor = '' AND env_hits * 1000 / char_count < 3 AS unanchored FROM sm),
vis AS (SELECT nm.doc_id, text AS place, seg, count(*) AS n, max(n_segments) AS k FROM nm JOIN seg ON seg.doc_id = nm.doc_id AND seg.seq = nm.seq GROUP BY ALL),
vg AS (SELECT *, coalesce(seg - lag(seg) OVER (PARTITION BY doc_id, place ORDER BY seg) - 1, 0) AS gap FROM vis),
pl AS (SELECT doc_id, place, sum(n) AS mentions, min(seg) AS seg, max(gap) AS longest, sum(CASE WHEN gap >= 3 THEN 1 ELSE 0 END) AS returns FROM vg GROUP BY ALL HAVING sum(n) >= 2),
places AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, place) AS rank FROM pl) WHERE rank <= 12),
lab AS (SELECT doc_id, seg, max(label) AS label FROM seg GROUP BY ALL), crowd AS (SELECT doc_id, seg, count(*) AS n FROM vis GROUP BY ALL HAVING count(*) >= 4),
env AS (SELECT doc_id, sum(env) AS total_env_hits, sum(visible) AS char_count, sum(env) * 1000 / sum(visible) AS env_density, bool_or(anchor <> '') AS places_measured FROM fa GROUP BY doc_id)"""


@query("setting_scenes", f"{_SCENES} SELECT * EXCLUDE (env_density, dialogue_share), round(env_density, 6) AS env_density, round(dialogue_share, 6) AS dialogue_share FROM scenes")
def setting_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = doc_segments(spark, sf_dir)
    return rounded(setting.scenes(setting.facts(seg, placed(seg), q.LATIN_ENV)))


@query(
    "setting_stats",
    f"""{_SCENES}, x AS (SELECT doc_id, count(*) AS scene_count, sum(CASE WHEN unanchored THEN 1 ELSE 0 END) AS unanchored_scenes FROM scenes GROUP BY doc_id), y AS (SELECT doc_id, count(*) AS place_count, sum(CASE WHEN mentions >= 3 THEN 1 ELSE 0 END) AS recurring_places FROM places GROUP BY doc_id), z AS (SELECT doc_id, count(*) AS crowded FROM crowd GROUP BY doc_id),
w AS (SELECT env.*, scene_count, unanchored_scenes, coalesce(crowded, 0) AS crowded, coalesce(place_count, 0) AS place_count, coalesce(recurring_places, 0) AS recurring_places, unanchored_scenes / scene_count AS unanchored_share FROM env JOIN x USING (doc_id) LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id))
SELECT * EXCLUDE (env_density, unanchored_share), round(env_density, 6) AS env_density, round(unanchored_share, 6) AS unanchored_share, CASE WHEN total_env_hits = 0 THEN 'none' WHEN env_density < 2 THEN 'thin' WHEN env_density > 10 THEN 'heavy' ELSE 'present' END AS verdict,
  CASE WHEN place_count > 0 OR total_env_hits > 0 THEN round(greatest(0, least(100, 100 - (CASE WHEN unanchored_share > 0.3 THEN least((unanchored_share - 0.3) * 60, 25) ELSE 0 END + CASE WHEN env_density < 2 THEN (2 - env_density) / 2 * 20 ELSE 0 END + CASE WHEN recurring_places > 0 OR env_density >= 10 THEN 0 ELSE 20 END + least(crowded * 5, 15)))), 6) END AS setting_score FROM w""",
)
def setting_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = doc_segments(spark, sf_dir)
    return rounded(setting.stats(setting.facts(seg, placed(seg), q.LATIN_ENV), setting.places(seg, placed(seg))))


@query(
    "setting_issues",
    _SCENES
    + " "
    + _issues(
        """SELECT doc_id, 1 AS part, scene AS place, 'unanchored' AS kind, section, env_density AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY scene) AS k FROM scenes WHERE unanchored) WHERE k <= 12
UNION ALL SELECT doc_id, 2, seg, 'crowded', label, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg) AS k FROM crowd) JOIN lab USING (doc_id, seg) WHERE k <= 12
UNION ALL SELECT doc_id, 3, rank, 'long_absence', label, longest FROM places JOIN lab USING (doc_id, seg) WHERE returns > 0 UNION ALL SELECT doc_id, 4, 0, 'thin_environment', '', env_density FROM env WHERE env_density < 2""",
        None,
    ),
)
def setting_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = doc_segments(spark, sf_dir)
    return rounded(findings.setting_issues(seg, placed(seg), q.LATIN_ENV))


# --- structure, curves and scores


_MARKS = f"""{q._SEG}{q._POINTS}, ps AS (SELECT *, coalesce((coalesce(sum(char_count) OVER (PARTITION BY doc_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + char_count / 2) / nullif(sum(char_count) OVER (PARTITION BY doc_id), 0), 0) AS position,
  lag(tension) OVER o AS was, lead(tension) OVER o AS nxt, avg(tension) OVER d AS mean, stddev_pop(tension) OVER d AS spread, row_number() OVER (PARTITION BY doc_id ORDER BY tension DESC, seg) AS nth FROM points WINDOW o AS (PARTITION BY doc_id ORDER BY seg), d AS (PARTITION BY doc_id)),
lm AS (SELECT doc_id, 'opening' AS kind, seg, position, tension AS strength FROM ps WHERE seg = 0 UNION ALL SELECT doc_id, 'climax', seg, position, tension FROM ps WHERE nth = 1 AND spread >= 5
  UNION ALL SELECT doc_id, 'peak', seg, position, tension - mean FROM ps WHERE (nth <> 1 OR spread < 5) AND (was IS NULL OR tension > was) AND (nxt IS NULL OR tension > nxt) AND tension >= mean + 8
  UNION ALL SELECT doc_id, 'trough', seg, position, mean - tension FROM ps WHERE (nth <> 1 OR spread < 5) AND (was IS NULL OR tension < was) AND (nxt IS NULL OR tension < nxt) AND tension <= mean - 8),
marks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg, kind) AS rank FROM lm) WHERE rank <= 24)"""


@query("landmarks", f"{_MARKS} SELECT doc_id, kind, seg, round(position, 6) AS position, round(strength, 6) AS strength, rank FROM marks")
def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structure.landmarks(pacing.curve(doc_segments(spark, sf_dir), terminators=STOPS)))


_BEATS = f"""{_MARKS}, beats(model, beat, ord, low, high, want, pref) AS (VALUES {", ".join(f"('{m}', '{b}', {i}, {lo}, {hi}, '{kind}', {k})" for i, (m, b, lo, hi, kinds) in enumerate(structure.BEATS) for k, kind in enumerate(kinds))}),
answers AS (SELECT *, kind AS want FROM marks UNION ALL SELECT *, 'peak' FROM marks WHERE kind = 'climax'),
met AS (SELECT doc_id, ord, kind, seg, position, strength, pref, greatest(low - position, position - high, 0) AS away FROM answers JOIN beats USING (want) WHERE greatest(low - position, position - high, 0) <= 0.12),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY CASE WHEN away > 0 THEN 1 ELSE 0 END, CASE WHEN away > 0 THEN away ELSE pref END, strength DESC, position, pref) AS k FROM met) WHERE k = 1),
fit AS (SELECT d.doc_id, b.model, b.beat, b.ord, CASE WHEN kind IS NULL THEN 'missing' WHEN away > 0 THEN 'displaced' ELSE 'found' END AS status, kind, seg, position FROM (SELECT DISTINCT doc_id FROM marks) d CROSS JOIN (SELECT DISTINCT model, beat, ord FROM beats) b LEFT JOIN best ON best.doc_id = d.doc_id AND best.ord = b.ord)"""


@query("beat_match", f"{_BEATS} SELECT doc_id, ord, model, beat, status, kind, seg, round(position, 6) AS position FROM fit")
def beat_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structure.beats(structure.landmarks(pacing.curve(doc_segments(spark, sf_dir), terminators=STOPS))))


@query(
    "model_fit",
    f"""{_BEATS}, n AS (SELECT doc_id, model, sum(CASE WHEN status = 'found' THEN 1 ELSE 0 END) AS found, sum(CASE WHEN status = 'displaced' THEN 1 ELSE 0 END) AS displaced, sum(CASE WHEN status = 'missing' THEN 1 ELSE 0 END) AS missing, count(*) AS k FROM fit GROUP BY ALL)
SELECT doc_id, model, found, displaced, missing, CASE WHEN found / k >= 0.75 THEN 'matched' WHEN found / k >= 0.5 THEN 'partial' ELSE 'unclear' END AS fit FROM n""",
)
def model_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.model_fit(structure.beats(structure.landmarks(pacing.curve(doc_segments(spark, sf_dir), terminators=STOPS))))


_GAPS = f"""{_MARKS}, lab AS (SELECT doc_id, seg, max(label) AS label FROM seg GROUP BY ALL), ends AS (SELECT doc_id, count(*) AS n, sum(char_count) AS chars, max(tension) AS highest, max_by(tension, seg) AS last, max(seg) AS last_seg FROM points GROUP BY doc_id HAVING sum(char_count) >= 1500),
seen AS (SELECT doc_id, count(*) AS k, bool_or(kind IN ('turn', 'peak', 'climax') AND position <= 0.25) AS early, bool_or(position BETWEEN 0.4 AND 0.62) AS middle, max(CASE WHEN kind = 'climax' THEN position END) AS climax, max(CASE WHEN kind = 'climax' THEN seg END) AS climax_seg FROM marks GROUP BY doc_id),
g AS (SELECT * FROM ends JOIN seen USING (doc_id))"""


@query(
    "structure_issues",
    _GAPS
    + " "
    + _issues(
        """SELECT doc_id, 1 AS part, 0 AS place, 'no_early_turn' AS kind, '' AS section, CAST(0.25 AS DOUBLE) AS value FROM g WHERE NOT early UNION ALL SELECT doc_id, 2, 0, 'missing_midpoint', '', 0.5 FROM g WHERE NOT middle
UNION ALL SELECT g.doc_id, 3, 0, 'climax_early', coalesce(label, CAST(climax_seg + 1 AS VARCHAR) || '/10'), climax FROM g LEFT JOIN lab ON lab.doc_id = g.doc_id AND lab.seg = climax_seg WHERE climax < 0.6
UNION ALL SELECT g.doc_id, 4, 0, 'no_descent', coalesce(label, CAST(last_seg + 1 AS VARCHAR) || '/10'), last FROM g LEFT JOIN lab ON lab.doc_id = g.doc_id AND lab.seg = last_seg WHERE n >= 3 AND last >= highest - 8
UNION ALL SELECT doc_id, 6, 0, 'too_few_landmarks', '', k FROM g WHERE k < 4""",
        8,
    ),
)
def structure_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pacing.curve(doc_segments(spark, sf_dir), terminators=STOPS)
    return rounded(findings.structure_issues(points, structure.landmarks(points)))


_FLAT = f"""{q._SEG.replace("WITH ", "WITH RECURSIVE ", 1)}{q._POINTS}, walk AS (SELECT doc_id, seg, tension AS low, tension AS high, seg AS from_seg, CAST(NULL AS BIGINT) AS ended_from, CAST(NULL AS BIGINT) AS ended_to FROM points WHERE seg = 0
UNION ALL SELECT p.doc_id, p.seg, CASE WHEN brk THEN p.tension ELSE least(low, p.tension) END, CASE WHEN brk THEN p.tension ELSE greatest(high, p.tension) END, CASE WHEN brk THEN p.seg ELSE from_seg END, CASE WHEN brk THEN from_seg END, CASE WHEN brk THEN p.seg END
  FROM (SELECT w.*, pp.tension AS t2, greatest(high, pp.tension) - least(low, pp.tension) > 8 AS brk FROM walk w JOIN points pp ON pp.doc_id = w.doc_id AND pp.seg = w.seg + 1) x JOIN points p ON p.doc_id = x.doc_id AND p.seg = x.seg + 1),
ends AS (SELECT doc_id, ended_from AS f, ended_to AS l FROM walk WHERE ended_to IS NOT NULL UNION ALL SELECT doc_id, from_seg, seg FROM (SELECT *, max(seg) OVER (PARTITION BY doc_id) AS z FROM walk) WHERE seg = z),
flat AS (SELECT doc_id, f, l, l - f + 1 AS n FROM ends WHERE l - f + 1 >= 4)"""


@query("flat_stretches", f"{_FLAT}, lab AS (SELECT doc_id, seg, max(label) AS label FROM seg GROUP BY ALL) SELECT flat.doc_id, coalesce(a.label, CAST(f + 1 AS VARCHAR) || '/10') AS from_section, coalesce(b.label, CAST(l + 1 AS VARCHAR) || '/10') AS to_section, n AS sections, round((SELECT sum(tension) FROM points p WHERE p.doc_id = flat.doc_id AND p.seg BETWEEN f AND l) / n, 6) AS mean_tension, (SELECT sum(char_count) FROM points p WHERE p.doc_id = flat.doc_id AND p.seg BETWEEN f AND l) AS char_count FROM flat LEFT JOIN lab a ON a.doc_id = flat.doc_id AND a.seg = f LEFT JOIN lab b ON b.doc_id = flat.doc_id AND b.seg = l")
def flat_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pacing.flat_stretches(pacing.curve(doc_segments(spark, sf_dir), terminators=STOPS)))


@query(
    "pacing_stats",
    f"""{_FLAT}, d AS (SELECT doc_id, count(*) AS segment_count, bool_or(chunked) AS chunked, stddev_pop(tension) AS tension_stdev, CASE WHEN sum(n) >= 2 THEN sqrt(greatest(sum(squares) * sum(n) - sum(total) * sum(total), 0)) / sum(n) ELSE 0 END AS sentence_stdev, min(tension) AS min_tension, max(tension) AS max_tension, avg(char_count) AS mean_section_chars, avg(tension) AS mean_tension FROM points GROUP BY doc_id),
slow AS (SELECT p.doc_id, least(count(*), 10) AS k FROM points p JOIN d USING (doc_id) WHERE char_count / mean_section_chars >= 1.8 AND tension < mean_tension - 1e-9 GROUP BY p.doc_id), lf AS (SELECT doc_id, max(n) AS k FROM flat GROUP BY doc_id),
e AS (SELECT d.* EXCLUDE (mean_tension), coalesce(lf.k, 0) AS longest_flat_run, coalesce(slow.k, 0) AS drag_count FROM d LEFT JOIN lf USING (doc_id) LEFT JOIN slow USING (doc_id))
SELECT doc_id, segment_count, chunked, round(tension_stdev, 6) AS tension_stdev, round(sentence_stdev, 6) AS sentence_stdev, round(min_tension, 6) AS min_tension, round(max_tension, 6) AS max_tension, round(mean_section_chars, 6) AS mean_section_chars, longest_flat_run, drag_count,
  CASE WHEN tension_stdev < 5 THEN 'flat' WHEN tension_stdev > 22 THEN 'spiky' ELSE 'varied' END AS verdict, CASE WHEN chunked THEN 100 ELSE round(greatest(0, least(100, 100 - (CASE WHEN tension_stdev < 5 THEN (5 - tension_stdev) / 5 * 30 ELSE 0 END + CASE WHEN longest_flat_run >= 4 THEN least((longest_flat_run - 3) * 6, 24) ELSE 0 END + least(drag_count * 8, 24) + CASE WHEN sentence_stdev < 6 THEN (6 - sentence_stdev) / 6 * 18 ELSE 0 END))), 6) END AS pace_score FROM e""",
)
def pacing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pacing.stats(pacing.curve(doc_segments(spark, sf_dir), terminators=STOPS)))


@query(
    "phrase_stats",
    f"""{_HITS.replace("tot AS (", "tot_ AS (")}, c AS (SELECT doc_id, sum(visible) AS char_count FROM seg GROUP BY doc_id), x AS (SELECT doc_id, sum(n) AS total_hits, count(*) AS distinct_phrases, max(n) AS most, sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS repeated_phrases, sum(CASE WHEN n >= 3 THEN n ELSE 0 END) AS repeat_hits FROM (SELECT doc_id, pattern, sum(n) AS n FROM t GROUP BY ALL) GROUP BY doc_id),
y AS (SELECT c.*, coalesce(total_hits, 0) AS total_hits, coalesce(distinct_phrases, 0) AS distinct_phrases, coalesce(repeated_phrases, 0) AS repeated_phrases, coalesce(repeat_hits, 0) AS repeat_hits, coalesce(total_hits, 0) * 10000 / char_count AS per_10k, coalesce(most / nullif(total_hits, 0), 0) AS top_share FROM c LEFT JOIN x USING (doc_id))
SELECT * EXCLUDE (per_10k, top_share), round(per_10k, 6) AS per_10k, round(top_share, 6) AS top_share, CASE WHEN total_hits = 0 THEN 'none' WHEN per_10k < 10 THEN 'light' WHEN per_10k > 25 THEN 'heavy' ELSE 'moderate' END AS verdict,
  CASE WHEN char_count >= 1000 THEN round(greatest(0, 100 - (CASE WHEN per_10k > 4 THEN least((per_10k - 4) * 2.5, 45) ELSE 0 END + least(repeat_hits, 20) + CASE WHEN total_hits >= 8 AND top_share >= 0.25 THEN 10 ELSE 0 END)), 6) END AS cliche_score FROM y""",
)
def phrase_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = doc_segments(spark, sf_dir)
    return rounded(phrases.phrase_stats(seg, phrases.phrase_hits(seg, q.LATIN_PHRASES))).drop("dialogue_hits")


@query(
    "conflict_stats",
    f"""{q._CONFLICT}, lab AS (SELECT doc_id, seg, max(label) AS label FROM seg GROUP BY ALL), ax AS (SELECT doc_id, max(n_segments) AS n FROM axis GROUP BY doc_id),
pi AS (SELECT p.doc_id, p.seg, p.char_count, p.hits, n, coalesce(label, CAST(p.seg + 1 AS VARCHAR) || '/10') AS label, least(coalesce(hits * 1000 / nullif(char_count, 0), 0) / {conflict.FULL}, 1) * 100 AS intensity FROM points p JOIN ax USING (doc_id) LEFT JOIN lab ON lab.doc_id = p.doc_id AND lab.seg = p.seg),
ru AS (SELECT doc_id, run, count(*) AS n FROM (SELECT *, seg - row_number() OVER (PARTITION BY doc_id ORDER BY seg) AS run FROM points WHERE hits = 0) GROUP BY ALL), ab AS (SELECT doc_id, max(n) AS longest_absent_run FROM ru GROUP BY doc_id),
fm AS (SELECT doc_id, kind, sum(hits) AS hits FROM th GROUP BY ALL), mx AS (SELECT doc_id, max(hits) / sum(hits) AS dominant_share, first(kind ORDER BY hits DESC, kind) AS dominant_type FROM fm GROUP BY doc_id),
d AS (SELECT doc_id, max(n) AS segment_count, sum(hits) AS total_hits, sum(char_count) AS char_count, max(intensity) AS peak_intensity, first(label ORDER BY intensity DESC, seg) AS peak_section, first(seg ORDER BY intensity DESC, seg) AS peak_seg, avg(intensity) FILTER (seg >= n - ceil(n / 3)) AS tail_intensity, max(hits) AS most FROM pi GROUP BY doc_id),
e AS (SELECT d.*, coalesce(dominant_share, 0) AS dominant_share, dominant_type, coalesce(longest_absent_run, 0) AS longest_absent_run, total_hits * 1000 / char_count AS density, coalesce(most / nullif(total_hits, 0), 0) AS concentration, CASE WHEN segment_count > 1 THEN peak_seg / (segment_count - 1) ELSE 0 END AS peak_position FROM d LEFT JOIN mx USING (doc_id) LEFT JOIN ab USING (doc_id))
SELECT doc_id, segment_count, total_hits, char_count, round(peak_intensity, 6) AS peak_intensity, peak_section, round(tail_intensity, 6) AS tail_intensity, round(dominant_share, 6) AS dominant_share, dominant_type, longest_absent_run, round(density, 6) AS density, round(concentration, 6) AS concentration, round(peak_position, 6) AS peak_position,
  CASE WHEN density <= 0 THEN 'none' WHEN density < {conflict.THIN} THEN 'thin' WHEN density > {conflict.HEAVY} THEN 'heavy' ELSE 'present' END AS verdict,
  CASE WHEN total_hits > 0 THEN round(greatest(0, least(100, 100 - (CASE WHEN density < {conflict.THIN} THEN ({conflict.THIN} - density) / {conflict.THIN} * 30 ELSE 0 END + CASE WHEN total_hits >= {conflict.MIN_MIX} THEN greatest(0, least(15, (dominant_share - 0.8) / 0.2 * 15)) ELSE 0 END + CASE WHEN longest_absent_run >= {conflict.ABSENT_MIN} THEN least((longest_absent_run - {conflict.ABSENT_MIN} + 1) * 5, 20) ELSE 0 END
    + CASE WHEN segment_count >= {conflict.MIN_SHAPE} AND peak_position < 1 / 3 AND tail_intensity < peak_intensity * 0.5 THEN 20 ELSE 0 END + CASE WHEN segment_count >= {conflict.MIN_SHAPE} AND concentration > 0.5 THEN least((concentration - 0.5) * 60, 15) ELSE 0 END))), 6) END AS conflict_score FROM e""",
)
def conflict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(conflict.stats(doc_segments(spark, sf_dir), q.LATIN_CONFLICT))


ORACLE["character_graph"] = f"""WITH c AS ({ORACLE["characters"]}), p AS ({ORACLE["character_partners"]}), top AS (SELECT doc_id, name FROM c WHERE rank <= 12)
SELECT p.doc_id, least(p.name, partner) AS a, greatest(p.name, partner) AS b, max(n) AS weight FROM p JOIN top x ON x.doc_id = p.doc_id AND x.name = p.name JOIN top y ON y.doc_id = p.doc_id AND y.name = partner GROUP BY ALL"""


_ARC = rf"""{q._SEG}{q._MENT}, ec AS (SELECT doc_id, seq, count(*) AS entities FROM ment GROUP BY ALL),
b AS (SELECT seg.doc_id, seg, visible, {q._QUOTED} AS quoted, length(regexp_replace(content, '[^!！?？]', '', 'g')) AS marks, {q._LENS.replace("[.!?;]", "[。！？；…!?;]")} AS l, coalesce(entities, 0) AS entities FROM seg LEFT JOIN ec ON ec.doc_id = seg.doc_id AND ec.seq = seg.seq),
s AS (SELECT doc_id, seg, sum(visible) AS chars, sum(quoted) AS quoted, sum(marks) AS marks, sum(len(l)) AS n, sum(len(list_filter(l, lambda x: x <= {sections.SHORT_SENTENCE}))) AS short, sum(entities) AS entities FROM b GROUP BY ALL),
f AS (SELECT a.doc_id, a.seg, coalesce(chars, 0) AS char_count, coalesce(quoted / nullif(chars, 0), 0) AS s_dialogue, coalesce(marks * 1000 / nullif(chars, 0), 0) AS s_exclaim, coalesce(short / nullif(n, 0), 0) AS s_short, coalesce(entities * 1000 / nullif(chars, 0), 0) AS s_entities FROM axis a LEFT JOIN s ON s.doc_id = a.doc_id AND s.seg = a.seg),
arc AS (SELECT doc_id, seg, char_count, {" + ".join(f"{w} * coalesce((s_{k} - min(s_{k}) OVER d) / nullif(max(s_{k}) OVER d - min(s_{k}) OVER d, 0), 0)" for k, w in sections.ARC_WEIGHTS.items())} AS intensity, count(*) OVER d AS n FROM f WINDOW d AS (PARTITION BY doc_id)),
th AS (SELECT *, greatest(n // 3, 1) AS t FROM arc), m AS (SELECT doc_id, max(n) AS n, coalesce(avg(intensity) FILTER (seg < t), 0) AS front, coalesce(avg(intensity) FILTER (seg >= t AND seg < n - t), 0) AS middle, coalesce(avg(intensity) FILTER (seg >= n - t), 0) AS back FROM th GROUP BY doc_id)"""


@query(
    "narrative_arc",
    f"""{_ARC} SELECT doc_id, seg, char_count, round(intensity, 6) AS intensity, CASE WHEN m.n < 3 THEN 'steady' WHEN middle > front + 0.05 AND middle > back + 0.05 THEN 'mountain' WHEN back > front + 0.05 AND back >= middle - 0.05 THEN 'rising' WHEN front > back + 0.05 AND front >= middle - 0.05 THEN 'falling' ELSE 'steady' END AS shape FROM arc JOIN m USING (doc_id)""",
)
def narrative_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = doc_segments(spark, sf_dir)
    points = sections.arc(seg, corpus.mentions(seg))
    return rounded(points.join(sections.arc_shape(points), "doc_id")).select("doc_id", "seg", "char_count", "intensity", "shape")


# --- time: the orders of a customer told as a text


def order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per customer, one block per order: its date in words and sixty more characters; three blocks make a section."""
    o = q.table(spark, sf_dir, "orders")
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = o.select(F.col("o_custkey").alias("doc_id"), seq.alias("seq"), F.concat(F.date_format("o_orderdate", "yyyy年M月d日"), F.lit("，"), F.lit("记" * 59)).alias("content"))
    part = F.concat(F.lit("part "), F.lpad(F.floor(F.col("seq") / 3).cast("string"), 3, "0"))
    return segments.with_segments(rows.select(F.lit("p").alias("project_id"), "doc_id", "seq", "content", part.alias("section_path"), F.lit("paragraph").alias("block_type"), F.lit(None).cast("string").alias("title")))


_TOLD = """WITH o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, CAST(o_orderdate AS DATE) AS d FROM orders),
t AS (SELECT *, year(d) || '年' || month(d) || '月' || day(d) || '日' AS text, 'part ' || lpad(CAST(seq // 3 AS VARCHAR), 3, '0') AS section FROM o), c AS (SELECT doc_id, sum(length(text) + 60) AS chars, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT t.*, lag(d) OVER w AS was, date_diff('day', lag(d) OVER w, d) AS days FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY seq)), j AS (SELECT s.* FROM s JOIN c USING (doc_id) WHERE chars >= 600)"""


@query("told_dates", f"{_TOLD} SELECT doc_id, seq, text, 'absolute' AS kind, 'day' AS precision, CAST(d AS VARCHAR) AS date, seq AS marker FROM t")
def told_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timeline.anchored(timeline.markers(order_texts(spark, sf_dir)))
    return found.select("doc_id", "seq", "text", "kind", "precision", F.col("date").cast("string").alias("date"), "marker")


@query(
    "timeline_issues",
    _TOLD
    + " "
    + _issues(
        """SELECT doc_id, 1 AS part, k AS place, 'backstep' AS kind, section, CAST(days AS DOUBLE) AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM j WHERE days < 0) WHERE k <= 10
UNION ALL SELECT doc_id, 2, k, 'long_jump', section, days FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY days DESC, was, d, seq) AS k FROM j WHERE days >= 366) WHERE k <= 10
UNION ALL SELECT doc_id, 4, 0, 'too_short', '', chars FROM c WHERE chars < 600""",
        None,
    ),
)
def timeline_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = order_texts(spark, sf_dir)
    # Written once: each of the lists reads the expressions, and would search the texts again.
    return rounded(findings.timeline_issues(seg, bundle.checkpointed(timeline.anchored(timeline.markers(seg)))))


# --- the whole review


@query("review_checklist")
def review_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nineteen rules over the documents, with mentions, signals and repeated phrases of their own texts."""
    seg = doc_segments(spark, sf_dir)
    return bundle.plans(seg, corpus.terms(seg), named(seg), signals(seg), words.text_phrases(seg), LATIN, bundle.checkpointed)["checklist"]


@query("concerns", f"SELECT doc_id, severity, rule AS title FROM ({ORACLE['recommendations']})")
def concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundle.concerns(rollups.recommendations(q._wide(spark, sf_dir))).select("doc_id", "severity", "title")
