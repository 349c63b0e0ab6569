"""Queries over the driver's tables, one or more for each operator, with DuckDB SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabulary.functions import calendar, lexicon, text
from fabulary.operators import conflict, dialogue, pacing, phrases, plot, sections, segments, setting, structure, theme, timeline, voice, words
from fabulary.plans import graph, rollups
from fabulary.sources import corpus

#: Latin terminators; the default set leaves the full stop out.
STOPS = ".!?;"
#: Small Latin lexicons, since the tables hold no Chinese.
LATIN_CONFLICT = {"outer": ["th", "ou"], "inner": ["ing", "tion"], "social": ["that", "with"]}
LATIN_PHRASES = [("(the|and) th", "opening"), ("tion(al|ed)?", "ending"), ("ou(gh)?", "vowel")]
LATIN_TIERS = [("idiot", "profanity", "mild"), ("moron", "hate", "strong"), ("(worthless|clown)", "profanity", "moderate")]
LATIN_ENV = ["ea", "hand", "the"]
LATIN_PERSONS = {"first": "is|as", "second": "of|on", "third": "the|that"}
LATIN_MARKS = [(".", "stop"), (",", "comma"), ("!", "bang"), ("?", "query"), ("*", "star")]
LATIN_GROUPS = [("articles", "aeiou"), ("rest", "xyz")]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a table that the scan cuts into fewer pieces than there are cores is dealt out by document first.

    One file with one row group is read by one task, which would then do all the work. A table of many files is left as it is.
    """
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs


def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.blocks(documents(spark, sf_dir))


def doc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.segmented(documents(spark, sf_dir))


_LINES = "lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS seq, len(string_split(text, chr(10))) AS n_lines FROM documents)"
_BLOCKS = f"""WITH {_LINES}, blocks AS (
  SELECT source AS project_id, doc_id, seq, content, 'part ' || lpad(CAST(CAST(floor(seq * 10 / n_lines) AS INT) + 1 AS VARCHAR), 2, '0') AS section_path,
    CASE WHEN length(content) <= 40 THEN 'title' WHEN regexp_matches(content, '^[-*•] ') THEN 'list' ELSE 'paragraph' END AS block_type,
    length(regexp_replace(content, '\\s', '', 'g')) AS visible
  FROM lines WHERE length(regexp_replace(content, '\\s', '', 'g')) > 0)"""
_SEG = (
    _BLOCKS
    + """, firsts AS (SELECT *, min(seq) OVER (PARTITION BY doc_id, section_path) AS first_seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS idx, count(*) OVER (PARTITION BY doc_id) AS n_blocks FROM blocks),
  ranked AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY first_seq) - 1 AS rk FROM firsts),
  tops AS (SELECT *, max(rk) OVER (PARTITION BY doc_id) + 1 AS n_top FROM ranked),
  seg AS (SELECT doc_id, seq, content, visible, section_path, block_type, n_top < 3 AS chunked,
    CASE WHEN n_top < 3 THEN least(CAST(floor(idx / ceil(n_blocks / 10.0)) AS INT), 9) ELSE CAST(rk AS INT) END AS seg,
    CASE WHEN n_top < 3 THEN 10 ELSE CAST(n_top AS INT) END AS n_segments,
    CASE WHEN n_top < 3 THEN CAST(least(CAST(floor(idx / ceil(n_blocks / 10.0)) AS INT), 9) + 1 AS VARCHAR) || '/10' ELSE section_path END AS label FROM tops),
  axis AS (SELECT doc_id, unnest(range(max(n_segments))) AS seg, max(n_segments) AS n_segments, bool_or(chunked) AS chunked FROM seg GROUP BY doc_id)"""
)
#: Content hashes of the blocks: block type, content, section path and title, each with its length.
_HASHES = """hashes AS (SELECT doc_id, any_value(project_id) AS project_id, sha256('v2' || string_agg(sha256(strlen(block_type) || ':' || block_type || strlen(content) || ':' || content || strlen(section_path) || ':' || section_path || '-'), '' ORDER BY seq)) AS hash FROM blocks GROUP BY doc_id)"""
_SENT = r"list_filter(string_split_regex(content, '[.!?;]'), lambda x: length(regexp_replace(x, '\s', '', 'g')) > 0)"
_LENS = rf"list_transform({_SENT}, lambda x: length(regexp_replace(x, '\s', '', 'g')))"
_QUOTED = r"""coalesce(list_sum(list_transform(regexp_extract_all(content, '[“「『"]([^”」』]*)', 1), lambda x: length(regexp_replace(x, '[\s“「『"]', '', 'g')))), 0)"""
_WORDS = ", words AS (SELECT doc_id, seq, unnest(regexp_extract_all(content, '\\p{L}+')) AS term FROM blocks)"
_MENT = r""", ment AS (SELECT doc_id, seq, section_path, unnest(regexp_extract_all(content, '[\p{Ll},] (\p{Lu}\p{Ll}{3,})', 1)) AS text, unnest(range(len(regexp_extract_all(content, '[\p{Ll},] (\p{Lu}\p{Ll}{3,})', 1)))) AS nth FROM blocks)"""


# --- words and sentences


@query(
    "doc_sentence_stats",
    f"""{_BLOCKS}, l AS (SELECT doc_id, {_LENS} AS l FROM blocks)
SELECT doc_id, sum(len(l)) AS sentence_count, sum(coalesce(list_sum(l), 0)) AS sentence_chars, sum(len(list_filter(l, lambda x: x <= 20))) AS upto_20,
  sum(len(list_filter(l, lambda x: x > 20 AND x <= 50))) AS upto_50, sum(len(list_filter(l, lambda x: x > 50 AND x <= 100))) AS upto_100, sum(len(list_filter(l, lambda x: x > 100))) AS above_100,
  round(coalesce(sum(coalesce(list_sum(l), 0)) / nullif(sum(len(l)), 0), 0), 6) AS avg_sentence_chars
FROM l GROUP BY doc_id""",
)
def doc_sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.sentence_stats(doc_blocks(spark, sf_dir), STOPS).withColumn("avg_sentence_chars", F.round("avg_sentence_chars", 6))


@query(
    "readability",
    f"""{_BLOCKS}, b AS (SELECT doc_id, {_LENS} AS l, regexp_extract_all(content, '[A-Za-z]+') AS w, length(regexp_replace(content, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(content, '[^一-鿿]', '', 'g')) AS cjk FROM blocks),
d AS (SELECT doc_id, sum(len(l)) AS s, sum(coalesce(list_sum(l), 0)) AS total, greatest(sum(len(w)), 1) AS w, sum(latin) AS latin, sum(cjk) AS cjk, sum(coalesce(list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')), 1))), 0)) AS y FROM b GROUP BY doc_id)
SELECT doc_id, CASE WHEN s = 0 THEN 'none' WHEN cjk >= latin THEN 'cjk-sentence-length' ELSE 'flesch' END AS method,
  round(CASE WHEN s = 0 THEN 0 WHEN cjk >= latin THEN greatest(0, least(100, 100 - greatest(total / s - 25, 0) * 2)) ELSE greatest(0, least(100, 206.835 - 1.015 * (w / s) - 84.6 * (y / w))) END, 6) AS score FROM d""",
)
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.readability(doc_blocks(spark, sf_dir), STOPS).select("doc_id", "method", F.round("score", 6).alias("score"))


@query(
    "doc_totals",
    f"{_BLOCKS} SELECT doc_id, count(*) AS block_count, sum(strlen(content)) AS byte_count, round(sum(strlen(content)) / count(*), 6) AS avg_block_length FROM blocks GROUP BY doc_id",
)
def doc_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.totals(doc_blocks(spark, sf_dir)).withColumn("avg_block_length", F.round("avg_block_length", 6))


@query(
    "top_words",
    f"""{_BLOCKS}{_WORDS}, c AS (SELECT doc_id, lower(term) AS term, count(*) AS n FROM words GROUP BY ALL)
SELECT doc_id, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 50""",
)
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.top_words(corpus.terms(doc_blocks(spark, sf_dir)))


@query(
    "compare_words",
    f"""WITH {_LINES}, w AS (SELECT source, lower(unnest(regexp_extract_all(content, '\\p{{L}}+'))) AS term FROM lines), c AS (SELECT source, term, count(*) AS n FROM w GROUP BY ALL)
SELECT term, max(n) AS max_n, count(*) AS n_projects FROM c GROUP BY term ORDER BY max_n DESC, term LIMIT 20""",
)
def compare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    blk = doc_blocks(spark, sf_dir)
    counts = blk.select("project_id", F.explode(F.regexp_extract_all("content", F.lit(r"\p{L}+"), F.lit(0))).alias("t")).groupBy("project_id", F.lower("t").alias("term")).agg(F.count("*").alias("n"))
    return graph.compare_words(counts).select("term", "max_n", "n_projects")


@query(
    "repeated_phrases",
    rf"""{_BLOCKS}, w AS (SELECT doc_id, seq, regexp_extract_all(content, '\p{{L}}+') AS t, string_split_regex(content, '\p{{L}}+') AS g FROM blocks),
f AS (SELECT doc_id, seq, unnest(t) AS a, unnest(range(len(t))) AS nth, unnest(list_transform(range(len(t)), lambda i: g[i + 2])) AS gap FROM w),
s AS (SELECT *, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(gap, 1) OVER o AS gap2 FROM f WINDOW o AS (PARTITION BY doc_id, seq ORDER BY nth)),
p AS (SELECT doc_id, a || ' ' || b AS phrase FROM s WHERE b IS NOT NULL AND length(gap) = 1 UNION ALL SELECT doc_id, a || ' ' || b || ' ' || c FROM s WHERE c IS NOT NULL AND length(gap) = 1 AND length(gap2) = 1),
n AS (SELECT doc_id, phrase, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 5)
SELECT doc_id, phrase, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, phrase) AS rank FROM n) WHERE rank <= 30""",
)
def repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.text_phrases(doc_blocks(spark, sf_dir))


# --- sections


@query("section_sizes", f"{_BLOCKS} SELECT doc_id, section_path, min(seq) AS first_seq, count(*) AS block_count, sum(strlen(content)) AS byte_count FROM blocks GROUP BY ALL")
def section_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.section_sizes(doc_blocks(spark, sf_dir))


@query(
    "extreme_sections",
    f"""{_BLOCKS}, s AS (SELECT doc_id, section_path, min(seq) AS f, sum(strlen(content)) AS b FROM blocks GROUP BY ALL)
SELECT doc_id, count(*) AS section_count, max_by(section_path, b * 1000000 + f) AS longest_section, min_by(section_path, b * 1000000 + f) AS shortest_section FROM s GROUP BY doc_id""",
)
def extreme_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.extreme_sections(doc_blocks(spark, sf_dir))


@query("block_types", f"{_BLOCKS} SELECT doc_id, block_type, count(*) AS n FROM blocks GROUP BY ALL")
def block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.block_types(doc_blocks(spark, sf_dir))


@query("segment_plan", f"{_SEG} SELECT doc_id, seq, seg, label, n_segments, chunked FROM seg")
def segment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_segments(spark, sf_dir).select("doc_id", "seq", "seg", "label", "n_segments", "chunked")


@query(
    "characters",
    f"""{_BLOCKS}{_MENT}, place AS (SELECT doc_id, seq, section_path, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS idx, count(*) OVER (PARTITION BY doc_id) AS nb FROM blocks),
m AS (SELECT DISTINCT doc_id, seq, text AS name FROM ment),
c AS (SELECT doc_id, name, count(*) AS mentions, min_by(section_path, idx) AS first_section, max_by(section_path, idx) AS last_section, round((max(idx) - min(idx) + 1) / max(nb), 9) AS span_ratio FROM m JOIN place USING (doc_id, seq) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mentions DESC, name) AS rank FROM c) WHERE rank <= 20""",
)
def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    blk = doc_blocks(spark, sf_dir)
    return sections.characters(blk, corpus.mentions(blk)).withColumn("span_ratio", F.round("span_ratio", 9))


_PAIRS = ", m AS (SELECT DISTINCT doc_id, seq, text FROM ment), pairs AS (SELECT x.doc_id, x.text AS a, y.text AS b, count(*) AS n FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.seq = y.seq AND x.text < y.text GROUP BY ALL)"


@query("cooccurrence_pairs", f"{_BLOCKS}{_MENT}{_PAIRS} SELECT doc_id, a, b, n FROM pairs")
def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.cooccurrence(corpus.mentions(doc_blocks(spark, sf_dir)))


@query(
    "character_partners",
    f"""{_BLOCKS}{_MENT}{_PAIRS}, both_ AS (SELECT doc_id, a AS name, b AS partner, n FROM pairs UNION ALL SELECT doc_id, b, a, n FROM pairs)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY n DESC, partner) AS rank FROM both_) WHERE rank <= 5""",
)
def character_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.partners(corpus.mentions(doc_blocks(spark, sf_dir)))


@query("character_graph")
def character_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    blk = doc_blocks(spark, sf_dir)
    ment = corpus.mentions(blk)
    return graph.character_graph(sections.characters(blk, ment), sections.partners(ment))


_POINTS = f""", b AS (SELECT doc_id, seg, visible, {_QUOTED} AS quoted, length(regexp_replace(content, '[^!！?？]', '', 'g')) AS marks, {_LENS} AS l FROM seg),
sums AS (SELECT doc_id, seg, sum(visible) AS chars, sum(quoted) AS quoted, sum(marks) AS marks, sum(len(l)) AS n, sum(len(list_filter(l, lambda x: x <= 12))) AS short, sum(coalesce(list_sum(l), 0)) AS total, sum(coalesce(list_sum(list_transform(l, lambda x: x * x)), 0)) AS squares FROM b GROUP BY ALL),
p AS (SELECT a.doc_id, a.seg, a.chunked, coalesce(chars, 0) AS char_count, coalesce(n, 0) AS n, coalesce(total, 0) AS total, coalesce(squares, 0) AS squares, coalesce(quoted, 0) / greatest(coalesce(chars, 0), 1) AS dialogue_share, coalesce(short / nullif(n, 0), 0) AS short_share, coalesce(marks, 0) / greatest(coalesce(chars, 0), 1) * 1000 AS punct FROM axis a LEFT JOIN sums s ON a.doc_id = s.doc_id AND a.seg = s.seg),
points AS (SELECT *, 100 * (0.35 * least(dialogue_share / 0.5, 1) + 0.30 * short_share + 0.20 * least(punct / 8, 1)) AS tension FROM p)"""


@query(
    "pacing_curve",
    f"""{_SEG}{_POINTS} SELECT doc_id, seg, char_count, n AS sentence_count, round(dialogue_share, 6) AS dialogue_share, round(tension, 6) AS tension,
round(CASE WHEN n >= 2 THEN sqrt(greatest(squares * n - total * total, 0)) / n ELSE 0 END, 6) AS sentence_stdev FROM points""",
)
def pacing_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pacing.curve(doc_segments(spark, sf_dir), terminators=STOPS)
    return points.select("doc_id", "seg", "char_count", "sentence_count", *[F.round(c, 6).alias(c) for c in ("dialogue_share", "tension", "sentence_stdev")])


@query(
    "pacing_drag",
    f"""{_SEG}{_POINTS}, d AS (SELECT doc_id, seg, char_count, tension, char_count / avg(char_count) OVER (PARTITION BY doc_id) AS r, avg(tension) OVER (PARTITION BY doc_id) AS m FROM points),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r DESC, seg) AS rank FROM d WHERE r >= 1.8 AND tension < m - 1e-9)
SELECT doc_id, seg, char_count, round(r, 6) AS length_ratio, rank FROM k WHERE rank <= 10""",
)
def pacing_drag(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = pacing.curve(doc_segments(spark, sf_dir), terminators=STOPS)
    return pacing.drag_sections(points).select("doc_id", "seg", "char_count", F.round("length_ratio", 6).alias("length_ratio"), "rank")


# --- dialogue


@query(
    "dialogue_shares",
    r"""WITH u AS (SELECT conv_id AS doc_id, turn AS seq, length(regexp_replace(text, '\s', '', 'g')) AS chars,
  coalesce(list_sum(list_transform(regexp_extract_all(text, '[“「『"]([^”」』"\n]*)["”」』\n]?', 1), lambda x: length(regexp_replace(x, '\s', '', 'g')))), 0)
  + coalesce(list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*[—–]+') AND NOT regexp_matches(x, '[“「『"]')), lambda x: length(regexp_replace(regexp_replace(x, '^\s*[—–]+', ''), '\s', '', 'g')))), 0) AS said FROM conversations)
SELECT doc_id, seq, chars, least(said, chars) AS dialogue_chars FROM u""",
)
def dialogue_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.block_shares(corpus.conversation_blocks(table(spark, sf_dir, "conversations"))).select("doc_id", "seq", "chars", "dialogue_chars")


@query(
    "quiet_runs",
    r"""WITH t AS (SELECT conv_id AS doc_id, role, length(regexp_replace(text, '\s', '', 'g')) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations),
q AS (SELECT *, a - row_number() OVER (PARTITION BY doc_id ORDER BY a) AS run FROM t WHERE chars < 300),
g AS (SELECT doc_id, run, count(*) AS n, sum(chars) AS chars FROM q GROUP BY ALL)
SELECT doc_id, max(n) AS longest_short_run, max_by(chars, n * 1000000 + chars) AS longest_short_chars FROM g GROUP BY doc_id""",
)
def quiet_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    blk = corpus.conversation_blocks(table(spark, sf_dir, "conversations"))
    return dialogue.longest_run(blk.select("doc_id", "seq", text.visible_chars(F.col("content")).alias("chars")), "chars < 300", "short")


# --- conflict, lexicons, voice


def _term_sql(families: dict[str, list[str]]) -> str:
    rows = ", ".join(f"('{k}', '{t}', {i})" for i, (k, ts) in enumerate(families.items()) for t in ts)
    return f""", terms(kind, term, ord) AS (VALUES {rows}), th AS (SELECT doc_id, seg, kind, term, ord, sum((length(content) - length(replace(content, term, ''))) // length(term)) AS hits FROM seg, terms GROUP BY ALL HAVING sum((length(content) - length(replace(content, term, ''))) // length(term)) > 0)"""


_CONFLICT = (
    _SEG
    + _term_sql(LATIN_CONFLICT)
    + """, k AS (SELECT doc_id, seg, kind, ord, sum(hits) AS hits FROM th GROUP BY ALL), h AS (SELECT doc_id, seg, sum(hits) AS hits, max_by(kind, hits * 10 - ord) AS dominant FROM k GROUP BY ALL), ch AS (SELECT doc_id, seg, sum(visible) AS chars FROM seg GROUP BY ALL),
points AS (SELECT a.doc_id, a.seg, coalesce(chars, 0) AS char_count, coalesce(hits, 0) AS hits, coalesce(dominant, '') AS dominant FROM axis a LEFT JOIN ch USING (doc_id, seg) LEFT JOIN h USING (doc_id, seg))"""
)


@query("conflict_curve", f"{_CONFLICT} SELECT doc_id, seg, char_count, hits, dominant, round(coalesce(hits * 1000 / nullif(char_count, 0), 0), 6) AS density FROM points")
def conflict_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.curve(doc_segments(spark, sf_dir), LATIN_CONFLICT).select("doc_id", "seg", "char_count", "hits", "dominant", F.round("density", 6).alias("density"))


@query(
    "absent_runs",
    f"""{_CONFLICT}, q AS (SELECT *, seg - row_number() OVER (PARTITION BY doc_id ORDER BY seg) AS run FROM points WHERE hits = 0)
SELECT doc_id, min(seg) AS from_seg, max(seg) AS to_seg, count(*) AS sections, sum(char_count) AS char_count FROM q GROUP BY doc_id, run HAVING count(*) >= 3""",
)
def absent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.absent_runs(conflict.curve(doc_segments(spark, sf_dir), LATIN_CONFLICT))


@query(
    "conflict_families",
    f"""{_SEG}{_term_sql(LATIN_CONFLICT)}, t AS (SELECT doc_id, kind, sum(hits) AS hits FROM th GROUP BY ALL)
SELECT doc_id, kind, hits, round(hits / sum(hits) OVER (PARTITION BY doc_id), 6) AS share FROM t""",
)
def conflict_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflict.families_of(doc_segments(spark, sf_dir), LATIN_CONFLICT).select("doc_id", "kind", "hits", F.round("share", 6).alias("share"))


def _hit_sql(lexicon_: list[tuple]) -> str:
    tried = lexicon.variants([p[0] for p in lexicon_])
    either = "|".join(v for v, _ in tried)
    known = ", ".join(f"('{v}', '{lexicon_[n][0]}', '{lexicon_[n][1]}')" for v, n in tried)
    return f""", found AS (SELECT doc_id, seq, seg, unnest(regexp_extract_all(content, '{either}')) AS matched FROM seg), known(matched, pattern, category) AS (VALUES {known}), hits AS (SELECT * FROM found JOIN known USING (matched))"""


@query("lexicon_hits", f"{_SEG}{_hit_sql(LATIN_PHRASES)} SELECT doc_id, seg, pattern, category, matched, count(*) AS n FROM hits GROUP BY ALL")
def lexicon_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrase_hits(doc_segments(spark, sf_dir), LATIN_PHRASES).groupBy("doc_id", "seg", "pattern", "category", "matched").agg(F.count("*").alias("n"))


@query(
    "phrase_tallies",
    f"""{_SEG}{_hit_sql(LATIN_PHRASES)}, t AS (SELECT doc_id, pattern, count(*) AS n, count(DISTINCT seg) AS segments_touched, min(seg) AS first_seg, max(seg) AS last_seg FROM hits GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS share, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pattern) AS rank FROM t""",
)
def phrase_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = doc_segments(spark, sf_dir)
    return phrases.tallies(phrases.phrase_hits(seg, LATIN_PHRASES)).select("doc_id", "pattern", "n", "segments_touched", "first_seg", "last_seg", F.round("share", 6).alias("share"), "rank")


@query(
    "phrase_curve",
    f"""{_SEG}{_hit_sql(LATIN_PHRASES)}, by_ AS (SELECT doc_id, seg, pattern, count(*) AS n FROM hits GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seg ORDER BY n DESC, pattern) AS k, sum(n) OVER (PARTITION BY doc_id, seg) AS hits FROM by_),
ch AS (SELECT doc_id, seg, sum(visible) AS chars FROM seg GROUP BY ALL)
SELECT a.doc_id, a.seg, coalesce(chars, 0) AS char_count, coalesce(hits, 0) AS hits, coalesce(pattern, '') AS top_pattern FROM axis a LEFT JOIN ch USING (doc_id, seg) LEFT JOIN (SELECT * FROM r WHERE k = 1) r USING (doc_id, seg)""",
)
def phrase_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = doc_segments(spark, sf_dir)
    return phrases.curve(seg, phrases.phrase_hits(seg, LATIN_PHRASES)).select("doc_id", "seg", "char_count", "hits", "top_pattern")


@query(
    "explicit_tiers",
    r"""SELECT doc_id, mild, moderate, strong, CASE WHEN strong > 0 THEN 'strong' WHEN moderate > 0 THEN 'moderate' ELSE 'mild' END AS advisory FROM (
SELECT doc_id, len(regexp_extract_all(text, 'idiot')) AS mild, len(regexp_extract_all(text, 'worthless|clown')) AS moderate, len(regexp_extract_all(text, 'moron')) AS strong FROM documents) WHERE mild + moderate + strong > 0""",
)
def explicit_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.tier_counts(phrases.explicit_hits(doc_segments(spark, sf_dir), LATIN_TIERS))


@query(
    "voice_marks",
    f"""{_BLOCKS}, m(mark, pat) AS (VALUES ('.', '[^.]'), (',', '[^,]'), ('!', '[^!]'), ('?', '[^?]'), ('*', '[^*]'))
SELECT doc_id, mark, sum(length(regexp_replace(content, pat, '', 'g'))) AS n, floor(sum(length(regexp_replace(content, pat, '', 'g'))) * 1000 / sum(visible) * 100 + 0.5) / 100 AS per_1000 FROM blocks, m GROUP BY ALL""",
)
def voice_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice.marks(doc_blocks(spark, sf_dir), LATIN_MARKS)


@query(
    "voice_function_words",
    f"""{_BLOCKS}, g(grp, pat) AS (VALUES ('articles', '[^aeiou]'), ('rest', '[^xyz]')) SELECT doc_id, grp AS "group", sum(length(regexp_replace(content, pat, '', 'g'))) AS n FROM blocks, g GROUP BY ALL""",
)
def voice_function_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice.function_words(doc_blocks(spark, sf_dir), LATIN_GROUPS).select("doc_id", "group", "n")


@query(
    "voice_pronouns",
    rf"""{_BLOCKS}, w AS (SELECT doc_id, list_transform(regexp_extract_all(content, '[\p{{L}}\p{{Nd}}\p{{Mn}}_]+'), lambda x: lower(x)) AS w FROM blocks)
SELECT doc_id, sum(len(list_filter(w, lambda x: x IN ('is', 'as')))) AS first, sum(len(list_filter(w, lambda x: x IN ('of', 'on')))) AS second, sum(len(list_filter(w, lambda x: x IN ('the', 'that')))) AS third FROM w GROUP BY doc_id""",
)
def voice_pronouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice.pronouns(doc_blocks(spark, sf_dir), LATIN_PERSONS).select("doc_id", "first", "second", "third")


@query(
    "voice_stance",
    f"""{_BLOCKS} SELECT doc_id, sum((length(content) - length(replace(content, 'ou', ''))) // 2 + (length(content) - length(replace(content, 'ea', ''))) // 2) AS hedging, sum((length(content) - length(replace(content, 'tion', ''))) // 4) AS assertive FROM blocks GROUP BY doc_id""",
)
def voice_stance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice.stance(doc_blocks(spark, sf_dir), ["ou", "ea"], ["tion"]).select("doc_id", "hedging", "assertive")


@query(
    "voice_rhythm",
    f"""{_BLOCKS}, b AS (SELECT doc_id, visible, {_LENS} AS l, coalesce(list_sum(list_transform({_SENT}, lambda x: length(regexp_replace(x, '[^，、；：,]', '', 'g')) + 1)), 0) AS c FROM blocks)
SELECT doc_id, sum(visible) AS char_count, count(*) AS paragraph_count, sum(len(l)) AS sentence_count, min(list_min(l)) AS shortest_sentence, max(list_max(l)) AS longest_sentence, sum(c) AS clause_count, sum(CASE WHEN len(l) = 1 THEN 1 ELSE 0 END) AS single_sentence_paragraphs FROM b GROUP BY doc_id""",
)
def voice_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice.rhythm(doc_blocks(spark, sf_dir), STOPS).select("doc_id", "char_count", "paragraph_count", "sentence_count", "shortest_sentence", "longest_sentence", "clause_count", "single_sentence_paragraphs")


@query(
    "voice_curve",
    f"""{_SEG}, b AS (SELECT doc_id, seg, visible, {_LENS} AS l, coalesce(list_sum(list_transform({_SENT}, lambda x: length(regexp_replace(x, '[^，、；：,]', '', 'g')) + 1)), 0) AS c FROM seg),
s AS (SELECT doc_id, seg, sum(visible) AS chars, sum(len(l)) AS n, sum(coalesce(list_sum(l), 0)) AS total, sum(c) AS clauses FROM b GROUP BY ALL)
SELECT a.doc_id, a.seg, coalesce(chars, 0) AS char_count, coalesce(n, 0) AS sentence_count, coalesce(floor(total / nullif(n, 0) * 10 + 0.5) / 10, 0) AS avg_sentence_chars, coalesce(floor(clauses / nullif(n, 0) * 100 + 0.5) / 100, 0) AS clauses_per_sentence
FROM axis a LEFT JOIN s ON a.doc_id = s.doc_id AND a.seg = s.seg""",
)
def voice_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice.curve(doc_segments(spark, sf_dir), STOPS).select("doc_id", "seg", "char_count", "sentence_count", "avg_sentence_chars", "clauses_per_sentence")


# --- plot over parts and months


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as subjects in the months in which they ship; one document for each year and supplier modulo 10."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.year("l_shipdate") * 10 + F.pmod("l_suppkey", F.lit(10))).alias("doc_id"), F.pmod("l_partkey", F.lit(60)).cast("string").alias("subject"), (F.month("l_shipdate") - 1).alias("section")).agg(F.count("*").alias("n")).withColumn("n_sections", F.lit(12))


_PRESENCE = """WITH p AS (SELECT year(l_shipdate) * 10 + l_suppkey % 10 AS doc_id, CAST(l_partkey % 60 AS VARCHAR) AS subject, month(l_shipdate) - 1 AS section, count(*) AS n FROM lineitem GROUP BY ALL),
g AS (SELECT *, coalesce(section - lag(section) OVER (PARTITION BY doc_id, subject ORDER BY section) - 1, 0) AS gap FROM p),
t AS (SELECT doc_id, subject, sum(n) AS mentions, count(*) AS sections_touched, min(section) AS first_section, max(section) AS last_section, max(gap) AS longest_gap, count(*) / 12 AS coverage FROM g GROUP BY ALL HAVING sum(n) >= 3),
threads AS (SELECT *, CASE WHEN first_section >= 0.8 * 11 THEN 'late_arrival' WHEN last_section <= 0.2 * 11 THEN 'setup_only' WHEN coverage >= 0.5 THEN 'sustained' WHEN longest_gap >= 2 THEN 'intermittent' WHEN sections_touched <= 2 AND mentions >= 6 THEN 'burst' ELSE 'minor' END AS shape FROM t)"""


@query("plot_threads", f"{_PRESENCE} SELECT doc_id, subject, mentions, sections_touched, first_section, last_section, longest_gap, shape FROM threads")
def plot_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plot.threads(presence(spark, sf_dir)).select("doc_id", "subject", "mentions", "sections_touched", "first_section", "last_section", "longest_gap", "shape")


@query("plotlines", f"{_PRESENCE}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coverage DESC, mentions DESC, subject) AS rank FROM threads) SELECT doc_id, subject, mentions, rank, rank <= 3 AND coverage >= 0.25 AS is_main FROM r WHERE rank <= 12")
def plotlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plot.plotlines(presence(spark, sf_dir)).select("doc_id", "subject", "mentions", "rank", "is_main")


@query(
    "turning_points",
    f"""{_PRESENCE}, k AS (SELECT p.doc_id, p.section, list(p.subject) AS now FROM p JOIN threads USING (doc_id, subject) GROUP BY ALL), ax AS (SELECT doc_id, unnest(range(12)) AS section FROM (SELECT DISTINCT doc_id FROM p)),
d AS (SELECT ax.doc_id, ax.section, coalesce(now, []) AS now, lag(coalesce(now, [])) OVER (PARTITION BY ax.doc_id ORDER BY ax.section) AS was FROM ax LEFT JOIN k ON ax.doc_id = k.doc_id AND ax.section = k.section),
c AS (SELECT doc_id, section, (len(list_filter(now, lambda x: NOT list_contains(was, x))) + len(list_filter(was, lambda x: NOT list_contains(now, x)))) / nullif(len(list_distinct(list_concat(now, was))), 0) AS change FROM d WHERE was IS NOT NULL)
SELECT doc_id, section, round(change, 9) AS change, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY change DESC, section) AS rank FROM c WHERE change > 0) WHERE rank <= 3""",
)
def turning_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plot.turning_points(presence(spark, sf_dir)).select("doc_id", "section", F.round("change", 9).alias("change"), "rank")


@query(
    "plot_coherence",
    f"""{_PRESENCE} SELECT doc_id, 12 AS section_count, count(*) AS thread_count, round(greatest(0, least(100, 100 - sum(CASE WHEN shape IN ('setup_only', 'late_arrival') THEN 8 ELSE 0 END + CASE WHEN longest_gap >= 3 THEN 5 ELSE 0 END) - CASE WHEN bool_or(coverage >= 0.5) THEN 0 ELSE 15 END)), 6) AS coherence_score FROM threads GROUP BY doc_id""",
)
def plot_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plot.coherence(presence(spark, sf_dir)).withColumn("coherence_score", F.round("coherence_score", 6))


# --- theme, scenes, places


def theme_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = doc_segments(spark, sf_dir)
    ment = corpus.mentions(seg)
    return theme.candidates(ment.join(seg.select("doc_id", "seq", "seg"), ["doc_id", "seq"]).select("doc_id", "seq", "seg", F.col("text").alias("term")))


@query(
    "theme_components",
    f"""{_BLOCKS.replace("WITH ", "WITH RECURSIVE ", 1)}{_MENT}, t AS (SELECT DISTINCT doc_id, seq, lower(text) AS term FROM ment), w AS (SELECT DISTINCT doc_id, term FROM t),
met AS (SELECT x.doc_id, x.term AS a, y.term AS b FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.seq = y.seq AND x.term < y.term GROUP BY ALL HAVING count(*) >= 3),
held AS (SELECT x.doc_id, x.term AS a, y.term AS b FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.term <> y.term AND contains(y.term, x.term)),
e AS (SELECT doc_id, a, b FROM met UNION SELECT doc_id, b, a FROM met UNION SELECT doc_id, a, b FROM held UNION SELECT doc_id, b, a FROM held),
reach AS (SELECT doc_id, term AS a, term AS b FROM w UNION SELECT r.doc_id, r.a, e.b FROM reach r JOIN e ON r.doc_id = e.doc_id AND r.b = e.a)
SELECT doc_id, a AS term, min(b) AS root FROM reach GROUP BY ALL""",
)
def theme_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theme.clusters(theme_terms(spark, sf_dir))


@query("themes")
def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theme.themes(theme_terms(spark, sf_dir), segments.segment_table(doc_segments(spark, sf_dir)))


@query(
    "scene_sessions",
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'purchase') THEN event_type ELSE '' END AS anchor, CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS opens, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY seq) AS grp FROM e),
b AS (SELECT *, last_value(nullif(anchor, '') IGNORE NULLS) OVER (PARTITION BY user_id, grp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ FROM g),
n AS (SELECT *, CASE WHEN seq = 1 OR opens = 1 OR (anchor <> '' AND before_ IS NOT NULL AND anchor <> before_) THEN 1 ELSE 0 END AS new FROM b)
SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY seq) - 1 AS scene FROM n""",
)
def scene_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    rows = ev.select("user_id", "event_id", F.when(F.col("event_type").isin("click", "purchase"), F.col("event_type")).otherwise("").alias("anchor"), "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"))
    return setting.scene_ids(rows, "user_id", "seq", "anchor", "event_type = 'signup'").select("user_id", "event_id", "scene")


@query(
    "place_absences",
    """WITH v AS (SELECT year(o_orderdate) AS y, c_nationkey AS place, month(o_orderdate) - 1 AS seg, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
g AS (SELECT *, coalesce(seg - lag(seg) OVER (PARTITION BY y, place ORDER BY seg) - 1, 0) AS gap FROM v)
SELECT y, place, sum(n) AS mentions, count(*) AS segments_touched, min(seg) AS first_seg, max(seg) AS last_seg, max(gap) AS longest_absence, sum(CASE WHEN gap >= 3 THEN 1 ELSE 0 END) AS returns FROM g GROUP BY ALL""",
)
def place_absences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    visits = o.groupBy(F.year("o_orderdate").alias("y"), F.col("c_nationkey").alias("place"), (F.month("o_orderdate") - 1).alias("seg")).agg(F.count("*").alias("n")).withColumn("n_segments", F.lit(12))
    return setting.absences(visits, "y", "place", "seg").drop("coverage")


@query(
    "segment_places",
    f"""{_SEG}{_MENT}, m AS (SELECT ment.doc_id, seg.seg, ment.seq, text, min(nth) AS nth FROM ment JOIN seg ON seg.doc_id = ment.doc_id AND seg.seq = ment.seq GROUP BY ALL),
c AS (SELECT doc_id, seg, text, count(*) AS n, min(seq * 1000000 + nth) AS place_at FROM m GROUP BY ALL),
t AS (SELECT doc_id, seg, count(*) AS place_count, first(text ORDER BY n DESC, place_at) AS dominant_place FROM c GROUP BY doc_id, seg)
SELECT a.doc_id, a.seg, coalesce(place_count, 0) AS place_count, coalesce(dominant_place, '') AS dominant_place FROM axis a LEFT JOIN t ON a.doc_id = t.doc_id AND a.seg = t.seg""",
)
def segment_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = doc_segments(spark, sf_dir)
    return setting.segment_places(seg, corpus.mentions(seg).withColumn("category", F.lit("LOCATION"))).select("doc_id", "seg", "place_count", "dominant_place")


# --- structure and time


@query("time_markers")
def time_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.anchored(timeline.markers(doc_segments(spark, sf_dir)))


@query(
    "nearest_anchor",
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN event_id END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS at FROM events),
c AS (SELECT x.user_id, x.event_id, y.v, row_number() OVER (PARTITION BY x.user_id, x.event_id ORDER BY abs(x.at - y.at), y.at) AS k FROM e x JOIN e y ON x.user_id = y.user_id AND x.at <> y.at AND y.v IS NOT NULL)
SELECT e.user_id, e.event_id, c.v AS nearest FROM e LEFT JOIN c ON e.user_id = c.user_id AND e.event_id = c.event_id AND c.k = 1""",
)
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("v"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("at"))
    return timeline.nearest(ev, "user_id", "at", "v").select("user_id", "event_id", "nearest")


@query(
    "date_steps",
    """WITH d AS (SELECT o_custkey, o_orderkey, CAST(lag(o_orderdate) OVER w AS DATE) AS f, CAST(o_orderdate AS DATE) AS t FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, o_orderkey, date_diff('day', f, t) AS days, CASE WHEN date_diff('day', f, t) < 0 THEN 'backstep' WHEN date_diff('day', f, t) >= 366 THEN 'jump' END AS step FROM d WHERE f IS NOT NULL""",
)
def date_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("date", F.to_date("o_orderdate"))
    return timeline.steps(o, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "days", "step")


@query(
    "wheel_years",
    """SELECT DISTINCT year(o_orderdate) AS year, (year(o_orderdate) - 4) % 60 AS wheel, substr('甲乙丙丁戊己庚辛壬癸', CAST((year(o_orderdate) - 4) % 10 + 1 AS INT), 1) || substr('子丑寅卯辰巳午未申酉戌亥', CAST((year(o_orderdate) - 4) % 12 + 1 AS INT), 1) AS pair FROM orders""",
)
def wheel_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return y.select("year", calendar.wheel_index(F.col("year")).alias("wheel"), calendar.pair_of(calendar.wheel_index(F.col("year"))).alias("pair"))


# --- roll-ups and graph


#: Without a tagger, Latin adverbs are told by their end.
ADVERB = "^[A-Za-z]+ly$"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: all that the roll-ups judge. Shares are of all words; repeats are those of the listed phrases."""
    blk = doc_blocks(spark, sf_dir)
    said = words.sentence_stats(blk, STOPS).select("doc_id", text.ratio(F.col("above_100"), F.col("sentence_count")).alias("long_share"))
    balance = rollups.section_balance(sections.section_sizes(blk)).select("doc_id", "max_ratio")
    wide = words.readability(blk, STOPS).select("doc_id", F.col("score").alias("readability")).join(said, "doc_id").join(balance, "doc_id")
    each = corpus.terms(blk).groupBy("doc_id", "text").agg(F.count("*").alias("n")).withColumn("adverb", F.when(F.col("text").rlike(ADVERB), F.col("n")))
    used = each.groupBy("doc_id").agg(F.sum("n").alias("words"), F.sum("adverb").alias("adverbs"), F.max("adverb").alias("top_adverb"))
    again = words.text_phrases(blk).groupBy("doc_id").agg(F.sum("n").alias("repeats"), F.max("n").alias("top_phrase"))
    wide = wide.join(used, "doc_id", "left").join(again, "doc_id", "left").fillna(0, ["words", "adverbs", "top_adverb", "repeats", "top_phrase"])
    return wide.withColumn("adverb_ratio", text.ratio(F.col("adverbs"), F.col("words"))).withColumn("repeat_ratio", text.ratio(F.col("repeats"), F.col("words")))


_WIDE = f"""{_BLOCKS}, b AS (SELECT doc_id, section_path, strlen(content) AS bytes, {_LENS} AS l, regexp_extract_all(content, '[A-Za-z]+') AS w, length(regexp_replace(content, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(content, '[^一-鿿]', '', 'g')) AS cjk FROM blocks),
d AS (SELECT doc_id, sum(len(l)) AS s, sum(len(list_filter(l, lambda x: x > 100))) AS long, sum(coalesce(list_sum(l), 0)) AS total, greatest(sum(len(w)), 1) AS w, sum(latin) AS latin, sum(cjk) AS cjk, sum(coalesce(list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')), 1))), 0)) AS y FROM b GROUP BY doc_id),
z AS (SELECT doc_id, section_path, sum(bytes) AS b FROM b GROUP BY ALL), m AS (SELECT doc_id, CASE WHEN count(*) >= 2 THEN max(b) / quantile_disc(b, 0.5) END AS max_ratio FROM z GROUP BY doc_id),
tn AS (SELECT doc_id, text, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(content, '\\p{{L}}+')) AS text FROM blocks) GROUP BY ALL),
us AS (SELECT doc_id, sum(n) AS words, sum(n) FILTER (regexp_matches(text, '{ADVERB}')) AS adverbs, max(n) FILTER (regexp_matches(text, '{ADVERB}')) AS top_adverb FROM tn GROUP BY doc_id),
ag AS (SELECT doc_id, sum(n) AS repeats, max(n) AS top_phrase FROM ({ORACLE["repeated_phrases"]}) GROUP BY doc_id),
wide AS (SELECT doc_id, coalesce(adverbs / nullif(words, 0), 0) AS adverb_ratio, coalesce(top_adverb, 0) AS top_adverb, coalesce(repeats / nullif(words, 0), 0) AS repeat_ratio, coalesce(top_phrase, 0) AS top_phrase, CASE WHEN s = 0 THEN 0 WHEN cjk >= latin THEN greatest(0, least(100, 100 - greatest(total / s - 25, 0) * 2)) ELSE greatest(0, least(100, 206.835 - 1.015 * (w / s) - 84.6 * (y / w))) END AS readability, coalesce(long / nullif(s, 0), 0) AS long_share, max_ratio FROM d JOIN m USING (doc_id) LEFT JOIN us USING (doc_id) LEFT JOIN ag USING (doc_id))"""


@query(
    "assessment_scores",
    f"""{_WIDE}, sc AS (SELECT doc_id, readability AS readability_score, greatest(0, least(100, 100 - 400 * long_share)) AS rhythm_score, CASE WHEN max_ratio IS NULL THEN 100 ELSE greatest(0, least(100, 100 - 20 * greatest(max_ratio - 1.5, 0))) END AS balance_score,
  greatest(0, least(100, 100 - 500 * greatest(adverb_ratio - 0.04, 0) - least(top_adverb / 20, 20))) AS word_choice_score, greatest(0, least(100, 100 - 1000 * greatest(repeat_ratio - 0.02, 0))) AS repetition_score FROM wide)
SELECT doc_id, round(readability_score, 4) AS readability_score, round(rhythm_score, 4) AS rhythm_score, round(word_choice_score, 4) AS word_choice_score, round(repetition_score, 4) AS repetition_score, round(balance_score, 4) AS balance_score,
  round((readability_score + rhythm_score + word_choice_score + repetition_score + balance_score) / 5, 4) AS overall FROM sc""",
)
def assessment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rollups.assessment(_wide(spark, sf_dir))
    return made.select("doc_id", *[F.round(c, 4).alias(c) for c in ("readability_score", "rhythm_score", "word_choice_score", "repetition_score", "balance_score", "overall")])


@query(
    "recommendations",
    f"""{_WIDE} SELECT doc_id, 'high' AS severity, 'hard_to_read' AS rule FROM wide WHERE readability < 60 UNION ALL SELECT doc_id, 'high', 'many_long_sentences' FROM wide WHERE long_share > 0.15
UNION ALL SELECT doc_id, 'medium', 'some_long_sentences' FROM wide WHERE long_share > 0.05 AND long_share <= 0.15 UNION ALL SELECT doc_id, 'medium', 'one_section_too_long' FROM wide WHERE max_ratio > 3 UNION ALL SELECT doc_id, 'medium', 'one_adverb_overused' FROM wide WHERE top_adverb > 100
UNION ALL SELECT doc_id, 'low', 'many_adverbs' FROM wide WHERE adverb_ratio > 0.06 UNION ALL SELECT doc_id, 'medium', 'one_phrase_repeated' FROM wide WHERE top_phrase > 30""",
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.recommendations(_wide(spark, sf_dir)).select("doc_id", "severity", "rule")


@query("coverage", f"{_BLOCKS}{_MENT}, w AS (SELECT doc_id, bool_or(regexp_matches(content, '\\p{{L}}')) AS has_tokens FROM blocks GROUP BY doc_id) SELECT doc_id, has_tokens, EXISTS (SELECT 1 FROM ment WHERE ment.doc_id = w.doc_id) AS has_entities FROM w")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    blk = doc_blocks(spark, sf_dir)
    return rollups.coverage(blk, corpus.terms(blk), corpus.mentions(blk)).select("doc_id", "has_tokens", "has_entities")


def customers_as_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_mktsegment").alias("project_id"), F.concat(F.lit("  Nation "), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("text"), F.lit("LOCATION").alias("category"))


@query(
    "entity_registry",
    """SELECT c_mktsegment AS project_id, 'ent:' || substr(sha256('LOCATION' || chr(31) || 'nation ' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0')), 1, 16) AS stable_id, count(*) AS mentions FROM customer GROUP BY ALL""",
)
def entity_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.entity_stats(customers_as_mentions(spark, sf_dir)).select("project_id", "stable_id", "mentions")


@query(
    "graph_validate",
    """WITH node AS (SELECT CAST(n_regionkey AS VARCHAR) AS project_id, 'n' || (n_nationkey // 2) AS id, n_nationkey % 7 AS layer, n_nationkey / 20.0 AS weight FROM nation),
edge AS (SELECT CAST(n_regionkey AS VARCHAR) AS project_id, 'e' || (n_nationkey // 3) AS id, 'n' || (n_nationkey // 2) AS source, 'n' || ((n_nationkey + 5) // 2) AS target, n_nationkey / 22.0 AS strength FROM nation),
ends AS (SELECT project_id, id, source AS e FROM edge UNION ALL SELECT project_id, id, target FROM edge)
SELECT project_id, 'duplicate_node' AS issue, id FROM node GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT project_id, 'duplicate_edge', id FROM edge GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT project_id, 'layer', id FROM node WHERE layer NOT BETWEEN 1 AND 5 UNION ALL SELECT project_id, 'weight', id FROM node WHERE weight > 1 UNION ALL SELECT project_id, 'strength', id FROM edge WHERE strength > 1
UNION ALL SELECT DISTINCT project_id, 'missing_end', id FROM ends WHERE NOT EXISTS (SELECT 1 FROM node WHERE node.project_id = ends.project_id AND node.id = ends.e)""",
)
def graph_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as nodes and edges of their regions' graphs, with faults of each kind that is looked for."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("project_id"), F.col("n_nationkey").alias("k"))
    at = lambda shift, by: F.floor((F.col("k") + shift) / by).cast("string")
    node = n.select("project_id", F.concat(F.lit("n"), at(0, 2)).alias("id"), (F.col("k") % 7).alias("layer"), (F.col("k") / 20.0).alias("weight"))
    edge = n.select("project_id", F.concat(F.lit("e"), at(0, 3)).alias("id"), F.concat(F.lit("n"), at(0, 2)).alias("source"), F.concat(F.lit("n"), at(5, 2)).alias("target"), (F.col("k") / 22.0).alias("strength"))
    return graph.validate(node, edge)


@query(
    "document_hash",
    f"{_BLOCKS}, {_HASHES} SELECT doc_id, hash FROM hashes",
)
def document_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fabulary.plans.store import document_hashes

    return document_hashes(doc_blocks(spark, sf_dir))


@query("html_comments_stripped", "SELECT page_id, length(regexp_replace(html, '<!--.*?-->', '', 'gs')) AS n FROM pages")
def html_comments_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(F.regexp_replace("html", "(?s)<!--.*?-->", "")).alias("n"))


@query("quoted_chars", f"{_BLOCKS} SELECT doc_id, sum({_QUOTED}) AS quoted, sum(visible) AS visible FROM blocks GROUP BY doc_id")
def quoted_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_blocks(spark, sf_dir).groupBy("doc_id").agg(F.sum(text.quoted_chars(F.col("content"))).alias("quoted"), F.sum(text.visible_chars(F.col("content"))).alias("visible"))
