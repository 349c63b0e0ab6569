"""Queries through the document store: saved, replaced and deleted documents, merged projects, and results that are missing; and dates told in
the lunar calendar and by reigns.

Each query fills a store of its own in the shared folder from the given tables and reads it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabulary.functions import calendar, lunar
from fabulary.operators import plot, segments, timeline
from fabulary.operators.components import ensure_checkpoint_dir
from fabulary.plans import bundle, graph, incremental, reviews
from fabulary.plans import queries as q
from fabulary.plans.library import Library
from fabulary.plans.queries import query
from fabulary.sources import corpus


def new_library(spark: SparkSession) -> Library:
    ensure_checkpoint_dir(spark)
    return Library(spark, f"{spark.sparkContext.getCheckpointDir()}/library-{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")))


def _owners(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("project_id"), F.col("lang").alias("title"), F.lit("2020-01-01").cast("timestamp").alias("created_at"))


@query(
    "stored_documents",
    f"""{q._BLOCKS}{q._MENT}, saved AS (SELECT doc_id, seq, CASE WHEN lang = 'en' THEN '> ' || content ELSE content END AS content FROM blocks JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE lang IS DISTINCT FROM 'fr'),
b AS (SELECT doc_id, count(*) AS blocks, sum(length(content)) AS chars, sum(strlen(content)) AS byte_count FROM saved GROUP BY doc_id),
e AS (SELECT ment.doc_id, count(*) AS entities FROM ment JOIN documents USING (doc_id) WHERE lang IS DISTINCT FROM 'en' GROUP BY ment.doc_id)
SELECT d.doc_id, coalesce(d.source, '') AS project_id, coalesce(b.byte_count, 0) AS byte_count, coalesce(b.blocks, 0) AS blocks, coalesce(b.chars, 0) AS chars, coalesce(e.entities, 0) AS entities
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id WHERE d.lang IS DISTINCT FROM 'fr'""",
)
def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are saved with their blocks and mentions; those in English are saved again in another form and without mentions, those in French deleted."""
    docs = q.documents(spark, sf_dir)
    blk = corpus.blocks(docs)
    library = new_library(spark)
    ment = corpus.mentions(blk).withColumn("keep", F.lit(True))
    library.save(_owners(docs), blk, entities=ment)
    english = docs.where("lang = 'en'")
    library.save(_owners(english), corpus.blocks(english).withColumn("content", F.concat(F.lit("> "), "content")))
    library.delete(docs.where("lang = 'fr'"))
    owners = library.documents()
    counted = library.children("blocks", documents=owners).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.length("content")).alias("chars"))
    named = library.children("entities", documents=owners).groupBy("doc_id").agg(F.count("*").alias("entities"))
    found = owners.select("doc_id", "project_id", "byte_count").join(counted, "doc_id", "left").join(named, "doc_id", "left").fillna(0, ["blocks", "chars", "entities"])
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


@query(
    "project_merge",
    f"{q._BLOCKS} SELECT coalesce(project_id, '') AS project_id, row_number() OVER (PARTITION BY coalesce(project_id, '') ORDER BY CAST(doc_id AS VARCHAR), seq) - 1 AS seq, doc_id AS part_of, length(content) AS chars, section_path FROM blocks",
)
def project_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each source as one document, numbered through."""
    docs = q.documents(spark, sf_dir)
    library = new_library(spark)
    library.save(_owners(docs), corpus.blocks(docs))
    return library.merged().select("project_id", F.col("seq").cast("long").alias("seq"), F.col("part_of").cast("long").alias("part_of"), F.length("content").alias("chars"), "section_path")


_FIRST = "(SELECT min(coalesce(source, '')) FROM documents)"


@query(
    "results_missing",
    f"""{q._BLOCKS}, {q._HASHES}, h AS (SELECT doc_id, coalesce(project_id, '') AS project_id, hash FROM hashes),
w AS (SELECT *, unnest([{", ".join(f"'{d}'" for d, *_ in bundle.DIMENSIONS)}]) AS dimension FROM h)
SELECT dimension, count(*) AS documents, count(DISTINCT hash || ' ' || project_id) AS contents FROM w WHERE dimension NOT IN ('t1', 'dialogue') OR project_id = {_FIRST} GROUP BY dimension""",
)
def results_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dimensions are computed and stored for all documents, then the results of one project are made invalid: what is missing, by dimension."""
    docs = q.documents(spark, sf_dir).withColumn("source", F.coalesce("source", F.lit("")))
    blk = corpus.blocks(docs)
    library = new_library(spark)
    incremental.fill(library, blk, lex=reviews.LATIN, dimensions=("t1", "dialogue"))
    first = docs.agg(F.min("source")).first()[0]
    if first is not None:
        library.invalidate(first)
    gone = library.missing(incremental.hashes_of(blk), [d for d, *_ in bundle.DIMENSIONS])
    return gone.groupBy("dimension").agg(F.count("*").alias("documents"), F.countDistinct("hash", "project_id").alias("contents"))


# --- what stands above the graph


_SHELL = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in graph.SHELLS.items()) + " END"


@query(
    "graph_narratives",
    f"""{q._PRESENCE}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coverage DESC, mentions DESC, subject) AS rank FROM threads),
k AS (SELECT doc_id, subject, rank, coverage, CASE WHEN rank <= 3 AND coverage >= 0.25 AND shape = 'sustained' THEN 'rain_band' WHEN rank <= 3 AND coverage >= 0.25 THEN 'tethered_balloon'
  WHEN shape IN ('intermittent', 'burst', 'late_arrival') THEN 'satellite' WHEN shape = 'setup_only' THEN 'free_balloon' END AS type FROM r WHERE rank <= 12),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) - 1 AS nth, {_SHELL} AS radius FROM k WHERE type IS NOT NULL)
SELECT doc_id, nth, subject AS label, type, round(radius * sin(0.7 + 0.15 * (nth % 4)) * cos(nth * {graph.GOLDEN_ANGLE!r}), 6) AS x, round(radius * cos(0.7 + 0.15 * (nth % 4)), 6) AS y, round(radius * sin(0.7 + 0.15 * (nth % 4)) * sin(nth * {graph.GOLDEN_ANGLE!r}), 6) AS z, 1 AS links FROM n""",
)
def graph_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threads of every document as narratives of its graph, each linked to the node of its subject."""
    presence = q.presence(spark, sf_dir)
    lines = plot.plotlines(presence).withColumnRenamed("doc_id", "project_id")
    node = graph.nodes(graph.entity_stats(presence.select(F.col("doc_id").alias("project_id"), F.col("subject").alias("text"), F.lit("PRODUCT").alias("category"))))
    made = graph.narratives(lines, node)
    return made.select(F.col("project_id").alias("doc_id"), "nth", "label", "type", *[F.round(c, 6).alias(c) for c in "xyz"], F.size("links").alias("links"))


# --- dates told by reigns, wheel and moon


def told_by_reigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per customer, one block per order: its date moved to the reign of Qianlong, by reign year and month; the last blocks of a document give the year by the wheel."""
    o = q.table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey")
    seq, many = F.row_number().over(w.orderBy("o_orderkey")) - 1, F.count("*").over(w)
    year = F.year("o_orderdate") - 1992 + 1740  # leap years fall on leap years
    rows = o.select(F.col("o_custkey").alias("doc_id"), seq.alias("seq"), many.alias("many"), year.alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"))
    regnal = (F.col("y") - 1735).cast("string")
    solar = F.concat(F.lit("乾隆"), regnal, F.lit("年"), F.col("m").cast("string"), F.lit("月"), F.col("d").cast("string"), F.lit("日"))
    wheel = F.concat(calendar.pair_of(calendar.wheel_index(F.col("y"))), F.lit("年"))
    shared = F.concat(F.lit("至元"), F.col("d").cast("string"), F.lit("年"))
    content = F.when(F.col("seq") % 3 == 0, solar).when(F.col("seq") % 3 == 1, wheel).otherwise(shared)
    part = F.concat(F.lit("part "), F.lpad(F.floor(F.col("seq") / 3).cast("string"), 3, "0"))
    return segments.with_segments(rows.select(F.lit("p").alias("project_id"), "doc_id", "seq", content.alias("content"), part.alias("section_path"), F.lit("paragraph").alias("block_type"), F.lit(None).cast("string").alias("title")))


@query(
    "reign_dates",
    """WITH o AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, year(o_orderdate) - 1992 + 1740 AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders),
t AS (SELECT doc_id, seq, m, d, y, CASE WHEN seq % 3 = 0 THEN make_date(y, m, d) END AS told, CASE seq % 3 WHEN 0 THEN 'era_day' WHEN 1 THEN 'ganzhi_year' ELSE 'era_year' END AS precision,
  CASE WHEN seq % 3 = 2 THEN list_filter([CASE WHEN d BETWEEN 1 AND 31 THEN 1263 + d END, CASE WHEN d BETWEEN 1 AND 6 THEN 1334 + d END], lambda x: x IS NOT NULL) END AS years FROM o),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS marker FROM t),
k AS (SELECT *, CASE WHEN seq % 3 = 0 THEN y WHEN seq % 3 = 2 AND len(years) = 1 THEN years[1] END AS known FROM a),
n AS (SELECT x.doc_id, x.seq, x.y, (SELECT z.known FROM k z WHERE z.doc_id = x.doc_id AND z.seq <> x.seq AND z.known IS NOT NULL AND abs(z.seq - x.seq) <= 2 ORDER BY abs(z.seq - x.seq), z.seq LIMIT 1) AS near FROM k x WHERE x.seq % 3 = 1),
p AS (SELECT doc_id, seq, near - 29 + ((y - 4) - (near - 29 - 4)) % 60 + CASE WHEN ((y - 4) - (near - 29 - 4)) % 60 < 0 THEN 60 ELSE 0 END AS year FROM n)
SELECT k.doc_id, k.seq, k.marker, precision, CASE WHEN k.seq % 3 = 2 AND len(years) > 1 THEN 'partial' ELSE 'absolute' END AS kind, CASE WHEN k.seq % 3 = 2 THEN len(years) ELSE 0 END AS candidates,
  CASE WHEN k.seq % 3 = 0 THEN strftime(told, '%Y-%m-%d') WHEN k.seq % 3 = 1 THEN p.year || '-01-01' WHEN len(years) = 1 THEN years[1] || '-01-01' END AS date
FROM k LEFT JOIN p ON p.doc_id = k.doc_id AND p.seq = k.seq""",
)
def reign_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a reign, years of the wheel placed by them, and years of a reign that shares its name with another."""
    found = timeline.anchored(timeline.markers(told_by_reigns(spark, sf_dir), calendar.ERA_NAMES, most=1 << 30))
    candidates = F.when(F.col("seq") % 3 == 2, F.size("years")).otherwise(0)
    return found.select("doc_id", "seq", "marker", "precision", "kind", candidates.alias("candidates"), F.col("date").cast("string").alias("date"))


@query("lunar_order_days")
def lunar_order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order day as a lunar date, and that date turned back; months are looked up by the span of days they cover."""
    months = lunar.months(spark, 1980, 2010)
    days = q.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).groupBy("day").agg(F.count("*").alias("orders"))
    each = months.select("lunar_year", "month", "leap", F.explode(F.sequence("first_day", F.date_add("first_day", F.col("days") - 1))).alias("day"), (F.datediff("day", "first_day") + 1).alias("lunar_day"))
    told = days.join(F.broadcast(each), "day")
    return lunar.to_dates(told.withColumnRenamed("lunar_year", "year"), months, "year", "month", "lunar_day", "leap", "back").select("day", "orders", "year", "month", "leap", "lunar_day", "back")
