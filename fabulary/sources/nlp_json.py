"""Annotated manuscripts: JSON with explicit schemas, enriched by a table of contents and a term list."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabulary.functions.text import title_key

_SPAN = "span ARRAY<INT>"
SEMANTIC = (
    "blocks ARRAY<STRUCT<source_block_ids ARRAY<STRING>, block_ids ARRAY<BIGINT>, content STRING, section_path STRING, `type` STRING, title STRING, "
    f"tokens ARRAY<STRUCT<text STRING, pos STRING, confidence FLOAT, {_SPAN}, source STRING>>, "
    f"entities ARRAY<STRUCT<text STRING, category STRING, source STRING, confidence FLOAT, {_SPAN}, keep BOOLEAN>>, "
    f"noun_signals ARRAY<STRUCT<text STRING, pos STRING, syntactic_role STRING, score FLOAT, {_SPAN}>>>>"
)
TOC = "result STRUCT<toc STRUCT<entries ARRAY<STRUCT<title STRING, level INT>>>>"
TERMS = "terms ARRAY<STRUCT<text STRING, original_text STRING, category STRING, score FLOAT, block_ids ARRAY<BIGINT>>>"
# Fixed values.
CATEGORIES = ("PERSON", "ORGANIZATION", "LOCATION", "DATE", "FACILITY", "PRODUCT", "NUMBER")
TAG_NAMES = "sub sup br div span p b i u em strong small big code pre table tr td th a img html head body title meta link script style".split()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("doc_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*/[^/]*$", 1))


def category(name: Column) -> Column:
    return F.when(F.upper(name).isin(*CATEGORIES), F.upper(name)).otherwise("UNKNOWN")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The block table with block_ids, tokens, entities and noun_signals; the folder above the file's folder names the document."""
    rows = _read(spark, path, SEMANTIC).select("doc_id", F.posexplode("blocks").alias("seq", "b"))
    at = lambda x, i: F.coalesce(F.get(x["span"], F.lit(i)), F.lit(0))
    token = lambda t: F.struct(t["text"].alias("text"), t["pos"].alias("pos"), t["confidence"].alias("confidence"), at(t, 0).alias("span_start"), at(t, 1).alias("span_end"), t["source"].alias("source"))
    entity = lambda e: F.struct(e["text"].alias("text"), category(e["category"]).alias("category"), e["confidence"].alias("confidence"), F.coalesce(e["keep"], F.lit(True)).alias("keep"), at(e, 0).alias("span_start"))
    signal = lambda s: F.struct(s["text"].alias("text"), s["pos"].alias("pos"), s["score"].alias("score"), at(s, 0).alias("span_start"))
    return rows.select(
        F.col("doc_id").alias("project_id"),
        "doc_id",
        "seq",
        F.get("b.source_block_ids", F.lit(0)).alias("source_block_id"),
        F.coalesce("b.block_ids", F.array().cast("array<bigint>")).alias("block_ids"),
        F.coalesce("b.content", F.lit("")).alias("content"),
        F.coalesce("b.section_path", F.lit("")).alias("section_path"),
        F.coalesce("b.type", F.lit("paragraph")).alias("block_type"),
        F.col("b.title").alias("title"),
        F.transform("b.tokens", token).alias("tokens"),
        F.transform("b.entities", entity).alias("entities"),
        F.transform("b.noun_signals", signal).alias("noun_signals"),
    )


def toc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, nth, title, level (at least 1); entries without a title are dropped."""
    rows = _read(spark, path, TOC).select("doc_id", F.posexplode("result.toc.entries").alias("nth", "e"))
    return rows.select("doc_id", "nth", F.trim("e.title").alias("title"), F.greatest(F.coalesce("e.level", F.lit(1)), F.lit(1)).alias("level")).where("title <> ''")


def terms(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text, category, score, block_ids; the printed form is preferred, names of tags are dropped."""
    rows = _read(spark, path, TERMS).select("doc_id", F.explode("terms").alias("t"))
    text = F.trim(F.coalesce(F.nullif(F.trim("t.original_text"), F.lit("")), F.col("t.text")))
    return rows.select("doc_id", text.alias("text"), "t.category", "t.score", "t.block_ids").where((F.col("text") != "") & ~F.lower("text").isin(TAG_NAMES))


def with_toc(blk: DataFrame, entries: DataFrame) -> DataFrame:
    """blk with section paths from the table of contents.

    Each entry takes the first fitting block behind the one before it: a title block that equals or holds it, else any
    block that equals it. That is sequential within a document, so documents are matched one by one in a grouped map over
    their titles and the blocks that equal an entry; the paths are then carried forward by a window.
    """
    keys = blk.select("doc_id", "seq", title_key(F.col("content")).alias("key"), (F.col("block_type") == "title").alias("is_title"))
    wanted = entries.select("doc_id", "nth", "title", "level", title_key(F.col("title")).alias("want"))
    # Of other blocks only those that equal an entry can be taken, whatever their length.
    equal = keys.where(~F.col("is_title")).join(wanted.select("doc_id", F.col("want").alias("key")).distinct(), ["doc_id", "key"], "left_semi")
    keys = keys.where("is_title").unionByName(equal)

    def match(k: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        k, w = k.sort_values("seq"), w.sort_values("nth")
        after, stack, out = -1, [], []
        for title, level, want in zip(w["title"], w["level"], w["want"]):
            if len(want) < 2:
                continue
            left = k[k["seq"] > after]
            near = left["key"].map(lambda x: bool(x) and (x == want or (min(len(x), len(want)) >= 2 and (x in want or want in x))))
            hits = left[left["is_title"] & near]
            hits = hits if len(hits) else left[left["key"] == want]
            if len(hits):
                after = int(hits["seq"].iloc[0])
                stack = [s for s in stack if s[0] < level] + [(level, title)]
                out.append((k["doc_id"].iloc[0], after, " / ".join(t for _, t in stack)))
        return pd.DataFrame(out, columns=["doc_id", "seq", "toc_path"])

    found = keys.groupBy("doc_id").cogroup(wanted.groupBy("doc_id")).applyInPandas(lambda k, w: match(k, w) if len(k) and len(w) else pd.DataFrame({"doc_id": [], "seq": [], "toc_path": []}), "doc_id string, seq int, toc_path string")
    carried = F.last("toc_path", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("seq"))
    return blk.join(found, ["doc_id", "seq"], "left").withColumn("section_path", F.coalesce(carried, "section_path")).drop("toc_path")


def with_terms(blk: DataFrame, found: DataFrame) -> DataFrame:
    """blk with the terms as noun signals of the first block that has their block id."""
    first = blk.select("doc_id", "seq", F.explode("block_ids").alias("id")).groupBy("doc_id", "id").agg(F.min("seq").alias("seq"))
    each = found.select("doc_id", F.explode("block_ids").alias("id"), "text", F.col("category").alias("pos"), "score")
    extra = each.join(first, ["doc_id", "id"]).groupBy("doc_id", "seq").agg(F.sort_array(F.collect_list(F.struct("text", "pos", "score", F.lit(0).alias("span_start")))).alias("more"))
    joined = blk.join(extra, ["doc_id", "seq"], "left")
    none = F.array().cast("array<struct<text:string,pos:string,score:float,span_start:int>>")
    return joined.withColumn("noun_signals", F.concat(F.coalesce("noun_signals", none), F.coalesce("more", none))).drop("more")


def tokens(blk: DataFrame) -> DataFrame:
    return blk.select("doc_id", "seq", F.posexplode("tokens").alias("nth", "t")).select("doc_id", "seq", "nth", "t.text", "t.pos", "t.span_start", "t.span_end")


def mentions(blk: DataFrame) -> DataFrame:
    return blk.select("doc_id", "seq", "section_path", F.posexplode("entities").alias("nth", "e")).select("doc_id", "seq", "section_path", "nth", "e.text", "e.category")


