"""The block table, and adapters that make it from plain tables of texts.

Blocks: project_id, doc_id, seq, content, section_path, block_type, title. Tokens: doc_id, seq, nth, text, pos,
span_start, span_end. Mentions: doc_id, seq, nth, text, category. All keyed by doc_id, so that grouping and windows
share one distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions.text import has_text, let
from fabulary.operators.segments import numbered


def _part(seq: Column, n_lines: Column, parts: int) -> Column:
    return F.concat(F.lit("part "), F.lpad((F.floor(seq * parts / n_lines).cast("int") + 1).cast("string"), 2, "0"))


def _typed(content: Column) -> list[Column]:
    kind = F.when(F.length(content) <= 40, "title").when(content.rlike(r"^[-*•] "), "list").otherwise("paragraph")
    return [kind.alias("block_type"), F.lit(None).cast("string").alias("title")]


def blocks(docs: DataFrame, parts: int = 10) -> DataFrame:
    """One block per line of a text that isn't blank, numbered before blank ones go; sections are tenths of the lines."""
    lines = F.split(F.col("text"), "\n")
    cut = docs.select(F.col("source").alias("project_id"), "doc_id", F.size(lines).alias("n_lines"), F.posexplode(lines).alias("seq", "content"))
    kept = cut.where(has_text(F.col("content")))
    return kept.select("project_id", "doc_id", "seq", "content", _part(F.col("seq"), F.col("n_lines"), parts).alias("section_path"), *_typed(F.col("content")))


def segmented(docs: DataFrame, parts: int = 10) -> DataFrame:
    """blocks() with segments. A row is a document, so its blocks are numbered within it and no text is shuffled."""
    line = lambda x, seq, lines: F.struct(seq.alias("seq"), x.alias("content"), _part(seq, F.size(lines), parts).alias("section_path"))
    cut = let(F.split(F.col("text"), "\n"), lambda lines: F.filter(F.transform(lines, lambda x, seq: line(x, seq, lines)), lambda b: has_text(b["content"])))
    each = docs.select(F.col("source").alias("project_id"), "doc_id", F.explode(numbered(cut)).alias("b"))
    return each.select("project_id", "doc_id", "b.*", *_typed(F.col("b.content")))


def conversation_blocks(turns: DataFrame) -> DataFrame:
    """One block per turn; the section is the role."""
    return turns.select(
        F.lit("conversations").alias("project_id"),
        F.col("conv_id").alias("doc_id"),
        F.col("turn").cast("int").alias("seq"),
        F.col("text").alias("content"),
        F.col("role").alias("section_path"),
        F.lit("paragraph").alias("block_type"),
        F.lit(None).cast("string").alias("title"),
    )


def terms(blk: DataFrame, word: str = r"\p{L}+") -> DataFrame:
    """The words of each block without their places."""
    return blk.select("doc_id", "seq", F.explode(F.regexp_extract_all(F.col("content"), F.lit(word), F.lit(0))).alias("text"))


def tokens(blk: DataFrame, word: str = r"\p{L}+", pos: Column | None = None) -> DataFrame:
    """Words of each block with their places. Without a tagger pos is null, which measures report as not measured."""
    found = F.regexp_extract_all(F.col("content"), F.lit(word), F.lit(0))
    gaps = F.slice(F.split(F.col("content"), word, -1), F.lit(1), F.size(found))
    spans = F.arrays_zip(gaps.alias("gap"), found.alias("text"))
    each = blk.select("doc_id", "seq", F.posexplode(spans).alias("nth", "w")).select("doc_id", "seq", "nth", "w.gap", "w.text")
    upto = Window.partitionBy("doc_id", "seq").orderBy("nth")
    end = F.sum(F.length("gap") + F.length("text")).over(upto)
    return each.select("doc_id", "seq", "nth", "text", (pos if pos is not None else F.lit(None).cast("string")).alias("pos"), (end - F.length("text")).alias("span_start"), end.alias("span_end"))


def mentions(blk: DataFrame) -> DataFrame:
    """Capitalised words that don't open a sentence, as stand-ins for named persons: test scaffolding, not a tagger."""
    found = F.regexp_extract_all(F.col("content"), F.lit(r"[\p{Ll},] (\p{Lu}\p{Ll}{3,})"), F.lit(1))
    return blk.select("doc_id", "seq", "section_path", F.posexplode(found).alias("nth", "text")).withColumn("category", F.lit("PERSON"))
