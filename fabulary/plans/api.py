"""The public functions: import, analyse, compare, report and export, for many documents in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulary.operators import sections, segments, words
from fabulary.plans import bundle, graph, report
from fabulary.plans.store import document_hashes, upsert, without_project
from fabulary.sources import nlp_json, plaintext


def import_texts(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all Markdown and text files below a path."""
    return plaintext.blocks(plaintext.read_files(spark, path))


def import_project(spark: SparkSession, semantic: str, toc: str | None = None, terms: str | None = None) -> DataFrame:
    """Blocks of annotated manuscripts (paths or globs), with section paths and terms where those files are given."""
    blk = nlp_json.blocks(spark, semantic)
    if toc:
        blk = nlp_json.with_toc(blk, nlp_json.toc(spark, toc))
    return nlp_json.with_terms(blk, nlp_json.terms(spark, terms)) if terms else blk


def analyse(blk: DataFrame, tok: DataFrame | None = None, ment: DataFrame | None = None, signals: DataFrame | None = None, lex: bundle.Lexicons | None = None) -> dict[str, DataFrame]:
    """One frame per dimension, keyed by doc_id, with their lists of findings. See bundle.measure()."""
    found = bundle.measure(segments.with_segments(blk), tok, ment, signals, lex=lex)
    if tok is not None:
        found |= {"top_words": words.top_words(tok), "phrases": words.repeated_phrases(tok), "adverbs": words.adverbs(tok), "adjectives": words.adjectives(tok)}
    if ment is not None:
        found |= {"characters": sections.characters(blk, ment), "entity_counts": words.entity_counts(ment), "top_entities": words.top_texts(ment)}
    if signals is not None:
        found |= {"top_noun_signals": words.top_texts(signals)}
    return found


def store(blk: DataFrame, found: dict[str, DataFrame], path: str) -> None:
    """Writes the fifteen dimensions of each document, by project and content hash; stored rows of the same content are replaced."""
    hashes = document_hashes(blk).join(blk.select("doc_id", "project_id").distinct(), "doc_id")
    rows = bundle.dimension_rows(found, hashes.select("doc_id", "hash")).join(hashes.select("doc_id", "project_id"), "doc_id")
    upsert(rows, path, "project_id", "input_hash")


def compare(tok: DataFrame, blk: DataFrame, k: int = 20) -> DataFrame:
    """The words with the highest counts in any project, by project."""
    projects = blk.select("project_id", "doc_id").distinct()
    counts = tok.join(projects, "doc_id").groupBy("project_id", F.lower("text").alias("term")).agg(F.count("*").alias("n"))
    return graph.compare_words(counts, k)


def reports(blk: DataFrame, tables: dict[str, tuple[DataFrame, list[str], str]]) -> DataFrame:
    """doc_id, markdown, html. tables: by title, the rows, their columns and the column that orders them."""
    made = [report.markdown_table(rows, title, columns, order) for title, (rows, columns, order) in tables.items()]
    return report.html_reports(report.markdown(F.col("doc_id"), made, blk))


def export_graph(ment: DataFrame, pairs: DataFrame, threads: DataFrame | None = None, turns: DataFrame | None = None, themes: DataFrame | None = None) -> DataFrame:
    """project_id, json of every project whose graph has no issue. All frames carry project_id; threads, turns and themes make its narratives."""
    node = graph.nodes(graph.entity_stats(ment))
    edge = graph.graph_edges(pairs, node)
    told = None if threads is None else graph.narratives(threads, node, turns, themes)
    bad = graph.validate(node, edge, told).select("project_id").distinct()
    return report.graph_json(node, edge, told).join(bad, "project_id", "left_anti")


def delete_project(rows: DataFrame, project_id: str) -> DataFrame:
    return without_project(rows, project_id)
