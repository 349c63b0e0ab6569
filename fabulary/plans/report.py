"""Reports: Markdown and HTML per document, and the graph as JSON."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a table that a report shows; the rest is counted.
SHOWN = 20


def markdown_table(rows: DataFrame, title: str, columns: list[str], order: str = "rank", key: str = "doc_id") -> DataFrame:
    """One Markdown section per document: a heading, a table of the first rows, and how many were left out."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("—")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order, *columns)))
    made = numbered.withColumn("_line", line).groupBy(key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("_n") <= SHOWN, F.struct("_n", "_line")))).alias("l"))
    head = f"## {title}\n\n| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    rest = F.when(F.col("n") > SHOWN, F.concat(F.lit("\n\n*"), (F.col("n") - SHOWN).cast("string"), F.lit(" more*"))).otherwise("")
    return made.select(key, F.lit(title).alias("section"), F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["_line"]), "\n"), rest).alias("body"))


def markdown(title: Column, sections: list[DataFrame], docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, markdown: the sections of each document in the given order. The same input gives the same bytes."""
    parts = None
    for nth, section in enumerate(sections):
        part = section.select(key, F.lit(nth).alias("nth"), "body")
        parts = part if parts is None else parts.unionByName(part)
    body = parts.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "body"))), lambda x: x["body"]), "\n\n").alias("body"))
    return docs.select(key, title.alias("_title")).distinct().join(body, key, "left").select(key, F.concat(F.lit("# "), F.col("_title").cast("string"), F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n")).alias("markdown"))


def _inline(text: str) -> str:
    text = html.escape(text)
    text = re.sub(r"`([^`]+)`", r"<code>\1</code>", text)
    text = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", text)
    return re.sub(r"\*([^*]+)\*", r"<em>\1</em>", text)


def to_html(text: str, title: str = "") -> str:
    """The Markdown that reports use: headings, lists, pipe tables, rules, paragraphs and emphasis. Everything else is escaped."""
    out: list[str] = []
    for block in re.split(r"\n{2,}", text.strip()):
        lines = block.split("\n")
        if m := re.fullmatch(r"(#{1,3}) (.*)", lines[0]):
            out.append(f"<h{len(m[1])}>{_inline(m[2])}</h{len(m[1])}>")
            lines = lines[1:]
        if not lines:
            continue
        if all(x.startswith("|") for x in lines):
            rows = [[c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", x.strip()[1:-1])] for x in lines]
            head = len(rows) > 1 and all(re.fullmatch(r":?-{3,}:?", c) for c in rows[1])
            tag = lambda row, t: "<tr>" + "".join(f"<{t}>{_inline(c)}</{t}>" for c in row) + "</tr>"
            out.append("<table>" + "".join([tag(rows[0], "th"), *[tag(r, "td") for r in rows[2:]]] if head else [tag(r, "td") for r in rows]) + "</table>")
        elif all(re.match(r"[-*] ", x) for x in lines):
            out.append("<ul>" + "".join(f"<li>{_inline(x[2:])}</li>" for x in lines) + "</ul>")
        elif re.fullmatch(r"-{3,}|\*{3,}", block):
            out.append("<hr>")
        else:
            out.append("<p>" + _inline(" ".join(lines)) + "</p>")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body>' + "".join(out) + "</body></html>\n"


def html_reports(reports: DataFrame) -> DataFrame:
    """reports (doc_id, markdown) with `html`."""

    @F.arrow_udf("string")
    def render(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([to_html(x or "") for x in batch.to_pylist()], pa.string())

    return reports.withColumn("html", render("markdown"))


def graph_json(node: DataFrame, edge: DataFrame, narrative: DataFrame | None = None) -> DataFrame:
    """project_id, json: nodes, edges and narratives of each project in a fixed order."""
    n = node.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("id", "label", "layer", "type", "weight"))).alias("nodes"))
    e = edge.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("id", "source", "target", "strength"))).alias("edges"))
    rows, parts = n.join(e, "project_id", "left"), ["nodes", "edges"]
    if narrative is not None:
        position = F.struct("x", "y", "z").alias("position")
        told = F.transform(F.array_sort(F.collect_list(F.struct("nth", "id", "label", "type", position, "stability", "links"))), lambda t: t.dropFields("nth"))
        rows, parts = rows.join(narrative.groupBy("project_id").agg(told.alias("narratives")), "project_id", "left"), [*parts, "narratives"]
    return rows.select("project_id", F.to_json(F.struct(F.lit("1.0").alias("version"), F.col("project_id").alias("name"), *parts), {"pretty": "true"}).alias("json"))
