"""Knowledge graph: entity registry, nodes, edges, narratives and the checks before export; comparison of projects."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions.text import identity_key, stable_id

# Fixed values.
GOLDEN_ANGLE = math.pi * (3.0 - math.sqrt(5.0))
ALTITUDE = (13.0, 26.0)
#: Distance from the centre at which each kind of narrative stands.
SHELLS = {"tethered_balloon": 14.0, "cloud": 15.5, "free_balloon": 17.0, "tornado": 19.0, "rain_band": 21.0, "satellite": 23.5}
VERSION = "1.0"


def entity_stats(ment: DataFrame) -> DataFrame:
    """ment: project_id, text, category[, confidence]. Entities by identity: mentions, and the busiest spelling (ties by text)."""
    by = ment.groupBy("project_id", "category", "text").agg(F.count("*").alias("n")).withColumn("stable_id", stable_id(F.col("category"), F.col("text")))
    return by.groupBy("project_id", "stable_id", "category").agg(F.sum("n").alias("mentions"), F.min_by("text", F.struct(-F.col("n"), "text")).alias("text"))


def register(known: DataFrame, ment: DataFrame) -> DataFrame:
    """Registry rows (stable_id, category, key) that aren't known yet."""
    rows = ment.select(stable_id(F.col("category"), F.col("text")).alias("stable_id"), "category", identity_key(F.col("text")).alias("key")).distinct()
    return rows.join(known, "stable_id", "left_anti")


def nodes(stats: DataFrame, *more: DataFrame) -> DataFrame:
    """project_id, id, label, layer, type, weight. stats: entity_stats; more: frames of the same columns; the first of equal labels stays."""
    most = F.max("mentions").over(Window.partitionBy("project_id"))
    base = stats.select("project_id", F.col("stable_id").alias("id"), F.col("text").alias("label"), F.lit(1).alias("layer"), F.col("category").alias("type"), F.least(0.1 + 0.9 * (F.col("mentions") / most), F.lit(1.0)).alias("weight"), F.lit(0).alias("branch"))
    for n, frame in enumerate(more, 1):
        base = base.unionByName(frame.withColumn("branch", F.lit(n)))
    order = Window.partitionBy("project_id", identity_key(F.col("label"))).orderBy("branch", F.desc("weight"), "id")
    return base.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth", "branch")


def graph_edges(pairs: DataFrame, node: DataFrame) -> DataFrame:
    """pairs: project_id, a, b, n. Edges whose ends both exist, with a strength of n over the largest n."""
    ends = node.select("project_id", identity_key(F.col("label")).alias("k"), "id")
    left, right = ends.toDF("project_id", "ka", "source"), ends.toDF("project_id", "kb", "target")
    keyed = pairs.withColumn("ka", identity_key(F.col("a"))).withColumn("kb", identity_key(F.col("b")))
    met = keyed.join(left, ["project_id", "ka"]).join(right, ["project_id", "kb"]).where("source <> target")
    strength = F.col("n") / F.max("n").over(Window.partitionBy("project_id"))
    ident = F.concat(F.lit("edge:"), F.substring(F.sha2(F.concat_ws("|", F.least("source", "target"), F.greatest("source", "target")), 256), 1, 16))
    return met.select("project_id", ident.alias("id"), "source", "target", strength.alias("strength"))


def _marked(prefix: str, name: str) -> Column:
    return F.concat(F.lit("nrr:"), F.substring(F.sha2(F.concat(F.lit(prefix + "\x1f"), identity_key(F.col(name))), 256), 1, 16))


def narratives(threads: DataFrame, node: DataFrame, turns: DataFrame | None = None, themes: DataFrame | None = None) -> DataFrame:
    """project_id, id, label, type, x, y, z, stability, links: what stands in the sky above a project's graph.

    threads: project_id, subject, shape, is_main, coverage, rank; those that are neither main nor have a telling shape are
    left out. turns: project_id, section, change, appeared (names), rank. themes: project_id, term, coverage, rank;
    only those that a node bears. Kinds stand on shells of their own, in the order threads, turns, themes, each on the
    golden angle behind the one before; links are the nodes of the names.
    """
    c = F.col
    kind = (
        F.when(c("is_main") & (c("shape") == "sustained"), "rain_band").when(c("is_main"), "tethered_balloon")
        .when(c("shape").isin("intermittent", "burst", "late_arrival"), "satellite").when(c("shape") == "setup_only", "free_balloon")
    )
    rows = threads.select("project_id", F.lit(0).alias("part"), "rank", _marked("plot", "subject").alias("id"), c("subject").alias("label"), kind.alias("type"), c("coverage").alias("stability"), F.array("subject").alias("names")).where("type is not null")
    if turns is not None:
        rows = rows.unionByName(turns.select("project_id", F.lit(1).alias("part"), "rank", _marked("turn", "section").alias("id"), c("section").alias("label"), F.lit("tornado").alias("type"), (1.0 - c("change")).alias("stability"), c("appeared").alias("names")))
    if themes is not None:
        borne = themes.withColumn("_k", identity_key(c("term"))).join(node.select("project_id", identity_key(c("label")).alias("_k")).distinct(), ["project_id", "_k"], "left_semi")
        rows = rows.unionByName(borne.select("project_id", F.lit(2).alias("part"), "rank", _marked("cloud", "term").alias("id"), c("term").alias("label"), F.lit("cloud").alias("type"), c("coverage").alias("stability"), F.array("term").alias("names")))
    nth = F.row_number().over(Window.partitionBy("project_id").orderBy("part", "rank", "label")) - 1
    placed = rows.withColumn("nth", nth)
    named = placed.select("project_id", "nth", F.posexplode("names").alias("at", "name")).withColumn("_k", identity_key(c("name")))
    met = named.join(node.select("project_id", identity_key(c("label")).alias("_k"), c("id").alias("_node")), ["project_id", "_k"])
    links = met.groupBy("project_id", "nth").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "_node"))), lambda x: x["_node"]).alias("links"))
    radius = F.element_at(F.create_map(*[F.lit(x) for kv in SHELLS.items() for x in kv]), c("type"))
    polar, turn = 0.7 + 0.15 * F.pmod(c("nth"), F.lit(4)), c("nth") * GOLDEN_ANGLE
    place = [(radius * F.sin(polar) * F.cos(turn)).alias("x"), (radius * F.cos(polar)).alias("y"), (radius * F.sin(polar) * F.sin(turn)).alias("z")]
    clamped = F.least(F.greatest(c("stability"), F.lit(0.0)), F.lit(1.0)).alias("stability")
    none = F.array().cast("array<string>")
    return placed.join(links, ["project_id", "nth"], "left").select("project_id", "nth", "id", "label", "type", *place, clamped, F.coalesce("links", none).alias("links"))


def validate(node: DataFrame, edge: DataFrame, narrative: DataFrame | None = None, project: DataFrame | None = None) -> DataFrame:
    """project_id, issue, id: what must not be exported. An empty result is a valid graph. project: project_id, version, name."""
    twice = lambda rows, what: rows.groupBy("project_id", "id").count().where("count > 1").select("project_id", F.lit(f"duplicate_{what}").alias("issue"), "id")
    told = lambda rows, issue: rows.select("project_id", F.lit(issue).alias("issue"), "id")
    ids = node.select("project_id", F.col("id").alias("end")).distinct()
    ends = edge.select("project_id", "id", F.explode(F.array("source", "target")).alias("end"))
    found = (
        twice(node, "node")
        .unionByName(twice(edge, "edge"))
        .unionByName(told(node.where(~F.col("layer").between(1, 5)), "layer"))
        .unionByName(told(node.where(~F.col("weight").between(0, 1)), "weight"))
        .unionByName(told(edge.where(~F.col("strength").between(0, 1)), "strength"))
        .unionByName(told(ends.join(ids, ["project_id", "end"], "left_anti"), "missing_end").distinct())
    )
    if narrative is not None:
        far = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
        linked = narrative.select("project_id", "id", F.explode("links").alias("end"))
        found = (
            found.unionByName(twice(narrative, "narrative"))
            .unionByName(told(narrative.where(~F.coalesce(far.between(*ALTITUDE), F.lit(False))), "altitude"))
            .unionByName(told(narrative.where(~F.col("stability").between(0, 1)), "stability"))
            .unionByName(told(linked.join(ids, ["project_id", "end"], "left_anti"), "dangling_link").distinct())
        )
    if project is not None:
        keyed = project.withColumn("id", F.col("project_id"))
        found = found.unionByName(told(keyed.where(~F.coalesce(F.col("version") == VERSION, F.lit(False))), "version")).unionByName(told(keyed.where(F.coalesce(F.trim("name"), F.lit("")) == ""), "name"))
    return found


def compare_words(counts: DataFrame, k: int = 20) -> DataFrame:
    """counts: project_id, term, n. The words with the highest count in any project, with a map of all projects' counts."""
    d = counts.groupBy("term").agg(F.max("n").alias("max_n"), F.count("*").alias("n_projects"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("project_id", "n")))).alias("by_project"))
    return d.orderBy(F.desc("max_n"), "term").limit(k)


def character_graph(people: DataFrame, partner: DataFrame, n: int = 12) -> DataFrame:
    """Edges among the leading characters: pairs once, with the larger weight. people: ranked; partner: doc_id, name, partner, n."""
    top = people.where(F.col("rank") <= n).select("doc_id", "name")
    kept = partner.join(top, ["doc_id", "name"], "left_semi").join(top.withColumnRenamed("name", "partner"), ["doc_id", "partner"], "left_semi")
    return kept.groupBy("doc_id", F.least("name", "partner").alias("a"), F.greatest("name", "partner").alias("b")).agg(F.max("n").alias("weight"))
