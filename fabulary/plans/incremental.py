"""Analysis of what has no result yet: an anti-join on content and dimension decides which plans are made.

A dimension that was added later is missing for every document, and its plan alone is made; a new document lacks all.
Documents are put together by the set of dimensions that they lack. There are few such sets - one for each change of
the library's dimensions, and one for new documents - and each is one run over its documents alone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabulary.operators import segments
from fabulary.operators.components import ensure_checkpoint_dir
from fabulary.plans import bundle
from fabulary.plans.library import Library
from fabulary.plans.store import document_hashes

#: Above so many sets the smallest are run together, with all that any of them lacks.
MOST_SETS = 8


def hashes_of(blk: DataFrame) -> DataFrame:
    """doc_id, project_id, hash of each document of a block table."""
    return document_hashes(blk).join(blk.groupBy("doc_id").agg(F.min("project_id").alias("project_id")), "doc_id").select("doc_id", "project_id", "hash")


def lacking(library: Library, blk: DataFrame, dimensions: Iterable[str]) -> DataFrame:
    """doc_id, project_id, hash, lacks: the sorted dimensions that a document has no result of. Documents that lack none have no row.

    Of documents of one project with one content the one with the smallest id stands for all, since they share their results.
    """
    gone = library.missing(hashes_of(blk), dimensions)
    one = gone.groupBy("project_id", "hash", "dimension").agg(F.min("doc_id").alias("doc_id"))
    return one.groupBy("doc_id", "project_id", "hash").agg(F.sort_array(F.collect_list("dimension")).alias("lacks"))


def sets_of(lacks: DataFrame) -> list[tuple[str, ...]]:
    """The distinct sets, the largest groups of documents first; past MOST_SETS they are joined into one."""
    found = [tuple(r["lacks"]) for r in lacks.groupBy("lacks").count().orderBy(F.desc("count"), "lacks").limit(MOST_SETS + 1).collect()]
    if len(found) <= MOST_SETS:
        return found
    every = lacks.select(F.explode("lacks").alias("d")).distinct().collect()
    return [*found[: MOST_SETS - 1], tuple(sorted(r["d"] for r in every))]


def fill(library: Library, blk: DataFrame, tok: DataFrame | None = None, ment: DataFrame | None = None, signals: DataFrame | None = None, lex: bundle.Lexicons | None = None, dimensions: Iterable[str] | None = None) -> dict[tuple[str, ...], int]:
    """Computes and stores what is missing. Returns the sets of dimensions that were planned, with the batch of each.

    Tokens, mentions and signals are those of the same blocks. What is stored already is neither read nor computed again.
    """
    names = [d for d, *_ in bundle.DIMENSIONS] if dimensions is None else list(dimensions)
    ensure_checkpoint_dir(blk.sparkSession)
    lacks = lacking(library, blk, names).checkpoint()  # the results change while this is read
    sets = sets_of(lacks)
    done: dict[tuple[str, ...], int] = {}
    for k, wanted in enumerate(sets):
        alone = F.col("lacks") == F.array(*[F.lit(d) for d in wanted])
        others = [F.col("lacks") == F.array(*[F.lit(d) for d in s]) for s in sets[:k]]
        mine = lacks.where(alone)
        if len(sets) == MOST_SETS and k == len(sets) - 1:  # the rest together
            mine = lacks
            for other in others:
                mine = mine.where(~other)
        own = lambda rows: None if rows is None else rows.join(mine.select("doc_id"), "doc_id", "left_semi")  # noqa: E731, B023
        seg = segments.with_segments(own(blk))
        found = bundle.measure(seg, own(tok), own(ment), own(signals), lex=lex, only=wanted)
        rows = bundle.dimension_rows(found, mine.select("doc_id", "hash"), wanted).join(mine.select("doc_id", "project_id", "lacks"), "doc_id")
        done[wanted] = library.save_results(rows.where(F.array_contains("lacks", F.col("dimension"))))
    return done


def stored(library: Library, blk: DataFrame) -> DataFrame:
    """doc_id, dimension, tier, score, data of every document of blk, from the results of its content."""
    return hashes_of(blk).join(library.results().withColumnRenamed("input_hash", "hash"), ["hash", "project_id"]).select("doc_id", "project_id", "dimension", "tier", "score", "data")
