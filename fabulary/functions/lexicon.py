"""Multi-pattern scans: patterns with alternatives become one regular expression, tried longest first."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_VARIANTS, CONTEXT = 16, 24
OPENING = ("“", "「", "『", '"')


def expand(pattern: str, most: int = MOST_VARIANTS) -> list[str]:
    """Variants of a pattern with groups `(a|b)` and optional groups `(a|b)?`, longest first."""
    pieces = [p for p in re.split(r"(\([^)]*\)\??)", pattern) if p]
    made = [""]
    for piece in pieces:
        options = [piece]
        if piece.startswith("("):
            options = piece.strip("()?").split("|") if piece.endswith(")") else [*piece[1:-2].split("|"), ""]
        made = [a + b for a, b in product(made, options)][:most]
    return sorted({v for v in made if v}, key=lambda v: (-len(v), v))


def variants(patterns: Sequence[str]) -> list[tuple[str, int]]:
    """(variant, pattern) in the order in which a scan tries them; of equal variants the first pattern has it."""
    found: dict[str, int] = {}
    for nth, pattern in enumerate(patterns):
        for variant in expand(pattern):
            found.setdefault(variant, nth)
    return sorted(found.items(), key=lambda x: (-len(x[0]), x[1], x[0]))


def occurrences(text: Column, patterns: Sequence[str]) -> Column:
    """ARRAY<STRUCT<start, matched, in_dialogue, excerpt>>: leftmost-longest matches that do not overlap, in code points."""
    either = "|".join(re.escape(v) for v, _ in variants(patterns))
    found = F.regexp_extract_all(text, F.lit(f"(?:{either})"), F.lit(0))
    gaps = F.slice(F.split(text, either, -1), F.lit(1), F.size(found))
    kind = "array<struct<start:int,matched:string>>"

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        one = F.array(F.struct(start.alias("start"), pair["matched"].alias("matched")))
        return F.struct((start + F.length(pair["matched"])).alias("at"), F.concat(state["found"], one).alias("found"))

    placed = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), found.alias("matched")),
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found")),
        step,
        lambda s: s["found"],
    )

    def whole(m: Column) -> Column:
        start, size = m["start"], F.length(m["matched"])
        return F.struct(start.alias("start"), m["matched"].alias("matched"), _in_dialogue(text, start).alias("in_dialogue"), _excerpt(text, start, size).alias("excerpt"))

    return F.when(text.rlike(either), F.transform(placed, whole)).otherwise(F.array().cast("array<struct<start:int,matched:string,in_dialogue:boolean,excerpt:string>>"))


def hits(blocks: DataFrame, patterns: Sequence[tuple], key: tuple[str, ...] = ("doc_id", "seq")) -> DataFrame:
    """blocks exploded to their matches, with the pattern and what the lexicon says of it. patterns: (pattern, category[, tier]).

    Places and quotation are running values over the matches of a block. What a query doesn't ask for is pruned; without
    the excerpt the text doesn't go along with each match.
    """
    tried = variants([p[0] for p in patterns])
    rows = [(v, n, patterns[n][0], patterns[n][1], patterns[n][2] if len(patterns[n]) > 2 else None) for v, n in tried]
    known = blocks.sparkSession.createDataFrame(rows, "matched string, pattern_idx int, pattern string, category string, tier string")
    either, text, c = "|".join(re.escape(v) for v, _ in tried), F.col("content"), F.col
    found = F.regexp_extract_all(text, F.lit(f"(?:{either})"), F.lit(0))
    gaps = F.slice(F.split(text, either, -1), F.lit(1), F.size(found))
    each = blocks.where(text.rlike(either)).select("*", F.posexplode(F.arrays_zip(gaps.alias("gap"), found.alias("matched"))).alias("_nth", "_m"))
    each = each.select(
        *blocks.columns, "_nth", c("_m.matched").alias("matched"), (F.length("_m.gap") + F.length("_m.matched")).alias("_size"),
        _last_mark(F.concat("_m.gap", F.substring("_m.matched", 1, 1))).alias("_own"), _last_mark(F.concat("_m.gap", "_m.matched")).alias("_mark"),
    )
    order = Window.partitionBy(*key).orderBy("_nth")
    before = F.last("_mark", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = each.withColumn("start", (F.sum("_size").over(order) - F.length("matched")).cast("int")).withColumn("in_dialogue", F.coalesce(F.coalesce("_own", before).isin(*OPENING), F.lit(False)))
    # The lexicon's size is fixed: a few variants for each pattern.
    return placed.drop("_nth", "_size", "_own", "_mark").withColumn("excerpt", _excerpt(text, c("start"), F.length("matched"))).join(F.broadcast(known), "matched")


def _last_mark(text: Column) -> Column:
    """The last quotation mark in a text, null without one."""
    return F.nullif(F.regexp_extract(text, '(?s)^.*([“”「」『』"])', 1), F.lit(""))


def _in_dialogue(text: Column, start: Column) -> Column:
    """Whether the last quotation mark up to the place opens."""
    return F.regexp_extract(F.substring(text, F.lit(1), start + 1), '([“”「」『』"])[^“”「」『』"]*$', 1).isin(*OPENING)


def _excerpt(text: Column, start: Column, size: Column) -> Column:
    first = F.greatest(start - CONTEXT, F.lit(0))
    last = F.least(start + size + CONTEXT, F.length(text))
    return F.concat(F.when(first > 0, "…").otherwise(""), F.substring(text, first + 1, last - first), F.when(last < F.length(text), "…").otherwise(""))
