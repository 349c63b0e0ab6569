"""The shared axis of all curves: top-level sections, or tenths of a document with fewer than three of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions.text import let, top_level_section

MIN_SECTIONS, CHUNKS = 3, 10


def _placed(idx: Column, n_blocks: Column, rank: Column, n_top: Column, top: Column) -> dict[str, Column]:
    """seg, label, n_segments and chunked of a block: the rank of its top section, or the tenth it lies in."""
    chunk = F.least(F.floor(idx / F.ceil(n_blocks / F.lit(float(CHUNKS)))), F.lit(CHUNKS - 1)).cast("int")
    chunked = n_top < MIN_SECTIONS
    return {
        "chunked": chunked,
        "seg": F.when(chunked, chunk).otherwise(rank).cast("int"),
        "label": F.when(chunked, F.concat((chunk + 1).cast("string"), F.lit(f"/{CHUNKS}"))).otherwise(top),
        "n_segments": F.when(chunked, F.lit(CHUNKS)).otherwise(n_top).cast("int"),
    }


def with_segments(blk: DataFrame) -> DataFrame:
    """blk with idx (place in its document), n_blocks, seg, label, n_segments and chunked. All windows share one shuffle by document."""
    doc, order = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("seq")
    ranked = (
        blk.withColumn("top", top_level_section(F.col("section_path")))
        .withColumn("idx", F.row_number().over(order) - 1)
        .withColumn("n_blocks", F.count("*").over(doc))
        .withColumn("first_seq", F.min("seq").over(Window.partitionBy("doc_id", "top")))
        .withColumn("rank", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first_seq")) - 1)
        .withColumn("n_top", F.max("rank").over(doc) + 1)
    )
    return ranked.withColumns(_placed(*[F.col(c) for c in ("idx", "n_blocks", "rank", "n_top", "top")])).drop("first_seq", "rank", "n_top", "top")


def numbered(blocks: Column) -> Column:
    """The same columns as fields of each struct of an array that holds one document's blocks in order: no shuffle, no window."""
    top = lambda b: top_level_section(b["section_path"])

    def all_of(bs: Column, tops: Column) -> Column:
        def one(b: Column, idx: Column) -> Column:
            made = _placed(idx, F.size(bs), F.array_position(tops, top(b)) - 1, F.size(tops), top(b))
            for name, value in {"idx": idx, "n_blocks": F.size(bs), **made}.items():
                b = b.withField(name, value)
            return b

        return F.transform(bs, one)

    return let(blocks, lambda bs: let(F.array_distinct(F.transform(bs, top)), lambda tops: all_of(bs, tops)))


def segment_table(seg: DataFrame) -> DataFrame:
    """doc_id, seg, label, n_segments, chunked: every segment of every document, also those that hold no block."""
    docs = seg.groupBy("doc_id").agg(F.max("n_segments").alias("n_segments"), F.max("chunked").alias("chunked"), F.map_from_entries(F.collect_set(F.struct("seg", "label"))).alias("labels"))
    dense = docs.withColumn("seg", F.explode(F.sequence(F.lit(0), F.col("n_segments") - 1)))
    return dense.select("doc_id", "seg", F.coalesce(F.col("labels")[F.col("seg")], F.concat((F.col("seg") + 1).cast("string"), F.lit(f"/{CHUNKS}"))).alias("label"), "n_segments", "chunked")


def by_segment(seg: DataFrame, *sums: Column) -> DataFrame:
    """One row per segment that holds a block, with the aggregates and its place on the axis, in one pass over the blocks."""
    return seg.groupBy("doc_id", "seg").agg(F.max("label").alias("label"), F.max("n_segments").alias("n_segments"), F.max("chunked").alias("chunked"), *sums)


def densely(points: DataFrame, *zeros: str) -> DataFrame:
    """by_segment's rows and the tenths that hold no block; the named columns are 0 where a segment has none, the others null.

    A document's points (its sections, or ten) meet in one array, so neither a second pass over the blocks nor a join is needed.
    """
    own = [f for f in points.schema.fields if f.name not in ("doc_id", "n_segments", "chunked")]
    value = lambda f: F.coalesce(f.name, F.lit(0)).cast(f.dataType) if f.name in zeros else F.col(f.name)
    docs = points.groupBy("doc_id").agg(F.max("n_segments").alias("n_segments"), F.max("chunked").alias("chunked"), F.collect_list(F.struct(*[value(f).alias(f.name) for f in own])).alias("points"))

    def empty(i: Column) -> Column:
        known = {"seg": i, "label": F.concat((i + 1).cast("string"), F.lit(f"/{CHUNKS}"))}
        return F.struct(*[known.get(f.name, F.lit(0 if f.name in zeros else None)).cast(f.dataType).alias(f.name) for f in own])

    gaps = F.array_except(F.sequence(F.lit(0), F.col("n_segments") - 1), F.col("points.seg"))
    return docs.select("doc_id", "n_segments", "chunked", F.inline(F.concat("points", F.transform(gaps, empty))))


def runs(rows: DataFrame, flag: str, order: str = "seg") -> DataFrame:
    """Islands: maximal runs of consecutive rows of a document for which the flag holds, with `run` numbering them."""
    doc = Window.partitionBy("doc_id").orderBy(order)
    on = rows.withColumn("_all", F.row_number().over(doc)).where(flag)
    return on.withColumn("run", F.col("_all") - F.row_number().over(doc)).drop("_all")
