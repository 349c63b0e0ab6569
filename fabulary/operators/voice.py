"""Voice: rhythm, marks, function words, pronouns and stance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabulary.functions.lexicons import ASSERTIVE, FUNCTION_GROUPS, HEDGING, MARKS, PERSONS, PRONOUN_BLOCK_BEFORE
from fabulary.functions.text import TERMINATORS, class_chars, clauses, count_term, count_terms, ratio, round_half_up, sentence_lengths, sentences, visible_chars
from fabulary.operators.segments import by_segment, densely

# Fixed values.
STANCE_RATE, STANCE_LEAD = 6.0, 1.5


def characters(blk: DataFrame) -> DataFrame:
    return blk.groupBy("doc_id").agg(F.sum(visible_chars(F.col("content"))).alias("char_count"))


def rhythm(blk: DataFrame, terminators: str = TERMINATORS) -> DataFrame:
    """Sentence, clause and paragraph measures. The deviation is taken about the rounded mean."""
    said = sentences(F.col("content"), terminators)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    rows = blk.select("doc_id", sentence_lengths(F.col("content"), terminators).alias("l"), total(F.transform(said, clauses)).alias("clauses"), visible_chars(F.col("content")).alias("chars"))
    d = rows.groupBy("doc_id").agg(
        F.sum("chars").alias("char_count"),
        F.count("*").alias("paragraph_count"),
        F.sum(F.size("l")).alias("sentence_count"),
        F.sum(total(F.col("l"))).alias("length_sum"),
        F.sum(total(F.transform("l", lambda x: (x * x).cast("long")))).alias("length_squares"),
        F.min(F.array_min("l")).alias("shortest_sentence"),
        F.max(F.array_max("l")).alias("longest_sentence"),
        F.sum("clauses").alias("clause_count"),
        F.sum((F.size("l") == 1).cast("int")).alias("single_sentence_paragraphs"),
    )
    n, mean = F.col("sentence_count"), round_half_up(ratio(F.col("length_sum"), F.col("sentence_count")), 1)
    spread = ratio(F.col("length_squares") - 2 * mean * F.col("length_sum") + mean * mean * n, n)
    d = d.withColumn("avg_sentence_chars", mean).withColumn("sentence_stdev", round_half_up(F.sqrt(F.greatest(spread, F.lit(0.0))), 1))
    d = d.withColumn("sentence_cv", round_half_up(ratio(F.col("sentence_stdev"), F.col("avg_sentence_chars")), 2))
    d = d.withColumn("clauses_per_sentence", round_half_up(ratio(F.col("clause_count"), n), 2)).withColumn("avg_paragraph_chars", round_half_up(ratio(F.col("char_count"), F.col("paragraph_count")), 1))
    return d.drop("length_sum", "length_squares")


def curve(seg: DataFrame, terminators: str = TERMINATORS) -> DataFrame:
    """One point per segment: characters, sentences, mean sentence length and clauses per sentence."""
    text, total = F.col("content"), lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    lengths, parts = sentence_lengths(text, terminators), F.transform(sentences(text, terminators), clauses)
    sums = {"char_count": visible_chars(text), "sentence_count": F.size(lengths), "sentence_chars": total(lengths), "clause_count": total(parts)}
    points = densely(by_segment(seg, *[F.sum(v).alias(k) for k, v in sums.items()]), *sums)
    mean = lambda part, digits: round_half_up(ratio(F.col(part), F.col("sentence_count")), digits)
    return points.withColumn("avg_sentence_chars", mean("sentence_chars", 1)).withColumn("clauses_per_sentence", mean("clause_count", 2))


def marks(blk: DataFrame, known: list[tuple[str, str]] = MARKS) -> DataFrame:
    """doc_id, mark, n, per_1000 for every mark, in one pass over the text."""
    counts = [F.sum(count_term(F.col("content"), m)).alias(f"m{i}") for i, (m, _) in enumerate(known)]
    d = blk.groupBy("doc_id").agg(F.sum(visible_chars(F.col("content"))).alias("chars"), *counts)
    each = F.array(*[F.struct(F.lit(m).alias("mark"), F.col(f"m{i}").alias("n")) for i, (m, _) in enumerate(known)])
    return d.select("doc_id", "chars", F.explode(each).alias("x")).select("doc_id", "x.mark", "x.n", round_half_up(ratio(F.col("x.n"), F.col("chars"), 1000.0), 2).alias("per_1000"))


def function_words(blk: DataFrame, groups: list[tuple[str, str]] = FUNCTION_GROUPS) -> DataFrame:
    """doc_id, group, n, per_1000."""
    d = blk.groupBy("doc_id").agg(F.sum(visible_chars(F.col("content"))).alias("chars"), *[F.sum(class_chars(F.col("content"), c)).alias(f"g{i}") for i, (_, c) in enumerate(groups)])
    each = F.array(*[F.struct(F.lit(g).alias("group"), F.col(f"g{i}").alias("n")) for i, (g, _) in enumerate(groups)])
    return d.select("doc_id", "chars", F.explode(each).alias("x")).select("doc_id", "x.group", "x.n", round_half_up(ratio(F.col("x.n"), F.col("chars"), 1000.0), 2).alias("per_1000"))


def pronouns(blk: DataFrame, persons: dict[str, str] = PERSONS, blocked: str = PRONOUN_BLOCK_BEFORE) -> DataFrame:
    """Pronouns by person; one behind a blocking character is part of a word. Latin sets are given as whole-word patterns."""
    pattern = lambda c: f"(?<![{blocked}])[{c}]" if len(c) < 8 and not c.isascii() else rf"(?i)\b(?:{c})\b"
    d = blk.groupBy("doc_id").agg(*[F.sum(F.regexp_count("content", F.lit(pattern(c)))).alias(p) for p, c in persons.items()])
    total = sum((F.col(p) for p in persons), F.lit(0))
    return d.withColumn("total", total).select("doc_id", *persons, "total", *[round_half_up(ratio(F.col(p), F.col("total")), 3).alias(f"{p}_share") for p in persons])


def stance(blk: DataFrame, hedging: list[str] = HEDGING, assertive: list[str] = ASSERTIVE) -> DataFrame:
    """Words that hold back and words that assert, per ten thousand characters, and which prevail."""
    text = F.col("content")
    d = blk.groupBy("doc_id").agg(F.sum(visible_chars(text)).alias("chars"), F.sum(count_terms(text, hedging)).alias("hedging"), F.sum(count_terms(text, assertive)).alias("assertive"))
    h, a = (round_half_up(ratio(F.col(c), F.col("chars"), 10000.0), 2) for c in ("hedging", "assertive"))
    verdict = F.when((h >= STANCE_RATE) & (h > a * STANCE_LEAD), "hedging").when((a >= STANCE_RATE) & (a > h * STANCE_LEAD), "assertive").otherwise("balanced")
    return d.select("doc_id", "hedging", "assertive", h.alias("hedging_per_10k"), a.alias("assertive_per_10k"), verdict.alias("verdict"))
