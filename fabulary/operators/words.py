"""T0: word, sentence and phrase statistics of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions.lexicons import ADVERB_STOP_WORDS, PHRASE_STOP_POS
from fabulary.functions.text import BUCKETS, TERMINATORS, cjk_chars, class_chars, clamp, ratio, sentence_bucket, sentence_lengths, sentences, syllables, visible_chars

# Fixed values.
TOP, TOP_PHRASES, MIN_PHRASE = 50, 30, 5
ADVERB_POS, ADJECTIVE_POS = ("AD", "DEG", "AS"), ("JJ", "VA")


def top_k(counts: DataFrame, k: int, value: str = "n", *ties: str, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The k highest rows of each group, ties by the named columns ascending, with `rank`."""
    order = Window.partitionBy(*by).orderBy(F.desc(value), *ties)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def totals(blk: DataFrame) -> DataFrame:
    """Blocks, bytes, and bytes per block of each document."""
    made = blk.groupBy("doc_id").agg(F.count("*").alias("block_count"), F.sum(F.octet_length("content")).alias("byte_count"))
    return made.withColumn("avg_block_length", ratio(F.col("byte_count"), F.col("block_count")))


def sentence_rows(blk: DataFrame, terminators: str = TERMINATORS) -> DataFrame:
    """One row per sentence with its visible characters."""
    each = blk.select(*[c for c in ("doc_id", "seq", "seg") if c in blk.columns], F.posexplode(sentences(F.col("content"), terminators)).alias("nth", "sentence"))
    return each.withColumn("chars", visible_chars(F.col("sentence")))


def sentence_stats(blk: DataFrame, terminators: str = TERMINATORS) -> DataFrame:
    """Sentence count, mean length, and the four length buckets of each document; all in one pass, without a row per sentence."""
    rows = blk.select("doc_id", sentence_lengths(F.col("content"), terminators).alias("l"))
    in_bucket = lambda b: F.sum(F.size(F.filter("l", lambda x: sentence_bucket(x) == b)))
    names = dict(zip(BUCKETS, ("upto_20", "upto_50", "upto_100", "above_100")))
    made = rows.groupBy("doc_id").agg(
        F.sum(F.size("l")).alias("sentence_count"),
        F.sum(F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x)).alias("sentence_chars"),
        *[in_bucket(b).alias(n) for b, n in names.items()],
    )
    return made.withColumn("avg_sentence_chars", ratio(F.col("sentence_chars"), F.col("sentence_count")))


def readability(blk: DataFrame, terminators: str = TERMINATORS) -> DataFrame:
    """score, level and method of each document: by sentence length for Chinese, Flesch reading ease for Latin text. One aggregate."""
    text = F.col("content")
    per_block = blk.select(
        "doc_id",
        cjk_chars(text).alias("cjk"),
        class_chars(text, "A-Za-z").alias("latin"),
        sentence_lengths(text, terminators).alias("l"),
        F.regexp_count(text, F.lit("[A-Za-z]+")).alias("words"),
        syllables(text).alias("syllables"),
    )
    sums = [F.sum(c).alias(c) for c in ("cjk", "latin", "words", "syllables")]
    chars = F.sum(F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x))
    d = per_block.groupBy("doc_id").agg(*sums, F.sum(F.size("l")).alias("sentences"), chars.alias("sentence_chars"))
    by_length = clamp(100.0 - F.greatest(ratio(F.col("sentence_chars"), F.col("sentences")) - 25.0, F.lit(0.0)) * 2.0, 0.0, 100.0)
    flesch = clamp(206.835 - 1.015 * F.greatest(F.col("words"), F.lit(1)) / F.col("sentences") - 84.6 * F.col("syllables") / F.greatest(F.col("words"), F.lit(1)), 0.0, 100.0)
    nothing = F.col("sentences") == 0
    method = F.when(nothing, "none").when(F.col("cjk") >= F.col("latin"), "cjk-sentence-length").otherwise("flesch")
    score = F.when(nothing, 0.0).when(F.col("cjk") >= F.col("latin"), by_length).otherwise(flesch)
    level = F.when(nothing, "无文本").when(score >= 80, "易读").when(score >= 60, "适中").when(score >= 40, "偏难").otherwise("困难")
    return d.select("doc_id", score.alias("score"), level.alias("level"), method.alias("method"))


def word_counts(tok: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id, term, n: words, lower case."""
    return tok.groupBy("doc_id", (F.lower("text") if key is None else key).alias("term")).agg(F.count("*").alias("n"))


def top_words(tok: DataFrame, k: int = TOP) -> DataFrame:
    return top_k(word_counts(tok), k, "n", "term")


def entity_counts(ment: DataFrame) -> DataFrame:
    """doc_id, category, n, the most frequent category first."""
    return top_k(ment.groupBy("doc_id", "category").agg(F.count("*").alias("n")), TOP, "n", "category")


def top_texts(found: DataFrame, k: int = TOP) -> DataFrame:
    """The most frequent texts of mentions or noun signals, as they are spelt."""
    return top_k(word_counts(found, F.col("text")), k, "n", "term")


def signal_totals(signals: DataFrame) -> DataFrame:
    return signals.groupBy("doc_id").agg(F.count("*").alias("noun_signal_count"))


def average_words(blk: DataFrame, tok: DataFrame) -> DataFrame:
    """word_count and avg_sentence_length, which is words per block whatever its name."""
    size, said = (rows.groupBy("doc_id").agg(F.count("*").alias(name)) for rows, name in ((blk, "block_count"), (tok, "word_count")))
    d = size.join(said, "doc_id", "left").fillna(0, ["word_count"])
    return d.withColumn("avg_sentence_length", ratio(F.col("word_count"), F.col("block_count")))


def tagged_words(tok: DataFrame, tags: tuple[str, ...], stop: list[str] | None = None, k: int = TOP) -> DataFrame:
    """Top words of some tags: adverbs with ADVERB_POS and ADVERB_STOP_WORDS, adjectives with ADJECTIVE_POS."""
    kept = tok.where(F.col("pos").isin(*tags))
    return top_k(word_counts(kept.where(~F.col("text").isin(stop)) if stop else kept, F.col("text")), k, "n", "term")


def adverbs(tok: DataFrame) -> DataFrame:
    return tagged_words(tok, ADVERB_POS, ADVERB_STOP_WORDS)


def adjectives(tok: DataFrame) -> DataFrame:
    return tagged_words(tok, ADJECTIVE_POS)


def pos_distribution(tok: DataFrame) -> DataFrame:
    return tok.groupBy("doc_id", "pos").agg(F.count("*").alias("n"))


def repeated_phrases(tok: DataFrame, gap: int = 0, least: int = MIN_PHRASE, k: int = TOP_PHRASES) -> DataFrame:
    """Two- and three-word phrases of words that follow each other `gap` characters apart (0: no space), at least so often."""
    eligible = tok.where((F.col("pos").isNull() | ~F.col("pos").isin(PHRASE_STOP_POS)) & F.col("text").rlike(r"[\p{L}\p{N}]"))
    order = Window.partitionBy("doc_id", "seq").orderBy("span_start")
    joint = F.lit(" " if gap else "")
    step = eligible.select("doc_id", F.col("text").alias("a"), *[f(n).over(order).alias(f"{name}{n}") for n in (1, 2) for name, f in (("t", lambda n: F.lead("text", n)), ("s", lambda n: F.lead("span_start", n)))], F.lead("span_end", 1).over(order).alias("e1"), "span_end")
    two = F.col("s1") == F.col("span_end") + gap
    three = two & (F.col("s2") == F.col("e1") + gap)
    grams = F.array_compact(F.array(F.when(two, F.concat("a", joint, "t1")), F.when(three, F.concat("a", joint, "t1", joint, "t2"))))
    counted = step.select("doc_id", F.explode(grams).alias("phrase")).groupBy("doc_id", "phrase").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return top_k(counted, k, "n", "phrase")


def text_phrases(blk: DataFrame, least: int = MIN_PHRASE, k: int = TOP_PHRASES) -> DataFrame:
    """repeated_phrases of untagged texts whose words are parted by one character: two patterns over a block, no row per word.

    A look-ahead finds the phrases that overlap. A document's phrases are sorted where its text is gathered, and only those
    that come back as often become rows: one that equals the phrase least - 1 places on.
    """
    joined = F.regexp_replace("content", r"(?<=\p{L})\P{L}(?=\p{L})", " ")
    grams = lambda t: F.concat(*[F.regexp_extract_all(t, F.lit(rf"(?<!\p{{L}})(?=(\p{{L}}++{more}))"), F.lit(1)) for more in (r" \p{L}++", r" \p{L}++ \p{L}++")])
    docs = blk.groupBy("doc_id").agg(F.collect_list(joined).alias("texts")).select("doc_id", F.sort_array(F.flatten(F.transform("texts", grams))).alias("phrases"))
    again = docs.select("doc_id", F.explode(F.filter("phrases", lambda x, i: x == F.get("phrases", i + (least - 1)))).alias("phrase"))
    return top_k(again.groupBy("doc_id", "phrase").agg((F.count("*") + (least - 1)).alias("n")), k, "n", "phrase")


def token_source(blk: DataFrame, tok: DataFrame) -> DataFrame:
    """'nlp' for documents with tokens, 'none' for those that were never tokenised."""
    have = tok.select("doc_id").distinct().withColumn("token_source", F.lit("nlp"))
    return blk.select("doc_id").distinct().join(have, "doc_id", "left").fillna("none", ["token_source"])
