"""A corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared checkpoint
folder and reads it again as the next one's docs. All stages but the last return the columns of documents.

Cases: a null text is the empty one and stays null; a null source is a source; rows without an id are documents of
their own; of repeated rows the second stage keeps one; extra columns pass through, whatever their names, but for
token_ids, n_tokens and round_trip, which the last stage sets; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulary.llm import bpe, mixing, quality, secret_scan, shingles
from fabulary.llm.common import crc_mod, ensure_checkpoint_dir, table, text_of


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    network = quality.train(docs.where(crc_mod("doc_id", 3) != 1), table(spark, sf_dir, "labels"))
    return docs.where(quality.score(text_of(), network) >= 0.5)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id: 5-word shingles, Jaccard 0.8 or more."""
    return shingles.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows."""
    masked = secret_scan.redact(secret_scan.scan(_packed(docs)))
    n_chars = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("_row.n_chars"))
    own = {"text": F.col("text"), "n_chars": n_chars.alias("n_chars")}
    return masked.select(*[own.get(c, F.col(f"_row.{c}")) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: a document appears as often as the mix takes it."""
    return mixing.repeat(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids; the decoded bytes are compared with the text."""
    coded = bpe.encode(_packed(docs))
    made = ("token_ids", "n_tokens", "round_trip")
    kept = [F.col("text") if c == "text" else F.col(f"_row.{c}") for c in docs.columns if c not in made]
    return coded.select(*kept, "token_ids", "n_tokens", (F.col("decoded") == text_of().cast("binary")).alias("round_trip"))


def _packed(docs: DataFrame) -> DataFrame:
    """text and `_row`, a struct of the other columns, so that no name of theirs meets one of an operator."""
    return docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", dedup_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: The stages are fitted models and iterative operators, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for nth, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{nth}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
