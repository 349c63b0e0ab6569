"""A store of analysed manuscripts: documents with their blocks, tokens, entities and signals, and the results of their analysis.

Each kind of row is a table bucketed by document (results: by content hash), so a child joins its documents bucket by
bucket, without an exchange. A save writes one batch, a partition of every table, and then publishes it by one row of the
manifest. Readers see published batches only: a save that fails part-way, or loses its driver, leaves files that
nobody reads and that compact() removes. Of each document the newest published batch counts; deleting publishes a
batch too, so nothing is ever changed in place.

The tables are external, below one folder that all executors share; a session that opens the folder declares them anew.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabulary.operators.components import ensure_checkpoint_dir

BUCKETS = 32
#: Fixed columns of each table besides `batch`; what a save doesn't give is null.
TABLES = {
    "documents": "doc_id STRING, project_id STRING, title STRING, created_at TIMESTAMP, block_count BIGINT, byte_count BIGINT, word_count BIGINT, deleted BOOLEAN",
    "blocks": "doc_id STRING, seq INT, source_block_id STRING, content STRING, section_path STRING, block_type STRING, title STRING",
    "tokens": "doc_id STRING, seq INT, nth INT, text STRING, pos STRING, confidence FLOAT, span_start INT, span_end INT, source STRING",
    "entities": "doc_id STRING, seq INT, nth INT, text STRING, category STRING, confidence FLOAT, source STRING, keep BOOLEAN, span_start INT, span_end INT",
    "signals": "doc_id STRING, seq INT, nth INT, text STRING, pos STRING, syntactic_role STRING, score FLOAT, span_start INT, span_end INT",
    "results": "input_hash STRING, project_id STRING, dimension STRING, tier STRING, score DOUBLE, data STRING, computed_at TIMESTAMP",
}
MANIFEST = "batch BIGINT, action STRING, documents BIGINT, schema_version INT, published_at TIMESTAMP"
LEDGER = "version INT, name STRING, applied_at TIMESTAMP"
KEYS = {"results": "input_hash"}
CHILDREN = ("blocks", "tokens", "entities", "signals")
#: Fixed: the changes of the stored form, in order. Columns that a later version adds are null in older files.
VERSIONS = ((1, "documents and blocks"), (2, "tokens, entities and signals"), (3, "results by dimension"), (4, "word counts of documents"))


class DuplicateBlocks(ValueError):
    """Two blocks of a document with one place, or two documents with one id, in a save."""


def _shaped(rows: DataFrame, schema: str) -> DataFrame:
    """rows with exactly the columns of a table, cast; those that are missing are null."""
    wanted = [c.strip().split(" ") for c in schema.split(",")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted])


def same_batch(a: str, b: str) -> Column:
    """Equality of batches that stays a condition of the join by document: as a key of its own it would ask for another distribution."""
    return (F.col(f"{a}.batch") >= F.col(f"{b}.batch")) & (F.col(f"{a}.batch") <= F.col(f"{b}.batch"))


class Library:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.space = "library_" + hashlib.sha256(self.path.encode()).hexdigest()[:12]
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.space} LOCATION '{self.path}/catalog'")
        for name, schema in TABLES.items():
            self._declare(name, schema)

    # --- tables ---

    def name(self, table: str) -> str:
        return f"{self.space}.{table}"

    def _declare(self, table: str, schema: str) -> None:
        if not self.spark.catalog.tableExists(self.name(table)):
            key = KEYS.get(table, "doc_id")
            # Makes the folder where there is none; adds nothing to one that is there.
            self.spark.createDataFrame([], f"{schema}, batch BIGINT").write.mode("append").partitionBy("batch").parquet(f"{self.path}/{table}")
            self.spark.sql(f"CREATE TABLE {self.name(table)} ({schema}, batch BIGINT) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{table}'")
        self.spark.catalog.recoverPartitions(self.name(table))

    def _small(self, name: str, schema: str) -> DataFrame:
        """A table of few rows, written row by row."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        return self._small("manifest", MANIFEST)

    def ledger(self) -> DataFrame:
        return self._small("ledger", LEDGER)

    def migrate(self) -> list[int]:
        """Notes the versions that this folder hasn't seen; those applied before are left alone. Returns what was new."""
        seen = {r["version"] for r in self.ledger().collect()}
        new = [(v, n) for v, n in VERSIONS if v not in seen]
        if new:
            rows = self.spark.createDataFrame(new, "version int, name string").withColumn("applied_at", F.current_timestamp())
            rows.coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
        return [v for v, _ in new]

    # --- writing ---

    def _write(self, table: str, rows: DataFrame, batch: int) -> None:
        key = KEYS.get(table, "doc_id")
        shaped = _shaped(rows, TABLES[table]).withColumn("batch", F.lit(batch).cast("bigint"))
        # One task a bucket, so a batch has one file for each.
        dealt = shaped.repartition(self.buckets, key)
        dealt.write.mode("append").format("parquet").partitionBy("batch").bucketBy(self.buckets, key).sortBy(key).saveAsTable(self.name(table), path=f"{self.path}/{table}")

    def _publish(self, batch: int, action: str, documents: int) -> None:
        """One file by one task: it is there whole or not at all."""
        row = self.spark.createDataFrame([(batch, action, documents, VERSIONS[-1][0])], "batch bigint, action string, documents bigint, schema_version int")
        row.withColumn("published_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        for table in TABLES:
            self.spark.catalog.refreshTable(self.name(table))

    def _next(self) -> int:
        """Above every batch before; batches of one folder are made by one writer at a time."""
        newest = self.manifest().agg(F.max("batch")).first()[0] or 0
        return max(newest + 1, time.time_ns() // 1_000)

    def save(self, documents: DataFrame, blocks: DataFrame, tokens: DataFrame | None = None, entities: DataFrame | None = None, signals: DataFrame | None = None) -> int:
        """Stores documents (doc_id, project_id, title, ...) with all their rows; those stored before under their ids are replaced. Returns the batch.

        Counts come from the rows. Blocks that share a place in their document, and documents that share an id, are refused, as a primary key would.
        """
        self.migrate()
        batch = self._next()
        counted = blocks.groupBy("doc_id").agg(F.count("*").alias("block_count"), F.countDistinct("seq").alias("places"), F.sum(F.octet_length("content")).alias("byte_count"))
        words = None if tokens is None else tokens.groupBy("doc_id").agg(F.count("*").alias("word_count"))
        own = documents.drop("block_count", "byte_count", "word_count", "deleted").join(counted, "doc_id", "left")
        own = own.withColumn("word_count", F.lit(0)) if words is None else own.join(words, "doc_id", "left")
        own = own.fillna(0, ["block_count", "byte_count", "word_count"]).withColumn("deleted", F.lit(False))
        if "created_at" not in own.columns:
            own = own.withColumn("created_at", F.current_timestamp())
        for table, rows in (("blocks", blocks), ("tokens", tokens), ("entities", entities), ("signals", signals)):
            if rows is not None:
                self._write(table, rows, batch)
        self._write("documents", own, batch)
        self._refuse_duplicates(batch)
        self._publish(batch, "save", self.spark.table(self.name("documents")).where(F.col("batch") == batch).count())
        return batch

    def _refuse_duplicates(self, batch: int) -> None:
        """Looks at the rows as they were written, by bucket."""
        for table, keys in (("documents", ["doc_id"]), ("blocks", ["doc_id", "seq"])):
            again = self.spark.table(self.name(table)).where(F.col("batch") == batch).groupBy(*keys).count().where("count > 1").limit(1).collect()
            if again:
                raise DuplicateBlocks(f"{table}: {[again[0][k] for k in keys]} is there {again[0]['count']} times")

    def delete(self, documents: DataFrame) -> int:
        """Documents (doc_id) that no longer count, with all their rows. Results stay: they belong to contents."""
        batch = self._next()
        self._write("documents", documents.select("doc_id").distinct().withColumn("deleted", F.lit(True)), batch)
        self._publish(batch, "delete", self.spark.table(self.name("documents")).where(F.col("batch") == batch).count())
        return batch

    # --- reading ---

    def batches(self) -> list[int]:
        """Published batches; their number is that of the saves since the last compact()."""
        dropped = self.manifest().where("action = 'compact'").agg(F.max("batch")).first()[0] or 0
        return sorted(r["batch"] for r in self.manifest().where(F.col("batch") >= dropped).select("batch").distinct().collect())

    def _published(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table)).where(F.col("batch").isin(self.batches()))

    def documents(self, project_id: str | None = None) -> DataFrame:
        """The documents that count, each in its newest form, with `batch`."""
        rows = self._published("documents")
        columns = [c for c in rows.columns if c not in ("doc_id", "batch")]
        newest = rows.groupBy("doc_id").agg(F.max(F.struct("batch", *columns)).alias("d")).select("doc_id", "d.*").where(~F.col("deleted")).drop("deleted")
        return newest if project_id is None else newest.where(F.col("project_id") == project_id)

    def children(self, table: str, project_id: str | None = None, documents: DataFrame | None = None) -> DataFrame:
        """Rows of a child table of the documents that count: all, those of a project, or those of the documents given (rows of documents())."""
        owners = (self.documents(project_id) if documents is None else documents).select("doc_id", "batch", "project_id")
        rows = self._published(table).alias("c").join(owners.alias("d"), (F.col("c.doc_id") == F.col("d.doc_id")) & same_batch("c", "d"))
        return rows.select("c.*", "d.project_id").drop("batch")

    def document(self, doc_id: str) -> DataFrame:
        """One document with its children nested: blocks in order, each with its tokens, entities and signals. No row if there is none."""
        owner = self.documents().where(F.col("doc_id") == doc_id)
        nested = self.children("blocks", documents=owner).drop("project_id")
        for table in ("tokens", "entities", "signals"):
            rows = self.children(table, documents=owner).drop("project_id")
            columns = [c for c in rows.columns if c not in ("doc_id", "seq")]
            each = rows.groupBy("doc_id", "seq").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(table))
            nested = nested.join(each, ["doc_id", "seq"], "left")
        columns = [c for c in nested.columns if c != "doc_id"]
        blocks = nested.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("blocks"))
        return owner.drop("batch").join(blocks, "doc_id", "left")

    def merged(self, project_id: str | None = None) -> DataFrame:
        """Blocks of each project as one document: `doc_id` is the project's, `seq` runs on through its documents in the order of their creation.

        Where a document's blocks begin is a running sum over the counts that documents carry, in two levels, so no task
        orders a project's blocks, and none a large project's documents.
        """
        d = self.documents(project_id)
        order = ["created_at", "doc_id"]
        starts = running_starts(d.select("doc_id", "project_id", "created_at", "block_count"), "project_id", order, "block_count")
        # seq of a stored block may have gaps (blank lines): its rank within its document comes from the document's own blocks.
        blocks = ranked_within(self.children("blocks", documents=d), "doc_id", "seq")
        return blocks.join(starts.select("doc_id", "start"), "doc_id").select(
            F.col("project_id").alias("doc_id"), "project_id", (F.col("start") + F.col("rank")).alias("seq"), F.col("doc_id").alias("part_of"), "source_block_id", "content", "section_path", "block_type", "title"
        )

    # --- results ---

    def results(self) -> DataFrame:
        """The newest result of each project, content and dimension; data that is null (made invalid) or no JSON counts as none."""
        rows = self._published("results")
        newest = rows.groupBy("input_hash", "project_id", "dimension").agg(F.max_by(F.struct("tier", "score", "data", "computed_at"), "batch").alias("r"))
        return newest.select("input_hash", "project_id", "dimension", "r.*").where(F.try_parse_json("data").isNotNull())

    def missing(self, hashes: DataFrame, dimensions: Iterable[str]) -> DataFrame:
        """doc_id, project_id, hash, dimension: what has no result. hashes: doc_id, project_id, hash."""
        wanted = hashes.withColumn("dimension", F.explode(F.array(*[F.lit(d) for d in dimensions])))
        known = self.results().select(F.col("input_hash").alias("hash"), "project_id", "dimension")
        return wanted.join(known, ["hash", "project_id", "dimension"], "left_anti").select("doc_id", "project_id", "hash", "dimension")

    def save_results(self, rows: DataFrame) -> int:
        """rows: input_hash, project_id, dimension, tier, score, data. They stand beside those stored before, or in place of the same key's."""
        self.migrate()
        batch = self._next()
        self._write("results", rows.withColumn("computed_at", F.current_timestamp()), batch)
        self._publish(batch, "results", 0)
        return batch

    def invalidate(self, project_id: str) -> int:
        """Makes every result of a project a miss."""
        return self.save_results(self.results().where(F.col("project_id") == project_id).withColumn("data", F.lit(None).cast("string")))

    # --- keeping house ---

    def compact(self) -> int:
        """Writes what counts as one batch, publishes it, and drops the older partitions and those of saves that failed."""
        batch = self._next()
        rows = {t: self.children(t).drop("project_id") for t in CHILDREN} | {"documents": self.documents().drop("batch").withColumn("deleted", F.lit(False)), "results": self.results()}
        for table, kept in rows.items():
            self._write(table, kept, batch)
        self._publish(batch, "compact", self.spark.table(self.name("documents")).where(F.col("batch") == batch).count())
        for table in TABLES:
            old = [r[0].split("=")[1] for r in self.spark.sql(f"SHOW PARTITIONS {self.name(table)}").collect() if int(r[0].split("=")[1]) < batch]
            for part in old:
                self.spark.sql(f"ALTER TABLE {self.name(table)} DROP IF EXISTS PARTITION (batch={part})")
        return batch


def running_starts(rows: DataFrame, key: str, order: list[str], size: str) -> DataFrame:
    """rows with `start`: the sum of size over the rows of their key that come before.

    Rows are dealt to ranges of (key, order), so a key with most of the rows lies in many. The sums of the ranges are run through
    first, one row for each range of a key, then each range's own rows.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    # Written down, since ranges drawn anew could differ between the two uses.
    dealt = rows.repartitionByRange(key, *order).withColumn("span", F.spark_partition_id()).checkpoint()
    before = F.coalesce(F.sum("of_span").over(Window.partitionBy(key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = dealt.groupBy(key, "span").agg(F.sum(size).alias("of_span")).select(key, "span", before.alias("before"))
    inside = F.coalesce(F.sum(size).over(Window.partitionBy(key, "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("inside", inside).join(spans, [key, "span"]).withColumn("start", F.col("before") + F.col("inside")).drop("span", "before", "inside")


def ranked_within(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with `rank`, from 0, by order within key: a window over one document's blocks."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
