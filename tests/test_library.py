"""The store: scoped loads, failed and repeated saves, merges, and results by dimension."""


import pytest
from pyspark.sql import functions as F

from fabulary.plans import bundle, incremental
from fabulary.plans.library import VERSIONS, DuplicateBlocks, Library, running_starts


@pytest.fixture
def library(spark, tmp_path):
    return Library(spark, f"{tmp_path}/lib", buckets=4)


def docs(spark, *rows):
    return spark.createDataFrame(rows, "doc_id string, project_id string, title string")


def blocks(spark, **texts):
    rows = [(d, i, f"b{i}", t, f"s{i // 2}", "paragraph", None) for d, ts in texts.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, "doc_id string, seq int, source_block_id string, content string, section_path string, block_type string, title string")


def tokens(blk):
    return blk.select("doc_id", "seq", F.posexplode(F.split("content", " ")).alias("nth", "text"))


def entities(spark, *rows):
    return spark.createDataFrame(rows, "doc_id string, seq int, nth int, text string, category string, keep boolean")


def signals(spark, *rows):
    return spark.createDataFrame(rows, "doc_id string, seq int, nth int, text string, score float")


def test_a_document_comes_back_whole(spark, library):
    blk = blocks(spark, a=["Hello world", "again"])
    library.save(docs(spark, ("a", "p", "Test Doc")), blk, tokens(blk), entities(spark, ("a", 0, 0, "Hello", "PERSON", True)), signals(spark, ("a", 0, 0, "Hello", 0.8)))
    (row,) = library.document("a").collect()
    assert (row.title, row.block_count, row.byte_count, row.word_count) == ("Test Doc", 2, 16, 3)
    first, second = row.blocks
    assert first.content == "Hello world" and [t.text for t in first.tokens] == ["Hello", "world"] and second.entities is None
    assert first.entities[0].category == "PERSON" and first.signals[0].score == pytest.approx(0.8)
    assert library.document("none").collect() == []


def test_loads_are_scoped_to_a_project_and_keep_order(spark, library):
    blk = blocks(spark, second=["x"], first=["y z", "w"], foreign=["v"])
    own = docs(spark, ("second", "p", "Second"), ("first", "p", "First"), ("foreign", "q", "Foreign"))
    own = own.withColumn("created_at", F.when(F.col("doc_id") == "first", F.lit("2020-01-01")).otherwise(F.lit("2021-01-01")).cast("timestamp"))
    library.save(own, blk, tokens(blk))
    assert [r.title for r in library.documents("p").orderBy("created_at", "doc_id").collect()] == ["First", "Second"]
    assert {(r.doc_id, r.text) for r in library.children("tokens", "p").collect()} == {("second", "x"), ("first", "y"), ("first", "z"), ("first", "w")}
    assert library.documents("none").count() == library.children("blocks", "none").count() == 0
    assert [(r.seq, r.part_of, r.content) for r in library.merged("p").orderBy("seq").collect()] == [(0, "first", "y z"), (1, "first", "w"), (2, "second", "x")]


def test_a_failed_save_leaves_nothing_visible(spark, library):
    library.save(docs(spark, ("a", "p", "A")), blocks(spark, a=["one"]))
    before = library.batches()
    with pytest.raises(DuplicateBlocks):
        twice = blocks(spark, a=["two"], b=["three"])
        library.save(docs(spark, ("a", "p", "A2"), ("b", "p", "B")), twice.union(twice.where("doc_id = 'b'")))
    with pytest.raises(Exception, match="broken"):
        blk = blocks(spark, a=["four"])
        library.save(docs(spark, ("a", "p", "A3")), blk, tokens(blk).withColumn("text", F.raise_error(F.lit("broken"))))
    assert library.batches() == before
    assert [(r.title, r.block_count) for r in library.documents().collect()] == [("A", 1)]
    assert [r.content for r in library.children("blocks").collect()] == ["one"]
    # The next save works, and what failed is cleared away with the older batches.
    library.save(docs(spark, ("b", "p", "B")), blocks(spark, b=["five"]))
    assert {r.content for r in library.children("blocks").collect()} == {"one", "five"}
    kept = library.compact()
    assert library.batches() == [kept] and {r.content for r in library.children("blocks").collect()} == {"one", "five"}
    parts = {r[0] for r in spark.sql(f"SHOW PARTITIONS {library.name('blocks')}").collect()}
    assert parts == {f"batch={kept}"}


def test_newer_batches_replace_and_deletes_hide(spark, library, tmp_path):
    blk = blocks(spark, a=["old", "older"], b=["stays"])
    library.save(docs(spark, ("a", "p", "A"), ("b", "p", "B")), blk, tokens(blk))
    library.save(docs(spark, ("a", "q", "A2")), blocks(spark, a=["new"]))
    assert [(r.content, r.project_id) for r in library.children("blocks").orderBy("content").collect()] == [("new", "q"), ("stays", "p")]
    assert [r.text for r in library.children("tokens").collect()] == ["stays"]
    library.delete(docs(spark, ("b", "", "")))
    assert [r.doc_id for r in library.documents().collect()] == ["a"] and library.children("tokens").count() == 0
    again = Library(spark, f"{tmp_path}/lib", buckets=4)
    spark.sql(f"DROP DATABASE {library.space} CASCADE")  # a new session knows nothing of the tables
    again = Library(spark, f"{tmp_path}/lib", buckets=4)
    assert [r.content for r in again.children("blocks").collect()] == ["new"]


def test_children_join_without_an_exchange(spark, library):
    blk = blocks(spark, **{f"d{i}": ["a b c"] * 3 for i in range(20)})
    library.save(docs(spark, *[(f"d{i}", f"p{i % 2}", "t") for i in range(20)]), blk, tokens(blk))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (library.children("blocks"), library.children("tokens", "p1"), library.documents()):
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_versions_are_noted_once(spark, library):
    assert library.migrate() == [v for v, _ in VERSIONS] and library.migrate() == []
    assert sorted(r.version for r in library.ledger().collect()) == [v for v, _ in VERSIONS]


def test_files_of_an_older_version_are_read(spark, tmp_path):
    """Documents stored before they had word counts."""
    first = Library(spark, f"{tmp_path}/lib", buckets=4)
    first.save(docs(spark, ("a", "p", "A")), blocks(spark, a=["one"]))
    path = f"{tmp_path}/lib/documents/batch={first.batches()[0]}"
    old = spark.read.parquet(path).drop("word_count").toPandas()
    (spark.createDataFrame(old, "doc_id string, project_id string, title string, created_at timestamp, block_count long, byte_count long, deleted boolean")
     .repartition(4, "doc_id").write.format("parquet").bucketBy(4, "doc_id").mode("overwrite").saveAsTable("older", path=path))
    spark.sql("DROP TABLE older")
    spark.catalog.refreshTable(first.name("documents"))
    assert [(r.doc_id, r.word_count) for r in first.documents().collect()] == [("a", None)]


def test_running_starts_equal_a_window(spark):
    rows = [(f"d{i:04}", "hot" if i % 3 else f"p{i % 7}", f"2020-01-{1 + (i * 7) % 3:02}", i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id string, project_id string, created_at string, n long").withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = {r.doc_id: r.start for r in running_starts(df.repartition(6), "project_id", ["created_at", "doc_id"], "n").collect()}
    want, sums = {}, {}
    for d, p, t, n in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        want[d] = sums.get(p, 0)
        sums[p] = want[d] + n
    assert got == want


# --- results


STORY = {"a": ["他说：“走吧。”风很大，众人都不作声。" * 8] * 6, "b": ["短。"] * 3, "c": ["短。"] * 3}


def story(spark, **more):
    return blocks(spark, **STORY, **more).withColumn("project_id", F.when(F.col("doc_id") == "c", "q").otherwise("p"))


def test_an_older_project_misses_only_the_new_dimension(spark, library):
    blk = story(spark)
    done = incremental.fill(library, blk, dimensions=("t0", "t1"))
    assert list(done) == [("t0", "t1")]
    before = {(r.doc_id, r.dimension): r.data for r in incremental.stored(library, blk).collect()}
    assert set(before) == {(d, x) for d in "abc" for x in ("t0", "t1")}
    gone = library.missing(incremental.hashes_of(blk), ["t0", "t1", "conflict"])
    assert {(r.doc_id, r.dimension) for r in gone.collect()} == {(d, "conflict") for d in "abc"}
    # Only the plan of the new dimension is made; the rows stored before stay as they are.
    planned = []
    made = bundle.dimension_rows
    bundle.dimension_rows = lambda found, hashes, only=None: planned.append(sorted(set(found) & {d for d, *_ in bundle.DIMENSIONS})) or made(found, hashes, only)
    try:
        assert list(incremental.fill(library, blk, dimensions=("t0", "t1", "conflict"))) == [("conflict",)]
        assert incremental.fill(library, blk, dimensions=("t0", "t1", "conflict")) == {}
    finally:
        bundle.dimension_rows = made
    assert planned == [["conflict"]]
    after = {(r.doc_id, r.dimension): r.data for r in incremental.stored(library, blk).collect()}
    assert {k: v for k, v in after.items() if k[1] != "conflict"} == before and len(after) == 9


def test_new_documents_lack_all_and_old_ones_what_is_new(spark, library):
    incremental.fill(library, story(spark), dimensions=("t1",))
    blk = story(spark, d=["新的一章。"], e=["短。"] * 3).withColumn("project_id", F.when(F.col("doc_id") == "c", "q").otherwise("p"))
    lacks = {r.doc_id: r.lacks for r in incremental.lacking(library, blk, ["t1", "voice"]).collect()}
    # e has the content of b in its project, so it lacks what b lacks; one of them stands for both.
    assert lacks == {"a": ["voice"], "b": ["voice"], "c": ["voice"], "d": ["t1", "voice"]}
    assert set(incremental.fill(library, blk, dimensions=("t1", "voice"))) == {("voice",), ("t1", "voice")}
    assert {(r.doc_id, r.dimension) for r in incremental.stored(library, blk).collect()} == {(x, y) for x in "abcde" for y in ("t1", "voice")}


def test_many_sets_are_joined(spark, library, monkeypatch):
    monkeypatch.setattr(incremental, "MOST_SETS", 2)
    rows = [("a", "p", "h1", ["x"]), ("b", "p", "h2", ["x"]), ("c", "p", "h3", ["y"]), ("d", "p", "h4", ["z", "y"])]
    lacks = spark.createDataFrame(rows, "doc_id string, project_id string, hash string, lacks array<string>")
    assert incremental.sets_of(lacks) == [("x",), ("x", "y", "z")]


def test_invalid_and_broken_results_are_misses(spark, library):
    blk = story(spark)
    hashes = incremental.hashes_of(blk)
    rows = hashes.select(F.col("hash").alias("input_hash"), "project_id", F.lit("t0").alias("dimension"), F.lit("t0").alias("tier"), F.lit(1.0).alias("score"), F.when(F.col("doc_id") == "a", '[{"x":').otherwise("[]").alias("data"))
    library.save_results(rows)
    assert [r.doc_id for r in library.missing(hashes, ["t0"]).collect()] == ["a"]
    library.invalidate("q")
    assert sorted(r.doc_id for r in library.missing(hashes, ["t0"]).collect()) == ["a", "c"]
    library.delete(docs(spark, ("b", "", "")))
    assert sorted(r.doc_id for r in library.missing(hashes, ["t0"]).collect()) == ["a", "c"]
