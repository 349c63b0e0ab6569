"""The pipeline on a small corpus: every stage's decisions take effect, and clean documents stay."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from fabulary.llm import mixing, shingles, simhash


def test_stages(spark, tmp_path):
    rng = random.Random(0)
    words = [a + b for a in ("ri", "sto", "let", "win", "gar", "pa", "mir", "sum") for b in ("ver", "ne", "ter", "dow", "den", "per", "ror", "mer")]
    rows = []
    for i in range(160):
        good = i % 4 != 0
        text = " ".join(rng.choice(words) for _ in range(120)) if good else " ".join("#$%" + rng.choice(words).upper() for _ in range(80))
        rows.append((i, text, "en", f"s{i % 2}", len(text)))
    rows[9] = (9, rows[5][1], "en", "s0", rows[5][4])
    rows[13] = (13, rows[13][1] + " token = " + "0a1b" * 10, "en", "s1", rows[13][4] + 48)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = now
        if name != "encoding":
            assert now.columns == docs.columns
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    clean = {i for i in range(160) if i % 4}
    assert ids("quality") == clean and ids("near_duplicates") == clean - {9}
    masked = seen["secrets"].where("doc_id = 13").first()
    assert masked.text.endswith(" [SECRET]") and masked.n_chars == len(masked.text)
    total = seen["secrets"].agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    mixed = seen["mixing"].agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert abs(mixed - 1.5 * total) <= 130
    assert seen["encoding"].where("not round_trip").count() == 0 and seen["encoding"].count() == seen["mixing"].count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["encoding"].count()


EXTRA = ["spans", "base", "runs", "size", "fp", "group", "row", "copies", "n_tokens", "decoded", "score", "component_id"]


def test_stages_keep_nulls_repeats_and_clashing_columns(spark, tmp_path):
    rows = [(i if i % 3 else None, None if i == 4 else f"text {i // 2} of some words", "en", None if i % 5 == 0 else "s", 20) for i in range(24)]
    rows += [rows[1], rows[1], (None, None, None, None, None), (None, None, None, None, None), (7, "token=" + "a1" * 10, "en", "s", 26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in EXTRA})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        assert all(r[c] == "x" for r in got.collect() for c in EXTRA if name != "encoding" or c != "n_tokens")
        if name in ("quality", "secrets", "encoding"):
            assert got.count() == len(rows)
        assert len(set(got.columns)) == len(got.columns) and (name == "encoding" or got.columns == docs.columns)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_near_duplicates_without_ids(spark):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(None, text(1)), (None, text(1)), (5, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (9, text(4)), (9, text(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(5, text(1)), (None, text(2)), (None, text(3)), (9, text(4))], key=str)
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {(None, 5), (5, 5), (None, None), (9, 9)}


def test_near_duplicates_with_clashing_ids(spark):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    kept = lambda rows: sorted(tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept([(5, text(1)), (5, text(2)), (7, text(2))]) == [(5, text(1)), (5, text(2))]
    assert kept([(3, text(1)), (5, text(1)), (5, text(2)), (7, text(2)), (5, text(2))]) == [(3, text(1)), (5, text(2))]


def test_edited_copies_against_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for i in range(30):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 40, 120, 700]))]
        texts.append(" ".join(words))
        for edits in (1, 2, 4, 8):
            other = [rng.choice(["new", "words"]) if rng.random() < edits / 60 else w for w in words]
            texts.append(" ".join(other))
    rng.shuffle(texts)
    texts += ["", " ", None, "Some Few words", "some few words"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()}
    assert kept == set(label) and len(kept) < simhash.keep_one(docs).count()
    base, groups = shingles.grouped(docs)
    assert {r.doc_id: r.component_id for r in base.join(groups, "fp").collect()} == dict(enumerate(label))


def test_repeated_rows_are_mixed_apart(spark):
    rows = [(1, "a b c", None)] * 3 + [(None, "d e", "s"), (None, "f g", "s"), (2, "h", None), (3, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, want = {}, {}
    for r in mixing.repeat(docs).collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.copies
    assert got == {k: n for k, n in want.items() if n}
