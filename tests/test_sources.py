"""Importers, stores and reports."""

import json

from pyspark.sql import functions as F

from fabulary.plans import api, report, store
from fabulary.sources import nlp_json, plaintext
from fabulary.streaming import ingest


def kinds(blocks):
    return [(b["block_type"], b["content"], b["section_path"]) for b in blocks]


def test_markdown_blocks():
    text = "---\nx: 1\n---\n# One\n\npara **bold** and\nmore [link](u) ![i](x)\n- item `c`\n\n### Deep\n> quoted\n\n```\ncode\n```\n***\n第三章 雨夜\n末段<!-- c -->\n"
    assert kinds(plaintext.split_markdown(text)) == [
        ("title", "One", "One"),
        ("paragraph", "para bold and more link", "One"),
        ("list", "item c", "One"),
        ("title", "Deep", "One / Deep"),
        ("paragraph", "quoted", "One / Deep"),
        ("paragraph", "code", "One / Deep"),
        ("title", "第三章 雨夜", "第三章 雨夜"),
        ("paragraph", "末段", "第三章 雨夜"),
    ]


def test_txt_modes_and_headings():
    assert kinds(plaintext.split_txt("第一章\n一行\r\n二行")) == [("title", "第一章", "第一章"), ("paragraph", "一行", "第一章"), ("paragraph", "二行", "第一章")]
    assert [b["content"] for b in plaintext.split_txt("一行\n二行\n\nab\ncd")] == ["一行二行", "ab cd"]
    assert plaintext.chapter("第三章的某个夜晚") is None and plaintext.chapter("前言不搭后语") is None and plaintext.chapter("尾声") == "尾声"
    assert plaintext.split_txt("") == []


def test_decoding():
    assert plaintext.decoded("你好".encode("gb18030")) == ("你好", "GB18030")
    assert plaintext.decoded(b"\xff\xfe" + "你".encode("utf-16-le")) == ("你", "UTF-16LE")
    assert plaintext.decoded(b"\xef\xbb\xbfa") == ("a", "UTF-8 (BOM)")
    assert plaintext.decoded(b"\xff") == (None, "unknown")


def test_import_analyse_and_report(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\n他说：“走吧！”\n\n2003年3月5日。")
    (tmp_path / "b.txt").write_bytes("你好".encode("gb18030"))
    (tmp_path / "c.bin").write_bytes(b"x")
    blk = api.import_texts(spark, str(tmp_path))
    assert {r.title for r in plaintext.read_files(spark, str(tmp_path)).collect()} == {"a", "b"}
    assert blk.count() == 4
    found = api.analyse(blk)
    assert found["dialogue"].where("unit_count = 1").count() == 1 and found["timeline"].count() == 1
    made = api.reports(blk, {"Dialogue": (found["dialogue"], ["char_count", "unit_count"], "char_count")}).collect()
    assert len(made) == 2 and all("<table>" in r.html and "## Dialogue" in r.markdown for r in made)


def test_annotated_project(spark, tmp_path):
    folder = tmp_path / "proj" / "semantic"
    folder.mkdir(parents=True)
    block = lambda i, c, t=None: {"source_block_ids": [f"s{i}"], "block_ids": [i], "content": c, "section_path": "", **({"type": t} if t else {}), "tokens": [{"text": c, "pos": "NN", "span": [0, len(c)]}], "entities": [{"text": c, "category": "Material", "span": []}], "noun_signals": []}
    (folder / "semantic_result.json").write_text(json.dumps({"blocks": [block(1, "第一章 开端", "title"), block(2, "正文"), block(3, "第二章", "title"), block(4, "尾")]}))
    (folder / "popo_result.json").write_text(json.dumps({"result": {"toc": {"entries": [{"title": " 第一章 ", "level": 0}, {"title": "", "level": 1}, {"title": "第二章", "level": 2}]}}}))
    (folder / "term_result.json").write_text(json.dumps({"terms": [{"text": "x", "original_text": " 法国 ", "category": "LOC", "score": 0.5, "block_ids": [2, 4]}, {"text": "sub", "original_text": "", "block_ids": [1]}]}))
    blk = api.import_project(spark, str(folder / "semantic_result.json"), str(folder / "popo_result.json"), str(folder / "term_result.json")).orderBy("seq").collect()
    assert [r.section_path for r in blk] == ["第一章", "第一章", "第一章 / 第二章", "第一章 / 第二章"]
    assert [[s["text"] for s in r.noun_signals] for r in blk] == [[], ["法国"], [], ["法国"]]
    assert blk[0].entities[0]["category"] == "UNKNOWN" and blk[1].block_type == "paragraph"
    assert nlp_json.tokens(nlp_json.blocks(spark, str(folder / "semantic_result.json"))).count() == 4


def test_long_titles_are_matched(spark):
    """Titles have no bound: a title block that holds the entry, and a paragraph that equals it."""
    long = "很长的标题" * 60
    rows = [("d", 0, "第一章" + long, "title"), ("d", 1, "正文" * 500, "paragraph"), ("d", 2, long + "二", "paragraph"), ("d", 3, "尾", "paragraph")]
    blk = spark.createDataFrame([(d, i, t, k, "") for d, i, t, k in rows], "doc_id string, seq int, content string, block_type string, section_path string")
    entries = spark.createDataFrame([("d", 0, "第一章" + long, 1), ("d", 1, long + "二", 1)], "doc_id string, nth int, title string, level int")
    got = [r.section_path for r in nlp_json.with_toc(blk, entries).orderBy("seq").collect()]
    assert got == ["第一章" + long] * 2 + [long + "二"] * 2


def test_cache_and_upsert(spark, tmp_path):
    blk = lambda *c: spark.createDataFrame([("d", i, x) for i, x in enumerate(c)], "doc_id string, seq int, content string")
    h = lambda *c: store.document_hashes(blk(*c)).first().hash
    assert h("a", "b") == h("a", "b") != h("b", "a") and h("ab") != h("a", "b")
    path = str(tmp_path / "r")
    rows = lambda *r: spark.createDataFrame(r, "project_id string, input_hash string, dimension string, payload string")
    store.upsert(rows(("p", "h1", "t0", "1"), ("p", "h2", "t0", "1")), path, "project_id", "input_hash")
    store.upsert(rows(("p", "h1", "t0", "2")), path, "project_id", "input_hash")
    assert sorted((r.input_hash, r.payload) for r in spark.read.parquet(path).collect()) == [("h1", "2"), ("h2", "1")]
    hashes = spark.createDataFrame([("d", "h1"), ("e", "h3")], "doc_id string, hash string")
    assert [r.doc_id for r in store.cache_misses(hashes, spark.read.parquet(path), 1).collect()] == ["e"]


def test_stream_stores_new_texts_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("你好")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    measure = lambda b: store.document_hashes(b).select(F.lit("p").alias("project_id"), F.lit("t0").alias("dimension"), F.col("hash").alias("input_hash"), F.lit("{}").alias("payload"))
    for name in ("b.txt", "c.txt"):
        ingest.watch(spark, str(tmp_path / "in"), out, mark, measure).awaitTermination(60)
        (tmp_path / "in" / name).write_text("你好")
    assert spark.read.parquet(out).count() == 1


def test_html_escapes():
    page = report.to_html("# A <b>\n\n| x | y |\n| --- | --- |\n| 1\\|2 | **z** |\n\n- i\n\n---", "t")
    assert "<h1>A &lt;b&gt;</h1>" in page and "<td>1|2</td><td><strong>z</strong></td>" in page and "<ul><li>i</li></ul><hr>" in page


def test_graph_export(spark):
    ment = spark.createDataFrame([("p", "Ann", "PERSON"), ("p", "Bob", "PERSON")], "project_id string, text string, category string")
    pairs = spark.createDataFrame([("p", "ann", "Bob", 3)], "project_id string, a string, b string, n int")
    made = json.loads(api.export_graph(ment, pairs).first().json)
    assert len(made["nodes"]) == 2 and made["edges"][0]["strength"] == 1.0
