"""Markdown and plain-text manuscripts: bytes to text, text to blocks.

A document's lines depend on those before them (fences, headings, paragraphs), so a document is split by one small
function inside an Arrow UDF; everything around it stays in DataFrames.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
FORMATS = {"md": "markdown", "markdown": "markdown", "mdown": "markdown", "mkd": "markdown", "txt": "txt"}
_NUMERALS, _PARTS, _JOINTS = "零〇一二三四五六七八九十百千万两0-9", "章节回卷篇幕部", " 、·\\-—"
_ALONE = "序章|楔子|前言|引言|导言|后记|后叙|尾声|终章|番外"
_CJK = "一-鿿㐀-䶿豈-﫿"

CHAPTER = re.compile(rf"(?:第[{_NUMERALS}]+[{_PARTS}](?:[{_JOINTS}　][{_JOINTS}]*[^。！？，；：]{{0,24}})?|(?:{_ALONE})(?:[{_JOINTS}　][^。！？，；：]{{0,24}})?)")
ATX = re.compile(r"\s*(#{1,6})\s*(.*?)#*\s*")
BREAK = re.compile(r"(?=(?:[^*\-_—─]*[*\-_—─]){3})[*\-_—─ ]+")
FENCE = re.compile(r"\s*(?:`{3,}|~{3,}|[`~]{3,})")
ITEM = re.compile(rf"\s*(?:[-*+]|[0-9]+[.)、])(?=[\s{_CJK}])\s*(\S.*)")
QUOTE = re.compile(r"\s*(?:>\s?)*")
_BLOCK = "array<struct<content:string,block_type:string,section_path:string,title:string>>"


def decoded(data: bytes) -> tuple[str | None, str]:
    """Text and encoding: what the byte-order mark says, else strict UTF-8, else GB18030; null text and 'unknown' if none fits."""
    if data.startswith(b"\xef\xbb\xbf"):
        return data[3:].decode("utf-8", "replace"), "UTF-8 (BOM)"
    tries = [("utf-8", "UTF-8", 0), ("gb18030", "GB18030", 0)]
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        tries = [("utf-16-le", "UTF-16LE", 2)] if data[:2] == b"\xff\xfe" else [("utf-16-be", "UTF-16BE", 2)]
    for codec, name, skip in tries:
        try:
            return data[skip:].decode(codec), name
        except UnicodeDecodeError:
            continue
    return None, "unknown"


def plain_inline(text: str) -> str:
    """Inline markup removed: code and link labels stay, images, tags and address brackets go, escapes are undone."""
    text = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", text)
    text = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"<((?:https?|mailto):[^>\s]+)>", r"\1", text)
    text = re.sub(r"</?[A-Za-z][^>]*>", "", text)
    text = re.sub(r"(?<!\\)(`+)(.+?)\1", r"\2", text)
    for mark in (r"\*\*\*", r"\*\*", "__", "~~", r"\*"):
        text = re.sub(rf"(?<!\\){mark}(\S(?:.*?\S)?){mark}", r"\1", text)
    text = re.sub(r"(?<![\w\\])_(\S(?:.*?\S)?)_(?!\w)", r"\1", text)
    return re.sub(r"\\([\\`*_{}\[\]()#+.!<>~-])", r"\1", text).strip()


def joined(lines: list[str]) -> str:
    """Soft-wrapped lines as one; a blank stands only between ASCII letters or digits."""
    out = ""
    for line in lines:
        line = line.strip()
        gap = " " if out and line and out[-1].isascii() and out[-1].isalnum() and line[0].isascii() and line[0].isalnum() else ""
        out += gap + line
    return out


class _Draft:
    def __init__(self) -> None:
        self.blocks: list[dict] = []
        self.stack: list[tuple[int, str]] = []
        self.lines: list[str] = []

    def add(self, content: str, kind: str = "paragraph", title: str | None = None) -> None:
        if content.strip():
            self.blocks.append({"content": content, "block_type": kind, "section_path": " / ".join(t for _, t in self.stack), "title": title})

    def flush(self) -> None:
        self.add(joined(self.lines))
        self.lines = []

    def heading(self, level: int, title: str) -> None:
        self.flush()
        while self.stack and self.stack[-1][0] >= level:
            self.stack.pop()
        self.stack.append((level, title))
        self.add(title, "title", title)


def prepared(text: str) -> str:
    """Line ends unified, front matter and comments removed."""
    text = re.sub(r"\r+\n?", "\n", text)
    text = re.sub(r"\A---[ \t]*\n.*?\n(?:---|\.\.\.)[ \t]*(?:\n|\Z)", "", text, flags=re.S)
    return re.sub(r"<!--.*?-->", "", text, flags=re.S)


def chapter(line: str) -> str | None:
    line = line.strip()
    return line if line and len(line) <= 40 and CHAPTER.fullmatch(line) else None


def split_markdown(text: str) -> list[dict]:
    draft, fenced = _Draft(), None
    for raw in prepared(text).split("\n"):
        line = raw.rstrip()
        if FENCE.match(line):
            if fenced is None:
                fenced = []
            else:
                draft.flush()
                draft.add(joined(fenced))
                fenced = None
        elif fenced is not None:
            fenced.append(raw)
        elif (m := ATX.fullmatch(line)) and m[2].strip():
            draft.heading(len(m[1]), plain_inline(m[2].strip()))
        elif title := chapter(line):
            draft.heading(1, title)
        elif BREAK.fullmatch(line.strip()):
            draft.flush()
        elif m := ITEM.fullmatch(line):
            draft.flush()
            draft.add(plain_inline(m[1].strip()), "list")
        elif not (body := line[QUOTE.match(line).end() :].strip()):
            draft.flush()
        else:
            draft.lines.append(plain_inline(body))
    if fenced:
        draft.add(joined(fenced))
    draft.flush()
    return draft.blocks


def split_txt(text: str) -> list[dict]:
    lines = [x.strip() for x in prepared(text).rstrip("\n").split("\n")]
    draft, paragraphs = _Draft(), any(not x for x in lines)
    for line in lines:
        if title := chapter(line):
            draft.heading(1, title)
        elif not line or BREAK.fullmatch(line):
            draft.flush()
        elif paragraphs:
            draft.lines.append(line)
        else:
            draft.add(line)
    draft.flush()
    return draft.blocks


def format_of(name: Column) -> Column:
    """'markdown' or 'txt' by the extension, else null."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), ext)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), title (the file's stem), format, text, encoding of all text files below a path."""
    return decoded_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def decoded_files(files: DataFrame) -> DataFrame:
    """files: path and content, from a batch or a stream's batch."""

    @F.arrow_udf("text string, encoding string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = [decoded(x or b"") for x in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([t for t, _ in made], pa.string()), pa.array([e for _, e in made], pa.string())], ["text", "encoding"])

    known = files.withColumn("format", format_of(F.col("path"))).where("format is not null")
    read = known.withColumn("d", decode("content"))
    return read.select(F.col("path").alias("doc_id"), F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("title"), "format", "d.text", "d.encoding")


def blocks(docs: DataFrame) -> DataFrame:
    """docs: doc_id, title, format, text. The block table; a text that could not be decoded has no blocks."""

    @F.arrow_udf(_BLOCK)
    def split(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([(n, pa.string()) for n in ("content", "block_type", "section_path", "title")]))
        for texts, formats in batches:
            yield pa.array([split_markdown(t or "") if f == "markdown" else split_txt(t or "") for t, f in zip(texts.to_pylist(), formats.to_pylist())], kind)

    project = F.col("project_id") if "project_id" in docs.columns else F.col("title")
    each = docs.select(project.alias("project_id"), "doc_id", F.posexplode(split("text", "format")).alias("seq", "b"))
    return each.select("project_id", "doc_id", "seq", "b.content", "b.section_path", "b.block_type", "b.title")
