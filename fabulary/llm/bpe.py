"""Byte-level BPE: texts to token ids and back, with the tokenizers library inside Arrow UDFs.

The vocabulary is a rank file (base64 token, rank per line). Bytes are written as printable characters so that
the library's BPE model can work on them; every pair of tokens whose concatenation is a token becomes a merge with
the rank of that token, which is the rule by which a rank file is applied. Each match of the split pattern is
encoded alone. Chunks of text met before come from a cache that is bounded in bytes; it costs or saves time only.

Cases: a null text is the empty one and has no tokens; special-token strings inside a text are ordinary text; an
output column replaces an input column of the same name; rows, ties and repeats pass through one to one; an empty
table gives no rows; a long text is split and encoded as a whole, alone in its slice of a batch.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulary.llm.common import parts, table, text_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of the chunks that a worker keeps, and what an entry takes besides its text; longer chunks are never kept.
CACHE_BYTES, ENTRY_BYTES, LONG_CHUNK = 16_000_000, 180, 64
#: A blank after white space does not start a chunk of its own.
_INNER_SPACE = re.compile(r"\s |\s\Z")
_CHUNK = re.compile(r"(?<=\S)(?= )")
#: Trailing punctuation that forms one piece after a word.
_TAIL = ".,!?;:#$%&*|"


def byte_characters() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves, the others take the characters from U+0100 on, in order."""
    shown = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Codec:
    """One vocabulary in one worker."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads; each of the library's own holds memory
        from tokenizers import Tokenizer, models

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.to_char = byte_characters()
        written = lambda raw: raw.decode("latin-1").translate(self.to_char)
        vocab = {written(token): rank for token, rank in ranks.items()}
        merges = [
            (written(token[:cut]), written(token[cut:]))
            for token in sorted(ranks, key=ranks.__getitem__)
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        self.model = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.split = regex.compile(pattern)
        to_byte = {c: b for b, c in self.to_char.items()}
        self.token_bytes: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in vocab.items():
            self.token_bytes[rank] = bytes(to_byte[c] for c in token)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0  # bytes of the young chunks

    def _parts(self, text: str) -> list[str]:
        """Chunks that the pattern never joins: it has no match with a blank right after a visible character."""
        if _INNER_SPACE.search(text):
            return _CHUNK.split(text)
        parts = text.replace(" ", "\0 ").split("\0") if "\0" not in text else _CHUNK.split(text)
        return parts

    def _pieces_of(self, chunk: str) -> list[str]:
        """The pattern's matches; a word with or without plain punctuation after it needs no regular expression."""
        stem = chunk.rstrip(_TAIL)
        if (stem[1:] if stem[:1] == " " else stem).isalpha():
            return [stem] if len(stem) == len(chunk) else [stem, chunk[len(stem) :]]
        return self.split.findall(chunk)

    def _learn(self, needed: set[str]) -> dict[str, bytes]:
        """Ids of the chunks. Those met lately are kept in two halves: a full young half becomes the old one."""
        out, split, new = {}, {}, {}
        for chunk in needed:
            ids = self.young.get(chunk)
            if ids is None and (ids := self.old.get(chunk)) is not None:
                self._keep(chunk, ids)
            if ids is not None:
                out[chunk] = ids
                continue
            own = split[chunk] = self._pieces_of(chunk)
            for piece in own:
                new[piece] = b""
        mapped = [p.encode().decode("latin-1").translate(self.to_char) for p in new]
        for piece, got in zip(list(new), self.model.encode_batch_fast(mapped, add_special_tokens=False)):
            new[piece] = array("I", got.ids).tobytes()
        for chunk, own in split.items():
            ids = out[chunk] = new[own[0]] if len(own) == 1 else b"".join([new[p] for p in own])
            if len(chunk) <= LONG_CHUNK:
                self._keep(chunk, ids)
        return out

    def _keep(self, chunk: str, ids: bytes) -> None:
        self.young[chunk] = ids
        self.held += len(chunk) + len(ids) + ENTRY_BYTES
        if self.held > CACHE_BYTES // 2:
            self.young, self.old, self.held = {}, self.young, 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [self._parts(t) for t in texts]
        known = self._learn(set().union(*split))
        return [b"".join([known[c] for c in parts_]) for parts_ in split]

    def decode(self, ids: bytes) -> bytes:
        own = self.token_bytes
        return b"".join([own[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def starts(self, ids: bytes) -> list[int]:
        """Code point at which each token starts; a token that starts inside a character gets that character's place."""
        own, out, chars = self.token_bytes, [], 0
        for i in np.frombuffer(ids, "<u4").tolist():
            token = own[i]
            inside = token[0] & 0xC0 == 0x80
            out.append(chars - 1 if inside else chars)
            chars += sum(b & 0xC0 != 0x80 for b in token)
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _default() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def token_ids(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """BINARY: the ids of a text as little-endian unsigned 32-bit integers, the form in which training shards hold them."""
    path, pattern = path or _default()[0], pattern or _default()[1]

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for part in parts(batches):
            yield pa.array(own.encode([x or "" for x in part.to_pylist()]), pa.binary())

    return encode(text)


def token_starts(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """ARRAY<INT>: code point offset of each token in its text."""
    path, pattern = path or _default()[0], pattern or _default()[1]

    @F.arrow_udf("array<int>")
    def starts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for part in parts(batches):
            yield pa.array([own.starts(x or b"") for x in part.to_pylist()], pa.list_(pa.int32()))

    return starts(ids)


def token_bytes(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """BINARY: the UTF-8 bytes that the ids stand for. Any run of ids decodes, also one that begins or ends inside a character."""
    path, pattern = path or _default()[0], pattern or _default()[1]

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for part in parts(batches):
            yield pa.array([own.decode(x or b"") for x in part.to_pylist()], pa.binary())

    return decode(ids)


def token_text(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """STRING: the decoded bytes as text; bytes that are no whole character become U+FFFD."""
    path, pattern = path or _default()[0], pattern or _default()[1]

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for part in parts(batches):
            yield pa.array([own.decode(x or b"").decode("utf-8", "replace") for x in part.to_pylist()], pa.string())

    return decode(ids)


def coded(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """STRUCT<ids BINARY, decoded BINARY>: `token_ids`, and what `token_bytes` makes of them, by one worker."""
    path, pattern = path or _default()[0], pattern or _default()[1]

    @F.arrow_udf("ids binary, decoded binary")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for part in parts(batches):
            ids = own.encode([t or "" for t in part.to_pylist()])
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())], ["ids", "decoded"])

    return both(text)


def encode(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with `token_ids` BINARY, `n_tokens` LONG and `decoded` BINARY, the bytes that the ids stand for."""
    out = df.withColumn("_coded", coded(text_of(text), path, pattern))
    return out.withColumn("token_ids", F.col("_coded.ids")).withColumn("n_tokens", (F.length("token_ids") / 4).cast("long")).withColumn("decoded", F.col("_coded.decoded")).drop("_coded")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text of documents."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
