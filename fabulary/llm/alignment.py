"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Tokenizer A (byte-level BPE of the tokenizers library) and B (sentencepiece, with byte fallback) encode the same text. Each byte has an
owner in A and one in B, `np.repeat` of the token numbers by the tokens' lengths. Distinct consecutive pairs of owners
are the overlaps; bytes where both owners change are the cuts, between which tokens form groups.

A text is split before each blank that follows a visible character. No match of A's pattern and no piece of B's
vocabulary goes over such a place (the vocabulary is tested for it when it is loaded), so chunks are encoded and aligned alone, and
those met before come from a cache that is bounded in bytes; it costs or saves time only.

The pairs of a document are written once, to the shared folder, and counted by document from there. Pairs with the highest counts, at most
HOT of them, go to the tasks as sorted arrays; pairs below that threshold are looked up by a join. This is one rule
for all sizes: no pair is dropped, and the hottest keys never meet in one task.

Cases: a text that is null, empty, or whose tokens in A or B don't join to the blank and the text (one with U+2581 in it) has no tokens: all numbers
are 0 and the digest is ''; strings of special tokens are ordinary text; a pair counts once for each row that holds it, so
repeated rows count each; a null id stays null; among pairs of one A id with equal counts all are best; an empty table gives no rows; other
columns are ignored, clashing names too. A text passes through whole, alone in its slice if it is long.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulary.llm.bpe import byte_characters
from fabulary.llm.common import cut, ensure_checkpoint_dir, parts, table

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs whose counts are sent to all tasks at most: 16 bytes each.
HOT = 1 << 20
#: Pairs of documents that a task looks up at a time.
LOOKED_UP = 500_000
#: Bytes of the chunks that a worker keeps, and what an entry takes besides its values; longer chunks are never kept.
CACHE_BYTES, ENTRY_BYTES, LONG_CHUNK = 130_000_000, 420, 64
#: Characters of chunks that A encodes in one call.
RUN = 4_000
_CHUNK = re.compile(r"(?<=\S)(?= )")
_BLANK = "▁"


# --- byte owners -------------------------------------------------------------------------------------------------


@dataclass
class Aligned:
    """Token runs of A and B over the same bytes."""

    a: np.ndarray  # overlaps: number of the A token
    b: np.ndarray  # and of the B token, in the order of their bytes
    group_a: np.ndarray  # group of each A token
    group_b: np.ndarray


def align(a_sizes: np.ndarray, b_sizes: np.ndarray) -> Aligned:
    """Overlaps and groups of two token runs, given by their lengths in bytes (all above 0, equal in sum)."""
    a = np.repeat(np.arange(len(a_sizes)), a_sizes)
    b = np.repeat(np.arange(len(b_sizes)), b_sizes)
    a_turn, b_turn = np.diff(a, prepend=-1) != 0, np.diff(b, prepend=-1) != 0
    at = np.flatnonzero(a_turn | b_turn)
    group = np.cumsum((a_turn & b_turn)[at]) - 1  # of each overlap
    pair_a, pair_b = a[at], b[at]
    group_a, group_b = np.zeros(len(a_sizes), np.int64), np.zeros(len(b_sizes), np.int64)
    group_a[pair_a], group_b[pair_b] = group, group
    return Aligned(pair_a, pair_b, group_a, group_b)


def _decimals(most: int) -> np.ndarray:
    """Rows of digits for each id, filled with zero bytes; the last place is for the mark behind the id."""
    digits = np.char.mod("%d", np.arange(most)).astype("S")
    return np.concatenate([digits.view(np.uint8).reshape(most, -1), np.zeros((most, 1), np.uint8)], axis=1)


def group_text(a_ids: np.ndarray, b_ids: np.ndarray, own: Aligned, a_digits: np.ndarray, b_digits: np.ndarray) -> np.ndarray:
    """Bytes of `a1,a2|b1;a3|b2;` - ids of A and B by group, each group closed - padded with zero bytes, one row a token."""
    wide = max(a_digits.shape[1], b_digits.shape[1])
    out = np.zeros((len(a_ids) + len(b_ids), wide), np.uint8)
    a_at = np.arange(len(a_ids)) + np.searchsorted(own.group_b, own.group_a, side="left")
    b_at = np.arange(len(b_ids)) + np.searchsorted(own.group_a, own.group_b, side="right")
    out[a_at, : a_digits.shape[1]] = a_digits[a_ids]
    out[b_at, : b_digits.shape[1]] = b_digits[b_ids]
    out[a_at, -1] = np.where(np.diff(own.group_a, append=-1) != 0, ord("|"), ord(","))
    out[b_at, -1] = np.where(np.diff(own.group_b, append=-1) != 0, ord(";"), ord(","))
    return out


# --- the two tokenizers in one worker ----------------------------------------------------------------------------


#: What a chunk adds to its text: tokens of A, tokens of B, groups, its groups' text (closed by ';'), its overlaps as 32-bit codes
#: (id of A * size of B's vocabulary + id of B), and whether both token runs join to the chunk.
Chunk = tuple[int, int, int, bytes, bytes, bool]
_UNEQUAL: Chunk = (0, 0, 0, b"", b"", False)


def _joined(ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The bytes of a token run."""
    own = sizes[ids]
    return flat[np.repeat(starts[ids] - np.cumsum(own) + own, own) + np.arange(int(own.sum()))]


class Pairer:
    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        to_byte = {c: b for b, c in byte_characters().items()}
        a_vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(a_vocab.values()) + 1)
        for token, i in a_vocab.items():
            self.a_bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        if len(self.a_bytes) * len(pieces) >= 1 << 31:
            raise ValueError("pair codes are 32-bit numbers: the product of both vocabularies' sizes is too large")
        self.b_size, self.b_blank = len(pieces), self.b.piece_to_id(_BLANK)
        with open(a_path, encoding="utf-8") as f:
            plain = json.load(f)["normalizer"] is None
        # A piece may hold blanks at its start only, and nothing may be rewritten before the split, else texts stay in one chunk.
        self.splits = plain and not any(_BLANK in p.lstrip(_BLANK) for p in pieces) and self.b.encode("a  b") == self.b.encode("a") + self.b.encode(" b")
        self.a_sizes = np.fromiter(map(len, self.a_bytes), np.int64, len(self.a_bytes))
        self.b_sizes = np.fromiter(map(len, self.b_bytes), np.int64, len(self.b_bytes))
        self.a_flat, self.b_flat = (np.frombuffer(b"".join(x), np.uint8) for x in (self.a_bytes, self.b_bytes))
        self.a_starts, self.b_starts = (np.cumsum(x) - x for x in (self.a_sizes, self.b_sizes))
        self.a_digits, self.b_digits = _decimals(len(self.a_bytes)), _decimals(self.b_size)
        self.young: dict[str, Chunk] = {}
        self.old: dict[str, Chunk] = {}
        self.held = 0

    def chunks(self, text: str) -> list[str]:
        """Pieces of the blank and the text; each begins with a blank."""
        return _CHUNK.split(" " + text) if self.splits else [" " + text]

    def _b_ids(self, chunks: list[str]) -> list[list[int]]:
        """B puts a blank before what it encodes, so each chunk goes without its own; nothing is left of a single blank."""
        got = self.b.encode([c[1:] for c in chunks], num_threads=1)
        return [ids if len(c) > 1 else [self.b_blank] for c, ids in zip(chunks, got)]

    def _a_ids(self, chunks: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A for all chunks, and how many each has. Chunks are encoded several at a time, up to one that ends in white space, since the next one's blank would join it."""
        runs, run, held = [], [], 0
        for c in chunks:
            run.append(c)
            held += len(c)
            if held > RUN or c[-1].isspace():
                runs.append("".join(run))
                run, held = [], 0
        runs.append("".join(run))
        ids = [e.ids for e in self.a.encode_batch_fast(runs, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))
        ends, wanted = np.cumsum(self.a_sizes[flat]), np.cumsum(sizes)
        last = np.searchsorted(ends, wanted)
        if len(ends) and ends[-1] == wanted[-1] and np.array_equal(ends[last], wanted):
            return flat, np.diff(last + 1, prepend=0)
        ids = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids))), np.fromiter(map(len, ids), np.int64, len(ids))

    def _aligned(self, chunks: list[str]) -> list[Chunk]:
        """All chunks in one run of bytes: both tokenizers have a cut at each chunk's end."""
        b_ids = self._b_ids(chunks)
        raw = [c.encode() for c in chunks]
        b_many, sizes = (np.fromiter(map(len, x), np.int64, len(chunks)) for x in (b_ids, raw))
        a, a_many = self._a_ids(chunks, sizes)
        b = np.fromiter(chain.from_iterable(b_ids), np.int64, int(b_many.sum()))
        out, given = [_UNEQUAL] * len(chunks), np.frombuffer(b"".join(raw), np.uint8)
        whole = np.ones(len(chunks), bool)
        for ids, many, lengths, starts, flat in ((a, a_many, self.a_sizes, self.a_starts, self.a_flat), (b, b_many, self.b_sizes, self.b_starts, self.b_flat)):
            total = np.add.reduceat(lengths[ids], np.cumsum(many) - many)
            fits = total == sizes
            if fits.all() and np.array_equal(_joined(ids, lengths, starts, flat), given):
                continue
            at, to = np.cumsum(total) - total, np.cumsum(sizes) - sizes
            joined = _joined(ids, lengths, starts, flat)
            whole &= [bool(f) and np.array_equal(joined[i : i + n], given[j : j + n]) for f, i, j, n in zip(fits, at.tolist(), to.tolist(), sizes.tolist())]
        good = np.flatnonzero(whole)
        if not len(good):
            return out
        a, b = a[np.repeat(whole, a_many)], b[np.repeat(whole, b_many)]
        a_many, b_many = a_many[good], b_many[good]
        own = align(self.a_sizes[a], self.b_sizes[b])
        codes = (a[own.a] * self.b_size + b[own.b]).astype(np.uint32)
        text = group_text(a, b, own, self.a_digits, self.b_digits)
        filled = np.cumsum(np.count_nonzero(text, axis=1))
        packed = text.ravel()
        packed = packed[packed != 0].tobytes()
        a_end, b_end = np.cumsum(a_many), np.cumsum(b_many)
        pair_end = np.searchsorted(own.a, a_end, side="left")
        text_end, group_end = filled[a_end + b_end - 1], own.group_a[a_end - 1] + 1
        text_at, pair_at = text_end - np.diff(text_end, prepend=0), 4 * (pair_end - np.diff(pair_end, prepend=0))
        packed_codes = codes.tobytes()
        values = (a_many, b_many, np.diff(group_end, prepend=0), text_at, text_end, pair_at, 4 * pair_end)
        for k, n_a, n_b, n_groups, t, te, p, pe in zip(good.tolist(), *(v.tolist() for v in values)):
            out[k] = (n_a, n_b, n_groups, packed[t:te], packed_codes[p:pe], True)
        return out

    def _keep(self, chunk: str, got: Chunk) -> None:
        self.young[chunk] = got
        self.held += len(chunk) + len(got[3]) + len(got[4]) + ENTRY_BYTES
        if self.held > CACHE_BYTES // 2:
            self.young, self.old, self.held = {}, self.young, 0

    def _learn(self, needed: set[str]) -> dict[str, Chunk]:
        out, new = {}, []
        for chunk in needed:
            got = self.young.get(chunk)
            if got is None and (got := self.old.get(chunk)) is not None:
                self._keep(chunk, got)
            if got is None:
                new.append(chunk)
            else:
                out[chunk] = got
        for chunk, got in zip(new, self._aligned(new) if new else []):
            out[chunk] = got
            if len(chunk) <= LONG_CHUNK:
                self._keep(chunk, got)
        return out

    def rows(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """Of each text: tokens of A, of B, groups, links, digest, distinct pair codes and how often each occurs."""
        split = [self.chunks(t) if t else [] for t in texts]
        known = self._learn(set().union(*split))
        none = np.zeros(0, np.int32)
        for chunks in split:
            a, b, groups, texts_, pairs_, whole = zip(*[known[c] for c in chunks]) if chunks else ((),) * 6
            if not chunks or not all(whole):
                yield 0, 0, 0, 0, "", none, none
                continue
            codes = np.frombuffer(b"".join(pairs_), np.uint32)
            pairs, times = np.unique(codes, return_counts=True)
            digest = hashlib.sha256(memoryview(b"".join(texts_))[:-1]).hexdigest()
            yield sum(a), sum(b), sum(groups), len(codes), digest, pairs.astype(np.int32), times.astype(np.int32)


def vocabulary_size(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


@lru_cache(maxsize=1)
def pairer(a_path: str, b_path: str) -> Pairer:
    return Pairer(a_path, b_path)


# --- on Spark ----------------------------------------------------------------------------------------------------


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    import public_tokenizers

    return a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)


def linked(docs: DataFrame, ident: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and `pairs` and `times`: the distinct pair codes of a text and their numbers."""
    a_path, b_path = _paths(a_path, b_path)
    kind = docs.schema[ident].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pairer(a_path, b_path)
        for batch in batches:
            at = 0
            for some in parts(iter([batch.column(1)])):
                found = list(zip(*own.rows(some.to_pylist())))
                ends = np.cumsum([0, *map(len, found[5])]).astype(np.int32)
                flat = [pa.array(np.concatenate(c), pa.int32()) for c in found[5:]]
                lists = [pa.ListArray.from_arrays(pa.array(ends), v) for v in flat]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(some)), *[pa.array(c, pa.int64()) for c in found[:4]], pa.array(found[4], pa.string()), *lists],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )
                at += len(some)

    shape = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"
    return docs.select(ident, text).mapInArrow(work, shape)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in the shared checkpoint folder, read back."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pair_counts(links: DataFrame, b_size: int) -> DataFrame:
    """pair, held (documents that hold it), best (no other pair of its A id is held by more)."""
    counts = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("held")).withColumn("a_id", F.expr(f"pair div {b_size}"))
    counts = cut(counts)
    # One row for each id of A's vocabulary at most.
    highest = counts.groupBy("a_id").agg(F.max("held").alias("highest"))
    return counts.join(F.broadcast(highest), "a_id").select("pair", "held", (F.col("held") == F.col("highest")).alias("best"))


def hot_threshold(counts: DataFrame, most: int = HOT) -> int:
    """Least power of two that at most so many pairs reach."""
    sizes = {r["size"]: r["many"] for r in counts.groupBy(F.length(F.bin("held")).alias("size")).agg(F.count(F.lit(1)).alias("many")).collect()}
    total, size = 0, max(sizes, default=0) + 1
    while size > 1 and total + sizes.get(size - 1, 0) <= most:
        size -= 1
        total += sizes.get(size, 0)
    return 1 << (size - 1)


def scored(links: DataFrame, b_size: int, most: int = HOT) -> DataFrame:
    """links with n_best and count_sum, without the pairs."""
    spark = links.sparkSession
    counts = cut(pair_counts(links, b_size))
    least = hot_threshold(counts, most)
    hot = counts.where(F.col("held") >= least).orderBy("pair").toArrow()
    # The code -1, which no pair has, keeps the arrays from being empty.
    known = spark.sparkContext.broadcast(tuple(np.append(v, hot.column(c).to_numpy()).astype(t) for c, v, t in (("pair", -1, np.int32), ("held", 0, np.int64), ("best", 0, np.int8))))
    plain = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held, best = known.value
        for batch in batches:
            ends = np.cumsum(np.append(0, batch.column("pairs").value_lengths().to_numpy(zero_copy_only=False)))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + LOOKED_UP, side="right")) - 1)
                some, own = batch.slice(at, to - at), ends[at : to + 1] - ends[at]
                codes, times = (some.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
                place = np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)
                hit = pairs[place] == codes
                sums = [np.append(0, np.cumsum(np.where(hit, value[place] * times.astype(np.int64), 0))) for value in (best, held)]
                cold = np.append(0, np.cumsum(~hit))[own].astype(np.int32)
                rest = [pa.ListArray.from_arrays(pa.array(cold), pa.array(v[~hit], pa.int32())) for v in (codes, times)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(c) for c in ("row", "doc_id", *plain)] + [pa.array(np.diff(v[own]), pa.int64()) for v in sums] + rest,
                    names=["row", "doc_id", *plain, "n_best", "count_sum", "cold", "times"],
                )
                at = to

    kind = links.schema["doc_id"].dataType.simpleString()
    shape = f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, cold array<int>, times array<int>"
    found = links.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", *plain, "pairs", "times").mapInArrow(look_up, shape)
    if least == 1:  # every pair is among the hot ones
        return found.select("doc_id", *plain, "n_best", "count_sum")
    found = written(found, "alignment")
    rare = found.where(F.size("cold") > 0).select("row", F.explode(F.arrays_zip("cold", "times")).alias("one")).select("row", F.col("one.cold").alias("pair"), F.col("one.times").alias("times"))
    more = rare.join(counts.where(F.col("held") < least), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("held") * F.col("times")).alias("more_sum"))
    whole = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).cast("long").alias(a)
    return found.join(more, "row", "left").select("doc_id", *plain, whole("n_best", "more_best"), whole("count_sum", "more_sum"))


def aligned(docs: DataFrame, ident: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None, most: int = HOT) -> DataFrame:
    """A row for each document: tokens, groups, links, and how its links stand in the counts of the whole table."""
    paths = _paths(a_path, b_path)
    links = written(linked(docs, ident, text, *paths), "alignment")
    return scored(links, vocabulary_size(paths[1]), most)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text of documents."""
    return aligned(table(spark, sf_dir, "documents")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
