"""LM scoring with a probabilistic suffix tree over words.

Symbols are the tokens of the base score: lower-cased words, the end of a text, and one event for all words that
training lacks. A context is the words just before a symbol, DEPTH at most, with a mark before the first word. A
context is a state of the tree when training predicts from it at least LEAST times and it passes the divergence test:
with every occurrence left out in turn, its next-symbol distribution predicts that occurrence better than the longest
shorter state does, by more than DIVERGENCE nats in sum. A state's distribution is discounted and smoothed towards that
of the longest shorter state, the root towards the one unknown event; each symbol is scored by the longest state that is
a suffix of its context. Probabilities of the words of training and the unknown event sum to one in every state.

No task and no driver holds the tree. Documents are written once as blocks, in a table bucketed by block, which later
passes read without a shuffle. In the pass of each level a block sends its distinct (context, symbol) pairs with their
counts to buckets of contexts; buckets sum them, test the contexts and answer each block what it asked, in its order.
Only contexts that the level before has seen LEAST times go on to the next. A context with more than HOT predictions is
dealt to several buckets by its symbols, whose parts of the test are summed afterwards. From the second level on, symbols
that the context one word shorter has seen once at most are pooled: they give their whole count to the shorter state.

Words and contexts are told apart by 64-bit hashes, the symbols after one context by 28 bits. In the divergence test a
shorter state's probability is rounded to an eighth of a nat, and what a hot context leaves to the shorter state is
taken as that of a part times the parts.

Cases: a null text is the empty one, which is only its end; without training documents all words are unknown and have
probability 1; rows without an id, ties and repeated rows are documents of their own; an empty table gives no rows; a
text longer than BLOCK is a block alone; columns other than doc_id, text and train are never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulary.llm.common import crc_mod, cut, ensure_checkpoint_dir, partitions, table, text_of

#: Words of a context at most; least predictions of a state; nats by which it must predict better; discount of a count.
DEPTH, LEAST, DIVERGENCE, DISCOUNT = 2, 2, 2.0, 0.75
#: Bytes of text in a block, bytes of all texts for each bucket, predictions from which on a context is dealt out.
BLOCK, BUCKET, HOT = 14_000_000, 8_000_000, 200_000
#: Nats between two steps of a rounded probability.
STEP = 0.125
_U = np.uint64
_END, _START = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
#: The symbol of unknown words and of those that are pooled.
_POOLED = np.uint32(0)
_FACTOR = 0x5851F42D4C957F2D
_PART = 1_000_000


class Facts(NamedTuple):
    """Of the training tokens: how many, how many different ones, how many ends, and the root's discount."""

    total: int
    distinct: int
    ends: int
    discount: float


# -- words as numbers ------------------------------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the bytes, A to Z as their small letters; which bytes are white space."""
    value = np.random.default_rng(42).integers(0, 2**64, 256, np.uint64)
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return value, space


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of a factor and of its inverse."""
    steps = [np.full(n, factor, np.uint64) for factor in (_FACTOR, pow(_FACTOR, -1, 2**64))]
    for s in steps:
        s[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(steps[0]), np.cumprod(steps[1])


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each with its end, and the number of tokens of each text."""
    value, space = _tables()
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space[raw], [True]]).view(np.int8)))
    first, last = edges[::2], edges[1::2]
    up, down = _powers(max(_PART, 1 << int(len(raw)).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[raw] * up[: len(raw)])])
        words = mixed((sums[last] - sums[first]) * down[first])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    owner = np.searchsorted(np.cumsum(sizes), first, side="right")
    many = np.bincount(owner, minlength=len(texts)) + 1
    out = np.full(int(many.sum()), _END, np.uint64)
    out[np.arange(len(words)) + owner] = words
    return out, many


def tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """As _hashed, for an Arrow column, a part of it at a time."""
    found, held, size = [], [], 0
    for at in range(0, len(texts), 200):
        for text in texts.slice(at, 200).to_pylist():
            raw = text.encode()
            if held and size + len(raw) > _PART:
                found.append(_hashed(held))
                held, size = [], 0
            held.append(raw)
            size += len(raw)
    if held:
        found.append(_hashed(held))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


# -- arrays that travel ----------------------------------------------------------------------------------------------


def _code(a: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on, compressed."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _decode(code: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(code, n * size, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def _rising(a: np.ndarray) -> bytes:
    return _code(np.diff(a, prepend=_U(0)))


_ASKED = "bucket int, block long, n int, groups int, keys binary, runs binary, symbols binary, counts binary, short binary, hot binary"
_TOLD = "block long, level int, bucket int, n int, groups int, counts binary, states binary, hot array<struct<c:long,g:long,gain:double,left:long>>"
_HOT = pa.list_(pa.struct([("c", pa.int64()), ("g", pa.int64()), ("gain", pa.float64()), ("left", pa.int64())]))
_HOT_ROW = np.dtype([("at", np.uint32), ("c", np.uint64), ("total", np.uint64)])


# -- a block ---------------------------------------------------------------------------------------------------------


class Block:
    """The tokens of some documents, and what the levels so far say of each position."""

    def __init__(self, docs: pa.Table) -> None:
        self.words, self.sizes = tokens(docs["text"])
        self.train = np.repeat(np.array(docs["train"].to_pylist(), bool), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known, self.at = np.unique(self.words, return_inverse=True)

    def ask(self, bits: int) -> Iterator[dict]:
        """Level 0: the distinct words with their counts in training, by the leading bits."""
        counts = np.bincount(self.at, self.train, len(self.known)).astype(np.uint64)
        for bucket, a, b in _spans(self.known, bits):
            yield {"bucket": bucket, "n": b - a, "groups": 0, "keys": _rising(self.known[a:b]), "counts": _code(counts[a:b])}

    def root(self, counts: np.ndarray, facts: Facts) -> None:
        """What level 0 told: the count of each distinct word."""
        self.count = counts[self.at].astype(np.int64)
        n = max(facts.total, 1)
        unknown = facts.discount * facts.distinct / n if facts.total else 1.0
        self.p = np.where(self.count > 0, (self.count - facts.discount) / n, unknown)
        self.symbol = np.where(self.count > 0, np.maximum((self.words >> _U(36)).astype(np.uint32), 1), _POOLED)
        self.context = np.concatenate([np.array([_START]), self.words[:-1]])
        self.context[self.starts] = _START
        self.total = np.concatenate([[0], self.count[:-1]])
        self.total[self.starts] = facts.ends

    def pairs(self) -> None:
        """The distinct pairs of a group and a symbol at the open positions. A group is a context, or a part of a hot one."""
        self.open = np.flatnonzero(self.total >= LEAST)
        c, s = self.context[self.open], self.symbol[self.open]
        parts = (-(-self.total[self.open] // HOT)).astype(np.uint64)
        self.is_hot = parts > 1
        with np.errstate(over="ignore"):
            dealt = mixed(c + (s % parts + _U(1)) * _END)
        self.groups, nth = np.unique(np.where(self.is_hot, dealt, c), return_inverse=True)
        self.keys, self.pair = np.unique((nth.astype(np.uint64) << _U(32)) | s, return_inverse=True)
        self.group = nth

    def ask_pairs(self, bits: int) -> Iterator[dict]:
        self.pairs()
        owner = (self.keys >> _U(32)).astype(np.int64)
        symbols = (self.keys & _U(0xFFFFFFFF)).astype(np.uint32)
        counts = np.bincount(self.pair, self.train[self.open], len(self.keys)).astype(np.uint64)
        short = np.zeros(len(self.keys), np.uint8)
        short[self.pair] = np.clip(np.rint(-np.log(self.p[self.open]) / STEP), 0, 255)
        runs = np.bincount(owner, minlength=len(self.groups)).astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum(runs, dtype=np.int64)])
        hot = np.zeros(len(self.groups), _HOT_ROW)
        of = self.group[self.is_hot]
        hot["c"][of], hot["total"][of] = self.context[self.open][self.is_hot], self.total[self.open][self.is_hot]
        for bucket, a, b in _spans(self.groups, bits):
            i, j = ends[a], ends[b]
            mine = hot[a:b]
            mine["at"] = np.arange(b - a)
            yield {
                "bucket": bucket, "n": int(j - i), "groups": b - a, "keys": _rising(self.groups[a:b]), "runs": _code(runs[a:b]), "symbols": _code(symbols[i:j]),
                "counts": _code(counts[i:j]), "short": _code(short[i:j]), "hot": mine[mine["total"] > 0].tobytes(),
            }

    def climb(self, counts: np.ndarray, states: np.ndarray, hot: dict[int, int]) -> None:
        """What a level told: the count of each pair, and of each group twice what it leaves to the shorter state, in quarters, plus 1 if it is a state."""
        self.pairs()
        state = states[self.group].astype(np.int64)
        if self.is_hot.any():
            c = self.context[self.open][self.is_hot]
            own, nth = np.unique(c, return_inverse=True)
            state[self.is_hot] = np.array([hot[x] for x in own.view(np.int64).tolist()], np.int64)[nth]
        n = counts[self.pair].astype(np.int64)
        p = self.p[self.open]
        smooth = (np.maximum(n - DISCOUNT, 0) + (state >> 1) / 4 * p) / self.total[self.open]
        self.p[self.open] = np.where(state & 1, smooth, p)
        seen = np.zeros(len(self.words), np.int64)
        seen[self.open] = n
        self.symbol = np.where(seen > 1, self.symbol, _POOLED)
        with np.errstate(over="ignore"):
            longer = mixed(self.context * _U(_FACTOR) ^ self.words)
        self.context[1:], self.total[1:] = longer[:-1], seen[:-1]
        self.total[self.starts] = 0


def _spans(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, first place, end) of the sorted keys that share the leading bits."""
    bucket = (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    new = np.flatnonzero(np.diff(bucket, prepend=-1))
    yield from zip(bucket[new].tolist(), new.tolist(), [*new[1:].tolist(), len(keys)])


def _restored(docs: pa.Table, told: pa.Table | None, facts: Facts | None, levels: int) -> Block:
    block = Block(docs)
    rows = told.sort_by([("level", "ascending"), ("bucket", "ascending")]).to_pylist() if told is not None else []
    for level in range(levels):
        mine = [r for r in rows if r["level"] == level]
        join = lambda made: np.concatenate(made) if made else np.zeros(0, np.uint64)
        counts = join([_decode(r["counts"], r["n"], np.uint64) for r in mine if r["bucket"] >= 0])
        if level == 0:
            block.root(counts, facts)
            continue
        states = join([_decode(r["states"], r["groups"], np.uint64) for r in mine if r["bucket"] >= 0])
        block.climb(counts, states, {h["c"]: h["left"] for r in mine if r["bucket"] < 0 for h in r["hot"]})
    return block


def _asked(rows: Iterator[dict], block: int) -> pa.Table:
    kinds = {"bucket": pa.int32(), "block": pa.int64(), "n": pa.int32(), "groups": pa.int32()} | {k: pa.binary() for k in ("keys", "runs", "symbols", "counts", "short", "hot")}
    return pa.Table.from_pylist([r | {"block": block} for r in rows], pa.schema(kinds))


# -- a bucket --------------------------------------------------------------------------------------------------------


def _rows(asked: pa.Table) -> list[dict]:
    return asked.sort_by("block").to_pylist()


def _count_words(asked: pa.Table) -> pa.Table:
    """Level 0: sums the counts of each word; the first row also tells of the bucket's words."""
    rows = _rows(asked)
    keys = np.concatenate([np.cumsum(_decode(r["keys"], r["n"], np.uint64), dtype=np.uint64) for r in rows])
    counts = np.concatenate([_decode(r["counts"], r["n"], np.uint64) for r in rows])
    words, nth = np.unique(keys, return_inverse=True)
    sums = np.bincount(nth, counts, len(words)).astype(np.uint64)
    told, ends = [], np.cumsum([r["n"] for r in rows])
    for r, end in zip(rows, ends.tolist()):
        told.append({"block": r["block"], "bucket": r["bucket"], "n": r["n"], "counts": _code(sums[nth[end - r["n"] : end]])})
    facts = {"total": int(sums.sum()), "distinct": int((sums > 0).sum()), "once": int((sums == 1).sum()), "twice": int((sums == 2).sum()), "ends": int(sums[words == _END].sum())}
    told[0] |= facts
    kinds = {"block": pa.int64(), "bucket": pa.int32(), "n": pa.int32(), "counts": pa.binary()} | {k: pa.int64() for k in facts}
    return pa.Table.from_pylist(told, pa.schema(kinds))


def _test_contexts(asked: pa.Table, level: int) -> pa.Table:
    """A later level: sums the counts of each pair and tests each context; parts of hot contexts are only reported."""
    rows = _rows(asked)
    own = [np.cumsum(_decode(r["keys"], r["groups"], np.uint64), dtype=np.uint64) for r in rows]
    groups, nth = np.unique(np.concatenate(own), return_inverse=True)
    runs = np.concatenate([_decode(r["runs"], r["groups"], np.uint32) for r in rows])
    symbols = np.concatenate([_decode(r["symbols"], r["n"], np.uint32) for r in rows])
    keys, pair = np.unique((np.repeat(nth, runs).astype(np.uint64) << _U(32)) | symbols, return_inverse=True)
    n = np.bincount(pair, np.concatenate([_decode(r["counts"], r["n"], np.uint64) for r in rows]), len(keys))
    short = np.zeros(len(keys))
    short[pair] = np.exp(-STEP * np.concatenate([_decode(r["short"], r["n"], np.uint8) for r in rows]))
    of = (keys >> _U(32)).astype(np.int64)
    total, parts = np.bincount(of, n, len(groups)), np.ones(len(groups))
    context = np.zeros(len(groups), np.uint64)
    at, ends = 0, []
    for r, mine in zip(rows, own):
        hot = np.frombuffer(r["hot"], _HOT_ROW)
        where = nth[at + hot["at"].astype(np.int64)]
        total[where], context[where] = hot["total"], hot["c"]
        parts[where] = -(-hot["total"].astype(np.int64) // HOT)
        ends.append((at, at := at + len(mine)))
    pooled = (keys & _U(0xFFFFFFFF)) == _POOLED
    left = np.bincount(of, np.where(pooled, n, DISCOUNT * (n > 0)), len(groups))
    gain = np.bincount(of, _left_out(n, pooled, short, (left * parts)[of], total[of]), len(groups))
    states = np.where(parts > 1, 0, left * 8 + (gain > DIVERGENCE)).astype(np.uint64)
    n = np.where(pooled, 0, n)
    told, done = [], 0
    for r, (a, b) in zip(rows, ends):
        mine = nth[a:b][parts[nth[a:b]] > 1]
        hot = [{"c": c, "g": g, "gain": w, "left": k} for c, g, w, k in zip(context[mine].view(np.int64).tolist(), groups[mine].view(np.int64).tolist(), gain[mine].tolist(), (left[mine] * 4).astype(np.int64).tolist())]
        told.append({"block": r["block"], "level": level, "bucket": r["bucket"], "n": r["n"], "groups": r["groups"], "counts": _code(n[pair[done : done + r["n"]]].astype(np.uint64)), "states": _code(states[nth[a:b]]), "hot": hot})
        done += r["n"]
    kinds_ = {"block": pa.int64(), "level": pa.int32(), "bucket": pa.int32(), "n": pa.int32(), "groups": pa.int32(), "counts": pa.binary(), "states": pa.binary(), "hot": _HOT}
    return pa.Table.from_pylist(told, pa.schema(kinds_))


def _left_out(n: np.ndarray, pooled: np.ndarray, short: np.ndarray, left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Nats by which a context predicts its n occurrences of a symbol better than the shorter state does, each one left out in turn."""
    kept = np.where(pooled | (n < 2), 0, n - 1 - DISCOUNT)
    left = left - np.where(pooled, 1, DISCOUNT * (n == 1))
    p = (kept + left * short) / np.maximum(total - 1, 1)
    return np.where(n > 0, n * np.log(np.maximum(p, 1e-300) / short), 0.0)


# -- the corpus ------------------------------------------------------------------------------------------------------


def _blocks(docs: DataFrame) -> DataFrame:
    """The documents with their block, in a table in the shared folder, bucketed by block."""
    spark = docs.sparkSession

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
            at = done = 0
            while at < len(batch):
                to = max(at + (held == 0), int(np.searchsorted(ends, done + BLOCK - held, side="right")))
                if to > at:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(to - at, block)), *batch.slice(at, to - at).columns], names=["block", *batch.schema.names])
                    held += int(ends[to - 1]) - done
                    at, done = to, int(ends[to - 1])
                if at < len(batch):
                    block, held = block + 1, 0

    ensure_checkpoint_dir(spark)
    name = f"suffix_tree_{uuid.uuid4().hex}"
    made = docs.mapInArrow(deal, "block long, doc_id long, text string, train boolean")
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}"
    made.write.bucketBy(partitions(spark), "block").option("compression", "zstd").saveAsTable(name, format="parquet", path=path)
    return spark.table(name)


def _hot_states(told: DataFrame, level: int) -> DataFrame:
    """For each block, the hot contexts that it asked for, their parts summed up."""
    seen = told.select("block", F.explode("hot").alias("h")).select("block", "h.*")
    whole = seen.select("c", "g", "gain", "left").distinct().groupBy("c").agg(F.sum("gain").alias("gain"), F.sum("left").alias("k"))
    state = whole.select("c", (F.col("k") * 2 + (F.col("gain") > DIVERGENCE).cast("long")).alias("state"))
    asked = seen.select("block", "c").distinct().join(state, "c")
    one = F.struct("c", F.lit(0).cast("long").alias("g"), F.lit(0.0).alias("gain"), F.col("state").alias("left"))
    none = F.lit(None).cast("binary")
    return asked.groupBy("block").agg(F.collect_list(one).alias("hot")).select(
        "block", F.lit(level).alias("level"), F.lit(-1).alias("bucket"), F.lit(0).alias("n"), F.lit(0).alias("groups"), none.alias("counts"), none.alias("states"), "hot"
    )


def _asking(facts: Facts, level: int, bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda docs, told: _asked(_restored(docs, told, facts, level).ask_pairs(bits), docs["block"][0].as_py())


def _answering(level: int) -> Callable[[pa.Table], pa.Table]:
    return lambda asked: _test_contexts(asked, level)


def score_documents(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """docs: doc_id LONG, text and train. Scores every document by the tree of contexts up to `depth` words learned from those marked train."""
    blocks = _blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.coalesce("train", F.lit(False)).alias("train")))
    size = blocks.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(0, (size // BUCKET).bit_length())
    by_block = blocks.groupBy("block")
    asked = by_block.applyInArrow(lambda d: _asked(Block(d).ask(bits), d["block"][0].as_py()), _ASKED)
    words = cut(asked.groupBy("bucket").applyInArrow(_count_words, "block long, bucket int, n int, counts binary, total long, distinct long, once long, twice long, ends long"))
    sums = words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "distinct", "once", "twice", "ends")]).first()
    total, distinct, once, twice, ends = sums
    facts = Facts(total, distinct, ends, min(0.95, max(0.05, once / max(1, once + 2 * twice))))
    none = F.lit(None).cast("binary")
    told = words.select("block", F.lit(0).alias("level"), "bucket", "n", F.lit(0).alias("groups"), "counts", none.alias("states"), F.array().cast(_TOLD.split(" hot ")[1]).alias("hot"))
    for level in range(1, depth + 1):
        asked = by_block.cogroup(told.groupBy("block")).applyInArrow(_asking(facts, level, bits), _ASKED)
        answers = cut(asked.groupBy("bucket").applyInArrow(_answering(level), _TOLD))
        told = told.unionByName(answers.withColumn("hot", F.array().cast(_TOLD.split(" hot ")[1]))).unionByName(_hot_states(answers, level))

    def score(d: pa.Table, t: pa.Table) -> pa.Table:
        block = _restored(d, t, facts, depth + 1)
        by_doc = lambda x: np.add.reduceat(x, block.starts)
        base = by_doc(np.log10(block.count + 1.0)) - block.sizes * np.log10(facts.total + facts.distinct + 1.0)
        train = d["train"].to_pylist()
        return pa.table(
            {
                "doc_id": d["doc_id"].cast(pa.int64()),
                "held_out": pa.array([not x for x in train], pa.bool_()),
                "n_tokens": pa.array(block.sizes, pa.int64()),
                "n_known": pa.array(by_doc((block.count > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(train), facts.total), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(by_doc(np.log10(block.p)), pa.float64()),
            }
        )

    return by_block.cogroup(told.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and tree score of every whole text of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("train", crc_mod("doc_id", 7) != 2)
    return score_documents(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
