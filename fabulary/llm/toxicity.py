"""Toxicity: a bag of subwords, its embeddings averaged into a linear softmax, trained jointly in numpy.

A text is lower-cased and cut into words (runs of letters and digits). Its features are the words and their character
n-grams with the word's bounds, each hashed to a row of one embedding table, so a misspelling that was never seen shares
most of its vectors with the word that was. Features are averaged over passages of 48 characters that overlap by half and cover
the whole text, since one insult would drown in an average over 20,000 words; the softmax is applied to each
average, and the most toxic passage is the document's. Embeddings and softmax are trained together: the error at that
passage moves the softmax by the average and every feature's vector by the softmax. Scoring runs inside an Arrow UDF with
one number for each row of the table, its part of the softmax.

Fitting uses a bounded sample: for each mark at most SAMPLE_ROWS labelled rows and SAMPLE_BYTES of their texts, in the
order of a hash of the id, taken to the driver. Only text is ever an input.

Cases: a null text is the empty one; a text without a letter or digit has no feature, and its score is that of the bias, 0.12; ties
between passages go to the first; labels of one id that differ count as toxic, null marks are left out; without labelled
rows of both marks the score is 0.5 everywhere (`predicted` 1); a null id counts as the empty text and is held out; repeated rows pass
through one to one; an empty table gives no rows; an output column replaces an input column of the same name, others are
kept; a text of more than PIECE characters is looked at in pieces, cut at white space and overlapping by a passage, so
its memory doesn't grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulary.llm.common import crc_mod, parts, table, text_of

SAMPLE_ROWS, SAMPLE_BYTES = 3_000, 5_000_000
GRAMS, BITS, WIDTH = (3, 4, 5, 6), 17, 8
HALF = 24  # characters in half a passage
ROUNDS, BATCH, RATE, DROPPED, SEED = 12, 64, 0.5, 1 / 3, 23
#: Logit of a text without features. The bias stays there, so nothing but what a text says can make it toxic.
EMPTY = -2.0
#: Bytes of the texts that one pass looks at, and characters of a piece of a long text.
_PASS, PIECE = 200_000, 100_000
_BASE, _ODD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_WORD: np.ndarray | None = None


def _is_word() -> np.ndarray:
    global _WORD
    if _WORD is None:
        _WORD = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _WORD


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Bag:
    """Texts as features: rows of the table, by half passage, by text."""

    buckets: np.ndarray
    counts: np.ndarray  # features of each half
    first: np.ndarray  # first half of each text
    halves: np.ndarray  # halves of each text


def bag(texts: list[str]) -> Bag:
    lowered = [t.lower() for t in texts]
    raw = "\0" + "\0".join(lowered) + "\0"
    c = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _is_word()[c]
    # A run of other characters becomes one bound; a text begins with a bound of its own.
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    starts = np.cumsum(sizes + 1) - sizes - 1
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[starts] = True
    keep[-1] = True
    at = np.flatnonzero(keep)
    code = np.where(word[at], c[at].astype(np.uint64) + np.uint64(1), np.uint64(0))
    begin = np.searchsorted(at, starts)
    length = np.diff(np.append(begin, len(at) - 1))
    halves = np.maximum(-(-length // HALF), 1)
    first = np.cumsum(halves) - halves
    place = np.arange(len(at) - 1)
    half = np.repeat(first, length) + (place - np.repeat(begin, length)) // HALF
    inner = np.append(0, np.cumsum(code == 0))  # bounds before each place
    rows, owner = [], []
    h = code
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * _BASE + code[n - 1 :]
        if n in GRAMS:
            i = np.flatnonzero(inner[n - 1 :][: len(h)] == inner[1 : len(h) + 1])  # no bound strictly inside
            rows.append(_bucket(h[i]))
            owner.append(half[i])
    # Whole words: differences of one running sum of code * base^place, brought to a common power by the next factor.
    bounds = np.flatnonzero(code == 0)
    a, b = bounds[:-1], bounds[1:]
    a, b = a[b - a > 1] + 1, b[b - a > 1]
    if len(a):
        power = np.multiply.accumulate(np.full(len(code), _BASE))
        inverse = np.multiply.accumulate(np.full(len(code), np.uint64(pow(int(_BASE), -1, 1 << 64))))
        running = np.append(np.uint64(0), np.cumsum(code * power, dtype=np.uint64))
        rows.append(_bucket((running[b] - running[a]) * inverse[a] + np.uint64(7)))
        owner.append(half[a])
    where = np.concatenate(owner)
    order = np.argsort(where, kind="stable")
    return Bag(np.concatenate(rows)[order], np.bincount(where, minlength=int(halves.sum())), first, halves)


def pieces(text: str) -> list[str]:
    """The text, or pieces of it that end after white space where there is some; each begins a passage before the last one's end."""
    out, at = [], 0
    while len(text) - at > PIECE:
        end = max((text.rfind(w, at + PIECE // 2, at + PIECE) for w in " \n\t"), default=-1) + 1 or at + PIECE
        out.append(text[at:end])
        at = end - 2 * HALF
    return [*out, text[at:]]


def _passages(sums: np.ndarray, own: Bag) -> tuple[np.ndarray, np.ndarray]:
    """Average of each passage (a half and the next of its text; the last half alone counts as itself only in a text of one), and its features."""
    total, counts = sums.copy(), own.counts.astype(np.float64)
    last = own.first + own.halves - 1
    joined = np.ones(len(total), bool)
    joined[last] = False
    k = np.flatnonzero(joined)
    count = counts.copy()
    total[k] += sums[k + 1]
    count[k] += counts[k + 1]
    return total / np.maximum(count, 1), count


class SubwordSoftmax:
    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.vectors = ((rng.random((1 << BITS, WIDTH)) - 0.5) / WIDTH).astype(np.float32)
        self.softmax = (rng.standard_normal((WIDTH, 2)) * 0.5).astype(np.float32)
        self.bias = np.array([-EMPTY / 2, EMPTY / 2], np.float32)

    def _parts(self) -> np.ndarray:
        """What each row of the table adds to the logit of toxic against not."""
        return self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])

    def _top(self, own: Bag, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Highest logit of each text, and its passage."""
        ends = np.cumsum(own.counts)
        running = np.append(0.0, np.cumsum(part[own.buckets], dtype=np.float64))
        logits = _passages(running[ends] - running[ends - own.counts], own)[0] + float(self.bias[1] - self.bias[0])
        alone = own.halves == 1
        last = (own.first + own.halves - 1)[~alone]
        logits[last] = -np.inf  # covered by the passage before
        top = np.maximum.reduceat(logits, own.first)
        hits = np.flatnonzero(logits == np.repeat(top, own.halves))
        owner = np.repeat(np.arange(len(own.first)), own.halves)[hits]
        return top, hits[np.searchsorted(owner, np.arange(len(own.first)))]

    def scores(self, texts: list[str], part: np.ndarray | None = None) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        cut = [pieces(t) for t in texts]
        flat, part = [p for own in cut for p in own], self._parts() if part is None else part
        tops, at = [], 0
        while at < len(flat):
            to, size = at + 1, len(flat[at])
            while to < len(flat) and size + len(flat[to]) <= _PASS:
                size, to = size + len(flat[to]), to + 1
            tops.append(self._top(bag(flat[at:to]), part)[0])
            at = to
        many = np.fromiter(map(len, cut), np.int64, len(cut))
        top = np.maximum.reduceat(np.concatenate(tops), np.cumsum(many) - many)
        return 1 / (1 + np.exp(-np.clip(top, -30, 30)))

    def fit(self, texts: list[str], mark: np.ndarray, rounds: int = ROUNDS, seed: int = SEED) -> SubwordSoftmax:
        """Adagrad over shuffled batches, half of them of each mark."""
        if not 0 < mark.sum() < len(mark):
            self.softmax[:], self.bias[:] = 0, 0
            return self
        rng = np.random.default_rng(seed)
        bags = [bag([t]) for t in texts]
        spent_v = np.full(1 << BITS, 1e-4, np.float32)
        spent_w = np.full_like(self.softmax, 1e-2)
        sides = [np.flatnonzero(mark <= 0), np.flatnonzero(mark > 0)]
        steps = rounds * max(16, -(-len(mark) // BATCH))
        queues: list[list[int]] = [[], []]
        for step in range(steps):
            rate = RATE * (1 - step / steps) + RATE / 50
            chosen: list[int] = []
            for side, queue in zip(sides, queues):
                while len(queue) < BATCH // 2:
                    queue += rng.permutation(side).tolist()
                chosen += queue[: BATCH // 2]
                del queue[: BATCH // 2]
            self._step([bags[i] for i in chosen], mark[chosen], rate, spent_v, spent_w, rng)
        return self

    def _step(self, bags: list[Bag], mark: np.ndarray, rate: float, spent_v: np.ndarray, spent_w: np.ndarray, rng: np.random.Generator | None = None) -> None:
        counts = np.concatenate([b.counts for b in bags])
        halves = np.concatenate([b.halves for b in bags])
        own = Bag(np.concatenate([b.buckets for b in bags]), counts, np.cumsum(halves) - halves, halves)
        logit, at = self._top(own, self._parts())
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - mark).astype(np.float32) / len(mark)
        # The features of each text's passage, with the weight that its error gives to each.
        ends = np.cumsum(counts)
        several = (at < own.first + own.halves - 1).astype(np.int64)
        low, high = ends[at] - counts[at], ends[at + several]
        many = high - low
        take = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        rows, owner = own.buckets[take], np.repeat(np.arange(len(bags)), many)
        if rng is not None:  # a third of them is left out, so that no single one decides
            some = rng.random(len(rows)) >= DROPPED
            rows, owner = rows[some], owner[some]
            many = np.bincount(owner, minlength=len(bags))
        weight = (1 / np.maximum(many, 1)).astype(np.float32)
        seen = self.vectors[rows]
        mean = np.stack([np.bincount(owner, seen[:, k], len(bags)) for k in range(WIDTH)], 1) * weight[:, None]
        touched, inverse = np.unique(rows, return_inverse=True)
        pull = np.bincount(inverse, (error * weight)[owner], len(touched)).astype(np.float32)
        axis = self.softmax[:, 1] - self.softmax[:, 0]
        spent_v[touched] += pull * pull * float(axis @ axis)
        self.vectors[touched] -= (rate * pull / np.sqrt(spent_v[touched]))[:, None] * axis
        g = (mean.T @ np.stack([-error, error], 1)).astype(np.float32)
        spent_w += g * g
        self.softmax -= 0.2 * rate * g / np.sqrt(spent_w)


def train(docs: DataFrame, labels: DataFrame, mark: str = "toxic", rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> SubwordSoftmax:
    """Fits on the labelled documents (doc_id, text; doc_id and the mark): of each mark at most so many rows and bytes."""
    marked = labels.where(F.col(mark).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max(mark) > 0).cast("int").alias("mark"))
    known = docs.select("doc_id", F.octet_length(text_of()).alias("size")).join(marked, "doc_id")
    known = known.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id"))
    many = {r["mark"]: r["count"] for r in known.groupBy("mark").count().collect()}
    chosen: dict = {}
    for side in (0, 1):
        total, n = 0, many.get(side, 0)
        # Twice the share that is wanted, by hash, so that a task hands on a few rows only.
        top = (1 << 63) - 1 if n <= 2 * rows else (2 * rows * (1 << 64)) // n - (1 << 63)
        for r in known.where((F.col("mark") == side) & (F.col("h") <= top)).orderBy("h", "doc_id", "size").limit(rows).collect():
            if total + r["size"] <= most and r["doc_id"] not in chosen:
                chosen[r["doc_id"]] = side
                total += r["size"]
    texts = docs.where(F.col("doc_id").isin(list(chosen))).groupBy("doc_id").agg(F.min(text_of()).alias("text")).collect()
    texts = sorted((r["doc_id"], r["text"]) for r in texts)
    return SubwordSoftmax().fit([t for _, t in texts], np.array([float(chosen[i]) for i, _ in texts]))


def score(text: Column, model: SubwordSoftmax) -> Column:
    """DOUBLE, 0 to 1: the probability that a text is toxic."""
    part = model._parts()

    @F.arrow_udf("double")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in parts(batches, _PASS):
            yield pa.array(model.scores([t or "" for t in some.to_pylist()], part), pa.float64())

    return rate(text)


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with `held_out`, `score` and `predicted`; learns only from rows that are not held out."""
    with_fold = docs.withColumn("held_out", crc_mod("doc_id", 5) == 0)
    model = train(with_fold.where(~F.col("held_out")), labels)
    return with_fold.withColumn("score", score(text_of(), model)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents."""
    return rated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
