"""Quality classifier: a convolutional network over bytes, in numpy.

A byte has a learned vector; learned filters slide over windows of eight bytes, four apart, and their rectified outputs
are averaged in chunks of 128 bytes that overlap by half and cover the whole text. A second layer of learned filters
looks at each chunk, the highest output of each filter over all chunks is kept, and these are combined into one
probability. Scoring runs inside an Arrow UDF, whatever the length of a text.

Fitting uses a bounded sample: at most SAMPLE_ROWS labelled rows and SAMPLE_BYTES of their texts, in the order of a hash
of the id, taken to the driver. Only text is ever an input.

Cases: a null text is the empty one, which has no window and a score of its own; repeated labels of one id count once,
by their highest mark; null marks are left out; without labelled rows the score is 0.5 everywhere; repeated rows pass
through one to one; an output column replaces an input column of the same name, other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulary.llm.common import crc_mod, parts, table, text_of

SAMPLE_ROWS, SAMPLE_BYTES = 3_000, 12_000_000
VECTOR, FILTERS, SHAPES = 8, 16, 16
STEP, HALF = 4, 16  # bytes between windows, windows in half a chunk
EPOCHS, BATCH, RATE, SEED = 8, 24, 0.004, 11
#: Bytes that one forward pass holds at a time.
_PASS = 400_000


@dataclass
class Laid:
    """Texts behind each other, each padded with zero bytes to whole half chunks."""

    data: np.ndarray  # groups of STEP bytes
    valid: np.ndarray  # windows that hold a byte of a text, per half chunk
    first: np.ndarray  # first half chunk of each text
    halves: np.ndarray  # half chunks of each text


def lay(raw: list[bytes]) -> Laid:
    unit = STEP * HALF
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    halves = -(-(sizes + STEP) // unit)
    first = np.cumsum(halves) - halves
    data = np.frombuffer(b"".join([b.ljust(h * unit, b"\0") for b, h in zip(raw, halves.tolist())]), np.uint8).reshape(-1, STEP)
    windows = -(-sizes // STEP)
    nth = np.arange(int(halves.sum())) - np.repeat(first, halves)
    return Laid(data, np.clip(np.repeat(windows, halves) - nth * HALF, 0, HALF), first, halves)


class Network:
    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.weights = {
            "byte": draw(256, VECTOR, by=0.5),
            "near": draw(STEP * VECTOR, 2 * FILTERS, by=(STEP * VECTOR * 2) ** -0.5 * 1.4),
            "near0": np.zeros(FILTERS, np.float32),
            "chunk": draw(FILTERS, SHAPES, by=FILTERS**-0.5 * 1.4),
            "chunk0": np.zeros(SHAPES, np.float32),
            "out": draw(SHAPES, by=SHAPES**-0.5),
            "out0": np.zeros(1, np.float32),
        }
        self.weights["byte"][0] = 0

    def _windows(self, data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte vectors, and the outputs of the first filters at each window of whole halves; data may go on by one group."""
        w = self.weights
        seen = w["byte"][data].reshape(len(data), -1)
        both = seen @ w["near"]
        near = both[:, :FILTERS]
        near[:-1] += both[1:, FILTERS:]
        near = near[: len(valid) * HALF] + w["near0"]
        np.maximum(near, 0, out=near)
        near *= (np.arange(HALF) < valid[:, None]).reshape(-1, 1)
        return seen, near

    def _combined(self, sums: np.ndarray, laid: Laid) -> tuple[np.ndarray, dict]:
        """Logits from the filters' sums over half chunks."""
        w, counts = self.weights, laid.valid.astype(np.float32)
        # A chunk is a half and the next one of the same text; the last half has none and stands alone only if it is the first.
        last = laid.first + laid.halves - 1
        pair_sum, pair_count = sums.copy(), counts.copy()
        pair_sum[:-1] += sums[1:]
        pair_count[:-1] += counts[1:]
        pair_sum[last], pair_count[last] = sums[last], counts[last]
        pair_count = np.maximum(pair_count, 1)[:, None]
        chunks = pair_sum / pair_count
        shapes = np.maximum(chunks @ w["chunk"] + w["chunk0"], 0)
        alone = laid.halves == 1
        shapes[last[~alone]] = -1  # covered by the chunk before
        top = np.maximum.reduceat(shapes, laid.first, axis=0)
        return top @ w["out"] + w["out0"][0], {"chunks": chunks, "shapes": shapes, "top": top, "last": last, "pair_count": pair_count}

    def forward(self, laid: Laid) -> tuple[np.ndarray, dict]:
        seen, near = self._windows(laid.data, laid.valid)
        logit, got = self._combined(near.reshape(-1, HALF, FILTERS).sum(1), laid)
        return logit, got | {"seen": seen, "near": near}

    def scores(self, raw: list[bytes]) -> np.ndarray:
        """Windows are looked at _PASS bytes at a time, also inside a long text; only their sums by half chunk are kept."""
        out, at = [], 0
        while at < len(raw):
            end, size = at, 0
            while end < len(raw) and (end == at or size + len(raw[end]) <= _PASS):
                size += len(raw[end])
                end += 1
            laid, step = lay(raw[at:end]), _PASS // (STEP * HALF)
            sums = [self._windows(laid.data[k * HALF : (k + step) * HALF + 1], laid.valid[k : k + step])[1].reshape(-1, HALF, FILTERS).sum(1) for k in range(0, len(laid.valid), step)]
            out.append(self._combined(np.concatenate(sums), laid)[0])
            at = end
        logit = np.concatenate(out or [np.zeros(0)]).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def gradients(self, laid: Laid, mark: np.ndarray) -> dict[str, np.ndarray]:
        w, (logit, got) = self.weights, self.forward(laid)
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - mark) / len(mark)).astype(np.float32)
        g = {"out": got["top"].T @ d, "out0": np.array([d.sum()], np.float32)}
        owner = np.repeat(np.arange(len(mark)), laid.halves)
        wins = (got["shapes"] == got["top"][owner]) & (got["shapes"] > 0)
        ties = np.add.reduceat(wins.astype(np.float32), laid.first, axis=0)
        d_shapes = wins * (d[:, None] * w["out"] / np.maximum(ties, 1))[owner]
        g["chunk"], g["chunk0"] = got["chunks"].T @ d_shapes, d_shapes.sum(0)
        d_pair = (d_shapes @ w["chunk"].T) / got["pair_count"]
        d_sums = d_pair.copy()
        apart = np.ones(len(d_pair), bool)
        apart[got["last"]] = False
        d_sums[1:] += d_pair[:-1] * apart[:-1, None]
        d_near = np.repeat(d_sums, HALF, axis=0) * (got["near"] > 0)
        d_both = np.zeros((len(d_near), 2 * FILTERS), np.float32)
        d_both[:, :FILTERS] = d_near
        d_both[1:, FILTERS:] = d_near[:-1]
        g["near"], g["near0"] = got["seen"].T @ d_both, d_near.sum(0)
        d_seen = (d_both @ w["near"].T).reshape(-1, VECTOR)
        flat = laid.data.ravel()
        g["byte"] = np.stack([np.bincount(flat, d_seen[:, k], 256) for k in range(VECTOR)], 1).astype(np.float32)
        g["byte"][0] = 0
        return g

    def fit(self, raw: list[bytes], mark: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
        """Adam over shuffled batches; the rarer mark weighs as much as the other."""
        if not len(mark):
            self.weights = {k: np.zeros_like(v) for k, v in self.weights.items()}
            return self
        rng, mean, square, step = np.random.default_rng(seed), {}, {}, 0
        short = np.flatnonzero(mark == (mark.mean() < 0.5))
        times = max(1, min(8, (len(mark) - len(short)) // max(1, len(short))))
        places = np.concatenate([np.arange(len(mark)), np.repeat(short, (times - 1) // 2)])
        rounds = epochs * min(6, max(1, 1_200 // len(places)))
        for epoch in range(rounds):
            rate = RATE * (1 - epoch / rounds) + RATE / 20
            for part in np.array_split(rng.permutation(places), -(-len(places) // BATCH)):
                g = self.gradients(lay([raw[i] for i in part.tolist()]), mark[part])
                step += 1
                for k, d in g.items():
                    mean[k] = 0.9 * mean.get(k, 0) + 0.1 * d
                    square[k] = 0.99 * square.get(k, 0) + 0.01 * d * d
                    self.weights[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame, mark: str = "quality", rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> Network:
    """Fits on the labelled documents (doc_id, text; doc_id and the mark) within the bounds."""
    marked = labels.where(F.col(mark).isNotNull()).groupBy("doc_id").agg(F.max(mark).alias("mark"))
    known = docs.select("doc_id", F.octet_length(text_of()).alias("size")).join(marked, "doc_id")
    chosen, total = {}, 0
    for r in known.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "size").limit(rows).collect():
        if total + r["size"] <= most and r["doc_id"] not in chosen:
            chosen[r["doc_id"]] = r["mark"]
            total += r["size"]
    texts = docs.where(F.col("doc_id").isin(list(chosen))).groupBy("doc_id").agg(F.min(text_of()).alias("text")).collect()
    texts = sorted((r["doc_id"], r["text"].encode()) for r in texts)
    return Network().fit([t for _, t in texts], np.array([float(chosen[i] > 0) for i, _ in texts]))


def score(text: Column, network: Network) -> Column:
    """DOUBLE, 0 to 1: the probability that a text is good."""

    @F.arrow_udf("double")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts(batches, _PASS):
            yield pa.array(network.scores([(t or "").encode() for t in part.to_pylist()]), pa.float64())

    return rate(text)


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with `held_out`, `score` and `predicted`; learns only from rows that are not held out."""
    with_fold = docs.withColumn("held_out", crc_mod("doc_id", 3) == 1)
    network = train(with_fold.where(~F.col("held_out")), labels)
    return with_fold.withColumn("score", score(text_of(), network)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of documents."""
    return rated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
