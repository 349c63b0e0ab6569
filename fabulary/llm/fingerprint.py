"""Document fingerprints: digests of improbable byte windows in chained Bloom filters.

Every window of 16 bytes has a collision entropy, given by the number of equal byte pairs in it. How rare each number
is comes from a histogram over the windows of all documents. A window is a feature when it is the rarest (the first of
equals) for enough of the neighbourhoods of 32 windows around it; in a text of fewer than 256 windows every window is
one. A feature sets five bits of a 2048-bit filter, and a filter that holds 160 features is followed by the next. Two
chains are compared filter by filter: shared bits beyond those that chance shares, over the most they could share.

Cases: a null text is the empty one; a text without bytes has an empty fingerprint, like 1 to another empty one and 0
to all others; a text shorter than a window is one feature; equal texts have equal fingerprints, whatever lies beside
them; repeated rows follow each other in the order of their texts; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulary.llm.common import partitions, table, text_of

WINDOW, AROUND, POPULAR, SHORT = 16, 32, 8, 256
BITS, HASHES, PER_FILTER = 2048, 5, 160
#: Windows with more equal pairs than this have too few different bytes to tell texts apart.
DULL = 40
_PAIRS = WINDOW * (WINDOW - 1) // 2 + 1
_ROWS = 256


def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as bytes behind each other, short ones padded to a window; where each starts; its number of windows."""
    raw = [t.encode() for t in texts]
    laid = [b.ljust(WINDOW, b"\0") if b else b for b in raw]
    sizes = np.fromiter(map(len, laid), np.int64, len(laid))
    return np.frombuffer(b"".join(laid), np.uint8), np.cumsum(sizes) - sizes, np.maximum(sizes - WINDOW + 1, 0)


def _equal_pairs(data: np.ndarray) -> np.ndarray:
    """Of the window from each byte on: the number of pairs of equal bytes. Windows slide, so pairs enter and leave at the ends."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    before, behind = np.zeros(len(data), np.int8), np.zeros(len(data), np.int8)
    for apart in range(1, WINDOW):
        equal = (data[apart:] == data[:-apart]).view(np.int8)
        before[apart:] += equal
        behind[:-apart] += equal
    first = sum(int((data[a + 1 : WINDOW] == data[a]).sum()) for a in range(WINDOW))
    steps = before[WINDOW:].astype(np.int32) - behind[: n - 1]
    return np.concatenate([[first], first + np.cumsum(steps)]).astype(np.int32)


def _places(starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """All places where a window of one text begins."""
    total = int(windows.sum())
    return np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(total)


def rarity(docs: DataFrame, text: str = "text") -> list[int]:
    """Rank by number of equal pairs, 0 the rarest over all windows of all documents; dull windows come last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(_PAIRS, np.int64)
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                data, starts, windows = _laid_out([t or "" for t in batch.column(0).slice(at, _ROWS).to_pylist()])
                if windows.sum():
                    seen += np.bincount(_equal_pairs(data)[_places(starts, windows)], minlength=_PAIRS)
        yield pa.RecordBatch.from_pydict({"pairs": np.arange(_PAIRS, dtype=np.int32), "n": seen})

    rows = docs.select(text_of(text)).mapInArrow(count, "pairs int, n long").groupBy("pairs").agg(F.sum("n").alias("n")).collect()
    seen = {r["pairs"]: r["n"] for r in rows}
    order = sorted(range(_PAIRS), key=lambda p: (p > DULL, seen.get(p, 0), p))
    return [order.index(p) for p in range(_PAIRS)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _features(data: np.ndarray, starts: np.ndarray, windows: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the features of all texts, ascending."""
    short = windows < SHORT
    every = _places(starts[short], windows[short])
    if short.all():
        return every
    key = (rank[_equal_pairs(data)].astype(np.int64) << 40) + np.arange(len(data) - WINDOW + 1)
    least, span = key, 1
    while span < AROUND:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    chosen = least[_places(starts[~short], windows[~short] - AROUND + 1)] & ((1 << 40) - 1)
    place, votes = np.unique(chosen, return_counts=True)
    place = place[(votes >= POPULAR)]
    return np.sort(np.concatenate([every, place]))


def digest(texts: list[str], rank: np.ndarray) -> list[bytes]:
    """The filters of each text behind each other."""
    data, starts, windows = _laid_out(texts)
    if not len(data):
        return [b""] * len(texts)
    place = _features(data, starts, windows, rank)
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[place]).view(np.uint64)
    with np.errstate(over="ignore"):
        hashed = _mixed(_mixed(words[:, 0]) + words[:, 1] * np.uint64(0x9E3779B97F4A7C15))
    filled = windows > 0
    owner = np.flatnonzero(filled)[np.searchsorted(starts[filled], place, side="right") - 1]
    # Of equal features of a text the first counts.
    order = np.lexsort((hashed, owner))
    new = np.concatenate([[True], (hashed[order][1:] != hashed[order][:-1]) | (owner[order][1:] != owner[order][:-1])])
    keep = np.sort(order[new])
    hashed, owner = hashed[keep], owner[keep]
    many = np.bincount(owner, minlength=len(texts))
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    filters = -(-many // PER_FILTER)
    first = np.cumsum(filters) - filters
    which = first[owner] + nth // PER_FILTER
    bits = np.zeros((int(filters.sum()), BITS), np.uint8)
    for k in range(HASHES):
        bits[which, ((hashed >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1)
    return [packed[a : a + n].tobytes() for a, n in zip(first.tolist(), filters.tolist())]


def _filters(raw: bytes) -> list[tuple[int, int]]:
    step = BITS // 8
    made = [int.from_bytes(raw[at : at + step], "big") for at in range(0, len(raw), step)]
    return [(x, x.bit_count()) for x in made]


def overlap(a: bytes, b: bytes) -> float:
    """0 to 1. Each filter of the shorter chain counts with its best partner, by the bits it holds."""
    one, two = sorted((_filters(a), _filters(b)), key=len)
    if not one:
        return float(not two)
    got = weight = 0.0
    for x, n in one:
        best = 0.0
        for y, m in two:
            chance = n * m / BITS
            if (shared := (x & y).bit_count()) > chance and (most := min(n, m)) > chance:
                best = max(best, (shared - chance) / (most - chance))
        got, weight = got + best * n, weight + n
    return min(1.0, got / weight)


def fingerprint(text: Column, rank: list[int]) -> Column:
    """STRING: the filters in hex."""
    ranks = np.array(rank)

    @F.arrow_udf("string")
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = (batch.slice(at, _ROWS).to_pylist() for at in range(0, len(batch), _ROWS))
            yield pa.array([x.hex() for part in parts for x in digest([t or "" for t in part], ranks)], pa.string())

    return make(text)


def likeness(a: Column, b: Column) -> Column:
    """DOUBLE, 0 to 1: overlap of two fingerprints in hex; a null one counts as empty."""

    @F.arrow_udf("double")
    def compare(left: pa.Array, right: pa.Array) -> pa.Array:
        raw = lambda x: bytes.fromhex(x or "")
        return pa.array([overlap(raw(x), raw(y)) for x, y in zip(left.to_pylist(), right.to_pylist())], pa.float64())

    return compare(a, b)


def _beside(batches: Iterator[pa.RecordBatch], ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows come in order and each span ends with a copy of the row that follows it; the last row waits for its next."""
    held: tuple | None = None
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            part = batch.slice(at, _ROWS).to_pydict()
            rows = list(zip(part["doc_id"], part["text"], part["copy"], digest(part["text"], ranks)))
            rows, held = ([held] if held else []) + rows, rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[2]]
            edited = []
            for (_, text, _, _), (_, following, _, _) in pairs:
                quarter = len(text) // 4
                edited.append(text[: len(text) - quarter] + following[:quarter])
            marks = digest(edited, ranks)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([a[0] for a, _ in pairs], pa.int64()),
                    "n_chars": pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                    "fingerprint": pa.array([a[3].hex() for a, _ in pairs], pa.string()),
                    "edited_fingerprint": pa.array([x.hex() for x in marks], pa.string()),
                    "near_edited": pa.array([overlap(a[3], x) for (a, _), x in zip(pairs, marks)], pa.float64()),
                    "near_next": pa.array([overlap(a[3], b[3]) for a, b in pairs], pa.float64()),
                }
            )


def beside_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document (doc_id LONG, text), of its text with the last quarter taken from the next one, and their likeness.

    The ids are cut into spans at approximate quantiles; each span is sorted alone and gets a copy of the first row of the next one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    spans = partitions(spark)
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / spans for i in range(1, spans)], 0.25 / spans))) if spans > 1 else []
    span = F.lit(0)
    if cuts:
        span = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c <= F.col("doc_id")))
    rows = rows.withColumn("span", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(span))
    firsts = sorted(rows.groupBy("span").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("null")).collect())
    ids = [None if r["null"] else r["first"] for r in firsts]
    follows = {i: firsts[k - 1]["span"] for k, i in enumerate(ids)}
    if not firsts:
        return rows.withColumn("copy", F.lit(False)).mapInArrow(lambda b: _beside(b, np.zeros(_PAIRS, np.int64)), _SCHEMA)
    # One row per span, so the pairs are as few as the partitions.
    places = spark.createDataFrame(list(follows.items()), "doc_id long, span int")
    opening = rows.where(F.col("doc_id").isin([i for i in ids if i is not None]) | (F.col("doc_id").isNull() if None in ids else F.lit(False)))
    opening = opening.groupBy("doc_id").agg(F.min("text").alias("text")).alias("o").join(F.broadcast(places.alias("p")), F.col("o.doc_id").eqNullSafe(F.col("p.doc_id"))).select("o.doc_id", "o.text", "p.span")
    ranks = np.array(rarity(docs))
    both = rows.withColumn("copy", F.lit(False)).unionByName(opening.withColumn("copy", F.lit(True)))
    dealt = both.repartition(spans, "span").sortWithinPartitions("span", "copy", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.select("doc_id", "text", "copy").mapInArrow(lambda b: _beside(b, ranks), _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beside_next(table(spark, sf_dir, "documents"))
