"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a few differing bits by BK-trees.

Fingerprints are made once per document and then handled as distinct values, so copies cost nothing. The values are
dealt to trees of about TREE values each, three trees a value: the bits are cut into three parts, and two values that
differ in at most two bits agree on the whole of one part at least, so they meet in the tree whose key is made of the
leading bits of that part. A crowded tree is dealt out again in the same way by the bits that its key leaves, twice at
most. Several trees share a shard of bounded size; there each is a BK-tree, whose children are keyed by their Hamming
distance to the parent and of which a search follows only the edges within the radius. A search of a tree of 1,024
random values compares 45 of them. Trees are built where their shard is and searched by that shard's values, because
trees of all fingerprints have no size bound and can't be broadcast.

A value has at most 1 + 64 + 2016 values within two bits, so links stay linear in the values. Components grow by
alternating large-star and small-star steps, each written to the checkpoint folder.

Cases: a null text is the empty one; texts without words have fingerprint zero and link like any other; repeated
rows share a component; a row without an id links like any other, and a component without any id has a null
component_id; an empty table gives no rows; a long text is read whole; columns other than doc_id and text are never read
and pass through keep_one as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fabulary.llm.common import cut, parts, table, text_of

WORDS, RADIUS, SEED = 3, 2, 42
#: Values of a tree on average, values above which it is dealt out again and by how many bits, rows of a shard on average.
TREE, CROWDED, FINER, SHARD_ROWS = 1_024, 8_192, 10, 50_000
_QUERIES = 4_096
#: Shingles whose bits are counted at once.
_SLICE = 8_192


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """Hashes of the n-word shingles in text order; fewer words are one shingle, no words none."""
    words = text.encode().lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(joined, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -n] + 1).tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the rows, as signed words. hashes: a row of one or more words for each shingle."""
    n, width = hashes.shape
    counts = np.zeros(64 * width, np.int64)
    for at in range(0, n, _SLICE):
        part = np.ascontiguousarray(hashes[at : at + _SLICE].astype(">u8"))
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8 * width), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n).view(">i8").astype(np.int64)


def fingerprint(text: str, n: int = WORDS) -> int:
    """Signed 64-bit SimHash of the n-word shingles, repeats included."""
    return int(majority(shingle_hashes(text, n)[:, None])[0])


def simhash(text: Column, n: int = WORDS) -> Column:
    """LONG: the fingerprint of a text."""

    @F.arrow_udf("long")
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts(batches):
            yield pa.array([fingerprint(t or "", n) for t in part.to_pylist()], pa.int64())

    return make(text)


class BkForest:
    """BK-trees of many buckets at once. values (one word or a row of words each) are sorted by bucket; `roots` are the first places of the buckets."""

    def __init__(self, bucket: np.ndarray, value: np.ndarray) -> None:
        self.value = value if value.ndim == 2 else value[:, None]
        self.span = 64 * self.value.shape[1] + 1
        first = np.concatenate([[True], bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, bool)
        self.root = np.maximum.accumulate(np.where(first, np.arange(len(bucket)), 0)) if len(bucket) else np.zeros(0, np.int64)
        parents, distances, children = [], [], []
        at, moving = self.root.copy(), np.flatnonzero(~first)
        while len(moving):  # one level of all trees a round
            edge = at[moving] * self.span + self._apart(moving, at[moving])
            edges, lead, nth = np.unique(edge, return_index=True, return_inverse=True)
            child = moving[lead]
            parents.append(edges // self.span)
            distances.append(edges % self.span)
            children.append(child)
            at[moving] = child[nth]
            stays = np.zeros(len(moving), bool)
            stays[lead] = True
            moving = moving[~stays]
        joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        key = joined(parents) * self.span + joined(distances)
        order = np.argsort(key, kind="stable")
        self.key, self.child = key[order], joined(children)[order]
        self.compared = 0

    def _apart(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Hamming distances of the values at places of the same bucket."""
        bits = np.bitwise_count(self.value[one] ^ self.value[two])
        return bits[:, 0].astype(np.int64) if bits.shape[1] == 1 else bits.sum(axis=1, dtype=np.int64)

    def pairs(self, places: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, smaller place) of all values of the same bucket within the radius."""
        found_a, found_b = [], []
        who, node = places, self.root[places]
        while len(who):
            self.compared += len(who)
            apart = self._apart(who, node)
            hit = (apart <= radius) & (node < who)
            found_a.append(who[hit])
            found_b.append(node[hit])
            first = np.searchsorted(self.key, node * self.span + np.maximum(apart - radius, 0), side="left")
            last = np.searchsorted(self.key, node * self.span + np.minimum(apart + radius, self.span - 1), side="right")
            many = last - first
            who = np.repeat(who, many)
            node = self.child[np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))]
        return np.concatenate(found_a or [places[:0]]), np.concatenate(found_b or [places[:0]])


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that links reach, by place."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(table: pa.Table, radius: int) -> pa.Table:
    """Links of one shard, each value to the smallest node of those that it reaches inside its bucket's tree."""
    kind, bucket = table["kind"].to_numpy(), table["bucket"].to_numpy()
    value, node = table["fp"].to_numpy().view(np.uint64), table["node"].to_numpy()
    order = np.lexsort((node, bucket, kind))
    kind, bucket, value, node = kind[order], bucket[order], value[order], node[order]
    new = np.concatenate([[True], (kind[1:] != kind[:-1]) | (bucket[1:] != bucket[:-1])])
    forest = BkForest(np.cumsum(new), value)
    crowd = np.flatnonzero(~np.concatenate([new[1:], [True]]) | ~new)
    a, b = [], []
    for at in range(0, len(crowd), _QUERIES):
        x, y = forest.pairs(crowd[at : at + _QUERIES], radius)
        a.append(x)
        b.append(y)
    label = _smallest(len(node), np.concatenate(a or [crowd[:0]]), np.concatenate(b or [crowd[:0]]))
    moved = np.flatnonzero(label != np.arange(len(node)))
    return pa.table({"a": node[moved], "b": node[label[moved]]})


def finer(mask: int, bits: int) -> list[int]:
    """Three masks: the bits of one, and so many of each third of the others."""
    rest = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in rest[k::3][:bits]) for k in range(3)]


def links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b (a > b): links between nodes whose fingerprints are near, enough to join all that are. values: distinct `fp` with `node`."""
    if radius > 2:
        raise ValueError("the bits are cut for a radius of at most 2")
    n = values.count()
    masks = [finer(0, min(21, max(0, (n // TREE).bit_length())))]
    for _ in range(2):
        masks.append([m for mask in masks[-1] for m in finer(mask, FINER)])
    known = [m for level in masks for m in level]
    signed = F.array(*[F.lit(m - 2**64 if m >= 2**63 else m).cast("long") for m in known])

    def dealt(rows: DataFrame, kinds: Column) -> DataFrame:
        made = rows.select("fp", "node", F.explode(kinds).alias("kind"))
        return made.withColumn("bucket", F.col("fp").bitwiseAND(F.element_at(signed, F.col("kind") + 1)))

    trees, first = [], 0
    rows = dealt(values, F.array(*[F.lit(k) for k in range(3)]))
    for level in range(len(masks) - 1):
        crowded = rows.groupBy("kind", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("kind", "bucket")
        crowded = cut(crowded)
        trees.append(rows.join(crowded, ["kind", "bucket"], "left_anti"))
        below = F.array(*[first + len(masks[level]) + (F.col("kind") - first) * 3 + k for k in range(3)])
        first += len(masks[level])
        rows = rows.join(crowded, ["kind", "bucket"], "left_semi").select("fp", "node", F.explode(below).alias("kind"))
        rows = rows.withColumn("bucket", F.col("fp").bitwiseAND(F.element_at(signed, F.col("kind") + 1)))
    for tree in trees:
        rows = rows.unionByName(tree.select("fp", "node", "kind", "bucket"))
    shards = max(1, n * 3 // SHARD_ROWS)
    laid = rows.withColumn("shard", F.pmod(F.xxhash64("kind", "bucket"), F.lit(shards)))
    return laid.groupBy("shard").applyInArrow(lambda t: _links(t, radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node of its component) of every node on an edge (a > b)."""
    edges = cut(edges)
    told = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == told or not state[0]:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        told = state
        ends = [F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ("ab", "ba")]
        both = edges.select(F.inline(F.array(*ends)))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("m", F.explode(F.array("a", "b")).alias("a")).where("a > m")
        edges = cut(small.select("a", F.col("m").alias("b")).distinct())


def _grouped(docs: DataFrame, radius: int, n: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp and `h`, a hash of the text, of every row, and by distinct `fp` its `group` (the smallest fingerprint that links reach) and `component_id`."""
    base = cut(docs.select("doc_id", F.xxhash64(text_of()).alias("h"), simhash(text_of(), n).alias("fp")))
    values = cut(base.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(values.select("fp", F.col("fp").alias("node")), radius)).select(F.col("node").alias("fp"), F.col("component").alias("group"))
    grouped = values.join(found, "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    smallest = grouped.groupBy("group").agg(F.min("first").alias("component_id"))
    return base, cut(grouped.join(smallest, "group").select("fp", "group", "component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, n: int = WORDS) -> DataFrame:
    """doc_id, fp, component_id: the smallest id that links reach from the document, itself included."""
    base, groups = _grouped(docs, radius, n)
    return base.join(groups, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, n: int = WORDS) -> DataFrame:
    """docs without all but one document of each component: the one with the smallest id, or, where no row has an id, with the smallest text."""
    return one_of_each(docs, *_grouped(docs, radius, n))


def one_of_each(docs: DataFrame, base: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of docs for each group: the one with the smallest id, of those the one with the smallest text. base, groups: as _grouped gives them.

    An id may stand for several texts, so a row is found by its id and the hash of its text.
    """
    winners = base.join(groups, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "h", "group").distinct()
    ids = winners.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("h", "group"))).alias("__won"))
    own = F.col("__won")[F.xxhash64(text_of())]
    nth = F.row_number().over(Window.partitionBy("doc_id", "__group").orderBy("text"))
    named = docs.join(ids, "doc_id").withColumn("__group", own).where(F.col("__group").isNotNull())
    named = named.withColumn("__nth", nth).where("__nth = 1").select(*docs.columns)
    # The filter on null ids reaches the scan, and the minimum is taken before the shuffle.
    nameless = docs.where(F.col("doc_id").isNull()).select(F.struct(*docs.columns).alias("row"), F.xxhash64(text_of()).alias("h"))
    nameless = nameless.join(winners.where(F.col("doc_id").isNull()).select("h", "group"), "h")
    nameless = nameless.groupBy("group").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row"))
    return named.unionByName(nameless.select("row.*"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
