"""Near copies by SimHash and BK-trees: one document of each group stays, linked by a Jaccard similarity of 0.8 or more of 5-word shingles.

Texts with the same set of shingles are one node, whose fingerprint is the SimHash of the set, SIM words of 64 bits. Nodes
are dealt to buckets; the nodes of a bucket are searched by a BK-tree of their fingerprints, and every pair within
RADIUS bits is a candidate, tested on the sets themselves. At 0.8 a bit differs with a probability of at most 0.1875
(sets of four and five shingles; 0.15 for large sets), so a pair lies beyond the radius with probability 2e-6 at most.

Buckets: fingerprints so far apart agree on no piece of useful length (in 79 pieces of three bits one is bound to be equal),
so a node goes to BANDS buckets, each the hash of ROWS minima of its set under random multipliers. A pair of similarity s misses all
buckets with probability (1 - s ** ROWS) ** BANDS, which is 3e-6 at 0.8 and less above. Buckets of the same nodes are one.

A bucket is searched in tiles of at most TILE nodes and TILE_HASHES hashes on average, each pair of tiles in a group of its own. Only
pairs of different parts are tested, and a link joins its parts, so a group returns fewer links than it has nodes.
In a bucket of several tiles every node is first tested against the smallest one, so copies of one document cost a link each.

Cases: a null text is the empty one; texts without words are copies of each other; a text of fewer than five words is
one shingle; ids as in simhash.keep_one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabulary.llm.common import cut, parts, text_of
from fabulary.llm.simhash import SEED, BkForest, components, majority, one_of_each, shingle_hashes

WORDS = 5
#: The least similarity, as a fraction.
SHARED, OF = 4, 5
#: Words of a fingerprint; bits in which a candidate pair differs at most.
SIM, RADIUS = 4, 78
BANDS, ROWS = 32, 5
#: Nodes and hashes of a tile; nodes that search a tree at once.
TILE, TILE_HASHES, QUERIES = 1024, 1 << 20, 64
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.arange(1, SIM, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text, WORDS))


def fingerprint(own: np.ndarray) -> np.ndarray:
    """SimHash of a set, SIM signed words: of the hashes themselves, then of hashes mixed from them."""
    more = own[:, None] + _STEPS[None, :]
    more = (more ^ (more >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    more = (more ^ (more >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return majority(np.concatenate([own[:, None], more ^ (more >> np.uint64(31))], axis=1))


def minima(own: np.ndarray) -> np.ndarray:
    """The least hash of a set under each multiplier."""
    least = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(own), 512):
        least = np.minimum(least, (_FACTORS[:, None] * own[None, at : at + 512]).min(axis=1))
    return least


def band_keys(own: np.ndarray) -> list[int]:
    """Signed bucket keys of a set; a set without shingles has a bucket of its own."""
    data, size = minima(own).tobytes(), 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(data[at : at + size], at) for at in range(0, len(data), size)], np.uint64).view(np.int64).tolist()


def _sketch(text: Column) -> Column:
    @F.arrow_udf("fp long, bands array<long>")
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts(batches):
            fps, bands = [], []
            for t in part.to_pylist():
                own = shingle_set(t or "")
                fps.append(int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).astype(np.int64)))
                bands.append(band_keys(own))
            yield pa.StructArray.from_arrays([pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["fp", "bands"])

    return make(text)


def _sets(text: Column) -> Column:
    @F.arrow_udf("own array<long>, sim array<long>")
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts(batches):
            own = [shingle_set(t or "") for t in part.to_pylist()]
            sims = pa.array([fingerprint(x) for x in own], pa.list_(pa.int64()))
            yield pa.StructArray.from_arrays([pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64())), sims], ["own", "sim"])

    return make(text)


def _tested(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose fingerprints are near and whose sets are similar enough."""
    one = sets.select(F.col("fp").alias("a"), F.col("own").alias("own_a"), F.col("sim").alias("sim_a"))
    two = sets.select(F.col("fp").alias("b"), F.col("own").alias("own_b"), F.col("sim").alias("sim_b"))
    apart = sum(F.bit_count(F.col("sim_a")[k].bitwiseXOR(F.col("sim_b")[k])) for k in range(SIM))
    both, sizes = F.size(F.array_intersect("own_a", "own_b")), F.size("own_a") + F.size("own_b")
    # |A and B| / |A or B| >= SHARED / OF
    return pairs.join(one, "a").join(two, "b").where(apart <= RADIUS).where(both * (SHARED + OF) >= sizes * SHARED).select("a", "b")


def similar(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether |A and B| / |A or B| is at least SHARED / OF, for sorted sets."""
    return len(np.intersect1d(one, two, assume_unique=True)) * (SHARED + OF) >= (len(one) + len(two)) * SHARED


def _joining(t: pa.Table) -> pa.Table:
    """Links (a > b) of the parts that one pair of tiles joins, which may be the same tile: from each part to the smallest one it reaches."""
    tile, across = t["tile"].to_numpy(), t["i"][0].as_py() != t["j"][0].as_py()
    names, part = np.unique(t["part"].to_numpy(), return_inverse=True)
    first = part.copy()
    own = [x.values.to_numpy().view(np.uint64) for x in t["own"]]
    size = np.array([len(x) for x in own])
    forest = BkForest(np.zeros(len(own), np.int64), np.stack([x.values.to_numpy().view(np.uint64) for x in t["sim"]]))
    for at in range(0, len(own), QUERIES):
        x, y = forest.pairs(np.arange(at, min(at + QUERIES, len(own))), RADIUS)
        open_ = (part[x] != part[y]) & ((tile[x] != tile[y]) | (not across))
        open_ &= np.minimum(size[x], size[y]) * OF >= np.maximum(size[x], size[y]) * SHARED
        for one, two in zip(x[open_].tolist(), y[open_].tolist()):
            if part[one] != part[two] and similar(own[one], own[two]):
                low, high = sorted((part[one], part[two]))
                part[part == high] = low
    joined = np.unique(np.stack([names[first], names[part]], axis=1)[first != part], axis=0)
    return pa.table({"a": pa.array(joined[:, 0], pa.int64()), "b": pa.array(joined[:, 1], pa.int64())})


def _searched(shared: DataFrame, sets: DataFrame, first: DataFrame) -> DataFrame:
    """Links between the parts of each bucket. shared: key and fp; sets: fp, own and sim; first: links a > b that are known."""
    part = F.coalesce("low", "fp").alias("part")
    known = sets.select("fp", F.size("own").alias("size")).join(first.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("low")), "fp", "left")
    parted = cut(shared.select("key", "fp").join(known.select("fp", "size", part), "fp"))
    several = parted.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("n"), F.sum("size").alias("hashes")).where("x < y")
    tiles = several.select("key", F.ceil(F.greatest(F.col("n") / TILE, F.col("hashes") / TILE_HASHES)).alias("tiles"))
    laid = parted.join(tiles, "key").withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles"))
    laid = laid.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    laid = laid.select("key", "fp", "part", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")).join(sets, "fp")
    return laid.groupBy("key", "i", "j").applyInArrow(_joining, "a long, b long").distinct()


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp and h of every row, and by distinct `fp` its `group` and `component_id`, as simhash.one_of_each takes them."""
    made = docs.select("doc_id", F.xxhash64(text_of()).alias("h"), _sketch(text_of()).alias("s"))
    made = cut(made.select("doc_id", "h", "s.fp", "s.bands"))
    keys = made.groupBy("fp").agg(F.min_by("bands", "h").alias("bands"), F.min("h").alias("h")).select("fp", "h", F.explode("bands").alias("key"))
    members = [F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("n"), F.bit_xor("fp").alias("x"), F.sum(F.shiftright("fp", 32)).alias("y")]
    buckets = keys.groupBy("key").agg(*members).where("n > 1").groupBy("low", "high", "n", "x", "y").agg(F.min("key").alias("key"))
    shared = cut(keys.join(buckets.select("key", "low", "n"), "key"))
    need = shared.groupBy("fp").agg(F.first("h").alias("h"))
    texts = docs.select(F.xxhash64(text_of()).alias("h"), "text").join(need.select("h"), "h", "left_semi").dropDuplicates(["h"])
    sets = cut(need.join(texts, "h").select("fp", _sets(text_of()).alias("s")).select("fp", "s.own", "s.sim"))
    first = shared.where((F.col("n") > TILE) & (F.col("fp") > F.col("low"))).select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    first = cut(_tested(first, sets))
    found = components(first.union(_searched(shared, sets, first))).select(F.col("node").alias("fp"), F.col("component").alias("group"))
    values = made.groupBy("fp").agg(F.min("doc_id").alias("first")).join(found, "fp", "left").withColumn("group", F.coalesce("group", "fp"))
    smallest = values.groupBy("group").agg(F.min("first").alias("component_id"))
    return made.select("doc_id", "h", "fp"), cut(values.join(smallest, "group").select("fp", "group", "component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one document of each group of near copies."""
    return one_of_each(docs, *grouped(docs))
