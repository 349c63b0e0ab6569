"""Near copies: candidates are what a BK-tree of SimHash fingerprints finds, in few and small shuffles."""

import random

import numpy as np
import pyarrow as pa

from fabulary.llm import shingles, simhash


def edited(rng, n, words, rate):
    base = [f"w{rng.randrange(900)}" for _ in range(words)]
    return [" ".join(rng.choice(["new", "words", "here"]) if rng.random() < rate else w for w in base) for _ in range(n)]


def jaccard(one, two):
    both = len(np.intersect1d(one, two))
    return both / (len(one) + len(two) - both)


def test_fingerprints_against_plain_bits():
    rng = random.Random(3)
    near = 0
    for text in ["", "few words", *edited(rng, 2, 40, 0.1), *edited(rng, 1, 9_000, 0)]:
        own = shingles.shingle_set(text)
        got = shingles.fingerprint(own)
        assert len(got) == shingles.SIM and int(got[0]) == int(simhash.majority(own[:, None])[0])
        words = [[int(h) for h in own]]
        for k in range(1, shingles.SIM):
            words.append([])
            for h in words[0]:
                x = (h + k * 0x9E3779B97F4A7C15) % 2**64
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
                words[-1].append(x ^ x >> 31)
        want = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in w) > len(w)) for w in words]
        assert [int(x) % 2**64 for x in got] == want
    for words in (8, 9, 20, 60, 300):
        for _ in range(40):
            sets = [shingles.shingle_set(t) for t in edited(rng, 4, words, 0.02)] + [shingles.shingle_set(" ".join(f"v{k}" for k in range(words - d))) for d in (0, 1)]
            for x in sets:
                for y in sets:
                    if 0.8 <= jaccard(x, y) < 1:
                        near += 1
                        assert np.bitwise_count((shingles.fingerprint(x) ^ shingles.fingerprint(y)).view(np.uint64)).sum() <= shingles.RADIUS
    assert near > 300


def test_trees_of_several_words_against_brute_force():
    rng = np.random.default_rng(8)
    bucket = np.sort(rng.integers(0, 5, 400))
    value = rng.integers(0, 2**64, (400, 4), np.uint64)
    value[::3] = value[0] ^ (np.uint64(1) << rng.integers(0, 64, (len(value[::3]), 4), np.uint64))
    a, b = simhash.BkForest(bucket, value).pairs(np.arange(400), 7)
    apart = np.bitwise_count(value[:, None] ^ value[None]).sum(axis=2)
    want = {(int(x), int(y)) for x, y in zip(*np.nonzero((apart <= 7) & (bucket[:, None] == bucket[None]))) if x > y}
    assert set(zip(a.tolist(), b.tolist())) == want and len(want) > 100


def test_candidates_are_those_of_the_tree():
    own = [shingles.shingle_set(t) for t in ("a b c d e f g h i j k l m n o p q r s t u v w x", "a b c d e f g h i j k l m n o p q r s t u v w y")]
    sims = [shingles.fingerprint(x) for x in own]
    table = lambda sims: pa.table({"key": [1, 1], "fp": [5, 3], "part": [5, 3], "tile": [0, 0], "i": [0, 0], "j": [0, 0], "own": [x.view(np.int64) for x in own], "sim": list(sims)})
    assert shingles.similar(*own)
    assert shingles._joining(table(sims)).to_pylist() == [{"a": 5, "b": 3}]
    assert shingles._joining(table([sims[0], ~sims[0]])).num_rows == 0


def test_hot_groups_in_several_tiles_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    texts = [t for rate in (0.01, 0.03, 0.06) for t in edited(rng, 30, 80, rate)]
    rng.shuffle(texts)
    own = [shingles.shingle_set(t) for t in texts]
    label = list(range(len(own)))
    for i, x in enumerate(own):
        for j in range(i):
            if shingles.similar(x, own[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if k == high else k for k in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tile, hashes in ((10**6, 10**9), (7, 10**9), (10**6, 500)):
        monkeypatch.setattr(shingles, "TILE", tile)
        monkeypatch.setattr(shingles, "TILE_HASHES", hashes)
        base, groups = shingles.grouped(docs)
        assert {r.doc_id: r.component_id for r in base.join(groups, "fp").collect()} == dict(enumerate(label))


def test_buckets_of_the_same_nodes_are_searched_once(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in range(100))
    seen, ran = [], []
    searched, components = shingles._searched, shingles.components
    monkeypatch.setattr(shingles, "_searched", lambda shared, *more: seen.append(shared.count()) or searched(shared, *more))
    monkeypatch.setattr(shingles, "components", lambda edges: ran.append(1) or components(edges))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "another text of some words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.keep_one(docs).collect()) == [1, 3]
    assert seen == [2] and len(ran) == 1


def test_rounds_of_components_read_the_edges_once(spark, monkeypatch):
    plans, cut = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    edges = spark.createDataFrame([(k + 1, k) for k in range(20)] + [(40, 30), (41, 30), (42, 41)], "a long, b long").coalesce(2)
    label = {r.node: r.component for r in simhash.components(edges).collect()}
    assert label == {k: 0 for k in range(1, 21)} | {40: 30, 41: 30, 42: 30}
    assert len(plans) > 2 and not any("Union" in p for p in plans)
