"""Toxicity against a plain version with dictionaries, numeric gradients of the passage, and held-out and misspelt words."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabulary.llm import toxicity

CALM = "garden river stone mirror paper window letter summer bread candle evening forest".split()
RUDE = "blorgath snivelkin drakmoot".split()


def prose(rng, n):
    return " ".join(rng.choice(CALM) for _ in range(n))


def plain_features(text):
    """Places and hashed features by a loop over characters."""
    kept, word = [0], False
    for c in text.lower():
        if c.isalnum():
            kept.append(ord(c) + 1)
            word = True
        elif word:
            kept.append(0)
            word = False
    if word:
        kept.append(0)
    base, mask, out = 0x100000001B3, (1 << 64) - 1, []

    def bucket(h):
        h = ((h ^ (h >> 29)) * 0x9E3779B97F4A7C15) & mask
        return h >> (64 - toxicity.BITS)

    for n in toxicity.GRAMS:
        for i in range(len(kept) - n + 1):
            gram = kept[i : i + n]
            if 0 not in gram[1:-1]:
                h = 0
                for c in gram:
                    h = (h * base + c) & mask
                out.append((i, bucket(h)))
    i = 0
    while i < len(kept):
        if kept[i]:
            j, h = i, 0
            while kept[j]:
                h = (h + kept[j] * pow(base, j - i + 1, 1 << 64)) & mask
                j += 1
            out.append((i, bucket((h * pow(base, -1, 1 << 64) + 7) & mask)))
            i = j
        i += 1
    length = max(len(kept) - (1 if len(kept) > 1 else 0), 1)
    return out, -(-length // toxicity.HALF)


def plain_score(model, text):
    part = model._parts()
    found, halves = plain_features(text)
    halves = max(halves, 1)
    sums, counts = [0.0] * (halves + 1), [0] * (halves + 1)
    for place, row in found:
        sums[place // toxicity.HALF] += float(part[row])
        counts[place // toxicity.HALF] += 1
    passages = range(max(halves - 1, 1))
    best = max((sums[k] + (sums[k + 1] if halves > 1 else 0)) / max(1, counts[k] + (counts[k + 1] if halves > 1 else 0)) for k in passages)
    return 1 / (1 + math.exp(-max(-30, min(30, best + float(model.bias[1] - model.bias[0])))))


def trained(seed=4):
    rng = random.Random(seed)
    texts, marks = [], []
    for i in range(160):
        words = prose(rng, rng.choice([5, 40, 300])).split()
        if i % 4 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        texts.append(" ".join(words) + ".")
        marks.append(float(i % 4 == 0))
    return toxicity.SubwordSoftmax().fit(texts, np.array(marks)), texts, marks


def test_scores_equal_a_plain_version():
    model, texts, _ = trained()
    odd = ["", " ", "a", "ab", "...", "Éİx", "日本語のテキスト" * 30, "x" * 500, "end.", ".start", "a\0b", "퟿\U0001f600 z"]
    many = [*odd, *texts[:40], *odd]
    got = model.scores(many)
    assert np.allclose(got, [plain_score(model, t) for t in many], atol=1e-5)
    assert np.allclose(got, [model.scores([t])[0] for t in many], atol=1e-9)


def test_step_follows_the_gradient():
    """One small step lowers the loss at the passages that it was taken for, in both the vectors and the softmax."""
    model, texts, marks = trained()
    fresh = toxicity.SubwordSoftmax(seed=1)
    own = toxicity.bag(texts[:8])
    y = np.array(marks[:8])

    def loss():
        z = fresh._top(own, fresh._parts())[0]
        return float(np.log1p(np.exp(-z * (2 * y - 1))).mean())

    rows = own.buckets[:5]
    before = loss()
    vectors, softmax = fresh.vectors.copy(), fresh.softmax.copy()
    spent = [np.full(len(vectors), 1e6, np.float32), np.full_like(softmax, 1e6)]
    fresh._step([toxicity.bag([t]) for t in texts[:8]], y, 1.0, *spent)
    moved = fresh.vectors - vectors
    after = loss()
    fresh.vectors, fresh.softmax = vectors, softmax
    assert after < before and np.abs(moved[np.unique(own.buckets)]).max() > 0
    outside = np.setdiff1d(np.arange(len(moved)), own.buckets)
    assert not moved[outside].any() and len(rows)


def test_unseen_misspellings_and_one_word_in_a_long_text():
    model, texts, marks = trained()
    assert ((model.scores(texts) >= 0.5) == (np.array(marks) > 0)).all()
    rng = random.Random(9)
    long = prose(rng, 20_000)
    cut = long[:70_003] + " snivelkin " + long[70_003:]
    assert model.scores([long])[0] < 0.5 <= model.scores([cut])[0]
    calm = model.scores([prose(rng, n) for n in (3, 30, 300, 3_000)])
    wrong = ("blorgathh", "bl0rgath", "snivelkins", "xsnivelkin", "drakmoott", "DRAKMOOT", "snivvelkin")
    got = model.scores([f"{prose(rng, 8)} {w} {prose(rng, 8)}" for w in wrong])
    assert calm.max() < 0.3 < got.min() and (got >= 0.5).sum() >= 6


def test_pieces_cover_the_text():
    text = " ".join(map(str, range(60_000)))
    cut = toxicity.pieces(text)
    assert max(map(len, cut)) <= toxicity.PIECE and len(cut) > 3
    at = 0
    for piece in cut:
        assert text[at : at + len(piece)] == piece
        at += len(piece) - 2 * toxicity.HALF
    assert at + 2 * toxicity.HALF == len(text)
    assert [len(p) for p in toxicity.pieces("y" * 250_000)] == [100_000, 100_000, 250_000 - 2 * (100_000 - 48)]


def test_query_learns_only_from_rows_that_are_not_held_out(spark, tmp_path):
    rng = random.Random(2)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows = [(i, prose(rng, 30) + (f" {rng.choice(RUDE)} now" if i % 3 == 0 else "")) for i in range(400)]
    labels = [(i, 1, (1 - int(i % 3 == 0)) if held(i) else int(i % 3 == 0)) for i in range(390)]  # held-out marks are wrong
    labels += [(None, 1, 1), (3, 1, None), (3, 0, 1)]
    docs = spark.createDataFrame([*rows, (None, rows[0][1]), (900, None), (901, "")], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("score", "mark", "predicted", "size")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.op11(spark, str(tmp_path)).collect()}
    assert len(got) == 403 and got[None]["predicted"] == 1 and got[None]["held_out"]
    for i, _ in rows:
        assert got[i]["held_out"] == held(i) and got[i]["predicted"] == int(i % 3 == 0)
    assert got[900]["score"] == got[901]["score"] < 0.5


@pytest.mark.parametrize("labels", [[], [(5, 1, 1)], [(5, 1, 0), (6, 1, 0)]])
def test_without_both_marks_the_score_is_a_half(spark, tmp_path, labels):
    spark.createDataFrame([(5, "one"), (6, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [r["score"] for r in toxicity.op11(spark, str(tmp_path)).collect()] == [0.5, 0.5]
