"""Alignment of two tokenizers against whole-text encodings and loops over tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fabulary.llm import alignment

ODD = [None, "", " ", "  ", "a ", "a  ", " a", "\n", "a\n b", "a \n b", "<|endoftext|>", "x <|endoftext|> y", "<s> </s> <unk>", "<0x41>", "a▁b", "▁", "a b c　d", "\x1c a\x85 b", "é ﬁ 😀😀 \0", "日本語 テキスト", "x" * 3000, "\t\ta", "don't I'll we've 's"]


@pytest.fixture(scope="module")
def own():
    return alignment.pairer(public_tokenizers.path(alignment.A_FILE), public_tokenizers.path(alignment.B_FILE))


def plain(own, text):
    """n_a, n_b, n_groups, n_links, digest and the links of a text, encoded as a whole and followed token by token."""
    if not text:
        return 0, 0, 0, 0, "", []
    raw = (" " + text).encode()
    runs = []
    for ids, table in ((own.a.encode(" " + text, add_special_tokens=False).ids, own.a_bytes), (own.b.encode(text), own.b_bytes)):
        if b"".join(table[i] for i in ids) != raw:
            return 0, 0, 0, 0, "", []
        at, run = 0, []
        for i in ids:
            run.append((at, at + len(table[i]), i))
            at += len(table[i])
        runs.append(run)
    a, b = runs
    links = [(i, j) for p, q, i in a for r, s, j in b if p < s and r < q] if len(a) * len(b) < 40_000 else swept(a, b)
    groups, k, m = [], 0, 0
    for end in sorted({e for _, e, _ in a} & {e for _, e, _ in b}):
        x, y = [], []
        while k < len(a) and a[k][1] <= end:
            x.append(str(a[k][2]))
            k += 1
        while m < len(b) and b[m][1] <= end:
            y.append(str(b[m][2]))
            m += 1
        groups.append(",".join(x) + "|" + ",".join(y))
    return len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def swept(a, b):
    out, first = [], 0
    for p, q, i in a:
        while b[first][1] <= p:
            first += 1
        k = first
        while k < len(b) and b[k][0] < q:
            out.append((i, b[k][2]))
            k += 1
    return out


def digest(links, own):
    return {a * own.b_size + b: n for (a, b), n in Counter(links).items()}


def texts_of(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(" \n\tab'sé日😀.,1<>| \x1c") for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_chunks_equal_whole_texts(own):
    assert own.splits
    texts = [*ODD, *texts_of(1, 1_500)]
    for at in range(0, len(texts), 40):
        for text, got in zip(texts[at : at + 40], own.rows(texts[at : at + 40])):
            want = plain(own, text)
            assert got[:5] == want[:5], text
            assert dict(zip(got[5].tolist(), got[6].tolist())) == digest(want[5], own), text


def test_groups_by_hand():
    got = alignment.align(np.array([1, 3, 2, 2]), np.array([1, 2, 3, 1, 1]))
    assert got.a.tolist() == [0, 1, 1, 2, 3, 3] and got.b.tolist() == [0, 1, 2, 2, 3, 4]
    assert got.group_a.tolist() == [0, 1, 1, 2] and got.group_b.tolist() == [0, 1, 1, 2, 2]


def test_cache_bound_changes_no_result(own, monkeypatch):
    texts = texts_of(3, 60) * 3
    want = [r[:5] for r in own.rows(texts)]
    monkeypatch.setattr(alignment, "CACHE_BYTES", 3_000)
    own.young, own.old, own.held = {}, {}, 0
    got = [r[:5] for t in texts for r in own.rows([t])]
    assert got == want and len(own.young) < 8
    own.young, own.old, own.held = {}, {}, 0


@pytest.mark.parametrize("most", [alignment.HOT, 40, 0])
def test_query_equals_counts_by_loops(spark, own, most):
    """Whatever number of pairs is sent to the tasks, none is lost."""
    rng = random.Random(8)
    words = "the quick brownfox jumps overlazy dogs 12345 naïve 東京 antidisestablishment".split()
    texts = [*ODD[:-3], "x" * 700, *[" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(60)]]
    texts += texts[30:40]
    docs = spark.createDataFrame([(None if i == 33 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("pairs", "times", "row", "n_a", "held")})
    got = {(r["doc_id"] if r["doc_id"] is not None else 33): r for r in alignment.aligned(docs.repartition(5), most=most).collect()}
    links = [plain(own, t) for t in texts]
    held = Counter(pair for x in links for pair in set(x[5]))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    assert len(got) == len(texts)
    for i, x in enumerate(links):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == x[:5]
        assert r["count_sum"] == sum(held[p] for p in x[5])
        assert r["n_best"] == sum(held[p] == best[p[0]] for p in x[5])


def test_threshold_keeps_the_bound(spark):
    df = spark.createDataFrame([(i, n, True) for i, n in enumerate([1] * 50 + [2, 3] * 10 + [9] * 5 + [1000])], "pair int, held long, best boolean")
    for most in (0, 1, 5, 6, 30, 76, 100):
        least = alignment.hot_threshold(df, most)
        assert df.where(F.col("held") >= least).count() <= most
        assert least == 1 or df.where(F.col("held") >= least // 2).count() > most


def test_a_long_text_without_a_blank(own):
    text = "".join(random.Random(5).choice("abcdefgh日é") for _ in range(200_000))
    (got,) = own.rows([text])
    assert got[:5] == plain(own, text)[:5]
