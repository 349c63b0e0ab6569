"""The models of random strings: trained on a given table, against a plain version, and by alphabet."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fabulary.llm import secret_scan as scan

TABLE = "/root/testdata/sf0.01/documents.parquet"
ALPHABETS = {
    "hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "small": "abcdefghijklmnopqrstuvwxyz", "small and digits": "abcdefghijklmnopqrstuvwxyz0123456789",
    "letters and digits": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "base64": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(TABLE).select("doc_id", "text")


@pytest.fixture(scope="module")
def ratios(docs):
    found = scan.base_spans(docs)
    return scan.transition_ratios(scan.ordinary_samples(docs, found))


def is_random(value, ratios):
    """The rule in plain Python."""
    n = len(scan.ALPHABET)
    model = next((k for k, a in enumerate(scan.RANDOM[:-1]) if set(value) <= set(a)), len(scan.RANDOM) - 1)
    at = [scan.ALPHABET.index(c) for c in value]
    return sum(round(ratios[model * n * n + a * n + b], 9) for a, b in zip(at, at[1:])) > max(scan.LEAST, scan.MARGIN * (len(value) - 1))


def test_recall_by_alphabet_does_not_fall_with_length(ratios):
    rng = random.Random(99)
    for name, alphabet in ALPHABETS.items():
        for length in (20, 24, 32, 48, 64):
            drawn = ["".join(rng.choices(alphabet, k=length)) for _ in range(100)]
            assert sum(is_random(v, ratios) for v in drawn) >= 95, (name, length)


def test_runs_and_identifiers_of_the_table_are_ordinary(docs, ratios):
    runs = [r.value for r in scan.base_spans(docs).select(F.explode("runs").alias("r")).select("r.value").collect()]
    assert len(runs) > 100 and sum(is_random(v, ratios) for v in runs) <= 0.01 * len(runs)
    rng = random.Random(7)
    words = sorted({w for r in docs.limit(200).collect() for w in re.findall("(?<![^ ])[a-z]{3,10}(?![^ ])", r.text or "")})
    made = [j.join(rng.choices(words, k=4)) for j in "_-/" for _ in range(200)] + ["".join(w.capitalize() for w in rng.choices(words, k=4)) for _ in range(200)]
    made += [str(rng.randrange(10**17, 10**18)) for _ in range(200)] + [f"2024-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}-{rng.choice(words)}" for _ in range(200)]
    made = [m for m in made if len(m) >= scan.RUN_LENGTH]
    assert sum(is_random(m, ratios) for m in made) <= 0.01 * len(made)


def test_the_query_judges_as_the_plain_version(spark, docs, ratios):
    rng = random.Random(3)
    values = ["".join(rng.choices(a, k=rng.randint(16, 40))) for a in ALPHABETS.values() for _ in range(10)] + ["report_of_the_committee_2024", "aaaaaaaaaaaaaaaaaaaa", "x" * 5_000]
    known = docs.unionByName(spark.createDataFrame([(10_000_000 + i, f"see {v} now") for i, v in enumerate(values)], "doc_id long, text string"))
    found = scan.base_spans(known)
    own = scan.transition_ratios(scan.ordinary_samples(known, found))
    judged = scan.scan(known).where("doc_id >= 10000000").orderBy("doc_id").collect()
    hexes = re.compile(scan.HEX)
    for row, value in zip(judged, values, strict=True):
        if not hexes.search(value):
            assert [s["kind"] for s in row.spans] == ["random"] * is_random(value, own), value


def test_the_main_path_has_no_python_workers(docs):
    plan = scan.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
