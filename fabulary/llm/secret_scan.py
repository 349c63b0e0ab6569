"""Secret scans in DataFrame functions only.

Three patterns give base spans. Beyond them, runs of 16 key characters or more are judged by first-order Markov models
over characters: one of random strings for each usual alphabet, and one of ordinary identifiers. The random ones are trained on
a labelled sample drawn by seed, since what secrets a corpus holds says little of those to come. The ordinary one is trained on samples that the corpus
labels itself: runs outside base spans that joining marks or capitals part into numbers and words of at most 24 letters, and the words and numbers of
at most WORD_DOCS texts of at most WORD_BYTES, in the order of their hash. A long run without a mark is no sample, for it may be a secret. Every run is judged by the
model of the smallest alphabet that has all its characters: it is a secret when its log-likelihood ratio against the ordinary model exceeds LEAST in
sum and MARGIN per transition. What base spans leave of a run is a run of its own if it is long enough. Identifiers
drawn at random, such as UUIDs, look like secrets to any such model and are reported.

Transitions are counted by a grouped sum whose result has at most as many rows as there are pairs
of key characters; it becomes a literal array of the second step. Places are code points, ends are exclusive.

Cases: a null text is the empty one and has no spans; matches of one kind do not overlap, those of different kinds may;
repeated rows pass through one to one; an empty table gives no rows; without any ordinary sample that model is uniform over all key characters,
and every run of a smaller alphabet is random; an output column replaces an input column of the same name, other columns are kept; a long text is read whole;
of spans that start together the kind first named comes first; rows without an id are kept like others.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulary.llm.common import cut, table, text_of

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: What every match of ASSIGN holds; most texts hold none.
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
#: A maximal run from its first AKIA on; shorter runs fail anyway.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex")
RUN_LENGTH = 16
RUN = rf"[A-Za-z0-9+/_-]{{{RUN_LENGTH},}}={{0,2}}"
_PART = "(?:[A-Z]?[a-z]{1,23}|[A-Z]{1,15}|[0-9]{1,15})"
#: Several parts with joining marks between them, or words told apart by their capitals.
ORDINARY = f"^(?:[+/_=-]*{_PART}(?:[+/_=-]+{_PART})+[+/_=-]*|[A-Z]?[a-z]{{2,23}}(?:[A-Z][a-z]{{1,23}})+(?:[A-Z]?[0-9]{{1,4}})?)$"
#: Words and numbers that are ordinary, and the bounds of the sample of texts that they come from.
WORDS = "(?<![A-Za-z0-9+/_=-])[A-Za-z]?(?:[a-z]{1,14}|[A-Z]{1,14}|[0-9]{1,14})(?![A-Za-z0-9+/_=-])"
WORD_DOCS, WORD_BYTES = 1_000, 200_000
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-=."
_SMALL, _LARGE, _DIGITS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
#: Alphabets of random strings, the smaller first: digits (of which the ordinary sample has as many), hexadecimal, base32, letters, letters and digits, base64 and its form for addresses.
RANDOM = (_DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _SMALL, _LARGE, _LARGE + "234567", _SMALL + _DIGITS, _LARGE + _DIGITS, _SMALL + _LARGE, _SMALL + _LARGE + _DIGITS, _SMALL + _LARGE + _DIGITS + "+/", _SMALL + _LARGE + _DIGITS + "-_", ALPHABET)
#: Strings drawn for each alphabet, their lengths, and the seed.
DRAWN, LENGTHS, SEED = 2_000, (16, 64), 17
#: Log-likelihood ratio per transition, and in sum, above which a run counts as random.
MARGIN, LEAST = 0.35, 8.0
#: Transitions that the single-character distribution counts for in each context.
LEAN = 20.0
MASK = "[SECRET]"

_SPAN = "array<struct<start:int,stop:int,value:string>>"


def _spans(text: Column, pattern: str, hint: Column) -> Column:
    """Leftmost non-overlapping matches: a match starts behind all gaps and matches before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["value"])
        one = F.array(F.struct(start.alias("start"), stop.alias("stop"), pair["value"].alias("value")))
        return F.struct(stop.alias("at"), F.concat(state["found"], one).alias("found"))

    none = F.array().cast(_SPAN)
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("value"))
    every = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda s: s["found"])
    return F.when(hint, every).otherwise(none)


def _kind(spans: Column, kind: str) -> Column:
    rank = (*KINDS, "random").index(kind)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `base`, the spans of the three patterns by start, then kind, and `runs`, other runs of key characters."""
    t = text_of(text)
    assign = F.filter(_spans(t, ASSIGN, t.rlike(ASSIGN_HINT)), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 8)
    access = _spans(t, ACCESS, F.contains(t, F.lit("AKIA")))
    hexes = _spans(t, HEX, t.rlike(HEX))
    base = F.array_sort(F.concat(_kind(assign, "assign"), _kind(access, "access"), _kind(hexes, "hex")))
    runs = _kind(_spans(t, RUN, t.rlike(RUN)), "random")

    def uncovered(r: Column) -> Column:
        """The run, or what lies before the first and behind the last base span that it meets."""
        met = F.filter(F.col("base"), lambda b: (r["start"] < b["stop"]) & (b["start"] < r["stop"]))
        first, last = F.array_min(F.transform(met, lambda b: b["start"])), F.array_max(F.transform(met, lambda b: b["stop"]))
        piece = lambda start, stop: F.struct(start.alias("start"), r["rank"].alias("rank"), stop.alias("stop"), r["kind"].alias("kind"), F.substring(r["value"], start - r["start"] + 1, F.greatest(stop - start, F.lit(0))).alias("value"))
        left = F.array(piece(r["start"], first), piece(last, r["stop"]))
        return F.when(F.size(met) == 0, F.array(r)).otherwise(F.filter(left, lambda x: F.length(x["value"]) >= RUN_LENGTH))

    free = F.flatten(F.transform(F.col("runs"), uncovered))
    return df.withColumn("base", base).withColumn("runs", runs).withColumn("runs", free)


def _secret_value(span: Column) -> Column:
    return F.when(span["kind"] == "assign", F.regexp_extract(span["value"], ASSIGN, 2)).otherwise(span["value"])


def drawn(alphabet: str, many: int = DRAWN, seed: int = SEED) -> list[str]:
    """The labelled sample of random strings over an alphabet."""
    rng = random.Random(f"{seed} {alphabet}")
    return ["".join(rng.choices(alphabet, k=rng.randint(*LENGTHS))) for _ in range(many)]


def numbers(many: int = DRAWN, seed: int = SEED) -> list[str]:
    """The labelled sample of ordinary numbers: digits in groups, joined as dates, versions and telephone numbers are."""
    rng = random.Random(f"{seed} numbers")
    group = lambda: "".join(rng.choices(_DIGITS, k=rng.randint(1, 8)))
    return [rng.choice(("-", "-", "_", "/", "+", "")).join(group() for _ in range(rng.randint(2, 6))) for _ in range(many)]


def ordinary_samples(df: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """value: ordinary runs of all documents, and identifiers made of neighbouring words and numbers of the sampled texts. found: `runs` of all documents."""
    t = text_of(text)
    # Twice the share that is wanted, by hash, so that a task hands on a few texts only; copies of a text count once.
    n = found.count()
    top = (1 << 63) - 1 if n <= 2 * WORD_DOCS else (2 * WORD_DOCS * (1 << 64)) // n - (1 << 63)
    some = df.select(t.alias("t")).withColumn("h", F.xxhash64("t")).where((F.col("h") <= top) & F.octet_length("t").between(1, WORD_BYTES))
    sample = some.groupBy("h").agg(F.min("t").alias("t")).orderBy("h").limit(WORD_DOCS)
    words = sample.select(F.regexp_extract_all("t", F.lit(WORDS), F.lit(0)).alias("w")).where(F.size("w") > 1)

    def joined(word: Column, nth: Column) -> Column:
        """A word and the next, joined in one of the usual ways, by turns."""
        following, turn = F.element_at("w", nth + 2), F.pmod(nth, F.lit(6))
        plain = F.concat(word, F.element_at(F.array(*[F.lit(j) for j in ("_", "-", "/", "")]), F.least(turn, F.lit(3)) + 1), following)
        return F.when(turn < 4, plain).when(turn == 4, F.concat(word, F.initcap(following))).otherwise(F.upper(F.concat(word, F.lit("_"), following)))

    made = words.select(F.explode(F.transform(F.slice("w", 1, F.size("w") - 1), joined)).alias("value"))
    return made.unionByName(found.select(F.explode(F.filter("runs", lambda r: r["value"].rlike(ORDINARY))).alias("r")).select("r.value"))


def _counts(values: DataFrame) -> dict[str, int]:
    """How often each pair of characters occurs; at most as many rows as pairs of key characters."""
    pairs = values.where(F.length("value") > 1).select(F.explode(F.expr("transform(sequence(1, length(value) - 1), i -> substring(value, i, 2))")).alias("pair"))
    return {r["pair"]: r["count"] for r in pairs.groupBy("pair").count().collect()}


def _paired(values: list[str]) -> dict[str, int]:
    seen: dict[str, int] = {}
    for value in values:
        for a, b in zip(value, value[1:]):
            seen[a + b] = seen.get(a + b, 0) + 1
    return seen


def _logs(seen: dict[str, int]) -> dict[str, float]:
    """Log probability of each second character after each first one. Rare contexts lean on how often each character occurs at all, which is smoothed by one."""
    n = len(ALPHABET)
    before = {a: sum(seen.get(a + b, 0) for b in ALPHABET) for a in ALPHABET}
    total = sum(before.values())
    alone = {b: (sum(seen.get(a + b, 0) for a in ALPHABET) + 1) / (total + n) for b in ALPHABET}
    return {a + b: math.log((seen.get(a + b, 0) + LEAN * alone[b]) / (before[a] + LEAN)) for a in ALPHABET for b in ALPHABET}


def transition_ratios(ordinary: DataFrame) -> list[float]:
    """Log ratio of random to ordinary for each alphabet of RANDOM and each pair of key characters. ordinary: `value` of the ordinary samples."""
    known, out = _counts(ordinary), []
    tables = [_paired(drawn(alphabet)) for alphabet in RANDOM]
    # Numbers are ordinary, whatever their digits: drawn ones make up a fifth of the sample at least.
    told = _paired(numbers())
    weight = max(1, sum(known.values()) // (4 * sum(told.values())))
    for pair, n in told.items():
        known[pair] = known.get(pair, 0) + weight * n
    plain = _logs(known)
    for seen in tables:
        likely = _logs(seen)
        out += [likely[a + b] - plain[a + b] for a in ALPHABET for b in ALPHABET]
    return out


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `spans`: array of (start, rank, stop, kind, value), base spans and those the models add, by start, then kind."""
    found = base_spans(df, text)
    return _judged(found, ordinary_samples(df, found, text))


def _judged(found: DataFrame, ordinary: DataFrame) -> DataFrame:
    n = len(ALPHABET)
    ratios = F.from_json(F.lit(json.dumps([round(r, 9) for r in transition_ratios(ordinary)])), "array<double>")
    place = lambda value, i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1))) - 1

    def model(value: Column) -> Column:
        """Where the ratios of the smallest alphabet that has all characters begin."""
        out = F.lit((len(RANDOM) - 1) * n * n)
        for k in reversed(range(len(RANDOM) - 1)):
            out = F.when(F.translate(value, RANDOM[k], "") == "", k * n * n).otherwise(out)
        return out

    def ratio(value: Column) -> Column:
        steps, start = F.sequence(F.lit(1), F.length(value) - 1), F.struct(model(value).alias("at"), F.lit(0.0).alias("sum"))
        add = lambda s, i: F.struct(s["at"].alias("at"), (s["sum"] + F.element_at(ratios, s["at"] + place(value, i) * n + place(value, i + 1) + 1)).alias("sum"))
        return F.aggregate(steps, start, add, lambda s: s["sum"])

    random_ = F.filter("runs", lambda r: ratio(r["value"]) > F.greatest(F.lit(LEAST), MARGIN * (F.length(r["value"]) - 1)))
    return found.withColumn("spans", F.array_sort(F.concat("base", random_)))


def redact(df: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """df with every span of its text replaced by the mask; spans that overlap are replaced together. Needs `spans`."""
    t = text_of(text)

    def step(state: Column, span: Column) -> Column:
        kept = F.substring(t, state["at"] + 1, span["start"] - state["at"])
        more = F.when(span["start"] >= state["at"], F.concat(state["out"], kept, F.lit(mask))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["stop"]).alias("at"), more.alias("out"))

    whole = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(t, s["at"] + 1, F.length(t))))
    return df.withColumn(text, F.when(F.size("spans") > 0, whole).otherwise(F.col(text)))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = cut(base_spans(docs).drop("text"))
    found = _judged(runs, ordinary_samples(docs, runs))
    many = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[many(k).alias(f"n_{k}") for k in KINDS], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
