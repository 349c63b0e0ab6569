"""Text primitives as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TERMINATORS = "。！？；…!?;\n"
OPENERS, CLOSERS = "“「『\"", "”」』"
CJK = "一-鿿㐀-䶿豈-﫿"
CLAUSE_MARKS = "，、；：,"


def _class(chars: str) -> str:
    """A regular-expression class of these characters."""
    return "[" + "".join("\\" + c if c in "\\]^-[" else "\\n" if c == "\n" else c for c in chars) + "]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, also where the body is evaluated for each element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def has_text(text: Column) -> Column:
    """Whether anything but white space is in it; stops at the first such character."""
    return text.rlike(r"(?U)\S")


def class_chars(text: Column, chars: str) -> Column:
    """Code points of a regular-expression class (what stands between its brackets)."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def visible_chars(text: Column) -> Column:
    """Code points that are not (Unicode) white space."""
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def sentences(text: Column, terminators: str = TERMINATORS) -> Column:
    """ARRAY<STRING>: the text cut at terminators, blank parts dropped."""
    return F.filter(F.split(text, _class(terminators)), has_text)


def sentence_lengths(text: Column, terminators: str = TERMINATORS) -> Column:
    """ARRAY<INT>: visible characters of each sentence. White space goes once from the whole text, then it is cut."""
    ends = "".join(c for c in terminators if c.isspace())
    blank = rf"(?U)[\s&&[^{_class(ends)[1:-1]}]]+" if ends else r"(?U)\s+"
    return F.filter(F.transform(F.split(F.regexp_replace(text, blank, ""), _class(terminators)), F.length), lambda n: n > 0)


def quoted_chars(text: Column) -> Column:
    """Visible characters inside quotation marks; a straight quote opens and never closes."""
    inside = F.regexp_extract_all(text, F.lit('[“「『"]([^”」』]*)'), F.lit(1))
    return F.aggregate(inside, F.lit(0), lambda a, s: a + F.length(F.regexp_replace(s, r'(?U)[\s“「『"]', "")))


def quote_units(text: Column) -> Column:
    """ARRAY<STRING>: what stands between an opening mark and a closing mark, a line end or the end."""
    spans = F.regexp_extract_all(text, F.lit('[“「『"]([^”」』"\\n]*)["”」』\\n]?'), F.lit(1))
    return F.filter(spans, has_text)


def dash_units(text: Column) -> Column:
    """ARRAY<STRING>: lines that open with a dash and hold no quotation mark, without the dash."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*[—–]+") & ~x.rlike('[“「『"]'))
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s*[—–]+", "")), has_text)


def cjk_chars(text: Column) -> Column:
    return class_chars(text, CJK)


def top_level_section(path: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("(root)")).otherwise(F.split(path, " / ")[0])


def count_term(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of one term. Terms nest, so each is counted alone."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("long")


def count_terms(text: Column, terms: list[str]) -> Column:
    total = F.lit(0).cast("long")
    for term in terms:
        total = total + count_term(text, term)
    return total


def clauses(sentence: Column) -> Column:
    return F.regexp_count(sentence, F.lit(_class(CLAUSE_MARKS))) + 1


def syllables(text: Column) -> Column:
    """Syllables of the Latin words of a text: its groups of vowels, and one for each word that has none."""
    mute = "(?<![A-Za-z])[B-DF-HJ-NP-TV-XZb-df-hj-np-tv-xz]++(?![A-Za-z])"
    return F.regexp_count(text, F.lit("[aeiouyAEIOUY]+")) + F.regexp_count(text, F.lit(mute))


def sentence_bucket(chars: Column) -> Column:
    return F.when(chars <= 20, "1-20").when(chars <= 50, "21-50").when(chars <= 100, "51-100").otherwise(">100")


BUCKETS = ("1-20", "21-50", "51-100", ">100")


def round_half_up(value: Column, digits: int) -> Column:
    """Half away from zero of value times a power of ten, in doubles, for values that aren't negative."""
    return F.floor(value * float(10**digits) + 0.5) / float(10**digits)


def identity_key(text: Column) -> Column:
    """Trimmed, full-width ASCII halved, white space single, lower case."""
    full = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    half = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
    return F.lower(F.regexp_replace(F.trim(F.translate(text, full, half)), r"(?U)\s+", " "))


def stable_id(category: Column, text: Column) -> Column:
    return F.concat(F.lit("ent:"), F.substring(F.sha2(F.concat(category, F.lit("\x1f"), identity_key(text)), 256), 1, 16))


def title_key(text: Column) -> Column:
    """A title without tags, white space and punctuation, for matching."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", ""), r"(?U)[\s\p{Punct}\p{IsPunctuation}]", ""))


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """part / whole, 0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part * F.lit(scale), whole.cast("double")), F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
