"""Timeline: time expressions in the text, their dates, and how the dates move.

One regular expression finds the expressions, leftmost first and by kind in a fixed order; what each says is read from
the matched text by column expressions, so the scan stays inside Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fabulary.functions.calendar import BRANCHES, SOME_ERAS, STEMS, era_years, index_of_pair, number, wheel_year_near
from fabulary.functions.lexicons import DEICTIC_DAYS, FESTIVALS, HOUR_PERIODS, SOLAR_TERMS, VAGUE_TIMES, WEEKDAYS
from fabulary.functions.lunar import known_months, read_day, to_dates
from fabulary.functions.text import visible_chars
from fabulary.operators.segments import runs

# Fixed values.
MOST_MARKERS, LONG_JUMP, MOST_STEPS, MIN_UNMARKED = 200, 366, 10, 3
MARK = "\x01"
UNIT_DAYS = {"分钟": 1 / 1440, "小时": 1 / 24, "秒钟": 1 / 86400, "星期": 7.0, "礼拜": 7.0, "个月": 30.0, "月": 30.0, "天": 1.0, "日": 1.0, "周": 7.0, "年": 365.0}
_N = "(?:[0-9]+|十[一二三四五六七八九两]?|[一二三四五六七八九两](?:十[一二三四五六七八九两]?)?)"
_Y = "(?:(?<![0-9])[1-9][0-9]{2,3}(?![0-9])|[〇零一二三四五六七八九]{3,})"
_LUNAR_DAY = "(?:初[一二三四五六七八九十]|廿[一二三四五六七八九十]|十五|三十)"
_NAMED_MONTH = f"闰?(?:正|冬|腊|{_N})月"
_LUNAR_TAIL, _SOLAR_TAIL = f"{_NAMED_MONTH}{_LUNAR_DAY}", f"{_NAMED_MONTH}{_N}[日号]"
#: Precisions of dates that can be put in order.
ORDERED = ("day", "month", "era_day", "lunar_day")


def _reigns(names: Sequence[str]) -> str:
    """The names by their first character, longest first: at most places one comparison refuses them all."""
    by_first: dict[str, list[str]] = {}
    for name in sorted(set(names), key=lambda n: (-len(n), n)):
        by_first.setdefault(name[0], []).append(name[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by_first.items()))


def forms(eras: Sequence[str] = ()) -> dict[str, str]:
    """Regular expression of each form, in the order in which they are tried at a place."""
    words = lambda ws: "|".join(sorted(ws, key=lambda w: -len(w)))
    found = {"absolute": f"{_Y}(?:-[0-9]+-[0-9]+|/[0-9]+/[0-9]+|年(?:{_N}月(?:{_N}[日号])?)?)", "month_day": f"{_N}月{_N}[日号]"}
    if eras:
        # Tried only where a number and the word for year follow within the length of a name.
        found["era_year"] = f"(?=[{''.join(sorted({e[0] for e in eras}))}].{{1,{max(map(len, eras)) - 1}}}(?:元|{_N})年)(?:{_reigns(eras)})(?:元|{_N})年(?:{_LUNAR_TAIL}|{_SOLAR_TAIL})?"
    return found | {
        "ganzhi_year": f"[{STEMS}][{BRANCHES}]年(?:{_LUNAR_TAIL})?",
        "lunar_date": f"闰?(?:正|冬|腊|{_N})月{_LUNAR_DAY}|闰?[正冬腊]月|闰{_N}月",
        "offset": f"(?:半|{_N})(?:{words(UNIT_DAYS)})(?:之后|以后|后|之前|以前|前)",
        "month": f"{_N}月(?!{_N}[日号])",
        "day": "(?<![月0-9])[0-9]+[日号]",
        "lunar_day": "[初廿][一二三四五六七八九十]",
        "deictic": words(DEICTIC_DAYS),
        "vague": words(VAGUE_TIMES),
        "term": words([*SOLAR_TERMS, *FESTIVALS, *HOUR_PERIODS, *[w for w in WEEKDAYS if not w.startswith("周")]]) + "|(?<![东西北后])周[一二三四五六日天末](?![期代朝])",
    }


def first_characters(eras: Sequence[str] = ()) -> str:
    """The characters with which some form begins; everywhere else a text is passed over at once.

    Before the class of all of them stands the range they lie in: it refuses a Latin letter by two comparisons.
    """
    words = [*DEICTIC_DAYS, *VAGUE_TIMES, *SOLAR_TERMS, *FESTIVALS, *HOUR_PERIODS, *WEEKDAYS, *eras]
    known = sorted({w[0] for w in words} | set("〇零一二三四五六七八九十两半闰正冬腊初廿周") | set(STEMS))
    return f"(?=[0-9{known[0]}-{known[-1]}])[0-9{''.join(known)}]"


def markers(seg: DataFrame, eras: Sequence[str] = (), most: int = MOST_MARKERS) -> DataFrame:
    """One row per time expression, the first `most` of each document: form, kind, date, offset in days, place in the text.

    The text is read in one pass; what is shuffled for the places is a number for each block and the expressions found.
    """
    kinds = forms(eras)
    first = first_characters(eras)
    pattern = f"(?={first})(?:" + "|".join(f"(?:{p})" for p in kinds.values()) + ")"
    text = F.col("content")
    found = F.when(text.rlike(first), F.regexp_extract_all(text, F.lit(f"(?:{pattern})"), F.lit(0)))
    blocks = seg.select("doc_id", "seq", "seg", "label", found.alias("found"), visible_chars(text).alias("chars"), "content")
    # Cut at a mark that stands for each expression: split by a regular expression would compile it for every row.
    marked = F.regexp_replace(F.translate(text, MARK, " "), pattern, MARK)
    gaps = F.when(F.size("found") > 0, F.slice(F.split(marked, MARK, -1), F.lit(1), F.size("found")))
    blocks = blocks.select("doc_id", "seq", "seg", "label", "chars", F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.col("found").alias("text")).alias("found"))
    whole, upto = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("before", F.coalesce(F.sum("chars").over(upto), F.lit(0))).withColumn("total", F.sum("chars").over(whole)).where(F.size("found") > 0)
    rows = placed.select("doc_id", "seq", "seg", "label", "before", "total", F.posexplode("found").alias("nth", "m"))
    inside = Window.partitionBy("doc_id", "seq").orderBy("nth")
    start = F.sum(F.col("m.gap") + F.length("m.text")).over(inside) - F.length("m.text")
    rows = rows.select("doc_id", "seq", "seg", "label", "nth", "before", "total", "m.text", start.alias("start"))
    t = F.col("text")
    form = F.lit(None).cast("string")
    for name, p in reversed(kinds.items()):
        plain = p.replace("(?<![0-9])", "").replace("(?<![月0-9])", "").replace("(?<![东西北后])", "").replace("(?![期代朝])", "")
        form = F.when(t.rlike(f"^(?:{plain})$"), name).otherwise(form)
    rows = rows.withColumn("form", form).withColumn("position", (F.col("before") + F.col("start")) / F.greatest(F.col("total"), F.lit(1)))
    # Refused rows are passed over in the numbering and go after it: a filter before it would read every expression again for its condition.
    upto_here = Window.partitionBy("doc_id").orderBy("seq", "nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = _read(rows, eras).withColumn("marker", (F.count_if("known").over(upto_here) - 1).cast("int"))
    return rows.where(F.col("known") & (F.col("marker") < most)).drop("before", "total", "nth", "known")


def _part(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))


def _read(rows: DataFrame, eras: Sequence[str] = ()) -> DataFrame:
    """Kind, date and offset of each expression; `known` is false for one that no calendar has.

    `era` and `regnal`: name and number of a reign year; `tail`: month, day, leap and lunar of what follows a named year.
    """
    parts = {
        "_year": f"^({_Y.replace('(?<![0-9])', '').replace('(?![0-9])', '')})[-/年]", "_month": f"年({_N})月", "_iso_month": "^[0-9]+[-/]([0-9]+)",
        "_day": f"月({_N})[日号]$", "_iso_day": "[-/]([0-9]+)$", "_count": f"^({_N})",
    }
    rows = rows.withColumns({n: _part(p) for n, p in parts.items()})
    rows = rows.withColumn("_year", number(F.col("_year"))).withColumn("_count", number(F.col("_count")))
    rows = rows.withColumn("_month", F.coalesce(number(F.col("_month")), F.col("_iso_month").try_cast("int"))).withColumn("_day", F.coalesce(number(F.col("_day")), F.col("_iso_day").try_cast("int")))
    year, month, day = F.col("_year"), F.col("_month"), F.col("_day")
    iso = F.format_string("%04d-%02d-%02d", year, F.coalesce(month, F.lit(1)), F.coalesce(day, F.lit(1)))
    absolute = F.col("form") == "absolute"
    date = F.when(absolute, F.try_to_date(iso, "yyyy-MM-dd"))
    units = F.lit(None).cast("double")
    for unit, days in reversed(UNIT_DAYS.items()):
        units = F.when(F.col("text").rlike(f"{unit}(?:之后|以后|后|之前|以前|前)$"), days).otherwise(units)
    count = F.when(F.col("text").startswith("半"), 0.5).otherwise(F.col("_count").cast("double"))
    sign = F.when(F.col("text").rlike("前$"), -1.0).otherwise(1.0)
    deictic = F.element_at(F.create_map(*[F.lit(x) for kv in DEICTIC_DAYS.items() for x in kv]), F.col("text"))
    kind = F.when(absolute, "absolute").when(F.col("form").isin("offset", "deictic"), "relative").when(F.col("form").isin("vague", "term"), "vague").otherwise("partial")
    precision = F.when(absolute, F.when(day.isNotNull(), "day").when(month.isNotNull(), "month").otherwise("year")).otherwise(F.col("form"))
    made = rows.select(
        "*", kind.alias("kind"), precision.alias("precision"), date.alias("date"), year.alias("year"),
        F.when(F.col("form") == "offset", sign * count * units).when(F.col("form") == "deictic", deictic).otherwise(0.0).alias("offset_days"),
        F.when(F.col("form") == "ganzhi_year", index_of_pair(F.substring("text", 1, 2))).alias("wheel"),
    ).drop(*parts)
    made = _with_named_years(made, eras)
    known = (~absolute | F.col("date").isNotNull()) & ((F.col("form") != "ganzhi_year") | F.col("wheel").isNotNull())
    return made.withColumn("known", F.coalesce(known, F.lit(False)))


def _with_named_years(rows: DataFrame, eras: Sequence[str]) -> DataFrame:
    """rows with era, regnal and tail; step by step, so that no expression is repeated inside another."""
    t, none, c = F.col("text"), F.lit("").cast("string"), F.col
    reign = (c("form") == "era_year") if eras else F.lit(False)
    rows = rows.withColumn("era", F.when(reign, _part(f"^({_reigns(eras)})") if eras else none))
    rows = rows.withColumn("_after", F.when(reign, F.substring(t, F.length("era") + 1, F.lit(99)))).withColumn("_tail", F.when(c("form").isin("era_year", "ganzhi_year"), F.nullif(F.regexp_extract(t, f"年({_NAMED_MONTH}.+)$", 1), F.lit(""))))
    rows = rows.withColumn("_no", F.regexp_extract("_after", f"^({_N})年", 1)).withColumn("_name", F.regexp_extract("_tail", f"^闰?(正|冬|腊|{_N})月", 1)).withColumn("_said", F.regexp_extract("_tail", "月(.+)$", 1))
    rows = rows.withColumn("_solar", c("_said").rlike("[日号]$")).withColumn("_digits", F.regexp_replace("_said", "[日号]$", ""))
    month = F.when(c("_name") == "正", 1).when(c("_name") == "冬", 11).when(c("_name") == "腊", 12).otherwise(number(c("_name")))
    rows = rows.withColumn("regnal", F.when(reign, F.when(c("_after").startswith("元年"), 1).otherwise(number(c("_no")))).cast("int")).withColumn("_m", month.cast("int"))
    rows = rows.withColumn("_d", F.when(c("_solar"), number(c("_digits"))).otherwise(read_day(c("_said"))).cast("int"))
    tail = F.struct(c("_m").alias("month"), c("_d").alias("day"), c("_tail").startswith("闰").alias("leap"), (~c("_solar")).alias("lunar"))
    return rows.withColumn("tail", F.when(c("_tail").isNotNull(), tail)).drop("_after", "_tail", "_no", "_name", "_said", "_solar", "_digits", "_m", "_d")


def nearest(rows: DataFrame, key: str, order: str, value: str, name: str = "nearest") -> DataFrame:
    """rows with the nearest other known value of their key by place in order, the earlier of two equally near."""
    w = Window.partitionBy(key).orderBy(order)
    known = rows.withColumn("_at", F.row_number().over(w)).withColumn("_v", F.when(F.col(value).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(value).alias("v"))))
    back = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first("_v", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    placed = known.withColumn("_b", back).withColumn("_a", ahead)
    take_ahead = F.col("_b").isNull() | (F.col("_a.at") - F.col("_at") < F.col("_at") - F.col("_b.at"))
    return placed.withColumn(name, F.when(take_ahead & F.col("_a").isNotNull(), F.col("_a.v")).otherwise(F.col("_b.v"))).drop("_at", "_v", "_b", "_a")


def anchored(found: DataFrame, eras: DataFrame | None = None, calendar: DataFrame | None = None) -> DataFrame:
    """Years of reigns looked up, and years of the wheel placed by the nearest dated expression; those without one stay undated.

    eras: reigns (name, start_year, end_year), by default the built-in ones. A number that no reign of its name reached is
    refused: its row goes. Where several reigns allow it, all their years are kept in `years`, and the row stays
    partial. calendar: months of the lunar calendar, by default those of functions.lunar; a lunar day
    after a named year becomes a date, or the year alone counts where that month had no such day.
    """
    spark = found.sparkSession
    eras = spark.createDataFrame(SOME_ERAS, "name string, start_year int, end_year int") if eras is None else eras
    named = found.withColumnRenamed("era", "name")
    named = era_years(named, eras).withColumnRenamed("name", "era").where((F.col("form") != "era_year") | (F.size("years") > 0))
    one = (F.col("form") == "era_year") & (F.size("years") == 1)
    near = nearest(named.withColumn("year", F.when(one, F.element_at("years", 1)).otherwise(F.col("year"))), "doc_id", "marker", "year")
    placed = F.when(F.col("wheel").isNotNull() & F.col("nearest").isNotNull(), wheel_year_near(F.col("wheel"), F.col("nearest")))
    told = F.when(one, F.col("year")).otherwise(placed)
    lunar_tail = F.col("tail.lunar")
    rows = near.select("*", told.alias("_told"), *[F.when(told.isNotNull() & lunar_tail, F.col(f"tail.{n}")).alias(f"_{n}") for n in ("month", "day", "leap")])
    rows = to_dates(rows, known_months(spark) if calendar is None else calendar, "_told", "_month", "_day", "_leap", "_lunar")
    solar = F.when(F.col("_told").isNotNull() & ~lunar_tail, F.try_to_date(F.format_string("%04d-%02d-%02d", F.col("_told"), F.col("tail.month"), F.col("tail.day")), "yyyy-MM-dd"))
    year = F.try_to_date(F.format_string("%04d-01-01", F.col("_told")), "yyyy-MM-dd")
    precision = F.when(F.col("_lunar").isNotNull(), "lunar_day").when(solar.isNotNull(), "era_day").otherwise(F.col("precision"))
    return (
        rows.withColumn("precision", precision)
        .withColumn("date", F.coalesce("_lunar", solar, "date", year))
        .withColumn("kind", F.when(F.col("_told").isNotNull(), "absolute").otherwise(F.col("kind")))
        .drop("nearest", "_told", "_month", "_day", "_leap", "_lunar")
    )


def histogram(found: DataFrame) -> DataFrame:
    """doc_id, precision, n: how often each form of time expression occurs in a document."""
    return found.groupBy("doc_id", "precision").agg(F.count("*").alias("n"))


def steps(dated: DataFrame, key: str = "doc_id", order: str = "marker", date: str = "date") -> DataFrame:
    """Adjacent dated rows with the days between them; `step` says backstep (before) or jump (a year or more ahead)."""
    w = Window.partitionBy(key).orderBy(order)
    pair = dated.where(F.col(date).isNotNull()).select(key, order, F.lag(date).over(w).alias("from_date"), F.col(date).alias("to_date")).where(F.col("from_date").isNotNull())
    days = F.datediff("to_date", "from_date")
    return pair.select("*", days.alias("days"), F.when(days < 0, "backstep").when(days >= LONG_JUMP, "jump").alias("step"))


def span(dated: DataFrame, key: str = "doc_id", order: str = "marker", date: str = "date") -> DataFrame:
    """First and last date in reading order, with backsteps and jumps counted."""
    known = dated.where(F.col(date).isNotNull()).groupBy(key).agg(F.min_by(date, order).alias("first_date"), F.max_by(date, order).alias("last_date"), F.datediff(F.max(date), F.min(date)).alias("span_days"))
    moved = steps(dated, key, order, date).groupBy(key).agg(F.count_if(F.col("step") == "backstep").alias("backsteps"), F.count_if(F.col("step") == "jump").alias("jumps"))
    return known.join(moved, key, "left").fillna(0, ["backsteps", "jumps"])


def unmarked(axis: DataFrame, found: DataFrame, least: int = MIN_UNMARKED) -> DataFrame:
    """Runs of segments without any time expression."""
    curve = axis.join(found.groupBy("doc_id", "seg").agg(F.count("*").alias("markers")), ["doc_id", "seg"], "left").fillna(0, ["markers"])
    each = runs(curve, "markers = 0").groupBy("doc_id", "run").agg(F.min("seg").alias("from_seg"), F.max("seg").alias("to_seg"), F.count("*").alias("n"))
    return each.where(F.col("n") >= least).drop("run")


