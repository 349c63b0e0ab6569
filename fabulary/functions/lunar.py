"""The Chinese lunisolar calendar as a table of months, computed by columns from new moons and the sun's longitude.

A month begins on the day of a new moon, in the time of Beijing. Each month in which the sun reaches a multiple of 30 degrees holds
a major term; that of the winter solstice is the eleventh. Where thirteen months lie between two solstices, the first of them without
a major term is a leap month and takes the number of the one before. These rules hold since 1645; before that the
calendar counted mean terms, and the table doesn't go there: such dates are refused.

Positions follow the usual series (new moons to some seconds, the sun to half a minute of arc), so a new moon or a term that falls within
a few minutes of midnight can be a day off; the almanacs of the 17th to 19th centuries, computed by hand, differ in such cases too.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1645, 2150
#: Seconds by which uniform time is ahead of the earth's rotation, by year; straight lines between them.
CLOCK = ((1600, 120), (1650, 48), (1700, 9), (1750, 13), (1800, 14), (1850, 7), (1880, -5), (1900, -3), (1920, 21), (1950, 29), (1970, 40), (1990, 57), (2010, 66), (2030, 76), (2100, 120), (2200, 250))
#: Fixed values of the series of new moons: amplitude in days, multiples of the sun's anomaly, the moon's anomaly and the argument of latitude, and the power of the eccentricity.
MOON = (
    (-0.40720, 0, 1, 0, 0), (0.17241, 1, 0, 0, 1), (0.01608, 0, 2, 0, 0), (0.01039, 0, 0, 2, 0), (0.00739, -1, 1, 0, 1), (-0.00514, 1, 1, 0, 1), (0.00208, 2, 0, 0, 2),
    (-0.00111, 0, 1, -2, 0), (-0.00057, 0, 1, 2, 0), (0.00056, 1, 2, 0, 1), (-0.00042, 0, 3, 0, 0), (0.00042, 1, 0, 2, 1), (0.00038, 1, 0, -2, 1), (-0.00024, -1, 2, 0, 1), (-0.00007, 2, 1, 0, 0),
)
#: Fixed values of the planets' part in the new moons: amplitude in millionths of a day, phase and change by month, in degrees.
PLANETS = (
    (325, 299.77, 0.107408), (165, 251.88, 0.016321), (164, 251.83, 26.651886), (126, 349.42, 36.412478), (110, 84.66, 18.206239), (62, 141.74, 53.303771), (60, 207.14, 2.453732),
    (56, 154.84, 7.306860), (47, 34.52, 27.261239), (42, 207.19, 0.121824), (40, 291.34, 1.844379), (37, 161.72, 24.198154), (35, 239.56, 25.513099), (23, 331.55, 3.592518),
)
_MONTH, _EPOCH_2000, _BEIJING = 29.530588861, 2451545.0, 8 / 24
_DAY_OF_1970 = 2440588  # Julian day number whose noon lies in the first day of 1970


def _polynomial(t: Column, *by: float) -> Column:
    out = F.lit(float(by[-1]))
    for c in reversed(by[:-1]):
        out = out * t + F.lit(float(c))
    return out


def _clock(day: Column) -> Column:
    """Days by which uniform time is ahead at a Julian day."""
    year = (day - _EPOCH_2000) / 365.25 + 2000
    out = F.lit(float(CLOCK[-1][1]))
    for (y0, s0), (y1, s1) in reversed(list(zip(CLOCK, CLOCK[1:]))):
        out = F.when(year < y1, s0 + (year - y0) * ((s1 - s0) / (y1 - y0))).otherwise(out)
    return out / 86400


def new_moon(k: Column) -> Column:
    """Julian day, in uniform time, of the k-th new moon from January 2000 on."""
    k = k.cast("double")
    t = k / 1236.85
    day = 2451550.09766 + _MONTH * k + _polynomial(t, 0, 0, 0.00015437, -0.000000150, 0.00000000073)
    sun = F.radians(2.5534 + 29.10535670 * k + _polynomial(t, 0, 0, -0.0000014, -0.00000011))
    moon = F.radians(201.5643 + 385.81693528 * k + _polynomial(t, 0, 0, 0.0107582, 0.00001238, -0.000000058))
    node = F.radians(160.7108 + 390.67050284 * k + _polynomial(t, 0, 0, -0.0016118, -0.00000227, 0.000000011))
    ascending = F.radians(124.7746 - 1.56375588 * k + _polynomial(t, 0, 0, 0.0020672, 0.00000215))
    round_ = _polynomial(t, 1, -0.002516, -0.0000074)
    for size, a, b, c, power in MOON:
        day = day + size * F.pow(round_, F.lit(power)) * F.sin(a * sun + b * moon + c * node)
    day = day - 0.00017 * F.sin(ascending)
    for size, phase, rate in PLANETS:
        day = day + size / 1e6 * F.sin(F.radians(phase + rate * k))
    return day


def sun_longitude(t: Column) -> Column:
    """The sun's apparent longitude in degrees, counted on through the years, at a time in centuries of uniform time from 2000 on."""
    mean = _polynomial(t, 280.46646, 36000.76983, 0.0003032)
    m = F.radians(_polynomial(t, 357.52911, 35999.05029, -0.0001537))
    centre = _polynomial(t, 1.914602, -0.004817, -0.000014) * F.sin(m) + _polynomial(t, 0.019993, -0.000101) * F.sin(2 * m) + 0.000289 * F.sin(3 * m)
    # The pull of the planets and the moon, then nutation and aberration.
    pulls = sum((size * F.cos(F.radians(phase + rate * t)) for size, phase, rate in ((0.00134, 153.23, 22518.7541), (0.00154, 216.57, 45037.5082), (0.00200, 312.69, 32964.3577), (0.00178, -19.51, 20.20))), F.lit(0.0)) + 0.00179 * F.sin(F.radians(350.74 + 445267.1142 * t) - 0)
    return mean + centre + pulls * 0.5 - 0.00569 - 0.00478 * F.sin(F.radians(125.04 - 1934.136 * t))


def months(spark: SparkSession, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> DataFrame:
    """lunar_year, month, leap, first_day, days: every month of the years. Some thousand rows, whatever is dated by them."""
    low, high = math.floor((first - 2001) * 12.3685) - 3, math.ceil((last - 1998) * 12.3685) + 3
    # Step by step, so that no long expression stands in another one several times.
    rows = spark.range(low, high).select(F.col("id").alias("k"), new_moon(F.col("id")).alias("moon"))
    rows = rows.select("k", F.floor(F.col("moon") - _clock(F.col("moon")) + _BEIJING + 0.5).alias("d"))  # number of the day in Beijing
    moment = F.col("d") - 0.5 - _BEIJING  # the day's first
    rows = rows.withColumn("t", (moment + _clock(moment) - _EPOCH_2000) / 36525).withColumn("from_term", F.floor(sun_longitude(F.col("t")) / 30))
    after = Window.orderBy("k")
    rows = rows.select("k", "d", "from_term", F.lead("d").over(after).alias("next"), F.lead("from_term").over(after).alias("to_term")).where("next IS NOT NULL")
    # Nine terms after the spring equinox comes the solstice; each count of solstices is one span of months from the eleventh on.
    rows = rows.withColumn("span", F.floor((F.col("to_term") - 9) / 12))
    span = Window.partitionBy("span")
    rows = rows.withColumn("nth", F.row_number().over(span.orderBy("k")) - 1).withColumn("many", F.count("*").over(span))
    empty = F.when((F.col("many") == 13) & (F.col("nth") > 0) & (F.col("from_term") == F.col("to_term")), F.col("nth"))
    rows = rows.withColumn("leap_at", F.min(empty).over(span)).withColumn("leap", F.coalesce(F.col("nth") == F.col("leap_at"), F.lit(False)))
    place = F.col("nth") - F.when(F.col("nth") >= F.col("leap_at"), 1).otherwise(0)
    day = lambda d: F.date_add(F.lit("1970-01-01").cast("date"), (d - _DAY_OF_1970).cast("int"))
    # The span's solstice lies in December of the year in which its eleventh month begins.
    solstice = F.year(F.first(day(F.col("d"))).over(span.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    found = rows.select((solstice + F.when(place >= 2, 1).otherwise(0)).alias("lunar_year"), (F.pmod(place + 10, F.lit(12)) + 1).cast("int").alias("month"), "leap", day(F.col("d")).alias("first_day"), (F.col("next") - F.col("d")).cast("int").alias("days"))
    return found.where(F.col("lunar_year").between(first, last))


_KNOWN: dict[str, pa.Table] = {}


def known_months(spark: SparkSession) -> DataFrame:
    """months(), computed once for an application: some thousand rows that plans carry with them."""
    own = spark.sparkContext.applicationId
    if own not in _KNOWN:
        _KNOWN[own] = months(spark).toArrow()
    return spark.createDataFrame(_KNOWN[own])


def to_dates(rows: DataFrame, calendar: DataFrame, year: str, month: str, day: str, leap: str, name: str = "lunar_as_date") -> DataFrame:
    """rows with the date of their lunar year, month, day and leap mark; null where no month of that name was, or it had fewer days.

    The calendar has a bounded number of rows and is broadcast; rows without a lunar date are kept.
    """
    c = F.broadcast(calendar.select("lunar_year", F.col("month").alias("_of_month"), F.col("leap").alias("_of_leap"), "first_day", "days"))
    joined = rows.join(c, (F.col(year) == F.col("lunar_year")) & (F.col(month) == F.col("_of_month")) & (F.coalesce(F.col(leap), F.lit(False)) == F.col("_of_leap")), "left")
    date = F.when((F.col(day) >= 1) & (F.col(day) <= F.col("days")), F.date_add("first_day", F.col(day).cast("int") - 1))
    return joined.withColumn(name, date).drop("lunar_year", "_of_month", "_of_leap", "first_day", "days")


def read_day(text: Column) -> Column:
    """1 to 30 from a day's name: 初八, 十五, 廿三, 三十; null for others."""
    digit = lambda c: F.when(c != "", F.instr(F.lit("一二三四五六七八九十"), c))
    last = digit(F.substring(text, 2, 1))
    return (
        F.when(text == "十五", 15).when(text == "三十", 30).when(text == "二十", 20)
        .when(text.startswith("初") & (last > 0), last)
        .when(text.startswith("廿") & (last > 0), F.when(last == 10, 20).otherwise(20 + last))
    )


def leap_months(spark: SparkSession, years: Sequence[int]) -> dict[int, int]:
    """The leap month of those years that have one."""
    rows = months(spark, min(years), max(years)).where("leap").select("lunar_year", "month").collect()
    return {r["lunar_year"]: r["month"] for r in rows if r["lunar_year"] in set(years)}
