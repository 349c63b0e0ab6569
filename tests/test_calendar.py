"""Lunar months, reign years and what the scan of a text makes of them."""

import datetime

import pytest
from pyspark.sql import functions as F

from fabulary.functions import calendar, lunar
from fabulary.operators import findings, segments, timeline


@pytest.fixture(scope="module")
def months(spark):
    return lunar.months(spark).cache()


def scanned(spark, months, *texts, eras=calendar.SOME_ERAS):
    rows = [("d", i, t, f"s{i}", "paragraph", None) for i, t in enumerate(texts)]
    seg = segments.with_segments(spark.createDataFrame(rows, "doc_id string, seq int, content string, section_path string, block_type string, title string"))
    table = spark.createDataFrame(eras, "name string, start_year int, end_year int")
    return timeline.anchored(timeline.markers(seg, [n for n, *_ in eras]), table, months).orderBy("marker")


def told(rows):
    return [(r.text, r.kind, r.precision, None if r.date is None else str(r.date)) for r in rows.collect()]


def test_a_lunar_date_becomes_a_gregorian_one_or_is_refused(spark, months):
    # 2023 has a leap second month and no leap tenth; the twelfth month of 1738 has 29 days; the table begins in 1645.
    want = {
        (2023, 8, 15, False): "2023-09-29", (2023, 12, 8, False): "2024-01-18", (1738, 3, 12, False): "1738-04-30", (1738, 3, 5, False): "1738-04-23", (2023, 2, 1, True): "2023-03-22",
        (1738, 12, 30, False): None, (2023, 10, 1, True): None, (-100, 1, 1, False): None, (2023, 1, 0, False): None, (1600, 1, 1, False): None, (None, 1, 1, False): None,
    }
    rows = spark.createDataFrame(list(want), "y int, m int, d int, l boolean")
    got = lunar.to_dates(rows, months, "y", "m", "d", "l")
    assert {(r.y, r.m, r.d, r.l): r.lunar_as_date and str(r.lunar_as_date) for r in got.collect()} == want


#: Published leap months of 1900 to 2036, and first days of the year.
LEAPS = {1900: 8, 1903: 5, 1906: 4, 1909: 2, 1911: 6, 1914: 5, 1917: 2, 1919: 7, 1922: 5, 1925: 4, 1928: 2, 1930: 6, 1933: 5, 1936: 3, 1938: 7, 1941: 6, 1944: 4, 1947: 2, 1949: 7, 1952: 5, 1955: 3, 1957: 8, 1960: 6, 1963: 4, 1966: 3, 1968: 7, 1971: 5, 1974: 4, 1976: 8, 1979: 6, 1982: 4, 1984: 10, 1987: 6, 1990: 5, 1993: 3, 1995: 8, 1998: 5, 2001: 4, 2004: 2, 2006: 7, 2009: 5, 2012: 4, 2014: 9, 2017: 6, 2020: 4, 2023: 2, 2025: 6, 2028: 5, 2031: 3, 2033: 11, 2036: 6}
YEARS = {1900: "01-31", 1910: "02-10", 1920: "02-20", 1930: "01-30", 1940: "02-08", 1949: "01-29", 1966: "01-21", 1976: "01-31", 1985: "02-20", 1997: "02-07", 2000: "02-05", 2007: "02-18", 2012: "01-23", 2019: "02-05", 2020: "01-25", 2021: "02-12", 2023: "01-22", 2024: "02-10", 2026: "02-17", 2030: "02-03"}


def test_leap_months_and_new_years_are_the_published_ones(months):
    got = {r.lunar_year: r.month for r in months.where("leap AND lunar_year BETWEEN 1900 AND 2036").collect()}
    assert got == LEAPS
    first = {r.lunar_year: r.first_day for r in months.where("month = 1 AND NOT leap").collect()}
    assert {y: first[y].strftime("%m-%d") for y in YEARS} == YEARS


def test_months_follow_each_other_without_a_gap(months):
    rows = months.orderBy("first_day").collect()
    assert len(rows) > 6_000 and {r.days for r in rows} == {29, 30}
    for a, b in zip(rows, rows[1:]):
        assert a.first_day + datetime.timedelta(a.days) == b.first_day
        assert (b.month, b.leap) in (((a.month % 12) + 1, False), (a.month, True)) and not (a.leap and b.leap)
        assert b.lunar_year == a.lunar_year + (b.month == 1 and a.month == 12)
    assert all(sum(r.lunar_year == y for r in rows) in (12, 13) for y in (1645, 1900, 2150))


def test_reign_years(spark):
    reigns = [("乾隆", 3), ("崇祯", 17), ("洪武", 31), ("康熙", 61), ("万历", 15), ("武德", 1), ("庆历", 3), ("宣统", 3), ("乾隆", 71), ("洪武", 0), ("没有", 3), ("至元", 31), ("至元", 3), ("贞观", 1), ("贞观", 20), (None, None)]
    eras = spark.createDataFrame(calendar.SOME_ERAS, "name string, start_year int, end_year int")
    got = calendar.era_years(spark.createDataFrame(reigns, "name string, regnal int"), eras).collect()
    want = [[1738], [1644], [1398], [1722], [1587], [618], [1043], [1911], [], [], [], [1294], [1266, 1337], [627, 1101], [646], []]
    assert {(r.name, r.regnal): r.years for r in got} == dict(zip(reigns, want))
    # Three regimes that date one reign give one year.
    three = spark.createDataFrame([("长兴", 930, 933), ("长兴", 930, 934), ("长兴", 930, 932)], "name string, start_year int, end_year int")
    assert calendar.era_years(spark.createDataFrame([("长兴", 1)], "name string, regnal int"), three).first().years == [930]


def test_reigns_in_a_text(spark, months):
    assert told(scanned(spark, months, "乾隆三年，他第一次进宫。")) == [("乾隆三年", "absolute", "era_year", "1738-01-01")]
    assert told(scanned(spark, months, "乾隆三年三月初五，他第一次进宫。")) == [("乾隆三年三月初五", "absolute", "lunar_day", "1738-04-23")]
    # The name of a lunar day makes the date lunar, also with the word for day behind it.
    assert told(scanned(spark, months, "宣统元年腊月十五日，雪。")) == [("宣统元年腊月十五", "absolute", "lunar_day", "1910-01-25")]
    assert told(scanned(spark, months, "光绪三年5月6日")) == [("光绪三年5月6日", "absolute", "era_day", "1877-05-06")]
    # A day that its month never had leaves the year.
    assert told(scanned(spark, months, "乾隆三年腊月三十")) == [("乾隆三年腊月三十", "absolute", "era_year", "1738-01-01")]
    assert told(scanned(spark, months, "乾隆七十一年，他还在进宫。")) == []
    assert told(scanned(spark, months, "他批评这份抄本不够正统。", "乾隆年间的事，没人记得。")) == []
    (row,) = scanned(spark, months, "至元三年，船从泉州出发。").collect()
    assert (row.kind, row.date, row.years) == ("partial", None, [1266, 1337])


def test_a_wheel_year_takes_its_lunar_day_once_placed(spark, months):
    got = told(scanned(spark, months, "乾隆三年，他进宫。", "甲子年八月十五，月圆。", "甲子年八月十五"))
    assert got == [("乾隆三年", "absolute", "era_year", "1738-01-01"), ("甲子年八月十五", "absolute", "lunar_day", "1744-09-20"), ("甲子年八月十五", "absolute", "lunar_day", "1744-09-20")]
    assert told(scanned(spark, months, "甲子年八月十五")) == [("甲子年八月十五", "partial", "ganzhi_year", None)]


def test_lunar_days_without_a_year_stay_undated(spark, months):
    got = told(scanned(spark, months, "八月初三，他回来了。", "八月十二日，又走。", "腊月初八", "正月里", "闰二月", "初五"))
    assert [(t, p) for t, _, p, d in got if d is None] == [("八月初三", "lunar_date"), ("八月十二日", "month_day"), ("腊月初八", "lunar_date"), ("正月", "lunar_date"), ("闰二月", "lunar_date"), ("初五", "lunar_day")]


def test_days_are_read(spark):
    names = {f"初{c}": i + 1 for i, c in enumerate("一二三四五六七八九十")} | {f"廿{c}": 21 + i for i, c in enumerate("一二三四五六七八九")} | {"廿十": 20, "十五": 15, "三十": 30, "十二": None, "初": None, "": None, None: None}
    df = spark.createDataFrame([(n,) for n in names], "t string")
    assert {r.t: r.d for r in df.select("t", lunar.read_day(F.col("t")).alias("d")).collect()} == names


def test_ambiguous_reigns_and_lunar_days_are_issues(spark, months):
    pad = "一段没有时间的长文字。" * 60
    rows = [("d", 0, "至元三年。" + pad, "s0", "paragraph", None), ("d", 1, "乾隆三年三月初五。" + pad, "s1", "paragraph", None), ("d", 2, "康熙六十一年正月初一。" + pad, "s2", "paragraph", None)]
    seg = segments.with_segments(spark.createDataFrame(rows, "doc_id string, seq int, content string, section_path string, block_type string, title string"))
    found = timeline.anchored(timeline.markers(seg, calendar.ERA_NAMES), None, months)
    issues = [(r.kind, r.value) for r in findings.timeline_issues(seg, found).collect()]
    assert ("ambiguous_era", 1) in issues and ("calendar_note", 2) in issues and any(k == "backstep" for k, _ in issues)
    assert {(r.precision, r.n) for r in timeline.histogram(found).collect()} == {("era_year", 1), ("lunar_day", 2)}
