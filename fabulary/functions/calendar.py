"""Calendar columns: the sixty-year wheel, reign years, and Chinese numerals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
STEMS, BRANCHES = "甲乙丙丁戊己庚辛壬癸", "子丑寅卯辰巳午未申酉戌亥"
DIGITS = "〇一二三四五六七八九"
#: Well-known reigns, by their first year; a full table is passed as a DataFrame (name, start_year, end_year).
SOME_ERAS = [
    ("武德", 618, 626), ("贞观", 627, 649), ("永徽", 650, 655), ("开元", 713, 741), ("天宝", 742, 756), ("贞元", 785, 805), ("元和", 806, 820), ("庆历", 1041, 1048),
    ("熙宁", 1068, 1077), ("元丰", 1078, 1085), ("贞观", 1101, 1101), ("政和", 1111, 1118), ("宣和", 1119, 1125), ("靖康", 1126, 1127), ("建炎", 1127, 1130), ("绍兴", 1131, 1162),
    ("至元", 1264, 1294), ("大德", 1297, 1307), ("至元", 1335, 1340), ("洪武", 1368, 1398), ("建文", 1399, 1402), ("永乐", 1403, 1424), ("洪熙", 1425, 1425), ("宣德", 1426, 1435),
    ("正统", 1436, 1449), ("成化", 1465, 1487), ("弘治", 1488, 1505), ("正德", 1506, 1521), ("嘉靖", 1522, 1566), ("隆庆", 1567, 1572), ("万历", 1573, 1620), ("天启", 1621, 1627),
    ("崇祯", 1628, 1644), ("顺治", 1644, 1661), ("康熙", 1662, 1722), ("雍正", 1723, 1735), ("乾隆", 1736, 1795), ("嘉庆", 1796, 1820), ("道光", 1821, 1850), ("咸丰", 1851, 1861),
    ("同治", 1862, 1874), ("光绪", 1875, 1908), ("宣统", 1909, 1911), ("民国", 1912, 1949),
]
ERA_NAMES = sorted({name for name, *_ in SOME_ERAS})


def pair_of(index: Column) -> Column:
    """The two characters at a place (0-59) of the wheel."""
    return F.concat(F.substring(F.lit(STEMS), F.pmod(index, F.lit(10)) + 1, F.lit(1)), F.substring(F.lit(BRANCHES), F.pmod(index, F.lit(12)) + 1, F.lit(1)))


def wheel_index(year: Column) -> Column:
    return F.pmod(year - 4, F.lit(60))


def index_of_pair(text: Column) -> Column:
    """0-59, null for a pair that the wheel never shows: stems and branches go together by parity."""
    stem, branch = F.instr(F.lit(STEMS), F.substring(text, 1, 1)) - 1, F.instr(F.lit(BRANCHES), F.substring(text, 2, 1)) - 1
    # The place i with i = stem (mod 10) and i = branch (mod 12).
    place = F.pmod(6 * stem - 5 * branch, F.lit(60))
    return F.when((F.length(text) == 2) & (stem >= 0) & (branch >= 0) & (F.pmod(stem - branch, F.lit(2)) == 0), place)


def wheel_year_near(index: Column, year: Column) -> Column:
    """The one year at that place of the wheel from 29 years before to 30 years after."""
    return year - 29 + F.pmod(index - wheel_index(year - 29), F.lit(60))


def number(text: Column) -> Column:
    """ASCII digits, digits written one by one, or tens and ones (十, 十二, 二十, 两)."""
    plain = F.translate(F.translate(text, "两零", "二〇"), DIGITS, "0123456789")
    tens = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(plain, "^([0-9]?)十", 1), F.lit("")), F.lit("9")).cast("int"), F.lit(1))
    ones = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(plain, "十([0-9])$", 1), F.lit("")), F.lit("9")).cast("int"), F.lit(0))
    return F.when(plain.contains("十"), tens * 10 + ones).otherwise(plain.try_cast("int"))


def reign_years(eras: DataFrame) -> DataFrame:
    """name, regnal, years: every year of every reign (name, start_year, end_year), with the distinct years that the name and number allow."""
    each = eras.select("name", F.posexplode(F.sequence("start_year", "end_year")).alias("nth", "year"))
    return each.groupBy("name", (F.col("nth") + 1).alias("regnal")).agg(F.sort_array(F.collect_set("year")).alias("years"))


def era_years(reigns: DataFrame, eras: DataFrame) -> DataFrame:
    """reigns: rows with `name` and `regnal`. Adds `years`: the distinct years that a reign of the name allows; two or more are ambiguous.

    The table has a row for each year of a reign, some thousands for all reigns there were, and is broadcast: rows without a reign stay where they are.
    """
    return reigns.join(F.broadcast(reign_years(eras)), ["name", "regnal"], "left").withColumn("years", F.coalesce("years", F.array().cast("array<int>")))
