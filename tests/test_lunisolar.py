"""Months and holidays of the Chinese calendar against published dates."""

import datetime as dt

from frames import frame
from pyspark.sql import functions as F

from ebbflow.operators import lunisolar as L

# Published dates: Spring Festival, Dragon Boat, Mid-Autumn.
PUBLISHED = """
2000-02-05 2000-06-06 2000-09-12
2001-01-24 2001-06-25 2001-10-01
2002-02-12 2002-06-15 2002-09-21
2003-02-01 2003-06-04 2003-09-11
2004-01-22 2004-06-22 2004-09-28
2005-02-09 2005-06-11 2005-09-18
2006-01-29 2006-05-31 2006-10-06
2007-02-18 2007-06-19 2007-09-25
2008-02-07 2008-06-08 2008-09-14
2009-01-26 2009-05-28 2009-10-03
2010-02-14 2010-06-16 2010-09-22
2011-02-03 2011-06-06 2011-09-12
2012-01-23 2012-06-23 2012-09-30
2013-02-10 2013-06-12 2013-09-19
2014-01-31 2014-06-02 2014-09-08
2015-02-19 2015-06-20 2015-09-27
2016-02-08 2016-06-09 2016-09-15
2017-01-28 2017-05-30 2017-10-04
2018-02-16 2018-06-18 2018-09-24
2019-02-05 2019-06-07 2019-09-13
2020-01-25 2020-06-25 2020-10-01
2021-02-12 2021-06-14 2021-09-21
2022-02-01 2022-06-03 2022-09-10
2023-01-22 2023-06-22 2023-09-29
2024-02-10 2024-06-10 2024-09-17
2025-01-29 2025-05-31 2025-10-06
"""
TOMB_SWEEPING_ON_5_APRIL = {2001, 2002, 2003, 2005, 2006, 2007, 2010, 2011, 2014, 2015, 2018, 2019, 2022, 2023}


def test_published_dates(spark):
    want = [tuple(map(dt.date.fromisoformat, line.split())) for line in PUBLISHED.split("\n") if line]
    years = L.year_table(spark, 2000, 2025)
    first = {(r["year"], r["number"]): dt.date(1970, 1, 1) + dt.timedelta(r["first"]) for r in L.months(years).where("NOT leap").collect()}
    day = dt.timedelta(1)
    assert [(first[y, 1], first[y, 5] + 4 * day, first[y, 8] + 14 * day) for y in range(2000, 2026)] == want
    days = {r[0] for r in L.holidays_of(years).collect()}
    for spring, boat, autumn in want:
        y = spring.year
        tomb = dt.date(y, 4, 5 if y in TOMB_SWEEPING_ON_5_APRIL else 4)
        own = {spring, spring + day, spring + 2 * day, boat, autumn, tomb, dt.date(y, 1, 1), dt.date(y, 5, 1), *(dt.date(y, 10, d) for d in (1, 2, 3))}
        assert {d for d in days if d.year == y} == own


def test_every_solstice_year_has_twelve_or_thirteen_months(spark):
    rows = L.months(L.year_table(spark, 1901, 2099)).groupBy("year").agg(
        F.count("*").alias("n"), F.sum(F.col("leap").cast("int")).alias("leaps"), F.count_distinct("number").alias("numbers")
    ).collect()
    assert len(rows) == 199 and all(r["n"] == 12 + r["leaps"] and r["numbers"] == 12 for r in rows)
    assert 70 <= sum(r["leaps"] for r in rows) <= 76  # seven in nineteen years


def test_holidays_of_a_frame(spark):
    days = {r[0] for r in L.chinese_holidays(frame(spark, [("a", "2024-03-01", 1.0, 1.0)])).collect()}
    assert {d.year for d in days} == {2023, 2024, 2025} and dt.date(2024, 2, 10) in days and dt.date(2024, 2, 13) not in days
    assert L.chinese_holidays(frame(spark, [])).collect() == []
