"""Chinese calendar holidays (D5) from new moons and solar terms, as column expressions over a table of years.

A month begins on the day of a new moon, Beijing time.  The months from the one that holds the
winter solstice to the next such one make a solstice year; if they are thirteen, the
first without a principal term (a solar longitude that is a multiple of 30 degrees) is a
leap month and takes the number of the month before it.  New moons follow the usual mean
lunation with its periodic terms and the sun's longitude its mean anomaly series; both are
right to some minutes for 1900 to 2100, and a holiday can be off where either falls that
close to midnight.

``chinese_holidays`` gives the statutory days of every year of a frame's dates: New Year, Spring
Festival (three days), Tomb-Sweeping, Labour, Dragon Boat, Mid-Autumn and National Day (three).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbflow.schema import D

BEIJING = 8 / 24
#: Difference of uniform and civil time, in days (about 65 to 75 seconds in 2000 to 2030).
CLOCK = 70 / 86_400
JULIAN_1970 = 2_440_587.5
RAD = "0.017453292519943295"
# Periodic terms of the new moon, (days, power of E, multiples of M, M', F), and of the sun's centre.
MOON_TERMS = (
    (-0.40720, 0, 0, 1, 0),
    (0.17241, 1, 1, 0, 0),
    (0.01608, 0, 0, 2, 0),
    (0.01039, 0, 0, 0, 2),
    (0.00739, 1, -1, 1, 0),
    (-0.00514, 1, 1, 1, 0),
    (0.00208, 2, 2, 0, 0),
    (-0.00111, 0, 0, 1, -2),
    (-0.00057, 0, 0, 1, 2),
    (0.00056, 1, 1, 2, 0),
    (-0.00042, 0, 0, 3, 0),
    (0.00042, 1, 1, 0, 2),
    (0.00038, 1, 1, 0, -2),
    (-0.00024, 1, -1, 2, 0),
)
#: (first month, day of month, days) of lunar holidays, and (month, day, days) of the others.
LUNAR_DAYS = ((1, 1, 3), (5, 5, 1), (8, 15, 1))
SOLAR_DAYS = ((1, 1, 1), (5, 1, 1), (10, 1, 3))
TOMB_SWEEPING = 15  # degrees of solar longitude


def new_moon_sql(k: str) -> str:
    """The Julian day, in uniform time, of new moon number ``k`` (0: January 2000)."""
    t = f"({k} / 1236.85)"
    e = f"(1 - 0.002516 * {t} - 0.0000074 * {t} * {t})"
    m = f"(2.5534 + 29.10535670 * {k} - 0.0000014 * {t} * {t})"
    m1 = f"(201.5643 + 385.81693528 * {k} + 0.0107582 * {t} * {t})"
    f = f"(160.7108 + 390.67050284 * {k} - 0.0016118 * {t} * {t})"
    node = f"(124.7746 - 1.56375588 * {k} + 0.0020672 * {t} * {t})"
    terms = [f"{c} * {' * '.join([e] * p + [''])}sin({RAD} * ({a} * {m} + {b} * {m1} + {n} * {f}))" for c, p, a, b, n in MOON_TERMS]
    terms.append(f"-0.00017 * sin({RAD} * {node})")
    return f"(2451550.09766 + 29.530588861 * {k} + 0.00015437 * {t} * {t} + " + " + ".join(f"({x})" for x in terms) + ")"


def longitude_sql(day: str) -> str:
    """The sun's apparent longitude, in degrees from 0 to 360, when Beijing's day number ``day`` (0: 1970-01-01) begins."""
    t = f"(({day} + {JULIAN_1970} - {BEIJING} + {CLOCK} - 2451545.0) / 36525.0)"
    m = f"({RAD} * (357.52911 + 35999.05029 * {t} - 0.0001537 * {t} * {t}))"
    centre = (
        f"((1.914602 - 0.004817 * {t}) * sin({m}) + (0.019993 - 0.000101 * {t}) * sin(2 * {m}) + 0.000289 * sin(3 * {m}))"
    )
    mean = f"(280.46646 + 36000.76983 * {t} + 0.0003032 * {t} * {t})"
    seen = f"({mean} + {centre} - 0.00569 - 0.00478 * sin({RAD} * (125.04 - 1934.136 * {t})))"
    return f"({seen} - 360 * floor({seen} / 360))"


def day_of_sql(julian: str) -> str:
    """Beijing's day number of a moment in uniform time."""
    return f"cast(floor({julian} - {CLOCK} + {BEIJING} - {JULIAN_1970}) as bigint)"


def months(years: DataFrame) -> DataFrame:
    """year, number, leap, first (day number) of the months from the winter solstice before each ``year`` to the next."""
    near = F.expr("cast(floor((year - 2000.0 - 0.2) * 12.3685) as bigint)")  # some lunations before the solstice month
    m = years.select("year", near.alias("k0")).select("year", F.explode(F.sequence(F.col("k0") - 1, F.col("k0") + 16)).alias("k"))
    m = m.withColumn("first", F.expr(day_of_sql(new_moon_sql("k")))).withColumn("next", F.expr(day_of_sql(new_moon_sql("(k + 1)"))))
    m = m.withColumn("from_term", F.expr(f"floor({longitude_sql('first')} / 30)")).withColumn("to_term", F.expr(f"floor({longitude_sql('next')} / 30)"))
    m = m.withColumn("term", F.col("from_term") != F.col("to_term"))
    solstice = F.col("term") & (F.col("from_term") < 9) & (F.col("to_term") >= 9)
    own = Window.partitionBy("year").orderBy("k")  # eighteen months
    m = m.withColumn("turns", F.sum(solstice.cast("int")).over(own))
    m = m.where("turns = 1")  # the lunations begin before the solstice of December
    m = m.withColumn("i", F.row_number().over(own) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("year")))
    bare = F.min(F.when(~F.col("term"), F.col("i"))).over(Window.partitionBy("year"))
    m = m.withColumn("leap_at", F.when(F.col("n") == 13, bare))
    late = F.coalesce((F.col("i") >= F.col("leap_at")).cast("int"), F.lit(0))
    return m.select(
        "year",
        ((F.lit(10) + F.col("i") - late) % 12 + 1).cast("int").alias("number"),
        F.coalesce(F.col("i") == F.col("leap_at"), F.lit(False)).alias("leap"),
        "first",
    )


def _date(day: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))


def holidays_of(years: DataFrame) -> DataFrame:
    """holiday_date of every statutory day of the years (column ``year``)."""
    m = months(years).where(~F.col("leap"))
    lunar = [
        m.where(F.col("number") == n).select(F.explode(F.sequence(F.col("first") + (d - 1), F.col("first") + (d + days - 2))).alias("day"))
        for n, d, days in LUNAR_DAYS
    ]
    solar = [
        years.select(F.explode(F.sequence(F.make_date("year", F.lit(mo), F.lit(d)), F.make_date("year", F.lit(mo), F.lit(d + days - 1)))).alias("holiday_date"))
        for mo, d, days in SOLAR_DAYS
    ]
    april = years.select(F.explode(F.sequence(F.make_date("year", F.lit(4), F.lit(3)), F.make_date("year", F.lit(4), F.lit(7)))).alias("holiday_date"))
    april = april.withColumn("day", F.datediff("holiday_date", F.lit("1970-01-01").cast("date")).cast("long"))
    begins, ends = longitude_sql("day"), longitude_sql("(day + 1)")
    out = april.where(F.expr(f"{begins} < {TOMB_SWEEPING} AND {ends} >= {TOMB_SWEEPING}")).select("holiday_date")
    for part in (*solar, *[x.select(_date(F.col("day")).alias("holiday_date")) for x in lunar]):
        out = out.unionByName(part)
    return out.distinct()


def chinese_holidays(df: DataFrame, date: str = D) -> DataFrame:
    """holiday_date for every year of the dates, and one year either side."""
    span = df.agg(F.min(F.year(date)).alias("a"), F.max(F.year(date)).alias("b")).where("a IS NOT NULL")
    return holidays_of(span.select(F.explode(F.sequence(F.col("a") - 1, F.col("b") + 1)).alias("year")))


def year_table(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
