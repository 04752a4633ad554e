from __future__ import annotations

import datetime
import math

from pyspark.sql import functions as F

from seriesloom.functions import calendar, geography, numeric, wording
from tests.helpers import day, tuples


def one(spark, values, kind, *columns):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_date_parts(spark):
    x = F.col("x")
    rows = one(spark, [day("2024-02-29"), day("2024-12-31"), day("1999-12-31")], "date",
               calendar.date_key(x), calendar.folded_day(x), calendar.season(x), calendar.decade(x))
    assert rows == [(20240229, 60, "DJF", 2020), (20241231, 365, "DJF", 2020), (19991231, 365, "DJF", 1990)]


def test_seasons_of_all_months(spark):
    months = [datetime.date(2023, m, 1) for m in range(1, 13)]
    found = [r[0] for r in one(spark, months, "date", calendar.season(F.col("x")))]
    assert found == ["DJF"] * 2 + ["MAM"] * 3 + ["JJA"] * 3 + ["SON"] * 3 + ["DJF"]


def test_year_range_is_inclusive(spark):
    inside = calendar.in_years(F.col("x"), 1961, 1990)
    dates = [day(d) for d in ("1960-12-31", "1961-01-01", "1990-12-31", "1991-01-01")]
    assert [r[0] for r in one(spark, dates, "date", inside)] == [False, True, True, False]


def test_stamp_sorts_as_text(spark):
    df = spark.sql("select timestamp'2024-03-04 05:06:07' as x")
    assert df.select(calendar.stamp(F.col("x"))).first()[0] == "20240304T050607Z"


def test_bands(spark):
    rows = one(spark, [0.0, -0.1, 23.5, -66.5, 66.4, None], "double",
               geography.hemisphere(F.col("x")), geography.latitude_band(F.col("x")))
    assert rows == [
        ("Northern", "Tropical"), ("Southern", "Tropical"), ("Northern", "Temperate"), ("Southern", "Polar"),
        ("Northern", "Temperate"), ("Southern", "Polar"),
    ]


def test_rounding(spark):
    values = [1.005, -1.005, 2.675, 1e300, math.nan, None]
    found = [r[0] for r in one(spark, values, "double", numeric.round_half_up(F.col("x"), 2))]
    assert found[:4] == [1.01, -1.01, 2.68, 1e300]
    assert math.isnan(found[4]) and found[5] is None


def test_ratio_and_skill(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0)], "a double, b double")
    assert tuples(df.select(numeric.skill(F.col("a"), F.col("b")))) == [(0.5,), (None,)]


def test_clamp_and_nan(spark):
    values = [-9.0, 2.0, 4.0, math.nan, None]
    assert [r[0] for r in one(spark, values, "double", numeric.clamp_scale(F.col("x"), 4))] == [-1.0, 0.5, 1.0, None, None]
    assert [r[0] for r in one(spark, values, "double", numeric.nan_to_null(F.col("x")))] == [-9.0, 2.0, 4.0, None, None]


def test_order_and_coverage(spark):
    df = spark.createDataFrame([(3.0, 1.0, 2.0)], "low double, mid double, high double")
    assert tuples(df.select(*numeric.ordered(("low", "mid", "high")))) == [(1.0, 2.0, 3.0)]
    covered = numeric.inside(F.col("x"), F.lit(1.0), F.lit(2.0))
    assert [r[0] for r in one(spark, [1.0, 2.0, 2.1], "double", covered)] == [1.0, 1.0, 0.0]


def test_words(spark):
    values = [0.19, -0.19, 0.2, 1.45, -0.25, 12.0, None]
    words = [r[0] for r in one(spark, values, "double", wording.describe_anomaly(F.col("x")))]
    assert words == [
        "close to normal", "close to normal", "0.2 °C warmer than usual", "1.4 °C warmer than usual",
        "0.3 °C colder than usual", "12.0 °C warmer than usual", None,
    ]
    yearly = [r[0] for r in one(spark, [0.04, -0.06], "double", wording.describe_vs_average(F.col("x")))]
    assert yearly == ["the same as the 1961 to 1990 average", "0.1 °C colder than the 1961 to 1990 average"]


def test_one_decimal_follows_the_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    values = [i / 100 for i in range(0, 3000)] + [0.05, 0.15, 0.25, 0.35, 1e-9, 99.95, 8.345]
    found = [r[0] for r in one(spark, values, "double", wording.one_decimal(F.col("x")))]
    assert found == [str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP)) for v in values]
