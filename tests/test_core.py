"""Rounding, formatting and day arithmetic helpers."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions.core import fmt_fixed, fmt_thousands, rnd_double, whole_days


def test_rounding_is_half_away_from_zero_on_the_decimal_value(spark):
    vals = [2.675, 0.125, -0.125, 2.5, -2.5, 1.005, 10.0149999]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "x double")
           .select(rnd_double(F.col("x"), 2)).collect()]
    assert got == [2.68, 0.13, -0.13, 2.5, -2.5, 1.01, 10.01]


def test_text_is_printed_from_the_rounded_value(spark):
    rows = spark.createDataFrame([(2.25,), (2.15,), (1234567.125,), (-0.05,)], "x double").select(
        fmt_fixed(F.col("x"), 1).alias("a"), fmt_thousands(F.col("x")).alias("b")).collect()
    assert [r.a for r in rows] == ["2.3", "2.2", "1234567.1", "-0.1"]
    assert [r.b for r in rows] == ["2.25", "2.15", "1,234,567.13", "-0.05"]


def test_whole_days_counts_complete_24h_periods(spark):
    a, b = dt.datetime(2018, 1, 1, 23, 0), dt.datetime(2018, 1, 2, 22, 0)
    df = spark.createDataFrame([(a, b), (a, a + dt.timedelta(days=2))], "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(whole_days(F.col("a"), F.col("b"))).collect()] == [0, 2]
