"""Parsing, calendar and bands on hand-written edge values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelscope.functions import aggregates, bands, calendar, cleaning, tails

from helpers import by_key, column


def labels(spark, values, kind, band):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r.x for r in df.select(band(F.col("v")).alias("x")).collect()]


def test_money_text(spark):
    df = spark.createDataFrame([("$1,095.54",), ("$0.00",), ("",), (None,), ("abc",)], "m string")
    assert column(df.select(cleaning.money_cents(F.col("m")).alias("c")), "c") == [109554, 0, None, None, None]
    dec = df.select(cleaning.money_decimal(F.col("m"), 8, strip="$").cast("double").alias("d"))
    assert column(dec, "d") == [None, 0.0, None, None, None]


def test_hour_and_date_text(spark):
    df = spark.createDataFrame([("00:00:00", "2023-01-31"), ("23:59:59", "2023-12-01"), (None, None), ("x", "y")],
                               "h string, d string")
    got = column(df.select(cleaning.hour_of(F.col("h")).alias("h"), cleaning.date_of(F.col("d")).alias("d")), "h", "d")
    assert got == [(0, dt.date(2023, 1, 31)), (23, dt.date(2023, 12, 1)), (None, None), (None, None)]


def test_failure_flag(spark):
    assert labels(spark, [0, 1, 5, None], "int", cleaning.failed) == [False, True, True, False]


def test_age_bands_differ(spark):
    ages = [17, 18, 29, 30, 45, 59, 60, 99, 100, None]
    assert labels(spark, ages, "int", bands.age_band_left) == [
        None, "18-29", "18-29", "30-44", "45-59", "45-59", "60+", "60+", None, None]
    assert labels(spark, ages, "int", bands.age_band_right) == [
        None, None, "18-29", "18-29", "30-44", "45-59", "45-59", "60+", "60+", None]
    assert labels(spark, ages, "int", bands.age_band_sql) == [
        "60+", "18-29", "18-29", "30-44", "45-59", "45-59", "60+", "60+", "60+", "60+"]


def test_tiers(spark):
    tiers = bands.TIER_LABELS_REPORT
    got = labels(spark, [0, 25, 26, 50, 51, 100, 101], "int", lambda c: bands.experience_tier(c, tiers))
    assert got == [None, tiers[0], tiers[1], tiers[1], tiers[2], tiers[2], None]
    size = bands.SIZE_LABELS
    assert labels(spark, [0, 5, 6, 10, 20, 21], "int", bands.order_size_tier) == [
        None, size[0], size[1], size[1], size[2], size[3]]
    amount = bands.AMOUNT_LABELS
    assert labels(spark, [0.0, 100.0, 100.01, 250.0, 400.0, 400.5], "double", bands.amount_tier) == [
        None, amount[0], amount[1], amount[1], amount[2], amount[3]]


def test_period(spark):
    assert labels(spark, [0, 5, 6, 11, 12, 17, 18, 23], "int",
                  lambda c: bands.period_of_day(c, bands.PERIOD_LABELS_MODEL)) == [
        "overnight", "overnight", "morning", "morning", "afternoon", "afternoon", "evening", "evening"]


def test_cut_points_belong_to_different_sides(spark):
    cuts = [F.lit(10), F.lit(20), F.lit(30)]
    assert labels(spark, [9, 10, 20, 30], "int", lambda c: bands.value_segment(c, *cuts)) == [
        "Low Value", "Medium Value", "High Value", "VIP"]
    assert labels(spark, [10, 20, 30, 31], "int", lambda c: bands.value_quartile(c, *cuts)) == [
        "Low Value", "Medium Value", "High Value", "VIP"]


def test_simple_labels(spark):
    assert labels(spark, [0.05, 0.1, 0.2], "double", bands.risk_label) == ["Low Risk", "Medium Risk", "High Risk"]
    assert labels(spark, [51.0, 50.0, 10.0, 3.0], "double", bands.attribution_level) == [
        "critical", "warning", "neutral", "ok"]
    assert labels(spark, [0.0001, 0.04], "double", bands.p_text) == ["p < 0.001", "p = 0.0400"]
    assert labels(spark, [2, 7], "int", lambda c: cleaning.capped_label(c, 5)) == ["2", "5+"]


def test_calendar_year(spark):
    year = calendar.calendar(calendar.days_spine(calendar.date_range(spark, "2023-01-01", "2023-12-31")))
    rows = {r.date_key: r for r in year.collect()}
    assert len(rows) == 365
    assert tuple(rows[20230101])[1:] == (20230101, "Sunday", 7, 52, 1, "January", "Jan", 1, "H1", 2023, True, "2023-01")
    assert tuple(rows[20230102])[1:] == (20230102, "Monday", 1, 1, 1, "January", "Jan", 1, "H1", 2023, False, "2023-01")
    assert rows[20231231].week_number == 52 and rows[20230701].semester == "H2"


def test_us_weeks(spark):
    for start, expected in (("2023-01-01", 1), ("2023-01-07", 1), ("2023-01-08", 2), ("2022-01-01", 1), ("2022-01-02", 2)):
        one = calendar.calendar_us(calendar.numbered_days(calendar.date_range(spark, start, start))).collect()[0]
        assert one.week_of_year == expected, start
    sunday = calendar.calendar_us(calendar.numbered_days(calendar.date_range(spark, "2023-01-01", "2023-01-01"))).collect()[0]
    assert (sunday.day_of_week, sunday.is_weekend, sunday.quarter_label, sunday.month_label) == (1, 1, "Q1 2023", "Jan 2023")


def test_missing_days_stay(spark):
    got = calendar.in_day_order(spark.createDataFrame([("Friday", 3)], "day_of_week string, n int"))
    assert by_key(got, "day_of_week", "n") == {d: (3 if d == "Friday" else None) for d in calendar.DAYS}


def test_half_even(spark):
    assert labels(spark, [0.03125, 0.5, 1.5], "double", lambda c: aggregates.half_even(c, 4)) == [0.0312, 0.5, 1.5]
    assert labels(spark, [0.5, 1.5, 2.5], "double", lambda c: aggregates.half_even(c)) == [0.0, 2.0, 2.0]


@pytest.mark.parametrize("got, expected", [
    (tails.chi2_sf(4.656560, 6), 0.5885535600), (tails.chi2_sf(3.1739, 3), 0.3655825),
    (tails.chi2_sf(22.7106, 3), 4.639866e-05), (tails.normal_sf(1.959963985), 0.025),
    (tails.t_sf_two_sided(2.228138852, 10), 0.05), (tails.t_sf_two_sided(1.959963985, 1e9), 0.05),
    (tails.beta_cdf(0.5, 2.0, 2.0), 0.5)])
def test_tail_probabilities(got, expected):
    assert got == pytest.approx(expected, rel=1e-6)
