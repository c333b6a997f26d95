import datetime as dt
import math

from pyspark.sql import functions as F

from limnos.functions import (bucket5, classify, clip, combine_date_time, convert_units, day_of_year, log1p_nonneg,
                              month_abbr, round_half_even, standardised_unit, strip_suffix, strip_thousands,
                              suppression_to_null, to_number)


def test_to_number_planted_text(spark):
    vals = ["12", " 12 ", "1e3", "1,234", "1.0d", "inf", "NaN", "0x10", "abc", "", None, "-.5"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(to_number("s")).collect()]
    assert got == [12.0, 12.0, 1000.0, None, None, None, None, None, None, None, None, -0.5]
    got2 = [r[0] for r in df.select(to_number(strip_thousands("s"))).collect()]
    assert got2[3] == 1234.0


def test_suppression_codes(spark):
    df = spark.createDataFrame([(v,) for v in ["(D)", " (D)", "(Z) ", "(NA)", "(X)", "1,234"]], "s string")
    got = [r[0] for r in df.select(suppression_to_null("s")).collect()]
    assert got == [None, None, None, None, "(X)", "1,234"]


def test_combine_date_time_and_doy(spark):
    data = [("2024-01-02", "10:11:12"), ("2024-01-02", None), (None, "10:00:00"), ("2024-02-30", "10:00:00"),
            ("2024-02-29", "00:00:00"), ("2024-12-31", "23:59:59")]
    df = spark.createDataFrame(data, "d string, t string").select(combine_date_time("d", "t").alias("ts"))
    got = [r[0] for r in df.collect()]
    assert got[0] == dt.datetime(2024, 1, 2, 10, 11, 12)
    assert got[1] is None and got[2] is None and got[3] is None
    doys = [r[0] for r in df.select(day_of_year("ts")).collect()]
    assert doys[4] == 60 and doys[5] == 366


def test_month_abbr_and_suffix(spark):
    df = spark.createDataFrame([(dt.date(2024, 9, 1), "CORN, MEASURED IN $")], "d date, s string")
    r = df.select(month_abbr("d"), strip_suffix("s")).first()
    assert r[0] == "SEP" and r[1] == "CORN"


def test_units_only_for_ruled_characteristics(spark):
    data = [("Temperature, water", 212.0, "deg F"), ("Temperature, water", 20.0, "deg C"),
            ("Temperature, water", 300.0, "K"), ("Temperature, water", 10.0, None), ("pH", 50.0, "deg F")]
    df = spark.createDataFrame(data, "n string, v double, u string")
    out = df.select(convert_units("n", "v", "u").alias("v"), standardised_unit("n", "u").alias("u"),
                    convert_units("n", "v", "u", strict_units=True).alias("vs")).collect()
    assert [r.v for r in out] == [100.0, 20.0, 300.0, 10.0, 50.0]
    assert [r.u for r in out] == ["deg C", "deg C", "deg C", "deg C", "deg F"]
    assert [r.vs for r in out] == [100.0, 20.0, None, None, 50.0]


def test_class_bounds(spark):
    vals = [6.5, 8.5, 5.0, 20.0, 28.0, 7.0, 19.0, 1.0, 3.0, 10.0, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    out = df.select(classify("v", "pH").alias("ph"), classify("v", "Water Temperature").alias("t"),
                    classify("v", "Dissolved Oxygen").alias("o"), classify("v", "Nitrate").alias("n"),
                    classify("v", "Conductivity").alias("x")).collect()
    assert out[0].ph == "Balanced" and out[1].ph == "Balanced"          # 6.5 and 8.5 are inside
    assert out[2].t == "Moderate" and out[3].t == "Moderate" and out[4].t == "Warm"
    assert out[2].o == "Fair" and out[5].o == "Healthy" and out[6].o == "Healthy"
    assert out[7].n == "Moderate" and out[8].n == "Elevated" and out[9].n == "High Concern"
    assert out[10].ph == "Unknown" and out[11].ph == "Unknown" and out[10].x == "Unknown"
    assert out[0].x == "Measured"


def test_levels(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0), (10.0, 0.0, 10.0), (2.0, 0.0, 10.0), (1.99, 0.0, 10.0),
                                (5.0, 3.0, 3.0)], "v double, lo double, hi double")
    assert [r[0] for r in df.select(bucket5("v", "lo", "hi")).collect()] == [0, 4, 1, 0, 2]


def test_clip_and_log_guard_keep_null(spark):
    df = spark.createDataFrame([(None,), (-2.0,), (3.0,)], "m double")
    out = df.select(clip("m", 0.0, 2.0).alias("c"), log1p_nonneg("m").alias("l")).collect()
    assert out[0].c is None and out[0].l is None
    assert out[1].c == 0.0 and out[1].l == 0.0
    assert out[2].c == 2.0 and math.isclose(out[2].l, math.log1p(3.0))


def test_round_half_even_matches_numpy(spark):
    import numpy as np
    vals = [46.57375, 0.00005, 0.00015, 2.5, -1.23455, 1234.56785]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(round_half_even("v", 4)).collect()]
    assert got == [float(np.round(v, 4)) for v in vals]


def test_lit_helpers(spark):
    assert spark.range(1).select(F.lit(1)).first()[0] == 1


def test_to_ts_us_formats(spark):
    from limnos.functions import to_ts

    df = spark.createDataFrame([("1/2/2024 10:05",), ("12/31/2024",), ("2024-01-02 10:05:00",), ("13/45/2024",)],
                               "s string")
    got = [r[0] for r in df.select(to_ts("s")).collect()]
    assert got[0] == dt.datetime(2024, 1, 2, 10, 5) and got[1] == dt.datetime(2024, 12, 31)
    assert got[2] == dt.datetime(2024, 1, 2, 10, 5) and got[3] is None
