import datetime as dt

import pytest

from limnos.operators.joins import attach_map, join_on_keys, key_overlap, left_join_dedup, with_dates
from limnos.operators.reshape import (bounded_sample, dedup_first, first_per_group, latest_per_entity,
                                      pivot_first, pivot_value_unit, top_categories, value_counts)
from tests.conftest import rows

T = dt.datetime


def test_first_per_group_and_pivot(spark):
    data = [("s1", "n1", T(2024, 1, 1, 9), "pH", 7.0, "std", 0),
            ("s1", "n1", T(2024, 1, 1, 9), "pH", 8.0, "std", 1),        # duplicate cell: first row wins
            ("s1", "n1", T(2024, 1, 1, 9), "DO", 9.5, "mg/L", 2),
            ("s1", "n2", T(2024, 1, 1, 9), "DO", 1.0, "mg/L", 3),       # other name, same index x category
            ("s1", None, T(2024, 1, 1, 9), "DO", 2.0, "mg/L", 4),       # null name: dropped
            ("s2", "n3", None, "pH", 6.0, "std", 5)]                    # null time: dropped
    df = spark.createDataFrame(data, "id string, name string, ts timestamp_ntz, c string, v double, u string, o int")
    first = first_per_group(df, ["id", "name", "ts", "c"], ["v", "u"], ["o"])
    assert rows(first, "id", "name", "c", "v") == [("s1", "n1", "DO", 9.5), ("s1", "n1", "pH", 7.0),
                                                   ("s1", "n2", "DO", 1.0)]
    first = first.join(df.select("id", "name", "ts", "c", "o"), ["id", "name", "ts", "c"])
    wide = pivot_value_unit(first, ["id", "ts"], "c", "v", "u", ["pH", "DO", "Nitrate"], ["o"])
    r = wide.first()
    assert (r.pH_value, r.pH_unit, r.DO_value, r.Nitrate_value) == (7.0, "std", 9.5, None)
    with pytest.raises(ValueError):
        pivot_value_unit(first, ["id", "ts"], "c", "v", "u", ["pH", "DO"], ["o"], on_duplicate="error")


def test_pivot_first_non_null(spark):
    data = [(2024, "JAN", "CORN", None, 0), (2024, "JAN", "CORN", 5.0, 1), (2024, "JAN", "SOY", 3.0, 2),
            (2024, "FEB", "CORN", None, 3), (2025, "JAN", "SOY", 4.0, 4), (2025, "JAN", "SOY", 9.0, 5)]
    df = spark.createDataFrame(data, "year int, period string, item string, value double, o int")
    p = pivot_first(df, ["year", "period"], "item", "value", ["CORN", "SOY"], ["o"])
    assert rows(p) == [(2024, "JAN", 5.0, 3.0), (2025, "JAN", None, 4.0)]  # all-null FEB row disappears


def test_latest_per_column(spark):
    data = [(1, T(2024, 1, 1), 1, 1.0, "a"), (1, T(2024, 1, 2), 2, None, "b"), (1, T(2024, 1, 2), 3, 7.0, None),
            (2, T(2024, 1, 1), 4, None, None), (3, None, 5, 5.0, "z")]
    df = spark.createDataFrame(data, "k int, ts timestamp_ntz, eid int, v double, s string")
    out = {r.k: r for r in latest_per_entity(df, "k", "ts", tie="eid").collect()}
    assert out[1].v == 7.0 and out[1].s == "b" and out[1].eid == 3
    assert out[2].v is None and out[2].s is None
    assert 3 not in out
    row = {r.k: r for r in latest_per_entity(df, "k", "ts", tie="eid", per_column=False).collect()}
    assert row[1].s is None and row[1].v == 7.0


def test_counts_and_top(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("a",), (None,)], "x string")
    assert [tuple(r) for r in value_counts(df, "x").collect()] == [("a", 2), ("b", 2), ("c", 1)]
    assert [r.x for r in top_categories(df, "x", 2).collect()] == ["a", "b"]


def test_dedup_first_and_sample(spark):
    df = spark.createDataFrame([(1, 3, "x"), (1, 1, "y"), (2, 5, "z")], "k int, o int, v string")
    assert rows(dedup_first(df, ["k"], ["o"])) == [(1, 1, "y"), (2, 5, "z")]
    big = spark.range(1000).withColumnRenamed("id", "cell_id")
    a = {r.cell_id for r in bounded_sample(big, ["cell_id"], 50, 0).collect()}
    b = {r.cell_id for r in bounded_sample(big.repartition(7), ["cell_id"], 50, 0).collect()}
    assert a == b and len(a) == 50


def test_fan_out_and_null_keys(spark):
    samples = spark.createDataFrame([("s1", 1), ("s2", 2), (None, 3)], "id string, n int")
    mapping = spark.createDataFrame([("s1", 41.0, "w1"), ("s1", 42.0, "w2"), (None, 40.0, "w0")],
                                    "id string, lat double, station string")
    assert len(attach_map(samples, mapping, ["id"]).collect()) == 4          # s1 fans out
    assert len(attach_map(samples, mapping, ["id"], one_per_id="id", order=["lat"]).collect()) == 3
    weather = spark.createDataFrame([("w1", 1, 10.0), ("w1", 1, 11.0), (None, 3, 9.0)], "st string, d int, t double")
    left = spark.createDataFrame([("w1", 1), (None, 3)], "cs string, day int")
    plain = left_join_dedup(left, weather, ["cs", "day"], ["st", "d"], order=["t"])
    assert rows(plain) == [(None, 3, None), ("w1", 1, 10.0)]
    ns = left_join_dedup(left, weather, ["cs", "day"], ["st", "d"], order=["t"], null_safe=True)
    assert rows(ns) == [(None, 3, 9.0), ("w1", 1, 10.0)]
    j = join_on_keys(left, weather, ["cs", "day"], ["st", "d"])
    assert j.columns == ["cs", "day", "t"]


def test_key_overlap_and_dates(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (3,), (4,)], "k int")
    r = key_overlap(a, b, "k").first()
    assert (r.left_keys, r.right_keys, r.both_keys, r.left_only_keys, r.right_only_keys) == (3, 3, 2, 1, 1)
    d = with_dates(spark.createDataFrame([(1,)], "e int"), "2023-12-30", "2024-01-02")
    assert [r.date for r in d.orderBy("date").collect()] == [dt.date(2023, 12, 30) + dt.timedelta(i) for i in range(4)]


def test_bounded_sample_equals_smallest_hashes(spark):
    import hashlib

    big = spark.range(20000).withColumnRenamed("id", "cell_id")
    got = [r.cell_id for r in bounded_sample(big, ["cell_id"], 25, 0).collect()]
    want = sorted(range(20000), key=lambda i: (hashlib.md5(f"{i}\u00010".encode()).hexdigest(), i))[:25]
    assert got == want
