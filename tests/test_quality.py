import pytest

from limnos.operators.quality import (blank_to_null, drop_sparse_columns, fill_constants, min_rows_gate,
                                      missing_report, normalize_columns, prefix_columns, profile, select_available,
                                      select_required)
from tests.conftest import rows


def _sparse(spark):
    data = []
    for i in range(20):
        data.append((i, None, "x" if i == 0 else None, "y" if i < 2 else "  ", f"v{i}"))
    return spark.createDataFrame(data, "id int, c0 string, c1 string, c2 string, c20 string")


def test_drop_sparse_inclusive_ten_percent(spark):
    df = blank_to_null(_sparse(spark))
    kept = drop_sparse_columns(df, 0.10)
    assert kept.columns == ["id", "c2", "c20"]  # 2 of 20 = exactly 10% is kept


def test_missing_report_and_profile(spark):
    df = blank_to_null(_sparse(spark))
    rep = {r.column_name: (r.null_count, r.percent_missing) for r in missing_report(df).collect()}
    assert rep["c0"] == (20, 100.0) and rep["c1"] == (19, 95.0) and rep["c2"] == (18, 90.0) and rep["id"] == (0, 0.0)
    only = [r.column_name for r in missing_report(df, only_missing=True).collect()]
    assert "id" not in only
    prof = {r.column_name: r for r in profile(df).collect()}
    assert prof["c20"].non_null == 20 and prof["id"].data_type == "int"


def test_normalize_and_collisions(spark):
    df = spark.createDataFrame([(1, 2)], "` a b ` int, `c` int")
    assert normalize_columns(df).columns == ["a_b", "c"]
    bad = spark.createDataFrame([(1, 2)], "`a b` int, `a_b` int")
    with pytest.raises(ValueError):
        normalize_columns(bad)


def test_projections(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Temperature, water_value` int, b int, c int")
    assert select_available(df, ["c", "zz", "Temperature, water_value"]).columns == ["c", "Temperature, water_value"]
    with pytest.raises(KeyError):
        select_required(df, ["c", "zz"])
    assert prefix_columns(df, "AG_", except_=["b"]).columns == ["AG_Temperature, water_value", "b", "AG_c"]


def test_fill_constants_and_gate(spark):
    df = spark.createDataFrame([("a", None), ("a", 1.0), ("b", 2.0)], "g string, d double")
    assert rows(fill_constants(df, {"d": 0.0})) == [("a", 0.0), ("a", 1.0), ("b", 2.0)]
    assert rows(min_rows_gate(df, ["g"], 2), "g") == [("a",), ("a",)]
