"""Results must not depend on the input partitioning."""

import pytest
from pyspark.sql import functions as F

from limnos.operators.regression import exact_split, fit_ols
from limnos.operators.reshape import dedup_first, latest_per_entity, pivot_value_unit
from limnos.operators.spatial import nearest_join
from limnos.operators.stats import exact_quantiles
from limnos.plans.registry import pseudo_lat, pseudo_lon
from limnos.session import table
from tests.conftest import SF_SMALL


def _events(spark, n):
    return table(spark, SF_SMALL, "events").repartition(n)


@pytest.mark.parametrize("n", [1, 17])
def test_order_dependent_operators(spark, n):
    base = sorted(tuple(r) for r in dedup_first(_events(spark, 3), ["user_id", "event_type"], ["ts", "event_id"]).collect())
    got = sorted(tuple(r) for r in dedup_first(_events(spark, n), ["user_id", "event_type"], ["ts", "event_id"]).collect())
    assert got == base
    last = lambda d: sorted(tuple(r) for r in latest_per_entity(d, "user_id", "ts", tie="event_id").collect())  # noqa
    assert last(_events(spark, n)) == last(_events(spark, 3))
    piv = lambda d: sorted(tuple(r) for r in pivot_value_unit(
        d.withColumn("day", F.to_date("ts")), ["user_id", "day"], "event_type", "value", "props",
        ["click", "view"], ["ts", "event_id"]).collect())
    assert piv(_events(spark, n)) == piv(_events(spark, 3))


@pytest.mark.parametrize("n", [1, 17])
def test_numeric_and_spatial_operators(spark, n):
    li = table(spark, SF_SMALL, "lineitem")
    q = lambda d: exact_quantiles(d, ["l_quantity", "l_extendedprice"], [0.02, 0.5, 0.98])
    assert q(li.repartition(n)) == q(li)
    fit = lambda d: fit_ols(d, ["l_quantity", "l_discount"], "l_extendedprice").first()
    a, b = fit(li.repartition(n)), fit(li)
    assert a.intercept == pytest.approx(b.intercept, rel=1e-9)
    assert a.coefficients == pytest.approx(b.coefficients, rel=1e-9)
    o = table(spark, SF_SMALL, "orders")
    split = lambda d: sorted(r.o_orderkey for r in exact_split(d, ["o_orderkey"], by=["o_orderstatus"])  # noqa
                             .filter("is_test").collect())
    assert split(o.repartition(n)) == split(o)
    c = table(spark, SF_SMALL, "customer").select("c_custkey", pseudo_lat("c_custkey").alias("lat"),
                                                  pseudo_lon("c_custkey").alias("lon"))
    s = table(spark, SF_SMALL, "supplier").select("s_suppkey", pseudo_lat("s_suppkey").alias("slat"),
                                                  pseudo_lon("s_suppkey").alias("slon"))
    nn = lambda l, r: sorted((x.c_custkey, x.s_suppkey) for x in nearest_join(
        l, r, left_lat="lat", left_lon="lon", right_lat="slat", right_lon="slon", right_cols=["s_suppkey"],
        tie="s_suppkey").collect())
    assert nn(c.repartition(n), s.repartition(n)) == nn(c, s)
