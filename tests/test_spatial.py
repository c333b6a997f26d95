import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.operators.spatial import EARTH_RADIUS_KM, nearest_join, nearest_label


def _brute(left, right, metric, k=1):
    out = {}
    for lid, la, lo in left:
        cands = []
        for rid, ra, ro in right:
            if metric == "haversine":
                s1 = math.sin(math.radians(ra - la) / 2)
                s2 = math.sin(math.radians(ro - lo) / 2)
                key = s1 * s1 + math.cos(math.radians(la)) * math.cos(math.radians(ra)) * s2 * s2
            else:
                key = (ra - la) ** 2 + (ro - lo) ** 2
            cands.append((key, rid))
        cands.sort()
        out[lid] = [c[1] for c in cands[:k]]
    return out


def _frames(spark, left, right):
    l_df = spark.createDataFrame(left, "lid long, lat double, lon double")
    r_df = spark.createDataFrame(right, "rid long, rlat double, rlon double")
    return l_df, r_df


@pytest.mark.parametrize("metric", ["planar_rad", "degrees"])
def test_planar_matches_brute_force(spark, metric):
    rng = random.Random(7)
    left = [(i, round(rng.uniform(40, 44), 2), round(rng.uniform(-97, -90), 2)) for i in range(400)]
    right = [(100 + i, round(rng.uniform(40.5, 43.5), 2), round(rng.uniform(-96, -91), 2)) for i in range(60)]
    right.append((999, left[0][1], left[0][2]))                       # exact hit
    right.append((998, right[0][1], right[0][2]))                     # co-located copy (larger id loses)
    l_df, r_df = _frames(spark, left, right)
    got = {r.lid: r.rid for r in nearest_join(l_df, r_df, left_lat="lat", left_lon="lon", right_lat="rlat",
                                              right_lon="rlon", right_cols=["rid"], tie="rid",
                                              metric=metric).collect()}
    want = _brute(left, right, metric)
    assert got == {k: v[0] for k, v in want.items()}


def test_planar_distance_is_reference_formula(spark):
    l_df, r_df = _frames(spark, [(1, 42.0, -93.0)], [(2, 42.5, -92.0)])
    d = nearest_join(l_df, r_df, left_lat="lat", left_lon="lon", right_lat="rlat", right_lon="rlon",
                     right_cols=["rid"], tie="rid").first().distance_km
    want = math.hypot(math.radians(42.0) - math.radians(42.5), math.radians(-93.0) - math.radians(-92.0)) * 6371
    assert math.isclose(d, want, rel_tol=1e-12)


def test_haversine_globe_poles_antimeridian(spark):
    rng = random.Random(3)

    def pt():
        z = rng.uniform(-1, 1)
        return math.degrees(math.asin(z)), rng.uniform(-180, 180)

    left = [(i, *pt()) for i in range(300)] + [(1000, 89.99, 10.0), (1001, 0.0, 179.99), (1002, -90.0, 0.0)]
    right = [(5000 + i, *pt()) for i in range(200)] + [(9000, 89.0, -170.0), (9001, 0.5, -179.99)]
    l_df, r_df = _frames(spark, left, right)
    out = nearest_join(l_df, r_df, left_lat="lat", left_lon="lon", right_lat="rlat", right_lon="rlon",
                       right_cols=["rid"], tie="rid", metric="haversine").collect()
    got = {r.lid: r.rid for r in out}
    assert got == {k: v[0] for k, v in _brute(left, right, "haversine").items()}
    assert got[1001] == 9001                                             # across the antimeridian
    r = next(r for r in out if r.lid == 1001)
    assert r.distance_km < 60


def test_knn_and_ties(spark):
    left = [(1, 0.0, 0.0), (2, 5.0, 5.0)]
    right = [(10, 1.0, 0.0), (11, 0.0, 1.0), (12, -1.0, 0.0), (13, 0.0, -1.0), (14, 3.0, 3.0)]
    l_df, r_df = _frames(spark, left, right)
    out = nearest_join(l_df, r_df, left_lat="lat", left_lon="lon", right_lat="rlat", right_lon="rlon",
                       right_cols=["rid"], tie="rid", metric="degrees", k=3).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.lid, r.nn_rank)):
        by.setdefault(r.lid, []).append(r.rid)
    assert by[1] == [10, 11, 12]                                         # four-way tie: smallest ids first
    assert by[2] == _brute(left, right, "degrees", 3)[2]


def test_few_points_and_empty_right(spark):
    l_df, r_df = _frames(spark, [(1, 41.0, -93.0), (2, None, None)], [(7, 43.0, -90.0)])
    got = {r.lid: r.rid for r in nearest_join(l_df, r_df, left_lat="lat", left_lon="lon", right_lat="rlat",
                                              right_lon="rlon", right_cols=["rid"], tie="rid", k=3).collect()}
    assert got == {1: 7, 2: None}
    empty = r_df.limit(0)
    got = [r.rid for r in nearest_join(l_df, empty, left_lat="lat", left_lon="lon", right_lat="rlat",
                                       right_lon="rlon", right_cols=["rid"], tie="rid").collect()]
    assert got == [None, None]


def test_nearest_label_first_listed_wins(spark):
    pts = spark.createDataFrame([(1, 41.0, -93.0)], "id int, lat double, lon double")
    places = spark.createDataFrame([("B", 42.0, -93.0, 0), ("A", 40.0, -93.0, 1)],
                                   "name string, plat double, plon double, ord int")
    out = nearest_label(pts, places, lat="lat", lon="lon", place_lat="plat", place_lon="plon", place_name="name",
                        place_order="ord").first()
    assert out.nearest_place == "B"
    none = nearest_label(pts, places.limit(0), lat="lat", lon="lon", place_lat="plat", place_lon="plon",
                         place_name="name", place_order="ord").first()
    assert none.nearest_place == "Iowa"
    assert EARTH_RADIUS_KM == 6371.0 and np.isfinite(EARTH_RADIUS_KM)


def test_planar_and_great_circle_disagree_at_42n(spark):
    # East neighbour: 0.9 deg of longitude (~0.67 deg of arc at 42N); north neighbour: 0.8 deg of latitude.
    l_df, r_df = _frames(spark, [(1, 42.0, -93.0)], [(10, 42.0, -92.1), (11, 42.8, -93.0)])
    kw = dict(left_lat="lat", left_lon="lon", right_lat="rlat", right_lon="rlon", right_cols=["rid"], tie="rid")
    assert nearest_join(l_df, r_df, metric="planar_rad", **kw).first().rid == 11
    assert nearest_join(l_df, r_df, metric="haversine", **kw).first().rid == 10


def test_far_cluster_is_not_compared_pair_by_pair(spark):
    """All right points in one dense cluster, all left points far away, some with unusable coordinates."""
    import numpy as np

    from limnos.operators import spatial

    rng = np.random.default_rng(8)
    right = [(i, float(41 + x), float(-93 + y)) for i, (x, y) in enumerate(rng.uniform(0, 0.01, (2000, 2)))]
    left = [(i, float(10 + x), float(-60 + y)) for i, (x, y) in enumerate(rng.uniform(0, 0.01, (2000, 2)))]
    r = spark.createDataFrame([*right, (9001, float("nan"), 1.0), (9002, float("inf"), 1.0), (9003, None, 1.0)], "sid int, rlat double, rlon double")
    l = spark.createDataFrame([*left, (9001, float("nan"), 1.0), (9002, 1.0, float("-inf")), (9003, None, None)], "id int, lat double, lon double")
    rp = spatial._prepare_right(r, "rlat", "rlon", "sid", ["sid"], 1)
    tree = spatial._Tree(rp, "degrees", 1)
    locs = spark.createDataFrame(left, "id int, lat double, lon double").select(F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    leaves = tree.search(locs, 1)
    assert leaves.agg(F.sum("__n")).first()[0] < 60 * (len(left) + len(right))
    got = {x.id: x.sid for x in spatial.nearest_join(l, r, left_lat="lat", left_lon="lon", right_lat="rlat", right_lon="rlon", right_cols=["sid"], tie="sid", metric="degrees").collect()}
    pts = np.array([(a, b) for _, a, b in right])
    for i, a, b in left[::20]:
        d = (pts[:, 0] - a) ** 2 + (pts[:, 1] - b) ** 2
        assert got[i] == int(np.argmin(d))
    assert [got[k] for k in (9001, 9002, 9003)] == [None, None, None]
