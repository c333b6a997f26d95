import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from limnos.operators.features import FEATURE_COLS, add_derived_features, scoring_matrix
from limnos.operators.grid import hull_mask, interpolate_idw, make_grid, render_table
from limnos.operators.timeline import calendar_window, score_calendar, score_dates


@pytest.mark.parametrize("end,grid_end", [("2024-01-20", "2024-01-20"), ("2024-01-21", "2024-01-27"),
                                          ("2024-01-17", "2024-01-20"), ("2024-01-01", "2024-01-06")])
def test_calendar_window(end, grid_end):
    start, stop = calendar_window(end)
    assert stop == dt.date.fromisoformat(grid_end) and (stop - start).days == 97 and start.weekday() == 6


def test_calendar_levels_and_labels(spark):
    start, _ = calendar_window("2024-01-10")
    days = [start + dt.timedelta(i) for i in range(98)]
    daily = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days)], "date date, mean_prediction double")
    cal = score_calendar(daily, "2024-01-10").orderBy("date").collect()         # crosses New Year
    assert len(cal) == 98 and cal[0].weekday == "Sun" and cal[-1].weekday == "Sat"
    past = [r for r in cal if not r.is_future]
    assert past[0].level == 0 and past[-1].level == 4
    assert all(r.level == 0 and r.value is None for r in cal if r.is_future)
    labels = [r.month_label for r in cal if r.weekday == "Sun"]
    assert labels[0] == "Oct" and labels.count("Jan") == 1 and labels.count("Dec") == 1 and "" in labels


def test_score_dates_by_doy(spark):
    snap = spark.createDataFrame([(1, None), (2, 4.0), (3, 6.0)], "id int, x double")
    scorer = lambda d: d.withColumn("predicted", F.col("doy") + F.col("x"))
    out = {r.date: r.mean_prediction for r in score_dates(snap, scorer, ["2024-01-01", "2024-12-31"],
                                                          ["doy", "x"]).collect()}
    assert out[dt.date(2024, 1, 1)] == pytest.approx(1 + 5.0)                  # null x filled with median 5
    assert out[dt.date(2024, 12, 31)] == pytest.approx(366 + 5.0)


def test_scoring_matrix_and_features(spark):
    snap = spark.createDataFrame([tuple([float(i)] * 12) for i in range(3)] + [tuple([None] * 12)],
                                 ", ".join(f"`{c}` double" for c in FEATURE_COLS))
    m = scoring_matrix(snap, "2026-05-01").collect()
    assert all(r.doy == 121 for r in m) and m[3].gdd_40_86 == 1.0
    f = add_derived_features(snap.limit(1).withColumn("doy", F.lit(91.5))).first()
    assert f.season_sin == pytest.approx(1.0) and f.frozen == 1.0


def test_grid_idw_hull_render(spark):
    st = spark.createDataFrame([(1, 41.0, -93.0, 10.0), (2, 42.0, -92.0, 20.0), (3, 41.5, -91.0, 30.0)],
                               "sid int, lat double, lon double, v double")
    grid = make_grid(st, "lat", "lon", resolution=5, margin=0.5)
    cells = grid.collect()
    assert len(cells) == 25 and max(c.lat for c in cells) == 42.5 and min(c.lon for c in cells) == -93.5
    on = spark.createDataFrame([(0, 41.0, -93.0), (1, 41.4, -92.0)], "cell_id long, lat double, lon double")
    got = {r.cell_id: r.value for r in interpolate_idw(st, on, station_id="sid", lat="lat", lon="lon", value="v",
                                                       k=8).collect()}
    assert got[0] == 10.0                                                      # on a station: its value
    w = [1 / ((41.0 - 41.4) ** 2 + 1.0), 1 / (0.36 + 0.0), 1 / (0.01 + 1.0)]
    assert got[1] == pytest.approx((10 * w[0] + 20 * w[1] + 30 * w[2]) / sum(w))  # fewer stations than k
    inside = {r.cell_id for r in hull_mask(grid, st, lat="lat", lon="lon").collect()}
    assert 0 not in inside and len(inside) < 25
    vals = interpolate_idw(st, grid, station_id="sid", lat="lat", lon="lon", value="v", k=2)
    table = render_table(vals, st, target="Water Temperature", station_id="sid", lat="lat", lon="lon", value="v",
                         sample_n=10).collect()
    grid_rows = [r for r in table if r.kind == "grid"]
    assert len(grid_rows) == 10 and all(10.4 <= r.value <= 29.6 for r in grid_rows)
    assert [r.label for r in sorted((r for r in table if r.kind == "station"), key=lambda r: r.value)] == [
        "Moderate", "Moderate", "Very Warm"]  # 20 is inside the Moderate band (<= 20)
    assert math.isfinite(sum(r.value for r in table))


def test_reference_places_labels(spark):
    from limnos.operators.grid import enrich_points

    pts = spark.createDataFrame([(1, 41.59, -93.62, 15.0), (2, 42.03, -93.63, 30.0), (3, 43.15, -93.20, 2.0)],
                                "id int, lat double, lon double, v double")
    out = {r.id: r for r in enrich_points(pts, target="Water Temperature", lat="lat", lon="lon", value="v").collect()}
    assert out[1].nearest_place == "Des Moines" and out[2].nearest_place == "Ames"
    assert out[3].nearest_place == "Mason City" and out[3].label == "Very Cold" and out[2].label == "Very Warm"


def test_hull_is_exact(spark, monkeypatch):
    import random

    from limnos.operators import grid as g
    rng = random.Random(2)
    points = [(rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(400)] + [(4.0, 4.0)] * 3 + [(0.0, 4.0), (2.0, 4.0)]
    monkeypatch.setattr(g, "_MERGE", 2)
    frame = lambda rows: spark.createDataFrame(rows, "lon double, lat double")
    hull = g.convex_hull(frame([*points, (None, 1.0)]).repartition(11), "lat", "lon")
    cross = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    edges = list(zip(hull, hull[1:] + hull[:1], strict=True))
    assert set(hull) <= set(points) and all(cross(a, b, p) >= -1e-12 for a, b in edges for p in points) and (2.0, 4.0) not in hull
    cells = [(i, rng.uniform(-4, 5), rng.uniform(-4, 5)) for i in range(500)] + [(900, 2.0, 4.0), (901, 4.0, 4.0), (902, 4.1, 4.0)]
    cells = spark.createDataFrame(cells, "cell_id long, lon double, lat double")
    inside = {r.cell_id for r in hull_mask(cells, frame(points), lat="lat", lon="lon").collect()}
    assert inside == {r.cell_id for r in cells.collect() if all(cross(a, b, (r.lon, r.lat)) >= -1e-9 for a, b in edges)} >= {900, 901}
    kept = lambda rows: {r.cell_id for r in hull_mask(cells, frame(rows), lat="lat", lon="lon").collect()}
    assert kept([]) == set() and kept([(4.0, 4.0)]) == {901} and kept([(0.0, 4.0), (4.0, 4.0)]) == {900, 901}
