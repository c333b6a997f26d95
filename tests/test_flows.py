import datetime as dt
import json
import random

from pyspark.sql import functions as F

from limnos.operators.learners import LINEAR, TargetSpec
from limnos.plans import flows
from limnos.sources.files import read_geojson_points, read_table_csv


def _raw_feeds(spark, tmp_path):
    rng = random.Random(11)
    wq, st, wx = [], [], []
    sites = [(f"S{i}", 41.0 + (i % 3) * 0.5, -93.5 + i * 0.3) for i in range(6)]  # not collinear
    for sid, lat, lon in sites:
        st.append((sid, f"Site {sid}", f"{lat}", f"{lon}", "  ", "IA"))
    start = dt.date(2023, 4, 1)
    n = 0
    for d in range(90):
        day = start + dt.timedelta(d)
        for sid, lat, lon in sites:
            if rng.random() < 0.5:
                continue
            temp_c = 5 + 15 * (d / 90) + rng.gauss(0, 1)
            unit, val = ("deg F", temp_c * 9 / 5 + 32) if n % 3 == 0 else ("deg C", temp_c)
            for char, v, u in (("Temperature, water", val, unit), ("pH", 7 + rng.gauss(0, 0.3), "std units")):
                wq.append((f"A{n}", day.isoformat(), "10:00:00", sid, f"Site {sid}", str(lat), str(lon), char,
                           f"{v:.3f}", u, "Actual"))
            n += 1
    for w, (lat, lon) in {"W1": (41.2, -93.4), "W2": (42.4, -92.3)}.items():
        for d in range(90):
            day = start + dt.timedelta(d)
            hi = 50 + d * 0.3
            wx.append((w, day.isoformat(), str(day.timetuple().tm_yday), str(d * 2.0), f"{hi}",
                       f"{(hi - 32) * 5 / 9}", f"{hi - 20}", f"{(hi - 52) * 5 / 9}", "0.1", "", ""))
    wq_cols = ["ActivityIdentifier", "ActivityStartDate", "ActivityStartTime/Time", "MonitoringLocationIdentifier",
               "MonitoringLocationName", "ActivityLocation/LatitudeMeasure", "ActivityLocation/LongitudeMeasure",
               "CharacteristicName", "ResultMeasureValue", "ResultMeasure/MeasureUnitCode", "ResultValueTypeName"]
    raw_wq = spark.createDataFrame(wq, ", ".join(f"`{c}` string" for c in wq_cols))
    raw_st = spark.createDataFrame(st, "MonitoringLocationIdentifier string, MonitoringLocationName string, "
                                       "LatitudeMeasure string, LongitudeMeasure string, HUCEightDigitCode string, "
                                       "StateCode string")
    wx_path = str(tmp_path / "weather")
    spark.createDataFrame(wx, "station string, day string, doy string, gdd_40_86 string, high string, "
                              "highc string, low string, lowc string, precip string, snow string, snowd string") \
        .coalesce(1).write.option("header", True).csv(wx_path)
    gj = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": "W1", "geometry": {"type": "Point", "coordinates": [-93.4, 41.2]},
         "properties": {"sname": "Ames"}},
        {"type": "Feature", "id": "W2", "geometry": {"type": "Point", "coordinates": [-92.3, 42.4]},
         "properties": {}},
        {"type": "Feature", "id": "W9", "geometry": {"type": "Point", "coordinates": [-93.0, 41.0]},
         "properties": {"sname": "Not in data"}}]}
    gj_path = tmp_path / "stations.geojson"
    gj_path.write_text(json.dumps(gj))
    ag = spark.createDataFrame([("2023", "YEAR", "IOWA", "CORN, MEASURED IN $", "1,234", " (D)"),
                                ("2023", "MAY", "IOWA", "CORN", "(D)", "2.0"),
                                ("2023", "MAY", "IOWA", "CORN", "55", "2.0")],
                               "Year string, Period string, State string, `Data Item` string, Value string, "
                               "`CV (%)` string")
    return raw_wq, raw_st, wx_path, str(gj_path), ag


def test_end_to_end(spark, tmp_path):
    raw_wq, raw_st, wx_path, gj_path, ag_raw = _raw_feeds(spark, tmp_path)
    report = {r.characteristic: r for r in flows.water_quality_report(
        raw_wq.withColumn("ActivityStartTime/Time", F.when(F.col("ActivityIdentifier") == "A0", F.lit(None))
                          .otherwise(F.col("ActivityStartTime/Time")))).collect()}
    assert report["pH"].dropped_rows == 1 and report["Temperature, water"].dropped_rows == 1  # A0 lost its time
    assert report["pH"].in_top and report["pH"].rows == report["pH"].clean_rows + 1
    samples = flows.clean_water_quality(raw_wq)
    assert {"Temperature, water_value", "Temperature, water_unit", "pH_value"} <= set(samples.columns)
    units = {r[0] for r in samples.select("`Temperature, water_unit`").distinct().collect()}
    assert units == {"deg C"}
    stations = flows.clean_stations(raw_st)
    assert "HUCEightDigitCode" not in stations.columns                     # all blank -> dropped
    weather = flows.clean_weather(read_table_csv(spark, wx_path))
    assert weather.filter("snow = 0").count() == weather.count()
    points = read_geojson_points(spark, gj_path)
    assert {r.id: r.name for r in points.collect()}["W2"] == ""
    mapping = flows.station_weather_map(stations, points, weather)
    assert {r.climate_station for r in mapping.collect()} <= {"W1", "W2"}
    merged = flows.merge_weather(flows.merge_samples_stations(samples, stations), mapping, weather)
    assert merged.filter(F.col("high").isNull()).count() == 0
    ag = flows.clean_agriculture(ag_raw).withColumn("year", F.col("year").cast("int"))
    full = flows.merge_agriculture(merged, ag, ["CORN"])
    r = full.filter(F.col("month") == "MAY").select("AG_YEAR_CORN", "AG_MONTH_CORN").first()
    assert (r.AG_YEAR_CORN, r.AG_MONTH_CORN) == (1234.0, 55.0)

    table = full.withColumnRenamed("climate_station", "cs")
    target = TargetSpec("Water Temperature", "Temperature, water_value", (-5.0, 45.0), False, "water_temperature")
    metrics, models = flows.train_models(table, [LINEAR], targets=[target], folds=2)
    m = metrics.first()
    assert m.train_rows + m.test_rows == m.rows_used and m.r2 > 0.5 and m.best_model_for_target

    snap = flows.station_snapshot(table)
    out = flows.run_prediction(snap, models[("Water Temperature", "Linear Regression")], "Water Temperature",
                               "2023-06-15", resolution=12, sample_n=50)
    assert out["stations"].count() == 6
    kinds = {r.kind for r in out["map"].collect()}
    assert kinds == {"grid", "station"}
    assert out["calendar"].count() == 98

    long = samples.join(stations, flows.ID).select(
        F.lit("Temperature, water").alias("CharacteristicName"),
        F.col("`Temperature, water_value`").alias("ResultMeasureValue"),
        F.col("LatitudeMeasure").alias("latitude"), F.col("LongitudeMeasure").alias("longitude"),
        flows.ID, flows.TS).join(merged.select(flows.ID, flows.TS, "distance_to_climate_station_km", "doy",
                                               "gdd_40_86", "high", "low", "precip", "snow", "snowd"),
                                 [flows.ID, flows.TS])
    ols_m, coefs = flows.train_ols_long(long, ["Temperature, water"], min_samples=20, key_cols=[flows.ID, flows.TS])
    assert ols_m.count() == 1 and coefs.count() == 11
