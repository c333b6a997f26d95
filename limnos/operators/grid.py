"""Map grids: bounding-box grid, IDW interpolation, hull mask, render table.

The reference interpolates with a cubic spline over a Delaunay triangulation
(a single-machine solver); here the surface is inverse-distance weighting
over the k nearest stations (Shepard 1968), found with the grid-bucketed
nearest join — values differ from the reference by design.  The convex-hull
NaN mask is exact: partial hulls of the tasks merge in a tree.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions.numeric import clip, round_half_even
from limnos.functions.rules import TARGET_UNITS, classify, classify_detail
from limnos.operators.reshape import bounded_sample
from limnos.operators.spatial import nearest_join, nearest_label
from limnos.operators.stats import exact_quantiles
from limnos.session import qcol, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The named places used to label map points, in their listed
# order (the first listed wins a tie): (name, latitude, longitude).
REFERENCE_PLACES = (
    ("Des Moines", 41.5868, -93.6250),
    ("Cedar Rapids", 41.9779, -91.6656),
    ("Davenport", 41.5236, -90.5776),
    ("Sioux City", 42.4999, -96.4003),
    ("Iowa City", 41.6611, -91.5302),
    ("Waterloo", 42.4928, -92.3426),
    ("Council Bluffs", 41.2619, -95.8608),
    ("Ames", 42.0308, -93.6319),
    ("Dubuque", 42.5006, -90.6646),
    ("Ankeny", 41.7321, -93.6030),
    ("West Des Moines", 41.5772, -93.7113),
    ("Cedar Falls", 42.5349, -92.4452),
    ("Marion", 42.0341, -91.5974),
    ("Bettendorf", 41.5244, -90.5121),
    ("Urbandale", 41.6265, -93.7122),
    ("Mason City", 43.1536, -93.2010),
    ("Ottumwa", 41.0200, -92.4113),
    ("Marshalltown", 42.0494, -92.9080),
    ("Clinton", 41.8444, -90.1887),
    ("Burlington", 40.8073, -91.1128),
    ("Fort Dodge", 42.4975, -94.1680),
    ("Muscatine", 41.4245, -91.0432),
    ("Coralville", 41.6727, -91.5802),
    ("Waukee", 41.6113, -93.8888),
    ("North Liberty", 41.7494, -91.6052),
    ("Oskaloosa", 41.2961, -92.6457),
    ("Storm Lake", 42.6411, -95.2097),
    ("Carroll", 42.0661, -94.8672),
    ("Fairfield", 41.0086, -91.9657),
    ("Spencer", 43.1414, -95.1441),
)
DEFAULT_PLACE = "Iowa"  # fixed value: label when there is no place at all

GRID_RESOLUTION = 120  # fixed value: cells per axis
GRID_MARGIN_DEG = 0.5  # fixed value: margin around the stations' bounding box
SAMPLE_CAP = 4000  # fixed value: at most this many grid cells are rendered
SAMPLE_SEED = 0  # fixed value: seed of that choice


def make_grid(points: DataFrame, lat: str, lon: str, resolution: int = GRID_RESOLUTION,
              margin: float = GRID_MARGIN_DEG) -> DataFrame:
    """G1: ``resolution^2`` cells ``(cell_id, row, col, lat, lon)`` over the box +/- margin.

    Like ``numpy.linspace``: ``lo + i * (hi - lo) / (n - 1)``, last point exactly ``hi``.
    """
    box = points.agg(F.min(qcol(lat)).alias("a0"), F.max(qcol(lat)).alias("a1"),
                     F.min(qcol(lon)).alias("b0"), F.max(qcol(lon)).alias("b1")).first()
    spark = points.sparkSession
    if box["a0"] is None:
        return spark.createDataFrame([], "cell_id long, row int, col int, lat double, lon double")
    a0, a1 = box["a0"] - margin, box["a1"] + margin
    b0, b1 = box["b0"] - margin, box["b1"] + margin
    n = resolution
    cells = spark.range(n * n).select(F.col("id").alias("cell_id"), (F.col("id") / n).cast("int").alias("row"),
                                      (F.col("id") % n).cast("int").alias("col"))

    def axis(i, lo, hi):
        step = (hi - lo) / (n - 1) if n > 1 else 0.0
        return F.when(i == n - 1, F.lit(hi)).otherwise(F.lit(lo) + i.cast("double") * F.lit(step))

    return cells.withColumns({"lat": axis(F.col("row"), a0, a1), "lon": axis(F.col("col"), b0, b1)})


def interpolate_idw(stations: DataFrame, grid: DataFrame, *, station_id: str, lat: str, lon: str, value: str,
                    k: int = 8, power: float = 2.0, out_col: str = "value") -> DataFrame:
    """Inverse-distance-weighted value of the ``k`` nearest stations per cell.

    Distances in degrees; weights ``1 / dist^power``; a cell on a station
    takes that station's value (smallest id if several coincide).
    """
    st = stations.select(qcol(station_id).alias("__sid"), qcol(lat).alias("__slat"), qcol(lon).alias("__slon"),
                         qcol(value).cast("double").alias("__sval"))
    nn = nearest_join(grid, st, left_lat="lat", left_lon="lon", right_lat="__slat", right_lon="__slon",
                      right_cols=["__sval"], tie="__sid", metric="degrees", k=k, distance_col="__dist",
                      rank_col="__rank", key_col="__d2")
    w = F.lit(1.0) / F.pow(F.col("__d2"), F.lit(power / 2.0))
    hit = F.col("__d2") == 0
    keys = [c for c in grid.columns]
    agg = nn.groupBy(*keys).agg(
        F.min_by(F.when(hit, F.col("__sval")), F.when(hit, F.col("__sid"))).alias("__exact"),
        F.sum(F.when(~hit, w * F.col("__sval"))).alias("__wv"), F.sum(F.when(~hit, w)).alias("__w"))
    return agg.select(*keys, F.coalesce(F.col("__exact"), F.col("__wv") / F.col("__w")).alias(out_col))


def _chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise (monotone chain); one or two points stay as they are."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    out = []
    for ordered in (points, points[::-1]):
        half: list[tuple[float, float]] = []
        for p in ordered:
            while len(half) > 1 and (half[-1][0] - half[-2][0]) * (p[1] - half[-2][1]) <= (half[-1][1] - half[-2][1]) * (p[0] - half[-2][0]):
                half.pop()
            half.append(p)
        out += half[:-1]
    return out


#: Partial hulls that one merge takes together.
_MERGE = 32


def convex_hull(points: DataFrame, lat: str, lon: str) -> list[tuple[float, float]]:
    """Corners (lon, lat) of the points' convex hull, counter-clockwise.

    Every task keeps the hull of its points; hulls merge in a tree, and only the corners of the last few reach the driver.
    """
    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[float, float]] = []
        for batch in batches:
            held = _chain(held + list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in held], pa.float64()) for i in (0, 1)], ["x", "y"])

    def merged(table: pa.Table) -> pa.Table:
        held = _chain(list(zip(table.column("x").to_pylist(), table.column("y").to_pylist(), strict=True)))
        part = pa.array([table.column("part")[0].as_py()] * len(held), pa.int32())
        return pa.table([*[pa.array([p[i] for p in held], pa.float64()) for i in (0, 1)], part], names=["x", "y", "part"])

    xy = points.select(qcol(lon).cast("double").alias("x"), qcol(lat).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    parts = stored(xy.mapInArrow(corners, "x double, y double").withColumn("part", F.spark_partition_id()), "hull")
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while left > _MERGE:
        left = -(-left // _MERGE)
        parts = parts.withColumn("part", (F.col("part") / _MERGE).cast("int"))
        parts = stored(parts.groupBy("part").applyInArrow(merged, "x double, y double, part int"), "hull")
    return _chain([(r["x"], r["y"]) for r in parts.select("x", "y").collect()])


def hull_mask(grid: DataFrame, stations: DataFrame, *, lat: str, lon: str, eps: float = 1e-9) -> DataFrame:
    """G3 + F6: keep cells inside the stations' convex hull or on its edge (within ``eps``)."""
    hull = convex_hull(stations, lat, lon)
    if not hull:
        return grid.limit(0)
    xs, ys = [p[0] for p in hull], [p[1] for p in hull]
    box = F.col("lon").between(min(xs) - eps, max(xs) + eps) & F.col("lat").between(min(ys) - eps, max(ys) + eps)
    edges = F.array(*[F.struct(F.lit(a[0]).alias("x"), F.lit(a[1]).alias("y"), F.lit(b[0] - a[0]).alias("dx"), F.lit(b[1] - a[1]).alias("dy"))
                      for a, b in zip(hull, hull[1:] + hull[:1], strict=True)])
    # Two corners make a segment: its way there and back bounds cells from both sides.
    left = lambda e: e["dx"] * (F.col("lat") - e["y"]) - e["dy"] * (F.col("lon") - e["x"]) >= -eps
    return grid.filter(box & F.forall(edges, left))


def render_table(grid_values: DataFrame, stations: DataFrame, *, target: str, station_id: str, lat: str, lon: str,
                 value: str, grid_value: str = "value", sample_n: int | None = None, seed: int = SAMPLE_SEED,
                 station_name: str | None = None, station_extra: Mapping[str, object] | None = None) -> DataFrame:
    """Clipped, labelled, bounded grid sample plus labelled station rows.

    Grid values are clipped to the 2nd..98th percentile of the *station*
    values (exact), NULL cells dropped; with ``sample_n`` at most that many cells are kept, by a
    seeded hash; every station row is kept with its rounded value.
    ``station_extra`` maps further station columns to the constant that
    stands in for a missing value (P12); grid rows carry NULL there.
    """
    p = exact_quantiles(stations, [value], [0.02, 0.98])[value]
    lo, hi = p if p[0] is not None else (None, None)
    cells = grid_values.filter(qcol(grid_value).isNotNull()) \
        .withColumn("__v", clip(grid_value, lo, hi) if lo is not None else qcol(grid_value))
    if sample_n is not None:
        cells = bounded_sample(cells, ["cell_id"], sample_n, seed)
    grid_rows = cells.select(F.lit("grid").alias("kind"), F.col("cell_id").cast("string").alias("id"),
                             F.lit("Interpolated surface").alias("name"), "lat", "lon", F.col("__v").alias("value"),
                             F.lit(TARGET_UNITS.get(target, "")).alias("unit"),
                             classify("__v", target).alias("label"), classify_detail("__v", target).alias("detail"))
    name = F.coalesce(qcol(station_name), F.lit("Unknown station")) if station_name else F.lit("Unknown station")
    st_rows = stations.select(F.lit("station").alias("kind"),
                              F.coalesce(qcol(station_id).cast("string"), F.lit("Unknown ID")).alias("id"),
                              name.alias("name"), qcol(lat).alias("lat"), qcol(lon).alias("lon"),
                              round_half_even(qcol(value), 4).alias("value"),
                              F.lit(TARGET_UNITS.get(target, "")).alias("unit"),
                              classify(qcol(value), target).alias("label"),
                              classify_detail(qcol(value), target).alias("detail"),
                              *[F.coalesce(qcol(c), F.lit(v)).alias(c) for c, v in (station_extra or {}).items()])
    return grid_rows.unionByName(st_rows, allowMissingColumns=True)


def places_frame(spark) -> DataFrame:
    """The reference places as a (bounded, literal) DataFrame: name, lat, lon, ordinal."""
    return spark.createDataFrame([(n, la, lo, i) for i, (n, la, lo) in enumerate(REFERENCE_PLACES)],
                                 "place_name string, place_lat double, place_lon double, place_order int")


def enrich_points(points: DataFrame, places: DataFrame | None = None, *, target: str, lat: str, lon: str,
                  value: str, place_lat: str = "place_lat", place_lon: str = "place_lon",
                  place_name: str = "place_name", place_order: str = "place_order") -> DataFrame:
    """Every point with its value, interpretation and nearest named place
    (the reference places when ``places`` is omitted)."""
    if places is None:
        places = places_frame(points.sparkSession)
    named = nearest_label(points, places, lat=lat, lon=lon, place_lat=place_lat, place_lon=place_lon,
                          place_name=place_name, place_order=place_order, default=DEFAULT_PLACE)
    return named.withColumns({"label": classify(qcol(value), target),
                              "detail": classify_detail(qcol(value), target)})

