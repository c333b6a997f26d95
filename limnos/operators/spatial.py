"""Nearest-neighbour joins without a cross join (J7, J8, J9; k-NN for G2).

Both sides are reduced to distinct coordinates (a hot location collapses in
the map-side partial aggregate).  The right points are counted in cells of many
sizes in one pass; cells of a few points are leaves, so a dense town is split
finer than an empty region.  Each left location descends from the root: it keeps
the cells that may still hold one of its k nearest points, judged by distance
bounds to cells and their counts, and only the points of its last leaves are
compared with it.  Work per left location follows the depth of the tree, also
when all right points lie in one far cluster; there is no all-pairs round.
Rounds are written to the shared scratch folder, which cuts their lineage.

Metrics:
  * ``planar_rad`` (parity): Euclid on (lat, lon) in radians x 6371 km,
    no cos(lat) factor — what the reference computes.
  * ``degrees``: squared-degree distance (nearest named place).
  * ``haversine``: great-circle km; candidates come from unit-sphere cubes,
    so poles and the antimeridian need no special case.
Ranking is by the metric (ties by ``tie`` ascending, so the first listed
wins as in the reference's strict ``<`` scan).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.session import qcol, stored

EARTH_RADIUS_KM = 6371.0  # fixed value: the reference's Earth radius

_LAT, _LON = "__lat", "__lon"
_RLAT, _RLON = "__rlat", "__rlon"


def rank_key(metric: str, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Monotone ranking key of the metric (exact IEEE ops for planar metrics)."""
    if metric in ("planar_rad", "degrees"):
        dlat, dlon = lat2 - lat1, lon2 - lon1
        return dlat * dlat + dlon * dlon
    if metric == "haversine":
        s1 = F.sin(F.radians(lat2 - lat1) / 2.0)
        s2 = F.sin(F.radians(lon2 - lon1) / 2.0)
        return s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    raise ValueError(f"unknown metric {metric!r}")


def distance_value(metric: str, lat1: Column, lon1: Column, lat2: Column, lon2: Column, key: Column) -> Column:
    """Reported distance: km for ``planar_rad``/``haversine``, degrees for ``degrees``."""
    if metric == "planar_rad":
        a = F.radians(lat1) - F.radians(lat2)
        b = F.radians(lon1) - F.radians(lon2)
        return F.sqrt(a * a + b * b) * F.lit(EARTH_RADIUS_KM)
    if metric == "haversine":
        return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(key, F.lit(1.0))))
    return F.sqrt(key)


def _xyz(lat: Column, lon: Column) -> list[Column]:
    la, lo = F.radians(lat), F.radians(lon)
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def _coords(metric: str, lat: str, lon: str) -> list[Column]:
    """Search coordinates as columns ``__x0..``: degrees on the plane, the unit sphere for great circles."""
    coords = _xyz(F.col(lat), F.col(lon)) if metric == "haversine" else [F.col(lat), F.col(lon)]
    return [c.alias(f"__x{i}") for i, c in enumerate(coords)]


def _prepare_right(right: DataFrame, lat: str, lon: str, tie: str, cols: Sequence[str], k: int) -> DataFrame:
    r = right.filter(_finite(qcol(lat).cast("double")) & _finite(qcol(lon).cast("double")))
    payload = list(dict.fromkeys([tie, *cols]))
    body = F.struct(*[qcol(c).alias(c) for c in payload])
    if k == 1:
        # Only the smallest tie key of co-located points can ever win.
        return (r.groupBy(qcol(lat).alias(_RLAT), qcol(lon).alias(_RLON))
                .agg(F.min_by(body, qcol(tie)).alias("__p")))
    # k smallest tie keys per coordinate; salted first pass so one location
    # holding a large share of the rows is spread over many tasks.
    r = r.select(qcol(lat).alias(_RLAT), qcol(lon).alias(_RLON), body.alias("__p"),
                 F.pmod(F.hash(qcol(tie)), F.lit(64)).alias("__salt"))
    w1 = Window.partitionBy(_RLAT, _RLON, "__salt").orderBy(F.col(f"__p.`{tie}`"))
    r = r.withColumn("__rn", F.row_number().over(w1)).filter(F.col("__rn") <= k)
    w2 = Window.partitionBy(_RLAT, _RLON).orderBy(F.col(f"__p.`{tie}`"))
    return r.withColumn("__rn", F.row_number().over(w2)).filter(F.col("__rn") <= k).drop("__rn", "__salt")


class _Tree:
    """Cells of the right points: every level halves the edge twice.

    ``cells``: level, cell indices, number of points, whether the cell is a leaf;
    ``points``: the right rows with the leaf that holds them.  A cell of at most
    ``leaf_points`` points is a leaf, so dense places are split further than
    empty ones; cells below a leaf are not kept.
    """

    LEVELS = 19  # 4^19 cells an edge: below the resolution of a coordinate

    def __init__(self, rp: DataFrame, metric: str, k: int):
        self.metric, self.dims = metric, 3 if metric == "haversine" else 2
        self.x = [f"__x{i}" for i in range(self.dims)]
        self.c = [f"__c{i}" for i in range(self.dims)]
        points = stored(rp.select("*", *_coords(metric, _RLAT, _RLON)), "nearest-points")
        box = points.agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{f.__name__}{x}") for x in self.x for f in (F.min, F.max)]).first()
        self.n = box["n"]
        if not self.n:
            return
        self.origin = [box[f"min{x}"] for x in self.x]
        self.edge = max(max(box[f"max{x}"] - o for x, o in zip(self.x, self.origin)), 1e-9) * (1 + 1e-12)
        self.slack = 1e-13 * max(self.edge, *[abs(o) for o in self.origin])
        leaf_points = max(8, 2 * k)
        level = F.explode(F.sequence(F.lit(0), F.lit(self.LEVELS)))
        index = [F.least(F.floor((F.col(x) - F.lit(o)) / F.lit(self.edge) * F.pow(F.lit(4.0), F.col("__level"))),
                         F.pow(F.lit(4.0), F.col("__level")) - 1).cast("long").alias(c) for x, o, c in zip(self.x, self.origin, self.c)]
        placed = points.withColumn("__level", level).select("*", *index)
        key = ["__level", *self.c]
        counts = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).withColumn("__leaf", (F.col("__n") <= leaf_points) | (F.col("__level") == self.LEVELS))
        counts = stored(counts, "nearest-counts")
        inner = counts.filter(~F.col("__leaf")).select((F.col("__level") + 1).alias("__level"), *[F.col(c).alias(f"__p{c}") for c in self.c])
        up = counts.select("*", *[F.shiftright(F.col(c), 2).alias(f"__p{c}") for c in self.c])
        parents = [f"__p{c}" for c in self.c]
        self.cells = stored(counts.filter("__level = 0").unionByName(up.join(inner, ["__level", *parents], "left_semi").drop(*parents)), "nearest-cells")
        leaves = self.cells.filter("__leaf").select(*key)
        self.points = stored(placed.drop(*self.x).join(leaves, key), "nearest-leaves")

    def bounds(self, frame: DataFrame) -> DataFrame:
        """Add ``__near`` and ``__far``: squared distance bounds from the left point to its cell."""
        edge = F.lit(self.edge) / F.pow(F.lit(4.0), F.col("__level"))
        near, far = F.lit(0.0), F.lit(0.0)
        for x, c, o in zip(self.x, self.c, self.origin):
            lo = F.lit(o) + F.col(c) * edge - F.lit(self.slack)
            hi = F.lit(o) + (F.col(c) + 1) * edge + F.lit(self.slack)
            gap = F.greatest(lo - F.col(x), F.col(x) - hi, F.lit(0.0))
            reach = F.greatest(F.abs(F.col(x) - lo), F.abs(F.col(x) - hi))
            near, far = near + gap * gap, far + reach * reach
        return frame.withColumn("__near", near).withColumn("__far", far)

    def prune(self, frame: DataFrame, k: int) -> DataFrame:
        """Drop cells that lie beyond cells already holding ``k`` points for the same left point."""
        of_left = Window.partitionBy(_LAT, _LON)
        held = F.sum("__n").over(of_left.orderBy("__far", "__level", *self.c).rowsBetween(Window.unboundedPreceding, 0))
        frame = frame.withColumn("__held", held)
        limit = F.min(F.when(F.col("__held") >= k, F.col("__far"))).over(of_left)
        frame = frame.withColumn("__limit", limit)
        return frame.filter(F.col("__limit").isNull() | (F.col("__near") <= F.col("__limit") * (1 + 1e-9))).drop("__held", "__limit")

    def search(self, locs: DataFrame, k: int) -> DataFrame:
        """The leaves (level, cell) that may hold one of the ``k`` nearest points of each left point.

        One round a level; a round joins the open cells with their children.
        The tree's depth ends the loop: dense places are deeper, by the logarithm of their density.
        """
        root = self.cells.filter("__level = 0").select("__n", "__leaf").first()
        cols = [_LAT, _LON, *self.x, "__level", *self.c, "__n", "__leaf", "__near", "__far"]
        start = locs.select(_LAT, _LON, *_coords(self.metric, _LAT, _LON), F.lit(0).alias("__level"), *[F.lit(0).cast("long").alias(c) for c in self.c],
                            F.lit(root["__n"]).cast("long").alias("__n"), F.lit(root["__leaf"]).alias("__leaf"))
        live = stored(self.bounds(start).select(*cols), "nearest-live")
        children = self.cells.select(*[F.shiftright(F.col(c), 2).alias(f"__p{c}") for c in self.c], (F.col("__level") - 1).alias("__up"),
                                     *[F.col(c).alias(f"__k{c}") for c in self.c], F.col("__n").alias("__kn"), F.col("__leaf").alias("__kleaf"))
        for level in range(self.LEVELS):
            if live.filter(~F.col("__leaf")).isEmpty():
                break
            here = children.filter(F.col("__up") == level)
            opened = (live.filter(~F.col("__leaf")).withColumnsRenamed({c: f"__p{c}" for c in self.c})
                      .join(here, [f"__p{c}" for c in self.c])
                      .select(_LAT, _LON, *self.x, F.lit(level + 1).alias("__level"), *[F.col(f"__k{c}").alias(c) for c in self.c],
                              F.col("__kn").alias("__n"), F.col("__kleaf").alias("__leaf")))
            opened = self.bounds(opened).select(*cols)
            live = stored(self.prune(live.filter("__leaf").unionByName(opened), k).select(*cols), "nearest-live")
        return live


def _best(tree: _Tree, leaves: DataFrame, metric: str, k: int, tie: str) -> DataFrame:
    """The ``k`` best right points per left point among the points of its leaves."""
    lat, lon = F.col(_LAT), F.col(_LON)
    cand = (leaves.select(_LAT, _LON, "__level", *tree.c).join(tree.points, ["__level", *tree.c])
            .withColumn("__key", rank_key(metric, lat, lon, F.col(_RLAT), F.col(_RLON))))
    tiecol = F.col(f"__p.`{tie}`")
    if k == 1:
        best = cand.groupBy(_LAT, _LON).agg(F.min_by(F.struct("__p", _RLAT, _RLON, "__key"), F.struct("__key", tiecol)).alias("__b"))
        return best.select(_LAT, _LON, "__b.*")
    ranked = cand.withColumn("__rank", F.row_number().over(Window.partitionBy(_LAT, _LON).orderBy("__key", tiecol)))
    return ranked.filter(F.col("__rank") <= k).select(_LAT, _LON, "__p", _RLAT, _RLON, "__key", "__rank")


def nearest_join(left: DataFrame, right: DataFrame, *, left_lat: str, left_lon: str, right_lat: str,
                 right_lon: str, right_cols: Sequence[str], tie: str, metric: str = "planar_rad", k: int = 1,
                 distance_col: str = "distance_km", rank_col: str = "nn_rank", key_col: str | None = None) -> DataFrame:
    """Attach the ``k`` nearest right points to every left row.

    Returns the left rows with ``right_cols``, ``distance_col``, ``rank_col``
    (k > 1 only) and optionally the raw ranking key as ``key_col``; ``k > 1``
    yields up to ``k`` rows per left row.  Left rows with NULL, NaN or infinite
    coordinates (or an empty right side) get NULL neighbours; such right rows
    are no neighbours.
    """
    keep = [c for c in dict.fromkeys([tie, *right_cols])]
    added = [*keep, distance_col, *([rank_col] if k > 1 else []), *([key_col] if key_col else [])]
    clash = [c for c in added if c in left.columns]
    if clash:
        raise ValueError(f"output columns already on the left side: {clash}")
    rp = _prepare_right(right, right_lat, right_lon, tie, right_cols, k)
    tree = _Tree(rp, metric, k)
    if not tree.n:
        out = left
        for c in keep:
            out = out.withColumn(c, F.lit(None).cast(right.schema[c].dataType))
        out = out.withColumn(distance_col, F.lit(None).cast("double"))
        out = out.withColumn(rank_col, F.lit(None).cast("int")) if k > 1 else out
        return out.withColumn(key_col, F.lit(None).cast("double")) if key_col else out
    locs = (left.filter(_finite(qcol(left_lat).cast("double")) & _finite(qcol(left_lon).cast("double")))
            .select(qcol(left_lat).alias(_LAT), qcol(left_lon).alias(_LON)).distinct())
    found = stored(_best(tree, tree.search(locs, k), metric, k, tie), "nearest-found")
    found = found.select(_LAT, _LON, *[F.col(f"__p.`{c}`").alias(c) for c in keep],
                         distance_value(metric, F.col(_LAT), F.col(_LON), F.col(_RLAT), F.col(_RLON),
                                        F.col("__key")).alias(distance_col),
                         *([F.col("__rank").alias(rank_col)] if k > 1 else []),
                         *([F.col("__key").alias(key_col)] if key_col else []))
    joined = left.join(found, (left[left_lat] == found[_LAT]) & (left[left_lon] == found[_LON]), "left")
    return joined.drop(_LAT, _LON)


def nearest_label(points: DataFrame, places: DataFrame, *, lat: str, lon: str, place_lat: str, place_lon: str,
                  place_name: str, place_order: str, default: str = "Iowa", out_col: str = "nearest_place",
                  ) -> DataFrame:
    """Name of the nearest place by squared degrees; first listed place wins ties;
    ``default`` when there is no place at all."""
    named = places.select(qcol(place_lat).alias("__plat"), qcol(place_lon).alias("__plon"),
                          qcol(place_name).alias("__pname"), qcol(place_order).alias("__pord"))
    out = nearest_join(points, named, left_lat=lat, left_lon=lon, right_lat="__plat", right_lon="__plon",
                       right_cols=["__pname"], tie="__pord", metric="degrees", distance_col="__pdist")
    return out.withColumn(out_col, F.coalesce(F.col("__pname"), F.lit(default))).drop("__pname", "__pord", "__pdist")


def nearest_name(points: DataFrame, stations: DataFrame, *, lat: str, lon: str, station_lat: str,
                 station_lon: str, station_name: str, station_order: str, out_col: str = "nearest_station_name",
                 ) -> DataFrame:
    """Name of the nearest station (squared degrees); a NULL name reads ``Unknown``."""
    return nearest_label(points, stations, lat=lat, lon=lon, place_lat=station_lat, place_lon=station_lon,
                         place_name=station_name, place_order=station_order, default="Unknown", out_col=out_col)
