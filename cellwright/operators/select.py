"""Which input points a chunk of output cells needs: spatial semi-joins with a halo.

All of them are equi-joins or range filters on plain columns. A window of a rectilinear grid is a
band in both coordinates; windows of many chunks at once are joined by the coarse cells they
touch, not by comparing every point with every window.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import cells as C
from ..functions import projection
from ..functions.cells import SPHERE, Ellipsoid
from ..sources.shared import materialize

#: Below every radius of curvature of the Earth: angles from it are on the safe side.
SMALL_RADIUS = 6_330_000.0


def chunk_points(points: DataFrame, chunk: int, chunk_level: int, buffer: float = 60.0, ellipsoid: Ellipsoid = SPHERE) -> DataFrame:
    """Points in a chunk or within ``buffer`` metres of it (and some beyond)."""
    placed = C.with_cell(points, chunk_level, ellipsoid, out="__chunk")
    if buffer <= 0:
        return placed.filter(F.col("__chunk") == chunk).drop("__chunk")
    ring = C.ring_level(buffer)
    near = C.chunk_ring(points.sparkSession, chunk, chunk_level, ring).select(F.col("cell_id").alias("__ring"))
    placed = C.add_steps(placed, C.cell_steps("lon", "lat", ring, ellipsoid, "__ring"), ["__ring"])
    return placed.join(near, "__ring", "left_semi").drop("__ring", "__chunk")


def points_by_chunk(points: DataFrame, chunk_level: int, buffer: float = 60.0, ellipsoid: Ellipsoid = SPHERE) -> DataFrame:
    """Every point with each chunk it matters to: its own and those whose halo it may lie in.

    The ring's cells are explored around the point, so there is no list of chunks to join with.
    """
    if buffer <= 0:
        return C.with_cell(points, chunk_level, ellipsoid, out="chunk_id")
    ring = max(C.ring_level(buffer), chunk_level) if C.ring_level(buffer) >= chunk_level else C.ring_level(buffer)
    placed = C.add_steps(points, C.cell_steps("lon", "lat", ring, ellipsoid, "__ring"), ["__ring"])
    around = C.with_neighbours(placed, ring, "__ring", "__near")
    cells = F.concat(F.array("__ring"), F.filter("__near", lambda c: c >= 0))
    if ring >= chunk_level:
        chunks = F.transform(cells, lambda c: F.shiftright(c, 2 * (ring - chunk_level)))
    else:
        n = 4 ** (chunk_level - ring)
        chunks = F.flatten(F.transform(cells, lambda c: F.sequence(c * n, c * n + (n - 1))))
    return around.withColumn("chunk_id", F.explode(F.array_distinct(chunks))).drop("__ring", "__near")


def window_bounds(chunks: DataFrame, level: int, buffer: float = 60.0, ellipsoid: Ellipsoid = SPHERE, step: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Conservative windows of cells: cell_id, c_lon, west, east (relative to c_lon), south, north.

    ``step`` widens them by a grid step each side (longitude, latitude), which resamplers on grids
    need. A window that reaches a pole takes all longitudes.
    """
    pad = math.degrees(max(0.0, buffer) / SMALL_RADIUS)
    df = C.with_center(C.with_vertices(chunks.select("cell_id"), level, ellipsoid), level, ellipsoid, lon="c_lon", lat="c_lat")
    lats, lons = [F.col(f"lat{k}") for k in range(4)], [F.pmod(F.col(f"lon{k}") - F.col("c_lon") + 180.0, F.lit(360.0)) - 180.0 for k in range(4)]
    df = df.withColumns({"south": F.greatest(F.lit(-90.0), F.least(*lats) - pad), "north": F.least(F.lit(90.0), F.greatest(*lats) + pad), "w": F.least(*lons), "e": F.greatest(*lons)})
    lon_pad = pad / F.cos(F.radians(F.greatest(F.abs("south"), F.abs("north"))))
    df = df.withColumns({"w": F.col("w") - lon_pad - step[0], "e": F.col("e") + lon_pad + step[0]})
    # At a pole, and where a window would go beyond the half circle each side.
    round_ = (F.col("south") <= -90.0) | (F.col("north") >= 90.0) | (F.col("w") < -180.0) | (F.col("e") > 180.0)
    return df.select(
        "cell_id", "c_lon", F.when(round_, -180.0).otherwise(F.col("w")).alias("west"), F.when(round_, 180.0).otherwise(F.col("e")).alias("east"),
        (F.col("south") - step[1]).alias("south"), (F.col("north") + step[1]).alias("north"),
    )


def in_window(points: DataFrame, bounds) -> DataFrame:
    """Points in one window (a row of ``window_bounds``); latitude limits go down to the scan."""
    df = points.filter(F.col("lat").between(float(bounds["south"]), float(bounds["north"])))
    relative = F.pmod(F.col("lon") - float(bounds["c_lon"]) + 180.0, F.lit(360.0)) - 180.0
    if bounds["west"] > -180.0 or bounds["east"] < 180.0:
        df = df.filter(relative.between(float(bounds["west"]), float(bounds["east"])))
    return df.withColumn("lon", F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0)


def band_join(points: DataFrame, bounds: DataFrame, width: float = 1.0) -> DataFrame:
    """Points with each window they lie in, by an equi-join on latitude bands of ``width`` degrees."""
    bands = bounds.withColumn("__band", F.explode(F.sequence(F.floor(F.col("south") / width), F.floor(F.col("north") / width))))
    hit = points.withColumn("__band", F.floor(F.col("lat") / width)).join(bands, "__band")
    relative = F.pmod(F.col("lon") - F.col("c_lon") + 180.0, F.lit(360.0)) - 180.0
    return hit.filter(F.col("lat").between(F.col("south"), F.col("north")) & relative.between(F.col("west"), F.col("east"))).drop("__band", "c_lon", "west", "east", "south", "north")


def in_windows(points: DataFrame, bounds: DataFrame, width: float = 1.0) -> DataFrame:
    """Points that lie in any of the windows, each once. The limits of latitude of them all go down to the scan."""
    limits = bounds.agg(F.min("south"), F.max("north")).first()  # one row
    if limits[0] is None:
        return points.limit(0)
    bands = bounds.withColumn("__band", F.explode(F.sequence(F.floor(F.col("south") / width), F.floor(F.col("north") / width)))).withColumnsRenamed({c: f"__{c}" for c in ("c_lon", "west", "east", "south", "north")})
    near = points.filter(F.col("lat").between(float(limits[0]), float(limits[1]))).withColumn("__at", F.floor(F.col("lat") / width))
    relative = F.pmod(F.col("lon") - F.col("__c_lon") + 180.0, F.lit(360.0)) - 180.0
    hit = (F.col("__at") == F.col("__band")) & F.col("lat").between(F.col("__south"), F.col("__north")) & relative.between(F.col("__west"), F.col("__east"))
    return near.join(bands.drop("cell_id"), hit, "left_semi").drop("__at")


def near_chunks(points: DataFrame, chunks: DataFrame, chunk_level: int, buffer: float, ellipsoid: Ellipsoid = SPHERE, kind: str = "points", step: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Points in some chunks (cell_id) or within ``buffer`` metres of them, and some beyond, each once.

    Rectilinear grids, and any points if ``step`` asks for grid steps beside the buffer, are cut by
    windows, whose limits reach the scan; other points are looked up by the cells of a ring. Points
    are told apart by all their columns.
    """
    if kind == "rectilinear" or step > (0.0, 0.0):
        return in_windows(points, window_bounds(chunks, chunk_level, buffer, ellipsoid, step))
    # The ring is explored around each point: fine cells of a chunk are too many to list.
    near = points_by_chunk(points, chunk_level, buffer, ellipsoid).join(chunks.select(F.col("cell_id").alias("chunk_id")), "chunk_id", "left_semi")
    return near.drop("chunk_id").dropDuplicates(points.columns)


def _bins(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first).cast("long"), F.floor(last).cast("long")))


def chunk_windows(lon_axis: DataFrame, lat_axis: DataFrame, chunks: DataFrame, level: int, buffer: float = 60.0, ellipsoid: Ellipsoid = SPHERE) -> DataFrame:
    """The window on a grid's axes that each chunk needs, as indices: cell_id, i_west, i_east, n_i, j_south, j_north, n_j.

    ``lon_axis``: i, lon; ``lat_axis``: j, lat; in any direction and convention. A window has the
    nodes within the buffer and one grid step (the largest) beyond on each side. i_west and i_east
    are the ends as seen from the chunk, so a window may go across the antimeridian; round the globe
    it has all nodes. A chunk without nodes on one of the axes has no row. Chunks meet nodes by
    whole degrees.
    """
    steps = []
    for axis, c in ((lon_axis, "lon"), (lat_axis, "lat")):
        by = W.Window.orderBy(c)  # an axis: one of the two sides of a grid
        steps.append(axis.select(F.col(c).cast("double")).distinct().select((F.lead(c).over(by) - F.col(c)).alias("d")).agg(F.max("d")).first()[0] or 0.0)
    bounds = window_bounds(chunks, level, buffer, ellipsoid, tuple(steps))
    relative = F.pmod(F.col("lon") - F.col("c_lon") + 180.0, F.lit(360.0)) - 180.0
    lons = lon_axis.select("i", F.col("lon").cast("double").alias("lon"), F.pmod(F.floor("lon").cast("long"), F.lit(360)).alias("bin"))
    wide = bounds.withColumn("bin", _bins(F.col("c_lon") + F.col("west"), F.col("c_lon") + F.col("east"))).withColumn("bin", F.pmod("bin", F.lit(360))).dropDuplicates(["cell_id", "bin"])
    x = wide.join(lons, "bin").withColumn("r", relative).filter(F.col("r").between(F.col("west"), F.col("east")))
    x = x.groupBy("cell_id").agg(F.min_by("i", F.struct("r", "i")).alias("i_west"), F.max_by("i", F.struct("r", "i")).alias("i_east"), F.count_distinct("i").alias("n_i"))
    lats = lat_axis.select("j", F.col("lat").cast("double").alias("lat"), F.floor("lat").cast("long").alias("bin"))
    y = bounds.withColumn("bin", _bins(F.col("south"), F.col("north"))).join(lats, "bin").filter(F.col("lat").between(F.col("south"), F.col("north")))
    y = y.groupBy("cell_id").agg(F.min_by("j", F.struct("lat", "j")).alias("j_south"), F.max_by("j", F.struct("lat", "j")).alias("j_north"), F.count_distinct("j").alias("n_j"))
    return x.join(y, "cell_id")


def _open(ring: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
    ring = [(float(a), float(b)) for a, b in ring]
    return ring[:-1] if ring[0] == ring[-1] else ring


def _sides(ring: list[tuple[float, float]]):
    return zip(ring, ring[1:] + ring[:1])


def _side_column(ring: list[tuple[float, float]]) -> Column:
    """The sides as one constant array: the plan doesn't grow with the polygon."""
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (*p, *q))]) for p, q in _sides(ring)])


def _inside(ring: list[tuple[float, float]], x: str, y: str) -> Column:
    """Whether a point is strictly inside, by crossings of the polygon's sides."""
    px, py = F.col(x), F.col(y)
    turn = lambda s: (px - s["x1"]) * (s["y2"] - s["y1"]) - (py - s["y1"]) * (s["x2"] - s["x1"])
    crossed = F.filter(_side_column(ring), lambda s: ((s["y1"] > py) != (s["y2"] > py)) & ((turn(s) < 0) == (s["y2"] > s["y1"])))
    on_side = F.exists(_side_column(ring), lambda s: (turn(s) == 0) & px.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])) & py.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"])))
    return (F.size(crossed) % 2 == 1) & ~on_side


def _within(ring: list[tuple[float, float]], distance: float, x: str, y: str) -> Column:
    """Whether a point is less than ``distance`` from a side."""
    px, py = F.col(x), F.col(y)

    def near(s: Column) -> Column:
        dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - s["x1"]) * dx + (py - s["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        a, b = px - (s["x1"] + t * dx), py - (s["y1"] + t * dy)
        return a * a + b * b < distance * distance

    return F.exists(_side_column(ring), near)


def in_polygon(points: DataFrame, ring: Iterable[tuple[float, float]], x: str = "x", y: str = "y", buffer: float = 0.0) -> DataFrame:
    """Points strictly inside a polygon, or less than ``buffer`` from it: a box that the scan can
    use, then crossings of its sides. Points on the boundary are outside.
    """
    ring = _open(ring)
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    df = points.filter((F.col(x) >= min(xs) - buffer) & (F.col(x) <= max(xs) + buffer) & (F.col(y) >= min(ys) - buffer) & (F.col(y) <= max(ys) + buffer))
    return df.filter(_inside(ring, x, y) | _within(ring, buffer, x, y) if buffer > 0 else _inside(ring, x, y))


def projected_ring(places: DataFrame, epsg: int) -> list[tuple[float, float]] | None:
    """The places (corner, lon, lat) of a polygon in a projection; None if some can't be projected."""
    ring = [(r["x"], r["y"]) for r in projection.from_degrees(places, epsg).orderBy("corner").select("x", "y").collect()]  # the places of one polygon
    return None if any(x is None or y is None for x, y in ring) else ring


def projected_points(points: DataFrame, chunk: int, chunk_level: int, epsg: int, buffer: float = 0.0, extent: "Extent | None" = None, step: int = 8, ellipsoid: Ellipsoid = SPHERE) -> DataFrame:
    """Points x, y of a projection in a chunk or within ``buffer`` (units of the projection) of it.

    The chunk's edge, with ``step`` places a side, and that of the extent are brought to the
    projection, so that limits of x and y reach the scan. A chunk out of the projection's reach is
    looked up by degrees instead.
    """
    spark = points.sparkSession
    ring = projected_ring(C.with_edge(spark.createDataFrame([(chunk,)], "cell_id long"), chunk_level, step, ellipsoid), epsg)
    if ring is None:
        out = chunk_points(projection.to_degrees(points, epsg), chunk, chunk_level, buffer, ellipsoid).drop("lon", "lat")
    else:
        out = in_polygon(points, ring, buffer=buffer)
    if extent is None or extent.whole:
        return out
    corners = [(extent.west, extent.south), (extent.east, extent.south), (extent.east, extent.north), (extent.west, extent.north)]
    places = [(4 * step * k + t, a + (c - a) * t / (4 * step), b + (d - b) * t / (4 * step)) for k, ((a, b), (c, d)) in enumerate(_sides(corners)) for t in range(4 * step)]
    box = projected_ring(spark.createDataFrame(places, "corner int, lon double, lat double"), epsg)
    if box is not None:
        return in_polygon(out, box)
    placed = projection.to_degrees(out, epsg)
    return placed.filter((F.col("lon") > extent.west) & (F.col("lon") < extent.east) & (F.col("lat") > extent.south) & (F.col("lat") < extent.north)).drop("lon", "lat")


@dataclass(frozen=True)
class Extent:
    """A box in degrees."""

    west: float
    south: float
    east: float
    north: float

    @property
    def whole(self) -> bool:
        return (self.west, self.south, self.east, self.north) == (-180.0, -90.0, 180.0, 90.0)

    def union(self, other: "Extent") -> "Extent":
        return Extent(min(self.west, other.west), min(self.south, other.south), max(self.east, other.east), max(self.north, other.north))

    @classmethod
    def of(cls, geometry) -> "Extent":
        """From an Extent, a (west, south, east, north) tuple or a GeoJSON geometry's box."""
        if isinstance(geometry, cls):
            return geometry
        if isinstance(geometry, dict):
            if geometry.get("type") not in ("Polygon", "MultiPolygon"):
                raise ValueError("the output extent must be a polygon")
            parts = geometry["coordinates"] if geometry["type"] == "MultiPolygon" else [geometry["coordinates"]]
            xs, ys = zip(*[(p[0], p[1]) for part in parts for p in part[0]])
            return cls(min(xs), min(ys), max(xs), max(ys))
        return cls(*map(float, geometry))


def coverage(spark, extent: Extent, level: int, ellipsoid: Ellipsoid = SPHERE) -> DataFrame:
    """Cells at ``level`` that touch an extent: cell_id, inside (whether all of it lies within).

    Goes down from the base cells and keeps the cells whose window meets the extent, so that the
    work follows the number of cells that are found. The whole sphere needs no test.
    """
    if extent.whole:
        return C.whole_sphere(spark, level).withColumn("inside", F.lit(True))
    at = C.whole_sphere(spark, 0)
    for l in range(level + 1):
        if l:
            at = C.children(at.select("cell_id"), 1).select(F.col("child_id").alias("cell_id"))
        # Above the last level a margin of half a cell makes up for curved edges.
        margin = 0.0 if l == level else C.RADIUS * math.sqrt(math.pi / 3) / 2**l / 2
        w = window_bounds(at, l, margin, ellipsoid)
        shift = F.pmod(F.lit((extent.west + extent.east) / 2) - F.col("c_lon") + 180.0, F.lit(360.0)) - 180.0
        half = (extent.east - extent.west) / 2
        meets = (F.col("south") < extent.north) & (F.col("north") > extent.south) & ((F.col("west") < shift + half) & (F.col("east") > shift - half))
        within = (F.col("south") >= extent.south) & (F.col("north") <= extent.north) & (F.col("west") >= shift - half) & (F.col("east") <= shift + half)
        at = w.filter(meets).select("cell_id", within.alias("inside"))
        if l < level and l % 4 == 3:
            at = materialize(at)
    return at


def _crossings(sides: Column, px: Column, py: Column) -> Column:
    """Whether a place is inside a polygon, by the number of its sides to one hand."""
    turn = lambda s: (px - s["x1"]) * (s["y2"] - s["y1"]) - (py - s["y1"]) * (s["x2"] - s["x1"])
    return F.size(F.filter(sides, lambda s: ((s["y1"] > py) != (s["y2"] > py)) & ((turn(s) < 0) == (s["y2"] > s["y1"])))) % 2 == 1


def _cut(sides: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Whether a side of a polygon has a place in a box: their boxes meet, and the box isn't on one hand of it."""

    def one(s: Column) -> Column:
        turns = [(x - s["x1"]) * (s["y2"] - s["y1"]) - (y - s["y1"]) * (s["x2"] - s["x1"]) for x in (x0, x1) for y in (y0, y1)]
        apart = (F.greatest(s["x1"], s["x2"]) < x0) | (F.least(s["x1"], s["x2"]) > x1) | (F.greatest(s["y1"], s["y2"]) < y0) | (F.least(s["y1"], s["y2"]) > y1)
        return ~apart & (F.least(*turns) <= 0) & (F.greatest(*turns) >= 0)

    return F.exists(sides, one)


def outline(geometry) -> tuple[tuple[float, float], ...] | None:
    """The outer ring of a GeoJSON polygon, which has no holes here; None for anything else."""
    if isinstance(geometry, dict) and geometry.get("type") == "Polygon" and len(geometry["coordinates"]) == 1:
        return tuple(_open([(p[0], p[1]) for p in geometry["coordinates"][0]]))
    return None


def polygon_coverage(spark, ring: Iterable[tuple[float, float]], level: int, ellipsoid: Ellipsoid = SPHERE, step: int = 4) -> DataFrame:
    """Cells at ``level`` that share a place with a polygon: cell_id, inside (whether all of it lies within).

    The polygon's sides are straight in longitude and latitude; it spans less than a turn, and its
    longitudes go on beyond 180 where it goes across the antimeridian. From the base cells down, a
    cell is out, in or cut by the box of its corners. What is in isn't looked at again, what is
    cut is split, and at the last level held against the polygon itself: ``step`` places on each
    side of the cell, the lines between them, and the polygon's own corners in it.
    """
    ring = _open(ring)
    sides, ref = _side_column(ring), sum(x for x, _ in ring) / len(ring)
    turned = lambda c: F.pmod(c - ref + 180.0, F.lit(360.0)) - 180.0 + ref
    turns = F.array(*[F.lit(t) for t in (-360.0, 0.0, 360.0)])  # the box may reach the polygon from either side
    steps = [*range(level % 2, level, 2), level]  # two levels at a time
    at, whole, before = C.whole_sphere(spark, steps[0]), [], steps[0]
    for l in steps:
        if l > before:
            at = C.children(at, l - before).select(F.col("child_id").alias("cell_id"))
        before = l
        margin = 0.0 if l == level else C.RADIUS * math.sqrt(math.pi / 3) / 2**l / 4
        w = window_bounds(at, l, margin, ellipsoid).withColumn("x", turned(F.col("c_lon")))
        box = lambda t: (F.col("x") + t + F.col("west"), F.col("x") + t + F.col("east"), F.col("south"), F.col("north"))
        middle = lambda t: _crossings(sides, F.col("x") + t, (F.col("south") + F.col("north")) / 2)
        told = w.select("cell_id", F.exists(turns, lambda t: _cut(sides, *box(t))).alias("cut"), F.exists(turns, middle).alias("in"))
        told = materialize(told.filter("cut or in"))
        whole.append(C.children(told.filter("in and not cut"), level - l).select(F.col("child_id").alias("cell_id"), F.lit(True).alias("inside")))
        at = told.filter("cut").select("cell_id")
    places = C.with_edge(at, level, step, ellipsoid)
    edges = places.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("corner", "lon", "lat"))).alias("p"))  # 4 step places
    first = turned(F.col("p")[0]["lon"])
    edges = edges.withColumn("p", F.transform("p", lambda q: F.struct((first + F.pmod(q["lon"] - F.col("p")[0]["lon"] + 180.0, F.lit(360.0)) - 180.0).alias("x"), q["lat"].alias("y"))))
    edges = edges.withColumn("e", F.zip_with("p", F.concat(F.slice("p", 2, 4 * step - 1), F.slice("p", 1, 1)), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))))
    hand = lambda s, x, y: (x - s["x1"]) * (s["y2"] - s["y1"]) - (y - s["y1"]) * (s["x2"] - s["x1"])
    across = lambda s, e, t: (hand(s, e["x1"] + t, e["y1"]) * hand(s, e["x2"] + t, e["y2"]) < 0) & (hand(e, s["x1"] - t, s["y1"]) * hand(e, s["x2"] - t, s["y2"]) < 0)
    crossed = F.exists(turns, lambda t: F.exists("e", lambda e: F.exists(sides, lambda s: across(s, e, t))))
    some = F.exists(turns, lambda t: F.exists("p", lambda q: _crossings(sides, q["x"] + t, q["y"])))
    every = F.exists(turns, lambda t: F.forall("p", lambda q: _crossings(sides, q["x"] + t, q["y"])))
    corners = C.with_cell(spark.createDataFrame([(x, y) for x, y in ring], "lon double, lat double"), level, ellipsoid).select("cell_id", F.lit(True).alias("corner")).distinct()
    held = edges.select("cell_id", crossed.alias("crossed"), some.alias("some"), every.alias("every")).join(corners, "cell_id", "left").withColumn("corner", F.coalesce("corner", F.lit(False)))
    out = held.filter("crossed or some or corner").select("cell_id", F.expr("every and not crossed and not corner").alias("inside"))
    for part in whole:
        out = out.unionByName(part)
    return out
