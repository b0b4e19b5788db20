"""Scans of gridded inputs: long-form Parquet tables, grids as axes, and side tables.

A dataset is a folder of Parquet tables, one for each group path; the tree's metadata is a table
of (path, json). Binary formats (GRIB, NetCDF, Zarr) are turned into that form at ingest, outside
the engine.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import crs, projection


def open_group(spark: SparkSession, root: str, group: str, options: dict[str, str] | None = None) -> DataFrame:
    """One group of a dataset; ``options`` go to the reader (object-store settings among them)."""
    return spark.read.options(**(options or {})).parquet(f"{root.rstrip('/')}/{group.strip('/')}" if group else root)


def select_groups(paths: Sequence[str], match: str | Iterable[str] | None = None, exclude: Iterable[str] = ()) -> list[str]:
    """Group paths that match a glob or are listed, without the excluded ones, in their order."""
    exclude = set(exclude)
    if match is None:
        found = list(paths)
    elif isinstance(match, str):
        found = [p for p in paths if fnmatch.fnmatch(p, match)]
    else:
        wanted = list(match)
        missing = [p for p in wanted if p not in paths]
        if missing:
            raise KeyError(f"no such groups: {missing}")
        found = [p for p in paths if p in wanted]
    return [p for p in found if p not in exclude]


def check_isomorphic(trees: Sequence[Sequence[str]]) -> None:
    if any(set(t) != set(trees[0]) for t in trees[1:]):
        raise ValueError("the inputs don't have the same groups")


def find_coordinates(df: DataFrame) -> tuple[str, str, bool]:
    """Longitude and latitude columns by their ``standard_name`` metadata or usual names, and
    whether the columns are axes of a rectilinear grid (metadata ``axis``)."""
    found = {}
    for f in df.schema:
        name = (f.metadata or {}).get("standard_name") or {"lon": "longitude", "lat": "latitude", "longitude": "longitude", "latitude": "latitude"}.get(f.name)
        if name in ("longitude", "latitude"):
            found.setdefault(name, f)
    if len(found) < 2:
        raise ValueError("no longitude and latitude")
    return found["longitude"].name, found["latitude"].name, all("axis" in (f.metadata or {}) for f in found.values())


def find_crs(attributes: dict) -> int | crs.TransverseMercator:
    """What ``proj:`` attributes state (default 4326): an EPSG code that is known, or the projection
    that WKT2 or PROJJSON describe. An error if they disagree.

    A code that isn't known goes by the description beside it, if there is one.
    """
    codes = set()
    if (e := attributes.get("proj:epsg")) is not None:
        codes.add(int(e))
    if (c := attributes.get("proj:code")) is not None:
        codes.add(int(str(c).rpartition(":")[2]))
    described = {crs.read(attributes[k]) for k in ("proj:wkt2", "proj:projjson") if attributes.get(k)}
    if described and not any(map(crs.known, codes)):
        codes = described
    else:
        codes |= described
    if len(codes) > 1:
        raise ValueError(f"the coordinate reference systems disagree: {sorted(map(str, codes))}")
    return codes.pop() if codes else 4326


def _spherical(name: str, field) -> bool:
    return (field.metadata or {}).get("standard_name") in ("longitude", "latitude") or name in ("lon", "lat", "longitude", "latitude")


@dataclass(frozen=True)
class Spatial:
    """How the points of a group are placed: one kind, and for each input a reference system and two columns."""

    kind: str  # projected, rectilinear or points
    epsg: tuple[int | crs.TransverseMercator, ...]
    columns: tuple[tuple[str, str], ...]


def spatial(df: DataFrame, default_epsg: int = 4326) -> Spatial | None:
    """What places the points of a table; None if nothing does.

    x and y are of the reference system that their ``proj:`` metadata state, else of the input's
    own. Where there are degrees besides, they are used.
    """
    if sum(_spherical(f.name, f) for f in df.schema) >= 2:
        lon, lat, axes = find_coordinates(df)
        return Spatial("rectilinear" if axes else "points", (4326,), ((lon, lat),))
    if {"x", "y"} <= set(df.columns):
        own = find_crs({k: v for f in df.schema if f.name in ("x", "y") for k, v in (f.metadata or {}).items()} or {"proj:epsg": default_epsg})
        if own != 4326:
            return Spatial("projected", (own,), (("x", "y"),))
    return None


def placements(inputs: Sequence[DataFrame], default_epsg: Sequence[int] | None = None) -> list[dict]:
    """For each input its number, its kind of placement (or ``empty``, ``no coordinates``), reference system and columns."""
    out = []
    for i, df in enumerate(inputs):
        at = spatial(df, default_epsg[i] if default_epsg else 4326) if df.columns else None
        kind = at.kind if at else "no coordinates" if df.columns else "empty"
        out.append({"input": i, "kind": kind, "epsg": at.epsg[0] if at else None, "columns": at.columns[0] if at else None})
    return out


def group_spatial(path: str, inputs: Sequence[DataFrame], default_epsg: Sequence[int] | None = None) -> Spatial | None:
    """How a group of several inputs is placed; None if none of them has coordinates.

    They must be of one kind; if not, the error names the inputs of each.
    """
    table = placements(inputs, default_epsg)
    kinds = {row["kind"]: [r["input"] for r in table if r["kind"] == row["kind"]] for row in table}
    if len(kinds) > 1:
        raise ValueError(f"group {path!r} is not of one kind: " + ", ".join(f"{k} in inputs {v}" for k, v in kinds.items()))
    if not set(kinds) & {"projected", "rectilinear", "points"}:
        return None
    return Spatial(*kinds, tuple(r["epsg"] for r in table), tuple(r["columns"] for r in table))


def located(df: DataFrame, at: Spatial, i: int) -> DataFrame:
    """An input's points with lon and lat, which take the place of its own coordinates."""
    (a, b), epsg = at.columns[i], at.epsg[i]
    if at.kind == "projected":
        return projection.to_degrees(df, epsg, a, b).drop(a, b)
    return df.withColumnsRenamed({a: "lon", b: "lat"})


def most_common_crs(codes: DataFrame, epsg: str = "epsg") -> int:
    """The reference system that most inputs have; of several the one that comes first by code."""
    return codes.groupBy(epsg).count().orderBy(F.desc("count"), epsg).first()[0]


def extents(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The smallest box of the points of each input (or of all): ``by``, west, south, east, north.

    In longitude it is all but the largest gap on the circle, so east is beyond 180 where a box goes
    across the antimeridian. Points are summed up by whole degrees first: at most 360 rows an input
    look for the gap. Of equal gaps the one with the lowest west end after it counts.
    """
    placed = points.filter("lon is not null and lat is not null").withColumn("__lon", F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0)
    bins = placed.groupBy(*by, F.floor("__lon").alias("__bin")).agg(F.min("__lon").alias("__w"), F.max("__lon").alias("__e"), F.min("lat").alias("south"), F.max("lat").alias("north"))
    one = W.Window.partitionBy(*by)
    before = F.coalesce(F.lag("__e").over(one.orderBy("__bin")), F.max("__e").over(one) - 360.0)
    gaps = bins.withColumn("__gap", F.col("__w") - before).withColumn("__before", before)
    box = gaps.groupBy(*by).agg(F.max_by(F.struct("__w", "__before"), F.struct("__gap", -F.col("__w"))).alias("__x"), F.min("south").alias("south"), F.max("north").alias("north"))
    west, end = F.col("__x")["__w"], F.col("__x")["__before"]
    return box.select(*by, west.alias("west"), "south", F.when(end < west, end + 360.0).otherwise(end).alias("east"), "north")


def largest_step(axis: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The largest distance between neighbouring nodes of each axis: ``by``, step."""
    nodes = axis.select(*by, value).distinct().withColumn("__next", F.lead(value).over(W.Window.partitionBy(*by).orderBy(value)))
    return nodes.groupBy(*by).agg(F.max(F.col("__next") - F.col(value)).alias("step"))


def rectilinear_points(values: DataFrame, lon: DataFrame, lat: DataFrame, input_id: int = 0) -> DataFrame:
    """Points of a grid (i, j, variables) from its axes (i, lon) and (j, lat), numbered row by row."""
    n = lon.count()
    joined = values.join(F.broadcast(lon), "i").join(F.broadcast(lat), "j")  # axes: the sides of the grid
    return joined.withColumns({"input_id": F.lit(input_id), "point_idx": F.col("j").cast("long") * n + F.col("i")})


def mesh(lon: DataFrame, lat: DataFrame) -> DataFrame:
    """All nodes of two axes, as a regular product of longitudes and latitudes has them."""
    return lat.crossJoin(lon)


def first_member(fields: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Analysis fields in long form: ensemble member 0 and canonical variable names."""
    df = fields.filter("number = 0").drop("number") if "number" in fields.columns else fields
    return df.withColumnsRenamed(renames if renames is not None else {"msl": "mslp", "siconc": "sic"})


def drop_variables(df: DataFrame, patterns: Iterable[str]) -> DataFrame:
    import re

    return df.drop(*[c for c in df.columns if any(re.fullmatch(p, c) for p in patterns)])
