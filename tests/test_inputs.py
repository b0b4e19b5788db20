"""Inputs by degrees and in projections, their consistency, conventions, stored links, labels together."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwright.functions import cells as C
from cellwright.functions import crs
from cellwright.functions import projection as J
from cellwright.operators import resample as R
from cellwright.operators import select as S
from cellwright.plans import staging as G
from cellwright.plans.settings import Chunks, Convention, ExtraDimension, Grid, Group, Resampler, Settings
from cellwright.sources import grids
from cellwright.sources.links import link_key, stored_neighbours


def utm_points(spark, n=400):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y), float(v)) for i, (x, y, v) in enumerate(zip(rng.uniform(3e5, 7e5, n), rng.uniform(5e6, 5.4e6, n), rng.uniform(0, 9, n)))]
    return spark.createDataFrame(rows, "point_idx long, x double, y double, v double")


def tagged(df, epsg=32631):
    return df.withColumn("x", F.col("x").alias("x", metadata={"proj:epsg": epsg})).withColumn("y", F.col("y").alias("y"))


def test_utm_there_and_back(spark):
    # A published example: 51.2 N 7.5 E is 395201.310 E 5673135.241 N of zone 32.
    known = J.from_degrees(spark.createDataFrame([(7.5, 51.2)], "lon double, lat double"), 32632).first()
    assert abs(known["x"] - 395201.310) < 0.001 and abs(known["y"] - 5673135.241) < 0.001
    pts = spark.createDataFrame([(3.0, 0.0), (3.0 - 75, 20.0), (3.0 + 81, 5.0), (183.0, 89.9)], "lon double, lat double")
    out = J.from_degrees(pts, 32631).collect()
    assert (out[0]["x"], out[0]["y"]) == (500000.0, 0.0) and out[2]["x"] is None and out[3]["x"] is None
    back = J.to_degrees(J.from_degrees(pts.limit(2), 32731).select("x", "y"), 32731).collect()
    assert all(abs(a["lon"] - b[0]) < 1e-6 and abs(a["lat"] - b[1]) < 1e-6 for a, b in zip(back, [(3.0, 0.0), (-72.0, 20.0)]))
    web = J.to_degrees(J.from_degrees(pts, 3857).select("x", "y"), 3857).collect()
    assert all(abs(a["lat"] - b) < 1e-9 for a, b in zip(web, [0.0, 20.0, 5.0, 89.9]))


def test_edges_meet_the_corners(spark):
    cells = C.whole_sphere(spark, 2)
    corners = {r["cell_id"]: r for r in C.with_vertices(cells, 2, C.WGS84).collect()}
    for r in C.with_edge(cells, 2, 3, C.WGS84).filter("corner % 3 = 0").collect():
        k = r["corner"] // 3
        assert (r["lon"], r["lat"]) == (corners[r["cell_id"]][f"lon{k}"], corners[r["cell_id"]][f"lat{k}"])


def test_projected_selection_is_that_by_degrees(spark):
    pts = utm_points(spark)
    placed = C.with_cell(J.to_degrees(pts, 32631), 6, C.WGS84)
    chunk = placed.groupBy("cell_id").count().orderBy(F.desc("count")).first()["cell_id"]
    own = {r[0] for r in placed.filter(F.col("cell_id") == chunk).select("point_idx").collect()}
    ids = lambda df: {r[0] for r in df.select("point_idx").collect()}
    assert ids(S.projected_points(pts, chunk, 6, 32631, step=64, ellipsoid=C.WGS84)) == own
    wide = S.projected_points(pts, chunk, 6, 32631, 20_000.0, ellipsoid=C.WGS84)
    assert own < ids(wide) and wide.columns == pts.columns
    part = ids(S.projected_points(pts, chunk, 6, 32631, 20_000.0, S.Extent(2.0, 46.0, 3.0, 47.0), ellipsoid=C.WGS84))
    inside = ids(J.to_degrees(pts, 32631).filter("lon > 2 and lon < 3 and lat > 46 and lat < 47"))
    assert part == ids(wide) & inside
    # A chunk on the other side of the globe is out of the projection's reach.
    far = C.with_cell(spark.createDataFrame([(-177.0, 1.0)], "lon double, lat double"), 6).first()["cell_id"]
    assert S.projected_points(pts, far, 6, 32631).count() == 0


def test_polygons_with_a_buffer(spark):
    pts = spark.createDataFrame([(0.5, 0.5), (1.0, 0.5), (1.05, 0.5), (1.2, 0.5), (1.05, 1.05)], "x double, y double")
    box = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    assert [r["x"] for r in S.in_polygon(pts, box).collect()] == [0.5]
    assert sorted((r["x"], r["y"]) for r in S.in_polygon(pts, box, buffer=0.1).collect()) == [(0.5, 0.5), (1.0, 0.5), (1.05, 0.5), (1.05, 1.05)]


def test_spatial_groups(spark):
    deg = spark.createDataFrame([(0, 1.0, 2.0)], "point_idx long, lon double, lat double")
    named = deg.withColumnRenamed("lon", "a").withColumn("a", F.col("a").alias("a", metadata={"standard_name": "longitude"}))
    flat, none = tagged(utm_points(spark, 3)), spark.createDataFrame([(1,)], "k int")
    assert grids.spatial(deg).kind == "points" and grids.spatial(none) is None and grids.spatial(named).columns == (("a", "lat"),)
    both = grids.group_spatial("g", [flat, tagged(utm_points(spark, 3), 32632)])
    assert both.kind == "projected" and both.epsg == (32631, 32632)
    assert grids.group_spatial("g", [utm_points(spark, 3)], [32631]).epsg == (32631,) and grids.group_spatial("g", [none, none]) is None
    assert grids.located(flat, both, 0).columns[-2:] == ["lon", "lat"] and "x" not in grids.located(flat, both, 0).columns
    for bad in ([deg, flat], [deg, none], [deg, spark.createDataFrame([()], "")]):
        with pytest.raises(ValueError):
            grids.group_spatial("g", bad)
    assert grids.most_common_crs(spark.createDataFrame([(32632,), (32631,), (32632,), (32631,)], "epsg int")) == 32631


def test_projected_inputs_are_converted(spark, tmp_path):
    pts = utm_points(spark)
    tagged(pts).write.parquet(str(tmp_path / "flat/g"))
    J.to_degrees(pts, 32631).drop("x", "y").write.parquet(str(tmp_path / "deg/g"))
    s = Settings({"g": Group(Grid(8, ellipsoid="WGS84"), Chunks("dense", 4), Resampler("bilinear"))})
    out = []
    for name in ("flat", "deg"):
        p = G.plan([str(tmp_path / name)], s, ["g"], extent=(2.0, 45.0, 4.0, 48.0))
        got = {r["cell_id"]: r["v"] for r in G.convert_group(spark, p, "g", links=str(tmp_path / "links")).collect()}
        out.append(got)
    assert out[0].keys() == out[1].keys() and all(abs(out[0][c] - v) < 1e-6 for c, v in out[1].items())


def test_labels_are_resampled_together_as_one_by_one(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), t, float(rng.uniform())) for i, (a, b) in enumerate(zip(rng.uniform(-5, 5, 60), rng.uniform(-5, 5, 60))) for t in ("p", "q")]
    kind = "point_idx long, lon double, lat double, t string, v double"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "all/g"))
    spark.createDataFrame([r for r in rows if (r[0], r[3]) != (7, "q")], kind).write.parquet(str(tmp_path / "some/g"))
    for method in ("nearest", "k-nearest", "bilinear"):
        s = Settings({"g": Group(Grid(6), Chunks("dense", 2), Resampler(method), extra=(ExtraDimension("t"),))})
        convert = lambda name: G.convert_group(spark, G.plan([str(tmp_path / name)], s, ["g"], extent=(-4.0, -4.0, 4.0, 4.0)), "g")  # noqa: E731, B023
        got = {(r["t"], r["cell_id"]): r["v"] for r in convert("all").collect()}
        one = {("p", r["cell_id"]): r["v"] for r in convert("some").filter("t = 'p'").collect()}
        assert len(got) == 2 * len(one) and all(got[k] == v or abs(got[k] - v) < 1e-12 for k, v in one.items())


def test_link_store(spark, tmp_path):
    rng = np.random.default_rng(4)
    pts = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-180, 180, 50), rng.uniform(-80, 80, 50)))], "input_id int, point_idx long, lon double, lat double")
    cells = C.whole_sphere(spark, 1)
    key = link_key(pts, cells, 1, 2)
    assert key == link_key(pts.repartition(3), cells.orderBy(F.desc("cell_id")), 1, 2)
    assert len({key, link_key(pts, cells, 1, 3), link_key(pts, cells, 1, 2, C.WGS84), link_key(pts.limit(49), cells, 1, 2), link_key(pts.withColumn("lon", F.col("lon") + 1e-9), cells, 1, 2)}) == 5
    a = stored_neighbours(pts, cells, 1, 2, str(tmp_path))
    files = sorted(f.name for f in (tmp_path / key).iterdir())
    b = stored_neighbours(pts, cells, 1, 2, str(tmp_path))
    assert files == sorted(f.name for f in (tmp_path / key).iterdir())
    assert a.exceptAll(R.neighbours(pts, cells, 1, 2)).count() == 0 and sorted(a.collect()) == sorted(b.collect()) and a.count() == 96


def test_conventions(spark):
    g = {"g/5": Group(Grid(5), Chunks("dense", 1))}
    assert Convention.of("CF") == Convention("cf") and Convention.of({"name": "cf", "version": "1.14"}).version == "1.14"
    s = Settings(g, conventions=(Convention.of("dggs"), Convention.of({"name": "cf", "grid_mapping": False})))
    assert Settings.from_json(s.to_json()) == s and Settings.from_dict({"groups": {}}).convention("multiscales") is not None
    docs = G.prepare(spark, G.plan([], s, ["g/5"]), "", dry_run=True)
    assert "dggs" in docs["g/5"] and "grid_mapping" not in docs["g/5"]
    docs = G.prepare(spark, G.plan([], Settings(g, conventions=(Convention("cf", "1.13"),)), ["g/5"]), "", dry_run=True)
    assert list(docs["g/5"]) == ["grid_mapping"]
    for bad in (lambda: Convention.of("x"), lambda: Convention("dggs", "1"), lambda: Convention("cf", "1.9"), lambda: Convention("cf", "1.x"), lambda: Settings(g, conventions=(Convention("cf"), Convention("cf")))):
        with pytest.raises(ValueError):
            bad()
    assert math.isclose(J.krueger_forward(0.0)[0], 0.0)


def test_reference_systems_from_descriptions(spark):
    from cellwright.plans.catalog import NATIONAL_GRID as wkt

    tm = crs.read(wkt)
    assert (tm.lon0, tm.lat0, tm.scale, tm.x0, tm.y0) == (-2.0, 49.0, 0.9996012717, 400000.0, -100000.0) and tm.ellipsoid == C.Ellipsoid("Airy 1830", 6377563.396, 299.3249646)
    # The worked example that the Ordnance Survey publishes.
    lon, lat = 1 + 43 / 60 + 4.5177 / 3600, 52 + 39 / 60 + 27.2531 / 3600
    at = J.from_degrees(spark.createDataFrame([(lon, lat)], "lon double, lat double"), tm)
    assert abs(at.first()["x"] - 651409.903) < 0.001 and abs(at.first()["y"] - 313177.270) < 0.001
    back = J.to_degrees(at.select("x", "y"), tm).first()
    assert abs(back["lon"] - lon) < 1e-11 and abs(back["lat"] - lat) < 1e-11
    as_json = {
        "type": "ProjectedCRS", "name": "grid",
        "base_crs": {"datum": {"ellipsoid": {"name": "Airy 1830", "semi_major_axis": 6377563.396, "inverse_flattening": 299.3249646}}},
        "conversion": {"method": {"name": "Transverse Mercator"}, "parameters": [
            {"name": "Latitude of natural origin", "value": 49, "unit": "degree"}, {"name": "Longitude of natural origin", "value": -2, "unit": "degree"},
            {"name": "Scale factor at natural origin", "value": 0.9996012717, "unit": "unity"},
            {"name": "False easting", "value": 400000, "unit": "metre"}, {"name": "False northing", "value": -100000, "unit": {"type": "LinearUnit", "name": "metre", "conversion_factor": 1}}]},
        "coordinate_system": {"axis": [{"direction": "east", "unit": "metre"}, {"direction": "north", "unit": "metre"}]},
    }
    assert crs.read(as_json) == tm
    assert grids.find_crs({"proj:wkt2": wkt, "proj:projjson": as_json}) == tm == grids.find_crs({"proj:code": "EPSG:27700", "proj:wkt2": wkt})
    assert crs.read(wkt.replace('ID["EPSG", 27700]', 'ID["EPSG", 32630]')) == 32630
    with pytest.raises(ValueError, match="disagree"):
        grids.find_crs({"proj:epsg": 32631, "proj:wkt2": wkt})
    for part, other, reason in (
        ("9807", "9808", "method"), ("299.3249646", "0", "ellipsoid"), ('LENGTHUNIT["metre", 1], ID["EPSG", 8806]', 'LENGTHUNIT["foot", 0.3048], ID["EPSG", 8806]', "metres"),
        ('"Greenwich", 0', '"Paris", 2.33722917', "Greenwich"), ("east, ORDER", "west, ORDER", "west"), ("PROJCRS", "GEOGCRS", "projected"), ('ID["EPSG", 8805]]', 'ID["EPSG", 1]]', "missing"),
    ):
        with pytest.raises(ValueError, match=reason):
            crs.read(wkt.replace(part, other))
    for bad in ("PROJCRS[", "x]", 'A["b"] B["c"]', "[1]"):
        with pytest.raises(ValueError, match="WKT"):
            crs.wkt_tree(bad)


def test_described_inputs_are_converted(spark, tmp_path):
    """Points in a grid known by its description alone come out as the same points in degrees."""
    from cellwright.plans.catalog import NATIONAL_GRID as wkt

    pts = spark.createDataFrame([(i, 1e5 + 7919.0 * i % 5e5, 1e5 + 15013.0 * i % 8e5, float(i)) for i in range(200)], "point_idx long, x double, y double, v double")
    pts.withColumn("x", F.col("x").alias("x", metadata={"proj:wkt2": wkt})).write.parquet(str(tmp_path / "a/g"))
    J.to_degrees(pts, crs.read(wkt)).drop("x", "y").write.parquet(str(tmp_path / "b/g"))
    s = Settings({"g": Group(Grid(6), Chunks("dense", 1), Resampler("nearest"))})
    a, b = (G.convert_group(spark, G.plan([str(tmp_path / n)], s, ["g"], extent=(-8, 49, 2, 61)), "g") for n in "ab")
    assert a.count() > 0 and a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
