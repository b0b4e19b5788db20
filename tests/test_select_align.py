import numpy as np
import pytest

from cellwright.functions import cells as C
from cellwright.functions import projection as J
from cellwright.operators import align as A
from cellwright.operators import select as S
from pyspark.sql import functions as F


@pytest.mark.parametrize("lon,lat", [(0.1, 0.1), (179.99, 10.0), (-45.0, 89.2), (30.0, -41.8)])
def test_halo_holds_every_point_within_the_buffer(spark, lon, lat):
    buffer, level = 100_000.0, 4
    chunk = C.with_cell(spark.createDataFrame([(lon, lat)], "lon double, lat double"), level).first()["cell_id"]
    edge = C.with_vertices(spark.createDataFrame([(chunk,)], "cell_id long"), level).first()
    rng = np.random.default_rng(0)
    rows = []
    for k in range(4):
        la0, lo0 = edge[f"lat{k}"], edge[f"lon{k}"]
        for b in rng.uniform(0, 2 * np.pi, 25):
            d = rng.uniform(0, buffer) / C.RADIUS
            la = np.arcsin(np.sin(np.radians(la0)) * np.cos(d) + np.cos(np.radians(la0)) * np.sin(d) * np.cos(b))
            lo = np.radians(lo0) + np.arctan2(np.sin(b) * np.sin(d) * np.cos(np.radians(la0)), np.cos(d) - np.sin(np.radians(la0)) * np.sin(la))
            rows.append((float((np.degrees(lo) + 180) % 360 - 180), float(np.degrees(la))))
    pts = spark.createDataFrame(rows, "lon double, lat double")
    assert S.chunk_points(pts, chunk, level, buffer).count() == len(rows)
    by = S.points_by_chunk(pts, level, buffer).filter(F.col("chunk_id") == chunk)
    assert by.count() == len(rows)
    w = S.window_bounds(spark.createDataFrame([(chunk,)], "cell_id long"), level, buffer)
    assert S.in_window(pts, w.first()).count() == len(rows)
    assert S.band_join(pts, w).count() == len(rows)


def test_no_buffer_is_the_chunk_alone(spark):
    pts = spark.range(2000).selectExpr("id * 0.18 - 180 as lon", "(id * 37 % 1700) / 10 - 85 as lat")
    assert S.chunk_points(pts, 5, 1, 0.0).count() == C.with_cell(pts, 1).filter("cell_id = 5").count()


def test_latitude_limits_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("cast(id as double) as lon", "cast(id as double) - 50 as lat").write.parquet(f"{tmp_path}/p")
    bounds = {"south": -1.0, "north": 1.0, "c_lon": 0.0, "west": -180.0, "east": 180.0}
    plan = S.in_window(spark.read.parquet(f"{tmp_path}/p"), bounds)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lat,-1.0)" in plan and "LessThanOrEqual(lat,1.0)" in plan


def test_polygons(spark):
    pts = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0), (5.0, 0.0), (9.0, 9.0), (4.9, 4.9)], "x double, y double")
    got = {(r["x"], r["y"]) for r in S.in_polygon(pts, [(0, 0), (10, 0), (0, 10), (0, 0)]).collect()}
    assert got == {(1.0, 1.0), (4.9, 4.9)}
    assert S.Extent.of({"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 3], [0, 0]]]}) == S.Extent(0, 0, 2, 3)


def test_coverage(spark):
    assert S.coverage(spark, S.Extent(-180, -90, 180, 90), 2).count() == 192
    got = {r["cell_id"] for r in S.coverage(spark, S.Extent(-20, -10, 30, 25), 4).collect()}
    pts = spark.range(20000).selectExpr("(id * 7919 % 50000) / 1000e0 - 20 as lon", "(id * 15013 % 35000) / 1000e0 - 10 as lat")
    need = {r[0] for r in C.with_cell(pts, 4).select("cell_id").distinct().collect()}
    assert need <= got and len(got) < 1.5 * len(need)
    inside = S.coverage(spark, S.Extent(-20, -10, 30, 25), 4).filter("inside")
    v = C.with_vertices(inside.select("cell_id"), 4).toPandas()
    assert v[[f"lat{k}" for k in range(4)]].to_numpy().min() >= -10 and v[[f"lat{k}" for k in range(4)]].to_numpy().max() <= 25


def test_utm_round_trip_through_the_forward_series(spark):
    # A point on the central meridian of zone 31 at the equator, and published pairs.
    df = spark.createDataFrame([(500000.0, 0.0), (448251.795, 5411932.678)], "x double, y double")
    rows = J.to_degrees(df, 32631).collect()
    assert (rows[0]["lon"], rows[0]["lat"]) == pytest.approx((3.0, 0.0), abs=1e-12)
    assert (rows[1]["lon"], rows[1]["lat"]) == pytest.approx((2.2945, 48.8582), abs=1e-4)
    south = J.to_degrees(spark.createDataFrame([(500000.0, 10_000_000.0)], "x double, y double"), 32731).first()
    assert south["lat"] == pytest.approx(0.0, abs=1e-12)
    with pytest.raises(ValueError):
        J.utm_zone(4326)


def test_alignment(spark):
    a = spark.createDataFrame([(0, x, 1.0) for x in ("d01", "d02", "d03")], "point_idx long, detector string, v double")
    b = spark.createDataFrame([(0, x, 2.0) for x in ("d02", "d03")], "point_idx long, detector string, v double")
    labels = lambda dfs: [sorted(r["detector"] for r in d.collect()) for d in dfs]
    assert labels(A.align([a, b], "detector", "outer")) == [["d01", "d02", "d03"]] * 2
    assert labels(A.align([a, b], "detector", "inner")) == [["d02", "d03"]] * 2
    assert labels(A.align([a, b], "detector", "reindex", ["d01", "d02", "d03", "d04"])) == [["d01", "d02", "d03", "d04"]] * 2
    for bad in (lambda: A.align([a, b], "detector", "exact"), lambda: A.align([a, b], "detector", "reindex", ["d01"]), lambda: A.align([a], "nothing"), lambda: A.check_compatible([a, b], "detector")):
        with pytest.raises(ValueError):
            bad()
    raw = a.withColumn("detector", F.col("detector").cast("binary"))
    assert labels(A.align([raw, b], "detector", "outer"))[0] == ["d01", "d02", "d03"]
    union = A.union_points([a, b.withColumnRenamed("v", "w")])
    assert union.count() == 5 and union.filter("input_id = 1 and v is null").count() == 2


def test_copied_tables(spark):
    a = spark.createDataFrame([(1, float("nan"), None), (2, 1.0, "x")], "k int, f double, s string")
    assert A.copy_table([a, a], ["s.*"]).columns == ["k", "f"]
    with pytest.raises(ValueError):
        A.copy_table([a, a.limit(1)])
    with pytest.raises(ValueError):
        A.table_difference(a, a.drop("s"))


def brute_coverage(spark, ring, level, step=4):
    """Every cell's places and edges against the polygon, in plain Python."""
    import math

    def inside(x, y):
        return sum((a[1] > y) != (b[1] > y) and ((x - a[0]) * (b[1] - a[1]) - (y - a[1]) * (b[0] - a[0]) < 0) == (b[1] > a[1]) for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1

    hand = lambda a, b, p: (p[0] - a[0]) * (b[1] - a[1]) - (p[1] - a[1]) * (b[0] - a[0])
    cells = {}
    for r in C.with_edge(C.whole_sphere(spark, level), level, step).collect():
        cells.setdefault(r["cell_id"], {})[r["corner"]] = (r["lon"], r["lat"])
    own = {r[0] for r in C.with_cell(spark.createDataFrame(ring, "lon double, lat double"), level).select("cell_id").collect()}
    ref, out = sum(x for x, _ in ring) / len(ring), {}
    for c, at in cells.items():
        p = [at[k] for k in range(4 * step)]
        x0 = (p[0][0] - ref + 180) % 360 - 180 + ref
        p = [(x0 + (x - p[0][0] + 180) % 360 - 180, y) for x, y in p]
        for t in (-360, 0, 360):
            q = [(x + t, y) for x, y in p]
            within = [inside(*v) for v in q]
            cross = any(hand(a, b, u) * hand(a, b, v) < 0 and hand(u, v, a) * hand(u, v, b) < 0 for a, b in zip(ring, ring[1:] + ring[:1]) for u, v in zip(q, q[1:] + q[:1]))
            if any(within) or cross:
                out[c] = out.get(c, False) or all(within) and not cross
    return {c: out.get(c, False) and c not in own for c in {*out, *own}}


@pytest.mark.parametrize("ring", [
    [(-20.0, 10.0), (35.0, 5.0), (40.0, 50.0), (10.0, 20.0), (-10.0, 55.0)], [(170.0, -10.0), (195.0, -20.0), (200.0, 15.0), (175.0, 12.0)], [(100.1, 3.1), (100.4, 3.2), (100.2, 3.4)], [(-60.0, 60.0), (60.0, 62.0), (50.0, 85.0), (-50.0, 84.0)],
], ids=["star", "antimeridian", "within-a-cell", "high"])
def test_polygon_coverage(spark, ring):
    got = {r["cell_id"]: r["inside"] for r in S.polygon_coverage(spark, ring + ring[:1], 3).collect()}
    assert got == brute_coverage(spark, ring, 3)


def test_windows_on_axes(spark):
    """Each chunk's window against all nodes, for a grid that goes round and one that doesn't."""
    for west, n in ((0.5, 90), (150.0, 20)):
        lons = spark.range(n).selectExpr("cast(id as int) as i", f"{west} + id * 4e0 as lon")
        lats = spark.range(45).selectExpr("cast(id as int) as j", "88e0 - id * 4e0 as lat")
        got = {r["cell_id"]: r for r in S.chunk_windows(lons, lats, C.whole_sphere(spark, 2), 2, 1000.0).collect()}
        for b in S.window_bounds(C.whole_sphere(spark, 2), 2, 1000.0, step=(4.0, 4.0)).collect():
            x = [(r, i) for i in range(n) if b["west"] <= (r := (west + 4 * i - b["c_lon"] + 180) % 360 - 180) <= b["east"]]
            y = [j for j in range(45) if b["south"] <= 88 - 4 * j <= b["north"]]
            r = got.get(b["cell_id"])
            assert (r is not None) == bool(x and y)
            if r is not None:
                assert (r["i_west"], r["i_east"], r["n_i"]) == (min(x)[1], max(x)[1], len(x)) and (r["j_north"], r["j_south"], r["n_j"]) == (min(y), max(y), len(y))
