import json

import pytest
from pyspark.sql import functions as F

from cellwright.plans import metadata as M
from cellwright.plans import staging as G
from cellwright.plans.settings import Chunks, ExtraDimension, Grid, Group, Pyramid, Resampler, Settings, json_schema
from cellwright.plans.products import ensemble_times, field_maps, predefined, sphere_to_ellipsoid, variables
from cellwright.sources import grids, sinks
from cellwright.streaming.cells import cell_windows


def dense(level, **kw):
    return Group(Grid(level), Chunks("dense", 1), **kw)


def test_settings_round_trip_and_rules():
    s = Settings({"a/5": dense(5, extra=(ExtraDimension("t", "reindex", ("x",)),)), "a/4": dense(4)}, {"a": Pyramid((3, 2), {"v": "mode"})}, copies=("tables",))
    assert Settings.from_json(s.to_json()) == s
    assert s.filter_and_replace(lambda p, g: g).groups == s.groups
    assert json.loads(json.dumps(json_schema()))["required"] == ["groups"]
    for bad in (
        lambda: Grid(30), lambda: Grid(3, scheme="x"), lambda: Chunks("dense"), lambda: Chunks("sparse", 2), lambda: Resampler("x"), lambda: Resampler(dtype="int"),
        lambda: Group(Grid(5), resampler=Resampler("cell-point")), lambda: Group(Grid(5), Chunks("none"), Resampler("grid-bilinear")), lambda: Group(Grid(2), Chunks("dense", 3)),
        lambda: Pyramid((2, 2)), lambda: Pyramid((2,), "median"), lambda: Settings({"a/5": dense(5)}, {"a": Pyramid((5,))}), lambda: Settings({"a/5": dense(5)}, {"a": Pyramid((6,))}),
        lambda: Settings({"a/5": dense(5), "a/4": Group(Grid(4), Chunks("dense", 2))}, {"a": Pyramid((3,))}), lambda: Settings({"a": dense(5)}, copies=("a",)), lambda: predefined("x"),
        lambda: Settings.from_dict({"groups": {}, "odd": 1}), lambda: ExtraDimension("t", "reindex"),
    ):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        s.for_group("b")
    assert predefined("dem-glo30").for_group("dem/glo30").grid.level == 18 and predefined("era5").for_group("measurements/oper").resampler.params["threshold"] == 0.5


def test_layouts(spark):
    levels = lambda rows: spark.createDataFrame(rows, "variable string, level int")
    derived = lambda rows: spark.createDataFrame(rows, "variable string, level int, source int")
    native = levels([("a", 3), ("b", 2)])
    lay = json.loads(M.layout_document(M.layout(native, derived([("a", 1, 3), ("b", 1, 2)])), "mean"))
    assert lay["resampling_method"] == "mean" and [x["asset"] for x in lay["layout"]] == ["3/a", "2/b", "1/a", "1/b"] and lay["layout"][0] == {"asset": "3/a"}
    assert lay["layout"][2] == {"asset": "1/a", "derived_from": "3/a", "transform": {"scale": [4.0]}, "resampling_method": "mean"} and lay["layout"][3]["derived_from"] == "2/b"
    assert [x["asset"] for x in json.loads(M.layout_document(M.layout(levels([("a", 3)]), derived([("a", 2, 3)]))))["layout"]] == ["3", "2"]
    with pytest.raises(ValueError):
        M.layout(native, derived([("a", 1, 3), ("b", 1, 2)]), "group")
    both = levels([("a", 5), ("a", 3), ("b", 4)])
    assert {tuple(r) for r in M.source_levels(both, (4, 2)).collect()} == {("a", 4, 5, 5), ("a", 2, 3, 5), ("b", 2, 4, 4)}
    assert "refinement_level" not in M.cf_grid_mapping(Grid(3, scheme="zuniq")) and M.cf_grid_mapping(Grid(3))["refinement_level"] == 3


def test_items(spark):
    a = {"type": "Feature", "properties": {"x": 1, "y": 2, 'q"\\': [None]}, "links": [{"rel": "a"}, {"rel": "b"}], "assets": {}, "id": "p", "bbox": []}
    b = a | {"properties": {"x": 1, "y": 3, 'q"\\': [None]}, "links": [{"rel": "b"}, {"rel": "c"}]}
    merge = lambda docs, how=None, at="s3://x/my data.zarr": json.loads(M.merge_items(M.items(spark, docs), at, (0, 1, 2, 3), how).first()["json"])
    out = merge([a, b], {"properties": "join_inner", "links": "join_outer"})
    assert out["id"] == "my_data" and out["bbox"] == [0, 1, 2, 3] and out["geometry"]["coordinates"][0][2] == [2, 3] and out["type"] == "Feature"
    assert out["properties"] == {"x": 1, 'q"\\': [None]} and [l["rel"] for l in out["links"]] == ["a", "b", "c"] and out["assets"] == {}
    assert merge([a, b], {"links": "join_inner"})["links"] == [{"rel": "b"}] and merge([b, a])["properties"]["y"] == 3
    for how in ("pick_first", "join_inner", "join_outer"):
        assert merge([a], dict.fromkeys(("links", "properties"), how))["links"] == a["links"]
    for bad in ([a, b | {"type": "Other"}], []):
        with pytest.raises(ValueError):
            merge(bad)
    table = spark.createDataFrame([("v", "valid_min", "0"), ("v", "a", "1"), ("v", "b", "2"), ("w", "valid_min", "0"), ("u", None, None)], "variable string, name string, value string")
    got = {tuple(r) for r in M.attributes(table, {"v": ["a"]}, {".*": {"b": "3"}, "w": {"b": "5"}}, {"c": "4"}, packed=["v"]).collect()}
    assert got == {("v", "b", "3"), ("v", "c", "4"), ("w", "valid_min", "0"), ("w", "b", "5"), ("w", "c", "4"), ("u", "b", "3"), ("u", "c", "4")}
    assert M.same({"a": [float("nan")]}, {"a": [float("nan")]}) and not M.same({"a": 1}, {"a": 1.0})
    row = spark.range(1).select(
        M.edited(M.F.array(M.F.lit('{"rel":"self"}'), M.F.lit('{"rel":"x"}')), "rel", ["self"], ['{"rel":"y"}']).alias("l"), M.without(M.F.create_map(*map(M.F.lit, ("ab", "1", "c", "2"))), ["a."], {"c": "3"}).alias("m")
    ).first()
    assert row["l"] == ['{"rel":"x"}', '{"rel":"y"}'] and row["m"] == {"c": "3"}


def test_consolidation(spark):
    docs = spark.createDataFrame([("", "{}"), ("a", "{}"), ("a/b", "{}")], "path string, json string")
    got = {r["root"]: set(r["documents"]) for r in M.consolidate(docs, ["a"]).collect()}
    assert got == {"": {"", "a", "a/b"}, "a": {"a", "a/b"}}
    with pytest.raises(RuntimeError):
        M.consolidate(docs.filter("path <> 'a'"), ["a"])


def test_sources():
    assert grids.select_groups(["a/b", "a/c", "d"], "a/*", ["a/c"]) == ["a/b"]
    with pytest.raises(KeyError):
        grids.select_groups(["a"], ["b"])
    with pytest.raises(ValueError):
        grids.check_isomorphic([["a"], ["b"]])
    assert grids.find_crs({"proj:code": "EPSG:32631"}) == 32631 and grids.find_crs({}) == 4326
    with pytest.raises(ValueError):
        grids.find_crs({"proj:epsg": 1, "proj:code": "EPSG:2"})


def test_whole_conversion_and_single_chunks(spark, tmp_path):
    pts = spark.range(3000).selectExpr("id as point_idx", "(id * 7919 % 36000) / 100e0 - 180 as lon", "degrees(asin((id * 1501 % 3000) / 1500e0 - 1)) as lat", "cast(id % 97 as double) as v", "cast(id % 5 as int) as k")
    pts.write.parquet(f"{tmp_path}/in/m/4")
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(f"{tmp_path}/in/tables")
    s = Settings({"m/4": Group(Grid(4, "sphere"), Chunks("dense", 1, buffer=500_000.0), Resampler("nearest"))}, {"m": Pyramid((3, 2), {"v": "mean", "k": "mode"})}, copies=("tables",), consolidate=("m",))
    out = f"{tmp_path}/out"
    assert G.run(spark, [f"{tmp_path}/in"], s, ["m/4", "tables"], f"{tmp_path}/dry", dry_run=True).keys() >= {"", "m", "m/4"}
    assert not (tmp_path / "dry").exists()
    G.run(spark, [f"{tmp_path}/in"], s, ["m/4", "tables"], out)
    whole = sinks.read_cells(spark, f"{out}/m/4")
    assert whole.count() == 3072 and dict(whole.dtypes)["k"] == "int"
    assert spark.read.parquet(f"{out}/m/2").count() == 192 and spark.read.parquet(f"{out}/tables").count() == 1
    p = G.Plan.from_json(G.plan([f"{tmp_path}/in"], s, ["m/4", "tables"]).to_json())
    assert p.groups == ("m/4",)
    part = G.convert_group(spark, p, "m/4", [3, 7])
    want = whole.filter("chunk_id in (3, 7)").select(part.columns)
    assert part.count() == 128 and part.withColumn("chunk_id", part.chunk_id.cast("int")).exceptAll(want).count() == 0
    assert sinks.read_cells(spark, f"{out}/m/4", [3]).count() == 64
    with pytest.raises(IndexError):
        G.convert_group(spark, p, "m/4", [48])
    assert {r["root"] for r in spark.read.parquet(f"{out}/_consolidated").collect()} == {"", "m"}


RESAMPLERS = [("nearest", {}, "dense"), ("k-nearest", {"k": 3}, "dense"), ("bilinear", {}, "dense"), ("grid-bilinear", {}, "dense"), ("nn", {}, "dense"), ("psf", {"max_iter": 400, "tol": 1e-12}, "dense"), ("cell-point", {}, "sparse")]


@pytest.mark.parametrize("method,params,kind,axes", [(*r, False) for r in RESAMPLERS] + [(*RESAMPLERS[k], True) for k in (2, 3, 5)], ids=[*(f"{r[0]}-points" for r in RESAMPLERS), "bilinear-axes", "grid-bilinear-axes", "psf-axes"])
def test_some_chunks_come_out_as_among_all(spark, tmp_path, method, params, kind, axes):
    """At the default buffer, which is far narrower than the grid; chunks at a pole and across the antimeridian too."""
    tag = lambda c, n: G.F.col(c).alias(c, metadata={"axis": n, "standard_name": {"lon": "longitude", "lat": "latitude"}[c]} if axes else {})
    nodes = spark.range(46 * 90).selectExpr("id as point_idx", "(id % 90) * 4e0 + 0.7 as lon", "89.1 - (id div 90) * 4e0 + (id div 90) % 3 as lat").filter("lat >= -90")
    nodes = nodes.selectExpr("*", "cast(point_idx * 7919 % 1009 as double) + lat as v").select("point_idx", tag("lon", "X"), tag("lat", "Y"), "v")
    nodes.filter("lat > -30").write.parquet(f"{tmp_path}/a/g")
    nodes.filter("lat <= -30 or point_idx % 90 < 40").write.parquet(f"{tmp_path}/b/g")
    chunks = Chunks("sparse", 2, chunk_size=4**20) if kind == "sparse" else Chunks("dense", 2)
    s = Settings({"g": Group(Grid(29 if kind == "sparse" else 4), chunks, Resampler(method, params))})
    p = G.plan([f"{tmp_path}/a", f"{tmp_path}/b"], s, ["g"])
    some = [0, 15, 77, 101, 130, 180]
    rows = lambda df: {r["cell_id"]: r["v"] for r in df.collect()}
    part = rows(G.convert_group(spark, p, "g", some))
    whole = rows(G.convert_group(spark, p, "g").filter(G.F.col("chunk_id").isin(some)))
    assert part.keys() == whole.keys() and len(part) > 20
    for cell, v in whole.items():
        assert part[cell] == v or v != v and part[cell] != part[cell] or abs(part[cell] - v) < (1e-4 if method == "psf" else 1e-9), (cell, v, part[cell])


def test_run_over_a_region_with_labels(spark, tmp_path, caplog):
    """The output follows the inputs across the antimeridian, dimensions stay in pyramids, lost variables are named."""
    pts = spark.range(900).selectExpr("id as point_idx", "pmod(172 + (id % 30) * 0.5 + 180, 360) - 180 as lon", "-7 + (id div 30) * 0.5e0 as lat", "explode(array('p', 'q')) as t")
    pts.selectExpr("*", "lat + case when t = 'p' then 100 else 0 end as v").write.parquet(f"{tmp_path}/in/m/6")
    g = Group(Grid(6, "sphere"), Chunks("dense", 4), Resampler("nearest"), extra=(ExtraDimension("t"),))
    s = Settings({"m/6": g}, {"m": Pyramid((5,), "max")})
    p = G.of_inputs(spark, G.plan([f"{tmp_path}/in"], s, ["m/6"]))
    assert p.extent[0] == pytest.approx(172, abs=1) and p.extent[2] == pytest.approx(186.5, abs=1) and G.Plan.from_json(p.to_json()) == p
    G.run(spark, [f"{tmp_path}/in"], s, ["m/6"], f"{tmp_path}/out", extent="inputs")
    whole = sinks.read_cells(spark, f"{tmp_path}/out/m/6")
    assert 0 < whole.select("chunk_id").distinct().count() < 48 and whole.filter("t = 'p'").count() * 2 == whole.count()
    made = spark.read.parquet(f"{tmp_path}/out/m/5")
    want = whole.groupBy(G.F.expr("cell_id >> 2").alias("cell_id"), "t").agg(G.F.max("v").alias("v"))
    assert made.select("cell_id", "t", "v").exceptAll(want).count() == 0 and made.count() == whole.count() / 4 and not caplog.records
    lost = Settings({"m/6": Group(Grid(6, "sphere"), Chunks("dense", 4), Resampler("bilinear", {"threshold": 2.0}), extra=(ExtraDimension("t"),))})
    triangle = {"type": "Polygon", "coordinates": [[[172, -7], [180, -7], [176, 3], [172, -7]]]}
    with caplog.at_level("WARNING"):
        G.run(spark, [f"{tmp_path}/in"], lost, ["m/6"], f"{tmp_path}/lost", extent=triangle)
    assert [r.args for r in caplog.records] == [("v", "m/6")]
    assert 0 < sinks.read_cells(spark, f"{tmp_path}/lost/m/6").select("chunk_id").distinct().count() < whole.select("chunk_id").distinct().count()


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).selectExpr("timestamp '2024-01-01' + make_interval(0,0,0,0,0,id) as ts", "id * 1.8 - 180 as lon", "id * 0.5 - 50 as lat", "cast(id as double) as v")
    rows.write.parquet(f"{tmp_path}/s")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/s")
    q = cell_windows(stream, 1, "v").writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cells").exceptAll(cell_windows(rows, 1, "v")).count() == 0 and spark.table("cells").count() >= 10


def test_products(spark):
    assert ensemble_times(spark, ["00:00", "01:00", "03:00"]) == ["00:00", "03:00"] and variables(spark).filter("`group` = 'measurements/aod'").count() == 6
    with pytest.raises(ValueError):
        ensemble_times(spark, ["01:00"])
    s = Settings({"measurements/aod": Group(Grid(3), Chunks("dense", 1, buffer=0.0), Resampler("psf", {"threshold": 0.01, "lam": 5.0}))})
    pts = spark.range(4000).selectExpr("0 as input_id", "id as point_idx", "'aod550' as variable", "'2024-01-01' as time", "(id * 7919 % 36000) / 100e0 - 180 as lon", "degrees(asin((id * 1501 % 4000) / 2000e0 - 1)) as lat", "abs(sin(id)) as value")
    for method in ("psf", "nn"):
        out = field_maps(pts, "measurements/aod", s, method)
        assert out.count() == 768 and out.filter("isnan(value) or value < 0 or value > 1").count() == 0
    assert field_maps(pts, "measurements/aod", s, chunk_indices=[3]).count() == 16
    with pytest.raises(IndexError):
        field_maps(pts, "measurements/aod", s, chunk_indices=[48])


def test_regrid_between_ellipsoids(spark):
    from cellwright.functions import cells as C

    level = 5
    sphere = C.with_center(C.whole_sphere(spark, level), level).selectExpr("cell_id", "case when lat > -60 then lat * 10 end as v")
    got = C.with_center(sphere_to_ellipsoid(sphere, level, "v", n_cells=9, lam=1e-3), level, C.WGS84).filter("abs(lat) between 40 and 50")
    plain = C.with_center(sphere, level, C.WGS84).filter("abs(lat) between 40 and 50")
    error = lambda df: df.selectExpr("avg(abs(v - lat * 10)) as e").first()["e"]
    assert error(got) < 0.5 * error(plain) and error(plain) > 0.5
    with pytest.raises(NotImplementedError):
        sphere_to_ellipsoid(sphere.withColumn("depth", C.F.lit(1)), level, "v")


def test_grid_bilinear_conversion_is_exact_on_planes(spark, tmp_path):
    """Bands, side-by-side tiles and a tile across the antimeridian, of a plane; a tile without values."""
    tile = lambda west, north, value="100 + 3 * lon - 2 * lat": spark.range(21 * 21).selectExpr("id as point_idx", f"{west} + (id % 21) * 0.05e0 as lon", f"{north} - (id div 21) * 0.05e0 as lat").selectExpr("*", f"cast({value} as double) as h")
    tiles = [tile(10, 1), tile(10, -0.3), tile(11, 1), tile(179.5, 1, "100 + 3 * lon - 2 * lat"), tile(20, 1, "double('NaN')")]
    for k, t in enumerate(tiles):
        t.write.parquet(f"{tmp_path}/in{k}/m/8")
    s = Settings({"m/8": Group(Grid(8, "sphere"), Chunks("dense", 3, buffer=30_000.0), Resampler("grid-bilinear"))})
    p = G.plan([f"{tmp_path}/in{k}" for k in range(len(tiles))], s, ["m/8"], extent=(9.0, -2.0, 22.0, 2.0))
    out = G.C.with_center(G.convert_group(spark, p, "m/8"), 8).filter("not isnan(h)")
    rows = out.collect()
    assert len(rows) > 50 and max(abs(r["h"] - (100 + 3 * r["lon"] - 2 * r["lat"])) for r in rows) < 1e-3
    where = lambda w, e, s, n: sum(w < r["lon"] < e and s < r["lat"] < n for r in rows)
    assert where(10, 11, -0.3, 0) > 0 and where(11, 12, 0, 1) > 5 and where(20, 21, 0, 1) == 0 and where(12.1, 19.9, -2, 2) == 0
    far = G.C.with_center(G.resample.grids_bilinear(tiles[3].withColumn("input_id", G.F.lit(0)), G.C.whole_sphere(spark, 7), 7, ["h"]), 7).filter("h is not null").collect()
    assert {r["lon"] < 0 for r in far} == {True, False} and max(abs(r["h"] - (100 + 3 * (r["lon"] % 360) - 2 * r["lat"])) for r in far) < 1e-3
    assert G.plan([f"{tmp_path}/in0"], predefined("dem-glo30"), ["dem/glo30"]).groups == ("dem/glo30",)


def test_only_changed_chunks_are_written(spark, tmp_path):
    path, schema = str(tmp_path / "cells"), "cell_id long, v double, name string"
    rows = [(i, float(i), "a") for i in range(64)]
    first = sinks.update_cells(spark.createDataFrame(rows, schema), path, 3, 1)
    assert sorted(map(tuple, first.collect())) == [(c, "added", 0, 16) for c in range(4)]
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "cells").glob("chunk_id=*/*.parquet")}
    had = files()
    assert sinks.update_cells(spark.createDataFrame(rows[::-1], schema).select("name", "cell_id", "v"), path, 3, 1).count() == 0 and files() == had
    # Chunk 0 as before, one value of 1 now null, 2 gone, 3 with a row twice, 4 new.
    new = rows[:17] + [(17, None, "a")] + rows[18:32] + rows[48:] + [rows[50]] + [(64, 1.0, None)]
    changes = sinks.update_cells(spark.createDataFrame(new, schema), path, 3, 1)
    assert sorted(map(tuple, changes.collect())) == [(1, "changed", 16, 16), (2, "gone", 16, 0), (3, "changed", 16, 17), (4, "added", 0, 1)]
    kept = {f: t for f, t in had.items() if "chunk_id=0" in str(f)}
    assert kept.items() <= files().items() and not (tmp_path / "cells/chunk_id=2").exists()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, sinks.read_cells(spark, path).select("cell_id", "v", "name").collect()), key=key) == sorted(new, key=key)
    # A null that moves to another column, and a column of another type, are changes.
    moved = spark.createDataFrame([(0, None, 1)], "cell_id long, a int, b int"), spark.createDataFrame([(0, 1, None)], "cell_id long, a int, b int")
    assert sinks.chunk_changes(*moved, 3, 1).count() == 1 and sinks.chunk_changes(moved[0], moved[0].withColumn("b", F.col("b").cast("long")), 3, 1).count() == 1
    assert sinks.chunk_changes(moved[0], moved[0].repartition(2), 3, None).count() == 0
    # An interrupted removal is made good, and an empty level removes all.
    assert sinks.update_cells(spark.createDataFrame([], schema), path, 3, 1).count() == 4 and not files()
    assert sinks.update_cells(spark.createDataFrame(rows[:1], schema), path, 3, 1).count() == 1
