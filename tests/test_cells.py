import math

import duckdb
import pytest

from cellwright.functions import cells as C


@pytest.mark.parametrize("ellipsoid", [C.SPHERE, C.WGS84], ids=lambda e: e.name)
@pytest.mark.parametrize("level", [0, 1, 4])
def test_centres_fall_in_their_cells(spark, level, ellipsoid):
    df = C.with_cell(C.with_center(C.whole_sphere(spark, level), level, ellipsoid), level, ellipsoid, out="back")
    assert df.filter("cell_id <> back").count() == 0 and df.count() == 12 * 4**level


def test_known_cells(spark):
    # Cell centres of level 0: four at 41.8103 north, four on the equator, four south.
    rows = C.with_center(C.whole_sphere(spark, 0), 0).orderBy("cell_id").collect()
    assert [round(r["lon"]) % 360 for r in rows] == [45, 135, 225, 315, 0, 90, 180, 270, 45, 135, 225, 315]
    assert [round(r["lat"], 4) for r in rows] == [41.8103] * 4 + [0.0] * 4 + [-41.8103] * 4


def test_parents_hold_their_children(spark):
    df = spark.range(20000).selectExpr("(id * 7919 % 360000) / 1000e0 - 180 + 0.00012 as lon", "asin((id * 15013 % 20000) / 10000e0 - 1) * 180 / pi() as lat")
    df = C.with_cell(C.with_cell(df, 9, out="fine"), 3, out="coarse")
    assert df.filter(f"{C.parent('fine', 6)} <> coarse").count() <= 2  # points on an edge


def test_ring_ids_run_along_latitudes(spark):
    rows = C.with_ring_id(C.with_center(C.whole_sphere(spark, 3), 3), 3).collect()
    order = sorted(rows, key=lambda r: (-round(r["lat"], 8), r["lon"] % 360))
    assert [r["ring_id"] for r in order] == list(range(768))


def test_neighbours_are_symmetric_and_near(spark):
    level = 3
    rows = C.with_vertices(C.with_neighbours(C.whole_sphere(spark, level), level), level).collect()
    near = {r["cell_id"]: [n for n in r["neighbours"] if n >= 0] for r in rows}
    corners = {r["cell_id"]: {(round(r[f"lat{k}"], 6), round(r[f"lon{k}"] % 360, 6) % 360 if abs(r[f"lat{k}"]) < 89.999 else 0.0) for k in range(4)} for r in rows}
    assert sum(len(v) == 7 for v in near.values()) == 24 and all(len(v) in (7, 8) for v in near.values())
    for c, others in near.items():
        assert all(c in near[n] for n in others)
        assert set(others) == {n for n in corners if n != c and corners[n] & corners[c]}


def test_sql_twin_gives_the_same(spark):
    steps = C.cell_steps("lon", "lat", 8, C.WGS84)
    src = "(select (i * 7919 % 360000) / 1000e0 - 180e0 as lon, (i * 15013 % 170000) / 1000e0 - 85e0 as lat from range(3000) r(i))"
    want = duckdb.sql(f"select cell_id from {C.steps_sql(src, steps, ['cell_id'])} order by lon, lat").fetchall()
    df = spark.range(3000).selectExpr("(id * 7919 % 360000) / 1000e0 - 180e0 as lon", "(id * 15013 % 170000) / 1000e0 - 85e0 as lat")
    assert [r[0] for r in C.with_cell(df, 8, C.WGS84).orderBy("lon", "lat").select("cell_id").collect()] == [r[0] for r in want]


def test_ring_levels_and_resolutions():
    assert [C.ring_level(b) for b in (60, 900, 1500, 3000, 10000, 5e6, 1e8)] == [16, 12, 11, 10, 8, 0, 0]
    assert C.resolution_level(C.RADIUS * math.sqrt(math.pi / 3) / 2**7) == 7
    with pytest.raises(ValueError):
        C.check_level(30)


def test_children_parents_and_chunk_ring(spark):
    kids = C.children(spark.createDataFrame([(100,)], "cell_id long"), 2)
    assert sorted(r["child_id"] for r in kids.collect()) == list(range(1600, 1616))
    assert C.where_parent(kids.select("child_id"), 100, 2, "child_id").count() == 16
    assert C.chunk_ring(spark, 6, 2, 3).count() == 16  # 4 cells and 12 around
    z = spark.sql(f"select {C.zuniq('cast(77 as bigint)', 4)} as z").selectExpr("z", f"{C.zuniq_level('z')} as l").first()
    assert z["l"] == 4 and ((z["z"] >> (2 * 25)) - 1) // 2 == 77


def test_functions_in_sql(spark):
    from cellwright.functions import sql

    assert {"cell_children", "cell_parent"} <= set(sql.register(spark))
    some = spark.range(0, 768, 7).withColumnRenamed("id", "cell_id")
    some.createOrReplaceTempView("some_cells")
    got, want = spark.sql("select cell_id, child_id from some_cells, lateral cell_children(cell_id, 2)"), C.children(some, 2)
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    assert spark.sql("select * from some_cells, lateral cell_children(cell_id, 2) where cell_parent(child_id, 2) <> cell_id").count() == 0
    z = spark.sql("select zuniq_level(cell_zuniq(cell_id, 3)) as level, zuniq_cell(cell_zuniq(cell_id, 3)) as cell, cell_id from some_cells")
    assert z.filter("level <> 3 or cell <> cell_id").count() == 0
    assert spark.sql("select cell_resolution(100000D)").first()[0] == C.resolution_level(100000)
    assert spark.sql("select * from cell_children(null, 1)").count() == 0 and spark.sql("select cell_parent(null, 1)").first()[0] is None
    # In place of its call: no Python, no join.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan
