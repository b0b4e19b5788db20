import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwright.functions import cells as C
from cellwright.operators import psf as Q
from cellwright.operators import resample as R


def make(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(0, i, float(lo), float(la), float(v), int(v)) for i, (lo, la, v) in enumerate(zip(rng.uniform(-180, 180, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(0, 100, n)))]
    return spark.createDataFrame(rows, "input_id int, point_idx long, lon double, lat double, v double, k int")


def xyz(lon, lat, e=C.SPHERE):
    lam, phi = np.radians(lon), np.radians(lat)
    n = e.a / np.sqrt(1 - e.e2 * np.sin(phi) ** 2)
    return np.stack([n * np.cos(phi) * np.cos(lam), n * np.cos(phi) * np.sin(lam), n * (1 - e.e2) * np.sin(phi)], axis=-1)


@pytest.mark.parametrize("ellipsoid", [C.SPHERE, C.WGS84], ids=lambda e: e.name)
def test_neighbours_match_brute_force(spark, ellipsoid):
    pts, level, k = make(spark), 2, 3
    got = {}
    for r in R.neighbours(pts, C.whole_sphere(spark, level), level, k, ellipsoid, start=1).collect():
        got.setdefault(r["cell_id"], {})[r["rank"]] = r["point_idx"]
    p = pts.orderBy("point_idx").toPandas()
    c = C.with_center(C.whole_sphere(spark, level), level, ellipsoid).orderBy("cell_id").toPandas()
    d = np.linalg.norm(xyz(c["lon"], c["lat"], ellipsoid)[:, None] - xyz(p["lon"], p["lat"], ellipsoid)[None], axis=2)
    want = np.argsort(d, axis=1, kind="stable")[:, :k]
    assert len(got) == 192 and all([got[i][r + 1] for r in range(k)] == want[i].tolist() for i in range(192))


@pytest.mark.parametrize("k", [1, 4])
def test_neighbours_of_clustered_points(spark, k):
    """A dense cluster, a pile at one place, some points far from all, and targets on the whole globe."""
    rng = np.random.default_rng(3)
    lon = np.concatenate([rng.normal(10.0, 0.05, 1500), np.full(400, 10.5), rng.uniform(-180, 180, 12)])
    lat = np.concatenate([rng.normal(45.0, 0.05, 1500), np.full(400, 45.25), rng.uniform(-80, 80, 12)])
    pts = spark.createDataFrame([(i % 2, i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat))], "input_id int, point_idx long, lon double, lat double")
    level = 3
    c = C.with_center(C.whole_sphere(spark, level), level).orderBy("cell_id").toPandas()
    got = R.neighbours(pts, C.whole_sphere(spark, level), level, k).toPandas().sort_values(["cell_id", "rank"])
    d = np.linalg.norm(xyz(c["lon"], c["lat"])[:, None] - xyz(lon, lat)[None], axis=2)
    assert len(got) == 768 * k and not got.duplicated(["cell_id", "input_id", "point_idx"]).any()
    want = np.sort(d, axis=1)[:, :k].ravel()
    assert np.abs(got["distance"].to_numpy() - want).max() < 1e-3
    assert np.abs(d[got["cell_id"], got["point_idx"]] - want).max() < 1e-3


def test_neighbours_of_nothing(spark):
    none = spark.createDataFrame([], "input_id int, point_idx long, lon double, lat double")
    assert R.neighbours(none, C.whole_sphere(spark, 1), 1, 2).count() == 0
    assert R.neighbours(make(spark, 5), C.whole_sphere(spark, 1).limit(0), 1, 2).count() == 0


def test_nearest_keeps_types_and_few_points_reach_everywhere(spark):
    pts = make(spark, 2)
    out = R.nearest(pts, C.whole_sphere(spark, 1), 1, ["k", "v"])
    assert dict(out.dtypes) == {"cell_id": "bigint", "k": "int", "v": "double"} and out.count() == 48


def test_constant_stays_constant(spark):
    pts = make(spark).withColumn("v", F.lit(0.25))
    near = R.inverse_distance(pts, C.whole_sphere(spark, 2), 2, ["v"], threshold=0.5)
    assert near.count() == 192 and near.filter("abs(v - 0.25) > 1e-6").count() == 0
    filled = R.fill_gaps(R.bin_mean(pts, 2, ["v"]), 2, "v")
    assert filled.count() == 192 and filled.filter("v is not null and v <> 0.25").count() == 0


def test_gap_filling_in_order(spark):
    level = 2
    have = {i: float(i % 7) for i in range(192) if i % 5 == 0 or i > 150}
    binned = spark.createDataFrame(list(have.items()), "cell_id long, v float")
    near = {r["cell_id"]: [n for n in r["neighbours"] if n >= 0] for r in C.with_neighbours(C.whole_sphere(spark, level), level).collect()}
    want = dict(have)
    for c in range(192):
        if c not in have:
            vs = [want[n] for n in near[c] if n in want]
            if vs:
                want[c] = float(np.float32(np.mean(np.array(vs, dtype=np.float32), dtype=np.float64)))
    got = {r["cell_id"]: r["v"] for r in R.fill_gaps(binned, level, "v", exact=True).collect()}
    assert len(got) == 192 and all(got[c] == pytest.approx(want.get(c), rel=1e-5) for c in got)
    # The same with blocks of four cells, which wait for each other.
    around = C.with_neighbours(C.whole_sphere(spark, level).join(binned, "cell_id", "left_anti"), level).select("cell_id", F.explode("neighbours").alias("near"))
    small = {r["cell_id"]: r["v"] for r in R.fill_in_order(binned, around, "v", levels=1).collect()}
    assert small == {c: v for c, v in got.items() if c not in have and v is not None}
    whole = C.with_neighbours(C.whole_sphere(spark, 1), 1).select("cell_id", F.explode("neighbours").alias("near"))
    assert R.fill_gaps(C.whole_sphere(spark, 1).selectExpr("cell_id", "cast(1 as float) as v"), 1, "v", exact=True).filter("v = 1").count() == 48
    assert R.fill_in_order(binned.limit(0), whole, "v").count() == 0


def grid(spark, lons, lats, f):
    lon = spark.createDataFrame(list(enumerate(map(float, lons))), "i int, lon double")
    lat = spark.createDataFrame(list(enumerate(map(float, lats))), "j int, lat double")
    nodes = spark.createDataFrame([(i, j, float(f(x, y))) for i, x in enumerate(lons) for j, y in enumerate(lats)], "i int, j int, h double")
    return nodes, lon, lat


@pytest.mark.parametrize("lons", [np.arange(-30, 31), np.arange(30, -31, -1), np.arange(330, 391)])
def test_planes_are_exact(spark, lons):
    wrap = lambda x: (x + 180) % 360 - 180
    nodes, lon, lat = grid(spark, lons, np.arange(-20, 21), lambda x, y: 100 + 3 * wrap(x) - 2 * y)
    out = R.grid_bilinear(nodes, lon, lat, C.whole_sphere(spark, 4), 4, ["h"])
    got = C.with_center(out, 4).withColumn("d", F.abs(F.col("h") - (100 + 3 * F.col("lon") - 2 * F.col("lat")))).toPandas()
    inside = C.with_center(C.whole_sphere(spark, 4), 4).filter("abs(lon) <= 30 and abs(lat) <= 20").count()
    assert len(got) == inside and got["d"].max() < 1e-4


def test_grid_goes_round_and_weights_count(spark):
    nodes, lon, lat = grid(spark, np.arange(0, 360, 2), np.arange(-90, 91, 2), lambda x, y: 5 * math.sin(math.radians(y)) if y < 30 else float("nan"))
    out = R.grid_bilinear(nodes, lon, lat, C.whole_sphere(spark, 3), 3, ["h"])
    got = C.with_center(out, 3).toPandas()
    assert len(got) == 768 and got["h"][got["lat"] > 31].isna().all() and got["h"][got["lat"] < 28].notna().all()


@pytest.mark.parametrize("lons,lats", [(np.arange(-180, 180, 4), np.arange(-88, 89, 4)), (np.arange(350, 10, -5), np.arange(60, -61, -3)), (np.arange(100, 141, 2.5), np.arange(-10, 31, 2))])
def test_regular_axes_give_what_a_search_gives(spark, monkeypatch, lons, lats):
    nodes, lon, lat = grid(spark, lons, lats, lambda x, y: (x * 7 + y * 13) % 50 if (x + 3 * y) % 7 else float("nan"))
    run = lambda: {r["cell_id"]: r["h"] for r in R.grid_bilinear(nodes, lon, lat, C.whole_sphere(spark, 4), 4, ["h"]).collect()}
    assert R._regular(lon, "i", "lon") is not None
    got = run()
    monkeypatch.setattr(R, "SENT_MESHES", 0)
    assert run() == got
    monkeypatch.setattr(R, "_regular", lambda *a: None)
    want = run()
    assert got.keys() == want.keys() and len(got) > 50
    assert all(got[c] is None and v is None or abs(got[c] - v) < 1e-9 for c, v in want.items())


def test_mean_of_layers(spark):
    a = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "cell_id long, v double")
    b = spark.createDataFrame([(1, 4.0), (2, None)], "cell_id long, v double")
    assert {r["cell_id"]: r["v"] for r in R.layer_mean([a, b], ["v"]).collect()} == {1: 3.0, 2: None}


def test_cell_point_keeps_first_and_dense_fills(spark):
    pts = spark.createDataFrame([(0, 1, 10.0, 20.0, 7), (0, 0, 10.0, 20.0, 8), (0, 2, -50.0, 1.0, 9)], "input_id int, point_idx long, lon double, lat double, k int")
    assert sorted(r["k"] for r in R.cell_point(pts, ["k"]).collect()) == [8, 9]
    with pytest.raises(ValueError):
        R.cell_point(pts, ["k"], level=5)
    some = spark.createDataFrame([(3, 1.0, 2)], "cell_id long, f double, n int")
    row = R.dense(some, C.whole_sphere(spark, 0)).filter("cell_id = 0").first()
    assert math.isnan(row["f"]) and row["n"] == 0
    with pytest.raises(ValueError):
        R.check_chunk_size(C.whole_sphere(spark, 2), 2, 0, 15)


def test_psf_reproduces_smooth_fields(spark):
    pts = make(spark, 4000, 3)
    flat = Q.psf(pts.withColumn("v", F.lit(7.0)), 3, 1, "v")
    assert flat.filter("abs(v - 7) > 1e-6").count() == 0 and flat.count() > 700
    wave = pts.withColumn("v", F.sin(F.radians("lat")) * 10)
    got = C.with_center(Q.psf(wave, 3, 1, "v", lam=0.01), 3).toPandas()
    assert np.corrcoef(got["v"], np.sin(np.radians(got["lat"])))[0, 1] > 0.98


def test_masks_parameters_and_lost_data(spark):
    pts = make(spark, 20).withColumns({"a": F.when(F.col("point_idx") > 3, F.col("v")), "b": F.when(F.col("point_idx") > 3, F.lit(1.0)), "c": F.col("v")})
    groups = {}
    for r in R.masks(pts, ["a", "b", "c"]).collect():
        groups.setdefault(r["mask"], []).append(r["variable"])
    assert sorted(map(sorted, groups.values())) == [["a", "b"], ["c"]] and R.masks(pts, ["a", "b", "c"]).filter("first").count() == 2
    assert R.per_variable(2.0, ["a"]) == {"a": 2.0}
    with pytest.raises(ValueError):
        R.per_variable({"a": 1.0}, ["a", "b"])
    assert R.lost_variables(pts, pts.withColumn("c", F.lit(None).cast("double")), ["b", "c"]) == ["c"]
    assert {r["v"] for r in R.clip_at_zero(spark.createDataFrame([(1, -2.0), (2, None)], "cell_id long, v double"), "v").collect()} == {0.0, None}


def labelled(spark, n=500):
    pts = make(spark, n, 5).drop("k").withColumn("t", F.explode(F.array(F.lit("p"), F.lit("q"), F.lit(None).cast("string"))))
    return pts.selectExpr("*", "v + case when t = 'p' then lat else 1 end as a", "case when point_idx % 5 <> 0 then cos(lat) end as b", "case when t = 'q' and lat > 0 then lon else double('NaN') end as c").drop("v")


def test_fields_that_share_masks_are_those_one_by_one(spark):
    pts = labelled(spark)
    rows = R.masked_maps(pts, C.whole_sphere(spark, 2), 2, ["a", "b", "c"], 3, by=("t",)).collect()
    got = {(r["t"], r["variable"], r["cell_id"]): r["value"] for r in rows}
    assert len(got) == len(rows) == 192 * 7  # c has values at one label
    for t, v in (("p", "a"), ("q", "b"), (None, "b"), ("q", "c")):
        own = pts.filter(F.col("t").eqNullSafe(t) & F.col(v).isNotNull() & ~F.isnan(v))
        for r in R.inverse_distance(own, C.whole_sphere(spark, 2), 2, [v], 3).collect():
            assert abs(got[t, v, r["cell_id"]] - r[v]) < 1e-9


def test_psf_of_many_fields_is_that_one_by_one(spark):
    pts, done = labelled(spark, 900), {"max_iter": 2000, "tol": 1e-12, "lam": 0.1}
    got = Q.psf_batch(pts, 3, 1, ["a", "b", "c"], ("t",), **done).toPandas()
    assert not got.duplicated(["cell_id", "t"]).any()
    for t, v in (("p", "a"), ("q", "b"), (None, "a"), ("q", "c")):
        want = Q.psf(pts.filter(F.col("t").eqNullSafe(t)), 3, 1, v, **done).toPandas().set_index("cell_id")[v]
        mine = got[got["t"].isna() if t is None else got["t"] == t].set_index("cell_id")[v].dropna()
        assert set(mine.index) == set(want.index) and (mine - want).abs().max() < 1e-6
    assert got[got["t"] == "p"]["c"].isna().all()
    none = Q.psf_batch(pts.limit(0), 3, 1, ["a"], ("t",))
    assert none.count() == 0 and none.columns == ["cell_id", "t", "a"]


def test_gaps_by_label(spark):
    pts = labelled(spark, 300)
    got = R.fill_gaps(R.bin_mean(pts, 3, ["a"], by=("t",)), 3, "a", by=("t",)).toPandas()
    assert len(got) == 3 * 768
    for t in ("p", None):
        want = R.fill_gaps(R.bin_mean(pts.filter(F.col("t").eqNullSafe(t)), 3, ["a"]), 3, "a").toPandas().set_index("cell_id")["a"]
        mine = got[got["t"].isna() if t is None else got["t"] == t].set_index("cell_id")["a"]
        mine, want = mine.sort_index(), want.sort_index()
        assert len(mine) == 768 and (mine.isna() == want.isna()).all() and (mine - want).abs().max() < 1e-4


def test_psf_gives_a_task_only_sums_per_cell(spark):
    pts = make(spark, 400, 3)
    many = pts.crossJoin(spark.range(4).select())
    to_the_end = {"max_iter": 5000, "tol": 1e-13}
    one, four = Q.psf(pts, 3, 1, "v", lam=0.01, **to_the_end), Q.psf(many, 3, 1, "v", lam=0.04, threshold=0.04, **to_the_end)
    a, b = ({r["cell_id"]: r["v"] for r in x.collect()} for x in (one, four))
    assert a.keys() == b.keys() and len(a) > 100 and all(abs(a[c] - b[c]) < 1e-5 for c in a)

    def into_solver(df):
        node = df._jdf.queryExecution().analyzed()
        while node.getClass().getSimpleName() != "FlatMapGroupsInPandas":
            node = node.children().head()
        return spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node.children().head()).count()

    assert into_solver(one) == into_solver(four) > 0


def test_psf_solves_each_chunk_as_dense_least_squares_does():
    rng = np.random.default_rng(5)
    full = rng.random((60, 12)) * (rng.random((60, 12)) < 0.4) + np.eye(60, 12) + 1e-3
    full /= full.sum(axis=1, keepdims=True)
    d = rng.random(60) + 100
    i, j = np.triu_indices(12)
    got = Q._solve(i, j, (full.T @ full)[i, j], full.T @ d, full.sum(axis=0), 12, 0.1, 200, 1e-12)
    want = np.linalg.solve(full.T @ full + 0.1 * np.eye(12), full.T @ (d - d.mean())) + d.mean()
    assert np.allclose(got, want, atol=1e-8)


@pytest.mark.parametrize("ellipsoid", [C.SPHERE, C.WGS84])
@pytest.mark.parametrize("level", [0, 1, 3, 17])
def test_cells_in_numpy_are_those_of_the_columns(spark, level, ellipsoid):
    first = 0 if level < 5 else 7 * 4**level // 3
    ids = spark.range(first, first + min(2000, 12 * 4**level)).withColumnRenamed("id", "cell_id")
    rows = C.with_center(C.with_neighbours(ids, level), level, ellipsoid).withColumns(R.ecef("lon", "lat", ellipsoid)).toPandas()
    cells = rows["cell_id"].to_numpy()
    assert (Q.around(cells, level)[:, 1:] == np.stack(rows["neighbours"])).all()
    assert np.abs(Q.centres(cells, level, ellipsoid) - rows[["x", "y", "z"]].to_numpy()).max() < 1e-3


def test_psf_is_the_least_squares_solution(spark):
    """Normal equations of a small case, written down point by point for each chunk and solved densely."""
    level, lam = 2, 1e-2
    pts = spark.range(900).selectExpr("(id * 7919 % 3600) / 10e0 - 180 as lon", "degrees(asin((id * 151 % 900) / 450e0 - 0.999)) as lat", "cast(cast(sin(id) as float) as double) as d")
    rows = C.with_cell(pts, level).toPandas()
    links = []
    for r in rows.to_dict("records"):
        cells = np.unique(Q.around(np.array([r["cell_id"]]), level))
        cells = cells[cells >= 0]
        _, used, w, _ = Q._links(np.array([r["lon"]]), np.array([r["lat"]]), cells, np.zeros(len(cells), int), level, 9, C.SPHERE)
        links.append((r["d"], set(cells >> 4), used, w))
        assert abs(w.sum() - 1) < 1e-12
    got = {r["cell_id"]: r["d"] for r in Q.psf(pts, level, 0, "d", lam=lam, max_iter=2000, tol=1e-13).collect()}
    assert len(got) == 192
    for chunk in range(12):
        mine = [x for x in links if chunk in x[1]]
        a = np.zeros((len(mine), 192))
        for k, (_, _, used, w) in enumerate(mine):
            a[k, used] = w
        d = np.array([x[0] for x in mine])
        want = np.linalg.solve(a.T @ a + lam * np.eye(192), a.T @ (d - d.mean())) + d.mean()
        assert np.abs([got[c] - want[c] for c in range(16 * chunk, 16 * chunk + 16)]).max() < 1e-6


@pytest.mark.parametrize("level,n_cells,ellipsoid", [(0, 9, C.SPHERE), (2, 4, C.SPHERE), (3, 9, C.WGS84), (12, 6, C.WGS84)])
def test_weights_are_those_of_points_one_by_one(level, n_cells, ellipsoid):
    rng = np.random.default_rng(level)
    cells = rng.integers(0, 12 * 4**level, 40)
    near = Q._near(cells, level)
    at = np.array([rng.choice(row[row >= 0]) for row in near])
    lat = rng.uniform(-0.3, 0.3, 40) * 60 / 2**level
    x, y, z = Q.centres(at, level, ellipsoid).T
    lon, lat = np.degrees(np.arctan2(y, x)) + rng.uniform(-20, 20, 40) / 2**level, np.clip(np.degrees(np.arctan2(z, np.hypot(x, y))) + lat, -90, 90)
    w, share = Q._weights(lon, lat, near, np.arange(40), level, n_cells, ellipsoid)
    place = Q._ecef(np.sin(np.radians(lat)), np.cos(np.radians(lat)), np.radians(lon), ellipsoid)
    for p in range(40):
        off = (Q.centres(near[p], level, ellipsoid) - place[p]) / (ellipsoid.a * np.sqrt(np.pi / 3) / 2**level)
        g = np.where(near[p] >= 0, np.exp(-2 * (off * off).sum(axis=1)), 0)
        g[np.lexsort((-near[p], -g))[n_cells:]] = 0
        second = (off * g[:, None]).T @ off
        fixed = g * (1 + off @ np.linalg.solve(second + np.eye(3) * 1e-6 * (1 + np.trace(second)), -(g @ off)))
        fixed = fixed if fixed.sum() > 0.05 * g.sum() else g
        assert np.allclose(w[:, p], fixed / fixed.sum(), rtol=0, atol=1e-7) and np.allclose(share[:, p], g / g.sum(), rtol=0, atol=1e-7)


def test_tables_of_cells_are_the_sums_over_points():
    rng = np.random.default_rng(1)
    n, level, v = 700, 1, 3
    code, cell = rng.integers(0, 3, n), rng.integers(0, 48, n)
    x, y, z = Q.centres(cell, level, C.SPHERE).T / C.SPHERE.a
    lon, lat = np.degrees(np.arctan2(y, x)) + rng.uniform(-5, 5, n), np.degrees(np.arcsin(z))
    d = np.where(rng.random((v, n)) < 0.7, rng.random((v, n)), np.nan)
    first = np.array([[True, False, True], [True, False, False], [False, False, True]])[:, code]
    parts = [Q._tables(code[s], cell[s], lon[s], lat[s], d[:, s], first[:, s], level, 9, C.SPHERE, True) for s in (slice(0, 300), slice(300, 301), slice(301, n))]
    equations, right = ({(o, b): t for o, b, t in zip(*Q._added([p[k] for p in parts if p[k] is not None]))} for k in (0, 1))
    w, share = Q._weights(lon, lat, Q._near(cell, level), np.arange(n), level, 9, C.SPHERE)
    want = {}, {}
    for p in range(n):
        of = want[1].setdefault((code[p], cell[p]), np.zeros((9, v)))
        of += np.outer(w[:, p], np.nan_to_num(d[:, p]))
        for k in range(v):
            if first[k, p] and not np.isnan(d[k, p]):
                of = want[0].setdefault((code[p] * v + k, cell[p]), np.zeros((9, 12)))
                of += np.column_stack([np.triu(np.outer(w[:, p], w[:, p])), w[:, p] * d[k, p], w[:, p], share[:, p]])
    for got, told in zip((equations, right), want):
        assert got.keys() == told.keys() and all(np.allclose(got[k], told[k], atol=1e-12) for k in told)


def test_psf_hands_on_tables_of_cells_not_of_points(spark):
    pts = C.with_cell(make(spark, 3000, 3), 2).withColumns({"code": F.col("point_idx") % 2, "d0": F.col("v"), "f0": F.lit(True)})

    def handed(df):
        made = Q.cell_sums(df.coalesce(1), 1, 2, 9, C.SPHERE, True)
        return spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, made._jdf.queryExecution().analyzed().children().head()).count()

    once, often = handed(pts), handed(pts.crossJoin(spark.range(20).select()))
    assert 0 < once == often <= 2 * 2 * 192 * 9


def test_psf_of_more_variables_than_a_table_has_columns(spark):
    pts = make(spark, 200, 3).withColumns({f"v{k}": F.col("v") * (k + 1) for k in range(14)})
    got = Q.psf_batch(pts, 1, 0, [f"v{k}" for k in range(14)], lam=0.1, max_iter=2000, tol=1e-13).toPandas()
    assert len(got) == 48 and all(np.allclose(got[f"v{k}"], got["v0"] * (k + 1), rtol=1e-5) for k in range(14))
