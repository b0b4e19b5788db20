"""The registered queries of the grid engine, and the same results as SQL.

There are no gridded tables among the inputs, so points, cells and grids are derived from the
tables there are: points from lineitem, whole levels of cells from the running order keys.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells as C
from ..functions import crs, projection, text
from ..operators import align, psf, pyramid, resample, select
from . import metadata, products

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LON = "((l_orderkey * 7919 + l_linenumber * 104729) % 360000) / 1000e0 - 180e0 + 0.000123e0"
LAT = "((l_partkey * 15013 + l_suppkey * 31) % 170000) / 1000e0 - 85e0 + 0.000321e0"
KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
POINTS = f"(select {KEYS}, {LON} as lon, {LAT} as lat, l_extendedprice as price, cast(l_quantity as int) as class, l_discount as discount from lineitem)"
#: The cells of LEVEL are numbered by the order keys, all of them (it has 201 million); orders
#: without a stated priority have no price. Prices are whole, so that sums are exact in any order.
LEVEL = 12
CELLS = "(select o_orderkey as cell_id, case when o_orderpriority <> '4-NOT SPECIFIED' then cast(floor(o_totalprice) as double) end as price, cast(floor(o_totalprice) as bigint) % 5 as class, cast(o_custkey % 128 as int) as flags from orders)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{LON} as lon", f"{LAT} as lat", "l_extendedprice as price", "cast(l_quantity as int) as class", "l_discount as discount")


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CELLS, with missing values as NaN, as a store would hold them."""
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey as cell_id", "case when o_orderpriority <> '4-NOT SPECIFIED' then cast(floor(o_totalprice) as double) else double('NaN') end as price", "cast(floor(o_totalprice) as bigint) % 5 as class", "cast(o_custkey % 128 as int) as flags")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point for each customer."""
    return read(spark, sf_dir, "customer").selectExpr("0 as input_id", "c_custkey as point_idx", "(c_custkey * 7919 % 36000) / 100e0 - 180e0 + 0.00123e0 as lon", "(c_custkey * 15013 % 17000) / 100e0 - 85e0 + 0.00321e0 as lat", "c_acctbal as balance", "cast(c_nationkey as int) as nation")


SITES = "(select c_custkey as point_idx, (c_custkey * 7919 % 36000) / 100e0 - 180e0 + 0.00123e0 as lon, (c_custkey * 15013 % 17000) / 100e0 - 85e0 + 0.00321e0 as lat, c_acctbal as balance, cast(c_nationkey as int) as nation from customer)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Geometry -------------------------------------------------------------------------------------


@query(f"select {KEYS}, lon, lat, cell_id from {C.steps_sql(POINTS, C.cell_steps('lon', 'lat', 8), ['cell_id'])} p")
def cell_assign(spark, sf_dir):
    return C.with_cell(points(spark, sf_dir), 8).selectExpr(*KEYS.split(", "), "lon", "lat", "cell_id")


@query(f"select {KEYS}, lon, lat, cell_id from {C.steps_sql(POINTS, C.cell_steps('lon', 'lat', 8, C.WGS84), ['cell_id'])} p")
def cell_assign_wgs84(spark, sf_dir):
    return C.with_cell(points(spark, sf_dir), 8, C.WGS84).selectExpr(*KEYS.split(", "), "lon", "lat", "cell_id")


@query(f"select cell_id, round(lon, 8) as lon, round(lat, 8) as lat from {C.steps_sql(CELLS, C.center_steps('cell_id', LEVEL), ['lon', 'lat'])} p")
def cell_center(spark, sf_dir):
    return C.with_center(order_cells(spark, sf_dir), LEVEL).select("cell_id", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


@query(f"select cell_id, round(lon, 8) as lon, round(lat, 8) as lat from {C.steps_sql(CELLS, C.center_steps('cell_id', LEVEL, C.WGS84), ['lon', 'lat'])} p")
def cell_center_wgs84(spark, sf_dir):
    return C.with_center(order_cells(spark, sf_dir), LEVEL, C.WGS84).select("cell_id", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


_V = [f"{c}{k}" for k in range(4) for c in ("lon", "lat")]


@query(f"select cell_id, {', '.join(f'round({v}, 8) as {v}' for v in _V)} from {C.steps_sql(CELLS, C.vertex_steps('cell_id', LEVEL), _V)} p")
def cell_vertices(spark, sf_dir):
    return C.with_vertices(order_cells(spark, sf_dir), LEVEL).select("cell_id", *[F.round(v, 8).alias(v) for v in _V])


@query(f"select cell_id, unnest(range(cell_id * 16, cell_id * 16 + 16)) as child_id from {CELLS} p")
def cell_children(spark, sf_dir):
    return C.children(order_cells(spark, sf_dir).select("cell_id"), 2)


@query(f"select cell_id >> 6 as ancestor, cell_id, unnest(range(cell_id * 4, cell_id * 4 + 4)) as child_id, (2 * cell_id + 1) << {58 - 2 * LEVEL} as zuniq from {CELLS} p")
def cells_in_sql(spark, sf_dir):
    """Cells by the functions of Spark SQL alone."""
    from ..functions import sql

    sql.register(spark)
    return spark.sql(f"select cell_parent(cell_id, 3) as ancestor, cell_id, child_id, cell_zuniq(cell_id, {LEVEL}) as zuniq from {{cells}}, lateral cell_children(cell_id, 1)", cells=order_cells(spark, sf_dir).select("cell_id"))


@query(f"select cell_id, cell_id >> 4 as parent_id from {CELLS} p")
def cell_parent(spark, sf_dir):
    return order_cells(spark, sf_dir).selectExpr("cell_id", f"{C.parent('cell_id', 2)} as parent_id")


_N = [f"n{k}" for k in range(8)]


@query(f"select cell_id, unnest([{', '.join(_N)}]) as neighbour_id, unnest(range(8)) as direction from {C.steps_sql(CELLS, C.neighbour_steps('cell_id', LEVEL), _N)} p")
def cell_neighbours(spark, sf_dir):
    return C.with_neighbours(order_cells(spark, sf_dir), LEVEL).select("cell_id", F.posexplode("neighbours").alias("direction", "neighbour_id")).selectExpr("cell_id", "neighbour_id", "cast(direction as bigint) as direction")


@query(f"select cell_id, ring_id from {C.steps_sql(CELLS, C.ring_steps('cell_id', LEVEL), ['ring_id'])} p")
def cell_ring_ids(spark, sf_dir):
    return C.with_ring_id(order_cells(spark, sf_dir), LEVEL).select("cell_id", "ring_id")


@query(f"select cell_id, (2 * cell_id + 1) << {58 - 2 * LEVEL} as zuniq, {LEVEL} as level from {CELLS} p")
def cell_zuniq(spark, sf_dir):
    return order_cells(spark, sf_dir).selectExpr("cell_id", f"{C.zuniq('cell_id', LEVEL)} as zuniq").selectExpr("cell_id", "zuniq", f"{C.zuniq_level('zuniq')} as level")


_NEAR = "(select unnest([cell_id, " + ", ".join(_N) + "]) as cell_id from " + C.steps_sql(f"(select distinct cell_id >> 4 as cell_id from {CELLS} o)", C.neighbour_steps("cell_id", LEVEL - 2), _N) + " p)"


@query(f"select distinct cell_id from {_NEAR} where cell_id >= 0")
def ring_selection(spark, sf_dir):
    """The parents of all orders' cells, and one ring around them."""
    parents = order_cells(spark, sf_dir).selectExpr(f"{C.parent('cell_id', 2)} as cell_id")
    return C.kth_ring(parents, LEVEL - 2)


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round_even(log2(6371000.0 * sqrt(pi() / 3) / l_extendedprice), 0) as int) as level, cast(floor(log2(6371000.0 * sqrt(pi() / 3) / l_extendedprice)) as int) as coarse from lineitem")
def resolution_level(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{C.resolution_level_sql('l_extendedprice')} as level", f"{C.resolution_level_sql('l_extendedprice', 'floor')} as coarse")


# Binning and pyramids -------------------------------------------------------------------------

_BIN4 = C.steps_sql(POINTS, C.cell_steps("lon", "lat", 4), ["cell_id"])


@query(f"select cell_id, cell_id >> 4 as parent_id, count(*) as n, cast(sum(cast(round(price * 100) as bigint)) as double) / (100e0 * count(*)) as price from {_BIN4} p group by 1, 2")
def bin_mean(spark, sf_dir):
    placed = C.with_cell(points(spark, sf_dir), 4).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.expr("cast(sum(cast(round(price * 100) as bigint)) as double) / (100e0 * count(1))").alias("price"))  # in whole cents: exact in any order
    return placed.selectExpr("cell_id", f"{C.parent('cell_id', 2)} as parent_id", "n", "price")


_BIN5 = f"(select cell_id, cast(avg(balance) as float) as balance from {C.steps_sql(SITES, C.cell_steps('lon', 'lat', 4, C.WGS84), ['cell_id'])} p group by 1)"
_NEAR4 = f"(select cell_id, unnest([{', '.join(_N)}]) as near from " + C.steps_sql("(select unnest(range(3072)) as cell_id)", C.neighbour_steps("cell_id", 4), _N) + " q)"


@query(f"with b as {_BIN5}, f as (select a.cell_id, avg(cast(b.balance as double)) as balance from {_NEAR4} a join b on a.near = b.cell_id where a.cell_id not in (select cell_id from b) group by 1) select cell_id, round(cast(balance as double), 2) as balance from b union all select g.i as cell_id, round(cast(cast(balance as float) as double), 2) as balance from range(3072) g(i) left join f on f.cell_id = g.i where g.i not in (select cell_id from b)")
def bin_mean_filled(spark, sf_dir):
    filled = resample.fill_gaps(resample.bin_mean(sites(spark, sf_dir), 4, ["balance"], C.WGS84), 4, "balance")
    return filled.select("cell_id", F.round(F.col("balance").cast("double"), 2).alias("balance"))


_BIN3 = f"(select cell_id, cast(avg(floor(price)) as float) as v from {C.steps_sql(POINTS, C.cell_steps('lon', 'lat', 3, C.WGS84), ['cell_id'])} p group by 1)"
_NEAR3 = f"(select cell_id, list_filter([{', '.join(_N)}], lambda x: x >= 0) as ns from " + C.steps_sql("(select unnest(range(768)) as cell_id)", C.neighbour_steps("cell_id", 3), _N) + " q)"


@query(f"with recursive b as {_BIN3}, near as {_NEAR3}, r(i, vals) as (select 0::bigint, list(b.v order by g.i) from range(768) g(i) left join b on b.cell_id = g.i union all select i + 1, case when vals[i + 1] is not null then vals else list_concat(list_concat(vals[1:i], [cast(list_avg(list_filter(list_transform(ns, lambda x: vals[x + 1]::double), lambda y: y is not null)) as float)]), vals[i + 2:]) end from r join near on cell_id = i where i < 768) select unnest(range(768)) as cell_id, unnest(vals) as price from r where i = 768")
def bin_mean_filled_in_order(spark, sf_dir):
    """Gaps filled in ascending order, each from what is there by then; the SQL goes cell by cell. Whole prices: sums are exact in any order."""
    whole = points(spark, sf_dir).withColumn("price", F.floor("price").cast("double"))
    return resample.fill_gaps(resample.bin_mean(whole, 3, ["price"], C.WGS84), 3, "price", exact=True)


_BINSITE = f"(select cell_id, cast(avg(floor(balance)) as float) as v from {C.steps_sql(SITES, C.cell_steps('lon', 'lat', 3, C.WGS84), ['cell_id'])} p group by 1)"


@query(f"with recursive b as {_BINSITE}, near as {_NEAR3}, r(i, vals) as (select 0::bigint, list(b.v order by g.i) from range(768) g(i) left join b on b.cell_id = g.i union all select i + 1, case when vals[i + 1] is not null then vals else list_concat(list_concat(vals[1:i], [cast(list_avg(list_filter(list_transform(ns, lambda x: vals[x + 1]::double), lambda y: y is not null)) as float)]), vals[i + 2:]) end from r join near on cell_id = i where i < 768) select unnest(range(768)) as cell_id, unnest(vals) as balance from r where i = 768")
def sites_filled_in_order(spark, sf_dir):
    """The same for few sites, so that there are gaps, in blocks of 16 cells that wait for each other."""
    whole = sites(spark, sf_dir).withColumn("balance", F.floor("balance").cast("double"))
    return resample.fill_gaps(resample.bin_mean(whole, 3, ["balance"], C.WGS84), 3, "balance", exact=True, block_levels=2)


def _pyramid(name: str, how: str, variable: str, sql: str):
    def f(spark, sf_dir):
        return pyramid.coarsen(order_cells(spark, sf_dir).select("cell_id", variable), LEVEL, LEVEL - 2, how)

    f.__name__ = name
    query(f"select cell_id >> 4 as cell_id, {sql} as {variable} from {CELLS} p group by 1")(f)


_pyramid("pyramid_mean", "mean", "price", "avg(price)")
_pyramid("pyramid_min", "min", "price", "min(price)")
_pyramid("pyramid_max", "max", "price", "max(price)")
_pyramid("pyramid_sum", "sum", "price", "coalesce(sum(price), 0)")
_pyramid("pyramid_bitor", "bitwise_or", "flags", "bit_or(flags)")


@query(f"select cell_id, class from (select cell_id >> 4 as cell_id, class, row_number() over (partition by cell_id >> 4 order by count(*) desc, class) as turn from {CELLS} p group by 1, 2) where turn = 1")
def pyramid_mode(spark, sf_dir):
    return pyramid.coarsen(order_cells(spark, sf_dir).select("cell_id", "class"), LEVEL, LEVEL - 2, "mode")


@query(" union all ".join(f"select {l} as level, cell_id >> {2 * (LEVEL - l)} as cell_id, avg(price) as price from {CELLS} p group by 2" for l in (11, 10, 8)))
def pyramid_mean_rollup(spark, sf_dir):
    levels = pyramid.mean_levels(order_cells(spark, sf_dir).select("cell_id", "price"), LEVEL, (11, 10, 8), ["price"])
    out = None
    for l, df in levels.items():
        one = df.select(F.lit(l).alias("level"), "cell_id", "price")
        out = one if out is None else out.unionByName(one)
    return out


@query(" union all ".join(f"select {l} as level, cell_id >> {2 * (LEVEL - l)} as cell_id, avg(price) as price, max(class) as class from {CELLS} p group by 2" for l in (11, 10, 9)))
def pyramid_grouping_sets(spark, sf_dir):
    return pyramid.all_levels(order_cells(spark, sf_dir), LEVEL, (11, 10, 9), {"price": "mean", "class": "max"})


@query(f"select cell_id >> 2 as cell_id, cast(round_even(avg(cast(flags as double)), 0) as smallint) as flags from {CELLS} p group by 1")
def pyramid_int_round(spark, sf_dir):
    out = pyramid.coarsen(order_cells(spark, sf_dir).select("cell_id", "flags"), LEVEL, LEVEL - 1, "mean")
    return out.select("cell_id", pyramid.restore(F.col("flags"), T.ShortType(), 255).alias("flags"))


#: Native levels of variables: for each priority the numbers of digits that its prices have.
_NATIVE = "(select distinct o_orderpriority as variable, cast(length(cast(cast(floor(o_totalprice) as bigint) as varchar(20))) as int) as level from orders)"


def _native(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr("o_orderpriority as variable", "cast(length(cast(cast(floor(o_totalprice) as bigint) as string)) as int) as level").distinct()


@query(f"select variable, cast(t.l as int) as level, min(n.level) as nearest, max(n.level) as finest from {_NATIVE} n join range(2, 6) t(l) on n.level > t.l group by 1, 2")
def source_levels(spark, sf_dir):
    return metadata.source_levels(_native(spark, sf_dir), range(2, 6))


@query("select min(l) as level from (select 12 as l union all " + " union all ".join(f"select {l} as l where (select min(n) from (select count(*) as n from orders group by o_orderkey >> {2 * (LEVEL - l)})) = {4 ** (LEVEL - l)}" for l in range(LEVEL - 1, -1, -1)) + ")")
def coarsest_whole_level(spark, sf_dir):
    cells = read(spark, sf_dir, "orders").selectExpr("o_orderkey as cell_id")
    return spark.createDataFrame([(pyramid.coarsest_whole_level(cells, LEVEL),)], "level int")


#: A conversion plan for each line item: level 1 to 20, natives up to 29, chunks up to 7 levels above.
_PLANS = ("cast(l_partkey % 20 as int) + 1 as level", "cast(l_suppkey % 9 as int) + 21 as native", "l_linenumber as above", "cast(l_quantity as int) % 4 as coarsest")


@query(f"select l_orderkey, l_linenumber, level - above as chunk, case when 3 < greatest(level - above, coarsest) then 3 end as shard from (select l_orderkey, l_linenumber, {', '.join(_PLANS)} from lineitem) p where level - above >= coarsest union all select l_orderkey, l_linenumber, coarsest, null from (select l_orderkey, l_linenumber, {', '.join(_PLANS)} from lineitem) p where level - above < coarsest")
def chunk_shard_layout(spark, sf_dir):
    plans = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *_PLANS)
    chunk, shard = pyramid.layout_levels(F.col("level"), F.col("above"), 3, F.col("coarsest"))
    return plans.select("l_orderkey", "l_linenumber", chunk.alias("chunk"), shard.alias("shard"))


@query(f"select l_orderkey, l_linenumber, list_max([0, case when coarsest <= level then coarsest else 0 end, case when above > 4 then level - above else level - 4 end]) as chunk from (select l_orderkey, l_linenumber, {', '.join(_PLANS)} from lineitem) p")
def derived_chunk_level(spark, sf_dir):
    plans = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *_PLANS)
    return plans.select("l_orderkey", "l_linenumber", pyramid.derived_chunk_levels(F.col("level"), F.col("native"), F.col("native") - F.col("above"), F.col("coarsest")).alias("chunk"))


# Resampling -----------------------------------------------------------------------------------


@query(f"select g.i as cell_id, coalesce(p.class, -1) as class from range((select min(12 * (1::bigint << (2 * l))) from range(15) t(l) where 12 * (1::bigint << (2 * l)) > (select max(o_orderkey) from orders))) g(i) left join (select cell_id, class from {CELLS} q where price is not null) p on p.cell_id = g.i")
def dense_grid_fill(spark, sf_dir):
    """The coarsest level that holds all orders, whole; cells without a price have no class."""
    cells = pyramid.nan_to_null(order_cells(spark, sf_dir), "price")
    last = cells.agg(F.max("cell_id")).first()[0]
    level = next(l for l in range(C.MAX_LEVEL) if 12 * 4**l > last)
    return resample.dense(cells.filter("price is not null").select("cell_id", "class"), C.whole_sphere(spark, level), {"class": -1})


@query(f"select cell_id, arg_min(balance, point_idx) as balance, arg_min(nation, point_idx) as nation from {C.steps_sql(SITES, C.cell_steps('lon', 'lat', 29), ['cell_id'])} p group by 1")
def sparse_cell_point(spark, sf_dir):
    return resample.cell_point(sites(spark, sf_dir), ["balance", "nation"])


def _ecef_sql(lon: str, lat: str) -> str:
    a = C.SPHERE.a
    return f"{a} * cos(radians({lat})) * cos(radians({lon})) as x, {a} * cos(radians({lat})) * sin(radians({lon})) as y, {a} * sin(radians({lat})) as z"


_CENTRES2 = "(select cell_id, " + _ecef_sql("lon", "lat") + " from " + C.steps_sql("(select unnest(range(192)) as cell_id)", C.center_steps("cell_id", 2), ["lon", "lat"]) + " q)"
_RANKED = f"(select c.cell_id, s.point_idx, s.balance, s.nation, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) + (c.z - s.z) * (c.z - s.z)) as d, row_number() over (partition by c.cell_id order by (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) + (c.z - s.z) * (c.z - s.z), s.point_idx) as turn from {_CENTRES2} c cross join (select *, {_ecef_sql('lon', 'lat')} from {SITES} r) s)"


@query(f"select cell_id, nation, balance from {_RANKED} where turn = 1")
def nearest(spark, sf_dir):
    return resample.nearest(sites(spark, sf_dir), C.whole_sphere(spark, 2), 2, ["nation", "balance"])


_W = f"(1 / (d / {C.SPHERE.a * 1.0233267079464885 / 4!r} + 1e-6))"


@query(f"select cell_id, round(sum({_W} * cast(cast(balance as float) as double)) / sum({_W}), 3) as balance from {_RANKED} where turn <= 4 group by 1")
def knn_inverse_distance(spark, sf_dir):
    out = resample.inverse_distance(sites(spark, sf_dir), C.whole_sphere(spark, 2), 2, ["balance"], k=4)
    return out.select("cell_id", F.round("balance", 3).alias("balance"))


#: A tile of 241 x 241 nodes around one level-8 cell, whose heights are mean prices of line items; some nodes have none.
#: Its west end is a little off the cells' longitudes, so that no value falls on a rounding tie.
_TILE, _SIDE, _STEP, _WEST, _NORTH = 300_000, 241, 1 / 512, -12.1875 + 2**-30, -1.40625
_NODES = f"(select cast(l_partkey % {_SIDE} as int) as i, cast((l_suppkey * 7 + l_linenumber * 31 + l_orderkey) % {_SIDE} as int) as j, cast(floor(cast(sum(cast(round(l_extendedprice) as bigint)) as double) / count(*)) as float) as height from lineitem group by 1, 2)"
_AT = f"(select cell_id, (lon - ({_WEST}e0)) / {_STEP}e0 as x, (({_NORTH}e0) - lat) / {_STEP}e0 as y from {C.steps_sql(f'(select unnest(range({_TILE * 4**10}::bigint, {(_TILE + 1) * 4**10}::bigint)) as cell_id)', C.center_steps('cell_id', 18), ['lon', 'lat'])} q)"
_CORNERS = " union all ".join(f"select cell_id, cast(floor(x) as int) + {a} as i, cast(floor(y) as int) + {b} as j, {'x - floor(x)' if a else '1 - (x - floor(x))'} as wx, {'y - floor(y)' if b else '1 - (y - floor(y))'} as wy from placed" for a in (0, 1) for b in (0, 1))


@query(f"with placed as {_AT}, c as ({_CORNERS}) select cell_id, case when sum(case when height is not null then wx * wy end) >= 0.5 then round(sum(wx * wy * height) / sum(case when height is not null then wx * wy end), 3) end as height from c left join {_NODES} n on n.i = c.i and n.j = c.j group by 1")
def grid_bilinear(spark, sf_dir):
    """One level-8 cell at level 18, 4^10 cells, from a tile of nodes."""
    lon, lat = spark.range(_SIDE).selectExpr("cast(id as int) as i", f"{_WEST}e0 + id * {_STEP}e0 as lon"), spark.range(_SIDE).selectExpr("cast(id as int) as j", f"{_NORTH}e0 - id * {_STEP}e0 as lat")
    nodes = read(spark, sf_dir, "lineitem").selectExpr(f"cast(l_partkey % {_SIDE} as int) as i", f"cast((l_suppkey * 7 + l_linenumber * 31 + l_orderkey) % {_SIDE} as int) as j", "l_extendedprice")
    nodes = nodes.groupBy("i", "j").agg(F.expr("cast(floor(cast(sum(cast(round(l_extendedprice) as bigint)) as double) / count(1)) as float)").alias("height"))
    cells = spark.range(_TILE * 4**10, (_TILE + 1) * 4**10).withColumnRenamed("id", "cell_id")
    out = resample.grid_bilinear(nodes, lon, lat, cells, 18, ["height"])
    return out.select("cell_id", F.round("height", 3).alias("height"))


@query(f"select cell_id, avg(v) as v from (select cell_id, price as v from {CELLS} p union all select cell_id, case when cell_id % 2 = 0 then class * 1e0 end as v from {CELLS} q) group by 1")
def layer_mean(spark, sf_dir):
    a = order_cells(spark, sf_dir)
    out = resample.layer_mean([a.selectExpr("cell_id", "price as v"), a.selectExpr("cell_id", "case when cell_id % 2 = 0 then class * 1e0 end as v")], ["v"])
    return out.select("cell_id", "v")


@query(f"select cell_id, case when price is not null then greatest(lo, least(hi, price * 1.5e0)) end as price from {CELLS} p, (select min(price) as lo, max(price) as hi from {CELLS} q)")
def clip_to_source(spark, sf_dir):
    a = order_cells(spark, sf_dir).select("cell_id", "price")
    return resample.clip_to_source(pyramid.nan_to_null(a.withColumn("price", F.col("price") * 1.5)), a, "price")


@query()
def psf_resample(spark, sf_dir):
    return psf.psf(points(spark, sf_dir), 4, 1, "price")


@query()
def psf_batch(spark, sf_dir):
    """Price and discount by line number, in one plan: fields that are known at the same points share their equations."""
    lines = read(spark, sf_dir, "lineitem").selectExpr("0 as input_id", "l_orderkey * 8 + l_linenumber as point_idx", f"{LON} as lon", f"{LAT} as lat", "l_linenumber % 3 as label", "l_extendedprice as price", "case when l_discount > 0 then l_discount end as discount")
    return psf.psf_batch(psf.at_work(lines), 4, 1, ["price", "discount"], ("label",))


_MASKED = "(select c_custkey as point_idx, c_nationkey % 3 as label, 'balance' as variable, cast(cast(c_acctbal as float) as double) as d from customer where c_acctbal > 0 union all select c_custkey, c_nationkey % 3, 'debt', cast(cast(-c_acctbal as float) as double) from customer where c_acctbal <= 0 union all select c_custkey, c_nationkey % 3, 'nation', cast(c_nationkey as double) from customer where c_acctbal > 0)"
_MASKED_RANKED = f"(select c.cell_id, f.label, f.variable, f.d as v, sqrt((c.x - s.x) ^ 2 + (c.y - s.y) ^ 2 + (c.z - s.z) ^ 2) as d, row_number() over (partition by c.cell_id, f.label, f.variable order by (c.x - s.x) ^ 2 + (c.y - s.y) ^ 2 + (c.z - s.z) ^ 2, s.point_idx) as turn from {_CENTRES2} c cross join (select *, {_ecef_sql('lon', 'lat')} from {SITES} r) s join {_MASKED} f on f.point_idx = s.point_idx)"


@query(f"select cell_id, label, variable, round(sum({_W} * v) / sum({_W}), 3) as value from {_MASKED_RANKED} where turn <= 4 group by all")
def masked_maps(spark, sf_dir):
    """Fields with missing values, each from the points that have one; fields with one mask share a search."""
    pts = sites(spark, sf_dir).selectExpr("*", "cast(nation % 3 as bigint) as label", "case when balance > 0 then balance end as good", "case when balance <= 0 then -balance end as debt", "case when balance > 0 then nation end as kind").drop("balance", "nation").withColumnsRenamed({"good": "balance", "kind": "nation"})
    out = resample.masked_maps(pts, C.whole_sphere(spark, 2), 2, ["balance", "debt", "nation"], 4, by=("label",))
    return out.select("cell_id", "label", "variable", F.round("value", 3).alias("value"))


@query(f"select 'balance' as variable, false as lost union all select 'price', count(price) > 0 from {CELLS} p")
def lost_data(spark, sf_dir):
    a = order_cells(spark, sf_dir).selectExpr("price", "price as balance")
    lost = resample.lost_variables(a, a.selectExpr("double('NaN') as price", "balance"), ["price", "balance"])
    return spark.createDataFrame([(v, v in lost) for v in ("balance", "price")], "variable string, lost boolean")


# Selection and projection ---------------------------------------------------------------------

_RING6 = "(select unnest(range(36 * 4096, 37 * 4096)) as cell_id)"


@query(f"with r as (select distinct unnest([cell_id, {', '.join(_N)}]) as ring from {C.steps_sql('(select unnest(range(147456, 151552)) as cell_id)', C.neighbour_steps('cell_id', 8), _N)} q) select {KEYS} from {C.steps_sql(POINTS, C.cell_steps('lon', 'lat', 8), ['cell_id'])} p where cell_id in (select ring from r)")
def halo_semi_join(spark, sf_dir):
    # A buffer of 10 km is looked up at level 8; chunk 36 of level 2 is 4096 of its cells.
    return select.chunk_points(points(spark, sf_dir), 36, 2, 10_000.0).selectExpr(*KEYS.split(", "))


@query(f"select {KEYS} from {POINTS} p where lat between -20 and 20 and lon between 155 and 180 union all select {KEYS} from {POINTS} p where lat between -20 and 20 and lon < -155")
def window_across_antimeridian(spark, sf_dir):
    bounds = {"south": -20.0, "north": 20.0, "c_lon": 180.0, "west": -25.0, "east": 25.0}
    return select.in_window(points(spark, sf_dir), bounds).selectExpr(*KEYS.split(", "))


@query(f"with w as (select cell_id, least(lat0, lat1, lat2, lat3) as s, greatest(lat0, lat1, lat2, lat3) as n, c_lon, least({', '.join(f'(lon{k} - c_lon + 180e0) - 360e0 * floor((lon{k} - c_lon + 180e0) / 360e0) - 180e0' for k in range(4))}) as w, greatest({', '.join(f'(lon{k} - c_lon + 180e0) - 360e0 * floor((lon{k} - c_lon + 180e0) / 360e0) - 180e0' for k in range(4))}) as e from " + C.steps_sql(C.steps_sql("(select cast(unnest([64, 80, 100]) as bigint) as cell_id)", C.vertex_steps("cell_id", 2), _V), C.center_steps("cell_id", 2, lon="c_lon", lat="c_lat"), ["c_lon"]) + f" v) select w.cell_id, count(*) as n from {POINTS} p join w on p.lat between w.s and w.n and (p.lon - c_lon + 180e0) - 360e0 * floor((p.lon - c_lon + 180e0) / 360e0) - 180e0 between w.w and w.e group by 1")
def window_band_join(spark, sf_dir):
    chunks = spark.createDataFrame([(64,), (80,), (100,)], "cell_id long")
    return select.band_join(points(spark, sf_dir), select.window_bounds(chunks, 2, 0.0)).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


#: An irregular grid: longitudes of customers, latitudes of suppliers; buffer of 20 km around each chunk of level 4.
_LONS, _LATS = "(select distinct c_custkey % 3571 as i, (c_custkey % 3571 * 7919 % 36000) / 100e0 - 180e0 + 0.00123e0 as lon from customer)", "(select s_suppkey as j, (s_suppkey * 15013 % 17000) / 100e0 - 85e0 + 0.00321e0 as lat from supplier)"
_PAD = math.degrees(20_000.0 / select.SMALL_RADIUS)
_STEPS4 = f"(select (select max(d) from (select lead(lon) over (order by lon) - lon as d from (select distinct lon from {_LONS} a) b) c) as dx, (select max(d) from (select lead(lat) over (order by lat) - lat as d from (select distinct lat from {_LATS} a) b) c) as dy)"
_TURN4 = lambda v: f"({v} - c_lon + 180e0) - 360e0 * floor(({v} - c_lon + 180e0) / 360e0) - 180e0"
_WINDOW4 = f"(select cell_id, c_lon, greatest(-90e0, least(lat0, lat1, lat2, lat3) - {_PAD!r}) as s, least(90e0, greatest(lat0, lat1, lat2, lat3) + {_PAD!r}) as n, least({', '.join(_TURN4(f'lon{k}') for k in range(4))}) as w, greatest({', '.join(_TURN4(f'lon{k}') for k in range(4))}) as e from " + C.steps_sql(C.steps_sql("(select unnest(range(3072)) as cell_id)", C.vertex_steps("cell_id", 4), _V), C.center_steps("cell_id", 4, lon="c_lon", lat="c_lat"), ["c_lon"]) + " v)"
_WINDOW4 = f"(select cell_id, c_lon, s, n, w - {_PAD!r} / cos(radians(greatest(abs(s), abs(n)))) - dx as w, e + {_PAD!r} / cos(radians(greatest(abs(s), abs(n)))) + dx as e, dy from {_WINDOW4} u, {_STEPS4} t)"


@query(f"with q as (select *, s <= -90 or n >= 90 or w < -180 or e > 180 as round from {_WINDOW4} k), x as (select cell_id, arg_min(i, (r, i)) as i_west, arg_max(i, (r, i)) as i_east, count(distinct i) as n_i from (select q.*, i, {_TURN4('lon')} as r from q cross join {_LONS} l) where round or r between w and e group by 1), y as (select cell_id, arg_min(j, (lat, j)) as j_south, arg_max(j, (lat, j)) as j_north, count(distinct j) as n_j from q cross join {_LATS} l where lat between s - dy and n + dy group by 1) select * from x join y using (cell_id)")
def chunk_windows(spark, sf_dir):
    """What each chunk of level 4 needs of an irregular grid; the SQL compares all chunks with all nodes."""
    lons = read(spark, sf_dir, "customer").selectExpr("c_custkey % 3571 as i", "(c_custkey % 3571 * 7919 % 36000) / 100e0 - 180e0 + 0.00123e0 as lon").distinct()
    lats = read(spark, sf_dir, "supplier").selectExpr("s_suppkey as j", "(s_suppkey * 15013 % 17000) / 100e0 - 85e0 + 0.00321e0 as lat")
    return select.chunk_windows(lons, lats, C.whole_sphere(spark, 4), 4, 20_000.0)


@query(f"select {KEYS} from {POINTS} p where lon > 0 and lat > 0 and lon + lat < 60")
def polygon_points(spark, sf_dir):
    return select.in_polygon(points(spark, sf_dir), [(0, 0), (60, 0), (0, 60)], "lon", "lat").selectExpr(*KEYS.split(", "))


_UTM_SRC = "(select l_orderkey, l_linenumber, l_partkey, l_suppkey, 200000e0 + (l_partkey * 37 % 600000) as x, (l_orderkey * 131 % 9000000) * 1e0 as y from lineitem)"


@query(f"select {KEYS}, round(lon, 9) as lon, round(lat, 9) as lat from {C.steps_sql(_UTM_SRC, projection.utm_steps(32631), ['lon', 'lat'])} p")
def utm_inverse(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").selectExpr(*KEYS.split(", "), "200000e0 + (l_partkey * 37 % 600000) as x", "(l_orderkey * 131 % 9000000) * 1e0 as y")
    out = projection.to_degrees(df, 32631)
    return out.selectExpr(*KEYS.split(", "), "round(lon, 9) as lon", "round(lat, 9) as lat")


_LL_SRC = f"(select {KEYS}, 3e0 + (lon / 60e0) as lon, lat from {POINTS} r)"


@query(f"select {KEYS}, round(x, 4) as x, round(y, 4) as y from {C.steps_sql(_LL_SRC, projection.utm_forward_steps(32631), ['x', 'y'])} p")
def utm_forward(spark, sf_dir):
    near = points(spark, sf_dir).withColumn("lon", F.expr("3e0 + (lon / 60e0)"))
    return projection.from_degrees(near, 32631).selectExpr(*KEYS.split(", "), "round(x, 4) as x", "round(y, 4) as y")


#: A national grid whose origin is off the equator, as its files describe it.
NATIONAL_GRID = """PROJCRS["OSGB36 / British National Grid", BASEGEOGCRS["OSGB36", DATUM["Ordnance Survey of Great Britain 1936",
    ELLIPSOID["Airy 1830", 6377563.396, 299.3249646, LENGTHUNIT["metre", 1]]], PRIMEM["Greenwich", 0, ANGLEUNIT["degree", 0.0174532925199433]]],
  CONVERSION["British National Grid", METHOD["Transverse Mercator", ID["EPSG", 9807]],
    PARAMETER["Latitude of natural origin", 49, ANGLEUNIT["degree", 0.0174532925199433], ID["EPSG", 8801]],
    PARAMETER["Longitude of natural origin", -2, ANGLEUNIT["degree", 0.0174532925199433], ID["EPSG", 8802]],
    PARAMETER["Scale factor at natural origin", 0.9996012717, SCALEUNIT["unity", 1], ID["EPSG", 8805]],
    PARAMETER["False easting", 400000, LENGTHUNIT["metre", 1], ID["EPSG", 8806]],
    PARAMETER["False northing", -100000, LENGTHUNIT["metre", 1], ID["EPSG", 8807]]],
  CS[Cartesian, 2], AXIS["(E)", east, ORDER[1], LENGTHUNIT["metre", 1]], AXIS["(N)", north, ORDER[2], LENGTHUNIT["metre", 1]], ID["EPSG", 27700]]"""


def _national_sql() -> str:
    """The same grid from its figures: the arc up to 49 degrees by quadrature, latitudes by the direct series in the conformal one."""
    a, f = 6377563.396, 1 / 299.3249646
    n, e2 = f / (2 - f), f * (2 - f)
    curve = lambda t: a * (1 - e2) / (1 - e2 * math.sin(t) ** 2) ** 1.5
    steps, top = 2000, math.radians(49)
    arc = math.fsum(curve(top * i / steps) * (1 if i in (0, steps) else 4 if i % 2 else 2) for i in range(steps + 1)) * top / steps / 3
    k = 0.9996012717 * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    back = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480,
        4397 * n**4 / 161280 - 11 * n**5 / 504,
        4583 * n**5 / 161280,
    ]
    direct = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45 + 26 * n**5 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45 + 2704 * n**5 / 315,
        56 * n**3 / 15 - 136 * n**4 / 35 - 1262 * n**5 / 105,
        4279 * n**4 / 630 - 332 * n**5 / 35,
        4174 * n**5 / 315,
    ]
    xi = "".join(f" - {b!r}::double * sin({2 * i} * p) * cosh({2 * i} * q)" for i, b in enumerate(back, 1))
    eta = "".join(f" - {b!r}::double * cos({2 * i} * p) * sinh({2 * i} * q)" for i, b in enumerate(back, 1))
    lat = "".join(f" + {d!r}::double * sin({2 * i} * c)" for i, d in enumerate(direct, 1))
    source = "select c_custkey, (c_custkey * 7919 % 7000) * 100e0 as x, (c_custkey * 15013 % 13000) * 100e0 as y from customer"
    scaled = f"select *, (y + 100000 + {0.9996012717 * arc!r}::double) / {k!r}::double as p, (x - 400000) / {k!r}::double as q from ({source}) a"
    series = f"select *, p{xi} as u, q{eta} as v from ({scaled}) b"
    conformal = f"select *, asin(sin(u) / cosh(v)) as c from ({series}) d"
    return f"select c_custkey, x, y, round(degrees(atan2(sinh(v), cos(u))) - 2, 8) as lon, round(degrees(c{lat}), 8) as lat from ({conformal}) e"


@query(_national_sql())
def national_grid(spark, sf_dir):
    """Easting and northing of a transverse Mercator grid that its WKT2 describes, to degrees."""
    pts = read(spark, sf_dir, "customer").selectExpr("c_custkey", "(c_custkey * 7919 % 7000) * 100e0 as x", "(c_custkey * 15013 % 13000) * 100e0 as y")
    return projection.to_degrees(pts, crs.read(NATIONAL_GRID)).select("c_custkey", "x", "y", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


@query(f"select {KEYS}, round(x, 5) as x, round(y, 5) as y from {_UTM_SRC} p")
def utm_round_trip(spark, sf_dir):
    """There and back: what was given comes out again, to hundredths of a millimetre."""
    df = read(spark, sf_dir, "lineitem").selectExpr(*KEYS.split(", "), "200000e0 + (l_partkey * 37 % 600000) as x", "(l_orderkey * 131 % 9000000) * 1e0 as y")
    out = projection.from_degrees(projection.to_degrees(df, 32631).drop("x", "y"), 32631)
    return out.selectExpr(*KEYS.split(", "), "round(x, 5) as x", "round(y, 5) as y")


#: Chunk 76 of level 2 in UTM: 32 places along its edge, and the sides between them.
_EDGE = C.steps_sql(C.steps_sql("(select 76::bigint as cell_id, unnest(range(32)) as corner)", C.edge_steps("cell_id", 2, "corner", 8), ["lon", "lat"]), projection.utm_forward_steps(32631), ["x", "y"])
_EDGES = f"(select a.x as x1, a.y as y1, b.x as x2, b.y as y2 from {_EDGE} a join {_EDGE} b on b.corner = (a.corner + 1) % 32)"
_NEAREST_SIDE = "least(1e0, greatest(0e0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ^ 2 + (y2 - y1) ^ 2)))"


@query(f"with s as {_EDGES}, p as (select *, {_NEAREST_SIDE} as t from (select distinct x, y from {_UTM_SRC} v) u cross join s), q as (select x, y from p group by x, y having sum(case when (y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 then 1 else 0 end) % 2 = 1 or min((x - x1 - t * (x2 - x1)) ^ 2 + (y - y1 - t * (y2 - y1)) ^ 2) < 1e8) select {KEYS} from {_UTM_SRC} w join q using (x, y)")
def projected_selection(spark, sf_dir):
    """Projected points in a chunk or within 10 km of it."""
    df = read(spark, sf_dir, "lineitem").selectExpr(*KEYS.split(", "), "200000e0 + (l_partkey * 37 % 600000) as x", "(l_orderkey * 131 % 9000000) * 1e0 as y")
    return select.projected_points(df, 76, 2, 32631, 10_000.0).selectExpr(*KEYS.split(", "))


@query("select o_orderkey, 300000e0 + 10e0 * ((o_orderkey % 100) + 0.5e0) as x, 5000000e0 - 10e0 * ((o_orderkey // 100) + 0.5e0) as y from orders")
def pixel_positions(spark, sf_dir):
    df = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(o_orderkey div 100 as int) as row", "cast(o_orderkey % 100 as int) as col")
    return projection.pixel_to_xy(df, (10.0, 0.0, 300000.0, 0.0, -10.0, 5000000.0)).select("o_orderkey", "x", "y")


# Checks of shape, metadata and names ------------------------------------------------------------


@query(f"select cell_id, corner, round(lon, 8) as lon, round(lat, 8) as lat from {C.steps_sql(f'(select cell_id, unnest(range(8)) as corner from {CELLS} c)', C.edge_steps('cell_id', LEVEL, 'corner', 2), ['lon', 'lat'])} p")
def cell_edges(spark, sf_dir):
    """Eight places along each cell's edge."""
    out = C.with_edge(order_cells(spark, sf_dir).select("cell_id"), LEVEL, 2)
    return out.selectExpr("cell_id", "cast(corner as bigint) as corner", "round(lon, 8) as lon", "round(lat, 8) as lat")


_BOX = "(select min(2e0 * n_nationkey - 20) as w, max(2e0 * n_nationkey - 20) as e, min(30e0 + n_nationkey) as s, max(30e0 + n_nationkey) as n from nation)"
_TURN = lambda v, c: f"({v} - ({c}) + 180e0) - 360e0 * floor(({v} - ({c}) + 180e0) / 360e0) - 180e0"
_WINDOW5 = f"(select cell_id, c_lon, least(lat0, lat1, lat2, lat3) as south, greatest(lat0, lat1, lat2, lat3) as north, least({', '.join(_TURN(f'lon{k}', 'c_lon') for k in range(4))}) as west, greatest({', '.join(_TURN(f'lon{k}', 'c_lon') for k in range(4))}) as east from " + C.steps_sql(C.steps_sql("(select unnest(range(12288)) as cell_id)", C.vertex_steps("cell_id", 5), _V), C.center_steps("cell_id", 5, lon="c_lon", lat="c_lat"), ["c_lon"]) + " v where least(lat0, lat1, lat2, lat3) > -90 and greatest(lat0, lat1, lat2, lat3) < 90)"


@query(f"select cell_id, south >= s and north <= n and west >= shift - half and east <= shift + half as inside from (select *, (e - w) / 2 as half, {_TURN('(w + e) / 2', 'c_lon')} as shift from {_WINDOW5} c, {_BOX} b) where south < n and north > s and west < shift + half and east > shift - half")
def coverage_of_extent(spark, sf_dir):
    """The level-5 cells that touch the box of the nations' places; the SQL tries all cells."""
    box = read(spark, sf_dir, "nation").selectExpr("min(2e0 * n_nationkey - 20)", "min(30e0 + n_nationkey)", "max(2e0 * n_nationkey - 20)", "max(30e0 + n_nationkey)").first()
    return select.coverage(spark, select.Extent(*box), 5)


#: Sites of each nation within 25 degrees of a meridian of its own; some lie across the antimeridian.
_NEAR_OWN = "((c_nationkey * 29 % 360) - 180 + (c_custkey * 7919 % 5000) / 100e0 - 25)"


@query(f"with p as (select c_nationkey as nation, {_NEAR_OWN} - 360e0 * floor(({_NEAR_OWN} + 180e0) / 360e0) as lon, lat from customer join {SITES} s on s.point_idx = c_custkey), g as (select *, coalesce(lag(lon) over (partition by nation order by lon), max(lon) over (partition by nation) - 360e0) as before from p), x as (select nation, arg_max(lon, (lon - before, -lon)) as west, arg_max(before, (lon - before, -lon)) as e, min(lat) as south, max(lat) as north from g group by 1) select nation, round(west, 6) as west, south, round(case when e < west then e + 360e0 else e end, 6) as east, north from x")
def input_extents(spark, sf_dir):
    """The smallest box of each nation's sites, by the largest gap on the circle; the SQL looks at all gaps."""
    from ..sources.grids import extents

    own = read(spark, sf_dir, "customer").selectExpr("c_custkey as point_idx", "c_nationkey as nation", f"{_NEAR_OWN} as lon")
    at = own.join(sites(spark, sf_dir).select("point_idx", "lat"), "point_idx")
    return extents(at, ["nation"]).select("nation", F.round("west", 6).alias("west"), "south", F.round("east", 6).alias("east"), "north")


#: A polygon with the nations as corners: a star around (10, 35), its corners' distance by the nation's region.
_CORNER = ("10e0 + (9 + 4 * n_regionkey) * cos(radians(n_nationkey * 14.4e0 + 3))", "35e0 + (6 + 3 * n_regionkey) * sin(radians(n_nationkey * 14.4e0 + 3))")
_RING = f"(select n_nationkey as k, {_CORNER[0]} as x, {_CORNER[1]} as y from nation)"
_SIDES = f"(select a.x as x1, a.y as y1, b.x as x2, b.y as y2 from {_RING} a join {_RING} b on b.k = (a.k + 1) % (select count(*) from nation))"
_EDGE6 = C.steps_sql("(select cell_id, unnest(range(16)) as corner from (select unnest(range(49152)) as cell_id) z)", C.edge_steps("cell_id", 6, "corner", 4), ["lon", "lat"])
_HAND = lambda s, x, y: f"(({x} - {s}x1) * ({s}y2 - {s}y1) - ({y} - {s}y1) * ({s}x2 - {s}x1))"


@query(f"with s as materialized {_SIDES}, p as materialized (select cell_id, corner, lon, lat from {_EDGE6} q where lon between -50 and 70 and lat between 0 and 75), e as materialized (select a.cell_id, a.lon as ex1, a.lat as ey1, b.lon as ex2, b.lat as ey2 from p a join p b on a.cell_id = b.cell_id and b.corner = (a.corner + 1) % 16), i as (select cell_id, corner, sum(case when (s.y1 > lat) <> (s.y2 > lat) and ({_HAND('s.', 'lon', 'lat')} < 0) = (s.y2 > s.y1) then 1 else 0 end) % 2 = 1 as within from p cross join s group by 1, 2), c as (select distinct cell_id from e cross join s where {_HAND('s.', 'ex1', 'ey1')} * {_HAND('s.', 'ex2', 'ey2')} < 0 and {_HAND('e', 's.x1', 's.y1')} * {_HAND('e', 's.x2', 's.y2')} < 0), v as (select distinct cell_id from {C.steps_sql(_RING, C.cell_steps('x', 'y', 6), ['cell_id'])} r), t as (select cell_id, bool_or(within) as any_in, bool_and(within) as all_in, count(*) as n from i group by 1) select t.cell_id, all_in and c.cell_id is null and v.cell_id is null as inside from t left join c using (cell_id) left join v using (cell_id) where any_in or c.cell_id is not null or v.cell_id is not null")
def polygon_coverage(spark, sf_dir):
    """The level-6 cells that a polygon with nations as corners covers; the SQL tries all cells around."""
    corners = read(spark, sf_dir, "nation").selectExpr("n_nationkey as k", f"{_CORNER[0]} as x", f"{_CORNER[1]} as y").orderBy("k").collect()  # the corners of one polygon
    return select.polygon_coverage(spark, [(r["x"], r["y"]) for r in corners], 6)


@query(f"select cell_id, case when price is not null then greatest(0e0, price - 150000) end as price from {CELLS} p")
def clip_at_zero(spark, sf_dir):
    a = pyramid.nan_to_null(order_cells(spark, sf_dir).select("cell_id", "price"))
    return resample.clip_at_zero(a.withColumn("price", F.col("price") - 150000), "price")


@query(f"select cell_id, case when flags <> 7 then flags * 0.5e0 - 3e0 end as v from {CELLS} p")
def packed_decode(spark, sf_dir):
    return order_cells(spark, sf_dir).select("cell_id", pyramid.decode_packed(F.col("flags"), 0.5, -3.0, 7).alias("v"))


@query(f"select coalesce(a.cell_id, b.cell_id) as cell_id, price, class from (select cell_id >> 2 as cell_id, max(price) as price from {CELLS} p where price is not null group by 1) a full join (select (o_custkey << 3) >> 2 as cell_id, min(cast(floor(o_totalprice) as bigint) % 5) as class from orders group by 1) b on a.cell_id = b.cell_id")
def merged_levels(spark, sf_dir):
    """Variables of a level that came from different native cells, by order and by customer, side by side."""
    a = pyramid.nan_to_null(order_cells(spark, sf_dir), "price").filter("price is not null")
    b = read(spark, sf_dir, "orders").selectExpr("shiftleft(o_custkey, 3) as cell_id", "cast(floor(o_totalprice) as bigint) % 5 as class")
    return pyramid.merge_levels([pyramid.coarsen(a.select("cell_id", "price"), LEVEL, LEVEL - 1, "max"), pyramid.coarsen(b, LEVEL, LEVEL - 1, "min")])


@query(f"select cell_id, cast(point_idx as bigint) as point_idx, cast(turn as int) as rank from {_RANKED} where turn <= 2")
def stored_links(spark, sf_dir):
    """The two nearest customers of each cell, kept in a link store and read from there."""
    from ..sources.links import stored_neighbours
    from ..sources.shared import shared_dir

    pts = sites(spark, sf_dir).withColumn("point_idx", F.col("point_idx").cast("long"))
    return stored_neighbours(pts, C.whole_sphere(spark, 2), 2, 2, f"{shared_dir(spark)}/links").select("cell_id", "point_idx", "rank")


@query(f"select label, cell_id, round(sum({_W} * cast(cast(balance + label as float) as double)) / sum({_W}), 3) as balance from {_RANKED}, (values (0), (1000), (5000)) t(label) where turn <= 4 group by 1, 2")
def knn_by_label(spark, sf_dir):
    """Three labels of an extra dimension with one neighbour search."""
    pts = sites(spark, sf_dir).withColumn("label", F.explode(F.array(F.lit(0), F.lit(1000), F.lit(5000)))).withColumn("balance", F.col("balance") + F.col("label"))
    out = resample.inverse_distance(pts, C.whole_sphere(spark, 2), 2, ["balance"], k=4, by=("label",))
    return out.select("label", "cell_id", F.round("balance", 3).alias("balance"))


_GROUND = lambda level, e, src, n: f"(select {n}, {e.a!r} / sqrt(1 - {e.e2!r} * sin(radians(lat)) ^ 2) * cos(radians(lat)) * cos(radians(lon)) as x, {e.a!r} / sqrt(1 - {e.e2!r} * sin(radians(lat)) ^ 2) * cos(radians(lat)) * sin(radians(lon)) as y, {e.a * (1 - e.e2)!r} / sqrt(1 - {e.e2!r} * sin(radians(lat)) ^ 2) * sin(radians(lat)) as z from {src} g)"
_FROM3 = _GROUND(3, C.WGS84, C.steps_sql("(select unnest(range(768)) as cell_id)", C.center_steps("cell_id", 3), ["lon", "lat"]), "cell_id as old")
_TO3 = _GROUND(3, C.WGS84, C.steps_sql("(select unnest(range(768)) as cell_id)", C.center_steps("cell_id", 3, C.WGS84), ["lon", "lat"]), "cell_id")


@query(f"with v as (select o_orderkey % 768 as old, max(floor(o_totalprice)) as price from orders group by 1), f as (select * from {_FROM3} p join v using (old)), d as (select cell_id, price, row_number() over (partition by cell_id order by (t.x - f.x) ^ 2 + (t.y - f.y) ^ 2 + (t.z - f.z) ^ 2, old) as turn from {_TO3} t cross join f) select cell_id, cast(price as double) as price from d where turn = 1")
def sphere_regrid_nearest(spark, sf_dir):
    """A map of the sphere's grid at level 3 on the grid of WGS84."""
    cells = read(spark, sf_dir, "orders").groupBy(F.expr("o_orderkey % 768").alias("cell_id")).agg(F.max(F.floor("o_totalprice")).cast("double").alias("price"))
    return products.sphere_to_ellipsoid(cells, 3, "price", method="nearest")


_ATTRS = "(select 'v' || (c_nationkey % 5) as variable, case c_custkey % 4 when 0 then 'units' when 1 then 'valid_min' when 2 then 'long_name' else 'history' end as name, cast(min(c_custkey) as varchar) as value from customer group by 1, 2)"


@query(f"select variable, name, value from {_ATTRS} a where not (name = 'valid_min' and variable in ('v1', 'v2')) and not (name = 'history' and variable <> 'v4') and name not in ('units', 'grid_mapping') and not (variable = 'v3' and name = 'long_name') union all select distinct variable, 'units', case when variable in ('v2', 'v3') then 'two' else 'one' end from {_ATTRS} b union all select distinct variable, 'grid_mapping', 'crs' from {_ATTRS} c union all select 'v3', 'long_name', 'third' where exists (from {_ATTRS} d where variable = 'v3')")
def attribute_rules(spark, sf_dir):
    """Packed variables lose valid ranges, patterns exclude and override, the engine has the last word."""
    names = F.expr("case c_custkey % 4 when 0 then 'units' when 1 then 'valid_min' when 2 then 'long_name' else 'history' end")
    table = read(spark, sf_dir, "customer").groupBy(F.expr("'v' || (c_nationkey % 5)").alias("variable"), names.alias("name")).agg(F.min("c_custkey").cast("string").alias("value"))
    return metadata.attributes(table, {"v[0-3]": ["his.*"]}, {".*": {"units": "one"}, "v[23]": {"units": "two"}, "v3": {"long_name": "third"}}, {"grid_mapping": "crs"}, ["v1", "v2"])


_DOCS = "(select '' as path, '{}' as json union all select 'a', '{}' union all select 'a/' || r_name, '{\"k\":' || r_regionkey || '}' from region union all select 'a/' || r_name || '/b', '[]' from region)"


@query(f"select '' as root, path, json from {_DOCS} d union all select 'a', path, json from {_DOCS} d where path = 'a' or starts_with(path, 'a/') union all select 'a/ASIA', path, json from {_DOCS} d where path = 'a/ASIA' or starts_with(path, 'a/ASIA/')")
def consolidated_roots(spark, sf_dir):
    """Metadata of the whole tree and of two roots in it; a root named twice counts once."""
    regions = read(spark, sf_dir, "region")
    docs = spark.createDataFrame([("", "{}"), ("a", "{}")], "path string, json string").unionByName(regions.selectExpr("'a/' || r_name as path", "concat('{\"k\":', r_regionkey, '}') as json")).unionByName(regions.selectExpr("'a/' || r_name || '/b' as path", "'[]' as json"))
    return metadata.consolidate(docs, ["a", "a/ASIA", "a"]).select("root", F.explode("documents").alias("path", "json"))


@query("select o_custkey % 2 as input_id, o_custkey as point_idx, o_orderpriority as label, count(*) as v from orders group by 1, 2, 3")
def align_exact(spark, sf_dir):
    """Two inputs that have the same labels, and must."""
    one = lambda k: read(spark, sf_dir, "orders").filter(f"o_custkey % 2 = {k}").groupBy(F.col("o_custkey").alias("point_idx"), F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("v"))
    return align.union_points(align.align([one(0), one(1)], "label", "exact")).selectExpr("cast(input_id as bigint) as input_id", "point_idx", "label", "v")


@query(f"select nation, max(step) as step from (select nation, lead(lat) over (partition by nation order by lat) - lat as step from (select distinct nation, lat from {SITES} a) b) c group by 1")
def grid_steps(spark, sf_dir):
    from ..sources.grids import largest_step

    return largest_step(sites(spark, sf_dir), ["nation"], "lat")


@query("select arg_min(epsg, (-n, epsg)) as epsg from (select 32600 + c_nationkey + 1 as epsg, count(*) as n from customer group by 1)")
def most_common_crs(spark, sf_dir):
    from ..sources.grids import most_common_crs as most

    return spark.createDataFrame([(most(read(spark, sf_dir, "customer").selectExpr("32600 + c_nationkey + 1 as epsg")),)], "epsg long")


@query("select event_id, strftime(ts, '%Y%m%d') || 'T' || strftime(ts, '%H') || case when event_id % 2 = 0 then '-12n2h' || substr(sha1(strftime(ts, '%H:%M') || '/12:00'), 1, 6) else '' end as tag from events")
def cache_tags(spark, sf_dir):
    at, noon = F.date_format("ts", "HH:mm"), F.lit("12:00")
    return read(spark, sf_dir, "events").select("event_id", text.cache_tag(F.date_format("ts", "yyyy-MM-dd"), F.when(F.col("event_id") % 2 == 0, F.array(at, noon)).otherwise(F.array(at))).alias("tag"))


@query("select event_id, 'S00__' || event_type || '_' || strftime(ts, '%Y%m%dT%H%M%S') || '_' || strftime(ts + interval 3 hour, '%Y%m%dT%H%M%S') || '_20240102T030405' as product, 'x.' || event_id as name from events")
def product_ids(spark, sf_dir):
    made = text.product_id(F.col("event_type"), F.col("ts"), F.col("ts") + F.expr("interval 3 hours"), F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    return read(spark, sf_dir, "events").select("event_id", made.alias("product"), text.product_name(F.concat(F.lit("s3://b/x."), F.col("event_id").cast("string"), F.lit(".zarr/"))).alias("name"))


_VERSION = "case l_linenumber % 3 when 0 then '1.' || cast(l_quantity as int) when 1 then cast(cast(l_quantity as int) as varchar(9)) else '2.' || l_linenumber || '.dev1+gabc' || (1000 + l_linenumber) || '.d2' end"


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when v not like '%dev%' then cast(string_split(v, '.') as int[]) >= [1, 13] end as recent, case when v like '%dev%' then regexp_extract(v, 'g(.*)[.]d', 1) when contains(v, '.') then 'refs/tags/v' || v else 'main' end as ref from (select *, {_VERSION} as v from lineitem)")
def version_refs(spark, sf_dir):
    v = F.expr(_VERSION)
    return read(spark, sf_dir, "lineitem").select(*KEYS.split(", "), (text.version_parts(v) >= F.array(F.lit(1), F.lit(13))).alias("recent"), text.version_ref(v).alias("ref"))


# Alignment and set operations -----------------------------------------------------------------


def _labelled(spark, sf_dir, which: int) -> DataFrame:
    """Mean value for each user of a label; the two inputs miss one label each."""
    e = read(spark, sf_dir, "events").filter(f"user_id % 2 = {which}")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    lack = kinds[0] if which else kinds[-1]
    return e.filter(F.col("event_type") != lack).groupBy(F.col("user_id").alias("point_idx"), F.col("event_type").alias("label")).agg(F.count(F.lit(1)).alias("v"))


_LAB = "(select user_id % 2 as input_id, user_id as point_idx, event_type as label, count(*) as v from events where not (user_id % 2 = 1 and event_type = (select min(event_type) from events where user_id % 2 = 1)) and not (user_id % 2 = 0 and event_type = (select max(event_type) from events where user_id % 2 = 0)) group by 1, 2, 3)"


def _aligned(spark, sf_dir, mode, labels=None):
    return align.union_points(align.align([_labelled(spark, sf_dir, 0), _labelled(spark, sf_dir, 1)], "label", mode, labels)).selectExpr("cast(input_id as bigint) as input_id", "point_idx", "label", "v")


@query(f"select p.input_id, p.point_idx, l.label, v.v from (select distinct input_id, point_idx from {_LAB} a) p cross join (select distinct label from {_LAB} b) l left join {_LAB} v on v.input_id = p.input_id and v.point_idx = p.point_idx and v.label = l.label")
def align_outer(spark, sf_dir):
    return _aligned(spark, sf_dir, "outer")


@query(f"select input_id, point_idx, label, v from {_LAB} a where label in (select label from {_LAB} b where input_id = 0) and label in (select label from {_LAB} c where input_id = 1)")
def align_inner(spark, sf_dir):
    return _aligned(spark, sf_dir, "inner")


@query(f"select p.input_id, p.point_idx, l.label, v.v from (select distinct input_id, point_idx from {_LAB} a) p cross join (select distinct event_type as label from events union select 'zz') l left join {_LAB} v on v.input_id = p.input_id and v.point_idx = p.point_idx and v.label = l.label")
def align_reindex(spark, sf_dir):
    kinds = [r[0] for r in read(spark, sf_dir, "events").select("event_type").distinct().collect()]  # a handful
    return _aligned(spark, sf_dir, "reindex", [*kinds, "zz"])


@query("select 0 as input_id, c_custkey as id, c_acctbal as a, null::double as b from customer union all select 1, s_suppkey, null, s_acctbal from supplier")
def point_union(spark, sf_dir):
    a = read(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_acctbal as a")
    b = read(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "s_acctbal as b")
    return align.union_points([a, b]).select("input_id", "id", "a", "b")


@query("select n_nationkey, n_name, case when n_nationkey = 3 then 'left' end as side from nation where n_nationkey = 3 union all select n_nationkey, upper(n_name) || '!', 'right' from nation where n_nationkey = 3")
def copy_table_diff(spark, sf_dir):
    a = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return align.table_difference(a, a.withColumn("n_name", F.when(F.col("n_nationkey") == 3, F.concat(F.upper("n_name"), F.lit("!"))).otherwise(F.col("n_name"))))


@query("select '' as path union all select 'a' as path")
def missing_parents(spark, sf_dir):
    paths = read(spark, sf_dir, "region").selectExpr("concat('a/', r_name) as path")
    leaves = paths.unionByName(paths.selectExpr("concat(path, '/b') as path"))
    return align.missing_parents(leaves)


# Functions ------------------------------------------------------------------------------------


@query("select n_nationkey, n_name as label from nation")
def label_decode(spark, sf_dir):
    return align.decode_labels(read(spark, sf_dir, "nation").selectExpr("n_nationkey", "cast(n_name as binary) as label"), "label")


@query("select event_id, len(string_split(strftime(ts, '%H/%M/%S'), '/')) as n_parts, case when hour(ts) % 3 = 0 then 1 else 0 end as n_synoptic from events")
def request_times(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.size(text.request_list(F.date_format("ts", "HH/mm/ss"))).cast("long").alias("n_parts"), F.size(text.three_hourly(F.array(F.date_format("ts", "HH:mm")))).alias("n_synoptic"))


@query("select event_id, (date_diff('second', timestamp '2024-01-01', ts) // 3600) as hours from events")
def hours_since(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", text.hours_since(F.col("ts"), F.to_timestamp(F.lit("2024-01-01 05:00:00"))).alias("hours"))


@query("select p_partkey, regexp_replace(p_name, '[^a-zA-Z0-9-]', '_', 'g') as item from part")
def item_ids(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.item_id(F.concat(F.lit("/data/x/"), "p_name", F.lit(".zarr"))).alias("item"))


@query("select n_nationkey, n_name, regexp_full_match(n_name, '.*A|NATION_1.*') as hit from nation")
def name_match(spark, sf_dir):
    return read(spark, sf_dir, "nation").select("n_nationkey", "n_name", text.full_match(F.col("n_name"), [".*A", "NATION_1.*"]).alias("hit"))


_DERIVED = f"(select variable, cast(t.l as int) as level, min(n.level) as source from {_NATIVE} n join range(1, 4) t(l) on n.level > t.l group by 1, 2)"


@query(f"select level || '/' || variable as asset, cast(null as varchar) as derived_from, cast(null as double) as scale from {_NATIVE} n where level not in (select level from {_DERIVED} d) union all select level || '/' || variable, source || '/' || variable, cast(1 << (source - level) as double) from {_DERIVED} d")
def layout_items(spark, sf_dir):
    native = _native(spark, sf_dir)
    derived = metadata.source_levels(native, range(1, 4)).select("variable", "level", F.col("nearest").alias("source"))
    return metadata.layout(native, derived, "array").select("asset", "derived_from", "scale")


_USERS = "(select user_id, list_sort(list(distinct event_type)) as xs from events group by 1)"


@query(f"select w, (select list_sort(list(distinct x)) from (select unnest(xs) as x, user_id // 8 as g from {_USERS} u) where g = w) as any_of, (select list_sort(list(x)) from (select x, count(*) as n from (select unnest(xs) as x, user_id // 8 as g from {_USERS} u) where g = w group by 1) where n = (select count(*) from {_USERS} v where user_id // 8 = w)) as all_of from (select distinct user_id // 8 as w from events) q")
def merged_lists(spark, sf_dir):
    """Union and intersection of the event types of eight users at a time."""
    users = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("xs"))
    lists = users.groupBy(F.floor(F.col("user_id") / 8).alias("w")).agg(F.collect_list("xs").alias("lists"))
    sort = lambda how: F.sort_array(metadata.merged(F.col("lists"), how))
    return lists.select("w", sort("join_outer").alias("any_of"), F.nullif(sort("join_inner"), F.array().cast("array<string>")).alias("all_of"))


_ITEMS = ", ".join(f"('{g}', '{v}', '{p}', '{u}', '{n}')" for g, vs in products.GROUPS.items() for v, (p, u, n) in vs.items())


@query(f"select t.*, count(e.event_type) as n, max(e.value) as high from (values {_ITEMS}) t(\"group\", variable, parameter, unit, long_name) left join events e on e.user_id % 16 = length(t.variable) group by all")
def product_variables(spark, sf_dir):
    """The products' variables with the events that their names' length stands for."""
    kinds = read(spark, sf_dir, "events").groupBy(F.expr("user_id % 16").alias("at")).agg(F.count("event_type").alias("n"), F.max("value").alias("high"))
    v = products.variables(spark)
    return v.join(kinds, F.char_length("variable") == F.col("at"), "left").select(*v.columns, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "high")


@query(f"select cell_id, ts as window_start, n, total from (select cell_id, date_trunc('day', o_orderdate) as ts, count(*) as n, round(sum(o_totalprice), 2) as total from (select o_orderkey % 192 as cell_id, o_orderdate, o_totalprice from orders) o group by 1, 2)")
def cell_windows_batch(spark, sf_dir):
    from ..streaming.cells import cell_windows

    at = C.with_center(read(spark, sf_dir, "orders").selectExpr("o_orderkey % 192 as cell_id", "o_orderdate as ts", "o_totalprice as price"), 2).drop("cell_id")
    out = cell_windows(at, 2, "price", window="1 day")
    return out.select("cell_id", "window_start", "n", F.round("total", 2).alias("total"))


@query(f"select chunk_id, cell_id, price from (select cell_id >> 8 as chunk_id, cell_id, price from {CELLS} p where price is not null) where chunk_id in (1, 3)")
def chunk_pruning(spark, sf_dir):
    from ..sources.shared import shared_dir
    from ..sources.sinks import read_cells, write_cells

    import uuid

    path = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    write_cells(pyramid.nan_to_null(order_cells(spark, sf_dir).select("cell_id", "price")).filter("price is not null"), path, LEVEL, LEVEL - 4)
    return read_cells(spark, path, [1, 3]).selectExpr("cast(chunk_id as bigint) as chunk_id", "cell_id", "price")


_OLD, _NEW = (f"(select o_orderkey as cell_id, case when o_orderpriority <> '4-NOT SPECIFIED' then floor({p}) end as price from orders where o_orderstatus {s})" for p, s in (("o_totalprice", "<> 'P'"), ("case when o_orderpriority = '3-MEDIUM' and o_orderstatus = 'F' then o_totalprice + 1 else o_totalprice end", "<> 'O' or o_orderpriority > '2-HIGH'")))
_SETS = ", ".join(f"{n} as (select cell_id >> 2 as chunk_id, list_sort(list(struct_pack(c := cell_id, p := price))) as rows from {t} t group by 1)" for n, t in (("a", _OLD), ("b", _NEW)))


@query(f"with {_SETS} select chunk_id, case when a.rows is null then 'added' when b.rows is null then 'gone' else 'changed' end as change, coalesce(len(a.rows), 0) as n_before, coalesce(len(b.rows), 0) as n_after from a full join b using (chunk_id) where a.rows is distinct from b.rows")
def changed_chunks(spark, sf_dir):
    """Orders before and after a day's work: the chunks of four cells that a second conversion has to write or remove."""
    from ..sources.sinks import chunk_changes

    orders = read(spark, sf_dir, "orders")
    cells = lambda df: df.selectExpr("o_orderkey as cell_id", "case when o_orderpriority <> '4-NOT SPECIFIED' then cast(floor(price) as double) end as price")
    old = cells(orders.filter("o_orderstatus <> 'P'").withColumn("price", F.col("o_totalprice")))
    new = cells(orders.filter("o_orderstatus <> 'O' or o_orderpriority > '2-HIGH'").withColumn("price", F.expr("case when o_orderpriority = '3-MEDIUM' and o_orderstatus = 'F' then o_totalprice + 1 else o_totalprice end")))
    return chunk_changes(old, new, LEVEL, LEVEL - 1)


@query(f"select cell_id, price from {CELLS} p where (cell_id >> 4) = 77")
def parent_range(spark, sf_dir):
    return C.where_parent(pyramid.nan_to_null(order_cells(spark, sf_dir).select("cell_id", "price")), 77, 2)
