"""Resampling of points onto cells: neighbour joins, grid interpolation, binning.

Candidates come from equi-joins on a cell and its ring, never from comparing all pairs. A neighbour
found within the width of the ring is certain; targets for which that fails go down the tree of
cells that hold points, with bounds of distance. Distances are straight lines between points on the ellipsoid. Values go
through float32 first, as observations are stored. Ties go to the lower input and point number.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..functions import cells as C
from ..functions.cells import SPHERE, Ellipsoid
from ..sources.shared import materialize, scratch
from .pyramid import nan_to_null

#: Resamplers whose result has the input's type; the others give float64.
KEEPS_TYPE = ("nearest", "k-nearest", "cell-point")


def ecef(lon: str, lat: str, ellipsoid: Ellipsoid, prefix: str = "") -> dict[str, Column]:
    """Columns x, y, z in metres."""
    lam, phi = F.radians(lon), F.radians(lat)
    n = F.lit(ellipsoid.a) / F.sqrt(1 - F.lit(ellipsoid.e2) * F.sin(phi) * F.sin(phi))
    return {f"{prefix}x": n * F.cos(phi) * F.cos(lam), f"{prefix}y": n * F.cos(phi) * F.sin(lam), f"{prefix}z": n * (1 - ellipsoid.e2) * F.sin(phi)}


#: Points are told apart by their cells of this level (10 cm); the tree of cells ends there.
FINE = 26
#: No point of a cell at level l is further from its centre than this share of the radius over 2^l.
WIDEST = 1.15


def start_level(n_points: int, k: int) -> int:
    """A level with some points more than ``k`` in a cell, if they are spread evenly."""
    return max(0, int(math.floor(math.log(max(n_points, 1) / (12.0 * 2 * k), 4))) if n_points > 24 * k else 0)


def _at(level: int) -> Column:
    return F.shiftright("fine", 2 * (FINE - level))


def _ring_level(placed: DataFrame, total: int, k: int, by: tuple[str, ...]) -> int:
    """The coarsest level from the even one on where points share their cell with few others."""
    even = start_level(total, k)
    levels = [l for l in (even, even + 2, even + 4) if l <= FINE]
    keys = F.explode(F.array(*[F.struct(F.lit(l).alias("l"), _at(l).alias("c")) for l in levels]))
    cells = placed.select(*by, keys.alias("k")).groupBy(*by, "k.l", "k.c").agg(F.count(F.lit(1)).alias("n"))
    shared = {r["l"]: r["s"] / r["t"] for r in cells.groupBy("l").agg(F.sum(F.col("n") * F.col("n")).alias("s"), F.sum("n").alias("t")).collect()}  # three rows
    return next((l for l in levels if shared.get(l, 0) <= 12 * k), levels[-1])


def _ranked(pairs: DataFrame, k: int, by: tuple[str, ...]) -> DataFrame:
    d2 = sum(((F.col(f"t{c}") - F.col(f"p{c}")) * (F.col(f"t{c}") - F.col(f"p{c}")) for c in "xyz"), F.lit(0.0))
    ranked = pairs.select("cell_id", *by, "input_id", "point_idx", d2.alias("d2")).withColumn("rank", F.row_number().over(W.Window.partitionBy("cell_id", *by).orderBy("d2", "input_id", "point_idx")))
    return ranked.filter(F.col("rank") <= k).select("cell_id", *by, "input_id", "point_idx", "rank", F.sqrt("d2").alias("distance"))


def _descend(placed: DataFrame, left: DataFrame, k: int, ellipsoid: Ellipsoid, by: tuple[str, ...]) -> DataFrame:
    """The k nearest points of any targets, wherever they are, from the tree of cells with points.

    Level by level each target keeps the cells that may hold one of its k: those no further than
    the bound within which as many as are ``wanted`` surely lie. Cells with few points aren't
    split; of points at one place, in the finest cells, the first k are enough.
    """
    small, at = max(16, 4 * k), 0
    target = ["cell_id", *by, "wanted", "tx", "ty", "tz"]
    open_, closed = left.select(*target, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("of")), None
    while True:
        nodes = placed.groupBy(*by, _at(at).alias("node")).agg(F.count(F.lit(1)).alias("n"))
        nodes = C.with_center(nodes, at, ellipsoid, cell="node", lon="c_lon", lat="c_lat").withColumns(ecef("c_lon", "c_lat", ellipsoid, "c"))
        nodes = nodes.select(*by, "node", "n", "cx", "cy", "cz", (F.shiftright("node", 4) if at else F.col("node")).alias("of"))
        away = F.sqrt(sum(((F.col(f"t{c}") - F.col(f"c{c}")) * (F.col(f"t{c}") - F.col(f"c{c}")) for c in "xyz"), F.lit(0.0)))
        reach = WIDEST * ellipsoid.a / 2**at
        found = open_.join(nodes, ["of", *by]).select(*target, F.lit(at).alias("at"), "node", "n", (away - reach).alias("near"), (away + reach).alias("far"))
        own = W.Window.partitionBy("cell_id", *by)
        every = (found if closed is None else found.unionByName(closed)).withColumn("sure", F.sum("n").over(own.orderBy("far", "at", "node").rowsBetween(W.Window.unboundedPreceding, 0)))
        bound = F.min(F.when(F.col("sure") >= F.col("wanted"), F.col("far"))).over(own)
        every = materialize(every.withColumn("bound", bound).filter(F.col("near") <= F.col("bound")).drop("sure", "bound"))
        split = (F.col("n") > small) & (F.col("at") < FINE)
        open_, closed = every.filter(split).select(*target, F.col("node").alias("of")), every.filter(~split)
        if open_.isEmpty():
            break
        at += 2
    pairs = None
    for l in range(0, at + 1, 2):
        near = placed.withColumn("node", _at(l))
        if l == FINE:
            near = near.join(closed.filter(F.col("at") == l).select("node", *by).distinct(), ["node", *by], "left_semi")
            near = near.withColumn("same", F.row_number().over(W.Window.partitionBy("node", "lon", "lat", *by).orderBy("input_id", "point_idx"))).filter(F.col("same") <= k).drop("same")
        one = closed.filter(F.col("at") == l).join(near, ["node", *by]).select("cell_id", *by, "tx", "ty", "tz", "input_id", "point_idx", "px", "py", "pz")
        pairs = one if pairs is None else pairs.unionByName(one)
    return _ranked(pairs, k, by)


#: A cell with more points than this many times k is crowded: its ring is not compared point by point.
CROWD = 512


def _in_ring(placed: DataFrame, left: DataFrame, at: int, k: int, ellipsoid: Ellipsoid, by: tuple[str, ...]) -> DataFrame:
    """The k nearest points in a target's cell of a level and the ring around; none where these are crowded."""
    own = C.add_steps(left, C.cell_steps("t_lon", "t_lat", at, ellipsoid, "own"), ["own"])
    if at > 0:
        around = C.with_neighbours(own, at, "own", "around")
        around = around.withColumn("near", F.explode(F.array_distinct(F.concat(F.array("own"), F.filter("around", lambda c: c >= 0))))).drop("around")
    else:
        around = own.withColumn("near", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    near = placed.withColumn("near", _at(at))
    crowded = near.groupBy("near", *by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD * k).select("near", *by)
    calm = around.join(around.join(crowded, ["near", *by], "left_semi").select("cell_id", *by).distinct(), ["cell_id", *by], "left_anti")
    return _ranked(calm.join(near, ["near", *by]), k, by)


def neighbours(points: DataFrame, targets: DataFrame, level: int, k: int, ellipsoid: Ellipsoid = SPHERE, start: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` points nearest to each target cell's centre: cell_id, ``by``, input_id, point_idx, rank, distance.

    ``points``: input_id, point_idx, lon, lat; ``targets``: cell_id. Fewer than k points: all. With
    columns ``by``, which both have, a target looks among the points that agree with it there; one
    plan serves them all. A target first looks in its cell of the level ``start`` (by default one
    that suits the number of points in occupied cells) and the ring around, then two levels up,
    unless one of these cells is crowded. Those that are, or that find too few, go through
    ``_descend``; so points may lie in clusters.
    """
    placed = points.select(*by, "input_id", "point_idx", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).filter("lon is not null and lat is not null")
    placed = materialize(C.with_cell(placed, FINE, ellipsoid, out="fine").withColumns(ecef("lon", "lat", ellipsoid, "p")))
    sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.max("n")).first()[0] or 0
    left = targets.select("cell_id", *by).distinct()
    left = left.join(sizes.select(*by, F.least("n", F.lit(k)).alias("wanted")), list(by)) if by else left.withColumn("wanted", F.lit(min(k, total)))
    left = C.with_center(left, level, ellipsoid, lon="t_lon", lat="t_lat").withColumns(ecef("t_lon", "t_lat", ellipsoid, "t"))
    found, key = None, ["cell_id", *by]
    first = (_ring_level(placed, total, k, by) if start is None else start) if total else 0
    for at in dict.fromkeys((first, max(0, first - 2))):
        best = materialize(_in_ring(placed, left, at, k, ellipsoid, by))
        width = C.NARROWEST * ellipsoid.a * math.sqrt(math.pi / 3) / 2**at if at else math.inf
        seen = best.groupBy(*key).agg(F.max("rank").alias("n"), F.max("distance").alias("far")).filter(F.col("far") <= width)
        ok = seen.join(left.select(*key, "wanted"), key).filter(F.col("n") >= F.col("wanted")).select(*key)
        left = materialize(left.join(ok, key, "left_anti"))
        sure = best.join(ok, key, "left_semi")
        found = sure if found is None else found.unionByName(sure)
        if not total or left.isEmpty():
            return found
    return found.unionByName(_descend(placed, left, k, ellipsoid, by))


def masked_maps(points: DataFrame, targets: DataFrame, level: int, variables: list[str], k: int = 4, ellipsoid: Ellipsoid = SPHERE, by: tuple[str, ...] = ()) -> DataFrame:
    """``inverse_distance`` of each field from the points where it has a value: cell_id, ``by``, variable, value.

    A field is a variable at a label of the dimensions ``by``. Fields known at the same points, by
    ``masks``, share a search of neighbours, and all searches are one plan. With k = 1 it is the
    nearest point that has a value. A field without any has no rows.
    """
    known = materialize(masks(points, variables, by))
    values = null_safe(fields_of(points, variables, by), known.select(*by, "variable", "mask", "first"), [*by, "variable"])
    own = values.filter("first").select("mask", "input_id", "point_idx", "lon", "lat")
    kinds = known.select("mask").distinct()
    cells = targets.select("cell_id").distinct().withColumn("__one", F.lit(1)).join(kinds.groupBy(F.lit(1).alias("__one")).agg(F.collect_list("mask").alias("__m")), "__one").select("cell_id", F.explode("__m").alias("mask"))  # masks are few
    links = neighbours(own, cells, level, k, ellipsoid, by=("mask",))
    size = ellipsoid.a * math.sqrt(math.pi / 3) / 2**level
    joined = links.join(values.drop("lon", "lat", "first"), ["mask", "input_id", "point_idx"]).withColumn("w", 1 / (F.col("distance") / size + 1e-6))
    return joined.groupBy("cell_id", *by, "variable").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("value"))


def fields_of(points: DataFrame, variables: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each value there is: input_id, point_idx, lon, lat, ``by``, variable, d (through float32)."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"`{v}`").cast("float").cast("double").alias("d")) for v in variables]))
    return points.select("input_id", "point_idx", "lon", "lat", *by, each.alias("__f")).select("input_id", "point_idx", "lon", "lat", *by, "__f.*").filter("d is not null and not isnan(d)")


def masks(points: DataFrame, variables: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Which fields are known at the same points: ``by``, variable, mask, first.

    Fields whose points with a value are the same have the same ``mask``, told by number, sum and
    parity of their hashes; one of them is the first. A field without any value has no row.
    """
    here = F.xxhash64("input_id", "point_idx", F.col("lon").cast("double"), F.col("lat").cast("double"))
    fields = fields_of(points, variables, by).groupBy(*by, "variable").agg(F.count(F.lit(1)).alias("__n"), F.sum(here.cast("decimal(38,0)")).alias("__s"), F.bit_xor(here).alias("__x"))
    fields = fields.select(*by, "variable", F.concat_ws("/", "__n", "__s", "__x").alias("mask"))
    turn = F.row_number().over(W.Window.partitionBy("mask").orderBy(*by, "variable"))
    return fields.withColumn("first", turn == 1)


def chunk_neighbours(points: DataFrame, near: DataFrame, reach: float, targets: DataFrame, level: int, k: int, ellipsoid: Ellipsoid = SPHERE) -> DataFrame:
    """``neighbours`` of the targets of some chunks: among the points ``near`` first, which are all up to ``reach`` metres away.

    A target whose k-th point is no further is done; all others look at all points.
    """
    found = materialize(neighbours(near, targets, level, k, ellipsoid))
    sure = 0.99 * 2 * ellipsoid.a * math.sin(min(math.pi, reach / ellipsoid.a) / 2)  # a straight line is shorter than the way on the ground
    ok = found.groupBy("cell_id").agg(F.max("rank").alias("n"), F.max("distance").alias("far")).filter((F.col("n") >= k) & (F.col("far") <= sure)).select("cell_id")
    left = materialize(targets.select("cell_id").distinct().join(ok, "cell_id", "left_anti"))
    if left.isEmpty():
        return found
    return found.join(ok, "cell_id", "left_semi").unionByName(neighbours(points, left, level, k, ellipsoid))


def float32(df: DataFrame, variables: Iterable[str]) -> DataFrame:
    """Values as they enter a resampler: floats and wide integers through float32, NaN to NULL."""
    floats = [v for v in variables if isinstance(df.schema[v].dataType, (T.DoubleType, T.FloatType, T.LongType, T.IntegerType))]
    return nan_to_null(df.withColumns({v: F.col(v).cast("float") for v in floats}), *floats)


def places(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Where points lie; with dimensions ``by``, along which they repeat, each once."""
    own = points.select("input_id", "point_idx", "lon", "lat")
    return own.dropDuplicates(["input_id", "point_idx"]) if by else own


def nearest(points: DataFrame, targets: DataFrame, level: int, variables: list[str], ellipsoid: Ellipsoid = SPHERE, links: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Each target cell takes its nearest point's values, whose types stay; a row for each ``by``."""
    links = neighbours(places(points, by), targets, level, 1, ellipsoid) if links is None else links.filter("rank = 1")
    return links.join(points.select("input_id", "point_idx", *by, *variables), ["input_id", "point_idx"]).select("cell_id", *by, *variables)


def inverse_distance(points: DataFrame, targets: DataFrame, level: int, variables: list[str], k: int = 4, ellipsoid: Ellipsoid = SPHERE, threshold: float = 0.0, keep_type: bool = False, links: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Means of the k nearest points, weighted by inverse distance in cell sizes.

    A missing value takes no part. A cell whose weights, as a share of all k, come to less than
    ``threshold`` is missing. One neighbour search serves all variables, and all labels of the
    dimensions ``by``, at each of which every point has a row.
    """
    links = neighbours(places(points, by), targets, level, k, ellipsoid) if links is None else links.filter(F.col("rank") <= k)
    size = ellipsoid.a * math.sqrt(math.pi / 3) / 2**level
    w = links.withColumn("w", 1 / (F.col("distance") / size + 1e-6))
    joined = w.join(float32(points.select("input_id", "point_idx", *by, *variables), variables), ["input_id", "point_idx"])
    aggs = []
    for v in variables:
        has = F.when(F.col(v).isNotNull(), F.col("w"))
        mean = F.when(F.sum(has) >= threshold * F.sum("w"), F.sum(F.col("w") * F.col(v)) / F.sum(has))
        kind = points.schema[v].dataType
        aggs.append((F.bround(mean).cast(kind) if keep_type and not isinstance(kind, (T.FloatType, T.DoubleType)) else mean.cast(kind if keep_type else "double")).alias(v))
    return joined.groupBy("cell_id", *by).agg(*aggs)


def cell_point(points: DataFrame, variables: list[str], ellipsoid: Ellipsoid = SPHERE, level: int = C.MAX_LEVEL) -> DataFrame:
    """Each point in its level-29 cell, values as they are; of several in a cell the first stays."""
    if level != C.MAX_LEVEL:
        raise ValueError("cell-point works at level 29 only")
    placed = C.with_cell(points, level, ellipsoid)
    first = F.min_by(F.struct(*variables), F.struct("input_id", "point_idx"))
    return placed.groupBy("cell_id").agg(first.alias("first")).select("cell_id", "first.*")


def bin_mean(points: DataFrame, level: int, variables: list[str], ellipsoid: Ellipsoid = SPHERE, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and number of the points in each cell that holds any: cell_id, ``by``, n, variables (float)."""
    placed = nan_to_null(C.with_cell(points, level, ellipsoid), *variables)
    return placed.groupBy("cell_id", *by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(v).cast("double")).cast("float").alias(v) for v in variables])


def every_cell(labels: DataFrame, level: int) -> DataFrame:
    """Each row with every cell of a level, in two steps so that no row holds a whole level."""
    half = level // 2
    coarse = labels.withColumn("__of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(12 * 4**half - 1).cast("long"))))
    return C.children(coarse, level - half, "__of", "cell_id").drop("__of")


def null_safe(a: DataFrame, b: DataFrame, on: Iterable[str], how: str = "inner") -> DataFrame:
    """A join by equal columns where null equals null; these columns come from the left side."""
    on = list(on)
    right = b.withColumnsRenamed({c: f"__{c}" for c in on})
    equal = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
    return a.join(right, equal, how).drop(*[f"__{c}" for c in on])


def fill_gaps(binned: DataFrame, level: int, variable: str, exact: bool = False, by: tuple[str, ...] = (), block_levels: int | None = None) -> DataFrame:
    """All cells of the sphere: an empty one gets the mean of its neighbours that have a value.

    The quick form looks at the values that were there, at each label of the dimensions ``by``.
    The exact form fills in ascending order, with earlier fills counting for later ones
    (``fill_in_order``). It has no labels.
    """
    have = binned.filter(F.col(variable).isNotNull()).select("cell_id", *by, F.col(variable).cast("float").alias(variable))
    every = every_cell(binned.select(*by).distinct(), level) if by else C.whole_sphere(binned.sparkSession, level)
    empty = null_safe(every, have, ["cell_id", *by], "left_anti")
    around = C.with_neighbours(empty, level).select("cell_id", *by, F.explode("neighbours").alias("near")).filter("near >= 0")

    def filled(edges: DataFrame, known: DataFrame) -> DataFrame:
        hits = null_safe(edges, known.withColumnRenamed("cell_id", "near"), ["near", *by])
        return hits.groupBy("cell_id", *by).agg(F.avg(F.col(variable).cast("double")).cast("float").alias(variable))

    if not exact:
        return null_safe(every, have.unionByName(filled(around, have)), ["cell_id", *by], "left").select("cell_id", *by, variable)
    return have.unionByName(fill_in_order(have, around, variable, FILL_LEVELS if block_levels is None else block_levels)).join(C.whole_sphere(binned.sparkSession, level), "cell_id", "right")


#: Gaps are filled in order by blocks of 4^FILL_LEVELS cells, each in one task.
FILL_LEVELS = 8


def fill_in_order(have: DataFrame, around: DataFrame, variable: str, levels: int = FILL_LEVELS) -> DataFrame:
    """The cells of ``around`` (cell_id, near) filled in ascending order: cell_id, ``variable``.

    A cell gets the mean of its neighbours that have a value by then. Cells of a block are filled in
    one task; a block waits for those with lower ids that hold empty neighbours of its cells. Blocks
    that wait for none are worked on together, wave after wave: there are as many waves as the longest
    chain of blocks, which is about 2^levels times shorter than that of cells. A wave reads its own
    edges alone. Cells whose neighbours get no value have no row.
    """
    spark = have.sparkSession
    of = lambda c: F.expr(C.parent(c, levels))
    empty = around.select(F.col("cell_id").alias("near"), F.lit(True).alias("empty")).distinct()
    known = have.select(F.col("cell_id").alias("near"), F.col(variable).alias("value"))
    edges = around.filter("near >= 0").join(empty, "near", "left").filter("empty is null or near < cell_id").join(known, "near", "left").filter("empty or value is not null")
    edges = materialize(edges.select(of("cell_id").alias("block"), "cell_id", "near", "value"))
    # An edge without a value comes from an empty cell; what is left of those in other blocks are waits.
    waits = materialize(edges.filter(F.col("value").isNull()).select("block", of("near").alias("before")).filter("before < block").distinct())
    waves, fills = scratch(spark, "waves"), scratch(spark, "fills")
    todo, wave = materialize(edges.select("block").distinct()), 0
    while not todo.isEmpty():
        held = waits.join(todo.withColumnRenamed("block", "before"), "before", "left_semi").select("block").distinct()
        later = materialize(todo.join(held, "block", "left_semi"))
        todo.join(later, "block", "left_anti").write.parquet(f"{waves}/wave={wave}")
        todo, wave = later, wave + 1
    shape = T.StructType([T.StructField("cell_id", T.LongType()), T.StructField(variable, T.FloatType())])
    if wave == 0:
        return spark.createDataFrame([], shape)
    numbered = scratch(spark, "edges")
    edges.join(spark.read.schema("block long, wave int").parquet(waves), "block").repartition("wave", "block").write.mode("overwrite").partitionBy("wave").parquet(numbered)

    def fill(block):
        import pandas as pd

        block = block.sort_values(["cell_id", "near"], kind="stable")
        made: dict[int, float] = {}
        cell, total, n = None, 0.0, 0

        def end():
            if n:
                made[cell] = float(np.float32(total / n))

        for at, near, value in zip(block["cell_id"].to_numpy(), block["near"].to_numpy(), block["value"].to_numpy()):
            if at != cell:
                end()
                cell, total, n = at, 0.0, 0
            v = made.get(near) if value != value else float(value)
            if v is not None:
                total, n = total + v, n + 1
        end()
        return pd.DataFrame({"cell_id": list(made), variable: np.fromiter(made.values(), dtype=np.float32)}).astype({"cell_id": "int64"})

    for i in range(wave):
        mine = spark.read.schema("block long, cell_id long, near long, value float, wave int").parquet(numbered).filter(f"wave = {i}").drop("wave")
        if i:
            before = spark.read.schema(T.StructType([*shape, T.StructField("wave", T.IntegerType())])).parquet(fills).select(F.col("cell_id").alias("near"), F.col(variable).alias("__made"))
            mine = mine.join(before, "near", "left").select("block", "cell_id", "near", F.coalesce("value", "__made").alias("value"))
        mine.groupBy("block").applyInPandas(fill, shape).write.parquet(f"{fills}/wave={i}")
    return spark.read.schema(T.StructType([*shape, T.StructField("wave", T.IntegerType())])).parquet(fills).drop("wave")


def clip_to_source(cells: DataFrame, points: DataFrame, variable: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Values no lower and no higher than the valid source values, at each label of the dimensions ``by``."""
    limits = nan_to_null(points, variable).groupBy(*by).agg(F.min(variable).alias("__lo"), F.max(variable).alias("__hi"))
    both = null_safe(cells, limits, by, "left") if by else cells.join(F.broadcast(limits))  # one row
    return both.withColumn(variable, F.when(F.col(variable).isNotNull(), F.greatest("__lo", F.least("__hi", variable)))).drop("__lo", "__hi")


def clip_at_zero(cells: DataFrame, variable: str) -> DataFrame:
    return cells.withColumn(variable, F.when(F.col(variable).isNotNull(), F.greatest(F.lit(0.0), variable)))


def dense(result: DataFrame, cells: DataFrame, fills: dict[str, float | None] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each wanted cell (and labels ``by``, which ``cells`` then has too); a missing value
    is the variable's fill (NaN for floats, else 0)."""
    kinds = {f.name: f.dataType for f in result.schema if f.name not in ("cell_id", *by)}
    joined = null_safe(cells.select("cell_id", *by), result, ["cell_id", *by], "left")
    out = []
    for v, kind in kinds.items():
        fill = (fills or {}).get(v)
        fill = (float("nan") if isinstance(kind, (T.FloatType, T.DoubleType)) else 0) if fill is None else fill
        out.append(F.coalesce(v, F.lit(fill).cast(kind)).alias(v))
    return joined.select("cell_id", *by, *out)


def check_chunk_size(cells: DataFrame, level: int, chunk_level: int, chunk_size: int) -> None:
    """Sparse output: no chunk may hold more cells than its size."""
    worst = cells.groupBy(F.expr(C.parent("cell_id", level - chunk_level)).alias("c")).count().agg(F.max("count")).first()[0]
    if worst is not None and worst > chunk_size:
        raise ValueError(f"a chunk holds {worst} cells, more than {chunk_size}")


def lost_variables(points: DataFrame, result: DataFrame, variables: list[str]) -> list[str]:
    """Variables with finite input and no finite output, which deserve a warning."""
    finite = lambda df: df.agg(*[F.count(F.when(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")), 1)).alias(v) for v in variables]).first()
    before, after = finite(points), finite(result)
    return [v for v in variables if before[v] and not after[v]]


def _brackets(axis: DataFrame, index: str, value: str) -> tuple[DataFrame, float, float]:
    """Neighbouring nodes of an axis, in bins of the typical step: bin, lo, hi, last, i, i2."""
    by = W.Window.orderBy("v")  # an axis: one of the two sides of a grid
    pairs = axis.select(F.col(index).alias("i"), F.col(value).cast("double").alias("v")).withColumns({"i2": F.lead("i").over(by), "hi": F.lead("v").over(by)})
    stats = pairs.agg(F.min("v").alias("first"), F.max("v").alias("last"), F.avg(F.col("hi") - F.col("v")).alias("step")).first()
    step = stats["step"] or 1.0
    pairs = pairs.filter("hi is not null").withColumnRenamed("v", "lo").withColumn("last", F.col("hi") == stats["last"])
    bins = F.sequence(F.floor((F.col("lo") - stats["first"]) / step), F.floor((F.col("hi") - stats["first"]) / step))
    return pairs.withColumn("bin", F.explode(bins)), stats["first"], step


def _quads(grid: DataFrame, xs: DataFrame, ys: DataFrame, variables: list[str]) -> DataFrame:
    """A row for each mesh of a grid, named by its first node (x_1, y_1): values at its four corners.

    A node is a corner of up to four meshes: the grid is exploded, not the far more many targets.
    """
    sides = lambda pairs, n: pairs.select(F.col("i").alias(f"{n}_1"), "i", F.lit(1).alias(f"{n}_side")).unionByName(pairs.select(F.col("i").alias(f"{n}_1"), F.col("i2").alias("i"), F.lit(2).alias(f"{n}_side"))).distinct()
    at = grid.join(F.broadcast(sides(xs, "x")), "i").join(F.broadcast(sides(ys, "y").withColumnRenamed("i", "j")), "j")  # axes
    corner = lambda v, a, b: F.max(F.when((F.col("x_side") == a) & (F.col("y_side") == b), F.col(v))).alias(f"{v}__{a}{b}")
    return at.groupBy("x_1", "y_1").agg(*[corner(v, a, b) for v in variables for a in (1, 2) for b in (1, 2)])


@dataclass(frozen=True)
class Axis:
    """An axis of constant step: number of nodes, first and last value, and how indices follow values (``i`` of the first, +1 or -1)."""

    n: int
    first: float
    last: float
    i: int
    way: int

    @property
    def step(self) -> float:
        return (self.last - self.first) / (self.n - 1)


def _regular(axis: DataFrame, index: str, value: str) -> Axis | None:
    by = W.Window.orderBy("v")  # an axis: one of the two sides of a grid
    nodes = axis.select(F.col(index).cast("long").alias("i"), F.col(value).cast("double").alias("v")).withColumns({"di": F.lead("i").over(by) - F.col("i"), "dv": F.lead("v").over(by) - F.col("v")})
    r = nodes.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("first"), F.max("v").alias("last"), F.min_by("i", "v").alias("i"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("di", "dv") for f in (F.min, F.max)]).first()
    if r["n"] < 2 or r["min_di"] != r["max_di"] or r["min_di"] not in (1, -1) or r["min_dv"] <= 0 or r["max_dv"] - r["min_dv"] > 1e-9 * r["max_dv"]:
        return None
    return Axis(r["n"], r["first"], r["last"], r["i"], r["min_di"])


#: Meshes that are sent to all tasks, four values a variable each; more are joined.
SENT_MESHES = 1 << 17


def _regular_bilinear(grid: DataFrame, x: Axis, y: Axis, targets: DataFrame, level: int, variables: list[str], ellipsoid: Ellipsoid, min_weight: float) -> DataFrame:
    """``grid_bilinear`` by arithmetic: meshes are numbered from the lowest longitude and latitude."""
    closed = x.last - x.first + 1.5 * x.step >= 360.0
    place = lambda a, i: (F.col(i).cast("long") - a.i) * a.way
    # A node is a corner of up to four meshes: the grid is exploded, not the far more many targets.
    left = F.when(F.col("p") > 0, F.col("p") - 1).otherwise(F.lit(x.n - 1 if closed else -1))
    sides = F.array(*[F.struct(mx.alias("x_1"), F.lit(a).alias("a"), my.alias("y_1"), F.lit(b).alias("b")) for a, mx in ((1, F.col("p")), (2, left)) for b, my in ((1, F.col("q")), (2, F.col("q") - 1))])
    at = float32(grid.select("i", "j", *variables), variables).withColumns({"p": place(x, "i"), "q": place(y, "j")}).withColumn("s", F.explode(sides)).select("s.*", *variables)
    at = at.filter((F.col("x_1") >= 0) & (F.col("y_1") >= 0))
    corner = lambda v, a, b: F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col(v))).alias(f"{v}__{a}{b}")
    meshes = at.groupBy("x_1", "y_1").agg(*[corner(v, a, b) for v in variables for a in (1, 2) for b in (1, 2)])
    c = C.with_center(targets.select("cell_id"), level, ellipsoid, lon="c_lon", lat="c_lat")
    c = c.withColumn("c_lon", F.lit(x.first) + F.pmod(F.col("c_lon") - x.first, F.lit(360.0)))
    inside = F.col("c_lat").between(y.first, y.last)
    c = c.filter(inside if closed else inside & (F.col("c_lon") <= x.last))
    number = lambda a, v: F.least(F.lit(a.n - 2), F.floor((F.col(v) - a.first) / a.step)).cast("long")
    c = c.withColumns({"x_1": F.when(F.col("c_lon") > x.last, F.lit(x.n - 1).cast("long")).otherwise(number(x, "c_lon")), "y_1": number(y, "c_lat")})
    gap = F.when(F.col("c_lon") > x.last, (F.col("c_lon") - x.last) / (360.0 - x.last + x.first))
    c = c.select("cell_id", "x_1", "y_1", F.coalesce(gap, (F.col("c_lon") - x.first) / x.step - F.col("x_1")).alias("x_w"), ((F.col("c_lat") - y.first) / y.step - F.col("y_1")).alias("y_w"))
    out = c.join(F.broadcast(meshes) if x.n * y.n * len(variables) <= SENT_MESHES else meshes, ["x_1", "y_1"], "left")
    return out.select("cell_id", *[_blend(v, min_weight).alias(v) for v in variables])


def grid_bilinear(grid: DataFrame, lon_axis: DataFrame, lat_axis: DataFrame, targets: DataFrame, level: int, variables: list[str], ellipsoid: Ellipsoid = SPHERE, min_weight: float = 0.5) -> DataFrame:
    """Bilinear interpolation between the four grid nodes around each cell centre.

    ``grid``: i, j, variables; ``lon_axis``: i, lon; ``lat_axis``: j, lat; either direction of an
    axis, and either convention of longitude. Exact on planes. Corners without a value give
    their weight up; a cell whose valid weight is under ``min_weight`` is missing. A cell outside
    the grid has no row. A grid that goes round the globe is closed. On axes with a constant step a
    target's mesh follows from its place, and it meets that mesh in one join; on other axes it is
    looked up on each first. Targets are never grouped.
    """
    regular = _regular(lon_axis, "i", "lon"), _regular(lat_axis, "j", "lat")
    if all(regular):
        return _regular_bilinear(grid, *regular, targets, level, variables, ellipsoid, min_weight)
    lon_axis = lon_axis.select("i", F.col("lon").cast("double").alias("lon"))
    spread = lon_axis.agg(F.min("lon").alias("start"), (F.max("lon") - F.min("lon")).alias("w"), F.count(F.lit(1)).alias("n")).first()
    start = spread["start"]
    if spread["n"] > 1 and spread["w"] + 1.5 * spread["w"] / (spread["n"] - 1) >= 360.0:
        closing = lon_axis.filter(F.col("lon") == start).select("i", (F.col("lon") + 360.0).alias("lon"))
        lon_axis = lon_axis.unionByName(closing).groupBy("lon").agg(F.min("i").alias("i")).select("i", "lon")
    xs, x0, xstep = _brackets(lon_axis, "i", "lon")
    ys, y0, ystep = _brackets(lat_axis, "j", "lat")
    centres = C.with_center(targets.select("cell_id"), level, ellipsoid, lon="c_lon", lat="c_lat")
    centres = centres.withColumn("c_lon", F.lit(start) + F.pmod(F.col("c_lon") - start, F.lit(360.0)))

    def bracket(df, pairs, first, step, c, name):
        inside = (F.col(c) >= F.col("lo")) & ((F.col(c) < F.col("hi")) | ((F.col(c) == F.col("hi")) & F.col("last")))
        hit = df.withColumn("bin", F.floor((F.col(c) - first) / step)).join(F.broadcast(pairs.drop("i2")), "bin").filter(inside)  # an axis
        return hit.withColumn(f"{name}_w", (F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo"))).withColumnRenamed("i", f"{name}_1").drop("bin", "lo", "hi", "last", c)

    at = bracket(bracket(centres, xs, x0, xstep, "c_lon", "x"), ys, y0, ystep, "c_lat", "y")
    at = at.join(_quads(float32(grid.select("i", "j", *variables), variables), xs, ys, variables), ["x_1", "y_1"], "left")
    return at.select("cell_id", *[_blend(v, min_weight).alias(v) for v in variables])


def _sides(points: DataFrame, axis: str) -> DataFrame:
    """Neighbouring values of an axis of each strip: strip, lo, hi, last, and bin, by the strip's mean step."""
    by = W.Window.partitionBy("strip")
    pairs = points.select("strip", F.col(axis).alias("lo")).distinct().withColumns({"hi": F.lead("lo").over(by.orderBy("lo")), "first": F.min("lo").over(by), "end": F.max("lo").over(by), "n": F.count(F.lit(1)).over(by)})
    if axis == "lon":  # a strip round the globe is closed
        turn = (F.col("n") > 1) & (F.col("end") - F.col("first") + 1.5 * (F.col("end") - F.col("first")) / (F.col("n") - 1) >= 360.0)
        pairs = pairs.withColumn("hi", F.coalesce("hi", F.when(turn, F.col("first") + 360.0)))
    pairs = pairs.filter("hi is not null").withColumns({"step": (F.col("end") - F.col("first")) / (F.col("n") - 1), "last": F.col("hi") >= F.col("end")})
    return pairs.withColumn("bin", F.explode(F.sequence(F.floor((F.col("lo") - F.col("first")) / F.col("step")), F.floor((F.col("hi") - F.col("first")) / F.col("step")))))


def grids_bilinear(points: DataFrame, targets: DataFrame, level: int, variables: list[str], ellipsoid: Ellipsoid = SPHERE, min_weight: float = 0.5, near: DataFrame | None = None) -> DataFrame:
    """``grid_bilinear`` for points of any number of rectilinear inputs: input_id, lon, lat, variables.

    Inputs with the same longitudes are bands of one strip, whose rows are in one order: what lies
    between the last row of one band and the first of the next is interpolated between these.
    Strips may overlap or lie side by side; a cell takes the mean of the strips that have a value
    there. Everything is keyed by strip, so that the plan doesn't grow with the inputs. ``near`` has
    those of the points that targets may need; strips and axes are those of all points nonetheless.
    """
    lons = points.groupBy("input_id").agg(F.xxhash64(F.sort_array(F.collect_set("lon"))).alias("strip"))  # an axis of an input
    whole = points.select("input_id", *[F.col(c).cast("double").alias(c) for c in ("lon", "lat")]).join(lons, "input_id")
    xs, ys = _sides(whole, "lon"), _sides(whole, "lat")
    nodes = float32(points if near is None else near, variables).join(lons, "input_id").groupBy("strip", "lon", "lat").agg(*[F.avg(v).alias(v) for v in variables])
    nodes = nodes.withColumns({c: F.col(c).cast("double") for c in ("lon", "lat")})
    closed = lambda v: F.when(F.col("hi") > F.col("end"), F.col("first")).otherwise(v)
    ends = lambda pairs, axis, n: pairs.select("strip", F.col("lo").alias(n), F.explode(F.array(F.struct(F.col("lo").alias(axis), F.lit(1).alias(f"{n}_side")), F.struct(closed(F.col("hi")).alias(axis), F.lit(2).alias(f"{n}_side")))).alias("e")).select("strip", n, "e.*").distinct()
    at = nodes.join(ends(xs, "lon", "x"), ["strip", "lon"]).join(ends(ys, "lat", "y"), ["strip", "lat"])
    corner = lambda v, a, b: F.max(F.when((F.col("x_side") == a) & (F.col("y_side") == b), F.col(v))).alias(f"{v}__{a}{b}")
    meshes = at.groupBy("strip", "x", "y").agg(*[corner(v, a, b) for v in variables for a in (1, 2) for b in (1, 2)])
    # Targets meet the strips that reach their degree of longitude, then one bracket on each axis.
    turned = lambda v: F.pmod(F.floor(v), F.lit(360))
    reach = xs.groupBy("strip").agg(F.min("lo").alias("west"), F.max("hi").alias("east"))
    reach = reach.select("strip", "west", F.explode(F.array_distinct(F.transform(F.sequence(F.floor("west").cast("int"), F.floor("east").cast("int")), lambda d: F.pmod(d, F.lit(360)).cast("long")))).alias("degree"))
    centres = C.with_center(targets.select("cell_id"), level, ellipsoid, lon="c_lon", lat="c_lat").withColumn("degree", turned(F.col("c_lon")))
    placed = centres.join(reach, "degree").withColumn("c_lon", F.col("west") + F.pmod(F.col("c_lon") - F.col("west"), F.lit(360.0))).drop("degree", "west")

    def bracket(df, pairs, c, n):
        stats = pairs.select("strip", "first", "step").distinct()
        binned = df.join(stats, "strip").withColumn("bin", F.floor((F.col(c) - F.col("first")) / F.col("step"))).drop("first", "step")
        hit = binned.join(pairs.select("strip", "bin", "lo", "hi", "last"), ["strip", "bin"]).filter((F.col(c) >= F.col("lo")) & ((F.col(c) < F.col("hi")) | ((F.col(c) == F.col("hi")) & F.col("last"))))
        return hit.select(*[x for x in df.columns if x != c], F.col("lo").alias(n), ((F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias(f"{n}_w"))

    found = bracket(bracket(placed, xs, "c_lon", "x"), ys, "c_lat", "y").join(meshes, ["strip", "x", "y"])
    out = [_blend(v, min_weight).alias(v) for v in variables]
    return found.select("cell_id", *out).groupBy("cell_id").agg(*[F.avg(v).alias(v) for v in variables])


def _blend(v: str, min_weight: float) -> Column:
    """The value between a mesh's corners, if those that have one weigh at least ``min_weight``."""
    valid, total = F.lit(0.0), F.lit(0.0)
    for a in (1, 2):
        for b in (1, 2):
            w, c = (F.col("x_w") if a == 2 else 1 - F.col("x_w")) * (F.col("y_w") if b == 2 else 1 - F.col("y_w")), F.col(f"{v}__{a}{b}")
            valid, total = valid + F.when(c.isNotNull(), w).otherwise(0.0), total + F.coalesce(w * c, F.lit(0.0))
    return F.when(valid >= min_weight, total / valid)


def layer_mean(results: list[DataFrame], variables: list[str]) -> DataFrame:
    """The mean of several layers' values in each cell; missing where all are."""
    both = results[0]
    for r in results[1:]:
        both = both.unionByName(r)
    return nan_to_null(both, *variables).groupBy("cell_id").agg(*[F.avg(v).alias(v) for v in variables])


def per_variable(params: float | dict, variables: list[str], name: str = "parameter") -> dict:
    """A scalar for all variables or one for each; a variable without one is an error."""
    if not isinstance(params, dict):
        return dict.fromkeys(variables, params)
    missing = sorted(set(variables) - set(params))
    if missing:
        raise ValueError(f"{name} is missing for {missing}")
    return {v: params[v] for v in variables}
