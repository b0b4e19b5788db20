"""The staged conversion: plan, prepare, convert, pyramids, finalize, and all of them in one call.

A plan is plain data that goes through JSON to other jobs; inputs are opened again from their
paths. What a step does to data is a DataFrame, and chunks are partitions that Spark schedules.
"""

from __future__ import annotations

import dataclasses
import json
import logging
import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .. import __version__
from ..functions import cells as C
from ..operators import align, psf, pyramid, resample, select
from ..sources import grids, sinks
from ..sources.links import stored_neighbours
from . import metadata
from .settings import Group, Settings

log = logging.getLogger("cellwright")


@dataclass(frozen=True)
class Plan:
    inputs: tuple[str, ...]
    groups: tuple[str, ...]
    settings: Settings
    extent: tuple[float, float, float, float] = (-180.0, -90.0, 180.0, 90.0)
    #: The corners of a polygon within the extent, if the output is to cover no more.
    polygon: tuple[tuple[float, float], ...] | None = None

    def to_json(self) -> str:
        return json.dumps({"inputs": self.inputs, "groups": self.groups, "extent": self.extent, "polygon": self.polygon, "settings": self.settings.to_dict()}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "Plan":
        d = json.loads(text)
        polygon = d.get("polygon")
        return cls(tuple(d["inputs"]), tuple(d["groups"]), Settings.from_dict(d["settings"]), tuple(d["extent"]), polygon and tuple(map(tuple, polygon)))

    def covered(self, spark: SparkSession, level: int, ellipsoid: C.Ellipsoid) -> DataFrame:
        """The cells of a level that the output has."""
        if self.polygon:
            return select.polygon_coverage(spark, self.polygon, level, ellipsoid).select("cell_id")
        return select.coverage(spark, select.Extent(*self.extent), level, ellipsoid).select("cell_id")


def plan(inputs: Sequence[str], settings: Settings, groups: Sequence[str], match: str | Sequence[str] | None = None, extent=None) -> Plan:
    """Check groups and settings against each other before anything is read."""
    chosen = [g for g in grids.select_groups(groups, match, settings.exclude_groups) if g not in settings.copies]
    for g in chosen:
        settings.for_group(g)
    box = select.Extent.of(extent) if extent is not None else select.Extent(-180.0, -90.0, 180.0, 90.0)
    return Plan(tuple(inputs), tuple(chosen), settings, dataclasses.astuple(box), select.outline(extent))


def of_inputs(spark: SparkSession, p: Plan) -> Plan:
    """The plan with the extent of its inputs' points, instead of the one it has: regional inputs give a regional output.

    Inputs in a projection count by their degrees. The box is half a cell wider than the points.
    """
    boxes = []
    for group in p.groups:
        pts, _ = _points(spark, p, group, p.settings.for_group(group))
        margin = math.degrees(math.sqrt(math.pi / 3) / 2 ** p.settings.for_group(group).grid.level) / 2
        boxes.append(pts.select("lon", "lat", F.lit(margin).alias("margin")))
    every = reduce(DataFrame.unionByName, boxes)
    box, margin = grids.extents(every).first(), every.agg(F.max("margin")).first()[0]  # one row each
    if box is None:
        return p
    wide = box["east"] - box["west"] + 2 * margin >= 360.0
    south, north = max(-90.0, box["south"] - margin), min(90.0, box["north"] + margin)
    return dataclasses.replace(p, extent=(-180.0 if wide else box["west"] - margin, south, 180.0 if wide else box["east"] + margin, north), polygon=None)


def chunks(spark: SparkSession, p: Plan, group: str) -> DataFrame:
    """Chunk ids of a group, ascending; one chunk 0 where there is no chunking."""
    g = p.settings.for_group(group)
    if g.chunks.level is None:
        return spark.range(1).withColumnRenamed("id", "cell_id")
    return p.covered(spark, g.chunks.level, C.ELLIPSOIDS[g.grid.ellipsoid]).orderBy("cell_id")


def _points(spark: SparkSession, p: Plan, group: str, g: Group) -> tuple[DataFrame, str]:
    """The points of all inputs, and how they are placed."""
    frames = [grids.drop_variables(grids.open_group(spark, path, group), g.drop) for path in p.inputs]
    at = grids.group_spatial(group, frames)
    if at is None:
        raise ValueError(f"group {group!r} has no coordinates")
    frames = [grids.located(f, at, i) for i, f in enumerate(frames)]
    dims = [x.name for x in g.extra]
    for name in {c for f in frames for c in f.columns if (f.schema[c].metadata or {}).get("dimension")} - {*dims}:
        align.check_compatible(frames, name)
    for extra in g.extra:
        for f in frames:
            if extra.name not in f.columns:
                raise ValueError(f"an input of {group!r} has no coordinate {extra.name!r}")
        frames = align.align(frames, extra.name, extra.mode, list(extra.labels) if extra.labels else None)
    return align.union_points([f.drop("input_id") for f in frames]), at.kind


def _chosen(ids: list[int], indices: Iterable[int] | None) -> list[int]:
    if indices is None:
        return ids
    indices = list(indices)
    if any(not 0 <= i < len(ids) for i in indices):
        raise IndexError(f"a chunk index is out of range 0..{len(ids) - 1}")
    return [ids[i] for i in indices]


def resampler(name: str) -> Callable:
    made = {
        "nearest": lambda pts, cells, g, vs, e, **kw: resample.nearest(pts, cells, g.grid.level, vs, e, **kw),
        "k-nearest": lambda pts, cells, g, vs, e, **kw: resample.inverse_distance(pts, cells, g.grid.level, vs, int(g.resampler.params.get("k", 4)), e, keep_type=True, **kw),
        "bilinear": lambda pts, cells, g, vs, e, **kw: resample.inverse_distance(pts, cells, g.grid.level, vs, int(g.resampler.params.get("k", 4)), e, float(g.resampler.params.get("threshold", 0.0)), **kw),
        "grid-bilinear": lambda pts, cells, g, vs, e, **kw: resample.grids_bilinear(pts, cells, g.grid.level, vs, e, float(g.resampler.params.get("min_weight", 0.5)), **kw),
        "cell-point": lambda pts, cells, g, vs, e: resample.cell_point(pts, vs, e),
        "nn": lambda pts, cells, g, vs, e: _by_variable(lambda v: resample.fill_gaps(resample.bin_mean(pts, g.grid.level, [v], e), g.grid.level, v).join(cells, "cell_id", "left_semi"), vs),
        "psf": lambda pts, cells, g, vs, e, **kw: psf.psf_batch(pts, g.grid.level, _solved_at(g), vs, ellipsoid=e, **_per_call(g, vs), **kw).join(cells, "cell_id", "left_semi"),
    }
    if name not in made:
        raise ValueError(f"resampler {name!r} is not available here")
    return made[name]


def _solved_at(g: Group) -> int:
    """The level of the cells that a point-spread function is solved in: the chunks', else five levels up."""
    return g.chunks.level if g.chunks.level is not None else max(0, g.grid.level - 5)


def _per_call(g: Group, variables: list[str]) -> dict:
    """A resampler's parameters as one call for all variables takes them."""
    out = {}
    for name, value in g.resampler.params.items():
        each = set(resample.per_variable(value, variables, name).values())
        if len(each) > 1:
            raise ValueError(f"parameter {name!r} must be the same for all variables")
        out[name] = each.pop()
    return out


def _by_variable(f: Callable[[str], DataFrame], variables: list[str]) -> DataFrame:
    return pyramid.merge_levels([f(v) for v in variables])


#: Resamplers whose links depend on places alone: one search serves all labels, and can be stored.
BY_LINKS = ("nearest", "k-nearest", "bilinear")


#: No cell reaches further than this many nominal sizes: what a resampler takes from the cells around.
CELL_REACH = 2.4


def _grid_step(pts: DataFrame) -> tuple[float, float]:
    """The largest steps of the inputs' axes in degrees, the way round the globe included."""
    out = []
    for c in ("lon", "lat"):
        by = W.Window.partitionBy("input_id").orderBy(c)
        steps = pts.select("input_id", F.col(c).cast("double").alias(c)).distinct().withColumn("d", F.lead(c).over(by) - F.col(c))
        out.append(1.5 * (steps.agg(F.max("d")).first()[0] or 0.0))
    return tuple(out)


def convert_group(spark: SparkSession, p: Plan, group: str, chunk_indices: Iterable[int] | None = None, links: str | None = None) -> DataFrame:
    """The cells of a group, of all its chunks or some: chunk_id, cell_id, variables.

    Dense chunks hold all their cells (missing: the fill), sparse ones those with points. ``links``
    is a folder where neighbour links are kept for later runs over the same points and cells. Some
    chunks come out as they do among all: neighbours that may lie further away than the buffer are
    looked for among all points, grids are cut by windows a grid step wider, and where cells around
    a chunk matter their points are read too.
    """
    g = p.settings.for_group(group)
    e = C.ELLIPSOIDS[g.grid.ellipsoid]
    pts, kind = _points(spark, p, group, g)
    dims = tuple(x.name for x in g.extra)
    variables = [c for c in pts.columns if c not in ("input_id", "point_idx", "lon", "lat", *dims)]
    level, method = g.grid.level, g.resampler.name
    size = e.a * math.sqrt(math.pi / 3) / 2**level
    near, reach = None, 0.0
    if g.chunks.level is None:
        wanted = p.covered(spark, level, e)
    else:
        ids = _chosen([r[0] for r in chunks(spark, p, group).collect()], chunk_indices)  # chunks are few: jobs are dealt by them
        frame = spark.createDataFrame([(i,) for i in ids], "cell_id long")
        if chunk_indices is not None:
            reach = max(g.chunks.buffer, {"psf": CELL_REACH, "nn": CELL_REACH}.get(method, 4.0 if method in BY_LINKS else 0.0) * size)
            near = select.near_chunks(pts, frame, g.chunks.level, reach, e, kind, _grid_step(pts) if method == "grid-bilinear" else (0.0, 0.0))
        wanted = C.children(frame, level - g.chunks.level).select(F.col("child_id").alias("cell_id"))
    # Labels are few, and those of all points. Where all have the same points, they are worked on together.
    here = [F.count(F.lit(1)).alias("__n"), F.bit_xor(F.xxhash64("input_id", "point_idx", "lon", "lat")).alias("__h")]
    slices = pts.groupBy(*dims).agg(*here).collect() if dims else []
    together = method == "psf" or method in BY_LINKS and len({(s["__n"], s["__h"]) for s in slices}) <= 1
    out = None
    for labels in [{}] if together or not dims else [{d: s[d] for d in dims} for s in slices]:
        of = lambda df: df.filter(reduce(and_, [F.col(d).eqNullSafe(F.lit(v)) for d, v in labels.items()], F.lit(True)))  # noqa: E731, B023
        part, close, by = of(pts), None if near is None else of(near), dims if together else ()
        kw: dict = {}
        if method in BY_LINKS:
            kw["by"] = by
            k = 1 if method == "nearest" else int(g.resampler.params.get("k", 4))
            at = resample.places(part, by or dims)
            if links is not None:
                kw["links"] = stored_neighbours(at, wanted, level, k, links, e)
            elif close is not None:
                kw["links"] = resample.chunk_neighbours(at, resample.places(close, by or dims), reach, wanted, level, k, e)
        elif method == "grid-bilinear":
            kw["near"] = close
        elif close is not None:
            part = close
        if method == "psf":
            kw["by"] = by
        one = resampler(method)(part, wanted, g, variables, e, **kw)
        if g.chunks.kind == "sparse":  # by chunk: fine cells of a chunk are too many to list
            one = one.withColumn("__chunk", F.expr(C.parent("cell_id", level - g.chunks.level))).join(frame.select(F.col("cell_id").alias("__chunk")), "__chunk", "left_semi").drop("__chunk")
        elif method != "cell-point":
            cells = wanted.withColumn("__of", F.explode(F.array(*[F.struct(*[F.lit(s[d]).alias(d) for d in dims]) for s in slices]))).select("cell_id", "__of.*") if by else wanted
            one = resample.dense(one, cells, by=by)
        one = one.withColumns({d: F.lit(v) for d, v in labels.items()})
        out = one if out is None else out.unionByName(one)
    if g.resampler.dtype:
        out = out.withColumns({v: pyramid.half_precision(F.col(v)) if g.resampler.dtype == "float16" else F.col(v).cast(g.resampler.dtype) for v in variables})
    out = out.withColumn("chunk_id", sinks.chunk_column(level, g.chunks.level))
    if g.chunks.kind == "sparse":
        resample.check_chunk_size(out, level, g.chunks.level, g.chunks.chunk_size)
    return out.select("chunk_id", "cell_id", *dims, *variables)


def prepare(spark: SparkSession, p: Plan, output: str, dry_run: bool = False) -> dict[str, dict]:
    """Check copied tables, and the metadata of all groups; written unless it is a dry run."""
    documents: dict[str, dict] = {"": {"settings": p.settings.to_dict(), "provenance": metadata.provenance(p.settings.to_dict(), p.inputs, __version__)}}
    for g in p.groups:
        at = ""
        for part in g.split("/")[:-1]:
            at = f"{at}/{part}".strip("/")
            documents.setdefault(at, {})
        grid = p.settings.for_group(g).grid
        cf = p.settings.convention("cf")
        documents[g] = ({"dggs": metadata.grid_attributes(grid)} if p.settings.convention("dggs") else {}) | ({"grid_mapping": metadata.cf_grid_mapping(grid)} if cf and cf.grid_mapping else {})
    for path, pyr in p.settings.pyramids.items() if p.settings.convention("multiscales") else ():
        native = spark.createDataFrame([("*", l) for l in p.settings.native(path)], "variable string, level int")
        derived = metadata.source_levels(native, pyr.levels).select("variable", "level", F.col("nearest" if pyr.source == "nearest" else "finest").alias("source"))
        assets = metadata.layout(native, derived, "group" if pyr.asset_type == "auto" else pyr.asset_type)
        documents.setdefault(path, {})["multiscales"] = json.loads(metadata.layout_document(assets, pyr.reduce if isinstance(pyr.reduce, str) else None))
    for copy in p.settings.copies:
        table = align.copy_table([grids.open_group(spark, i, copy) for i in p.inputs], list(p.settings.copy_drop))
        documents.setdefault(copy, {})
        if not dry_run:
            table.write.mode("overwrite").parquet(f"{output}/{copy}")
    if not dry_run:
        rows = [(k, json.dumps(v, sort_keys=True, default=str)) for k, v in documents.items()]
        spark.createDataFrame(rows, "path string, json string").coalesce(1).write.mode("overwrite").parquet(f"{output}/_metadata")
    return documents


def pyramids(spark: SparkSession, p: Plan, output: str, write: bool = True) -> dict[str, dict[int, DataFrame]]:
    """Derived levels of every pyramid from the written native ones."""
    out: dict[str, dict[int, DataFrame]] = {}
    for path, pyr in p.settings.pyramids.items():
        native, made = p.settings.native(path), {}
        frames = {l: sinks.read_cells(spark, f"{output}/{_where(p, path, l)}").drop("chunk_id") for l in native}
        keys = tuple(dict.fromkeys(x.name for g in native.values() for x in g.extra))  # extra dimensions stay
        coarsest = pyramid.coarsest_whole_level(frames[min(native)].select("cell_id").distinct(), min(native))
        chunk = next(iter(native.values())).chunks.level
        for level in sorted(pyr.levels, reverse=True):
            if level < coarsest:
                raise ValueError(f"level {level} of {path!r} is coarser than the converted area allows ({coarsest})")
            sources: dict[int, list[str]] = {}
            have = {l: [c for c in f.columns if c != "cell_id" and c not in keys] for l, f in frames.items()}
            for v in sorted({v for vs in have.values() for v in vs}):
                sources.setdefault(pyramid.source_level(have, v, level, pyr.source == "nearest"), []).append(v)
            parts = [pyramid.coarsen(frames[l].select("cell_id", *keys, *vs), l, level, pyr.reduce, keys) for l, vs in sorted(sources.items())]
            made[level] = pyramid.merge_levels(parts, keys=keys)
            if write:
                at = pyramid.derived_chunk_level(level, max(native), chunk, coarsest) if pyr.chunk_offset is None else pyramid.chunk_and_shard_levels(level, pyr.chunk_offset, pyr.shard_level, coarsest)[0]
                sinks.write_cells(made[level], f"{output}/{path}/{level}", level, at)
        out[path] = made
    return out


def _where(p: Plan, path: str, level: int) -> str:
    return next(n for n, g in p.settings.groups.items() if g.grid.level == level and n.rpartition("/")[0] == path)


def finalize(spark: SparkSession, p: Plan, output: str) -> DataFrame:
    """One metadata document for each consolidated root, written beside the groups."""
    documents = spark.read.parquet(f"{output}/_metadata")
    known = {r["path"] for r in documents.select("path").collect()}  # groups are few
    for root in p.settings.consolidate:
        if root not in known:
            log.warning("no group %r to consolidate", root)
    out = metadata.consolidate(documents, [r for r in p.settings.consolidate if r in known])
    out.write.mode("overwrite").parquet(f"{output}/_consolidated")
    return out


def run(spark: SparkSession, inputs: Sequence[str], settings: Settings, groups: Sequence[str], output: str, match=None, extent=None, dry_run: bool = False) -> dict[str, dict]:
    """All stages in one call. A dry run plans and describes, and writes nothing.

    ``extent`` is a box, a GeoJSON geometry or "inputs", which takes that of the inputs' points.
    Variables that have values in the inputs and none in the output get a warning.
    """
    p = plan(inputs, settings, groups, match, None if extent == "inputs" else extent)
    if extent == "inputs":
        p = of_inputs(spark, p)
    documents = prepare(spark, p, output, dry_run)
    if dry_run:
        return documents
    for g in p.groups:
        s = settings.for_group(g)
        made = convert_group(spark, p, g)
        seen = Observation()  # counted while the cells are written
        variables = [c for c in made.columns if c not in ("chunk_id", "cell_id", *(x.name for x in s.extra))]
        have = lambda v: F.count(F.when(F.col(f"`{v}`").isNotNull() & ~F.isnan(F.col(f"`{v}`").cast("double")), 1)).alias(v)
        if variables:
            made = made.observe(seen, *map(have, variables))
        sinks.write_cells(made, f"{output}/{g}", s.grid.level, s.chunks.level, s.chunks.shard_level)
        empty = [v for v in variables if not seen.get[v]]
        if empty:  # only then the inputs are looked at
            before = _points(spark, p, g, s)[0].agg(*map(have, empty)).first()
            for v in empty:
                if before[v]:
                    log.warning("variable %r of %r has values in the inputs and none in the output", v, g)
    pyramids(spark, p, output)
    finalize(spark, p, output)
    return documents
