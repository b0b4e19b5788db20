"""Point-spread-function resampling: regularised least squares by conjugate gradient, per chunk.

Each observation is modelled as a Gaussian mean of the ``n_cells`` cells nearest to it, with a
width of half a cell; weights are corrected so that their centroid is the observation's place,
which makes the model exact for fields that are linear nearby. Cell values solve
(A'A + lam I) x = A'd. The kernel is this engine's own.
Points of one cell stand for the same nine cells at most, so what they add to A'A and A'd is one
small table for each cell, made where the points are read and added up by an aggregation. The tables
are spread over chunks and their halos, and a task solves one chunk from these sums alone, whose
number the cells of the chunk and its halo bound, however many points there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import cells as C
from ..sources.shared import materialize
from .resample import fields_of, masks

#: Points that a task sorts by cell at once, and those of them that it weighs at once.
SORTED, WEIGHED = 1 << 17, 1 << 13
#: Cells' tables that a task holds before it adds them up, and those it keeps after that before it hands them on.
HELD, FLUSH = 1 << 16, 1 << 15
#: Columns of a table after the weights' products with each of the nine cells: A'd, A'1 and the coverage.
AROUND, COLUMNS = 9, 12


def _solve(i: np.ndarray, j: np.ndarray, ww: np.ndarray, wd: np.ndarray, w: np.ndarray, n: int, lam: float, max_iter: int, tol: float) -> np.ndarray:
    """Conjugate gradient on the normal equations: A'A by its entries i <= j, and A'd and A'1 by cell."""
    off = i != j
    oi, oj, ow = i[off], j[off], ww[off]
    normal = lambda x: np.bincount(i, ww * x[j], n) + np.bincount(oj, ow * x[oi], n)
    # A point's weights have sum 1: this is the mean of the points' values.
    mean = wd.sum() / w.sum() if n else 0.0
    x = np.zeros(n)
    r = wd - mean * w
    p, rr = r.copy(), float(r @ r)
    limit = tol * tol * max(rr, 1e-300)
    for _ in range(max_iter):
        if rr <= limit:
            break
        q = normal(p) + lam * p
        a = rr / float(p @ q)
        x += a * p
        r -= a * q
        new = float(r @ r)
        p, rr = r + new / rr * p, new
    return x + mean


def _packed(x: np.ndarray) -> np.ndarray:
    """Every second bit of each number."""
    x = x & 0x5555555555555555
    for k, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0xFFFFFFFF)):
        x = (x | (x >> k)) & mask
    return x


def _spread(x: np.ndarray) -> np.ndarray:
    for k, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << k)) & mask
    return x


def around(cells: np.ndarray, level: int) -> np.ndarray:
    """Each cell and its eight neighbours, -1 where there is none: as ``cells.with_neighbours`` has them."""
    ns = 1 << level
    inner, face = cells & ((1 << 2 * level) - 1), cells >> (2 * level)
    i, j = _packed(inner), _packed(inner >> 1)
    beyond, turns = np.array(C.FACE_BEYOND), np.array(C.TURN_BEYOND)
    out = [cells]
    for di, dj in C.AROUND:
        x, y = i + di, j + dj
        side = 4 + (x >= ns) * 1 - (x < 0) + 3 * ((y >= ns) * 1 - (y < 0))
        to, turn = beyond[side, face], turns[side, face >> 2]
        x, y = x % ns, y % ns
        x, y = np.where(turn & 1, ns - 1 - x, x), np.where(turn & 2, ns - 1 - y, y)
        x, y = np.where(turn & 4, y, x), np.where(turn & 4, x, y)
        out.append(np.where(to < 0, -1, (to << (2 * level)) + _spread(x) + (_spread(y) << 1)))
    return np.stack(out, axis=1)


def _ecef(sin_lat: np.ndarray, cos_lat: np.ndarray, lon: np.ndarray, e: C.Ellipsoid) -> np.ndarray:
    n = e.a / np.sqrt(1 - e.e2 * sin_lat * sin_lat)
    return np.stack([n * cos_lat * np.cos(lon), n * cos_lat * np.sin(lon), n * (1 - e.e2) * sin_lat], axis=1)


def centres(cells: np.ndarray, level: int, e: C.Ellipsoid) -> np.ndarray:
    """Cell centres in metres, x, y, z: as ``cells.with_center`` has them."""
    inner = cells & ((1 << 2 * level) - 1)
    face = cells >> (2 * level)
    x, y = ((_packed(v) + 0.5) / (1 << level) for v in (inner, inner >> 1))
    ring = np.array(C.RING_OF_FACE)[face] - x - y
    near = np.minimum(1.0, np.minimum(ring, 4 - ring))  # rings from the pole, in the polar caps
    z = np.where(ring < 1, 1 - near * near / 3, np.where(ring > 3, near * near / 3 - 1, (2 - ring) * 2 / 3))
    lon = np.pi / 4 * (np.array(C.PLACE_OF_FACE)[face] * near + x - y) / near
    if not e.e2:
        return _ecef(z, np.sqrt(1 - z * z), lon, e)
    k = math.sqrt(e.e2)
    q = lambda s: (1 - e.e2) * (s / (1 - e.e2 * s * s) + np.arctanh(k * s) / k)
    lat = np.arcsin(z)
    for _ in range(4):  # Newton's steps on q(sin lat) = z q(1)
        s = np.sin(lat)
        lat = lat + (1 - e.e2 * s * s) ** 2 * (z * q(1.0) - q(s)) / (2 * (1 - e.e2) * np.maximum(np.cos(lat), 1e-12))
    return _ecef(np.sin(lat), np.cos(lat), lon, e)


def _near(cells: np.ndarray, level: int) -> np.ndarray:
    """``around``, sorted, each cell once: small levels meet a neighbour twice."""
    near = np.sort(around(cells, level), axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    return near


def _weights(lon: np.ndarray, lat: np.ndarray, near: np.ndarray, of: np.ndarray, level: int, n_cells: int, e: C.Ellipsoid) -> tuple[np.ndarray, np.ndarray]:
    """Centred weights and shares of points, a row for each of the cells in ``near[of]``; 0 for cells beyond the ``n_cells`` nearest."""
    width = e.a * math.sqrt(math.pi / 3) / 2**level  # two sigma
    centre = centres(np.maximum(near, 0).ravel(), level, e).reshape(*near.shape, 3) / width
    centre[near < 0] = 100.0 * 2**level  # so far away that the weight is 0
    lat = np.radians(lat)
    place = _ecef(np.sin(lat), np.cos(lat), np.radians(lon), e) / width
    x, y, z = (np.ascontiguousarray(centre[:, :, a].T)[:, of] - place[:, a] for a in range(3))
    w = np.exp(-2 * (x * x + y * y + z * z))
    if n_cells < near.shape[1]:
        nth = np.lexsort((-near[of], -w.T), axis=-1)
        np.put_along_axis(w, nth[:, n_cells:].T, 0.0, axis=0)
    total = w.sum(axis=0)
    # The slope that makes the first moment around the place vanish, by the second moments' LDL' factors.
    mx, my, mz = w * x, w * y, w * z
    xx, xy, xz, yy, yz, zz = ((m * o).sum(axis=0) for m, o in ((mx, x), (mx, y), (mx, z), (my, y), (my, z), (mz, z)))
    ridge = 1e-6 * (1 + xx + yy + zz)
    d1 = xx + ridge
    l2, l3 = xy / d1, xz / d1
    d2, t = yy + ridge - l2 * xy, yz - l3 * xy
    l4 = t / d2
    d3 = zz + ridge - l3 * xz - l4 * t
    bx = -mx.sum(axis=0)
    by = -my.sum(axis=0) - l2 * bx
    bz = -mz.sum(axis=0) - l3 * bx - l4 * by
    sz = bz / d3
    sy = by / d2 - l4 * sz
    sx = bx / d1 - l2 * sy - l3 * sz
    fixed = w * (1 + sx * x + sy * y + sz * z)
    fixed = np.where(fixed.sum(axis=0) > 0.05 * total, fixed, w)
    return fixed / np.maximum(fixed.sum(axis=0), 1e-300), w / np.maximum(total, 1e-300)


def _links(lon: np.ndarray, lat: np.ndarray, cells: np.ndarray, rows: np.ndarray, level: int, n_cells: int, e: C.Ellipsoid):
    """``_weights`` with the cells of each point side by side, and the cells used: row, cell, centred weight, share."""
    near = np.full((len(lon), AROUND), -1)
    near[rows, np.arange(len(rows)) - np.searchsorted(rows, rows)] = cells
    w, share = (x.T for x in _weights(lon, lat, near, np.arange(len(lon)), level, n_cells, e))
    used = share > 0
    return np.nonzero(used)[0], near[used], w[used], share[used]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where rows sorted by some keys begin a new one."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])
    return new


#: Tables by a number (of a label or a field) and a cell: the numbers, the cells, and a row for each of the nine cells around.
Tables = tuple[np.ndarray, np.ndarray, np.ndarray]


def _added(parts: list[Tables]) -> Tables:
    """Several sets of tables as one with each number and cell once."""
    of, base, values = map(np.concatenate, zip(*parts))
    order = np.lexsort((base, of))
    of, base = of[order], base[order]
    first = np.flatnonzero(_starts(of, base))
    return of[first], base[first], np.add.reduceat(values[order], first, axis=0) if len(of) else values


def _tables(code: np.ndarray, cell: np.ndarray, lon: np.ndarray, lat: np.ndarray, d: np.ndarray, first: np.ndarray, level: int, n_cells: int, e: C.Ellipsoid, right: bool) -> tuple[Tables | None, Tables | None]:
    """What some points add to the equations of the fields that are ``first``, and, if ``right``, to A'd of all variables of a label.

    ``d``, ``first``: a row for each variable; NaN is no value. A field's number is that of its label
    times the number of variables, and its variable's place.
    """
    n_variables = len(d)
    leads = first & ~np.isnan(d)
    pattern = np.zeros(len(code), np.int64)
    for k, row in enumerate(leads):
        pattern = 2 * pattern + row
        if k % 32 == 31:
            pattern = np.unique(pattern, return_inverse=True)[1]
    order = np.lexsort((pattern, cell, code))
    code, cell, lon, lat, pattern, d, leads = code[order], cell[order], lon[order], lat[order], pattern[order], np.nan_to_num(d[:, order]), leads[:, order]
    new = _starts(code, cell)
    place, at = np.flatnonzero(new), np.cumsum(new) - 1
    near = _near(cell[place], level)
    w, share = np.empty((AROUND, len(code))), np.empty((AROUND, len(code)))
    for start in range(0, len(code), WEIGHED):
        s, lo = slice(start, start + WEIGHED), at[start]
        own = near[lo : at[s][-1] + 1]
        w[:, s], share[:, s] = _weights(lon[s], lat[s], own, at[s] - lo, level, n_cells, e)
    to_right = None
    if right:
        values = np.empty((len(place), AROUND, n_variables))
        for x in range(AROUND):
            for k in range(n_variables):
                values[:, x, k] = np.add.reduceat(w[x] * d[k], place)
        to_right = code[place], cell[place], values
    lead = np.flatnonzero(leads.any(axis=0))
    if not len(lead):
        return None, to_right
    if len(lead) < len(code):
        code, cell, pattern, d, leads, w, share = code[lead], cell[lead], pattern[lead], d[:, lead], leads[:, lead], w[:, lead], share[:, lead]
    group = np.flatnonzero(_starts(code, cell, pattern))
    code, cell, leads = code[group], cell[group], leads[:, group]
    shared = np.zeros((len(group), AROUND, COLUMNS))
    for x in range(AROUND):
        for y in range(x, AROUND):
            shared[:, x, y] = np.add.reduceat(w[x] * w[y], group)
        shared[:, x, AROUND + 1], shared[:, x, AROUND + 2] = np.add.reduceat(w[x], group), np.add.reduceat(share[x], group)
    parts = []
    for k in np.flatnonzero(leads.any(axis=1)):
        for x in range(AROUND):
            shared[:, x, AROUND] = np.add.reduceat(w[x] * d[k], group)
        mine = leads[k]
        begin = np.flatnonzero(_starts(code[mine], cell[mine]))
        parts.append((code[mine][begin] * n_variables + k, cell[mine][begin], np.add.reduceat(shared[mine], begin, axis=0)))
    return tuple(map(np.concatenate, zip(*parts))), to_right


def cell_sums(placed: DataFrame, n_variables: int, level: int, n_cells: int, e: C.Ellipsoid, right: bool) -> DataFrame:
    """The sums of ``_tables``, a row for each cell around a cell: equations (or A'd of variables), of, base, x, v0 and on.

    ``placed``: code, cell_id, lon, lat, d0 and on (null: no value), f0 and on (whether that field is first).
    """
    names = ["equations", "of", "base", "x", *[f"v{k}" for k in range(max(COLUMNS, n_variables))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held: dict[bool, list[Tables]] = {True: [], False: []}

        def take():
            column = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in waiting])
            d, first = (np.stack([column(f"{c}{k}").astype(kind) for k in range(n_variables)]) for c, kind in (("d", float), ("f", bool)))
            made = _tables(column("code"), column("cell_id"), column("lon"), column("lat"), d, first, level, n_cells, e, right)
            for kind, tables in zip((True, False), made):
                if tables is not None:
                    held[kind].append(tables)

        def give(kind: bool) -> Iterator[pa.RecordBatch]:
            for start in range(0, len(held[kind][0][0]), WEIGHED):
                of, base, values = (x[start : start + WEIGHED] for x in held[kind][0])
                there = (_near(base, level) >= 0).ravel()
                n = len(base)
                keys = [np.full(n * AROUND, kind), np.repeat(of, AROUND), np.repeat(base, AROUND), np.tile(np.arange(AROUND, dtype=np.int32), n)]
                values = values.reshape(n * AROUND, -1)
                empty = pa.nulls(int(there.sum()), pa.float64())
                sums = [pa.array(values[there, k]) if k < values.shape[1] else empty for k in range(len(names) - 4)]
                yield pa.RecordBatch.from_arrays([*(pa.array(k[there]) for k in keys), *sums], names=names)
            held[kind] = []

        for b in batches:
            if b.num_rows:
                waiting.append(b)
            if sum(b.num_rows for b in waiting) >= SORTED:
                take()
                waiting = []
                for kind in (True, False):
                    if sum(len(t[0]) for t in held[kind]) > HELD:
                        held[kind] = [_added(held[kind])]
                        if len(held[kind][0][0]) > FLUSH:
                            yield from give(kind)
        if waiting:
            take()
        for kind in (True, False):
            if held[kind]:
                held[kind] = [_added(held[kind])]
                yield from give(kind)

    kinds = "equations boolean, of long, base long, x int, " + ", ".join(f"{n} double" for n in names[4:])
    asked = ["code", "cell_id", "lon", "lat", *[f"{c}{k}" for c in "df" for k in range(n_variables)]]
    return placed.select(*asked).mapInArrow(run, kinds).groupBy(*names[:4]).agg(*[F.sum(n).alias(n) for n in names[4:]])


def at_work(scan: DataFrame) -> DataFrame:
    """A scan of few row groups would leave most cores without work."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def _halo(near: np.ndarray, shift: int) -> np.ndarray:
    """The chunks that each row of cells takes part in, each once, -1 for the rest."""
    chunks = np.sort(np.where(near < 0, -1, near >> shift), axis=1)
    chunks[:, 1:][chunks[:, 1:] == chunks[:, :-1]] = -1
    return chunks


def normal_sums(sums: DataFrame, level: int, chunk_level: int) -> DataFrame:
    """A'A of fields by its entries i <= j, and by cell (i = j) A'd, A'1 and the coverage, for each chunk: of, chunk, i, j, ww, wd, w, share.

    ``sums``: ``cell_sums``. A point takes part in every chunk that holds its cell or one around it,
    with all of its cells: the halo.
    """
    shift, names = 2 * (level - chunk_level), ["of", "chunk", "i", "j", "ww", "wd", "w", "share"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            of, base, x = (b.column(c).to_numpy() for c in ("of", "base", "x"))
            values = np.stack([b.column(f"v{k}").to_numpy() for k in range(COLUMNS)], axis=1)
            near = _near(base, level)
            ww, cover = values[:, :AROUND], values[:, AROUND + 2]
            y = np.arange(AROUND)
            # A cell that no point stands for has no equation.
            row, y = np.nonzero((near >= 0) & np.where(y == x[:, None], cover[:, None] > 0, (y > x[:, None]) & (ww != 0)))
            chunks = _halo(near, shift)[row]
            each, c = np.nonzero(chunks >= 0)
            row, y, chunk = row[each], y[each], chunks[each, c]
            own = y == x[row]
            rest = (np.where(own, values[row, AROUND + k], 0.0) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (of[row], chunk, near[row, x[row]], near[row, y], ww[row, y], *rest)], names=names)

    kinds = ", ".join(f"{n} {'long' if n in names[:4] else 'double'}" for n in names)
    entries = sums.filter("equations").select("of", "base", "x", *[f"v{k}" for k in range(COLUMNS)]).mapInArrow(run, kinds)
    return entries.groupBy(*names[:4]).agg(*[F.sum(c).alias(c) for c in names[4:]])


def right_sums(sums: DataFrame, n_variables: int, level: int, chunk_level: int) -> DataFrame:
    """A'd of the variables of labels, in the chunks of ``normal_sums``: code, chunk, i, d0 and on."""
    shift, names = 2 * (level - chunk_level), ["code", "chunk", "i", *[f"d{k}" for k in range(n_variables)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near, x = _near(b.column("base").to_numpy(), level), b.column("x").to_numpy()
            chunks = _halo(near, shift)
            row, c = np.nonzero(chunks >= 0)
            rest = (b.column(f"v{k}").to_numpy()[row] for k in range(n_variables))
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (b.column("of").to_numpy()[row], chunks[row, c], near[row, x[row]], *rest)], names=names)

    kinds = ", ".join(f"{n} {'long' if n in names[:3] else 'double'}" for n in names)
    entries = sums.filter("not equations").select("of", "base", "x", *[f"v{k}" for k in range(n_variables)]).mapInArrow(run, kinds)
    return entries.groupBy(*names[:3]).agg(*[F.sum(c).alias(c) for c in names[3:]])


def psf(points: DataFrame, level: int, chunk_level: int, variable: str, n_cells: int = 9, lam: float = 1e-3, threshold: float = 0.01, max_iter: int = 100, tol: float = 1e-8, ellipsoid: C.Ellipsoid = C.SPHERE) -> DataFrame:
    """cell_id, variable (double) for the cells whose coverage, the sum of their weights, reaches ``threshold``."""
    known = points.select(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.col(variable).cast("float").cast("double").alias("d0")).filter("d0 is not null and not isnan(d0)")
    placed = C.with_cell(at_work(known), level, ellipsoid).filter("cell_id is not null").withColumns({"code": F.lit(0).cast("long"), "f0": F.lit(True)})
    sums = normal_sums(cell_sums(placed, 1, level, n_cells, ellipsoid, right=False), level, chunk_level)
    shift = 2 * (level - chunk_level)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"])
        own = pdf[pdf["i"] == pdf["j"]]  # every cell, in order
        cells = own["i"].to_numpy()
        i, j = np.searchsorted(cells, pdf["i"]), np.searchsorted(cells, pdf["j"])
        x = _solve(i, j, pdf["ww"].to_numpy(), own["wd"].to_numpy(), own["w"].to_numpy(), len(cells), lam, max_iter, tol)
        cover = own["share"].to_numpy()
        mine = (cells >> shift == pdf["chunk"].iloc[0]) & (cover >= threshold)
        return pd.DataFrame({"cell_id": cells[mine], variable: x[mine]})

    return sums.groupBy("chunk").applyInPandas(solve, f"cell_id long, `{variable}` double")


#: Fields that one task solves together.
TOGETHER = 64
#: Labels that are broadcast to the points; beyond, they are joined.
LABELS = 1 << 16


def _solve_many(i: np.ndarray, j: np.ndarray, ww: np.ndarray, wd: np.ndarray, w: np.ndarray, lam: float, max_iter: int, tol: float) -> np.ndarray:
    """``_solve`` for the columns of ``wd`` in step; a column that is done changes no more."""
    n, off = len(w), i != j
    rows, columns, entries = np.concatenate([i, j[off]]), np.concatenate([j, i[off]]), np.concatenate([ww, ww[off]])
    order = np.argsort(rows, kind="stable")
    rows, columns, entries = rows[order], columns[order], entries[order][:, None]
    first = np.searchsorted(rows, np.arange(n))  # every cell has its own entry
    normal = lambda x: np.add.reduceat(entries * x[columns], first, axis=0)
    mean = wd.sum(axis=0) / w.sum()
    x = np.zeros_like(wd)
    r = wd - mean * w[:, None]
    p, rr = r.copy(), (r * r).sum(axis=0)
    limit = tol * tol * np.maximum(rr, 1e-300)
    for _ in range(max_iter):
        go = rr > limit
        if not go.any():
            break
        q = normal(p[:, go]) + lam * p[:, go]
        a = rr[go] / (p[:, go] * q).sum(axis=0)
        x[:, go] += a * p[:, go]
        r[:, go] -= a * q
        new = (r[:, go] * r[:, go]).sum(axis=0)
        p[:, go] = r[:, go] + new / rr[go] * p[:, go]
        rr[go] = new
    return x + mean


def psf_batch(points: DataFrame, level: int, chunk_level: int, variables: list[str], by: tuple[str, ...] = (), n_cells: int = 9, lam: float = 1e-3, threshold: float = 0.01, max_iter: int = 100, tol: float = 1e-8, ellipsoid: C.Ellipsoid = C.SPHERE) -> DataFrame:
    """``psf`` of several variables at all labels of the dimensions ``by``: cell_id, ``by``, variables (double).

    ``points``: input_id, point_idx, lon, lat, ``by``, variables. A point is weighed once for all its
    variables; A'A is made once for all fields that are known at the same points, A'd for all fields
    of a row at once, and a task solves up to ``TOGETHER`` fields of a chunk in step. The plan is the same for any number of labels. A cell
    that a field doesn't cover has null there; one that none covers has no row.
    """
    # Dimensions go by names of their own inside: one of them may be called "variable".
    inside = {c: f"__by{k}" for k, c in enumerate(by)}
    points, by, n = points.withColumnsRenamed(inside), tuple(inside.values()), len(variables)
    known = materialize(masks(points, variables, by))
    leads = [F.coalesce(F.max(F.col("first") & (F.col("variable") == v)), F.lit(False)).alias(f"f{k}") for k, v in enumerate(variables)]
    labels = materialize(known.groupBy(*by).agg(*leads).withColumn("code", F.monotonically_increasing_id()))
    same = reduce(and_, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by], F.lit(True))
    # A field's number is that of its label and its variable; the first field of a mask stands for all of them.
    told = known.alias("l").join(labels.alias("r"), same).select("l.mask", "l.first", "r.code", (F.array_position(F.array(*map(F.lit, variables)), F.col("l.variable")) - 1).alias("k"))
    alike = W.Window.partitionBy("mask")
    told = told.withColumns({"of": F.max(F.when(F.col("first"), F.col("code") * n + F.col("k"))).over(alike), "nth": F.row_number().over(alike.orderBy("code", "k")) - 1})
    told = materialize(told.select("code", "k", "of", F.floor(F.col("nth") / TOGETHER).alias("slice"), F.ceil(F.count(F.lit(1)).over(alike) / TOGETHER).alias("slices")))
    clean = [F.when(~F.isnan(F.col(f"`{v}`").cast("double")), F.col(f"`{v}`").cast("float").cast("double")).alias(f"d{k}") for k, v in enumerate(variables)]
    located = points.filter("lon is not null and lat is not null").select(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), *by, *clean)
    located = C.with_cell(located, level, ellipsoid).filter("cell_id is not null")
    placed = located.alias("l").join(F.broadcast(labels.alias("r")) if labels.count() <= LABELS else labels.alias("r"), same).drop(*by)
    sums = materialize(cell_sums(placed, n, level, n_cells, ellipsoid, right=True))
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"d{k}").alias("wd")) for k in range(n)]))
    right = right_sums(sums, n, level, chunk_level).select("code", "chunk", "i", each.alias("__f")).select("code", "chunk", "i", "__f.*").join(told.drop("slices"), ["code", "k"])
    left = normal_sums(sums, level, chunk_level).drop("wd").join(told.select("of", "slices").distinct(), "of").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices")
    shift = 2 * (level - chunk_level)

    def solve(a: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(d):
            return pd.DataFrame({"cell_id": np.zeros(0, np.int64), "code": np.zeros(0, np.int64), "k": np.zeros(0, np.int64), "value": np.zeros(0)})
        own = a[a["i"] == a["j"]].sort_values("i")
        cells = own["i"].to_numpy()
        i, j = np.searchsorted(cells, a["i"]), np.searchsorted(cells, a["j"])
        fields, of = np.unique(d["code"].to_numpy() * n + d["k"].to_numpy(), return_inverse=True)
        at = np.searchsorted(cells, d["i"].to_numpy())
        there = (at < len(cells)) & (cells[np.minimum(at, len(cells) - 1)] == d["i"].to_numpy())
        wd = np.zeros((len(cells), len(fields)))
        wd[at[there], of[there]] = d["wd"].to_numpy()[there]
        x = _solve_many(i, j, a["ww"].to_numpy(), wd, own["w"].to_numpy(), lam, max_iter, tol)
        mine = (cells >> shift == a["chunk"].iloc[0]) & (own["share"].to_numpy() >= threshold)
        field = np.repeat(fields, int(mine.sum()))
        return pd.DataFrame({"cell_id": np.tile(cells[mine], len(fields)), "code": field // n, "k": field % n, "value": x[mine].T.ravel()})

    solved = left.groupBy("of", "chunk", "slice").cogroup(right.groupBy("of", "chunk", "slice")).applyInPandas(solve, "cell_id long, code long, k long, value double")
    wide = solved.groupBy("cell_id", "code").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(v) for k, v in enumerate(variables)])
    return wide.join(labels.select("code", *by), "code").select("cell_id", *[F.col(c).alias(name) for name, c in inside.items()], *variables)
