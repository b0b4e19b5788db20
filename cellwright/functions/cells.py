"""Cell geometry of the hierarchical equal-area grid (HEALPix, nested ids) as column expressions.

Each function adds columns in a few named steps, so that no expression is repeated inside
another and all of it stays in generated code. A step is SQL text that means the same to Spark
and to other engines; ``steps_sql`` turns the same steps into nested selects for those.

Formulas: Gorski et al. 2005, Calabretta and Roukema 2007; authalic latitude: Snyder 1987, 3-11
and 3-12. Level l has 12 * 4^l cells. On an ellipsoid the grid is laid on the authalic sphere,
which keeps cells equal in area.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LEVEL = 29
#: Mean radius of the Earth in metres, for nominal resolutions.
RADIUS = 6_371_000.0


@dataclass(frozen=True)
class Ellipsoid:
    """Semi-major axis in metres and inverse flattening (infinite: a sphere)."""

    name: str
    a: float
    inverse_flattening: float

    @property
    def e2(self) -> float:
        f = 0.0 if math.isinf(self.inverse_flattening) else 1 / self.inverse_flattening
        return f * (2 - f)


SPHERE = Ellipsoid("sphere", 6_371_000.0, math.inf)
WGS84 = Ellipsoid("WGS84", 6_378_137.0, 298.257223563)
ELLIPSOIDS = {e.name: e for e in (SPHERE, WGS84)}

Steps = list[dict[str, str]]

# For each face its ring (in units of a face side) and its place along the ring.
RING_OF_FACE = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
PLACE_OF_FACE = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)
# The face beyond each side and corner (south, south-east, east, south-west, the
# face itself, north-east, west, north-west, north) of each face; -1 where three faces meet.
FACE_BEYOND = (
    (8, 9, 10, 11, -1, -1, -1, -1, 10, 11, 8, 9),
    (5, 6, 7, 4, 8, 9, 10, 11, 9, 10, 11, 8),
    (-1, -1, -1, -1, 5, 6, 7, 4, -1, -1, -1, -1),
    (4, 5, 6, 7, 11, 8, 9, 10, 11, 8, 9, 10),
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11),
    (1, 2, 3, 0, 0, 1, 2, 3, 5, 6, 7, 4),
    (-1, -1, -1, -1, 7, 4, 5, 6, -1, -1, -1, -1),
    (3, 0, 1, 2, 3, 0, 1, 2, 4, 5, 6, 7),
    (2, 3, 0, 1, -1, -1, -1, -1, 0, 1, 2, 3),
)
# How i and j change on the way there, for north, equatorial and south faces:
# 1 turns i round, 2 turns j round, 4 swaps them.
TURN_BEYOND = ((0, 0, 3), (0, 0, 6), (0, 0, 0), (0, 0, 5), (0, 0, 0), (5, 0, 0), (0, 0, 0), (6, 0, 0), (3, 0, 0))
#: Steps to the eight neighbours: south-west, west, north-west, north, north-east, east, south-east, south.
AROUND = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))

_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def check_level(level: int) -> int:
    if not 0 <= level <= MAX_LEVEL:
        raise ValueError(f"level {level} is not in 0..{MAX_LEVEL}")
    return level


def _q(s: str, e: float) -> str:
    """The authalic function q of a sine, as SQL."""
    e2 = e * e
    return f"({1 - e2!r} * (({s}) / (1e0 - {e2!r} * ({s}) * ({s})) + atanh({e!r} * ({s})) / {e!r}))"


def _q_pole(e: float) -> float:
    return (1 - e * e) * (1 / (1 - e * e) + math.atanh(e) / e)


def _lookup(values: tuple, index: str) -> str:
    """An entry of a small integer table by a zero-based SQL index, without array syntax."""
    text = "".join(f"{v + 1:>3}" for v in values)
    return f"(cast(trim(substr('{text}', cast(3 * ({index}) + 1 as int), 3)) as int) - 1)"


def _spread_steps(names: list[str]) -> Steps:
    return [{n: f"(({n} | ({n} << {k})) & {mask})" for n in names} for k, mask in _SPREAD]


def _pack_steps(names: list[str]) -> Steps:
    """Every second bit of each column, packed: the opposite of spreading."""
    steps = [{n: f"({n} & {_SPREAD[-1][1]})" for n in names}]
    masks = [m for _, m in _SPREAD[:-1]][::-1] + [0xFFFFFFFF]
    for k, mask in zip((1, 2, 4, 8, 16), masks):
        steps.append({n: f"(({n} | ({n} >> {k})) & {mask})" for n in names})
    return steps


def cell_steps(lon: str, lat: str, level: int, ellipsoid: Ellipsoid = SPHERE, out: str = "cell_id") -> Steps:
    """Degrees to the nested id of the cell that holds the point."""
    ns = 1 << check_level(level)
    e = math.sqrt(ellipsoid.e2)
    sine = f"sin(radians({lat}))"
    first = {"q_s": sine, "q_t": f"(({lon}) - 360e0 * floor(({lon}) / 360e0)) / 90e0"}
    z = "q_s" if e == 0 else f"{_q('q_s', e)} / {_q_pole(e)!r}"
    big = lambda x: f"cast({x} as bigint)"
    return [
        first,
        {"q_z": f"greatest(-1e0, least(1e0, {z}))", "q_n": big("least(3e0, floor(q_t))")},
        {"q_m": f"{ns} * sqrt(3e0 * (1e0 - abs(q_z)))", "q_p": "q_t - q_n"},
        {
            "q_a": big(f"case when abs(q_z) <= {2 / 3!r} then floor({ns} * (0.5e0 + q_t) - {0.75 * ns!r} * q_z) else least({ns - 1}e0, floor(q_p * q_m)) end"),
            "q_b": big(f"case when abs(q_z) <= {2 / 3!r} then floor({ns} * (0.5e0 + q_t) + {0.75 * ns!r} * q_z) else least({ns - 1}e0, floor((1e0 - q_p) * q_m)) end"),
        },
        {"q_fa": f"(q_a >> {level})", "q_fb": f"(q_b >> {level})"},
        {
            "q_f": f"case when abs(q_z) <= {2 / 3!r} then (case when q_fa = q_fb then (q_fa & 3) + 4 when q_fa < q_fb then (q_fa & 3) else (q_fb & 3) + 8 end) when q_z > 0 then q_n else q_n + 8 end",
            "q_i": f"case when abs(q_z) <= {2 / 3!r} then (q_b & {ns - 1}) when q_z > 0 then {ns - 1} - q_b else q_a end",
            "q_j": f"case when abs(q_z) <= {2 / 3!r} then {ns - 1} - (q_a & {ns - 1}) when q_z > 0 then {ns - 1} - q_a else q_b end",
        },
        *_spread_steps(["q_i", "q_j"]),
        {out: f"case when ({lon}) is null or ({lat}) is null then null else (q_f << {2 * level}) + q_i + (q_j << 1) end"},
    ]


def _split_steps(cell: str, level: int) -> Steps:
    """Face, i and j of a nested id."""
    return [{"q_f": f"(({cell}) >> {2 * level})", "q_i": f"(({cell}) & {(1 << 2 * level) - 1})", "q_j": f"((({cell}) & {(1 << 2 * level) - 1}) >> 1)"}, *_pack_steps(["q_i", "q_j"])]


def _place_steps(level: int, di: float | str, dj: float | str, ellipsoid: Ellipsoid, lon: str, lat: str) -> Steps:
    """Degrees of the place (i + di, j + dj) on a face; di and dj are numbers or SQL."""
    ns = float(1 << level)
    di, dj = (d if isinstance(d, str) else f"{d!r}e0" for d in (di, dj))
    e2 = ellipsoid.e2
    steps: Steps = [
        {"q_x": f"(q_i + {di}) / {ns!r}e0", "q_y": f"(q_j + {dj}) / {ns!r}e0"},
        {"q_r": f"{_lookup(RING_OF_FACE, 'q_f')} - q_x - q_y"},
        {"q_n": "case when q_r < 1e0 then q_r when q_r > 3e0 then 4e0 - q_r else 1e0 end"},
        {
            "q_z": "case when q_r < 1e0 then 1e0 - q_n * q_n / 3e0 when q_r > 3e0 then q_n * q_n / 3e0 - 1e0 else (2e0 - q_r) * 2e0 / 3e0 end",
            "q_l": f"case when q_n < 1e-15 then 0e0 else 45e0 * ({_lookup(PLACE_OF_FACE, 'q_f')} * q_n + q_x - q_y) / q_n end",
        },
        {lon: "q_l - 360e0 * floor((q_l + 180e0) / 360e0)", "q_w": "asin(greatest(-1e0, least(1e0, q_z)))"},
    ]
    if e2 == 0:
        return [*steps, {lat: "degrees(q_w)"}]
    e = math.sqrt(e2)
    a, b, c = e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360
    pole = _q_pole(e)
    return [
        *steps,
        {"q_w": f"q_w + {a!r} * sin(2e0 * q_w) + {b!r} * sin(4e0 * q_w) + {c!r} * sin(6e0 * q_w)"},
        {"q_s": "sin(q_w)"},
        # One Newton step on q(sin w) = z q(1); the series is good to 1e-9 already.
        {"q_w": f"case when abs(q_s) > 0.9999999e0 then q_w else q_w + (1e0 - {e2!r} * q_s * q_s) * (1e0 - {e2!r} * q_s * q_s) * ({pole!r} * q_z - {_q('q_s', e)}) / ({2 * (1 - e2)!r} * cos(q_w)) end"},
        {lat: "degrees(q_w)"},
    ]


def center_steps(cell: str, level: int, ellipsoid: Ellipsoid = SPHERE, lon: str = "lon", lat: str = "lat") -> Steps:
    return [*_split_steps(cell, check_level(level)), *_place_steps(level, 0.5, 0.5, ellipsoid, lon, lat)]


#: Corners of a cell as (di, dj): south, east, north, west.
CORNERS = ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))


def vertex_steps(cell: str, level: int, ellipsoid: Ellipsoid = SPHERE) -> Steps:
    """Columns lon0, lat0 to lon3, lat3: the corners south, east, north and west."""
    out = _split_steps(cell, check_level(level))
    for k, (di, dj) in enumerate(CORNERS):
        out += _place_steps(level, di, dj, ellipsoid, f"lon{k}", f"lat{k}")
    return out


def edge_steps(cell: str, level: int, corner: str, step: int, ellipsoid: Ellipsoid = SPHERE, lon: str = "lon", lat: str = "lat") -> Steps:
    """The place number ``corner`` of 4 ``step`` along a cell's edge, from south by east, north and west."""
    part = f"({corner} % {step}) * 1e0 / {step}e0"
    return [
        {"q_t": part, "q_e": f"cast(floor({corner} * 1e0 / {step}e0) as int)"},
        {"q_di": "case q_e when 0 then q_t when 1 then 1e0 when 2 then 1e0 - q_t else 0e0 end", "q_dj": "case q_e when 0 then 0e0 when 1 then q_t when 2 then 1e0 else 1e0 - q_t end"},
        *_split_steps(cell, check_level(level)), *_place_steps(level, "q_di", "q_dj", ellipsoid, lon, lat),
    ]


def neighbour_steps(cell: str, level: int, out: str = "n") -> Steps:
    """Columns n0 to n7 (south-west, then clockwise to south): the neighbours, -1 where none is."""
    ns = 1 << check_level(level)
    steps = _split_steps(cell, level)
    a, b, c, d = {}, {}, {}, {}
    for k, (di, dj) in enumerate(AROUND):
        a |= {f"q_x{k}": f"q_i + {di}", f"q_y{k}": f"q_j + {dj}"}
        b[f"q_b{k}"] = f"4 + (case when q_x{k} < 0 then -1 when q_x{k} >= {ns} then 1 else 0 end) + 3 * (case when q_y{k} < 0 then -1 when q_y{k} >= {ns} then 1 else 0 end)"
        flat = tuple(v for row in FACE_BEYOND for v in row)
        c[f"q_f{k}"] = f"cast({_lookup(flat, f'12 * q_b{k} + q_f')} as bigint)"
        turns = tuple(v for row in TURN_BEYOND for v in row)
        c[f"q_t{k}"] = _lookup(turns, f"3 * q_b{k} + (q_f >> 2)")
        c |= {f"q_x{k}": f"((q_x{k} + {ns}) & {ns - 1})", f"q_y{k}": f"((q_y{k} + {ns}) & {ns - 1})"}
    steps += [a, b, c]
    for k in range(8):
        d |= {f"q_x{k}": f"case when (q_t{k} & 1) <> 0 then {ns - 1} - q_x{k} else q_x{k} end", f"q_y{k}": f"case when (q_t{k} & 2) <> 0 then {ns - 1} - q_y{k} else q_y{k} end"}
    steps.append(d)
    steps.append({x: e for k in range(8) for x, e in ((f"q_u{k}", f"case when (q_t{k} & 4) <> 0 then q_y{k} else q_x{k} end"), (f"q_v{k}", f"case when (q_t{k} & 4) <> 0 then q_x{k} else q_y{k} end"))})
    steps += _spread_steps([f"q_{x}{k}" for k in range(8) for x in "uv"])
    steps.append({f"{out}{k}": f"case when q_f{k} < 0 then -1 else (q_f{k} << {2 * level}) + q_u{k} + (q_v{k} << 1) end" for k in range(8)})
    return steps


def ring_steps(cell: str, level: int, out: str = "ring_id") -> Steps:
    """Nested id to ring id, which counts along circles of latitude from the north."""
    ns = 1 << check_level(level)
    return [
        *_split_steps(cell, level),
        {"q_r": f"{_lookup(RING_OF_FACE, 'q_f')} * cast({ns} as bigint) - q_i - q_j - 1"},
        {"q_n": f"case when q_r < {ns} then q_r when q_r > {3 * ns} then {4 * ns} - q_r else cast({ns} as bigint) end", "q_k": f"case when q_r < {ns} or q_r > {3 * ns} then 0 else ((q_r - {ns}) & 1) end"},
        {"q_p": f"({_lookup(PLACE_OF_FACE, 'q_f')} * q_n + q_i - q_j + 1 + q_k) >> 1"},
        {"q_p": "case when q_p > 4 * q_n then q_p - 4 * q_n when q_p < 1 then q_p + 4 * q_n else q_p end"},
        {out: f"case when q_r < {ns} then 2 * q_r * (q_r - 1) + q_p - 1 when q_r > {3 * ns} then {12 * ns * ns} - 2 * q_n * (q_n + 1) + q_p - 1 else {2 * ns * (ns - 1)} + (q_r - {ns}) * {4 * ns} + q_p - 1 end"},
    ]


def zuniq(cell: str, level: int) -> str:
    """A number that holds both level and nested id and sorts along the curve at mixed levels."""
    return f"((2 * ({cell}) + 1) << {2 * (MAX_LEVEL - check_level(level))})"


def zuniq_level(z: str) -> str:
    """The level of a zuniq number: from its lowest bit that is set."""
    return f"cast({MAX_LEVEL} - round(log2(cast(({z}) & -({z}) as double))) / 2 as int)"


def add_steps(df: DataFrame, steps: Steps, keep: list[str]) -> DataFrame:
    """Run the steps and keep ``keep`` besides the frame's own columns.

    The results leave through ``inline``: a filter on them stays above it, where it is evaluated
    on ready values. Pushed down through the steps it would copy each step into the next, again
    and again. Filters on the frame's own columns still go down to the scan.
    """
    own = [c for c in df.columns if c not in keep]
    for step in steps:
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    return df.select(*[F.col(f"`{c}`") for c in own], F.inline(F.array(F.struct(*keep))))


def steps_sql(source: str, steps: Steps, keep: list[str]) -> str:
    """The same as one SQL text over ``source`` (a table or a select in brackets)."""
    sql, seen = source, set()
    for i, step in enumerate(steps):
        again = seen & set(step)
        star = f"* exclude ({', '.join(sorted(again))})" if again else "*"
        sql = f"(select {star}, {', '.join(f'{e} as {n}' for n, e in step.items())} from {sql} s{i})"
        seen |= set(step)
    gone = sorted(seen - set(keep))
    return f"(select * exclude ({', '.join(gone)}) from {sql} t)" if gone else sql


def with_cell(df: DataFrame, level: int, ellipsoid: Ellipsoid = SPHERE, lon: str = "lon", lat: str = "lat", out: str = "cell_id") -> DataFrame:
    return add_steps(df, cell_steps(lon, lat, level, ellipsoid, out), [out])


def with_center(df: DataFrame, level: int, ellipsoid: Ellipsoid = SPHERE, cell: str = "cell_id", lon: str = "lon", lat: str = "lat") -> DataFrame:
    return add_steps(df, center_steps(cell, level, ellipsoid, lon, lat), [lon, lat])


def with_vertices(df: DataFrame, level: int, ellipsoid: Ellipsoid = SPHERE, cell: str = "cell_id") -> DataFrame:
    return add_steps(df, vertex_steps(cell, level, ellipsoid), [f"{c}{k}" for k in range(4) for c in ("lon", "lat")])


def with_edge(df: DataFrame, level: int, step: int = 1, ellipsoid: Ellipsoid = SPHERE, cell: str = "cell_id") -> DataFrame:
    """A row for each of 4 ``step`` places along the cell's edge: corner, lon, lat."""
    places = df.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit(4 * step - 1))))
    return add_steps(places, edge_steps(cell, level, "corner", step, ellipsoid), ["lon", "lat"])


def with_ring_id(df: DataFrame, level: int, cell: str = "cell_id", out: str = "ring_id") -> DataFrame:
    return add_steps(df, ring_steps(cell, level, out), [out])


def with_neighbours(df: DataFrame, level: int, cell: str = "cell_id", out: str = "neighbours") -> DataFrame:
    """An array of eight ids, -1 where there is no neighbour."""
    names = [f"n{k}" for k in range(8)]
    return add_steps(df, [*neighbour_steps(cell, level), {out: f"array({', '.join(names)})"}], [out])


def parent(cell: str, levels: int) -> str:
    """The ancestor ``levels`` levels up, as SQL."""
    return f"(({cell}) >> {2 * levels})"


def children(df: DataFrame, levels: int, cell: str = "cell_id", out: str = "child_id") -> DataFrame:
    """A row for each of the 4^levels descendants."""
    first = F.col(cell) * F.lit(4**levels)
    return df.withColumn(out, F.explode(F.sequence(first, first + F.lit(4**levels - 1))))


def where_parent(df: DataFrame, ancestor: int, levels: int, cell: str = "cell_id") -> DataFrame:
    """Descendants of a cell, by a range that Parquet statistics can use (a shift could not)."""
    low = ancestor << (2 * levels)
    return df.filter(F.col(cell).between(low, low + (1 << (2 * levels)) - 1))


def kth_ring(df: DataFrame, level: int, ring: int = 1, cell: str = "cell_id") -> DataFrame:
    """Distinct cells within ``ring`` steps of any cell, the cells themselves included."""
    out = df.select(F.col(cell).cast("long").alias("cell_id")).distinct()
    for _ in range(ring):
        near = with_neighbours(out, level)
        out = near.select(F.explode(F.concat(F.array("cell_id"), "neighbours")).alias("cell_id")).filter("cell_id >= 0").distinct()
    return out


def resolution_level(metres: float, rounding: str = "round") -> int:
    """The level whose nominal cell size is nearest to (or no finer / coarser than) a resolution."""
    exact = math.log2(RADIUS * math.sqrt(math.pi / 3) / metres)
    return {"round": round, "floor": math.floor, "ceil": math.ceil}[rounding](exact)


def resolution_level_sql(metres: str, rounding: str = "round") -> str:
    """The same as Spark SQL; ties go to the even level."""
    exact = f"log2({RADIUS * math.sqrt(math.pi / 3)!r} / ({metres}))"
    return f"cast({ {'round': 'bround', 'floor': 'floor', 'ceil': 'ceil'}[rounding]}({exact}) as int)"


#: The narrowest one-cell ring is this share of the nominal cell size.
NARROWEST = 0.65


def ring_level(buffer: float) -> int:
    """The finest level whose narrowest one-cell ring is at least ``buffer`` metres wide."""
    if buffer <= 0:
        return MAX_LEVEL
    return max(0, min(MAX_LEVEL, math.floor(math.log2(RADIUS * math.sqrt(math.pi / 3) / (buffer / NARROWEST)))))


def chunk_ring(spark, chunk: int, chunk_level: int, level: int) -> DataFrame:
    """Cells at ``level`` that a chunk consists of (or lies in), and one ring around them, sorted."""
    if level >= chunk_level:
        n = 4 ** (level - chunk_level)
        own = spark.range(chunk * n, (chunk + 1) * n).withColumnRenamed("id", "cell_id")
    else:
        own = spark.range(chunk >> (2 * (chunk_level - level)), (chunk >> (2 * (chunk_level - level))) + 1).withColumnRenamed("id", "cell_id")
    return kth_ring(own, level).orderBy("cell_id")


def whole_sphere(spark, level: int) -> DataFrame:
    return spark.range(12 * 4 ** check_level(level)).withColumnRenamed("id", "cell_id")
