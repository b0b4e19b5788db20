"""Projected coordinates: affine pixel positions and the transverse Mercator projection both ways.

It is Krueger's series of order six, as column expressions; the coefficients are those of Karney
(2011), computed from the ellipsoid.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import WGS84, Ellipsoid
from .crs import TransverseMercator

SCALE, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500_000.0, 10_000_000.0


def normalise_longitude(lon: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def pixel_to_xy(df: DataFrame, transform: tuple[float, ...], row: str = "row", col: str = "col", center: bool = True) -> DataFrame:
    """x and y of pixels from (a, b, c, d, e, f): x = a col + b row + c, y = d col + e row + f."""
    a, b, c, d, e, f = transform[:6]
    half = 0.5 if center else 0.0
    i, j = F.col(row) + half, F.col(col) + half
    return df.withColumns({"x": F.lit(a) * j + F.lit(b) * i + F.lit(c), "y": F.lit(d) * j + F.lit(e) * i + F.lit(f)})


def utm_zone(epsg: int) -> tuple[int, bool]:
    """Zone and whether it is south, of EPSG:326xx and 327xx."""
    zone, south = epsg % 100, epsg // 100 == 327
    if epsg // 100 not in (326, 327) or not 1 <= zone <= 60:
        raise ValueError(f"EPSG:{epsg} is not a UTM zone")
    return zone, south


def krueger(ellipsoid: Ellipsoid) -> tuple[float, list[float]]:
    """Rectifying radius over a, and the six coefficients of the inverse series."""
    f = 1 / ellipsoid.inverse_flattening
    n = f / (2 - f)
    radius = (1 + n**2 / 4 + n**4 / 64 + n**6 / 256) / (1 + n)
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512 + 96199 * n**6 / 604800,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105 - 1118711 * n**6 / 3870720,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480 + 5569 * n**6 / 90720,
        4397 * n**4 / 161280 - 11 * n**5 / 504 - 830251 * n**6 / 7257600,
        4583 * n**5 / 161280 - 108847 * n**6 / 3991680,
        20648693 * n**6 / 638668800,
    ]
    return radius, beta


def utm(epsg: int, ellipsoid: Ellipsoid = WGS84) -> TransverseMercator:
    """A UTM zone as the transverse Mercator projection that it is."""
    zone, south = utm_zone(epsg)
    return TransverseMercator(6.0 * zone - 183.0, 0.0, SCALE, FALSE_EASTING, FALSE_NORTHING if south else 0.0, ellipsoid)


def equator_northing(tm: TransverseMercator) -> float:
    """The northing of the equator on the central meridian: the false one less the arc up to the latitude of origin."""
    if tm.lat0 == 0.0:
        return tm.y0
    e, s = math.sqrt(tm.ellipsoid.e2), math.sin(math.radians(tm.lat0))
    chi = math.atan(math.sinh(math.asinh(math.tan(math.radians(tm.lat0))) - e * math.atanh(e * s)))
    f = 1 / tm.ellipsoid.inverse_flattening
    xi = chi + sum(a * math.sin(2 * i * chi) for i, a in enumerate(krueger_forward(f / (2 - f)), 1))
    return tm.y0 - tm.scale * tm.ellipsoid.a * krueger(tm.ellipsoid)[0] * xi


def utm_steps(epsg: int, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat", ellipsoid: Ellipsoid = WGS84) -> list[dict[str, str]]:
    """Easting and northing of a UTM zone to degrees, as steps."""
    return tmerc_steps(utm(epsg, ellipsoid), x, y, lon, lat)


def tmerc_steps(tm: TransverseMercator, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat") -> list[dict[str, str]]:
    """Easting and northing to degrees, as steps (see ``cells``)."""
    ellipsoid = tm.ellipsoid
    radius, beta = krueger(ellipsoid)
    k = tm.scale * ellipsoid.a * radius
    e2 = ellipsoid.e2
    e = math.sqrt(e2)
    xi = " - ".join(["t_x", *(f"{b!r} * sin({2 * i}e0 * t_x) * cosh({2 * i}e0 * t_y)" for i, b in enumerate(beta, 1))])
    eta = " - ".join(["t_y", *(f"{b!r} * cos({2 * i}e0 * t_x) * sinh({2 * i}e0 * t_y)" for i, b in enumerate(beta, 1))])
    steps = [
        {"t_x": f"({y} - {equator_northing(tm)!r}) / {k!r}", "t_y": f"({x} - {tm.x0!r}) / {k!r}"},
        {"t_u": xi, "t_v": eta},
        {"t_s": "sinh(t_v)", "t_c": "cos(t_u)"},
        {lon: f"degrees(atan2(t_s, t_c)) + {tm.lon0!r}", "t_w": "sin(t_u) / sqrt(t_s * t_s + t_c * t_c)", "t_t": "sin(t_u) / sqrt(t_s * t_s + t_c * t_c)"},
    ]
    # Newton steps on the tangent of the conformal latitude (Karney 2011, equations 19 to 21).
    for _ in range(3):
        steps += [
            {"t_g": f"sinh({e!r} * atanh({e!r} * t_t / sqrt(1e0 + t_t * t_t)))"},
            {"t_h": "t_t * sqrt(1e0 + t_g * t_g) - t_g * sqrt(1e0 + t_t * t_t)"},
            {"t_t": f"t_t + (t_w - t_h) / sqrt(1e0 + t_h * t_h) * (1e0 + {1 - e2!r} * t_t * t_t) / ({1 - e2!r} * sqrt(1e0 + t_t * t_t))"},
        ]
    return [*steps, {lat: "degrees(atan(t_t))"}]


def krueger_forward(n: float) -> list[float]:
    """The six coefficients of the forward series, of the third flattening."""
    return [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 - 127 * n**5 / 288 + 7891 * n**6 / 37800,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 + 281 * n**5 / 630 - 1983433 * n**6 / 1935360,
        61 * n**3 / 240 - 103 * n**4 / 140 + 15061 * n**5 / 26880 + 167603 * n**6 / 181440,
        49561 * n**4 / 161280 - 179 * n**5 / 168 + 6601661 * n**6 / 7257600,
        34729 * n**5 / 80640 - 3418889 * n**6 / 1995840,
        212378941 * n**6 / 319334400,
    ]


#: Degrees from a zone's meridian beyond which the series is not used: such places have no x and y.
REACH = 80.0


def utm_forward_steps(epsg: int, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y", ellipsoid: Ellipsoid = WGS84) -> list[dict[str, str]]:
    """Degrees to easting and northing of a UTM zone, as steps."""
    return tmerc_forward_steps(utm(epsg, ellipsoid), lon, lat, x, y)


def tmerc_forward_steps(tm: TransverseMercator, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> list[dict[str, str]]:
    """Degrees to easting and northing, as steps; null beyond REACH."""
    ellipsoid = tm.ellipsoid
    f = 1 / ellipsoid.inverse_flattening
    radius, _ = krueger(ellipsoid)
    alpha = krueger_forward(f / (2 - f))
    k, e = tm.scale * ellipsoid.a * radius, math.sqrt(ellipsoid.e2)
    turned = f"({lon}) - ({tm.lon0!r}e0) + 180e0"
    xi = " + ".join(["t_x", *(f"{a!r} * sin({2 * i}e0 * t_x) * cosh({2 * i}e0 * t_y)" for i, a in enumerate(alpha, 1))])
    eta = " + ".join(["t_y", *(f"{a!r} * cos({2 * i}e0 * t_x) * sinh({2 * i}e0 * t_y)" for i, a in enumerate(alpha, 1))])
    return [
        {"t_d": f"{turned} - 360e0 * floor(({turned}) / 360e0) - 180e0", "t_s": f"sin(radians({lat}))", "t_o": f"cos(radians({lat}))"},
        # The conformal latitude's sine and cosine, from the tangent of the isometric one.
        {"t_d": f"case when abs(t_d) <= {REACH!r}e0 then radians(t_d) end", "t_q": f"sinh({e!r} * atanh({e!r} * t_s))"},
        {"t_u": "t_s * sqrt(1e0 + t_q * t_q) - t_q", "t_v": "t_o * cos(t_d)", "t_w": "t_o * sin(t_d)"},
        {"t_x": "atan2(t_u, t_v)", "t_y": "asinh(t_w / sqrt(t_u * t_u + t_v * t_v))"},
        {x: f"{tm.x0!r} + {k!r} * ({eta})", y: f"{equator_northing(tm)!r} + {k!r} * ({xi})"},
    ]


def web_mercator_forward_steps(lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> list[dict[str, str]]:
    """Degrees to EPSG:3857; null at the poles."""
    a = WGS84.a
    return [{x: f"{a!r} * radians({lon})", y: f"case when abs({lat}) < 90e0 then {a!r} * asinh(tan(radians({lat}))) end"}]


def web_mercator_steps(x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat") -> list[dict[str, str]]:
    """EPSG:3857 to degrees."""
    a = WGS84.a
    return [{lon: f"degrees({x} / {a!r})", lat: f"degrees(2e0 * atan(exp({y} / {a!r})) - {math.pi / 2!r})"}]


def _tmerc(system: int | TransverseMercator) -> TransverseMercator:
    return system if isinstance(system, TransverseMercator) else utm(system)


def to_degrees(df: DataFrame, epsg: int | TransverseMercator, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds lon and lat: EPSG:4326 as it is, 3857, the UTM zones, and any transverse Mercator projection."""
    from .cells import add_steps

    if epsg == 4326:
        return df.withColumns({lon: F.col(x).cast("double"), lat: F.col(y).cast("double")})
    steps = web_mercator_steps(x, y, lon, lat) if epsg == 3857 else tmerc_steps(_tmerc(epsg), x, y, lon, lat)
    return add_steps(df, steps, [lon, lat])


def from_degrees(df: DataFrame, epsg: int | TransverseMercator, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """Adds x and y: the opposite of ``to_degrees``; null where the projection doesn't reach."""
    from .cells import add_steps

    if epsg == 4326:
        return df.withColumns({x: F.col(lon).cast("double"), y: F.col(lat).cast("double")})
    steps = web_mercator_forward_steps(lon, lat, x, y) if epsg == 3857 else tmerc_forward_steps(_tmerc(epsg), lon, lat, x, y)
    return add_steps(df, steps, [x, y])
