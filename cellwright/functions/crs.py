"""Reference systems from their descriptions, WKT2 text or PROJJSON: what a transverse Mercator projection needs.

A description comes down to an EPSG code that the engine knows, or to a ``TransverseMercator``;
anything else is refused with the reason. Datums are taken as they are: no shift is applied.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

from .cells import Ellipsoid

# EPSG codes of the method and of its parameters.
METHOD = 9807
LATITUDE_OF_ORIGIN, LONGITUDE_OF_ORIGIN, SCALE_AT_ORIGIN, FALSE_EASTING, FALSE_NORTHING = 8801, 8802, 8805, 8806, 8807
NAMES = {
    "latitude of natural origin": LATITUDE_OF_ORIGIN,
    "longitude of natural origin": LONGITUDE_OF_ORIGIN,
    "scale factor at natural origin": SCALE_AT_ORIGIN,
    "false easting": FALSE_EASTING,
    "false northing": FALSE_NORTHING,
}


@dataclass(frozen=True)
class TransverseMercator:
    """Degrees, metres, and the ellipsoid that they refer to."""

    lon0: float
    lat0: float
    scale: float
    x0: float
    y0: float
    ellipsoid: Ellipsoid


@dataclass(frozen=True)
class Node:
    """KEYWORD[value, ..., child, ...]"""

    word: str
    values: tuple
    children: tuple["Node", ...]

    def get(self, *words: str) -> "Node | None":
        return next((c for c in self.children if c.word in words), None)


_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([A-Za-z_][A-Za-z_0-9]*)|([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)|([\[(])|([\])])|(,))')


def wkt_tree(text: str) -> Node:
    """The nested keywords of WKT."""
    open_nodes: list[tuple[str, list, list]] = [("", [], [])]
    word, at, text = None, 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError(f"not WKT at {text[at:at + 20]!r}")
        at = m.end()
        quoted, name, number, start, end, _ = m.groups()
        if start:
            if word is None:
                raise ValueError("WKT bracket without a keyword")
            open_nodes.append((word, [], []))
            word = None
            continue
        if word is not None:  # a keyword without brackets is a plain value
            open_nodes[-1][1].append(word)
            word = None
        if name:
            word = name.upper()
        elif quoted is not None:
            open_nodes[-1][1].append(quoted.replace('""', '"'))
        elif number:
            open_nodes[-1][1].append(float(number))
        elif end:
            if len(open_nodes) == 1:
                raise ValueError("WKT closes more brackets than it opens")
            w, values, children = open_nodes.pop()
            open_nodes[-1][2].append(Node(w, tuple(values), tuple(children)))
    roots = open_nodes[0][2]
    if len(open_nodes) != 1 or len(roots) != 1:
        raise ValueError("WKT is not one whole definition")
    return roots[0]


def _id(node: Node | None) -> int | None:
    found = node.get("ID", "AUTHORITY") if node else None
    return int(found.values[1]) if found and str(found.values[0]).upper() == "EPSG" else None


def _factor(node: Node | None) -> float | None:
    return None if node is None else float(node.values[1])


def _number(code: int | None, name: str) -> int | None:
    return code or NAMES.get(name.strip().lower().replace("_", " "))


def _from_wkt(text: str) -> dict:
    root = wkt_tree(text)
    if root.word == "BOUNDCRS":
        root = root.get("SOURCECRS").children[0]
    out: dict = {"code": _id(root), "projected": root.word in ("PROJCRS", "PROJECTEDCRS"), "method": None, "parameters": {}, "axes": [], "flips": False}
    base = root.get("BASEGEOGCRS", "BASEGEODCRS", "BASEGEOGRAPHICCRS", "BASEGEODETICCRS") or root
    datum = base.get("DATUM", "GEODETICDATUM", "ENSEMBLE", "TRF")
    ball = datum.get("ELLIPSOID", "SPHEROID") if datum else None
    if ball is not None:
        out["ellipsoid"] = Ellipsoid(ball.values[0], ball.values[1] * (_factor(ball.get("LENGTHUNIT", "UNIT")) or 1.0), ball.values[2] or math.inf)
    prime = base.get("PRIMEM", "PRIMEMERIDIAN")
    out["prime"] = float(prime.values[1]) if prime else 0.0
    conversion = root.get("CONVERSION")
    if conversion is not None:
        method = conversion.get("METHOD", "PROJECTION")
        out["method"] = (_id(method), method.values[0])
        for p in conversion.children:
            if p.word == "PARAMETER":
                out["parameters"][_number(_id(p), p.values[0])] = (float(p.values[1]), _factor(p.get("ANGLEUNIT", "LENGTHUNIT", "SCALEUNIT", "UNIT")))
    whole = _factor(root.get("LENGTHUNIT", "UNIT"))
    for axis in root.children:
        if axis.word == "AXIS":
            out["axes"].append(_factor(axis.get("LENGTHUNIT", "UNIT")) or whole or 1.0)
            out["flips"] |= bool({str(v).lower() for v in axis.values[1:]} & {"west", "south"})
    return out


# Units that PROJJSON states by name.
UNITS = {"metre": 1.0, "degree": math.pi / 180, "unity": 1.0}


def _json_unit(unit) -> float | None:
    return None if unit is None else UNITS[unit] if isinstance(unit, str) else float(unit["conversion_factor"])


def _json_value(d) -> float:
    """A plain number, or one with a unit."""
    return float(d["value"]) * (_json_unit(d.get("unit")) or 1.0) if isinstance(d, dict) else float(d)


def _json_id(d: dict) -> int | None:
    ids = [d["id"]] if "id" in d else d.get("ids", [])
    return next((int(i["code"]) for i in ids if i["authority"].upper() == "EPSG"), None)


def _from_json(d: dict) -> dict:
    if d.get("type") == "BoundCRS":
        d = d["source_crs"]
    out: dict = {"code": _json_id(d), "projected": d.get("type") == "ProjectedCRS", "method": None, "parameters": {}, "axes": [], "flips": False}
    base = d.get("base_crs", d)
    datum = base.get("datum") or base.get("datum_ensemble") or {}
    if "ellipsoid" in datum:
        ball = datum["ellipsoid"]
        a = _json_value(ball.get("semi_major_axis", ball.get("radius")))
        b = _json_value(ball["semi_minor_axis"]) if "semi_minor_axis" in ball else a
        flat = ball.get("inverse_flattening") or (a / (a - b) if a != b else math.inf)
        out["ellipsoid"] = Ellipsoid(ball["name"], a, flat)
    out["prime"] = _json_value((datum.get("prime_meridian") or {}).get("longitude", 0.0))
    if "conversion" in d:
        method = d["conversion"]["method"]
        out["method"] = (_json_id(method), method["name"])
        for p in d["conversion"].get("parameters", []):
            out["parameters"][_number(_json_id(p), p["name"])] = (float(p["value"]), _json_unit(p.get("unit")))
    for axis in d.get("coordinate_system", {}).get("axis", []):
        out["axes"].append(_json_unit(axis.get("unit")) or 1.0)
        out["flips"] |= axis.get("direction") in ("west", "south")
    return out


def known(code: int | None) -> bool:
    return code in (4326, 3857) or code is not None and code // 100 in (326, 327) and 1 <= code % 100 <= 60


def read(description: str | dict) -> "int | TransverseMercator":
    """The EPSG code that a description states, if it is a known one, else its projection.

    Only the transverse Mercator method will do, in metres and degrees from Greenwich, on an
    ellipsoid, with axes to the east and north.
    """
    if isinstance(description, str) and description.lstrip().startswith("{"):
        description = json.loads(description)
    d = _from_json(description) if isinstance(description, dict) else _from_wkt(description)
    if known(d["code"]):
        return d["code"]
    p = d["parameters"]
    code, name = d["method"] or (None, "")
    angles = [p[k][1] for k in (LATITUDE_OF_ORIGIN, LONGITUDE_OF_ORIGIN) if k in p]
    lengths = [p[k][1] for k in (FALSE_EASTING, FALSE_NORTHING) if k in p]
    faults = {
        "it isn't projected": not d["projected"],
        f"its method is {name!r}": code != METHOD and (code is not None or name.strip().lower().replace("_", " ") != "transverse mercator"),
        "it has no ellipsoid": "ellipsoid" not in d or math.isinf(d["ellipsoid"].inverse_flattening),
        "it doesn't count from Greenwich": d["prime"] != 0.0,
        "a parameter is missing": not {LATITUDE_OF_ORIGIN, LONGITUDE_OF_ORIGIN, SCALE_AT_ORIGIN, FALSE_EASTING, FALSE_NORTHING} <= p.keys(),
        "its angles aren't in degrees": any(u is not None and not math.isclose(u, UNITS["degree"], rel_tol=1e-9) for u in angles),
        "its lengths aren't in metres": any(u not in (None, 1.0) for u in lengths) or any(u != 1.0 for u in d["axes"]),
        "an axis points west or south": d["flips"],
    }
    wrong = [reason for reason, holds in faults.items() if holds]
    if wrong:
        raise ValueError("a reference system can't be used: " + ", ".join(wrong))
    value = lambda k: p[k][0]
    return TransverseMercator(value(LONGITUDE_OF_ORIGIN), value(LATITUDE_OF_ORIGIN), value(SCALE_AT_ORIGIN), value(FALSE_EASTING), value(FALSE_NORTHING), d["ellipsoid"])
