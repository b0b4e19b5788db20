"""Settings of a conversion, validated as a whole, with JSON both ways."""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..functions.cells import ELLIPSOIDS, MAX_LEVEL

SCHEMES = ("nested", "ring", "zuniq")
RESAMPLERS = ("nearest", "k-nearest", "bilinear", "grid-bilinear", "psf", "cell-point", "nn")
CHUNKINGS = ("none", "dense", "sparse")


@dataclass(frozen=True)
class Grid:
    level: int
    ellipsoid: str = "WGS84"
    scheme: str = "nested"
    dimension: str = "cells"
    coordinate: str = "cell_ids"
    compression: str = "none"

    def __post_init__(self):
        if not 0 <= self.level <= MAX_LEVEL:
            raise ValueError(f"level {self.level} is not in 0..{MAX_LEVEL}")
        if self.scheme not in SCHEMES:
            raise ValueError(f"unknown indexing scheme {self.scheme!r}")
        if self.ellipsoid not in ELLIPSOIDS:
            raise ValueError(f"unknown ellipsoid {self.ellipsoid!r}")


@dataclass(frozen=True)
class Chunks:
    """Output partitions: the children of a coarser cell, with a halo of input around them."""

    kind: str = "none"
    level: int | None = None
    shard_level: int | None = None
    buffer: float = 60.0
    chunk_size: int | None = None

    def __post_init__(self):
        if self.kind not in CHUNKINGS:
            raise ValueError(f"unknown chunking {self.kind!r}")
        if (self.kind == "none") != (self.level is None):
            raise ValueError("a chunk level goes with dense or sparse chunks, and only with them")
        if self.kind == "sparse" and not self.chunk_size:
            raise ValueError("sparse chunks need a chunk size")
        if self.shard_level is not None and (self.level is None or self.shard_level > self.level):
            raise ValueError("a shard must not be finer than its chunks")


@dataclass(frozen=True)
class Resampler:
    name: str = "nearest"
    params: dict[str, Any] = field(default_factory=dict)
    dtype: str | None = None

    def __post_init__(self):
        if self.name not in RESAMPLERS:
            raise ValueError(f"unknown resampler {self.name!r}")
        if self.dtype not in (None, "float", "double", "float16"):
            raise ValueError("the output type of a resampler must be floating")


@dataclass(frozen=True)
class ExtraDimension:
    name: str
    mode: str = "exact"
    labels: tuple[str, ...] | None = None

    def __post_init__(self):
        if self.mode not in ("outer", "inner", "exact", "reindex"):
            raise ValueError(f"unknown join {self.mode!r}")
        if (self.mode == "reindex") != (self.labels is not None):
            raise ValueError("labels go with reindex, and only with it")


@dataclass(frozen=True)
class Group:
    grid: Grid
    chunks: Chunks = Chunks()
    resampler: Resampler = Resampler()
    drop: tuple[str, ...] = ()
    extra: tuple[ExtraDimension, ...] = ()
    exclude_attributes: dict[str, list[str]] = field(default_factory=dict)
    override_attributes: dict[str, dict[str, Any]] = field(default_factory=dict)

    def __post_init__(self):
        if self.resampler.name == "cell-point" and self.grid.level != MAX_LEVEL:
            raise ValueError("cell-point works at level 29 only")
        if self.resampler.name == "grid-bilinear" and self.chunks.kind != "dense":
            raise ValueError("grid-bilinear needs dense chunks")
        if self.resampler.name == "cell-point" and self.chunks.kind == "dense":
            raise ValueError("cell-point gives sparse cells")
        if self.chunks.level is not None and self.chunks.level > self.grid.level:
            raise ValueError("a chunk must not be finer than its cells")
        if self.grid.scheme != "nested":
            raise ValueError("conversion works on nested ids")


# The conventions that outputs can follow, and the first version of CF with such grids.
CONVENTIONS = ("dggs", "multiscales", "cf")
CF_SINCE = "1.13"


def version_tuple(version: str) -> tuple[int, ...]:
    if not re.fullmatch(r"\d+(\.\d+)*", version):
        raise ValueError(f"{version!r} is not a version number")
    return tuple(map(int, version.split(".")))


@dataclass(frozen=True)
class Convention:
    """A convention that the output's metadata follows; ``grid_mapping`` is of CF."""

    name: str
    version: str | None = None
    grid_mapping: bool = True

    def __post_init__(self):
        if self.name not in CONVENTIONS:
            raise ValueError(f"unknown convention {self.name!r}")
        if self.name != "cf" and (self.version is not None or not self.grid_mapping):
            raise ValueError(f"convention {self.name!r} has no options")
        if self.name == "cf" and version_tuple(self.version or CF_SINCE) < version_tuple(CF_SINCE):
            raise ValueError(f"CF {self.version} has no such grid mapping; it takes {CF_SINCE} or later")

    @classmethod
    def of(cls, value: "Convention | str | dict[str, Any]") -> "Convention":
        """From a name alone, in any case, or its members."""
        if isinstance(value, cls):
            return value
        members = {"name": value} if isinstance(value, str) else dict(value)
        return cls(**members | {"name": members["name"].lower()})


@dataclass(frozen=True)
class Pyramid:
    levels: tuple[int, ...]
    reduce: str | dict[str, str] = "mean"
    source: str = "nearest"
    chunk_offset: int | None = None
    shard_level: int | None = None
    asset_type: str = "auto"

    def __post_init__(self):
        from ..operators.pyramid import REDUCERS

        if len(set(self.levels)) != len(self.levels):
            raise ValueError("a derived level is given twice")
        if self.source not in ("nearest", "finest"):
            raise ValueError("derived levels come from the nearest or the finest native level")
        for how in [self.reduce] if isinstance(self.reduce, str) else self.reduce.values():
            if how not in REDUCERS:
                raise ValueError(f"unknown reducer {how!r}")


@dataclass(frozen=True)
class Settings:
    """groups: by path; multiscale: paths of groups whose children are the levels of one pyramid;
    copies: lookup tables that are passed on; consolidate: roots that get one metadata document."""

    groups: dict[str, Group]
    pyramids: dict[str, Pyramid] = field(default_factory=dict)
    copies: tuple[str, ...] = ()
    copy_drop: tuple[str, ...] = ()
    exclude_groups: tuple[str, ...] = ()
    consolidate: tuple[str, ...] = ()
    item_merges: dict[str, str] = field(default_factory=dict)
    conventions: tuple[Convention, ...] = tuple(map(Convention, CONVENTIONS))

    def __post_init__(self):
        names = [c.name for c in self.conventions]
        if len(set(names)) < len(names):
            raise ValueError("a convention is given twice")
        both = set(self.groups) & set(self.copies)
        if both:
            raise ValueError(f"groups are both converted and copied: {sorted(both)}")
        for path, pyramid in self.pyramids.items():
            native = self.native(path)
            if not native:
                raise ValueError(f"pyramid {path!r} has no native level")
            if any(g.chunks.kind != "dense" for g in native.values()):
                raise ValueError(f"pyramid {path!r} needs dense native levels")
            if len({g.chunks.level for g in native.values()}) > 1:
                raise ValueError(f"the native levels of pyramid {path!r} have different chunk levels")
            for level in pyramid.levels:
                if level in native:
                    raise ValueError(f"level {level} of pyramid {path!r} is native")
                if level >= max(native):
                    raise ValueError(f"level {level} of pyramid {path!r} is not coarser than its native levels")

    def convention(self, name: str) -> Convention | None:
        return next((c for c in self.conventions if c.name == name), None)

    def native(self, path: str) -> dict[int, Group]:
        """Native levels of a multiscale group: its children."""
        out: dict[int, Group] = {}
        for name, group in self.groups.items():
            if name.rpartition("/")[0] == path or name == path:
                if group.grid.level in out:
                    raise ValueError(f"level {group.grid.level} of {path!r} is given twice")
                out[group.grid.level] = group
        return out

    def for_group(self, path: str) -> Group:
        """The settings of a group: by its path, or by the last pattern that matches it."""
        if path in self.groups:
            return self.groups[path]
        for pattern in reversed(list(self.groups)):
            if re.fullmatch(pattern, path):
                return self.groups[pattern]
        raise KeyError(f"no settings for group {path!r}")

    def filter_and_replace(self, change: Callable[[str, Group], Group | None]) -> "Settings":
        """The settings with each group as ``change`` gives it back; None takes it out."""
        groups = {p: new for p, g in self.groups.items() if (new := change(p, g)) is not None}
        return dataclasses.replace(self, groups=groups)

    def to_dict(self) -> dict[str, Any]:
        return dataclasses.asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> "Settings":
        def group(g):
            return Group(
                Grid(**g["grid"]), Chunks(**g.get("chunks", {})), Resampler(**g.get("resampler", {})), tuple(g.get("drop", ())),
                tuple(ExtraDimension(x["name"], x.get("mode", "exact"), tuple(x["labels"]) if x.get("labels") is not None else None) for x in g.get("extra", ())),
                g.get("exclude_attributes", {}), g.get("override_attributes", {}),
            )

        unknown = set(d) - {f.name for f in dataclasses.fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(
            {p: group(g) for p, g in d["groups"].items()}, {p: Pyramid(**{**x, "levels": tuple(x["levels"])}) for p, x in d.get("pyramids", {}).items()},
            tuple(d.get("copies", ())), tuple(d.get("copy_drop", ())), tuple(d.get("exclude_groups", ())), tuple(d.get("consolidate", ())), d.get("item_merges", {}),
            tuple(Convention.of(c) for c in d.get("conventions", CONVENTIONS)),
        )

    @classmethod
    def from_json(cls, text: str) -> "Settings":
        return cls.from_dict(json.loads(text))


def json_schema() -> dict[str, Any]:
    """A JSON schema of the settings, from the dataclasses."""

    def of(t: Any) -> dict[str, Any]:
        if dataclasses.is_dataclass(t):
            import typing

            hints = typing.get_type_hints(t)
            needed = [f.name for f in dataclasses.fields(t) if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
            return {"type": "object", "additionalProperties": False, "properties": {f.name: of(hints[f.name]) for f in dataclasses.fields(t)}, "required": needed}
        kinds = {int: "integer", float: "number", str: "string", bool: "boolean"}
        if t in kinds:
            return {"type": kinds[t]}
        args = getattr(t, "__args__", ())
        origin = getattr(t, "__origin__", None)
        if origin is dict:
            return {"type": "object", "additionalProperties": of(args[1])}
        if origin in (tuple, list):
            return {"type": "array", "items": of(args[0])}
        if args:
            return {"anyOf": [{"type": "null"} if a is type(None) else of(a) for a in args]}
        return {}

    return {"$schema": "https://json-schema.org/draft/2020-12/schema"} | of(Settings)
