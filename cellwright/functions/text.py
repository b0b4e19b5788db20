"""String, time and list functions of product readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def request_list(value: Column) -> Column:
    """``a/b/c`` to its parts, empty ones left out."""
    return F.filter(F.split(value, "/"), lambda x: x != "")


def three_hourly(times: Column) -> Column:
    """The times ``hh:mm`` at whole multiples of three hours."""
    return F.filter(times, lambda t: F.pmod(F.substring(t, 1, 2).cast("int"), F.lit(3)) == 0)


def hours_since(time: Column, first_day: Column) -> Column:
    """Whole hours since the beginning of a day."""
    return F.floor((F.unix_timestamp(time) - F.unix_timestamp(F.date_trunc("day", first_day))) / 3600).cast("long")


def cache_tag(date: Column, times: Column) -> Column:
    """A file-name tag of a date, list or range of dates and an array of times ``hh:mm``: for several
    times the first and last hour, how many there are, and six digits of their hash."""
    day = F.regexp_replace(F.regexp_replace(date, "-", ""), "/", "-")
    hour = lambda i: F.substring(F.element_at(times, i), 1, 2)
    several = F.concat(F.lit("-"), hour(-1), F.lit("n"), F.size(times).cast("string"), F.lit("h"), F.substring(F.sha1(F.array_join(times, "/")), 1, 6))
    return F.concat(day, F.lit("T"), hour(1), F.when(F.size(times) > 1, several).otherwise(F.lit("")))


def product_name(path: Column) -> Column:
    """The id of a product that is named by its path: the last part, without ``.zarr``."""
    return F.regexp_replace(F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1), r"\.zarr$", "")


def product_id(kind: Column, start: Column, end: Column, created: Column) -> Column:
    """The id of a product by its kind, the span of its data and when it was made."""
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss")
    return F.concat_ws("_", F.lit("S00_"), kind, stamp(start), stamp(end), stamp(created))


def version_parts(version: Column) -> Column:
    """A dotted version as numbers, which compare part by part; null where it isn't one."""
    return F.when(version.rlike(r"^\d+(\.\d+)*$"), F.split(version, r"\.").cast("array<int>"))


def version_ref(version: Column, default: str = "main") -> Column:
    """Where a version's files are kept: the tag of a release, the commit of a development version."""
    commit = F.regexp_extract(version, r"\+g([0-9a-f]{7,40})", 1)
    return F.when(version.rlike(r"^\d+(\.\d+)+$"), F.concat(F.lit("refs/tags/v"), version)).when(commit != "", commit).otherwise(F.lit(default))


def item_id(path: Column) -> Column:
    """An item id from a path: its stem, with ``_`` for what isn't a letter, digit or hyphen."""
    name = F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)
    return F.regexp_replace(F.regexp_replace(name, r"(.)\.[^.]*$", "$1"), "[^a-zA-Z0-9-]", "_")


def full_match(value: Column, patterns: list[str]) -> Column:
    """Whether a string matches any pattern as a whole."""
    return F.coalesce(value.rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$"), F.lit(False)) if patterns else F.lit(False)
