"""Hierarchical aggregation: coarser levels of a level of cells.

A parent is a shift of the nested id, so a level is one ``groupBy``; Spark combines on the map
side, and nothing but the groups' partial results is shuffled. Tables bucketed by chunk need no
shuffle at all for levels at or above the chunk level (group by chunk and parent). Missing values
are NULL inside the engine and NaN at its edges; ``nan_to_null`` and ``restore`` cross them.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import check_level, parent

REDUCERS = ("mean", "min", "max", "sum", "mode", "bitwise_or")
_FLOATS = (T.FloatType, T.DoubleType)
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def nan_to_null(df: DataFrame, *names: str) -> DataFrame:
    """NaN to NULL in floating columns (Spark's avg, max and mode would take NaN for a value)."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, _FLOATS) and (not names or f.name in names)]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in floats})


def decode_packed(value: Column, scale: float = 1.0, offset: float = 0.0, fill: float | None = None) -> Column:
    """Packed integers to values: the fill is missing, all else is scaled."""
    out = value.cast("double") * scale + offset
    return out if fill is None else F.when(value != fill, out)


def check_bitwise_or(kind: T.DataType, packed: bool = False, decoded: bool = False) -> None:
    """Flags must be whole numbers, as stored: not packed, and 64-bit ones not decoded by a fill."""
    if not isinstance(kind, _INTEGERS):
        raise ValueError("bitwise_or needs an integer variable")
    if packed:
        raise ValueError("bitwise_or cannot reduce a packed variable")
    if decoded and isinstance(kind, T.LongType):
        raise ValueError("bitwise_or cannot reduce a 64-bit variable with a fill value: decoding loses bits")


def reducer(how: str, value: Column) -> Column:
    """One aggregate; missing values are skipped, and the sum of none is 0."""
    value = value if how in ("bitwise_or", "mode", "min", "max") else value.cast("double")
    made = {
        "mean": lambda: F.avg(value), "min": lambda: F.min(value), "max": lambda: F.max(value),
        "sum": lambda: F.coalesce(F.sum(value), F.lit(0.0)), "mode": lambda: F.mode(value, deterministic=True), "bitwise_or": lambda: F.bit_or(value),
    }
    if how not in made:
        raise ValueError(f"unknown reducer {how!r}")
    return made[how]()


def coarsen(df: DataFrame, level: int, target: int, how: str | dict[str, str] = "mean", keys: Iterable[str] = (), variables: Iterable[str] | None = None, cell: str = "cell_id") -> DataFrame:
    """``df`` at ``level`` to ``target``: one row a parent cell and value of ``keys`` (extra dimensions).

    ``how`` is a reducer for all variables or one for each. Every reducer runs over all native
    descendants; a mean is not a mean of means.
    """
    if not 0 <= target < check_level(level):
        raise ValueError(f"level {target} is not coarser than {level}")
    keys = list(keys)
    variables = [c for c in df.columns if c not in (cell, *keys)] if variables is None else list(variables)
    of = lambda v: how if isinstance(how, str) else how[v]
    for v in variables:
        if of(v) == "bitwise_or":
            check_bitwise_or(df.schema[v].dataType)
    clean = nan_to_null(df.select(cell, *keys, *variables), *variables)
    up = clean.withColumn(cell, F.expr(parent(cell, level - target)))
    return up.groupBy(cell, *keys).agg(*[reducer(of(v), F.col(v)).alias(v) for v in variables])


def restore(value: Column, kind: T.DataType, fill: float | None = None) -> Column:
    """An aggregate in its variable's type: whole numbers are rounded half to even, NULL is the fill."""
    if isinstance(kind, _INTEGERS):
        return F.coalesce(F.bround(value.cast("double")), F.lit(float(fill or 0))).cast(kind)
    return F.coalesce(value.cast(kind), F.lit(float("nan")).cast(kind)) if fill is None else F.coalesce(value, F.lit(fill)).cast(kind)


def half_precision(value: Column) -> Column:
    """A float64 aggregate as float16 would hold it, in a float: NULL stays, overflow is infinite."""
    @F.pandas_udf("float")
    def run(x: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series(x.to_numpy(dtype="float64", na_value=np.nan).astype(np.float16).astype(np.float32))

    return F.when(value.isNotNull(), run(value))


def mean_parts(df: DataFrame, level: int, target: int, variables: Iterable[str], keys: Iterable[str] = (), cell: str = "cell_id") -> DataFrame:
    """Sums and counts (``v__sum``, ``v__n``) at ``target``: what means of all coarser levels need."""
    variables = list(variables)
    clean = nan_to_null(df, *variables).withColumn(cell, F.expr(parent(cell, level - target)))
    aggs = [a for v in variables for a in (F.sum(F.col(v).cast("double")).alias(f"{v}__sum"), F.count(v).alias(f"{v}__n"))]
    return clean.groupBy(cell, *keys).agg(*aggs)


def mean_levels(df: DataFrame, level: int, targets: Iterable[int], variables: Iterable[str], keys: Iterable[str] = (), cell: str = "cell_id") -> dict[int, DataFrame]:
    """Means of several levels, each rolled up from the sums and counts of the next finer one.

    The work shrinks by four from level to level, where one grouping per level would read the
    native level each time. Equal to ``coarsen`` up to the order of additions.
    """
    variables, keys, out, at, parts = list(variables), list(keys), {}, level, None
    for target in sorted(set(targets), reverse=True):
        if not 0 <= target < at:
            raise ValueError(f"level {target} is not coarser than {level}")
        if parts is None:
            parts = mean_parts(df, level, target, variables, keys, cell)
        else:
            up = parts.withColumn(cell, F.expr(parent(cell, at - target)))
            parts = up.groupBy(cell, *keys).agg(*[F.sum(f"{v}__{p}").alias(f"{v}__{p}") for v in variables for p in ("sum", "n")])
        out[target] = parts.select(cell, *keys, *[F.when(F.col(f"{v}__n") > 0, F.col(f"{v}__sum") / F.col(f"{v}__n")).alias(v) for v in variables])
        at = target
    return out


def all_levels(df: DataFrame, level: int, targets: Iterable[int], how: dict[str, str], cell: str = "cell_id") -> DataFrame:
    """All levels in one pass over the native level, as grouping sets: level, cell_id, variables."""
    targets = sorted(set(targets))
    clean = nan_to_null(df.select(cell, *how), *how)
    ids = [F.struct(F.lit(t).alias("level"), F.expr(parent(cell, level - t)).alias(cell)) for t in targets]
    wide = clean.select(F.explode(F.array(*ids)).alias("at"), *how)
    return wide.groupBy("at.level", f"at.{cell}").agg(*[reducer(r, F.col(v)).alias(v) for v, r in how.items()])


def source_level(native: dict[int, Iterable[str]], variable: str, target: int, nearest: bool = True) -> int:
    """The native level a derived one is made from: the coarsest finer one that has the variable, or the finest."""
    levels = [l for l, vs in native.items() if variable in set(vs) and l > target]
    if not levels:
        raise ValueError(f"no native level finer than {target} has {variable!r}")
    return min(levels) if nearest else max(levels)


def coarsest_whole_level(cells: DataFrame, level: int, cell: str = "cell_id") -> int:
    """The coarsest level all of whose cells have four complete children, from distinct ids.

    Each step looks at a quarter of the cells; it stops at the first level with a gap.
    """
    ids = cells.select(cell).distinct()
    while level > 0:
        up = ids.groupBy(F.expr(parent(cell, 1)).alias(cell)).agg(F.count(F.lit(1)).alias("n"))
        low = up.agg(F.min("n")).first()[0]
        if low is None or low < 4:
            break
        ids, level = up.select(cell), level - 1
    return level


def derived_chunk_level(level: int, native: int, native_chunk: int, coarsest: int = 0) -> int:
    """The chunk level of a derived level: the native distance, at least 4, but no coarser than the coverage."""
    return max(level - max(native - native_chunk, 4), coarsest if coarsest <= level else 0, 0)


def chunk_and_shard_levels(level: int, offset: int, shard: int | None, coarsest: int = 0) -> tuple[int, int | None]:
    """Explicit layout: chunks ``offset`` levels up, in shards of a level while that is coarser."""
    chunk = max(level - offset, coarsest, 0)
    return chunk, shard if shard is not None and shard < chunk else None


def derived_chunk_levels(level: Column, native: Column, native_chunk: Column, coarsest: Column) -> Column:
    """``derived_chunk_level`` of a table of plans."""
    return F.greatest(level - F.greatest(native - native_chunk, F.lit(4)), F.when(coarsest <= level, coarsest).otherwise(0), F.lit(0))


def layout_levels(level: Column, offset: Column, shard: int | None, coarsest: Column) -> tuple[Column, Column]:
    """``chunk_and_shard_levels`` of a table of plans."""
    chunk = F.greatest(level - offset, coarsest, F.lit(0))
    return chunk, F.when(F.lit(shard) < chunk, F.lit(shard))


def merge_levels(parts: list[DataFrame], cell: str = "cell_id", keys: Iterable[str] = ()) -> DataFrame:
    """Variables of one level that came from different native levels, side by side."""
    on, out = [cell, *keys], parts[0]
    for p in parts[1:]:
        out = out.join(p, on, "full")
    return out
