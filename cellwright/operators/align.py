"""Alignment of several inputs along a labelled dimension, and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("outer", "inner", "exact", "reindex")


def labels_of(df: DataFrame, dim: str) -> DataFrame:
    if dim not in df.columns:
        raise ValueError(f"an input has no coordinate {dim!r}")
    return df.select(dim).distinct()


def decode_labels(df: DataFrame, dim: str) -> DataFrame:
    """Byte labels as UTF-8 strings; others as they are."""
    return df.withColumn(dim, F.decode(dim, "utf-8")) if dict(df.dtypes).get(dim) == "binary" else df


def align(inputs: list[DataFrame], dim: str, mode: str = "outer", labels: list | None = None, keys: tuple[str, ...] = ("point_idx",)) -> list[DataFrame]:
    """Each input with the same labels of ``dim``; what an input lacks is NULL.

    outer: the union of the labels, inner: their intersection, exact: an error unless they are the
    same, reindex: ``labels``, and an error for a label that isn't among them. An input's rows are
    told apart by ``keys``; labels are few, so they are what is broadcast.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    inputs = [decode_labels(d, dim) for d in inputs]
    own = [labels_of(d, dim) for d in inputs]
    spark = inputs[0].sparkSession
    if mode == "exact":
        for other in own[1:]:
            if not own[0].exceptAll(other).isEmpty() or not other.exceptAll(own[0]).isEmpty():
                raise ValueError(f"the inputs' labels of {dim!r} differ")
        return inputs
    if mode == "reindex":
        if labels is None:
            raise ValueError("reindex needs labels")
        wanted = spark.createDataFrame([(x,) for x in labels], own[0].schema)
        unknown = reduce(DataFrame.union, own).distinct().join(wanted, dim, "left_anti").limit(5).collect()
        if unknown:
            raise ValueError(f"labels of {dim!r} that are not in the list: {[r[0] for r in unknown]}")
    elif mode == "outer":
        wanted = reduce(DataFrame.union, own).distinct()
    else:
        wanted = reduce(lambda a, b: a.join(b, dim, "left_semi"), own)
        return [d.join(wanted, dim, "left_semi").select(d.columns) for d in inputs]
    out = []
    for d in inputs:
        frame = d.select(*keys).distinct().crossJoin(wanted)  # points of one input by its few labels: the dense result itself
        out.append(frame.join(d, [*keys, dim], "left").select(d.columns))
    return out


def check_compatible(inputs: list[DataFrame], dim: str) -> None:
    """Undeclared extra dimensions must have the same labels in all inputs."""
    first = labels_of(inputs[0], dim)
    for other in map(lambda d: labels_of(d, dim), inputs[1:]):
        if not first.exceptAll(other).isEmpty() or not other.exceptAll(first).isEmpty():
            raise ValueError(f"dimension {dim!r} differs between inputs and isn't declared as extra dimension")


def union_points(inputs: list[DataFrame]) -> DataFrame:
    """All inputs' points with the input's number; variables that an input lacks are NULL."""
    numbered = [d.withColumn("input_id", F.lit(i)) for i, d in enumerate(inputs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table and not the other, with ``side``; NULLs (and NaNs) equal each other."""
    if [(f.name, f.dataType) for f in a.schema] != [(f.name, f.dataType) for f in b.schema]:
        raise ValueError("the tables' schemas differ")
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def copy_table(inputs: list[DataFrame], drop: list[str] = ()) -> DataFrame:
    """A lookup table that must be the same in all inputs, without columns that match ``drop``."""
    import re

    for other in inputs[1:]:
        if not table_difference(inputs[0], other).isEmpty():
            raise ValueError("a copied table differs between inputs")
    return inputs[0].drop(*[c for c in inputs[0].columns if any(re.fullmatch(p, c) for p in drop)])


def missing_parents(paths: DataFrame, path: str = "path") -> DataFrame:
    """Ancestors of group paths that have no row of their own; the root is ''."""
    parts = F.split(path, "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    above = paths.select(F.explode(ups).alias(path)).distinct()
    return above.join(paths.select(path), path, "left_anti")
