"""Stored neighbour links: the search for a pair of points and cells is done once.

A store is a folder of Parquet tables of (cell_id, input_id, point_idx, rank, distance), sorted by
cell so that ids take next to no room, each named by what it was made from. Jobs share it by path.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import __version__
from ..functions.cells import SPHERE, Ellipsoid
from ..operators.resample import neighbours


def _digest(df: DataFrame, columns: list[str]) -> str:
    """Of a set of rows in any order: their number, and sum and parity of their hashes."""
    h = F.xxhash64(*columns)
    return "/".join(str(v) for v in df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def link_key(points: DataFrame, targets: DataFrame, level: int, k: int, ellipsoid: Ellipsoid = SPHERE) -> str:
    """A name for the links: they follow from the geometry, the search's parameters and this version."""
    parts = [_digest(points, ["input_id", "point_idx", "lon", "lat"]), _digest(targets, ["cell_id"]), level, k, ellipsoid.name, ellipsoid.a, ellipsoid.inverse_flattening, __version__]
    return hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=16).hexdigest()


def stored_neighbours(points: DataFrame, targets: DataFrame, level: int, k: int, store: str, ellipsoid: Ellipsoid = SPHERE) -> DataFrame:
    """``neighbours``, read from the store if it has them complete, else searched for and put there."""
    spark = points.sparkSession
    path = f"{store.rstrip('/')}/{link_key(points, targets, level, k, ellipsoid)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        found = neighbours(points, targets, level, k, ellipsoid).repartitionByRange("cell_id").sortWithinPartitions("cell_id", "rank")
        found.write.mode("overwrite").option("compression", "zstd").option("parquet.writer.version", "v2").parquet(path)
    return spark.read.schema("cell_id long, input_id int, point_idx long, rank int, distance double").parquet(path)
