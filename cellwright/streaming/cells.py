"""Streams of point observations to aggregates by cell and time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cells as C


def cell_windows(stream: DataFrame, level: int, variable: str, time: str = "ts", window: str = "1 hour", late: str = "2 hours", ellipsoid: C.Ellipsoid = C.SPHERE) -> DataFrame:
    """Count, sum and mean of each cell and window; rows later than ``late`` are left out.

    Works on static frames too. A window's state goes once the watermark has passed it.
    """
    placed = C.with_cell(stream, level, ellipsoid)
    if placed.isStreaming:
        placed = placed.withWatermark(time, late)
    out = placed.groupBy(F.window(time, window), "cell_id").agg(F.count(variable).alias("n"), F.sum(variable).alias("total"), F.avg(variable).alias("mean"))
    return out.select(F.col("window.start").alias("window_start"), "cell_id", "n", "total", "mean")
