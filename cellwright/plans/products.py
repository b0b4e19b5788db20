"""Known products: their variables and settings, and how their fields become cells.

A product's input is a long table of fields: group, variable, time, [number,] point_idx, lon, lat,
value (or cell_id on a native grid). Decoding files and downloading them happens before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions.text import three_hourly
from ..operators import psf, resample
from ..sources.grids import first_member
from ..sources.sinks import chunk_column
from .settings import Chunks, Grid, Group, Pyramid, Resampler, Settings

# For each variable its parameter in the archive, unit and long name.
ERA5_ENSEMBLE = {
    "t2m": ("167.128", "K", "2 metre temperature"),
    "u10": ("165.128", "m s-1", "10 metre U wind component"),
    "v10": ("166.128", "m s-1", "10 metre V wind component"),
    "sp": ("134.128", "Pa", "Surface pressure"),
    "d2m": ("168.128", "K", "2 metre dewpoint temperature"),
    "skt": ("235.128", "K", "Skin temperature"),
}
ERA5_DETERMINISTIC = {
    "tcwv": ("137.128", "kg m-2", "Total column water vapour"),
    "mslp": ("151.128", "Pa", "Mean sea level pressure"),
    "tcc": ("164.128", "1", "Total cloud cover"),
    "sst": ("34.128", "K", "Sea surface temperature"),
    "sic": ("31.128", "1", "Sea ice area fraction"),
    "sd": ("141.128", "m", "Snow depth (water equivalent)"),
    "swvl1": ("39.128", "m3 m-3", "Volumetric soil water layer 1"),
    "asn": ("32.128", "1", "Snow albedo"),
    "tco3": ("206.128", "kg m-2", "Total column ozone"),
}
CAMS = {
    "aod550": ("total_aerosol_optical_depth_550nm", "1", "Total AOD at 550 nm"),
    "ssaod550": ("sea_salt_aerosol_optical_depth_550nm", "1", "Sea salt AOD at 550 nm"),
    "duaod550": ("dust_aerosol_optical_depth_550nm", "1", "Dust AOD at 550 nm"),
    "omaod550": ("organic_matter_aerosol_optical_depth_550nm", "1", "Organic matter AOD at 550 nm"),
    "bcaod550": ("black_carbon_aerosol_optical_depth_550nm", "1", "Black carbon AOD at 550 nm"),
    "suaod550": ("sulphate_aerosol_optical_depth_550nm", "1", "Sulphate AOD at 550 nm"),
}
CLIMATE_SURFACE = {
    "sp": ("134", "Pa", "Surface pressure"),
    "u10": ("165", "m s-1", "10 metre U wind component"),
    "v10": ("166", "m s-1", "10 metre V wind component"),
    "t2m": ("167", "K", "2 metre temperature"),
    "d2m": ("168", "K", "2 metre dewpoint temperature"),
}
CLIMATE_OCEAN = {"avg_thetao": ("263501", "K", "Ocean potential temperature")}
GROUPS = {"measurements/enda": ERA5_ENSEMBLE, "measurements/oper": ERA5_DETERMINISTIC, "measurements/aod": CAMS, "measurements/sfc": CLIMATE_SURFACE, "measurements/ocean": CLIMATE_OCEAN}


def _globe(level: int, threshold: float, lam: float) -> Group:
    return Group(Grid(level), Chunks("dense", 2, buffer=0.0), Resampler("psf", {"threshold": threshold, "lam": lam}))


def predefined(name: str) -> Settings:
    """Settings of a product by its name."""
    made = {
        "era5": lambda: Settings({"measurements/enda": _globe(7, 0.5, 0.0), "measurements/oper": _globe(7, 0.5, 0.0)}),
        "cams-eac4": lambda: Settings({"measurements/aod": _globe(6, 0.01, 5.0)}),
        "climatedt-sfc": lambda: Settings({"measurements/sfc": _globe(7, 0.5, 0.0)}),
        "dem-glo30": lambda: Settings({"dem/glo30": Group(Grid(18), Chunks("dense", 6, buffer=300.0), Resampler("grid-bilinear", dtype="float"))}, {"dem": Pyramid(tuple(range(17, 7, -1)), "mean")}),
    }
    if name not in made:
        raise ValueError(f"unknown product {name!r}; there are {sorted(made)}")
    return made[name]()


def ensemble_times(spark: SparkSession, times: list[str]) -> list[str]:
    """Those of the times that have an ensemble analysis, every three hours; none is an error."""
    df = spark.createDataFrame([(times,)], "times array<string>")
    out = df.select(three_hourly(F.col("times"))).first()[0]
    if not out:
        raise ValueError(f"none of the times {times} has an ensemble analysis")
    return out


def variables(spark: SparkSession) -> DataFrame:
    """The tables above as one: group, variable, parameter, unit, long_name."""
    return spark.createDataFrame([(g, v, *meta) for g, vs in GROUPS.items() for v, meta in vs.items()], "`group` string, variable string, parameter string, unit string, long_name string")


def field_maps(fields: DataFrame, group: str, settings: Settings, method: str = "psf", chunk_indices: list[int] | None = None) -> DataFrame:
    """Whole-globe maps of a group's fields: time, variable, chunk_id, cell_id, value (float).

    Each field is resampled from its valid points, all in one plan; fields that are known at the
    same points share the equations of the point-spread function. Chunks are taken from the map. PSF
    results stay within the valid source values; optical depths don't fall below 0. The method
    ``nn`` is binning with gaps filled.
    """
    g = settings.for_group(group)
    level, e, by = g.grid.level, C.ELLIPSOIDS[g.grid.ellipsoid], ("time", "variable")
    known = GROUPS.get(group, {})
    fields = first_member(fields).filter(F.col("variable").isin(*known)) if known else first_member(fields)
    fields = fields.withColumn("value", F.col("value").cast("float"))
    if method == "nn":
        made = resample.fill_gaps(resample.bin_mean(fields, level, ["value"], e, by), level, "value", by=by)
    else:
        made = psf.psf_batch(fields, level, g.chunks.level, ["value"], by, ellipsoid=e, **g.resampler.params)
        made = resample.clip_to_source(made, fields, "value", by)
    if group == "measurements/aod":
        made = resample.clip_at_zero(made, "value")
    cells = resample.every_cell(fields.select(*by).distinct(), level)
    if chunk_indices is not None:
        n = 12 * 4**g.chunks.level
        if any(not 0 <= i < n for i in chunk_indices):
            raise IndexError(f"a chunk index is out of range 0..{n - 1}")
        cells = cells.filter(chunk_column(level, g.chunks.level).isin(chunk_indices))
    made = resample.dense(made.withColumn("value", F.col("value").cast("float")), cells, by=by)
    return made.select("time", "variable", chunk_column(level, g.chunks.level).alias("chunk_id"), "cell_id", "value")


def sphere_to_ellipsoid(cells: DataFrame, level: int, variable: str, chunk_level: int = 2, method: str = "psf", **params) -> DataFrame:
    """A map on the sphere's grid to the same level of the WGS84 grid.

    Cells of the two grids with one id lie up to 14 km apart, so values are resampled from the
    spherical centres; masked cells take no part and stay missing.
    """
    extra = set(cells.columns) - {"cell_id", variable}
    if extra:
        raise NotImplementedError(f"dimensions besides cells: {sorted(extra)}")
    pts = C.with_center(cells, level, C.SPHERE).withColumns({"input_id": F.lit(0), "point_idx": F.col("cell_id")}).drop("cell_id")
    valid = pts.filter(F.col(variable).isNotNull() & ~F.isnan(F.col(variable).cast("double")))
    if method == "nearest":
        return resample.nearest(valid, C.whole_sphere(cells.sparkSession, level), level, [variable], C.WGS84)
    return resample.clip_to_source(psf.psf(valid, level, chunk_level, variable, ellipsoid=C.WGS84, **params), valid, variable)
