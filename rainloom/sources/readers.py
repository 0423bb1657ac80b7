"""Readers by file format and by product family; sinks are in ``operators.verification``."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import nan_to_null
from ..operators.precipitation import normalize_precipitation, wrf_precipitation_amount
from .normalize import normalize_coords

#: Columns that may hold precipitation, by family, and other names of families.
CANDIDATES = {
    "era5": ("tp", "total_precipitation", "precip"),
    "era5-land": ("tp", "total_precipitation", "precip"),
    "imerg": ("precipitationCal", "precipitation", "precip"),
    "gpm": ("precipitationCal", "precipitation", "precip"),
    "imdaa": ("pr", "precipitation", "rainfall", "precip"),
    "imd": ("rainfall", "precipitation", "pr", "precip"),
    "cmip6": ("pr", "precipitation", "prec"),
    "wrf": ("RAINNC", "RAINC", "RAINSH"),
}
FAMILIES = {"era5land": "era5-land", "gpm-imerg": "imerg"}
FORMATS = ("parquet", "csv", "json", "orc")


def family_of(name: str) -> str:
    key = name.lower().strip().replace("_", "-")
    return FAMILIES.get(key, key)


def open_dataset(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """A lazy table of a file or folder, by suffix; floating NaN is null.

    Array formats (NetCDF, Zarr, GRIB) need a Python data source that is installed and registered
    under the name of the suffix.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.options(**({"header": True, "inferSchema": True} if kind == "csv" else {}) | options)
    if kind in ("nc", "zarr", "grib"):
        kind = {"nc": "netcdf"}.get(kind, kind)
    elif kind not in FORMATS:
        kind = "parquet"
    return nan_to_null(reader.format(kind).load(path))


def pick_variable(df: DataFrame, family: str, variable: str | None = None) -> str:
    if variable:
        if variable not in df.columns:
            raise KeyError(f"{variable!r} is not in the table")
        return variable
    for c in CANDIDATES.get(family, ()):
        if c in df.columns:
            return c
    raise KeyError(f"no precipitation column for {family!r}; name one of {df.columns}")


def attach_coordinates(df: DataFrame, cells: DataFrame, on: tuple[str, str] = ("south_north", "west_east")) -> DataFrame:
    """Latitude and longitude of model cells from a table of one row a cell."""
    return df.join(cells, list(on), "left")


def load_precipitation(source: DataFrame, *, family: str, variable: str | None = None, normalize: bool = True, units: str | None = None, frequency: str | None = None) -> DataFrame:
    """Rows (time, latitude, longitude, value) of a product; accumulations of a model become amounts."""
    kind = family_of(family)
    df = normalize_coords(source, dataset=kind, strict=True)
    if "time" not in df.columns:
        raise ValueError("a product needs time, latitude and longitude")
    if kind == "wrf" and variable is None and {"RAINC", "RAINNC"} <= set(df.columns):
        df = wrf_precipitation_amount(df, order="time", keys=["latitude", "longitude"], name="value")
    else:
        name = pick_variable(df, kind, variable)
        df = df.withColumn("value", F.col(name).cast("double")).withMetadata("value", dict(df.schema[name].metadata or {}))
    df = nan_to_null(df.select("time", "latitude", "longitude", "value"), "value")
    return normalize_precipitation(df, keys=["latitude", "longitude"], units=units, frequency=frequency) if normalize else df


@dataclass(frozen=True)
class ProductSpec:
    """A product to load: ``source`` is a table or a path."""

    name: str
    family: str
    source: DataFrame | str
    variable: str | None = None
    units: str | None = None
    options: Mapping[str, object] = field(default_factory=dict)

    def load(self, spark: SparkSession | None = None, *, normalize: bool = True) -> DataFrame:
        df = self.source if isinstance(self.source, DataFrame) else open_dataset(spark or SparkSession.getActiveSession(), self.source, **self.options)
        return load_precipitation(df, family=self.family, variable=self.variable, units=self.units, normalize=normalize)


def validate_input_paths(spark: SparkSession, **paths: str | None) -> None:
    """Raise if a given path is missing, on any file system that Spark reads."""
    conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    missing = [f"{n}={p}" for n, p in paths.items() if p and not (x := hadoop(p)).getFileSystem(conf).exists(x)]
    if missing:
        raise FileNotFoundError(f"missing inputs: {', '.join(missing)}")
