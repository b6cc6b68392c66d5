"""What kind of store a target is, and opening it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.ranged import length, locate, on_web

# Name endings of the kinds, the files or folders that mark a folder as one, and words in an address.
ENDINGS = {
    "zarr": (".zarr", ".zmetadata", "zarr.json"),
    "netcdf": (".nc", ".nc3", ".nc4", ".cdf", ".netcdf", ".h5", ".hdf5", ".hdf", ".he5"),
    "geotiff": (".tif", ".tiff", ".gtiff", ".geotif", ".geotiff", ".cog"),
}
MARKERS = {"icechunk": ("icechunk.json", "snapshots", "manifests", "config.json"), "zarr": ("zarr.json", ".zmetadata", ".zgroup", ".zarray")}
SCHEMES = {"zarr": ("zarr://",), "netcdf": ("netcdf://", "hdf5://"), "geotiff": ("geotiff://",), "icechunk": ("icechunk://", "icechunk+", "vcc://")}


class UnsupportedStore(ValueError):
    """The target is of no kind that can be read."""


def marked_kind(target: str) -> str | None:
    """icechunk or zarr, by what a folder holds; None where it holds no marker or is no folder."""
    from pyarrow.fs import FileType

    if on_web(target):
        found = (kind for kind, names in MARKERS.items() if any("." in name and length(f"{target}/{name}") is not None for name in names))
        return next(found, None)
    try:
        fs, path = locate(target)
    except ValueError:  # no address of a file system
        return None
    for kind, names in MARKERS.items():
        if any(info.type != FileType.NotFound for info in fs.get_file_info([f"{path}/{name}" for name in names])):
            return kind
    return None


def kind_of(target: str) -> str:
    """zarr, netcdf, geotiff or icechunk: by scheme, then by ending (a query string does not count), then by the markers of a folder."""
    bare = target.strip().strip("'\"").split("?")[0].rstrip("/")
    low = bare.lower()
    for kind, starts in SCHEMES.items():
        if low.startswith(starts):
            return kind
    for kind, ends in ENDINGS.items():
        if low.endswith(ends):
            return kind
    if ".zarr/" in low:
        return "zarr"
    kind = marked_kind(bare) if bare else None
    if kind is None:
        raise UnsupportedStore(target)
    return kind


def _without_scheme(target: str, kind: str) -> str:
    start = f"{kind}://"
    return target[len(start) :] if target.lower().startswith(start) else target


def _readers(target: str) -> tuple[str, str]:
    kind = kind_of(target)
    if kind == "icechunk":
        raise UnsupportedStore(target)
    return kind, _without_scheme(target, kind)


def open_variables(spark: SparkSession, target: str) -> DataFrame:
    """The table of variables of a store of any kind."""
    from gridloom.sources import geotiff, netcdf3, zarr

    kind, place = _readers(target)
    return {"zarr": zarr.variables, "netcdf": netcdf3.variables, "geotiff": geotiff.rasters}[kind](spark, place)


def open_cells(spark: SparkSession, target: str, variable: str | None = None, dims: list[str] | None = None, **selections) -> DataFrame:
    """Cells (an index column for each dimension, and v) of an array of a store of any kind: of ``variable``, or of a band of a raster by its number.

    ``dims`` names the dimensions; those of rasters are y and x.  Selections by dimension reach the chunks that are read."""
    from gridloom.sources import geotiff, netcdf3, zarr

    kind, place = _readers(target)
    if kind == "zarr":
        found, dims = zarr.chunks(spark, place, variable, **selections), dims or zarr.Layout(zarr.open_array(place, variable)).dims
    elif kind == "netcdf":
        found = netcdf3.chunks(spark, place, variable, **selections)
        dims = dims or netcdf3.variables(spark, place).where(F.col("name") == variable).first()["dims"]
    else:
        window = [b for d in "yx" for b in selections[d].bounds()] if {"y", "x"} <= selections.keys() else None
        found, dims = geotiff.tiles(spark, place, 0, int(variable or 0), window), ["y", "x"]
    return zarr.cells(found, dims, **selections)
