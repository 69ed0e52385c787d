"""Grids of values as tiles, and their samples at points.

A tile is one row: its place in the grid of tiles and its values, row by row from the north. Points
meet the tiles of the pixels that they need, at most four, in one equi-join, so a sample that lies
across the edge of tiles is like any other; a tile with very many points is a skewed join, which AQE
splits. Samples that need a pixel without data, or outside the grid, are null.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Grid(NamedTuple):
    """Western and northern edge, width of a pixel, pixels to a side of a tile, the value that stands for no data."""

    west: float
    north: float
    pixel: float
    side: int
    nodata: float = -9999.0


def tiles(pixels: DataFrame, grid: Grid) -> DataFrame:
    """tile_x, tile_y, values from pixels (column, row, value), one row each; what is missing has no data."""
    side = grid.side
    at = F.pmod("row", F.lit(side)) * side + F.pmod("column", F.lit(side))
    rows = pixels.select(F.floor(F.col("column") / side).alias("tile_x"), F.floor(F.col("row") / side).alias("tile_y"), F.struct(at.cast("int").alias("at"), F.col("value").cast("double").alias("value")).alias("p"))
    held = rows.groupBy("tile_x", "tile_y").agg(F.map_from_entries(F.collect_list("p")).alias("held"))
    values = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.coalesce(F.element_at("held", k), F.lit(grid.nodata)))
    return held.select("tile_x", "tile_y", values.alias("values"))


def corners(x: Column, y: Column, grid: Grid, smooth: bool) -> Column:
    """The pixels that a point needs, with their weights: its own, or the four whose centres are around it."""
    across, down = (x - grid.west) / grid.pixel, (F.lit(grid.north) - y) / grid.pixel
    if not smooth:
        return F.array(F.struct(F.floor(across).alias("column"), F.floor(down).alias("row"), F.lit(1.0).alias("weight")))
    c, r = F.floor(across - 0.5), F.floor(down - 0.5)
    fx, fy = across - 0.5 - c, down - 0.5 - r
    return F.array(*[F.struct((c + i).alias("column"), (r + j).alias("row"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("weight")) for i in (0, 1) for j in (0, 1)])


def sample(points: DataFrame, keys: list[str], raster: DataFrame, grid: Grid, smooth: bool = False) -> DataFrame:
    """keys and value of each point (keys, x, y): of the pixel that it lies in, or smooth between pixels."""
    needed = points.select(*keys, F.explode(corners(F.col("x"), F.col("y"), grid, smooth)).alias("c")).filter("c.weight > 0")
    side = grid.side
    placed = needed.select(*keys, "c.weight", F.floor(F.col("c.column") / side).alias("tile_x"), F.floor(F.col("c.row") / side).alias("tile_y"), (F.pmod("c.row", F.lit(side)) * side + F.pmod("c.column", F.lit(side))).cast("int").alias("at"))
    value = F.get("values", F.col("at"))
    usable = F.when(~F.isnan(value) & (F.abs(value) < float("inf")) & (value != grid.nodata), value)
    met = placed.join(raster, ["tile_x", "tile_y"], "left").select(*keys, "weight", usable.alias("value"))
    whole = F.count("value") == F.count(F.lit(1))
    return met.groupBy(*keys).agg(F.when(whole, F.sum(F.col("weight") * F.col("value"))).alias("value"))
