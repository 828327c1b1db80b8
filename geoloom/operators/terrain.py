"""Terrain derivatives over tile tables.

Each tile receives the one-pixel border of its eight neighbours: tiles emit their
edge strips keyed by the neighbour, one shuffle brings at most nine rows per tile
together, and the 3x3 window then runs inside each tile.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import one_of
from .raster import Grid

SIDES = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


def _strip(dr: int, dc: int) -> Column:
    """The part of a tile that its neighbour in direction ``(dr, dc)`` needs."""
    v, h, w = F.col("values"), F.col("h"), F.col("w")
    row = h - 1 if dr == 1 else F.lit(0)
    col = w - 1 if dc == 1 else F.lit(0)
    if dr and dc:
        return F.array(F.get(v, (row * w + col).cast("int")))
    if dr:
        return F.slice(v, (row * w + 1).cast("int"), w)
    return F.transform(F.sequence(F.lit(0), h - 1), lambda r: F.get(v, (r * w + col).cast("int")))


def with_halo(tiles: DataFrame) -> DataFrame:
    """Add one array column per side holding the neighbour's border, NULL where there is none."""
    keys = ["raster_id", "band", "tile_row", "tile_col"]
    copies = [
        F.struct(
            F.col("tile_row").alias("r"), F.col("tile_col").alias("c"), F.lit(4).alias("side"),
            F.col("values").alias("v"), F.col("h"), F.col("w"),
        )
    ]
    for dr, dc in SIDES:
        # the neighbour at (+dr, +dc) sees this tile on its opposite side
        copies.append(
            F.struct(
                (F.col("tile_row") + dr).cast("int").alias("r"), (F.col("tile_col") + dc).cast("int").alias("c"),
                F.lit((1 - dr) * 3 + (1 - dc)).alias("side"), _strip(dr, dc).alias("v"), F.col("h"), F.col("w"),
            )
        )
    sent = tiles.select("raster_id", "band", F.explode(F.array(*copies)).alias("s")).select(
        "raster_id", "band", F.col("s.r").alias("tile_row"), F.col("s.c").alias("tile_col"),
        F.col("s.side").alias("side"), F.col("s.v").alias("v"), F.col("s.h").alias("h"), F.col("s.w").alias("w"),
    )
    grouped = sent.groupBy(*keys).agg(
        *[F.max_by("v", F.when(F.col("side") == i, F.lit(1))).alias(f"side{i}") for i in range(9)],
        F.max(F.when(F.col("side") == 4, F.col("h"))).alias("h"), F.max(F.when(F.col("side") == 4, F.col("w"))).alias("w"),
    )
    return grouped.where("h is not null").withColumnRenamed("side4", "values")


def _padded(h: int, w: int, sides: dict[int, np.ndarray | None], last_row: bool, last_col: bool, first_row: bool, first_col: bool, edge: bool = False) -> np.ndarray:
    """The tile with its border; where the raster ends its own pixels repeat, a missing tile inside is NaN unless it is an edge."""
    out = np.full((h + 2, w + 2), np.nan)
    out[1:-1, 1:-1] = np.asarray(sides[4], dtype=float).reshape(h, w)

    def fill(cells, strip, edge, inner):
        if strip is not None:
            out[cells] = np.asarray(strip, dtype=float)
        elif edge:
            out[cells] = out[inner]

    mid = slice(1, -1)
    fill((mid, 0), sides[3], first_col, (mid, 1))
    fill((mid, -1), sides[5], last_col, (mid, -2))
    fill((0, mid), sides[1], first_row, (1, mid))
    fill((-1, mid), sides[7], last_row, (-2, mid))
    for side, r, c, top, left in ((0, 0, 0, first_row, first_col), (2, 0, -1, first_row, last_col), (6, -1, 0, last_row, first_col), (8, -1, -1, last_row, last_col)):
        strip = sides[side]
        ri, ci = (1 if r == 0 else -2), (1 if c == 0 else -2)
        if top:
            out[r, c] = out[ri, c]
        elif strip is not None:
            out[r, c] = np.asarray(strip, dtype=float)[0]
        elif left or edge:
            out[r, c] = out[r, ci]
    return out


def gradients(tiles: DataFrame, grid: Grid, z_factor: float = 1.0, missing: str = "null") -> DataFrame:
    """Tiles with ``dzdx`` and ``dzdy`` arrays (Horne 3x3); NULL where any neighbour is NULL.

    ``grid`` tells where the raster ends, so that its border repeats its own pixels.  A tile that the table lacks
    has NULL pixels, or with ``missing="edge"`` the raster ends there too.
    """
    edge = one_of("missing", missing, ("null", "edge")) == "edge"
    if not math.isfinite(z_factor) or z_factor <= 0:
        raise ValueError("z_factor must be a positive, finite number")
    dx, dy = grid.cell_meters()
    height, width = grid.height, grid.width

    @F.pandas_udf("struct<dzdx:array<double>,dzdy:array<double>>")
    def horne(pdf: pd.DataFrame) -> pd.DataFrame:
        gx, gy = [], []
        for t in pdf.itertuples(index=False):
            h, w = int(t.h), int(t.w)
            sides = {i: getattr(t, "values_" if i == 4 else f"side{i}") for i in range(9)}
            ends = ((t.tile_row + 1) * h >= height, (t.tile_col + 1) * w >= width, t.tile_row == 0, t.tile_col == 0)
            p = _padded(h, w, sides, *(end or edge and sides[i] is None for end, i in zip(ends, (7, 5, 1, 3))), edge)
            # a tile that reaches past the raster's end repeats the last real row or column
            rows, cols = height - t.tile_row * h, width - t.tile_col * w
            if rows < h:
                p[rows + 1] = p[rows]
            if cols < w:
                p[:, cols + 1] = p[:, cols]
            east = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]
            west = p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2]
            north = p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:]
            south = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]
            zx = (east - west) / (8 * dx) * z_factor
            zy = (north - south) / (8 * dy) * z_factor
            bad = ~np.isfinite(zx) | ~np.isfinite(zy) | ~np.isfinite(p[1:-1, 1:-1])
            zx[bad] = np.nan
            zy[bad] = np.nan
            gx.append(zx.ravel())
            gy.append(zy.ravel())
        return pd.DataFrame({"dzdx": gx, "dzdy": gy})

    haloed = with_halo(tiles)
    packed = F.struct(
        "tile_row", "tile_col", "h", "w", F.col("values").alias("values_"), *[F.col(f"side{i}") for i in range(9) if i != 4]
    )
    out = haloed.select("raster_id", "band", "tile_row", "tile_col", "h", "w", horne(packed).alias("_g"))

    def nulled(c: str) -> Column:
        return F.transform(F.col(f"_g.{c}"), lambda v: F.when(~F.isnan(v), v))

    return out.select(
        "raster_id", "band", "tile_row", "tile_col", "h", "w", nulled("dzdx").alias("dzdx"), nulled("dzdy").alias("dzdy")
    )


def _derived(tiles: DataFrame, fn) -> DataFrame:
    return tiles.withColumn("values", F.zip_with("dzdx", "dzdy", fn)).drop("dzdx", "dzdy")


def hillshade(
    tiles: DataFrame, grid: Grid, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0, missing: str = "null"
) -> DataFrame:
    """Shaded relief 0..255, cut to whole numbers; pixels without a gradient are 0."""
    if not 0 <= azimuth <= 360:
        raise ValueError("azimuth must be between 0 and 360 degrees")
    if not 0 <= altitude <= 90:
        raise ValueError("altitude must be between 0 and 90 degrees")
    zenith, light = math.radians(90.0 - altitude), math.radians(azimuth)

    def shade(x: Column, y: Column) -> Column:
        slope = F.atan(F.hypot(x, y))
        facing = F.atan2(-x, -y)
        s = F.lit(math.cos(zenith)) * F.cos(slope) + F.lit(math.sin(zenith)) * F.sin(slope) * F.cos(F.lit(light) - facing)
        return F.coalesce(F.floor(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)) * 255.0), F.lit(0)).cast("short")

    return _derived(gradients(tiles, grid, z_factor, missing), shade)


def slope(tiles: DataFrame, grid: Grid, units: str = "degrees", z_factor: float = 1.0, missing: str = "null") -> DataFrame:
    one_of("units", units, ("degrees", "percent"))

    def steepness(x: Column, y: Column) -> Column:
        g = F.hypot(x, y)
        return F.degrees(F.atan(g)) if units == "degrees" else g * 100.0

    return _derived(gradients(tiles, grid, z_factor, missing), steepness)


def aspect(tiles: DataFrame, grid: Grid, z_factor: float = 1.0, missing: str = "null") -> DataFrame:
    """Compass direction the slope faces; flat pixels take 0."""
    # adding 0.0 turns -0.0 into 0.0, so that flat ground faces 0 and not 180
    return _derived(
        gradients(tiles, grid, z_factor, missing),
        lambda x, y: F.when((x == 0) & (y == 0), F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(-x + 0.0, -y + 0.0)), F.lit(360.0))),
    )
