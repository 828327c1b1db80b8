"""Raster operators on pixel tables and tile tables.

A pixel table has ``row, col, value`` (one value column per band where several are
needed); a tile table has ``raster_id, band, tile_row, tile_col, h, w, values``.  A
masked pixel is NULL.  ``Grid`` holds what places pixels on the ground.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import crs as C
from ..functions import geom as G
from ..functions import predicates as P
from ..session import cut_lineage, one_of
from .joins import candidate_pairs
from .percentiles import group_percentiles

# The bands each spectral index needs.
INDEX_BANDS = {
    "ndvi": ("nir", "red"),
    "gndvi": ("nir", "green"),
    "ndwi": ("green", "nir"),
    "ndmi": ("nir", "swir16"),
    "ndbi": ("swir16", "nir"),
    "nbr": ("nir", "swir22"),
    "evi": ("nir", "red", "blue"),
    "savi": ("nir", "red"),
}
ZONAL_STATS = ("count", "mean", "min", "max", "sum", "std", "median")


@dataclass(frozen=True)
class Grid:
    """An affine pixel grid: ``x = a*col + b*row + c``, ``y = d*col + e*row + f``."""

    width: int
    height: int
    srid: int = 4326
    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = -1.0
    f: float = 0.0

    def place(self, col, row) -> tuple[Column, Column]:
        col, row = G.as_col(col), G.as_col(row)
        return (
            col * F.lit(self.a) + row * F.lit(self.b) + F.lit(self.c),
            col * F.lit(self.d) + row * F.lit(self.e) + F.lit(self.f),
        )

    def locate(self, x, y) -> tuple[Column, Column]:
        """Fractional ``(col, row)`` of a position."""
        x, y = G.as_col(x) - F.lit(self.c), G.as_col(y) - F.lit(self.f)
        det = self.a * self.e - self.b * self.d
        # without rotation one division, so that a position halfway between two pixels stays there
        upright = (F.lit(self.b) == 0) & (F.lit(self.d) == 0)
        return (
            F.when(upright, x / F.lit(self.a)).otherwise((x * F.lit(self.e) - y * F.lit(self.b)) / F.lit(det)),
            F.when(upright, y / F.lit(self.e)).otherwise((y * F.lit(self.a) - x * F.lit(self.d)) / F.lit(det)),
        )

    def bounds(self) -> tuple[float, float, float, float]:
        xs = [self.a * u + self.b * v + self.c for u in (0, self.width) for v in (0, self.height)]
        ys = [self.d * u + self.e * v + self.f for u in (0, self.width) for v in (0, self.height)]
        return min(xs), min(ys), max(xs), max(ys)

    def cell_meters(self) -> tuple[float, float]:
        """Pixel spacing in metres; degrees are scaled at the centre latitude."""
        per_x = per_y = 1.0
        if self.srid == C.GEOGRAPHIC:
            # Metres per degree of longitude at the equator and of latitude.
            per_x, per_y = 111_320.0, 110_540.0
            box = self.bounds()
            per_x *= math.cos(math.radians(0.5 * (box[1] + box[3])))
        return tuple(abs(cell) * per or 1.0 for cell, per in ((self.a, per_x), (self.e, per_y)))

    def same_as(self, other: "Grid") -> bool:
        return self == other


#: The columns of a table of rasters that make a grid.
GRID = ("width", "height", "srid", "a", "b", "c", "d", "e", "f")


def grid_of(prefix: str = "") -> Grid:
    """A grid whose numbers are columns; its ``srid`` is one too, so positions have to be in it already."""
    return Grid(*(F.col(prefix + c) for c in GRID))


def with_grid(pixels: DataFrame, rasters: DataFrame, keys: list[str], prefix: str = "_g_") -> DataFrame:
    """``pixels`` with the grid of their raster beside them, from ``rasters(keys, width, height, srid, a..f)``."""
    return pixels.join(rasters.select(*keys, *(F.col(c).alias(prefix + c) for c in GRID)), keys)


def srids_of(rasters: DataFrame) -> list[int]:
    """The coordinate systems in use, of which there are few."""
    return sorted(r.srid for r in rasters.select("srid").distinct().collect())


def require_same_grid(first: Grid, *others: Grid) -> None:
    if any(not first.same_as(g) for g in others):
        raise ValueError("the rasters do not share one grid and CRS; reproject and clip them first")


def raster_info(meta: DataFrame) -> DataFrame:
    """Bounds of every raster from its affine transform and size."""
    xs = [F.col("a") * u + F.col("b") * v + F.col("c") for u in (F.lit(0), F.col("width")) for v in (F.lit(0), F.col("height"))]
    ys = [F.col("d") * u + F.col("e") * v + F.col("f") for u in (F.lit(0), F.col("width")) for v in (F.lit(0), F.col("height"))]
    return meta.withColumns(
        {"minx": F.least(*xs), "miny": F.least(*ys), "maxx": F.greatest(*xs), "maxy": F.greatest(*ys)}
    )


def tile_pixels(tiles: DataFrame, *extra: str) -> DataFrame:
    """A tile table as pixel rows."""
    out = tiles.select("tile_row", "tile_col", "h", "w", *extra, F.posexplode("values").alias("_i", "value"))
    return out.select(
        *extra,
        (F.col("tile_row") * F.col("h") + F.floor(F.col("_i") / F.col("w"))).cast("int").alias("row"),
        (F.col("tile_col") * F.col("w") + F.col("_i") % F.col("w")).cast("int").alias("col"),
        "value",
    )


def pixel_tiles(pixels: DataFrame, size: int, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """A pixel table as square tiles; pixels that are missing become NULL.

    ``keys`` are those of ``raster_id`` and ``band`` that the pixels have; the others get one name for all.
    """
    size, own = int(size), list(keys or [])
    keyed = pixels.select(
        *own, F.floor(F.col("row") / size).cast("int").alias("tile_row"), F.floor(F.col("col") / size).cast("int").alias("tile_col"),
        ((F.col("row") % size) * size + F.col("col") % size).cast("int").alias("i"), F.col(value).alias("value"),
    )
    cells = keyed.groupBy(*own, "tile_row", "tile_col").agg(F.map_from_entries(F.collect_list(F.struct("i", "value"))).alias("m"))
    names = {"raster_id": F.lit("raster"), "band": F.lit(1)} | {k: F.col(k) for k in own}
    return cells.select(
        *(c.alias(k) for k, c in names.items()), "tile_row", "tile_col", F.lit(size).alias("h"), F.lit(size).alias("w"),
        F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.element_at("m", i)).alias("values"),
    )


# -- statistics -----------------------------------------------------------


def valid(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def band_stats(pixels: DataFrame, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """min, max, mean, std (population), p2 and p98 over valid pixels; one row per raster and band that ``keys`` name.

    A key without a valid pixel has NULL statistics.
    """
    keys = list(keys or [])
    seen = F.when(valid(value), F.col(value))
    basic = pixels.groupBy(*keys).agg(F.min(seen).alias("min"), F.max(seen).alias("max"), F.avg(seen).alias("mean"), F.stddev_pop(seen).alias("std"))
    p = group_percentiles(pixels, keys, value, [0.02, 0.98]).withColumnsRenamed({"p0": "p2", "p1": "p98"})
    if keys:
        return _beside(basic, p, keys)
    return basic.withColumns({c: p.select(c).scalar() for c in ("p2", "p98")})


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of ``right``, joined by keys that may be NULL."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*(f"_{k}" for k in keys))


def histogram(pixels: DataFrame, bins: int = 256, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Equal bins over min..max, the maximum in the last one; a flat band spans value ± 0.5.

    With ``keys`` every raster and band has its own range and all its bins.
    """
    keys = list(keys or [])
    rows = pixels.where(valid(value))
    edges = rows.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    edges = edges.select(
        *keys, F.struct(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi")).alias("_e")
    )
    with_edges = _beside(rows, edges, keys) if keys else rows.withColumn("_e", edges.scalar())
    binned = with_edges.select(
        *keys, F.least(F.width_bucket(F.col(value), F.col("_e.lo"), F.col("_e.hi"), F.lit(bins)) - 1, F.lit(bins - 1)).alias("bin")
    )
    counts = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    own = pixels.select(*keys).distinct() if keys else pixels.sparkSession.range(1).select()
    every = own.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return _beside(every, counts, [*keys, "bin"]).select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def stretch_limits(pixels: DataFrame, values: str | list[str], method: str, pmin: float, pmax: float, keys: list[str] | None = None) -> DataFrame:
    """``keys`` and a struct ``lo, hi`` for each of the ``values``: percentile or min-max limits; one row without keys.

    All columns share one pass: they are told apart by a further key.
    """
    one_of("method", method, ("percentile", "minmax"))
    keys, values = list(keys or []), [values] if isinstance(values, str) else list(values)
    if method == "minmax":
        seen = {v: F.when(valid(v), F.col(v)).cast("double") for v in values}
        return pixels.groupBy(*keys).agg(*(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(v) for v, c in seen.items()))
    long = pixels.select(*keys, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)))).alias("_s"))
    p = group_percentiles(long.select(*keys, F.col("_s.i").alias("_i"), F.col("_s.v").alias("_x")), [*keys, "_i"], "_x", [pmin / 100, pmax / 100])
    picked = {v: F.when(F.col("_i") == i, F.struct(F.col("p0").alias("lo"), F.col("p1").alias("hi"))) for i, v in enumerate(values)}
    return p.groupBy(*keys).agg(*(F.max(c).alias(v) for v, c in picked.items()))


def _with_limits(pixels: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """``pixels`` with the columns of ``limits`` in a struct ``_lim``."""
    packed = limits.select(*keys, F.struct(*(c for c in limits.columns if c not in keys)).alias("_lim"))
    return _beside(pixels, packed, keys) if keys else pixels.withColumn("_lim", packed.scalar())


def to_byte(value: Column, lo: Column, hi: Column) -> Column:
    """Linear stretch to 0..255, clipped and cut to whole numbers."""
    return F.floor(F.least(F.greatest((value - lo) / (hi - lo) * 255.0, F.lit(0.0)), F.lit(255.0))).cast("short")


def rescale(
    pixels: DataFrame, value: str = "value", vmin: float | None = None, vmax: float | None = None,
    method: str = "percentile", pmin: float = 2, pmax: float = 98, fill: bool = False, keys: list[str] | None = None,
) -> DataFrame:
    """Stretch a band to bytes; a flat band gives 0, NULL stays NULL unless ``fill`` makes it 0.

    With ``keys`` every raster and band is stretched between limits of its own.
    """
    out, keys = pixels, list(keys or [])
    if vmin is None or vmax is None:
        out = _with_limits(out, stretch_limits(pixels, value, method, pmin, pmax, keys), keys)
    lo = F.lit(float(vmin)) if vmin is not None else F.col(f"_lim.{value}.lo")
    hi = F.lit(float(vmax)) if vmax is not None else F.col(f"_lim.{value}.hi")
    byte = F.when(F.col(value).isNull(), F.lit(0 if fill else None)).when(hi <= lo, F.lit(0)).otherwise(to_byte(F.col(value), lo, hi))
    return out.withColumn(value, byte.cast("short")).drop("_lim")


# -- expressions ----------------------------------------------------------


def band_math(bands: DataFrame, expression: str, name: str = "value") -> DataFrame:
    """A Spark SQL expression over the band columns."""
    return bands.withColumn(name, F.expr(expression).cast("double"))


def spectral_index(
    bands: DataFrame, index: str = "ndvi", names: dict[str, str] | None = None, scale: float = 1.0, L: float = 0.5,
    out: str = "value",
) -> DataFrame:
    """A named index per pixel; masked bands and zero denominators give NULL."""
    key = one_of("index", index.strip().lower(), INDEX_BANDS)
    if not (math.isfinite(scale) and scale):
        raise ValueError(f"bands cannot be divided by a scale of {scale!r}")
    column_of = dict(zip(INDEX_BANDS[key], INDEX_BANDS[key])) | (names or {})
    b = {band: F.col(column_of[band]).cast("double") / float(scale) for band in INDEX_BANDS[key]}
    if key == "evi":
        top = (b["nir"] - b["red"]) * 2.5
        low = b["nir"] + b["red"] * 6.0 - b["blue"] * 7.5 + 1.0
    elif key == "savi":
        top = (b["nir"] - b["red"]) * (1.0 + L)
        low = b["nir"] + b["red"] + F.lit(float(L))
    else:
        first, second = (b[n] for n in INDEX_BANDS[key])
        top, low = first - second, first + second
    value = F.when(low != 0, top / low)
    return bands.withColumn(out, F.when(~F.isnan(value), value))


def stack_bands(rasters: dict[str, tuple[DataFrame, Grid]]) -> DataFrame:
    """Single-band pixel tables on one grid as one table with a column per band."""
    grids = [g for _, g in rasters.values()]
    require_same_grid(grids[0], *grids[1:])
    out = None
    for name, (df, _) in rasters.items():
        band = df.select("row", "col", F.col("value").alias(name))
        out = band if out is None else out.join(band, ["row", "col"])
    return out


def compose_rgb(
    bands: DataFrame, red: str = "red", green: str = "green", blue: str = "blue", stretch: bool = True,
    pmin: float = 2, pmax: float = 98, keys: list[str] | None = None,
) -> DataFrame:
    """Three bands stretched to bytes; masked pixels are 0.  With ``keys`` every raster has limits of its own."""
    keys, names = list(keys or []), list(dict.fromkeys((red, green, blue)))
    out = _with_limits(bands, stretch_limits(bands, names, "percentile" if stretch else "minmax", pmin, pmax, keys), keys)
    for name in names:
        lo, hi = F.col(f"_lim.{name}.lo"), F.col(f"_lim.{name}.hi")
        byte = to_byte(F.col(name), lo, F.when(hi <= lo, lo + 1.0).otherwise(hi))
        out = out.withColumn(name, F.coalesce(byte, F.lit(0)).cast("short"))
    return out.drop("_lim")


# -- location -------------------------------------------------------------


def sample_points(
    points: DataFrame, pixels: DataFrame, grid: Grid, x: str = "x", y: str = "y", srid: int = 4326, value: str = "value"
) -> DataFrame:
    """The pixel value under each position, NULL outside; positions are reprojected first."""
    gx, gy = C.transform_xy(srid, grid.srid, F.col(x), F.col(y))
    col, row = grid.locate(gx, gy)
    at = points.withColumns({"col": F.floor(col).cast("int"), "row": F.floor(row).cast("int")})
    return at.join(pixels.select("row", "col", value), ["row", "col"], "left")


def clip_bounds(pixels: DataFrame, grid: Grid, bounds, bounds_srid: int = 4326) -> tuple[DataFrame, Grid]:
    """Pixels of the window that covers a box, and the window's grid.

    The window is a range on ``row``/``col`` with literal ends, so it reaches the scan.
    """
    west, south, east, north = (float(v) for v in bounds)
    if not all(map(math.isfinite, (west, south, east, north))) or west >= east or south >= north:
        raise ValueError("bounds must be [west, south, east, north]")
    if bounds_srid != grid.srid:
        if bounds_srid == C.GEOGRAPHIC and not (-180 <= west <= 180 and -180 <= east <= 180 and -90 <= south <= 90 and -90 <= north <= 90):
            raise ValueError(f"bounds {bounds} are outside longitude/latitude range")
        west, south, east, north = project_box(pixels.sparkSession, (west, south, east, north), bounds_srid, grid.srid)
    det = grid.a * grid.e - grid.b * grid.d
    corners = []
    for x, y in ((west, south), (west, north), (east, south), (east, north)):
        u, v = x - grid.c, y - grid.f
        corners.append(((u * grid.e - v * grid.b) / det, (v * grid.a - u * grid.d) / det))
    c0, c1 = max(min(c for c, _ in corners), 0.0), min(max(c for c, _ in corners), grid.width)
    r0, r1 = max(min(r for _, r in corners), 0.0), min(max(r for _, r in corners), grid.height)
    if c1 - c0 < 1 or r1 - r0 < 1:
        raise ValueError(f"bounds {bounds} do not overlap this raster")
    c0, r0 = math.floor(c0 + 1e-9), math.floor(r0 + 1e-9)
    c1, r1 = math.ceil(c1 - 1e-9), math.ceil(r1 - 1e-9)
    window = pixels.where(F.col("col").between(c0, c1 - 1) & F.col("row").between(r0, r1 - 1))
    moved = Grid(
        c1 - c0, r1 - r0, grid.srid, grid.a, grid.b, grid.a * c0 + grid.b * r0 + grid.c,
        grid.d, grid.e, grid.d * c0 + grid.e * r0 + grid.f,
    )
    return window.withColumns({"row": F.col("row") - r0, "col": F.col("col") - c0}), moved


def project_box(spark, box, src: int, dst: int, steps: int = 21) -> tuple[float, float, float, float]:
    """The extent of a box's outline in another CRS (a few dozen positions)."""
    w, s, e, n = box
    edge = [(w + (e - w) * i / (steps - 1), s + (n - s) * i / (steps - 1)) for i in range(steps)]
    ring = [(x, yy) for x, _ in edge for yy in (s, n)] + [(xx, y) for _, y in edge for xx in (w, e)]
    pts = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])
    one = spark.range(1).select(F.explode(pts).alias("p"))
    x, y = C.transform_xy(src, dst, F.col("p.x"), F.col("p.y"))
    return tuple(one.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first())


def clip_mask(pixels: DataFrame, grid: Grid, mask: DataFrame, geom: str = "geom") -> DataFrame:
    """Pixels whose centre lies in a mask polygon, the rest NULL, cropped to the mask's box.

    The mask layer must be in the raster's CRS.
    """
    box = G.with_bbox(mask.select(geom), geom)
    x, y = grid.place(F.col("col") + 0.5, F.col("row") + 0.5)
    edge = box.agg(*[F.struct(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")).alias("b")])
    inside = centres_in_zones(pixels.select("row", "col"), grid, mask.select(geom), geom).select("row", "col").distinct()
    hw, hh = abs(grid.a) / 2, abs(grid.e) / 2
    near = pixels.withColumns({"_b": edge.scalar(), "_x": x, "_y": y}).where(
        (F.col("_x") + hw > F.col("_b.minx")) & (F.col("_x") - hw < F.col("_b.maxx"))
        & (F.col("_y") + hh > F.col("_b.miny")) & (F.col("_y") - hh < F.col("_b.maxy"))
    ).drop("_b", "_x", "_y")
    kept = near.join(inside.withColumn("_in", F.lit(True)), ["row", "col"], "left")
    return kept.withColumn("value", F.when(F.col("_in"), F.col("value"))).drop("_in")


def default_grid(spark, grid: Grid, dst_srid: int) -> Grid:
    """A north-up grid in another CRS that keeps the diagonal's pixel count."""
    w, s, e, n = project_box(spark, grid.bounds(), grid.srid, dst_srid)
    res = math.hypot(e - w, n - s) / math.hypot(grid.width, grid.height)
    return Grid(max(1, round((e - w) / res)), max(1, round((n - s) / res)), dst_srid, res, 0.0, w, 0.0, -res, n)


RESAMPLING = ("nearest", "bilinear", "cubic", "average", "mode", "min", "max", "median")


def _kernel(t: Column) -> Column:
    """Cubic convolution weights (the usual a = -0.5) at distance ``t``."""
    return (
        F.when(t <= 1, (F.lit(1.5) * t - 2.5) * t * t + 1)
        .when(t < 2, ((F.lit(-0.5) * t + 2.5) * t - 4) * t + 2)
        .otherwise(0.0)
    )


def reproject(
    pixels: DataFrame, grid: Grid, dst: Grid, resampling: str = "nearest", value: str = "value"
) -> DataFrame:
    """Warp onto another grid: every target pixel looks up its sources by an equi-join.

    ``nearest``, ``bilinear`` (2 x 2) and ``cubic`` (4 x 4) read around the target's centre; ``average``,
    ``mode``, ``min``, ``max`` and ``median`` read every valid pixel whose centre lies in the target's
    footprint: source pixels find their target, so each is read once.  Ties of ``mode`` go to the lesser value.
    """
    one = pixels.select(F.lit(0).alias("_r"), "row", "col", F.col(value).alias("value"))
    return _warped(one, ["_r"], grid, dst, resampling, pixels.sparkSession.range(1).select(F.lit(0).alias("_r"))).drop("_r")


def reproject_all(pixels: DataFrame, rasters: DataFrame, targets: DataFrame, resampling: str = "nearest", keys: list[str] | None = None, value: str = "value") -> DataFrame:
    """Many rasters warped at once: ``keys, row, col, value`` on the grid that ``targets`` names for each.

    ``rasters`` and ``targets`` hold ``raster_id`` and the columns of ``GRID``; ``keys`` are those of the pixels, ``raster_id``
    first (for example with ``band``).
    """
    keys = list(keys or ["raster_id"])
    s, d = ([F.col(c).alias(f"_{p}_{c}") for c in GRID] for p in "sd")
    both = rasters.select("raster_id", *s).join(targets.select("raster_id", *d), "raster_id")
    pairs = both.select("_s_srid", "_d_srid").distinct().collect()  # few coordinate systems
    bands = pixels.select(*keys).distinct()
    out = None
    for src, dst in sorted(map(tuple, pairs)):
        own = both.where((F.col("_s_srid") == src) & (F.col("_d_srid") == dst))
        named = pixels.select(*keys, "row", "col", F.col(value).alias("value")).join(own.select("raster_id"), "raster_id", "left_semi")
        source, target = (Grid(*(v if c == "srid" else F.col(f"_{p}_{c}") for c in GRID)) for p, v in (("s", src), ("d", dst)))
        found = _warped(named, keys, source, target, resampling, bands.join(own, "raster_id"), own)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return pixels.select(*keys, "row", "col", F.col(value).cast("double").alias("value")).limit(0)
    return out


def _warped(pixels: DataFrame, keys: list[str], grid: Grid, dst: Grid, resampling: str, each: DataFrame, grids: DataFrame | None = None) -> DataFrame:
    """``keys, row, col, value`` on ``dst`` for every row of ``each``, which holds the keys and the grids' columns."""
    one_of("resampling", resampling, RESAMPLING)
    numbers = [c for c in each.columns if c not in keys]
    width, height = F.lit(dst.width), F.lit(dst.height)
    # the target's rows first, then the pixels of each: no task starts with a whole raster
    lines = each.withColumn("dst_row", F.explode(F.sequence(F.lit(0), (height - 1).cast("int"))))
    n = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = lines.repartition(n, *keys, "dst_row").withColumn("dst_col", F.explode(F.sequence(F.lit(0), (width - 1).cast("int"))))
    if resampling in ("average", "mode", "min", "max", "median"):
        x, y = grid.place(F.col("col") + 0.5, F.col("row") + 0.5)
        placed = pixels.where(valid("value"))
        placed = placed if grids is None else placed.join(grids, "raster_id")
        col, row = dst.locate(*C.transform_xy(grid.srid, dst.srid, x, y))
        placed = placed.select(*keys, F.floor(row).cast("int").alias("row"), F.floor(col).cast("int").alias("col"), F.col("value").cast("double").alias("value"))
        at = [*keys, "row", "col"]
        if resampling == "mode":
            votes = placed.groupBy(*at, "value").agg(F.count(F.lit(1)).alias("_n"))
            found = votes.groupBy(*at).agg(F.max_by("value", F.struct("_n", -F.col("value"))).alias("value"))
        elif resampling == "median":
            found = placed.groupBy(*at).agg(F.median("value").alias("value"))
        else:
            found = placed.groupBy(*at).agg({"average": F.avg, "min": F.min, "max": F.max}[resampling]("value").alias("value"))
        return cells.select(*keys, F.col("dst_row").alias("row"), F.col("dst_col").alias("col")).join(found, at, "left")
    x, y = dst.place(F.col("dst_col") + 0.5, F.col("dst_row") + 0.5)
    col, row = grid.locate(*C.transform_xy(dst.srid, grid.srid, x, y))
    if resampling == "nearest":
        at = cells.withColumns({"row": F.floor(row).cast("int"), "col": F.floor(col).cast("int")}).drop(*numbers)
        return at.join(pixels, [*keys, "row", "col"], "left").select(*keys, F.col("dst_row").alias("row"), F.col("dst_col").alias("col"), "value")
    at = cells.withColumns({"_c": col - 0.5, "_r0": row - 0.5, "_w": F.lit(grid.width), "_h": F.lit(grid.height)}).drop(*numbers)
    reach = (0, 1) if resampling == "bilinear" else (-1, 0, 1, 2)
    corner = F.array(*[F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in reach for j in reach])
    at = at.withColumn("_o", F.explode(corner))
    fr, fc = F.col("_r0") - F.floor("_r0"), F.col("_c") - F.floor("_c")
    if resampling == "bilinear":
        weight = F.when(F.col("_o.dr") == 1, fr).otherwise(1 - fr) * F.when(F.col("_o.dc") == 1, fc).otherwise(1 - fc)
    else:
        weight = _kernel(F.abs(fr - F.col("_o.dr"))) * _kernel(F.abs(fc - F.col("_o.dc")))
    at = at.select(
        *keys, "dst_row", "dst_col", (F.floor("_r0") + F.col("_o.dr")).cast("int").alias("row"),
        (F.floor("_c") + F.col("_o.dc")).cast("int").alias("col"), weight.alias("_k"),
        (F.floor(F.col("_r0") + 0.5).between(0, F.col("_h") - 1) & F.floor(F.col("_c") + 0.5).between(0, F.col("_w") - 1)).alias("_in"),
    )
    found = at.join(pixels, [*keys, "row", "col"], "left")
    have = F.col("value").isNotNull() & F.col("_in")
    return found.groupBy(*keys, "dst_row", "dst_col").agg(
        F.sum(F.when(have, F.col("_k") * F.col("value"))).alias("s"), F.sum(F.when(have, F.col("_k"))).alias("w")
    ).select(
        *keys, F.col("dst_row").alias("row"), F.col("dst_col").alias("col"), F.when(F.col("w") > 0, F.col("s") / F.col("w")).alias("value")
    )


# -- zones ----------------------------------------------------------------


def _rect_tests(touched: bool) -> str:
    if touched:
        return "x + _hw > minx and x - _hw < maxx and y + _hh > miny and y - _hh < maxy"
    return "x > minx and x < maxx and y > miny and y < maxy"


def centres_in_zones(
    pixels: DataFrame, grid: Grid, zones: DataFrame, geom: str = "geom", all_touched: bool = False, block: int = 64, keys: list[str] | None = None,
) -> DataFrame:
    """Pixels joined to the zones that hold their centre (or touch them).

    With ``keys`` the pixels are those of many rasters, and carry the columns that ``grid`` refers to.

    Zones meet blocks of pixels first, by the binned join on boxes; a pixel is tested
    against the outlines of its own block's zones only.
    """
    zone_cols = [c for c in zones.columns if c not in G.BBOX]
    zl = G.with_bbox(zones.select(zone_cols), geom).withColumn("_rect", F.expr(P.is_rectangle(geom)))
    zl = zl.select(*[F.col(c).alias(f"r_{c}") for c in zl.columns])
    keys = list(keys or [])
    own = [f"_g_{c}" for c in GRID] if keys else []
    blocks = pixels.select(
        *(F.col(k).alias(f"l_{k}") for k in keys), *own, F.floor(F.col("row") / block).alias("l__br"), F.floor(F.col("col") / block).alias("l__bc")
    ).distinct()
    x0, y0 = grid.place(F.col("l__bc") * block, F.col("l__br") * block)
    x1, y1 = grid.place((F.col("l__bc") + 1) * block, (F.col("l__br") + 1) * block)
    blocks = blocks.withColumns(
        {"l_minx": F.least(x0, x1), "l_maxx": F.greatest(x0, x1), "l_miny": F.least(y0, y1), "l_maxy": F.greatest(y0, y1)}
    )
    near = candidate_pairs(blocks, zl)
    near = near.select(
        *(F.col(f"l_{k}").alias(k) for k in keys), F.col("l__br").alias("_br"), F.col("l__bc").alias("_bc"),
        *[F.col(f"r_{c}").alias(c) for c in [*zone_cols, *G.BBOX, "_rect"]],
    )
    x, y = grid.place(F.col("col") + 0.5, F.col("row") + 0.5)
    px = pixels.withColumns(
        {"_br": F.floor(F.col("row") / block), "_bc": F.floor(F.col("col") / block), "x": x, "y": y}
    )
    hits = px.join(near, [*keys, "_br", "_bc"]).withColumns({"_hw": F.abs(F.lit(grid.a)) / 2, "_hh": F.abs(F.lit(grid.e)) / 2})
    inside = f"({P.locate('x', 'y', geom)}) = 1"
    if all_touched:
        hits = hits.withColumns({"_pminx": F.col("x") - F.col("_hw"), "_pmaxx": F.col("x") + F.col("_hw"), "_pminy": F.col("y") - F.col("_hh"), "_pmaxy": F.col("y") + F.col("_hh")})
        hits = hits.withColumn("_pg", G.box("_pminx", "_pminy", "_pmaxx", "_pmaxy"))
        inside = P.intersects("_pg", geom, "_p", "")
    test = F.expr(f"case when _rect then {_rect_tests(all_touched)} else {inside} end")
    return hits.where(test).drop(*own, "_br", "_bc", "_rect", "x", "y", "_hw", "_hh", "_pg", "_pminx", "_pmaxx", "_pminy", "_pmaxy", *G.BBOX)


def zonal_stats(
    pixels: DataFrame, grid: Grid, zones: DataFrame, key: str, stats=("count", "mean", "min", "max"),
    prefix: str = "raster", all_touched: bool = False, geom: str = "geom", zones_srid: int | None = None,
) -> DataFrame:
    """Statistics of the valid pixels in each zone as ``<prefix>_<stat>`` columns.

    ``key`` is unique per zone.  A zone without data has count 0 and NULL statistics;
    overlapping zones each count a shared pixel.
    """
    srid = C.layer_srid(zones, zones_srid)
    shaped = zones.select(key, C.transform_geom(F.col(geom), srid, grid.srid).alias(geom))
    # read again by the median
    hits = centres_in_zones(pixels.where(valid("value")), grid, shaped, geom, all_touched).select(key, "value")
    return _zone_table(zones, hits, [key], stats, prefix)


def _zone_table(zones: DataFrame, hits: DataFrame, keys: list[str], stats, prefix: str) -> DataFrame:
    """``zones`` with the statistics of ``hits(keys, value)``."""
    for name in stats:
        one_of("statistic", name, ZONAL_STATS)
    if "median" in stats:
        hits = cut_lineage(hits)  # read twice
    aggregates = {
        "count": F.count("value"), "mean": F.avg("value"), "min": F.min("value"), "max": F.max("value"),
        "sum": F.sum("value"), "std": F.stddev_pop("value"),
    }
    wanted = [n for n in stats if n != "median"] or ["count"]
    summary = hits.groupBy(*keys).agg(*[aggregates[n].alias(f"{prefix}_{n}") for n in wanted])
    out = zones.join(summary, keys, "left")
    if "median" in stats:
        med = group_percentiles(hits, keys, "value", [0.5]).select(*keys, F.col("p0").alias(f"{prefix}_median"))
        out = out.join(med, keys, "left")
    if "count" in wanted:
        out = out.withColumn(f"{prefix}_count", F.coalesce(f"{prefix}_count", F.lit(0)))
    return out if "count" in stats or wanted != ["count"] else out.drop(f"{prefix}_count")


def zonal_stats_all(
    pixels: DataFrame, rasters: DataFrame, zones: DataFrame, key: str, stats=("count", "mean", "min", "max"), keys: list[str] | None = None,
    prefix: str = "raster", all_touched: bool = False, geom: str = "geom", zones_srid: int | None = None,
) -> DataFrame:
    """``zonal_stats`` of many rasters and bands at once: a row for every zone and every one of ``keys``, ``raster_id`` first.

    ``rasters`` holds ``raster_id`` and the columns of ``GRID``; zones are brought into the coordinate system
    of each.
    """
    keys, srid = list(keys or ["raster_id"]), C.layer_srid(zones, zones_srid)
    hits = None
    for own in srids_of(rasters):
        shaped = zones.select(key, C.transform_geom(F.col(geom), srid, own).alias(geom))
        placed = with_grid(pixels.where(valid("value")), rasters.where(F.col("srid") == own), ["raster_id"])
        found = centres_in_zones(placed, grid_of("_g_"), shaped, geom, all_touched, keys=keys).select(key, *keys, "value")
        hits = found if hits is None else hits.unionByName(found)
    bands = pixels.select(*keys).distinct()
    if hits is None:
        hits = pixels.select(*keys, "value").limit(0).withColumn(key, F.lit(None).cast(zones.schema[key].dataType))
    # a row for every zone and band is what is asked for; the bands are dealt, so that no task has them all
    n = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = bands.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))
    every = dealt.join(zones.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), "_b").drop("_b")
    return _zone_table(every, hits, [key, *keys], stats, prefix)


# -- resampling and mosaics -----------------------------------------------


def build_pyramid(tiles: DataFrame, levels: int, resample: str = "nearest") -> DataFrame:
    """Overviews of a tile table: level 0 is the input, each level halves the grid.

    ``nearest`` keeps the upper left pixel of each 2x2 block, ``average`` the mean of
    its valid pixels.
    """
    one_of("resample", resample, ("nearest", "average"))
    keys = [c for c in ("raster_id", "band") if c in tiles.columns]
    base = tiles.select(*keys, F.lit(0).alias("level"), "tile_row", "tile_col", "h", "w", "values")
    out, below = base, base
    for level in range(1, levels + 1):
        below = _halve(below, keys, resample).withColumn("level", F.lit(level))
        out = out.unionByName(below.select(out.columns))
    return out


def _halve(tiles: DataFrame, keys: list[str], resample: str) -> DataFrame:
    """One overview step: each tile shrinks in place, then four of them form a new tile."""
    hh, hw = F.floor(F.col("h") / 2).cast("int"), F.floor(F.col("w") / 2).cast("int")
    cells = F.sequence(F.lit(0), hh * hw - 1)
    w = F.col("w")

    def shrunk(i: Column) -> Column:
        at = F.floor(i / hw).cast("int") * 2 * w + (i % hw) * 2
        block = F.array(*[F.get("values", (at + o).cast("int")) for o in (F.lit(0), F.lit(1), w, w + 1)])
        if resample == "nearest":
            return F.get(block, F.lit(0))
        present = F.filter(block, lambda v: v.isNotNull())
        return F.when(F.size(present) > 0, G.total(present) / F.size(present))

    small = tiles.select(
        *keys, "h", "w", F.floor(F.col("tile_row") / 2).cast("int").alias("tile_row"),
        F.floor(F.col("tile_col") / 2).cast("int").alias("tile_col"),
        ((F.col("tile_row") % 2) * 2 + F.col("tile_col") % 2).cast("int").alias("q"), F.transform(cells, shrunk).alias("v"),
    )
    grouped = small.groupBy(*keys, "tile_row", "tile_col").agg(
        F.max("h").alias("h"), F.max("w").alias("w"),
        *[F.max(F.when(F.col("q") == q, F.col("v"))).alias(f"q{q}") for q in range(4)],
    )

    def value(i: Column) -> Column:
        r, c = F.floor(i / w).cast("int"), (i % w).cast("int")
        local = ((r % hh) * hw + c % hw).cast("int")
        return F.when(
            r < hh, F.when(c < hw, F.get("q0", local)).otherwise(F.get("q1", local))
        ).otherwise(F.when(c < hw, F.get("q2", local)).otherwise(F.get("q3", local)))

    values = F.transform(F.sequence(F.lit(0), (F.col("h") * w - 1).cast("int")), value)
    return grouped.select(*keys, "tile_row", "tile_col", "h", "w", values.alias("values"))


def downsample(pixels: DataFrame, factor: int, value: str = "value") -> DataFrame:
    """Block average of the valid pixels."""
    return pixels.groupBy(
        F.floor(F.col("row") / int(factor)).alias("row"), F.floor(F.col("col") / int(factor)).alias("col")
    ).agg(F.avg(value).alias(value))


def downsample_factor(grid: Grid, max_side: int) -> int:
    return max(1, math.ceil(max(grid.width, grid.height) / max_side))


def mosaic(pixels: DataFrame, priority: str, value: str = "value", keys: list[str] | None = None) -> DataFrame:
    """Rasters on one grid merged: the lowest ``priority`` with a valid pixel wins each cell (of each band, with ``keys``)."""
    best = F.min_by(F.col(value), F.when(valid(value), F.col(priority)))
    return pixels.groupBy(*(keys or []), "row", "col").agg(best.alias(value))


def combine_bounds(boxes: DataFrame) -> DataFrame:
    """Union of boxes, NULL ones ignored."""
    return boxes.where("minx is not null and miny is not null and maxx is not null and maxy is not null").agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")
    )


def index_change(
    before: DataFrame, after: DataFrame, index: str, threshold: float, names: dict[str, str] | None = None, scale: float = 1.0
) -> DataFrame:
    """Pixels of two dates whose index moved by at least ``threshold``; ``value`` is -1 or 1."""
    b = spectral_index(before, index, names, scale, out="_before").select("row", "col", "_before")
    a = spectral_index(after, index, names, scale, out="_after").select("row", "col", "_after")
    both = b.join(a, ["row", "col"]).withColumn("change", F.col("_after") - F.col("_before"))
    return both.where(F.abs(F.col("change")) >= threshold).select(
        "row", "col", "change", F.signum("change").cast("int").alias("value")
    )
