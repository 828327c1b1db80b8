"""Raster to vector: regions of equal value as polygons, contour lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom as G
from ..session import cut_lineage, measure, one_of
from .chains import PATH, completed, paths
from .components import connected_components
from .linking import link_rings
from .raster import Grid, grid_of, valid, with_grid
from .vector import simplify

BLOCK = 64
#: A pixel's sides: the neighbour behind it, then its start and end corner, each as (row, column); the interior lies on the left.
SIDES = ((-1, 0, (0, 1), (0, 0)), (0, -1, (0, 0), (1, 0)), (1, 0, (1, 0), (1, 1)), (0, 1, (1, 1), (0, 1)))
#: Block-local labels are ``row * SPAN + col`` of the region's first pixel.
SPAN = 1 << 31


def label_block(values: np.ndarray) -> np.ndarray:
    """4-connected regions of equal value in one block, NaN is no region (-1)."""
    h, w = values.shape
    ok = ~np.isnan(values)
    lab = np.where(ok, np.arange(h * w).reshape(h, w), -1)
    across = ok[:, 1:] & ok[:, :-1] & (values[:, 1:] == values[:, :-1])
    down = ok[1:] & ok[:-1] & (values[1:] == values[:-1])
    while True:
        before = lab.copy()
        for sel, a, b in ((across, lab[:, :-1], lab[:, 1:]), (down, lab[:-1], lab[1:])):
            low = np.minimum(a, b)
            a[sel] = np.minimum(a[sel], low[sel])
            b[sel] = np.minimum(b[sel], low[sel])
        flat = lab.ravel()
        live = flat >= 0
        flat[live] = flat[flat[live]]
        if np.array_equal(before, lab):
            return lab


def _block_edges(pixels: DataFrame, value: str, block: int, keys: list[str]) -> DataFrame:
    """Directed pixel sides between regions, labelled inside each block.

    Sides inside a region vanish here; sides on a block border are kept and flagged.
    The plane is ``x = col, y = -row``, so the interior lies on the left.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["row"].iloc[0]) // block * block, int(pdf["col"].iloc[0]) // block * block
        grid = np.full((block, block), np.nan)
        r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        grid[r, c] = pdf["value"].to_numpy(dtype=float)
        lab = label_block(grid)
        rows, cols = np.nonzero(lab >= 0)
        own = lab[rows, cols]
        pad = np.full((block + 2, block + 2), -2)
        pad[1:-1, 1:-1] = lab
        frames = []
        for dr, dc, (a, b), (p, q) in SIDES:
            other = pad[rows + 1 + dr, cols + 1 + dc]
            keep = other != own
            rr, cc, lb = rows[keep], cols[keep], own[keep]
            frames.append(
                pd.DataFrame(
                    {
                        "label": (lb // block + r0).astype("int64") * SPAN + (lb % block + c0), "value": grid[rr, cc],
                        "x1": (cc + c0 + b).astype(float), "y1": -(rr + r0 + a).astype(float),
                        "x2": (cc + c0 + q).astype(float), "y2": -(rr + r0 + p).astype(float), "seam": other[keep] == -2,
                    }
                )
            )
        out = pd.concat(frames, ignore_index=True)
        return out.assign(**{k: [pdf[k].iloc[0]] * len(out) for k in keys})[[*keys, "label", "value", "x1", "y1", "x2", "y2", "seam"]]

    types = dict(pixels.dtypes)
    keyed = pixels.where(valid(value)).select(*keys, "row", "col", F.col(value).cast("double").alias("value"))
    blocks = keyed.groupBy(*keys, F.floor(F.col("row") / block).alias("_br"), F.floor(F.col("col") / block).alias("_bc"))
    return blocks.applyInPandas(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "label long, value double, x1 double, y1 double, x2 double, y2 double, seam boolean"]))


def region_edges(pixels: DataFrame, value: str = "value", block: int = BLOCK, keys: list[str] | None = None) -> DataFrame:
    """Boundary sides of every region with its ``region`` id (its first pixel) and ``value``; regions stay within their ``keys``."""
    keys = list(keys or [])
    edges = cut_lineage(_block_edges(pixels, value, block, keys))
    # two blocks see a shared side in opposite directions
    seam = edges.where("seam").select(
        *keys, "label", "value", F.least("x1", "x2").alias("a"), F.least("y1", "y2").alias("b"), F.greatest("x1", "x2").alias("c"), F.greatest("y1", "y2").alias("d")
    )
    met = seam.groupBy(*keys, "a", "b", "c", "d", "value").agg(
        F.min("label").alias("src"), F.max("label").alias("dst"), F.count(F.lit(1)).alias("n")
    ).where("n = 2")

    def node(c: str) -> Column:
        return F.struct(*keys, F.col(c).alias("label")) if keys else F.col(c)

    groups = connected_components(met.select(node("src").alias("src"), node("dst").alias("dst")))
    first = F.col("component.label") if keys else F.col("component")
    named = edges.withColumn("node", node("label")).join(groups, "node", "left").withColumn("region", F.coalesce(first, "label"))
    inner = named.where("not seam").select(*keys, "region", "value", "x1", "y1", "x2", "y2")
    border = named.where("seam").groupBy(
        *keys, "region", F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2")
    ).agg(*[F.first(c).alias(c) for c in ("value", "x1", "y1", "x2", "y2")], F.count(F.lit(1)).alias("n")).where("n = 1")
    return inner.unionByName(border.select(inner.columns))


def polygonize(pixels: DataFrame, grid: Grid, value: str = "value", block: int = BLOCK) -> DataFrame:
    """One polygon per 4-connected region of equal value: ``region, value, geom, srid``."""
    shapes = link_rings(region_edges(pixels, value, block), ["region", "value"])
    placed = G.map_vertices(F.col("geom"), lambda x, y: grid.place(x, -y))
    return shapes.select("region", "value", placed.alias("geom"), F.lit(grid.srid).alias("srid"))


def polygonize_all(pixels: DataFrame, rasters: DataFrame, keys: list[str] | None = None, value: str = "value", block: int = BLOCK) -> DataFrame:
    """``polygonize`` of many rasters and bands at once: ``keys, region, value, geom, srid``.

    ``keys`` has ``raster_id`` first; ``rasters`` holds it and the columns of a grid.
    """
    keys = list(keys or ["raster_id"])
    shapes = with_grid(link_rings(region_edges(pixels, value, block, keys), [*keys, "region", "value"]), rasters, ["raster_id"])
    grid = grid_of("_g_")
    placed = G.map_vertices(F.col("geom"), lambda x, y: grid.place(x, -y))
    return shapes.select(*keys, "region", "value", placed.alias("geom"), grid.srid.alias("srid"))


def region_sizes(pixels: DataFrame, value: str = "value", block: int = BLOCK) -> DataFrame:
    """``region, value, pixels, perimeter`` straight from the boundary sides (no geometry built)."""
    e = region_edges(pixels, value, block)
    return e.groupBy("region", "value").agg(
        F.round(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).cast("long").alias("pixels"),
        F.count(F.lit(1)).alias("perimeter"),
    )


# -- contours -------------------------------------------------------------


def contour_levels(pixels: DataFrame, interval: float, base: float = 0.0, value: str = "value") -> DataFrame:
    """``k, level``: the multiples of ``interval`` from ``base`` that lie in the range of the band, counted from 0."""
    step, zero = F.lit(measure("interval", interval, above_zero=True)), F.lit(float(base))
    extent = pixels.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    ends = extent.select(F.ceil((F.col("lo") - zero) / step).alias("m0"), F.floor((F.col("hi") - zero) / step).alias("m1"))
    marks = ends.where("m0 <= m1").select("m0", F.explode(F.sequence("m0", "m1")).alias("m"))
    return marks.select((F.col("m") - F.col("m0")).alias("k"), (zero + F.col("m") * step).alias("level"))


#: The sides of a cell that a line runs between, start and end, by which corners are high (1 top left, 2 top right,
#: 4 bottom left, 8 bottom right).  Where two opposite corners are high, each is cut off on its own.
CASES = {
    1: ("tl",), 2: ("rt",), 3: ("rl",), 4: ("lb",), 5: ("tb",), 6: ("rt", "lb"), 7: ("rb",), 8: ("br",), 9: ("tl", "br"),
    10: ("bt",), 11: ("bl",), 12: ("lr",), 13: ("tr",), 14: ("lt",),
}
_SIDE = {name: i for i, name in enumerate("tblr")}
#: By case and line: the sides it runs between, -1 where there is none.
_LINES = np.array([[[_SIDE[c] for c in (CASES.get(k, ()) + ("", ""))[i]] or [-1, -1] for i in (0, 1)] for k in range(16)])


def cell_lines(v: np.ndarray, row: int, col: int, interval: float, base: float, width: int) -> dict[str, np.ndarray]:
    """Marching squares over the cells between the pixels ``v``, the first of which stands at ``row, col``.

    ``k, s, e, x1, y1, x2, y2``: the level ``base + k * interval``, names of the grid edges at both ends, and
    the ends as fractional columns and rows.  A corner is high when it exceeds the level.  A cell with a NaN
    corner has no lines.
    """
    tl, tr, bl, br = v[:-1, :-1].ravel(), v[:-1, 1:].ravel(), v[1:, :-1].ravel(), v[1:, 1:].ravel()
    cell = np.flatnonzero(~np.isnan(tl + tr + bl + br))
    tl, tr, bl, br = tl[cell], tr[cell], bl[cell], br[cell]
    low, high = np.minimum.reduce([tl, tr, bl, br]), np.maximum.reduce([tl, tr, bl, br])
    # one more on both sides: the quotients are rounded, the comparison below is not
    first = np.floor((low - base) / interval).astype(np.int64) - 1
    many = np.ceil((high - base) / interval).astype(np.int64) + 2 - first
    at = np.repeat(np.arange(len(tl)), many)
    k = np.repeat(first, many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    level = base + k * interval
    cut = (level >= low[at]) & (level < high[at])
    at, k, level = at[cut], k[cut], level[cut]
    tl, tr, bl, br = tl[at], tr[at], bl[at], br[at]
    r, c = row + cell[at] // (v.shape[1] - 1), col + cell[at] % (v.shape[1] - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.stack([c + (level - tl) / (tr - tl), c + (level - bl) / (br - bl), c + 0.0, c + 1.0])
        y = np.stack([r + 0.0, r + 1.0, r + (level - tl) / (bl - tl), r + (level - tr) / (br - tr)])
    name = np.stack([(r * (width + 1) + c) * 2, ((r + 1) * (width + 1) + c) * 2, (r * (width + 1) + c) * 2 + 1, (r * (width + 1) + c + 1) * 2 + 1])
    case = (tl > level) + 2 * (tr > level) + 4 * (bl > level) + 8 * (br > level)
    ends = _LINES[case].reshape(-1, 2)
    one = np.flatnonzero(ends[:, 0] >= 0)
    a, b, of = ends[one, 0], ends[one, 1], one // 2
    return {"k": k[of], "s": name[a, of], "e": name[b, of], "x1": x[a, of], "y1": y[a, of], "x2": x[b, of], "y2": y[b, of]}


def contour_runs(pixels: DataFrame, grid: Grid, interval: float, base: float, value: str, block: int) -> DataFrame:
    """``k`` and the runs of contour lines inside blocks of cells, as ``chains.linked`` gives them."""
    edges = 2 * (grid.width + 1) * (grid.height + 1)

    def run(t: pa.Table) -> pa.Table:
        r0, c0 = (t.column(c)[0].as_py() * block for c in ("br", "bc"))
        row, col = t.column("row").to_numpy() - r0, t.column("col").to_numpy() - c0
        v = np.full((int(row.max()) + 1, int(col.max()) + 1), np.nan)
        v[row, col] = t.column("v").to_numpy()
        found = cell_lines(v, r0, c0, interval, base, grid.width) if min(v.shape) > 1 else {}
        if not found or not len(found["k"]):
            return pa.schema([("k", pa.int64()), ("node", pa.int64()), ("nxt", pa.int64()), ("closed", pa.bool_()), ("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64())), ("ex", pa.float64()), ("ey", pa.float64())]).empty_table()
        node, nxt = (found["k"] * edges + found[c] for c in ("s", "e"))
        begin, columns = paths(node, nxt, *(found[c] for c in ("x1", "y1", "x2", "y2")))
        return pa.table({"k": pa.array(found["k"][begin]), **columns})

    # a block has the first pixels of the next ones as well
    px = pixels.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("v"))

    def targets(c: str) -> Column:
        own = F.floor(F.col(c) / block).cast("int")
        return F.when((F.col(c) % block == 0) & (F.col(c) > 0), F.array(own, own - 1)).otherwise(F.array(own))

    dealt = px.withColumn("br", F.explode(targets("row"))).withColumn("bc", F.explode(targets("col")))
    return dealt.groupBy("br", "bc").applyInArrow(run, f"k long, {PATH}")


def contour(
    pixels: DataFrame, grid: Grid, interval: float = 10.0, base: float = 0.0, simplify_pixels: float = 0.0,
    value: str = "value", block: int = BLOCK, missing: str = "refuse",
) -> DataFrame:
    """Contour lines with their ``value``; a band with missing pixels is refused.

    With ``missing="edge"`` the band ends at missing pixels: lines run between the others and stop there.
    Lines are linked inside blocks of cells; the runs that go on in another block are ordered by pointer
    doubling, so a line of any length is dealt over all tasks until it is one row.
    """
    interval, base = measure("interval", interval, above_zero=True), float(base)
    known, low, high = pixels.agg(F.count_if(valid(value)), F.min(value), F.max(value)).first()
    if one_of("missing", missing, ("refuse", "edge")) == "refuse" and known != grid.width * grid.height:
        raise ValueError(f"{known} of {grid.width * grid.height} pixels have a value; contours need all of them")
    if low == high:
        raise ValueError(f"every pixel is {low:g}: a flat band has no contours")
    # a contour through a grid corner yields pieces without length: their ends coincide
    lines = completed(cut_lineage(contour_runs(pixels, grid, interval, base, value, block)), ["k"])
    path = F.zip_with(F.concat("xs", F.array("ex")), F.concat("ys", F.array("ey")), lambda u, v: G.xy(*grid.place(u + 0.5, v + 0.5)))
    out = lines.select((F.lit(base) + F.col("k") * F.lit(interval)).alias("value"), G.line(path).alias("geom"), F.lit(grid.srid).alias("srid"))
    tolerance = simplify_pixels * max(abs(grid.a), abs(grid.e))
    return simplify(out, tolerance, preserve_topology=False) if tolerance > 0 else out
