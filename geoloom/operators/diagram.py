"""Voronoi cells and Delaunay triangles of large point sets.

No task ever holds the whole set.  Every point starts from a few neighbours that follow
and precede it on a space-filling curve; its cell is the extent cut by the bisectors
to them.  A cell is right when no other point lies inside the circle around any of its
corners through its own point.  Rounds of a binned join look for such points, add the
nearest one per corner and cut again, until none is left.

Cells that leave the points' extent (Delaunay needs them whole) are settled in two steps: all
cells inside the extent, then those that touch its border, among themselves.  A cell is convex and
holds its point, so one that lies partly outside the border crosses it, and outside no other point counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import crs as C
from ..functions import geom as G
from ..session import cut_lineage, one_of
from .joins import candidate_pairs

NEAR = 6
CELL = "id long, x double, y double, nid array<long>, nx array<double>, ny array<double>, vx array<double>, vy array<double>, own array<long>"


def cut_cell(x, y, box, nid, nx, ny):
    """The box cut by the bisectors to the neighbours: corners and the neighbour behind each edge (-1 box)."""
    vx, vy = [box[0], box[2], box[2], box[0]], [box[1], box[1], box[3], box[3]]
    own = [-1, -1, -1, -1]
    for k in np.argsort((nx - x) ** 2 + (ny - y) ** 2):
        dx, dy = nx[k] - x, ny[k] - y
        mx, my = x + dx / 2, y + dy / 2
        side = [(a - mx) * dx + (b - my) * dy for a, b in zip(vx, vy)]
        if max(side) <= 0:
            continue
        ox, oy, oo = [], [], []
        n = len(vx)
        for i in range(n):
            j = (i + 1) % n
            if side[i] <= 0:
                ox.append(vx[i]), oy.append(vy[i])
                oo.append(own[i])
            if (side[i] <= 0) != (side[j] <= 0):
                t = side[i] / (side[i] - side[j])
                ox.append(vx[i] + t * (vx[j] - vx[i])), oy.append(vy[i] + t * (vy[j] - vy[i]))
                # leaving the kept side starts the new edge; coming back goes on along the old one
                oo.append(int(nid[k]) if side[i] <= 0 else own[i])
        vx, vy, own = ox, oy, oo
    return vx, vy, own


def _cut_all(rows: DataFrame, box) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [
                cut_cell(x, y, box, np.asarray(i), np.asarray(p, float), np.asarray(q, float))
                for x, y, i, p, q in zip(b["x"], b["y"], b["nid"], b["nx"], b["ny"])
            ]
            yield b[["id", "x", "y", "nid", "nx", "ny"]].assign(
                vx=[o[0] for o in out], vy=[o[1] for o in out], own=[o[2] for o in out]
            )

    return rows.select("id", "x", "y", "nid", "nx", "ny").mapInPandas(run, CELL)


def _first_neighbours(points: DataFrame, extent) -> DataFrame:
    """Each point with those around it on the Z-order curve, partition by partition."""
    minx, miny, maxx, maxy = extent
    gx = F.floor((F.col("x") - minx) / (maxx - minx) * 65535).cast("long")
    gy = F.floor((F.col("y") - miny) / (maxy - miny) * 65535).cast("long")
    z = F.lit(0).cast("long")
    for bit in range(16):
        z = z + F.shiftleft(F.shiftright(gx, bit).bitwiseAND(1), 2 * bit) + F.shiftleft(F.shiftright(gy, bit).bitwiseAND(1), 2 * bit + 1)
    ordered = points.withColumn("z", z).repartitionByRange("z", "id").sortWithinPartitions("z", "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for b in batches:
            # the last rows of the batch before are repeated as neighbours only
            joined = b if tail is None else pd.concat([tail, b], ignore_index=True)
            skip = 0 if tail is None else len(tail)
            i, x, y = (joined[c].to_numpy() for c in ("id", "x", "y"))
            sets = [np.r_[max(0, k - NEAR) : k, k + 1 : min(len(i), k + 1 + NEAR)] for k in range(skip, len(i))]
            yield pd.DataFrame(
                {"id": i[skip:], "x": x[skip:], "y": y[skip:], "nid": [i[s] for s in sets], "nx": [x[s] for s in sets], "ny": [y[s] for s in sets]}
            )
            tail = joined.tail(NEAR)[["id", "x", "y"]]

    return ordered.select("id", "x", "y").mapInPandas(run, "id long, x double, y double, nid array<long>, nx array<double>, ny array<double>")


def cells(points: DataFrame, box, extent, max_rounds: int = 200) -> DataFrame:
    """Final cells of ``points(id, x, y)`` inside ``box``."""
    points = cut_lineage(points)
    return _settled(_cut_all(_first_neighbours(points, extent), box), points, box, 8.0, max_rounds)


def wide_cells(points: DataFrame, box, extent, max_rounds: int = 200) -> DataFrame:
    """Final cells of ``points(id, x, y)`` inside a ``box`` far larger than the extent."""
    rim = max(extent[2] - extent[0], extent[3] - extent[1]) * 1e-3
    inner = (extent[0] - rim, extent[1] - rim, extent[2] + rim, extent[3] + rim)
    near = cut_lineage(cells(points, inner, extent, max_rounds))
    outer = near.where(F.array_contains("own", F.lit(-1)))
    far = _settled(_cut_all(outer, box), outer.select("id", "x", "y"), box, float("inf"), max_rounds)
    return near.where(~F.array_contains("own", F.lit(-1))).unionByName(far)


def _settled(open_: DataFrame, points: DataFrame, box, reach: float, max_rounds: int) -> DataFrame:
    """Cut cells again until none of the points lies in the circle of a corner."""
    open_ = cut_lineage(open_)
    done = None
    right = points.select(
        F.col("id").alias("r_id"), F.col("x").alias("r_minx"), F.col("y").alias("r_miny"), F.col("x").alias("r_maxx"), F.col("y").alias("r_maxy")
    )
    for step in range(max_rounds):
        near = F.array_min(F.zip_with("nx", "ny", lambda a, b: F.hypot(a - F.col("x"), b - F.col("y"))))
        # the search radius grows from round to round, so that early, loose cells stay cheap
        corners = open_.select("id", "x", "y", (near * (reach ** (step + 1))).alias("cap"), F.posexplode(F.arrays_zip("vx", "vy")).alias("k", "v"))
        r = F.hypot(F.col("v.vx") - F.col("x"), F.col("v.vy") - F.col("y"))
        corners = corners.select("id", "k", F.col("v.vx").alias("cx"), F.col("v.vy").alias("cy"), r.alias("r"), "cap")
        within = F.least("r", "cap")
        left = corners.select(
            F.col("id").alias("l_id"), F.col("k").alias("l_k"), F.col("cx").alias("l_cx"), F.col("cy").alias("l_cy"), F.col("r").alias("l_r"),
            (F.col("cx") - within).alias("l_minx"), (F.col("cy") - within).alias("l_miny"), (F.col("cx") + within).alias("l_maxx"), (F.col("cy") + within).alias("l_maxy"),
        )
        hits = candidate_pairs(left, right).where("l_id <> r_id").withColumn("d", F.hypot(F.col("r_minx") - F.col("l_cx"), F.col("r_miny") - F.col("l_cy")))
        hits = hits.where(F.col("d") < F.col("l_r") * (1 - 1e-9))
        best = hits.groupBy("l_id", "l_k").agg(F.min_by(F.struct("r_id", F.col("r_minx").alias("px"), F.col("r_miny").alias("py")), "d").alias("p"))
        fresh = best.groupBy(F.col("l_id").alias("id")).agg(F.collect_set("p").alias("add"))
        wide = corners.groupBy("id").agg(F.bool_and(F.col("r") <= F.col("cap")).alias("whole"))
        state = open_.join(wide, "id").join(fresh, "id", "left")
        # a corner computed a hair off may point at a neighbour that is known already
        state = state.withColumn("add", F.filter("add", lambda p: ~F.array_contains(F.col("nid"), p["r_id"])))
        state = cut_lineage(state.withColumn("add", F.when(F.size("add") > 0, F.col("add"))))
        settled = state.where("whole and add is null").select("id", "x", "y", "nid", "nx", "ny", "vx", "vy", "own")
        done = settled if done is None else done.unionByName(settled)
        again = state.where("not whole or add is not null").select(
            "id", "x", "y", *[F.when(F.col("add").isNull(), F.col(c)).otherwise(F.concat(c, F.col("add")[f])).alias(c)
                              for c, f in (("nid", "r_id"), ("nx", "px"), ("ny", "py"))],
        )
        open_ = cut_lineage(_cut_all(again, box))
        if open_.isEmpty():
            return done
    raise RuntimeError("the diagram did not settle")


def voronoi(df: DataFrame, kind: str = "voronoi", geom: str = "geom", srid: int | None = None) -> DataFrame:
    """Voronoi cells clipped to the points' extent, or Delaunay triangles; planar in a metric CRS.

    Needs three points that do not share an x or a y.
    """
    one_of("kind", kind, ("voronoi", "delaunay"))
    src, metric = C.metric_srid(df, geom, srid)
    g = C.transform_geom(F.col(geom), src, metric)
    dots = df.where(F.col(geom)["type"].isin("Point", "MultiPoint")).select(F.explode(G.vertices(g)).alias("p")).select("p.x", "p.y").distinct()
    points = cut_lineage(dots.withColumn("id", F.xxhash64("x", "y")))
    n, minx, miny, maxx, maxy = points.agg(F.count(F.lit(1)), F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if n < 3:
        raise ValueError("a diagram needs at least 3 points")
    if minx == maxx or miny == maxy:
        raise ValueError("the points are collinear or coincident; spread them out first")
    extent = (minx, miny, maxx, maxy)
    if kind == "voronoi":
        rows = cells(points, extent, extent)
        path = F.zip_with("vx", "vy", lambda a, b: G.xy(a, b))
        shape = G.polygon(F.concat(path, F.slice(path, 1, 1)))
        return rows.select(
            C.transform_geom(F.struct(F.lit("Point").alias("type"), G.point("x", "y")["parts"].alias("parts")), metric, src).alias("site"),
            C.transform_geom(shape, metric, src).alias("geom"), F.lit(src).alias("srid"),
        )
    # a tiny shift per point, fixed by its id, leaves no four points on one circle
    side = max(maxx - minx, maxy - miny)
    noise = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000003)) / 1000003.0 - 0.5) * side * 1e-7
    shifted = points.select("id", (F.col("x") + noise(1)).alias("x"), (F.col("y") + noise(2)).alias("y"))
    big = side * 1e5
    rows = wide_cells(shifted, (minx - big, miny - big, maxx + big, maxy + big), extent)
    behind = rows.select("id", "own", F.concat(F.slice("own", F.size("own"), 1), F.slice("own", 1, F.size("own") - 1)).alias("prev"))
    pairs = behind.select("id", F.explode(F.arrays_zip("own", "prev")).alias("e")).where("e.own <> -1 and e.prev <> -1 and e.own <> e.prev")
    corner = F.array_sort(F.array("id", "e.own", "e.prev"))
    seen = pairs.select(corner.alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    named = seen.select(*[F.col("t")[i].alias(f"t{i}") for i in range(3)])
    for i in range(3):
        named = named.join(points.select(F.col("id").alias(f"t{i}"), F.struct("x", "y").alias(f"p{i}")), f"t{i}")
    ring = F.array("p0", "p1", "p2", "p0")
    flat = F.abs(G.signed_area(F.col("ring"))) > side * side * 1e-15
    out = named.select(ring.alias("ring")).where(flat)
    return out.select(C.transform_geom(G.polygon(F.col("ring")), metric, src).alias("geom"), F.lit(src).alias("srid"))
