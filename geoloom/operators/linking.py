"""Geometries from pieces: rings and polygons from edges, lines from chains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geom as G
from ..session import cut_lineage
from .chains import BATCH_ROWS, completed, linked, per_path, side_by_side
from .joins import candidate_pairs


def successors(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``edges(keys, node, x1, y1, x2, y2)`` with ``nxt``, the edge that goes on where each one ends.

    Where a vertex has several ways on, the leftmost is taken, so that parts that only touch stay separate
    rings.  Around a vertex that is the way out next to the edge's own direction back, clockwise.
    """
    base = edges.select(*keys, "node", "x1", "y1", "x2", "y2")
    none = F.lit(None).cast("long")

    def side(x: str, y: str, to_x: str, to_y: str, out: Column, own: Column) -> DataFrame:
        angle = F.atan2(F.col(to_y) - F.col(y), F.col(to_x) - F.col(x))
        return base.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), angle.alias("_a"), out.alias("_out"), own.alias("node"), "x1", "y1", "x2", "y2")

    both = side("x1", "y1", "x2", "y2", F.col("node"), none).unionByName(side("x2", "y2", "x1", "y1", none, F.col("node")))
    around = W.partitionBy(*keys, "_x", "_y").orderBy("_a")
    before = F.last("_out", ignorenulls=True).over(around.rowsBetween(W.unboundedPreceding, W.currentRow))
    last = F.last("_out", ignorenulls=True).over(around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return both.withColumn("nxt", F.coalesce(before, last)).where("node is not null").select(*keys, "node", "nxt", "x1", "y1", "x2", "y2")


def _tidy(eps: float):
    """A function for ``per_path``: rings without vertices on straight lines, their areas, boxes, and a point inside."""

    def run(t: pa.Table):
        xs, ys = t.column("xs").combine_chunks(), t.column("ys").combine_chunks()
        n = xs.value_lengths().to_numpy()
        x, y = xs.flatten().to_numpy(), ys.flatten().to_numpy()

        def around(n):
            """The place after each vertex of closed rings."""
            end = np.cumsum(n)
            nxt = np.arange(1, int(n.sum()) + 1)
            nxt[end[n > 0] - 1] = (end - n)[n > 0]
            return nxt

        nxt = around(n)
        ring = np.repeat(np.arange(len(n)), n)
        before = np.empty(len(x), np.int64)
        before[nxt] = np.arange(len(x))
        ax, ay, bx, by = x - x[before], y - y[before], x[nxt] - x, y[nxt] - y
        keep = np.abs(ax * by - ay * bx) > eps * (np.abs(ax) + np.abs(ay)) * (np.abs(bx) + np.abs(by))
        n = np.bincount(ring[keep], minlength=len(n))
        good = n >= 3
        keep &= good[ring]
        x, y, ring = x[keep], y[keep], ring[keep]
        rows = np.flatnonzero(good)
        n = n[rows]
        if not len(rows):
            return pa.array([], pa.int64()), {k: pa.array([], pa.list_(pa.float64()) if k in ("xs", "ys") else pa.float64()) for k in ("area", "xs", "ys", "minx", "miny", "maxx", "maxy", "px", "py")}
        start = np.cumsum(n) - n
        nxt = around(n)
        of = np.repeat(np.arange(len(n)), n)
        ux, uy = x - x[start][of], y - y[start][of]
        area = np.add.reduceat(ux * uy[nxt] - ux[nxt] * uy, start) / 2
        inside = [_inner_point(x[a : a + k], y[a : a + k]) if s < 0 else (np.nan, np.nan) for a, k, s in zip(start.tolist(), n.tolist(), area.tolist())]
        offsets = pa.array(np.append(start, len(x)), pa.int32())
        return pa.array(rows), {
            "area": pa.array(area), "xs": pa.ListArray.from_arrays(offsets, pa.array(x)), "ys": pa.ListArray.from_arrays(offsets, pa.array(y)),
            "minx": pa.array(np.minimum.reduceat(x, start)), "miny": pa.array(np.minimum.reduceat(y, start)),
            "maxx": pa.array(np.maximum.reduceat(x, start)), "maxy": pa.array(np.maximum.reduceat(y, start)),
            "px": pa.array([p[0] for p in inside]), "py": pa.array([p[1] for p in inside]),
        }

    return run


def _inner_point(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A point inside a simple ring, on a level between two vertices."""
    levels = np.unique(y)
    k = int(np.diff(levels).argmax())
    at = (levels[k] + levels[k + 1]) / 2
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    hit = (y > at) != (y2 > at)
    where = np.sort(x[hit] + (at - y[hit]) / (y2[hit] - y[hit]) * (x2[hit] - x[hit]))
    gap = int(np.diff(where)[::2].argmax()) * 2
    return float(where[gap] + where[gap + 1]) / 2, float(at)


RING = "area double, xs array<double>, ys array<double>, minx double, miny double, maxx double, maxy double, px double, py double"


def rings(edges: DataFrame, keys: list[str], eps: float = 0.0, rows: int = BATCH_ROWS) -> DataFrame:
    """The closed rings of directed edges: ``keys, path`` and ``RING``; exteriors have positive areas, holes negative ones."""
    numbered = cut_lineage(edges.select(*keys, "x1", "y1", "x2", "y2").withColumn("node", F.monotonically_increasing_id()))
    pieces = cut_lineage(linked(side_by_side(successors(numbered, keys), keys), keys, rows))
    whole = completed(pieces, keys).where("closed")
    return cut_lineage(per_path(whole.select(*keys, "path", "xs", "ys"), keys, _tidy(eps), RING))


def nested(found: DataFrame, keys: list[str]) -> DataFrame:
    """``hole, shell``: the smallest exterior of its key around each hole of ``found``, which ``rings`` gave.

    A key with one exterior needs no test; elsewhere boxes are joined by bins, and only where several of them
    hold a hole are the edges of those counted above a point inside it.
    """
    outer, holes = found.where("area > 0"), found.where("area < 0")
    count = outer.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("path").alias("_only"))
    counted = holes.select(*keys, "path", "area", "px", "py").join(count, keys)
    alone = counted.where("_n = 1").select(F.col("path").alias("hole"), F.col("_only").alias("shell"))
    point = {"l_minx": "px", "l_miny": "py", "l_maxx": "px", "l_maxy": "py"}
    left = counted.where("_n > 1").select(*keys, F.col("path").alias("hole"), F.col("area").alias("hole_area"), *(F.col(c).alias(k) for k, c in point.items()))
    right = outer.select(*keys, F.col("path").alias("shell"), F.col("area").alias("shell_area"), *(F.col(c).alias(f"r_{c}") for c in G.BBOX))
    pairs = candidate_pairs(left, right, keys).where("shell_area > -hole_area").select("hole", "shell", "shell_area", F.col("l_minx").alias("px"), F.col("l_miny").alias("py"))
    pairs = cut_lineage(pairs)
    many = pairs.groupBy("hole").agg(F.count(F.lit(1)).alias("_n"), F.max("shell").alias("shell"))
    one = many.where("_n = 1").select("hole", "shell")
    unsure = pairs.join(many.where("_n > 1").select("hole"), "hole", "left_semi")
    edge = F.zip_with(
        F.arrays_zip("xs", "ys"), F.concat(F.slice(F.arrays_zip("xs", "ys"), F.lit(2), F.size("xs")), F.slice(F.arrays_zip("xs", "ys"), 1, 1)),
        lambda p, q: F.struct(p["xs"].alias("x1"), p["ys"].alias("y1"), q["xs"].alias("x2"), q["ys"].alias("y2")),
    )
    asked = outer.join(unsure.select(F.col("shell").alias("path")).distinct(), "path", "left_semi").select(F.col("path").alias("shell"), F.explode(edge).alias("e")).select("shell", "e.*")
    over = (F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))
    cross = over & (F.col("px") < F.col("x1") + F.try_divide(F.col("py") - F.col("y1"), F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    odd = unsure.join(asked, "shell").where(cross).groupBy("hole", "shell", "shell_area").agg((F.count(F.lit(1)) % 2).alias("_odd")).where("_odd = 1")
    return alone.unionByName(one).unionByName(odd.groupBy("hole").agg(F.min_by("shell", F.struct("shell_area", "shell")).alias("shell")))


def link_rings(edges: DataFrame, keys: list[str], eps: float = 0.0, rows: int = BATCH_ROWS) -> DataFrame:
    """One polygonal geometry per key from directed boundary edges ``x1,y1,x2,y2`` with the interior on their left.

    Edges, runs of them and rings are dealt over all tasks whatever key they have; only the finished geometry
    of a key is one row.  ``rows`` edges are linked together inside a task.
    """
    found = rings(edges, keys, eps, rows)
    ring = F.zip_with(F.concat("xs", F.slice("xs", 1, 1)), F.concat("ys", F.slice("ys", 1, 1)), lambda x, y: G.xy(x, y)).alias("_ring")
    shells = found.where("area > 0").select(*keys, "path", ring)
    holes = found.where("area < 0").select(F.col("path").alias("hole"), ring).join(nested(found, keys), "hole")
    inner = holes.groupBy(F.col("shell").alias("path")).agg(F.sort_array(F.collect_list(F.struct("hole", "_ring"))).alias("_in"))
    part = F.concat(F.array("_ring"), F.coalesce(F.transform("_in", lambda h: h["_ring"]), F.array().cast(G.RINGS)))
    parts = shells.join(inner, "path", "left").select(*keys, "path", part.alias("rings"))
    whole = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("path", "rings"))).alias("_p"))
    kind = F.when(F.size("_p") == 1, "Polygon").otherwise("MultiPolygon")
    return whole.select(*keys, G.make(kind, F.transform("_p", lambda p: F.struct(p["rings"].alias("rings")))).alias("geom"))


def join_chains(start: list, end: list, points: list[list]) -> list[tuple[object, object, list]]:
    """Chains joined at equal end keys; each key ends at most two chains.  ``(start, end, points)``."""
    at: dict[object, list[int]] = {}
    for i, (s, e) in enumerate(zip(start, end)):
        at.setdefault(s, []).append(i)
        at.setdefault(e, []).append(i)
    used = [False] * len(start)
    done = []

    def grow(i: int, from_start: bool):
        """Walk away from one end of chain ``i`` as far as chains join on."""
        used[i] = True
        key, path = (end[i], list(points[i])) if from_start else (start[i], list(points[i])[::-1])
        origin = start[i] if from_start else end[i]
        while key != origin:
            nxt = next((j for j in at[key] if not used[j]), None)
            if nxt is None:
                break
            used[nxt] = True
            forward = start[nxt] == key
            more = points[nxt] if forward else points[nxt][::-1]
            key = end[nxt] if forward else start[nxt]
            path += list(more)[1:]
        return origin, key, path

    order = sorted(range(len(start)), key=lambda i: min(len(at[start[i]]), len(at[end[i]])))
    for i in order:
        if not used[i]:
            done.append(grow(i, len(at[start[i]]) == 1 or len(at[end[i]]) != 1))
    return done
