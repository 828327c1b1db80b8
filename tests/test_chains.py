"""Paths and rings of any length: against loops in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geom as G
from geoloom.operators import chains, linking, polygonize, raster, validity
from geoloom.operators.raster import Grid


def test_runs_in_one_task():
    #                 0  1  2   3  4  5  6   7
    nxt = np.array([2, 0, 5, -1, 6, -1, 4, -1])
    first, place, closed = chains.runs(nxt)
    assert first.tolist() == [1, 1, 1, 3, 4, 1, 4, 7]
    assert place.tolist() == [1, 0, 2, 0, 0, 3, 1, 0]
    assert closed.tolist() == [False, False, False, False, True, False, True, False]
    first, place, closed = chains.runs(np.roll(np.arange(1000), -1))
    assert closed.all() and (first == 0).all() and place.tolist() == list(range(1000))
    assert [len(x) for x in chains.runs(np.zeros(0, np.int64))] == [0, 0, 0]


def test_order_by_pointer_doubling(spark):
    r = random.Random(2)
    names = r.sample(range(10**9), 900)
    parts = {"closed": names[:500], "open": names[500:830], "pair": names[830:832], "own": names[832:833], "one": names[833:834], "dangling": names[834:]}
    rows = []
    for kind, own in parts.items():
        after = own[1:] + {"open": [None], "one": [None], "dangling": [-5]}.get(kind, own[:1])
        rows += list(zip(own, after))
    r.shuffle(rows)
    got: dict = {}
    for x in chains.ordered(spark.createDataFrame(rows, "node long, nxt long")).collect():
        got.setdefault((x.path, x.closed), []).append((x.place, x.node))
    found = {tuple(n for _, n in sorted(v)): closed for (_, closed), v in got.items()}
    want = {}
    for kind, own in parts.items():
        if kind in ("closed", "pair", "own"):
            at = own.index(min(own))
            want[tuple(own[at:] + own[:at])] = True
        else:
            want[tuple(own)] = False
    assert found == want


def edges(spark, rings, key="k"):
    rows = [(k, *a, *b) for k, ring in rings for a, b in zip(ring, ring[1:] + ring[:1])]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(k, *map(float, r)) for k, *r in rows], f"{key} int, x1 double, y1 double, x2 double, y2 double")


def square(x, y, side, hole=False):
    ring = [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
    return ring[::-1] if hole else ring


def shapes(df):
    """Per key the parts, as (vertices of the shell, sorted vertex lists of the holes)."""
    out = {}
    for r in df.collect():
        out[r.k] = sorted((sorted((v.x, v.y) for v in p.rings[0][:-1]), sorted(sorted((v.x, v.y) for v in h[:-1]) for h in p.rings[1:])) for p in r.geom.parts)
        for p in r.geom.parts:
            assert all(ring[0] == ring[-1] for ring in p.rings)
    return out


@pytest.mark.parametrize("rows", [1 << 15, 3])
def test_rings_and_nesting(spark, rows):
    """Islands in holes, parts and holes that touch at a corner, and runs cut into batches of a few edges."""
    records = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", min(rows, 10_000))
    rings = [
        (1, square(0, 0, 100)), (1, square(10, 10, 60, True)), (1, square(20, 20, 30)), (1, square(30, 30, 5, True)), (1, square(80, 80, 10, True)), (1, square(200, 0, 10)),
        (2, square(0, 0, 10)), (2, square(10, 10, 10)),  # they touch at one corner
        (3, [(0, 0), (10, 0), (10, 10), (5, 10), (0, 10)]), (3, [(5, 10), (6, 8), (4, 8)]),  # a hole that touches its shell
        (4, [(0, 0), (4, 0), (8, 0), (8, 8), (0, 8)]),  # a vertex on a straight side goes
    ]
    flat = lambda ring: sorted((float(x), float(y)) for x, y in ring)
    got = shapes(linking.link_rings(edges(spark, rings), ["k"], rows=rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    assert got[1] == sorted([(flat(square(0, 0, 100)), sorted([flat(square(10, 10, 60)), flat(square(80, 80, 10))])), (flat(square(20, 20, 30)), [flat(square(30, 30, 5))]), (flat(square(200, 0, 10)), [])])
    assert got[2] == sorted([(flat(square(0, 0, 10)), []), (flat(square(10, 10, 10)), [])])
    assert got[4] == [(flat(square(0, 0, 8)), [])]
    # the corner that shell and hole of key 3 share is a vertex of both
    assert len(got[3]) == 1 and (5.0, 10.0) in [p for ring in (got[3][0][0], *got[3][0][1]) for p in ring]


def test_a_ring_of_200000_edges(spark):
    n = 200_000
    angle = F.col("id") * (2 * math.pi / n)
    x, y = (lambda a: F.round(F.cos(a) * 1e6, 4)), (lambda a: F.round(F.sin(a) * 1e6, 4))
    after = F.pmod(F.col("id") + 1, F.lit(n)) * (2 * math.pi / n)
    ring = spark.range(n).select(F.lit(1).alias("k"), x(angle).alias("x1"), y(angle).alias("y1"), x(after).alias("x2"), y(after).alias("y2"))
    out = linking.link_rings(ring, ["k"]).select(F.size(F.col("geom")["parts"]).alias("parts"), F.size(F.flatten(F.flatten(F.col("geom")["parts"]["rings"]))).alias("n"), G.area(F.col("geom")).alias("area")).first()
    assert out.parts == 1 and n * 0.99 < out.n <= n + 1
    assert abs(out.area - math.pi * 1e12) < 1e6


def test_contour_vertices_as_cell_by_cell(spark):
    r = np.random.default_rng(3)
    v = np.round(r.normal(size=(23, 31)), 2)  # rounded: levels pass through corners
    rows = [(i, j, float(v[i, j])) for i in range(23) for j in range(31)]
    grid = Grid(31, 23, 3857, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    lines = polygonize.contour(spark.createDataFrame(rows, "row int, col int, value double"), grid, 0.25, 0.1, block=7).collect()
    got, ends = [], {}
    for line in lines:
        path = [(p.x, p.y) for p in line.geom.parts[0].rings[0]]
        got += [(round(line.value, 6), a, b) for a, b in zip(path, path[1:])]
        ends.setdefault(round(line.value, 6), []).append((path[0], path[-1]))
    want = []
    for i in range(22):
        for j in range(30):
            corner = {"tl": v[i, j], "tr": v[i, j + 1], "bl": v[i + 1, j], "br": v[i + 1, j + 1]}
            for k in range(-20, 20):
                level = 0.1 + k * 0.25
                if not min(corner.values()) <= level < max(corner.values()):
                    continue
                at = {}
                for side, a, b, x, y in (("t", "tl", "tr", lambda f: j + f, lambda f: i), ("b", "bl", "br", lambda f: j + f, lambda f: i + 1), ("l", "tl", "bl", lambda f: j, lambda f: i + f), ("r", "tr", "br", lambda f: j + 1, lambda f: i + f)):
                    if (corner[a] > level) != (corner[b] > level):
                        f = (level - corner[a]) / (corner[b] - corner[a])
                        at[side] = (x(f) + 0.5, y(f) + 0.5)
                pairs = [tuple(at)] if len(at) == 2 else [("t", "l"), ("b", "r")] if corner["tl"] > level else [("t", "r"), ("b", "l")]
                want += [(round(level, 6), at[a], at[b]) for a, b in pairs]

    def near(segs):
        return sorted((lv, *sorted((tuple(round(c, 6) + 0.0 for c in a), tuple(round(c, 6) + 0.0 for c in b)))) for lv, a, b in segs)

    assert near(got) == near(want)
    # a line ends at the raster's border or where it began
    on_border = lambda p: min(abs(p[0] - 0.5), abs(p[1] - 0.5), abs(p[0] - 30.5), abs(p[1] - 22.5)) < 1e-9
    assert all(a == b or (on_border(a) and on_border(b)) for own in ends.values() for a, b in own)


def polygon(*parts):
    """A geometry of parts, each a list of open rings."""
    rings = [([[(float(x), float(y)) for x, y in [*ring, ring[0]]] for ring in p],) for p in parts]
    return ("Polygon" if len(parts) == 1 else "MultiPolygon", rings)


def test_reasons(spark):
    bow, spike = [(0, 0), (4, 4), (4, 0), (0, 4)], [(0, 0), (4, 0), (8, 0), (4, 0), (4, 4)]
    cases = {
        1: (polygon([bow]), validity.CLASH), 2: (polygon([square(0, 0, 8), square(20, 0, 2)]), validity.OUTSIDE), 3: (polygon([square(0, 0, 8), square(1, 1, 5), square(2, 2, 1)]), validity.HOLES),
        4: (polygon([square(0, 0, 8)], [square(1, 1, 2)]), validity.SHELLS), 5: (polygon([square(0, 0, 8)], [square(8, 2, 3)]), validity.CLASH), 6: (polygon([spike]), validity.CLASH),
        7: (polygon([square(0, 0, 8), square(1, 1, 5)], [square(2, 2, 1)]), None), 8: (polygon([square(0, 0, 8)], [square(8, 8, 2)]), None), 9: (polygon([square(0, 0, 8), square(1, 1, 2), square(4, 4, 2)]), None),
        10: (polygon([square(0, 0, 8), [(0, 0), (2, 1), (1, 2)]]), None),  # a hole that touches a corner of its shell
        11: (("Polygon", [([[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]],)]), "Too few points in geometry component"), 12: (("Polygon", [([[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]],)]), "Ring is not closed"),
        13: (None, None), 14: (("Polygon", []), None), 15: (("Point", [([[(1.0, 2.0)]],)]), None),
        16: (polygon([[(math.cos(a * 0.01), math.sin(a * 0.01)) for a in range(628)]]), None),
    }
    df = spark.createDataFrame([(k, g) for k, (g, _) in cases.items()], f"id int, geom {G.GEOM_DDL}")
    got = {r.id: r.reason for r in validity.reasons(df, "id").collect()}
    assert got == {k: w for k, (_, w) in cases.items() if w}
    assert validity.reasons(df.limit(0), "id").count() == 0


def test_many_rasters_as_one_by_one(spark):
    r = np.random.default_rng(5)
    grids = {"a": Grid(24, 18, 4326, 0.01, 0.0, 10.0, 0.0, -0.01, 50.0), "b": Grid(16, 20, 3857, 700.0, 0.0, 1.1e6, 0.0, -700.0, 6.4e6)}
    targets = {"a": Grid(9, 11, 3857, 4000.0, 0.0, 1.112e6, 0.0, -4000.0, 6.447e6), "b": Grid(7, 8, 4326, 0.013, 0.0, 9.885, 0.0, -0.013, 49.75)}
    rows = [(k, b, i, j, float(r.integers(0, 3)) if r.random() < 0.9 else None) for k, g in grids.items() for b in (1, 2) for i in range(g.height) for j in range(g.width)]
    px = spark.createDataFrame(rows, "raster_id string, band int, row int, col int, value double")

    def meta(table):
        return spark.createDataFrame([(k, *(getattr(g, c) for c in raster.GRID)) for k, g in table.items()], "raster_id string, width int, height int, srid int, a double, b double, c double, d double, e double, f double")

    for how in ("nearest", "average", "cubic"):
        every = raster.reproject_all(px, meta(grids), meta(targets), how, ["raster_id", "band"]).collect()
        for k, g in grids.items():
            for b in (1, 2):
                own = raster.reproject(px.where(f"raster_id = '{k}' and band = {b}"), g, targets[k], how).collect()
                got = sorted((x.row, x.col, None if x.value is None else round(x.value, 9)) for x in every if x.raster_id == k and x.band == b)
                assert got == sorted((x.row, x.col, None if x.value is None else round(x.value, 9)) for x in own)
                assert any(v is not None for *_, v in got)
    every = polygonize.polygonize_all(px, meta(grids), ["raster_id", "band"], block=8).select("raster_id", "band", "region", "value", G.area(F.col("geom")).alias("area"), "srid").collect()
    one = polygonize.polygonize(px.where("raster_id = 'b' and band = 2"), grids["b"], block=8).select("region", "value", G.area(F.col("geom")).alias("area"), "srid").collect()
    assert sorted((x.region, x.value, round(x.area, 3), x.srid) for x in every if x.raster_id == "b" and x.band == 2) == sorted((x.region, x.value, round(x.area, 3), x.srid) for x in one)
