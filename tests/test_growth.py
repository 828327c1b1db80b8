"""Steps whose cost has to grow no faster than their input."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geom as G
from geoloom.operators import arrangement as A
from geoloom.operators import diagram as D
from geoloom.operators import history as H
from geoloom.operators import joins as J
from geoloom.operators import overlay as O
from geoloom.operators import photos as P
from geoloom.operators import tiling as T
from geoloom.operators.raster import Grid
from geoloom.plans import vector_queries


def test_join_of_repeated_shapes_equals_the_plain_one(spark):
    k = F.col("id")
    boxes = spark.range(120).select("id", G.box(k % 7, k % 5, k % 7 + 1.5, k % 5 + 1).alias("geom"), F.lit(3857).alias("srid"))
    plain, shared = (J.spatial_join(boxes, boxes, "intersects", srids=(3857, 3857), repeats=r) for r in (False, True))
    assert plain.columns == shared.columns
    rows = lambda df: sorted(tuple(r) for r in df.select("id_left", "id_right").collect())
    assert rows(plain) == rows(shared)
    with pytest.raises(ValueError):
        J.spatial_join(boxes, boxes, how="left", repeats=True)


def test_members_of_repeated_shapes_meet_on_all_cores(spark, monkeypatch):
    """A small file is read in one task; the many pairs that come of it are not made there."""
    monkeypatch.setattr(J, "MEMBERS", 3)
    k = F.col("id")
    x = F.when(k < 60, 0).otherwise(k % 7)  # one shape with most of the members
    boxes = spark.range(100).coalesce(1).select("id", G.box(x, k * 0, x + 1.5, k * 0 + 1).alias("geom"), F.lit(3857).alias("srid"))
    other = boxes.where("id % 2 = 0")
    plain, shared = (J.spatial_join(boxes, other, "intersects", srids=(3857, 3857), repeats=r) for r in (False, True))
    rows = lambda df: sorted(tuple(r) for r in df.select("id_left", "id_right").collect())
    assert rows(plain) == rows(shared)
    assert shared.where("id_left < 60 and id_right < 60").select(F.spark_partition_id()).distinct().count() > 4


def test_wide_cells_equal_brute_force(spark):
    """Cells in a box far larger than the extent, settled by its rim alone, have the neighbours that all points give."""
    pts = np.random.default_rng(3).random((60, 2)) * 50
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, x double, y double")
    extent, box = (*pts.min(0), *pts.max(0)), (-5e6, -5e6, 5e6, 5e6)
    extent = tuple(map(float, extent))
    rows = D.wide_cells(df, box, extent).select("id", "own").collect()
    assert sorted(r.id for r in rows) == list(range(60))
    for r in rows:
        rest = np.delete(np.arange(60), r.id)
        own = D.cut_cell(*pts[r.id], box, rest, pts[rest, 0], pts[rest, 1])[2]
        assert set(own) == set(r.own)


def optimized(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "10000")
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_query_terms_folds_each_spelling_once(spark):
    text = F.lit("Été été ete b B ÉTÉ c b")
    df = spark.range(1).select(H.query_terms(F.concat(text, F.col("id").cast("string"))).alias("t"))
    assert df.first().t == ["Été", "b", "c", "b0"]
    assert "array_distinct(regexp_extract_all" in optimized(df)


def test_photo_fields_are_worked_out_once(spark):
    row = [(f"a/{i}.jpg", {}, f'<x:xmpmeta drone-dji:GpsLatitude="{i}.5" drone-dji:GpsLongitude="7.25"/>') for i in range(3)]
    p = P.photo_records(spark.createDataFrame(row, "path string, exif map<string,string>, xmp string"))
    assert sorted((r.lat, r.lon) for r in p.collect()) == [(0.5, 7.25), (1.5, 7.25), (2.5, 7.25)]
    assert optimized(p).count("GPSLongitudeRef]") <= 2


def test_softmax_is_summed_once_a_row(spark):
    raw = spark.createDataFrame([(1, [1.0, 3.0, 0.0], 0.5, 0.5, 0.2, 0.2)], "q long, logits array<double>, cx double, cy double, bw double, bh double")
    d = T.decode_detections(raw, ["a", "b", "c"], 0.5)
    assert [(r.label, round(r.score, 6)) for r in d.collect()] == [("b", round(float(np.exp(3) / np.exp([1, 3, 0]).sum()), 6))]
    assert optimized(d).count("aggregate(") == 1


def test_json_is_parsed_once_a_row(spark):
    df = H.json_path(spark.range(2).select(F.to_json(F.struct(F.array("id", "id", "id").alias("a"))).alias("j")), "j", "a[0:2]")
    assert sorted(r.value for r in df.collect()) == ["[0,0]", "[1,1]"]
    assert optimized(df).lower().count("parsejson(") <= 1 and "Generate" in optimized(df)


def test_boxes_of_simplify_are_dealt_over_tasks(spark):
    assert "RepartitionByExpression [id" in optimized(vector_queries.simplify_collinear(spark, "/root/testdata/sf0.001"))


def test_mask_sides_go_on_in_small_batches(spark, monkeypatch):
    """A task holds few sides at a time, and handing them on early loses none."""
    monkeypatch.setattr(T, "HELD_SIDES", 5)
    masks = spark.range(30).select("id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i + F.col("id")) % 3 > 0).alias("tile_mask"), F.lit(4).alias("w"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    p = T.mask_polygons(masks, "id", Grid(4, 4, 3857))
    got = {r.id: r.a for r in p.groupBy("id").agg(F.sum(G.area(F.col("geom"))).alias("a")).collect()}
    assert got == {i: float(sum((k + i) % 3 > 0 for k in range(16))) for i in range(30)}


def test_union_cuts_no_segments_deep_inside(spark, monkeypatch):
    """Shapes that lie many deep are cut along the union's outline only, and its holes stay."""
    w, h = 120, 80
    rng = np.random.default_rng(11)
    at = np.column_stack([rng.integers(0, w - 24, 1500), rng.integers(0, h - 24, 1500), rng.integers(10, 25, 1500), rng.integers(10, 25, 1500)])
    hole = (at[:, 0] < 70) & (at[:, 0] + at[:, 2] > 50) & (at[:, 1] < 50) & (at[:, 1] + at[:, 3] > 30)
    at = at[~hole]
    grid = np.zeros((w, h), bool)
    for x, y, a, b in at:
        grid[x : x + a, y : y + b] = True
    df = spark.createDataFrame([tuple(map(float, r)) for r in at], "x double, y double, a double, b double")
    turned = [G.xy(c * 0.8 - s * 0.6, c * 0.6 + s * 0.8) for c, s in ((F.col("x") + F.col("a") * i, F.col("y") + F.col("b") * j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))]
    shapes = df.select(F.lit(0).alias("k"), G.polygon(F.array(*turned)).alias("geom"))
    cut, split = [], A._split
    monkeypatch.setattr(A, "_split", lambda segs, *more: cut.append(segs.count()) or split(segs, *more))
    segs = A.polygon_segments(shapes, ["k"])
    row = A.arrange(segs, ["k"], "union", 6).select(G.area(F.col("geom")).alias("a"), F.size(G.rings_of(F.col("geom"))).alias("n")).first()
    assert round(row.a, 3) == grid.sum()
    assert row.n >= 2
    assert cut[0] < segs.count() / 2


def test_convex_shapes_in_boxes_need_no_arrangement(spark, monkeypatch):
    """Triangles inside, across and outside a box: cut at once; only a bent one is arranged, and nothing is left of inner ones."""
    at = {1: [(1, 1), (3, 1), (1, 3)], 2: [(8, 2), (12, 2), (8, 6)], 3: [(-5, -5), (25, -5), (-5, 25)], 4: [(10, 0), (14, 0), (10, 4)], 5: [(2, 6), (2, 9), (5, 9)], 6: [(8, 8), (12, 8), (12, 12), (11, 9)]}
    rows = [(k, [(float(x), float(y)) for x, y in [*p, p[0]]]) for k, p in at.items()]
    df = spark.createDataFrame(rows, "k int, r array<struct<x:double,y:double>>").select("k", G.polygon(F.col("r")).alias("geom"), F.lit(3857).alias("srid"))
    box = spark.range(1).select("id", G.box(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)).alias("geom"), F.lit(3857).alias("srid"))
    areas = lambda o: {r.k: round(r.a, 6) for r in o.select("k", G.area(F.col("geom")).alias("a")).collect()}
    seen, arrange = [], A.arrange
    key = lambda segs, keys: {r[0] for r in segs.select(keys[0]).collect()}
    monkeypatch.setattr(A, "arrange", lambda segs, keys, *more: seen.append(key(segs, keys)) or arrange(segs, keys, *more))
    inside = areas(O.overlay(df, box, "intersection", "k", "id", srids=(3857, 3857)))
    outside = areas(O.overlay(df, box, "difference", "k", "id", srids=(3857, 3857)))
    assert seen == [{6}, {2, 3, 6}]
    whole = areas(df)
    assert inside == {1: 2.0, 2: 6.0, 3: 100.0, 5: 4.5, 6: inside[6]}
    assert outside == {2: 2.0, 3: 350.0, 4: 8.0, 6: outside[6]}
    assert abs(inside[6] + outside[6] - whole[6]) < 1e-5


def test_buffers_are_grown_by_all_tasks(spark):
    """Many short lines have the bytes of one task, but growing them is work for all; no line is lost."""
    k = F.col("id")
    lines = spark.range(2000).select("id", G.line(F.array(G.xy(k, 0), G.xy(k + 1 + k % 7, 0))).alias("geom"), F.lit(3857).alias("srid"))
    rows = O.buffer(lines, 0.25, "id", srid=3857).select("id", G.area(F.col("geom")).alias("a"), F.spark_partition_id().alias("task")).collect()
    ends = 32 * math.sin(2 * math.pi / 64) * 0.25**2
    assert {r.id: round(r.a, 3) for r in rows} == {i: round(0.5 * (1 + i % 7) + ends, 3) for i in range(2000)}
    share = Counter(r.task for r in rows)
    assert len(rows) == 2000 and len(share) > 1 and max(share.values()) < 500
