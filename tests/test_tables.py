"""Rasters, detections, history and streams on small inputs and against brute force."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import catalog as K
from geoloom.operators import history as H
from geoloom.operators import nms as N
from geoloom.operators import percentiles as Q
from geoloom.operators import polygonize as Z
from geoloom.operators import raster as R
from geoloom.operators import terrain as T
from geoloom.operators import tiling as TL
from geoloom.plans import catalogue
from geoloom.plans import layers as L
from geoloom.sources import layers as S
from geoloom.sources import traces as TR
from geoloom.streaming import traces as ST

SF = "/root/testdata/sf0.001"


def raster(spark, array):
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(np.asarray(array, float))]
    return spark.createDataFrame(rows, "row int, col int, value double")


def test_terrain_closed_forms(spark):
    g = R.Grid(8, 8, 3857, 10.0, 0.0, 0.0, 0.0, -10.0, 0.0)
    plane = R.pixel_tiles(raster(spark, np.tile(np.arange(8.0), (8, 1))), 4)
    at = lambda t: R.tile_pixels(t).where("row = 4 and col = 4").first().value
    assert at(T.slope(plane, g)) == pytest.approx(5.7106, abs=1e-4)
    assert at(T.slope(plane, g, "percent")) == pytest.approx(10.0)
    assert at(T.aspect(plane, g)) == pytest.approx(270.0)
    flat = R.pixel_tiles(raster(spark, np.full((8, 8), 100.0)), 4)
    assert {r.value for r in R.tile_pixels(T.hillshade(flat, g)).collect()} == {180}
    assert {r.value for r in R.tile_pixels(T.aspect(flat, g)).collect()} == {0.0}


def test_ragged_tiles_match_one_tile(spark):
    values = np.random.default_rng(3).random((7, 10))
    g = R.Grid(10, 7, 3857, 10.0, 0.0, 0.0, 0.0, -10.0, 0.0)
    px = raster(spark, values)
    got = [
        {(r.row, r.col): round(r.value, 9) for r in R.tile_pixels(T.slope(R.pixel_tiles(px, n), g)).where("row < 7 and col < 10").collect()}
        for n in (4, 16)
    ]
    assert got[0] == got[1] and len(got[0]) == 70


def test_missing_pixels_make_gradients_null(spark):
    a = np.ones((4, 4))
    a[1, 1] = np.nan
    g = R.Grid(4, 4, 3857, 10.0, 0.0, 0.0, 0.0, -10.0, 0.0)
    rows = R.tile_pixels(T.slope(R.pixel_tiles(raster(spark, a), 4), g)).collect()
    assert sum(r.value is None for r in rows) == 9


def test_flat_histogram_and_rescale(spark):
    px = raster(spark, np.full((2, 3), 5.0))
    h = R.histogram(px).where("n > 0").collect()
    assert [(r.bin, r.n) for r in h] == [(128, 6)]
    assert {r.value for r in R.rescale(px).collect()} == {0}


def test_narrowed_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=500), np.full(400, 0.25), rng.random(100) * 1e6])
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)], "k int, v double")
    ps = [0.0, 0.02, 0.5, 0.98, 1.0]
    whole = Q.group_percentiles(df, [], "v", ps).first()
    assert list(whole) == pytest.approx(list(np.quantile(values, ps)))
    for row in Q.group_percentiles(df, ["k"], "v", ps).collect():
        assert list(row)[1:] == pytest.approx(list(np.quantile(values[row.k :: 2], ps)))


def greedy(boxes, t):
    kept = []
    for b in sorted(boxes, key=lambda r: (-r.score, r.id)):
        def over(k):
            w, h = min(k.x1, b.x1) - max(k.x0, b.x0), min(k.y1, b.y1) - max(k.y0, b.y0)
            i = max(w, 0) * max(h, 0)
            return i / ((k.x1 - k.x0) * (k.y1 - k.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - i) > t
        if not any(over(k) for k in kept):
            kept.append(b)
    return {b.id for b in kept}


def test_class_blind_suppression_equals_brute_force(spark):
    d = L.detections(spark, SF)
    # a third of all boxes are copies on one spot
    hot = d.where("id % 3 = 0").withColumns({"id": F.col("id") + 10000, "x0": F.lit(5.0), "y0": F.lit(5.0), "x1": F.lit(12.0), "y1": F.lit(12.0)})
    both = d.unionByName(hot)
    assert {r.id for r in N.greedy_nms(both, 0.7).select("id").collect()} == greedy(both.collect(), 0.7)


def test_contours_close_and_join_across_blocks(spark):
    y, x = np.mgrid[0:20, 0:20]
    hill = 100 - ((x - 9.3) ** 2 + (y - 9.7) ** 2)
    g = R.Grid(20, 20, 3857, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    lines = Z.contour(raster(spark, hill), g, 40.0, 0.0, block=4).where("value = 40").collect()
    assert len(lines) == 1
    path = lines[0].geom.parts[0].rings[0]
    assert path[0] == path[-1] and len(path) > 20
    with pytest.raises(ValueError):
        Z.contour(raster(spark, np.full((20, 20), 3.0)), g)


def test_polygon_with_hole(spark):
    a = np.zeros((6, 6))
    a[2:4, 2:4] = 1
    g = R.Grid(6, 6, 3857, 1.0, 0.0, 0.0, 0.0, -1.0, 6.0)
    rows = {r.value: r.geom for r in Z.polygonize(raster(spark, a), g, block=4).collect()}
    assert len(rows[0.0].parts[0].rings) == 2 and len(rows[1.0].parts[0].rings) == 1


def test_usage_fallback_and_terms(spark):
    df = spark.createDataFrame([('{"input_tokens": 3, "cache_read_tokens": 0, "details": {"prompt_cache_hit_tokens": 7}}',)], "usage string")
    row = H.flatten_usage(df).first()
    assert (row.input_tokens, row.cache_read_tokens, row.output_tokens) == (3, 7, 0)
    assert H.term_list("The the Élan a_b") == ["the", "elan", "a", "b"]


def test_trace_files_skip_bad_lines(spark, tmp_path):
    lines = ['{"type":"run","run_id":"r1","model":"m"}', "", "{broken", '{"type":"step","step":{"type":"text","content":"hi"}}', '{"type":"result","status":"done"}']
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    records = TR.read_trace(spark, str(tmp_path))
    assert sorted(r.type for r in records.collect()) == ["result", "run", "step"]
    assert [(r.type, r.content) for r in TR.steps_of(records).collect()] == [("text", "hi")]


def test_layer_files_round_trip(spark, tmp_path):
    boxes = L.boxes(spark, SF)
    S.write_layer(boxes, f"{tmp_path}/b.geojsonl")
    back = S.read_geojson(spark, f"{tmp_path}/b.geojsonl", "s_suppkey long, s_name string", lines=True)
    assert back.count() == boxes.count() and back.join(boxes, ["s_suppkey", "geom"]).count() == boxes.count()
    S.write_layer(boxes.select("geom", "srid"), f"{tmp_path}/c.parquet", layer="one")
    S.write_layer(boxes.select("geom", "srid"), f"{tmp_path}/c.parquet", layer="two")
    with pytest.raises(ValueError):
        S.read_layer(spark, f"{tmp_path}/c.parquet")
    assert S.read_layer(spark, f"{tmp_path}/c.parquet", "two").count() == boxes.count()
    with pytest.raises(ValueError):
        S.write_layer(boxes, f"{tmp_path}/x.shp")


def test_catalog_pages_and_file_list(spark, tmp_path):
    item = {"id": "i", "collection": "c", "bbox": [0, 0, 1, 1], "assets": {"visual": {"href": "https://h/x.tif", "type": "image/tiff"}}, "properties": {"datetime": "2024-01-01T00:00:00Z", "eo:cloud_cover": 3.5}}
    (tmp_path / "page1.json").write_text(json.dumps({"context": {"matched": 9}, "features": [item]}))
    row = S.read_item_pages(spark, str(tmp_path)).first()
    assert (row.matched, row.id, row.properties.cloud_cover) == (9, "i", 3.5)
    assert [r.path.rsplit("/", 1)[-1] for r in S.list_files(spark, str(tmp_path), "*.json").collect()] == ["page1.json"]


def test_tile_table_prunes(spark, tmp_path):
    S.write_tiles(L.raster_tiles(spark, SF), f"{tmp_path}/t")
    window = S.read_tiles(spark, f"{tmp_path}/t", rows=(2, 3), cols=(0, 4))
    assert window.count() == 10
    assert "PushedFilters: [IsNotNull(tile_row)" in window._jdf.queryExecution().toString()


def test_stream_folding_equals_batch(spark, tmp_path):
    rows = []
    for cell in range(3):
        kinds = ["text", "text_delta", "text_delta", "tool_call", "text_delta", "text", "text_delta", "reason", "text_delta", "result"]
        for i, k in enumerate(kinds):
            rows.append({"cell_id": cell, "step_index": i, "type": "text_delta" if k == "reason" else k, "content": f" {k}{i} ", "reasoning": k == "reason"})
    late = rows[::-1]
    for n, part in enumerate((late[:11], late[11:19], late[19:])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(r) for r in part))
    schema = "cell_id long, step_index long, type string, content string, reasoning boolean"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = ST.fold_text_stream(source).writeStream.format("memory").queryName("blocks").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    live = {tuple(r) for r in spark.table("blocks").collect()}
    batch = H.fold_text(spark.createDataFrame(rows, schema)).select("cell_id", "step_index", "text")
    assert live == {tuple(r) for r in batch.collect()} and len(live) == 12


def test_stream_ingest_and_usage(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(2):
        usage = json.dumps({"input_tokens": n + 1, "output_tokens": 1})
        (tmp_path / "in" / f"{n}.jsonl").write_text(json.dumps({"type": "result", "model": "m", "usage": usage}) + "\nbroken\n")
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(tmp_path / "in"))
    ST.ingest(lines, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    q = ST.usage_totals(TR.parse_lines(lines).select("model", "usage")).writeStream.format("memory").queryName("usage").outputMode(
        "complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.model, r.responses, r.input_tokens) for r in spark.table("usage").collect()] == [("m", 2, 3)]


def test_windows_round_halves_as_one_division_does(spark):
    g = R.Grid(1000, 1000, 4326, 0.36, 0.0, -180.0, 0.0, -0.17, 85.0)
    rows = [(k, (k * 37 % 3600) / 10.0 - 180, (k * 53 % 1700) / 10.0 - 85) for k in range(0, 6120, 3)]
    b = spark.createDataFrame(rows, "k int, w double, s double")
    got = b.select("k", "w", "s", TL.window_of(g, F.col("w"), F.col("s"), F.col("w") + 2, F.col("s") + 3).alias("at")).where("at is not null").collect()
    want = {k: (max(round((w + 180) / 0.36), 0), max(round((85 - (s + 3)) / 0.17), 0)) for k, w, s in rows}
    assert [r.k for r in got if (r["at"].col, r["at"].row) != want[r.k]] == []
    assert [r.k for r in got if TL.read_window(g, (r.w, r.s, r.w + 2, r.s + 3))[:2] != want[r.k]] == []


def ragged(values):
    """Horne gradients of an array whose absent pixels (NaN) end it: rows repeat their ends first, then columns."""
    at = lambda r, c: None if min(r, c) < 0 or r >= values.shape[0] or c >= values.shape[1] or np.isnan(values[r, c]) else values[r, c]
    out = {}
    for r, c in np.argwhere(~np.isnan(values)):
        north, here, south = (
            [v if (v := at(q, k)) is not None else at(q, c) for k in (c - 1, c, c + 1)] for q in (s if at(s, c) is not None else r for s in (r - 1, r, r + 1))
        )
        dx = (north[2] + 2 * here[2] + south[2] - north[0] - 2 * here[0] - south[0]) / 80
        dy = (north[0] + 2 * north[1] + north[2] - south[0] - 2 * south[1] - south[2]) / 80
        out[int(r), int(c)] = (dx, dy)
    return out


@pytest.fixture(scope="module")
def unfinished(spark):
    """Tiles of 4 x 4 pixels of which the last row has two of three, and their gradients by brute force."""
    values = np.random.default_rng(8).random((12, 12)) * 20
    values[8:, 8:] = np.nan
    tiles = R.pixel_tiles(raster(spark, values).where("value is not null"), 4)
    return tiles, R.Grid(12, 12, 3857, 10.0, 0.0, 0.0, 0.0, -10.0, 0.0), ragged(values)


def told(tiles, digits=6):
    return {(r.row, r.col): None if r.value is None else round(float(r.value), digits) for r in R.tile_pixels(tiles).collect()}


def test_aspect_ends_where_the_tiles_end(unfinished):
    tiles, g, want = unfinished
    assert told(T.aspect(tiles, g, missing="edge")) == {k: round(float(np.degrees(np.arctan2(-x, -y))) % 360, 6) for k, (x, y) in want.items()}
    assert None in told(T.aspect(tiles, g)).values()


def test_hillshade_ends_where_the_tiles_end(unfinished):
    tiles, g, want = unfinished
    slope = {k: np.arctan(np.hypot(x, y)) for k, (x, y) in want.items()}
    s = {k: np.sqrt(0.5) * (np.cos(slope[k]) + np.sin(slope[k]) * np.cos(np.radians(315) - np.arctan2(-x, -y))) for k, (x, y) in want.items()}
    assert told(T.hillshade(tiles, g, missing="edge")) == {k: np.floor(min(max(v, 0), 1) * 255) for k, v in s.items()}


def test_slope_in_degrees_ends_where_the_tiles_end(unfinished):
    tiles, g, want = unfinished
    assert told(T.slope(tiles, g, missing="edge")) == {k: round(float(np.degrees(np.arctan(np.hypot(x, y)))), 6) for k, (x, y) in want.items()}


def test_slope_in_percent_ends_where_the_tiles_end(unfinished):
    tiles, g, want = unfinished
    assert told(T.slope(tiles, g, "percent", missing="edge")) == {k: round(float(np.hypot(x, y) * 100), 6) for k, (x, y) in want.items()}


def test_contours_end_where_the_pixels_end(spark):
    slope = np.tile(np.arange(6.0), (6, 1))
    slope[4:, 4:] = np.nan
    g = R.Grid(6, 6, 3857, 1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    px = raster(spark, slope).where("value is not null")
    with pytest.raises(ValueError):
        Z.contour(px, g, 1.0, 0.5, block=2)
    lines = Z.contour(px, g, 1.0, 0.5, block=2, missing="edge").collect()
    long = {r.value: sum(abs(b.y - a.y) for a, b in zip(r.geom.parts[0].rings[0], r.geom.parts[0].rings[0][1:])) for r in lines}
    assert long == {0.5: 5.0, 1.5: 5.0, 2.5: 5.0, 3.5: 3.0, 4.5: 3.0}


ODD = [
    (1, "a\nb  c\t\r\nd ", "en", "s0"), (2, None, "en", "s0"), (3, "", "en", "s0"), (4, "\nsecond line", "de", "s1"),
    (5, "x", None, "s0"), (6, "x", "de", None), (7, "a\x0bb\x0cc\x1cd\x85e\xa0f\u3000g", "en", "s0"), (8, "\xa0 ends \u2003", "en", "s0"),
    (9, " \t\n", "en", "s0"), (10, "twice", "en", "s0"), (10, "twice", "en", "s0"), (11, "one", "en", "s0"), (11, "two", "de", "s1"),
    (None, "no id", "en", "s0"), (12, "\u2028 lines \u2029\nq", "", ""), (13, "  first\r\nsecond", "en", "s,t"),
]


def test_collection_entries_of_odd_documents_as_their_sql(spark, tmp_path):
    """Missing and empty fields, repeated ids and blanks of all kinds."""
    spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.QUERIES["collection_entries"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLES["collection_entries"]).fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_collection_entries_are_the_first_of_their_id(spark):
    rows = [(" a ", 2, "late", "x", ["k"]), ("a", 1, "", " x\xa0\n y ", None), (None, 3, "t", "x", []), (" ", 4, "t", "x", [])]
    raw = spark.createDataFrame(rows, "id string, ordinal int, title string, description string, keywords array<string>")
    assert [tuple(r) for r in K.collection_entries(raw).collect()] == [("a", 1, "a", "x y", [])]
