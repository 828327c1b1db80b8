"""Layers derived from the supplied tables by key arithmetic.

Each layer is defined twice, once as a DataFrame and once as the SQL text of the
same rows, so that a query and its check start from the same data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom as G


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all tasks, for costly work on a table whose few bytes stand in one or two read tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def points(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    x = ((F.col("c_custkey") * 37) % 3600) / F.lit(10.0) - 180
    y = ((F.col("c_custkey") * 53) % 1700) / F.lit(10.0) - 85
    return c.select("*", x.alias("x"), y.alias("y")).select(
        "*", G.point("x", "y").alias("geom"), F.lit(4326).alias("srid")
    )


POINTS = """points as (select *, (c_custkey*37 % 3600)/10.0::double - 180 as x,
  (c_custkey*53 % 1700)/10.0::double - 85 as y from customer)"""


def zones(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation")
    west = (F.col("n_nationkey") % 5) * 72.0 - 180
    south = F.floor(F.col("n_nationkey") / 5) * 34.0 - 85
    return n.select("n_nationkey", "n_name", "n_regionkey", west.alias("w"), south.alias("s")).select(
        "n_nationkey", "n_name", "n_regionkey",
        G.box(F.col("w"), F.col("s"), F.col("w") + 60, F.col("s") + 30).alias("geom"),
        F.lit(4326).alias("srid"),
    )


ZONES = """zones as (select n_nationkey, n_name, n_regionkey, w, s, w+60 as e, s+30 as n from (
  select *, (n_nationkey%5)*72.0::double - 180 as w, floor(n_nationkey/5)*34.0::double - 85 as s from nation))"""


def boxes(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    x = ((k * 37) % 3600) / F.lit(10.0) - 180
    y = ((k * 53) % 1700) / F.lit(10.0) - 85
    return s.select("*", x.alias("w"), y.alias("s")).select(
        "s_suppkey", "s_name", "s_nationkey", "s_acctbal",
        G.box(F.col("w"), F.col("s"), F.col("w") + 1 + k % 7, F.col("s") + 1 + k % 5).alias("geom"),
        F.lit(4326).alias("srid"),
    )


BOXES = """boxes as (select *, w + 1 + s_suppkey%7 as e, s + 1 + s_suppkey%5 as n from (
  select *, (s_suppkey*37 % 3600)/10.0::double - 180 as w, (s_suppkey*53 % 1700)/10.0::double - 85 as s from supplier))"""


def part_boxes(spark, sf) -> DataFrame:
    """Many small overlapping boxes: the detections' geometry without scores."""
    d = detections(spark, sf)
    return d.select(
        "id", "label", "score", "p_size", G.box("x0", "y0", "x1", "y1").alias("geom"), F.lit(3857).alias("srid")
    )


def detections(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    side = 4 + F.col("p_size") % 8
    return p.select(
        k.alias("id"), F.col("p_brand").alias("label"), "p_size",
        (((k * 7919) % 1000) / F.lit(1000.0)).alias("score"),
        ((k * 37) % 200).cast("double").alias("x0"), ((k * 53) % 200).cast("double").alias("y0"),
        ((k * 37) % 200 + side).cast("double").alias("x1"), ((k * 53) % 200 + side).cast("double").alias("y1"),
    )


DETECTIONS = """detections as (select p_partkey as id, p_brand as label, p_size,
  (p_partkey*7919 % 1000)/1000.0::double as score,
  (p_partkey*37%200)::double as x0, (p_partkey*53%200)::double as y0,
  (p_partkey*37%200 + 4 + p_size%8)::double as x1, (p_partkey*53%200 + 4 + p_size%8)::double as y1 from part)"""


TILE = 8
TILE_COLS = 25


def raster_tiles(spark, sf) -> DataFrame:
    """One 8x8 tile per embedding, in the tile-table form."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.lit("emb").alias("raster_id"), F.lit(1).alias("band"),
        F.floor(F.col("vec_id") / TILE_COLS).cast("int").alias("tile_row"),
        (F.col("vec_id") % TILE_COLS).cast("int").alias("tile_col"),
        F.lit(TILE).alias("h"), F.lit(TILE).alias("w"),
        F.col("embedding").cast("array<double>").alias("values"), "label",
    )


def pixels(spark, sf) -> DataFrame:
    t = raster_tiles(spark, sf)
    return t.select(
        "tile_row", "tile_col", "label", F.posexplode("values").alias("i", "value")
    ).select(
        (F.col("tile_row") * TILE + F.floor(F.col("i") / TILE)).cast("int").alias("row"),
        (F.col("tile_col") * TILE + F.col("i") % TILE).cast("int").alias("col"),
        "value", "label",
    )


PIXELS = """pixels as (select (8*tr + i//8)::integer as row, (8*tc + i%8)::integer as col, v as value, label, tr, tc from (
  select (vec_id//25)::integer as tr, (vec_id%25)::integer as tc, label,
    unnest(range(0, 64))::integer as i, unnest(embedding)::double as v from embeddings))"""


def bands(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        (F.col("l_extendedprice") / 1e5).alias("nir"), (F.col("l_quantity") / 100).alias("red"),
        F.col("l_discount").alias("green"), F.col("l_tax").alias("blue"),
        (F.col("l_discount") + F.col("l_tax")).alias("swir16"), (F.col("l_quantity") / 200).alias("swir22"),
    )


BANDS = """bands as (select l_orderkey, l_linenumber, l_extendedprice/1e5 as nir, l_quantity/100 as red,
  l_discount as green, l_tax as blue, l_discount + l_tax as swir16, l_quantity/200 as swir22 from lineitem)"""


def scene_items(spark, sf) -> DataFrame:
    """Orders as nested catalog items, as a harvested page would hold them."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    west = ((k * 37) % 3600) / F.lit(10.0) - 180
    south = ((k * 53) % 1700) / F.lit(10.0) - 85
    href = F.concat(F.lit("https://img.example.com/"), k.cast("string"), F.lit("/visual.tif"))
    s3 = F.concat(F.lit("s3://bucket-a/"), k.cast("string"), F.lit("/B04.tif"))
    asset = "struct<href:string,type:string,gsd:double>"

    def item(h, kind, gsd=None):
        return F.struct(h.alias("href"), F.lit(kind).alias("type"), F.lit(gsd).cast("double").alias("gsd")).cast(asset)

    assets = F.map_filter(
        F.create_map(
            F.lit("thumbnail"), item(F.concat(F.lit("https://img.example.com/"), k.cast("string"), F.lit(".png")), "image/png"),
            F.lit("B04"), item(s3, "image/tiff; application=geotiff", 10.0),
            F.lit("visual"), item(href, "image/tiff; application=geotiff; profile=cloud-optimized", 10.0),
            F.lit("meta"), item(F.lit("https://img.example.com/meta.xml"), "application/xml"),
        ),
        lambda name, a: ~((name == "visual") & (k % 7 == 0)) & ~((name == "B04") & (k % 21 == 0)),
    )
    return o.select(
        k.cast("string").alias("id"), F.col("o_orderpriority").alias("collection"), k.alias("ordinal"),
        F.when(k % 13 != 0, F.array(west, south, west + 1 + k % 3, south + 1 + k % 2)).alias("bbox"),
        assets.alias("assets"),
        F.struct(
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"),
            F.lit(None).cast("string").alias("start_datetime"),
            F.when(k % 5 != 0, F.lit("sat-a")).alias("platform"), F.lit("const-x").alias("constellation"),
            F.when(k % 11 != 0, (k % 101).cast("double")).alias("cloud_cover"),
            F.lit(None).cast("string").alias("title"), F.lit(None).cast("double").alias("gsd"),
            F.lit(None).cast("double").alias("eo_gsd"),
        ).alias("properties"),
    )


#: The same scenes in SQL after asset choice: id, url, asset name and filters.
SCENES = """items as (select o_orderkey as k, o_orderkey::varchar as id, o_orderpriority as collection,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as datetime,
  case when o_orderkey % 11 <> 0 then (o_orderkey % 101)::double end as cloud,
  o_orderkey % 13 <> 0 as has_box,
  (o_orderkey*37 % 3600)/10.0::double - 180 as west, (o_orderkey*53 % 1700)/10.0::double - 85 as south from orders),
scenes as (select *, west + 1 + k%3 as east, south + 1 + k%2 as north,
  case when k%7 <> 0 then 'visual' else 'B04' end as asset,
  case when k%7 <> 0 then 'https://img.example.com/' || id || '/visual.tif'
       else 'https://bucket-a.s3.amazonaws.com/' || id || '/B04.tif' end as asset_url,
  case when k%5 <> 0 then 'sat-a' else 'const-x' end as sensor
  from items where not (k%21 = 0))"""


def collections(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ordinal"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("description"),
        F.array("lang", "source").alias("keywords"),
    )


def history_units(spark, sf) -> DataFrame:
    """Conversation turns as indexed units of a run history."""
    c = table(spark, sf, "conversations")
    kind = F.when(F.col("role") == "user", "prompt").when(F.col("role") == "assistant", "response").otherwise("tool_result")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("cell_id"),
        F.col("turn").alias("step_index"), kind.alias("kind"), "text",
        F.when(kind == "tool_result", F.concat(F.lit("tool_"), (F.col("turn") % 3).cast("string"))).alias("tool_name"),
    )


UNITS = """units as (select conv_id*1000 + turn as id, conv_id as cell_id, turn as step_index,
  case role when 'user' then 'prompt' when 'assistant' then 'response' else 'tool_result' end as kind, text,
  case when role not in ('user', 'assistant') then 'tool_' || (turn % 3) end as tool_name from conversations)"""


def trace_steps(spark, sf) -> DataFrame:
    """Events as agent-trace steps: one cell per user, in time order."""
    e = table(spark, sf, "events")
    kind = (
        F.when(F.col("event_type") == "view", "text").when(F.col("event_type") == "purchase", "tool_call")
        .when(F.col("event_type") == "signup", "tool_result").otherwise("text_delta")
    )
    return e.select(
        F.col("user_id").alias("cell_id"), F.col("event_id").alias("step_index"), kind.alias("type"),
        F.when(F.col("event_type").isin("purchase", "signup"), F.concat(F.lit("tool_"), F.col("event_id") % 4)).alias("name"),
        F.when(F.col("event_type") == "purchase", F.col("props")).alias("args"),
        F.when(F.col("event_type") != "purchase", F.concat(F.col("event_type"), F.lit("  "), F.col("props"))).alias("content"),
        F.col("event_id").cast("string").alias("tool_call_id"),
        (F.col("event_type") == "error").alias("reasoning"), "ts", "value",
    )


STEPS = """steps as (select user_id as cell_id, event_id as step_index,
  case event_type when 'view' then 'text' when 'purchase' then 'tool_call' when 'signup' then 'tool_result' else 'text_delta' end as type,
  case when event_type in ('purchase','signup') then 'tool_' || (event_id % 4) end as name,
  case when event_type = 'purchase' then props end as args,
  case when event_type <> 'purchase' then event_type || '  ' || props end as content,
  event_type = 'error' as reasoning, ts, value from events)"""
