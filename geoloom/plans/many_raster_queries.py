"""Queries over several rasters and bands in one call, each with a grid of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geom as G
from ..operators import polygonize as Z
from ..operators import raster as R
from . import layers as L
from .registry import query

KEYS = ["raster_id", "band"]


def many(spark, sf):
    """The tile rows of the embeddings dealt to two rasters of two bands; band 2 has masked pixels."""
    px = L.pixels(spark, sf).withColumn("band", F.explode(F.array(F.lit(1), F.lit(2))))
    value = F.when(F.col("band") == 1, F.col("value")).when((F.col("row") % 5 != 0) | (F.col("col") % 7 != 0), F.col("value") * 10 + F.col("band") * F.col("label"))
    row = (F.floor(F.col("row") / 16) * 8 + F.col("row") % 8).cast("int")
    return px.select(F.concat(F.lit("r"), (F.floor(F.col("row") / 8) % 2).cast("string")).alias("raster_id"), "band", row.alias("row"), "col", value.alias("value"), "label")


MANY = """many as (select 'r' || (row//8 % 2) as raster_id, band, ((row//16)*8 + row%8)::integer as row, col, label,
  case when band = 1 then value when row%5 <> 0 or col%7 <> 0 then value*10 + band*label end as value from pixels, (values (1), (2)) b(band))"""


def rasters(spark, sf):
    """Both rasters' grids in one metric CRS: pixels of 10 and of 20 units."""
    t = F.floor(F.max("vec_id") / L.TILE_COLS) + 1
    size = L.table(spark, sf, "embeddings").agg(t.alias("t"))
    both = size.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    second = F.col("i") == 1
    return both.select(
        F.concat(F.lit("r"), F.col("i").cast("string")).alias("raster_id"), F.lit(200).alias("width"), (F.floor((F.col("t") + 1 - F.col("i")) / 2) * 8).cast("int").alias("height"), F.lit(3857).alias("srid"),
        F.when(second, 20.0).otherwise(10.0).alias("a"), F.lit(0.0).alias("b"), F.when(second, 1000.0).otherwise(0.0).alias("c"),
        F.lit(0.0).alias("d"), F.when(second, -20.0).otherwise(-10.0).alias("e"), F.when(second, 500.0).otherwise(0.0).alias("f"),
    )


def targets(spark, sf):
    """Coarser grids over the same ground: pixels of 30 and of 80 units."""
    second = F.col("raster_id") == "r1"
    k = F.when(second, 4).otherwise(3)
    return rasters(spark, sf).withColumns(
        {"width": F.ceil(F.col("width") / k).cast("int"), "height": F.ceil(F.col("height") / k).cast("int"), "a": F.col("a") * k, "e": F.col("e") * k}
    )


TARGETS = """size as (select max(vec_id)//25 + 1 as t from embeddings),
rasters as (select 'r' || i as raster_id, case i when 0 then 3 else 4 end as k, 200 as width, ((t + 1 - i)//2)*8 as height from size, (values (0), (1)) v(i)),
cells as (select raster_id, k, band, r::integer as row, c::integer as col from (
  select *, unnest(range(((width + k - 1)//k)::bigint)) as c from (select *, unnest(range(((height + k - 1)//k)::bigint)) as r from rasters, (values (1), (2)) b(band))))"""


@query(
    "stats_by_band",
    """select raster_id, band, round(min(value), 6) as min, round(max(value), 6) as max, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std,
       round(quantile_cont(value, 0.02), 6) as p2, round(quantile_cont(value, 0.98), 6) as p98 from many group by 1, 2""",
    base=(L.PIXELS, MANY),
)
def stats_by_band(spark, sf):
    s = R.band_stats(many(spark, sf), keys=KEYS)
    return s.select(*KEYS, *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std", "p2", "p98")])


@query(
    "histogram_by_band",
    """, e as (select raster_id, band, min(value) as lo, max(value) as hi from many group by 1, 2),
       h as (select raster_id, band, least(floor((value-lo)/((hi-lo)/64.0::double)), 63)::bigint as bin, count(*) as n from many join e using (raster_id, band) where value is not null group by 1, 2, 3)
       select e.raster_id, e.band, b as bin, coalesce(n, 0) as n from (select *, unnest(range(64)) as b from e) left join h on (h.raster_id, h.band, h.bin) = (e.raster_id, e.band, b)""".replace("(select *, unnest(range(64)) as b from e)", "(select *, unnest(range(64)) as b from e) e"),
    base=(L.PIXELS, MANY),
)
def histogram_by_band(spark, sf):
    return R.histogram(many(spark, sf), 64, keys=KEYS)


@query(
    "rescale_by_band",
    """, l as (select raster_id, band, quantile_cont(value, 0.02) as lo, quantile_cont(value, 0.98) as hi from many group by 1, 2)
       select raster_id, band, row, col, case when value is not null then floor(least(greatest((value-lo)/(hi-lo)*255.0, 0), 255))::smallint end as value from many join l using (raster_id, band)""",
    base=(L.PIXELS, MANY),
)
def rescale_by_band(spark, sf):
    return R.rescale(many(spark, sf), keys=KEYS).select(*KEYS, "row", "col", "value")


@query(
    "compose_rgb_by_raster",
    """, w as (select raster_id, row, col, max(value) filter (band = 1) as red, max(value) filter (band = 2) as green, -max(value) filter (band = 1) as blue from many group by 1, 2, 3),
       l as (select raster_id, quantile_cont(red, [0.02, 0.98]) as r, quantile_cont(green, [0.02, 0.98]) as g, quantile_cont(blue, [0.02, 0.98]) as u from w group by 1)
       select raster_id, row, col, floor(least(greatest((red-r[1])/(r[2]-r[1])*255.0, 0), 255))::smallint as red,
         coalesce(floor(least(greatest((green-g[1])/(g[2]-g[1])*255.0, 0), 255)), 0)::smallint as green,
         floor(least(greatest((blue-u[1])/(u[2]-u[1])*255.0, 0), 255))::smallint as blue from w join l using (raster_id)""",
    base=(L.PIXELS, MANY),
)
def compose_rgb_by_raster(spark, sf):
    wide = many(spark, sf).groupBy("raster_id", "row", "col").agg(
        F.max(F.when(F.col("band") == 1, F.col("value"))).alias("red"), F.max(F.when(F.col("band") == 2, F.col("value"))).alias("green"),
        (-F.max(F.when(F.col("band") == 1, F.col("value")))).alias("blue"),
    )
    return R.compose_rgb(wide, keys=["raster_id"])


@query(
    "mosaic_by_band",
    "select band, row, col, round(coalesce(max(value) filter (raster_id = 'r1'), max(value) filter (raster_id = 'r0')), 6) as value from many group by 1, 2, 3",
    base=(L.PIXELS, MANY),
)
def mosaic_by_band(spark, sf):
    """Both rasters on one grid of rows and columns, the second one first, band by band."""
    px = many(spark, sf).withColumn("priority", F.when(F.col("raster_id") == "r1", 0).otherwise(1))
    return R.mosaic(px, "priority", keys=["band"]).select("band", "row", "col", F.round("value", 6).alias("value"))


def _zones(spark, sf):
    """Boxes for even nations, triangles with a right angle at their lower left for odd ones."""
    k = F.col("n_nationkey")
    w, n = k * 70.3 + 0.1, k * -25.7 + 480.2
    e, s = w + 450.7, n - 260.3
    triangle = G.polygon(F.array(G.xy(w, s), G.xy(e, s), G.xy(w, n), G.xy(w, s)))
    return L.table(spark, sf, "nation").select("n_nationkey", F.when(k % 2 == 0, G.box(w, s, e, n)).otherwise(triangle).alias("geom"), F.lit(3857).alias("srid"))


_ZONES = """z as (select n_nationkey as k, n_nationkey*70.3::double + 0.1 as w, n_nationkey*-25.7::double + 480.2 as n from nation),
p as (select *, case raster_id when 'r0' then (col+0.5)*10 else 1000 + (col+0.5)*20 end as x, case raster_id when 'r0' then (row+0.5)*-10 else 500 - (row+0.5)*20 end as y from many),
hit as (select k, raster_id, band, value from z join p on x > w and x < w+450.7 and y > n-260.3 and y < n and value is not null
  and (k%2 = 0 or (x-w)/450.7 + (y-(n-260.3))/260.3 < 1))"""


@query(
    "zonal_stats_by_band",
    """select z.k as n_nationkey, b.raster_id, b.band, count(value) as raster_count, round(avg(value), 6) as raster_mean, round(min(value), 6) as raster_min,
       round(max(value), 6) as raster_max, round(stddev_pop(value), 6) as raster_std, round(median(value), 6) as raster_median
       from z cross join (select distinct raster_id, band from many) b left join hit on (hit.k, hit.raster_id, hit.band) = (z.k, b.raster_id, b.band) group by 1, 2, 3""",
    base=(L.PIXELS, MANY, _ZONES),
)
def zonal_stats_by_band(spark, sf):
    z = R.zonal_stats_all(many(spark, sf), rasters(spark, sf), _zones(spark, sf), "n_nationkey", ("count", "mean", "min", "max", "std", "median"), KEYS, zones_srid=3857)
    rounded = [F.round(f"raster_{c}", 6).alias(f"raster_{c}") for c in ("mean", "min", "max", "std", "median")]
    return z.select("n_nationkey", *KEYS, "raster_count", *rounded)


def _reprojected(spark, sf, how):
    v = R.reproject_all(many(spark, sf), rasters(spark, sf), targets(spark, sf), how, KEYS)
    return v.select(*KEYS, "row", "col", F.round("value", 6).alias("value"))


#: Footprints: the source pixels whose centres lie in a target pixel.
for _how, _sql in {
    "average": "avg(value)", "min": "min(value)", "max": "max(value)", "median": "median(value)",
}.items():
    query(
        f"reproject_{_how}",
        f"""select cells.raster_id, cells.band, cells.row, cells.col, round({_sql}, 6) as value from cells left join many
           on many.raster_id = cells.raster_id and many.band = cells.band and many.row//k = cells.row and many.col//k = cells.col group by 1, 2, 3, 4""",
        base=(L.PIXELS, MANY, TARGETS),
    )(lambda spark, sf, how=_how: _reprojected(spark, sf, how))


@query(
    "reproject_mode",
    """, votes as (select raster_id, band, row//k as row, col//k as col, round(value)::double + 0.0 as value, count(*) as n from many join rasters using (raster_id) where value is not null group by 1, 2, 3, 4, 5),
       best as (select * from votes qualify row_number() over (partition by raster_id, band, row, col order by n desc, value) = 1)
       select raster_id, band, row, col, best.value as value from cells left join best using (raster_id, band, row, col)""",
    base=(L.PIXELS, MANY, TARGETS),
)
def reproject_mode(spark, sf):
    px = many(spark, sf).withColumn("value", F.round("value"))
    return R.reproject_all(px, rasters(spark, sf), targets(spark, sf), "mode", KEYS).select(*KEYS, "row", "col", (F.col("value") + 0.0).alias("value"))


_SPOT = "spot as (select *, (col+0.5)*k - 0.5 as x, (row+0.5)*k - 0.5 as y from cells)"


@query(
    "reproject_many_nearest",
    """select cells.raster_id, cells.band, cells.row, cells.col, round(value, 6) as value from cells left join many on many.raster_id = cells.raster_id and many.band = cells.band
       and many.row = floor((cells.row+0.5)*k) and many.col = floor((cells.col+0.5)*k)""",
    base=(L.PIXELS, MANY, TARGETS),
)
def reproject_many_nearest(spark, sf):
    return _reprojected(spark, sf, "nearest")


@query(
    "reproject_cubic",
    f""", {_SPOT}, o as (select unnest([-1, 0, 1, 2]) as o), near as (
         select spot.*, floor(y)::integer + a.o as r, floor(x)::integer + b.o as c, abs(y - floor(y) - a.o) as ty, abs(x - floor(x) - b.o) as tx from spot, o a, o b),
       w as (select near.*, value, case when ty <= 1 then (1.5*ty - 2.5)*ty*ty + 1 when ty < 2 then ((-0.5*ty + 2.5)*ty - 4)*ty + 2 else 0 end *
         case when tx <= 1 then (1.5*tx - 2.5)*tx*tx + 1 when tx < 2 then ((-0.5*tx + 2.5)*tx - 4)*tx + 2 else 0 end as g
         from near join rasters using (raster_id) left join many on many.raster_id = near.raster_id and many.band = near.band and many.row = r and many.col = c and floor(y+0.5) between 0 and height-1 and floor(x+0.5) between 0 and width-1)
       select raster_id, band, row, col, round(case when sum(g) filter (value is not null) > 0 then sum(g*value) / sum(g) filter (value is not null) end, 6) as value from w group by 1, 2, 3, 4""",
    base=(L.PIXELS, MANY, TARGETS),
)
def reproject_cubic(spark, sf):
    return _reprojected(spark, sf, "cubic")


@query(
    "polygonize_by_raster",
    """cells as (select (vec_id//25)%2 as g, (vec_id//25)//2 as r, vec_id%25 as c, label%3 as v, ((vec_id//25)//2)*25 + vec_id%25 as id from embeddings),
       walk as (select g, id as root, id, r, c, v from cells union
         select w.g, w.root, n.id, n.r, n.c, n.v from walk w join cells n on n.g = w.g and n.v = w.v and abs(n.r-w.r) + abs(n.c-w.c) = 1),
       comp as (select g, id, min(root) as comp, any_value(v) as v from walk group by g, id)
       select 'r' || g as raster_id, ((comp//25)*8)*2147483648::bigint + (comp%25)*8 as region, any_value(v)::double as value, round(count(*)*64*case g when 0 then 100.0::double else 400.0::double end, 4) as area
       from comp group by g, comp""".replace("cells as", "with recursive cells as", 1),
)
def polygonize_by_raster(spark, sf):
    px = many(spark, sf).where("band = 1").select("raster_id", "row", "col", (F.col("label") % 3).alias("value"))
    p = Z.polygonize_all(px, rasters(spark, sf), block=32)
    return p.select("raster_id", "region", "value", F.round(G.area(F.col("geom")), 4).alias("area"))
