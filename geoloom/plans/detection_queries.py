"""Queries over tile plans, detections, masks, regions and contours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geom as G
from ..operators import nms as N
from ..operators import polygonize as Z
from ..operators import raster as R
from ..operators import tiling as T
from . import layers as L
from .raster_queries import emb_grid, metric_grid
from .registry import query

_GREEDY = """, ranked as (select *, row_number() over (partition by {part} order by score desc, id) as rn from detections),
  greedy as (
    select {key}, 0::bigint as step, []::struct(id bigint, x0 double, y0 double, x1 double, y1 double)[] as kept from (select distinct {key} from ranked)
    union all
    select g.{key}, g.step + 1, case when len(list_filter(g.kept, lambda k:
        greatest(least(k.x1, r.x1) - greatest(k.x0, r.x0), 0) * greatest(least(k.y1, r.y1) - greatest(k.y0, r.y0), 0)
        > {t}::double * ((k.x1-k.x0)*(k.y1-k.y0) + (r.x1-r.x0)*(r.y1-r.y0)
          - greatest(least(k.x1, r.x1) - greatest(k.x0, r.x0), 0) * greatest(least(k.y1, r.y1) - greatest(k.y0, r.y0), 0)))) > 0
      then g.kept else list_append(g.kept, {{'id': r.id, 'x0': r.x0, 'y0': r.y0, 'x1': r.x1, 'y1': r.y1}}) end
    from greedy g join ranked r on r.{key} = g.{key} and r.rn = g.step + 1),
  final as (select {key}, unnest(kept).id as id from (select {key}, arg_max(kept, step) as kept from greedy group by {key}))
  select id from final"""


@query("nms_per_class", _GREEDY.format(part="label", key="label", t=0.5), base=(L.DETECTIONS,), recursive=True)
def nms_per_class(spark, sf):
    return N.greedy_nms(L.detections(spark, sf), 0.5, ["label"]).select("id")


@query("nms_low_threshold", _GREEDY.format(part="label", key="label", t=0.2), base=(L.DETECTIONS,), recursive=True)
def nms_low_threshold(spark, sf):
    return N.greedy_nms(L.detections(spark, sf), 0.2, ["label"]).select("id")


@query("nms_class_blind", ", blind as (select *, 0 as one from detections)" + _GREEDY.format(part="one", key="one", t=0.7).replace("from detections", "from blind"), base=(L.DETECTIONS,), recursive=True)
def nms_class_blind(spark, sf):
    """Class-blind suppression; its SQL takes the boxes one by one."""
    return N.greedy_nms(L.detections(spark, sf), 0.7).select("id")


@query(
    "box_iou",
    """, g as (select id, label, x0, y0, x1, y1, lag(x0) over w as px0, lag(y0) over w as py0, lag(x1) over w as px1, lag(y1) over w as py1
         from detections window w as (partition by label order by id)),
       i as (select *, greatest(least(x1, px1)-greatest(x0, px0), 0)*greatest(least(y1, py1)-greatest(y0, py0), 0) as inter from g where px0 is not null)
       select id, round(inter/((x1-x0)*(y1-y0)+(px1-px0)*(py1-py0)-inter), 6) as iou from i""",
    base=(L.DETECTIONS,),
)
def box_iou(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("id")
    d = L.detections(spark, sf).select(
        "id", *[F.col(c).alias("a_" + c) for c in N.BOX], *[F.lag(c).over(w).alias("b_" + c) for c in N.BOX]
    ).where("b_x0 is not null")
    return d.select("id", F.round(N.iou(), 6).alias("iou"))


def _rasters(spark, sf):
    """Orders as rasters of many sizes."""
    k = F.col("o_orderkey")
    return L.table(spark, sf, "orders").select(
        k.alias("raster_id"), (200 + k % 3001).cast("int").alias("width"), (100 + k * 7 % 2003).cast("int").alias("height"),
        (k % 5 * 100).cast("int").alias("col_off"), (k % 3 * 50).cast("int").alias("row_off"),
    )


_PLAN = """r as (select o_orderkey as id, 200 + o_orderkey%3001 as w, 100 + o_orderkey*7%2003 as h, o_orderkey%5*100 as ox, o_orderkey%3*50 as oy from orders),
n as (select *, case when w <= 512 then 1 else greatest(2, ceil((w-512)/448.0)::bigint + 1) end as nx, case when h <= 512 then 1 else greatest(2, ceil((h-512)/448.0)::bigint + 1) end as ny from r),
a as (select *, unnest(range(0, nx)) as tc from n), b as (select *, unnest(range(0, ny)) as tr from a),
p as (select *, case when nx = 1 then 0 else round_even(tc*(w-512)/(nx-1)::double, 0)::bigint end as x, case when ny = 1 then 0 else round_even(tr*(h-512)/(ny-1)::double, 0)::bigint end as y from b),
c as (select *, lead(x) over (partition by id, tr order by tc) as rx, lag(x) over (partition by id, tr order by tc) as lx,
  lead(y) over (partition by id, tc order by tr) as ry, lag(y) over (partition by id, tc order by tr) as ly from p),
plan as (select id, tr, tc, x+ox as x, y+oy as y, least(512, w-x) as w, least(512, h-y) as h,
  ox + case when lx is null then 0 else (lx+512+x)/2.0::double end as cx0, oy + case when ly is null then 0 else (ly+512+y)/2.0::double end as cy0,
  ox + case when rx is null then w::double else (x+512+rx)/2.0::double end as cx1, oy + case when ry is null then h::double else (y+512+ry)/2.0::double end as cy1 from c)"""


@query(
    "plan_tiles",
    "select id as raster_id, tr::integer as tile_row, tc::integer as tile_col, x::integer as x, y::integer as y, w::integer as w, h::integer as h, cx0 as core_x0, cy0 as core_y0, cx1 as core_x1, cy1 as core_y1 from plan",
    base=(_PLAN,),
)
def plan_tiles(spark, sf):
    return T.plan_tiles(_rasters(spark, sf), 512, 64)


@query(
    "tile_core_area",
    "select o_orderkey as raster_id, ((200 + o_orderkey%3001)*(100 + o_orderkey*7%2003))::double as area from orders",
)
def tile_core_area(spark, sf):
    """The cores of each raster's tiles cover it exactly once."""
    p = T.plan_tiles(_rasters(spark, sf), 512, 64)
    a = (F.col("core_x1") - F.col("core_x0")) * (F.col("core_y1") - F.col("core_y0"))
    return p.groupBy("raster_id").agg(F.sum(a).alias("area"))


@query(
    "canvas_sizes",
    """, r as (select o_orderkey as id, 200 + o_orderkey%3001 as w, 100 + o_orderkey*7%2003 as h from orders),
       s as (select *, least(480.0::double/least(w,h), 800.0::double/greatest(w,h)) as scale from r)
       select id as raster_id, greatest(16, (floor(round_even(w*scale, 0)/16)*16)::integer)::integer as width,
       greatest(16, (floor(round_even(h*scale, 0)/16)*16)::integer)::integer as height, round(scale, 6) as scale from s""".replace(", r as", "with r as", 1),
)
def canvas_sizes(spark, sf):
    c = _rasters(spark, sf).select("raster_id", T.canvas(F.col("height"), F.col("width"), 800, 1333, 800).alias("c"))
    return c.select("raster_id", "c.width", "c.height", F.round("c.scale", 6).alias("scale"))


@query(
    "stretch_tiles",
    """, q as (select vec_id, quantile_cont(v, 0.02) as lo, quantile_cont(v, 0.98) as hi from (select vec_id, unnest(embedding)::double as v from embeddings) group by 1),
       p as (select vec_id, unnest(embedding)::double as v from embeddings)
       select vec_id, sum(floor(least(greatest((v-lo)*(255.0/(hi-lo)), 0), 255))::integer)::bigint as total from p join q using (vec_id) group by 1""".replace(", q as", "with q as", 1),
)
def stretch_tiles(spark, sf):
    e = L.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", F.aggregate(T.stretch_band(F.col("v")), F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query(
    "normalised_channels",
    """select vec_id, round(list_sum(list_transform(embedding, lambda v: (least(greatest(floor(v::double*40+128), 0), 255)/255.0::double - 0.456)/0.224)), 6) as total from embeddings""",
)
def normalised_channels(spark, sf):
    e = L.table(spark, sf, "embeddings")
    byte = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.least(F.greatest(F.floor(v * 40 + 128), F.lit(0)), F.lit(255)))
    return e.select("vec_id", F.round(F.aggregate(T.normalise(byte, 1), F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(
    "read_windows",
    """, r as (select s_suppkey, round_even((w+180)/0.36, 0)::bigint as c0, round_even((e-w)/0.36, 0)::bigint as wd,
         round_even((85-n)/0.17, 0)::bigint as r0, round_even((n-s)/0.17, 0)::bigint as hg from boxes),
       k as (select s_suppkey, greatest(c0, 0) as col, greatest(r0, 0) as row, least(c0+wd, 1000) as c1, least(r0+hg, 1000) as r1 from r)
       select s_suppkey, col, row, c1-col as width, r1-row as height from k where c1 > col and r1 > row""",
    base=(L.BOXES,),
)
def read_windows(spark, sf):
    grid = R.Grid(1000, 1000, 4326, 0.36, 0.0, -180.0, 0.0, -0.17, 85.0)
    b = G.with_bbox(L.boxes(spark, sf))
    windows = b.select("s_suppkey", T.window_of(grid, *(F.col(c) for c in G.BBOX)).alias("w")).where("w is not null")
    return windows.select("s_suppkey", "w.*")


@query(
    "tile_rgb_not_blank",
    "select vec_id from embeddings where vec_id % 4 <> 0",
)
def tile_rgb_not_blank(spark, sf):
    e = L.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    flat = e.withColumn("v", F.when(F.col("vec_id") % 4 == 0, F.transform("v", lambda x: F.lit(7.0))).otherwise(F.col("v")))
    return T.tile_rgb(flat, ["v"]).select("vec_id")


@query(
    "score_tiles",
    "select vec_id, round(list_avg(list_transform(embedding, lambda v: v::double)), 6) as score from embeddings",
)
def score_tiles(spark, sf):
    e = L.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))

    def load():
        import numpy as np
        import pandas as pd

        return lambda batch: pd.DataFrame({"vec_id": batch["vec_id"], "score": np.stack(batch["v"]).mean(1)})

    return T.score_tiles(e, load, "vec_id long, score double").select("vec_id", F.round("score", 6).alias("score"))


@query(
    "decode_detections",
    """, e as (select vec_id, list_transform(embedding[1:62], lambda v: v::double*10) as z, embedding[63]::double as cx, embedding[64]::double as cy from embeddings),
       s as (select vec_id, cx, cy, z, list_max(z) as m from e), t as (select *, list_transform(z, lambda v: exp(v-m)) as x from s),
       p as (select *, list_transform(x, lambda v: v/list_sum(x))[1:5] as p from t),
       b as (select *, list_max(p) as score, list_position(p, list_max(p)) - 1 as c from p)
       select vec_id, c::integer as class_id, ['car','N/A','ship','plane','tree'][c+1] as label, round(score, 6) as score, round(cx-0.1, 6) as x0, round(cy+0.15, 6) as y1
       from b where score >= 0.05 and c in (0, 2, 3)""".replace(", e as", "with e as", 1),
)
def decode_detections(spark, sf):
    v = F.col("embedding").cast("array<double>")
    raw = L.table(spark, sf, "embeddings").select(
        "vec_id", F.transform(F.slice(v, 1, 62), lambda z: z * 10).alias("logits"), F.get(v, F.lit(62)).alias("cx"), F.get(v, F.lit(63)).alias("cy"),
        F.lit(0.2).alias("bw"), F.lit(0.3).alias("bh"),
    )
    d = T.decode_detections(raw, ["car", "N/A", "ship", "plane", "tree"], 0.05, ["Car", "ship", "plane"], ["vec_id"], order="vec_id")
    return d.select("vec_id", "class_id", "label", F.round("score", 6).alias("score"), F.round("x0", 6).alias("x0"), F.round("y1", 6).alias("y1"))


@query(
    "detections_to_tile_pixels",
    """, d as (select id, least(greatest((x0/200)*480/0.5, 0), 700) as a, least(greatest((y0/200)*320/0.5, 0), 500) as b,
         least(greatest((x1/200)*480/0.5, 0), 700) as c, least(greatest((y1/200)*320/0.5, 0), 500) as e from detections)
       select id, round(a, 6) as x0, round(b, 6) as y0, round(c, 6) as x1, round(e, 6) as y1 from d where c-a >= 1 and e-b >= 1""",
    base=(L.DETECTIONS,),
)
def detections_to_tile_pixels(spark, sf):
    d = L.detections(spark, sf)
    d = d.withColumns({c: F.col(c) / 200 for c in N.BOX}).withColumns(
        {"canvas": F.struct(F.lit(480).alias("width"), F.lit(320).alias("height"), F.lit(0.5).alias("scale")), "w": F.lit(700), "h": F.lit(500)}
    )
    return T.to_tile_pixels(d).select("id", *[F.round(c, 6).alias(c) for c in N.BOX])


def _in_windows(spark, sf):
    """Detections, enlarged, seen by every 256-pixel window that holds them whole, of the raster they span."""
    d = L.detections(spark, sf).select("id", "label", "score", *[(F.col(c) * 2.9).alias(c) for c in N.BOX])
    one = d.agg(F.ceil(F.max("x1")).cast("int").alias("width"), F.ceil(F.max("y1")).cast("int").alias("height"))
    windows = T.plan_tiles(one.select(F.lit("r").alias("raster_id"), "width", "height"), 256, 100)
    return T.prompts_in_tiles(d, windows)


def _axis(side: str) -> str:
    """The starts of the windows along one side, and the half-open cores between the middles of their overlaps."""
    return f"""{side}s as (select unnest(range(greatest(2, ceil(({side}_n - 256)/156.0)::bigint + 1))) as i, greatest(2, ceil(({side}_n - 256)/156.0)::bigint + 1) as n, {side}_n from size),
{side}t as (select i, n, {side}_n, round_even(i * ({side}_n - 256) / (n - 1)::double, 0)::bigint as s from {side}s),
{side}w as (select s, case when i = 0 then 0 else (lag(s) over (order by i) + 256 + s) / 2.0::double end as lo, case when i = n - 1 then {side}_n else (s + 256 + lead(s) over (order by i)) / 2.0::double end as hi from {side}t)"""


_W = f"""big as (select id, label, score, x0*2.9::double as x0, y0*2.9::double as y0, x1*2.9::double as x1, y1*2.9::double as y1 from detections),
size as (select ceil(max(x1))::bigint as x_n, ceil(max(y1))::bigint as y_n from big), {_axis("x")}, {_axis("y")},
seen as (select big.*, xw.s as wx, yw.s as wy, xw.lo as x_lo, xw.hi as x_hi, yw.lo as y_lo, yw.hi as y_hi
  from big join xw on x0 >= xw.s and x1 < xw.s+256 join yw on y0 >= yw.s and y1 < yw.s+256)"""


@query("prompts_in_tiles", "select id, wx::integer as x, wy::integer as y from seen", base=(L.DETECTIONS, _W))
def prompts_in_tiles(spark, sf):
    return _in_windows(spark, sf).select("id", "window.x", "window.y")


@query(
    "core_ownership",
    """, e as (select *, (x0+x1)/2 as cx, (y0+y1)/2 as cy from seen)
       select id, wx::integer as x, wy::integer as y from e where cx >= x_lo and cx < x_hi and cy >= y_lo and cy < y_hi""",
    base=(L.DETECTIONS, _W),
)
def core_ownership(spark, sf):
    d = _in_windows(spark, sf)
    d = d.select("id", "label", "score", *[F.col(f"window.{c}").alias(c) for c in ("x", "y", "core_x0", "core_y0", "core_x1", "core_y1")],
                 (F.col("x0") - F.col("window.x")).alias("x0"), (F.col("y0") - F.col("window.y")).alias("y0"),
                 (F.col("x1") - F.col("window.x")).alias("x1"), (F.col("y1") - F.col("window.y")).alias("y1"))
    return T.owned_by_core(d).select("id", "x", "y")


@query("nms_on_ground", _GREEDY.format(part="label", key="label", t=0.5), base=(L.DETECTIONS,), recursive=True)
def nms_on_ground(spark, sf):
    """Suppression after the boxes were placed on the ground by an affine grid (IoU is unchanged)."""
    d = L.detections(spark, sf).withColumns({"x": F.lit(0), "y": F.lit(0)})
    g = T.to_ground(d, R.Grid(200, 200, 3857, 10.0, 0.0, 1000.0, 0.0, -10.0, 5000.0))
    return N.greedy_nms(g, 0.5, ["label"]).select("id")


@query(
    "detection_summary",
    "select label, count(*) as n, min(score) as min_score, max(score) as max_score, min(x0) as minx, min(y0) as miny, max(x1) as maxx, max(y1) as maxy from detections group by 1",
    base=(L.DETECTIONS,),
)
def detection_summary(spark, sf):
    return T.detection_summary(L.detections(spark, sf))


@query(
    "mask_stability",
    """, c as (select vec_id, len(list_filter(embedding, lambda v: v::double*10 > 1)) as hi, len(list_filter(embedding, lambda v: v::double*10 > -1)) as lo from embeddings)
       select vec_id, case when lo > 0 then round(hi/lo, 6) else 0 end as stability from c""".replace(", c as", "with c as", 1),
)
def mask_stability(spark, sf):
    e = L.table(spark, sf, "embeddings")
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 10)
    return e.select("vec_id", F.round(T.stability(v), 6).alias("stability"))


@query(
    "best_masks",
    """, m as (select vec_id//3 as prompt, vec_id as choice, embedding[1]::double as score, embedding as e from embeddings),
       b as (select prompt, arg_max(e, score) as e, max(score) as score from m group by 1),
       c as (select prompt, score, i, e[i+1] as v from b, range(64) t(i))
       select prompt, round(score, 6) as score, min(i%8)::double as x0, min(i//8)::double as y0, max(i%8)::double as x1, max(i//8)::double as y1, count(*)::integer as area_px from c where v > 0 group by 1, 2""".replace(", m as", "with m as", 1),
)
def best_masks(spark, sf):
    v = F.col("embedding").cast("array<double>")
    m = L.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("prompt"), F.col("vec_id").alias("choice"), v.alias("logits"), F.lit(8).alias("w"), F.get(v, F.lit(0)).alias("score"))
    return T.best_masks(m, ["prompt"]).select("prompt", F.round("score", 6).alias("score"), *N.BOX, "area_px")


@query(
    "prompt_grid",
    """select n_nationkey, r*5 + c as prompt, round((c+0.5)*((100+n_nationkey)/5.0::double), 6) as px, round((r+0.5)*(80/5.0::double), 6) as py
       from nation, range(5) t(r), range(5) s(c)""",
)
def prompt_grid(spark, sf):
    t = L.table(spark, sf, "nation").select("n_nationkey")
    g = T.prompt_grid(t, F.lit(100.0) + F.col("n_nationkey"), F.lit(80.0), 5)
    return g.select("n_nationkey", F.col("prompt").cast("long").alias("prompt"), F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query(
    "filter_masks",
    """, m as (select vec_id, embedding[1]::double*5 + 0.5 as score, len(list_filter(embedding, lambda v: v > 0)) as area from embeddings)
       select vec_id from m where score >= 0.6 and area >= 25 and area <= 64*0.55""".replace(", m as", "with m as", 1),
)
def filter_masks(spark, sf):
    v = F.col("embedding").cast("array<double>")
    m = L.table(spark, sf, "embeddings").select(
        "vec_id", (F.get(v, F.lit(0)) * 5 + 0.5).alias("score"), F.lit(1.0).alias("stability"), F.size(F.filter(v, lambda x: x > 0)).alias("area_px"), F.lit(64).alias("tile_area")
    )
    return T.filter_masks(m, 0.6, 0.9, 25, 0.55).select("vec_id")


@query(
    "mask_to_tile",
    """, c as (select vec_id, r, c, embedding[least(greatest(floor((r+0.5)*1.5/4.0)::integer, 0), 7)*8 + least(greatest(floor((c+0.5)*1.5/4.0)::integer, 0), 7) + 1] > 0 as m
         from embeddings, range(20) t(r), range(16) s(c))
       select vec_id, count(*) filter (m) as area, sum(case when m then r*16+c else 0 end)::bigint as mark from c group by 1""".replace(", c as", "with c as", 1),
)
def mask_to_tile(spark, sf):
    e = L.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v > 0).alias("mask"))
    t = T.mask_to_tile(F.col("mask"), F.lit(8), F.lit(1.5), F.lit(20), F.lit(16))
    on = F.filter(F.transform(t, lambda v, i: F.when(v, i)), lambda i: i.isNotNull())
    return e.select("vec_id", F.size(on).cast("long").alias("area"), F.aggregate(on, F.lit(0).cast("long"), lambda a, i: a + i).alias("mark"))


@query(
    "mask_polygons",
    """select vec_id, len(list_filter(embedding, lambda v: v > 0))*2.5::double as area from embeddings""",
)
def mask_polygons(spark, sf):
    """Mask regions traced to polygons; their areas add up to the mask's pixels."""
    e = L.table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v > 0).alias("tile_mask"), F.lit(8).alias("w"),
        (F.col("vec_id") % 25 * 8).cast("int").alias("x"), (F.floor(F.col("vec_id") / 25) * 8).cast("int").alias("y"),
    )
    p = T.mask_polygons(e, "vec_id", emb_grid(spark, sf))
    return p.groupBy("vec_id").agg(F.round(F.sum(G.area(F.col("geom"))) / 0.45 * 2.5, 6).alias("area"))


@query(
    "mask_polygon_ownership",
    "select vec_id from embeddings where len(list_filter(embedding, lambda v: v > 0)) > 0",
)
def mask_polygon_ownership(spark, sf):
    """Every traced region's interior point lies in its own tile's core, so no mask is lost."""
    e = L.table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: v > 0).alias("tile_mask"), F.lit(8).alias("w"),
        (F.col("vec_id") % 25 * 8).cast("int").alias("x"), (F.floor(F.col("vec_id") / 25) * 8).cast("int").alias("y"),
    )
    g = emb_grid(spark, sf)
    p = T.mask_polygons(e, "vec_id", g).join(e.select("vec_id", "x", "y"), "vec_id").withColumns(
        {"core_x0": F.col("x"), "core_y0": F.col("y"), "core_x1": F.col("x") + 8, "core_y1": F.col("y") + 8}
    )
    return T.polygons_owned(p, g).select("vec_id").distinct()


# -- regions and contours -------------------------------------------------

_REGIONS = """cells as (select (vec_id//25) as r, (vec_id%25) as c, label % 3 as v, vec_id as id from embeddings),
walk as (select id as root, id, r, c, v from cells union
  select w.root, n.id, n.r, n.c, n.v from walk w join cells n on n.v = w.v and abs(n.r-w.r) + abs(n.c-w.c) = 1),
comp as (select id, min(root) as comp, any_value(v) as v from walk group by id)"""


@query(
    "polygonize_regions",
    """select ((comp//25)*8)*2147483648::bigint + (comp%25)*8 as region, any_value(v)::double as value, round(count(*)*64*100.0::double, 4) as area, 'Polygon' as kind from comp group by comp""",
    base=(_REGIONS,),
    recursive=True,
)
def polygonize_regions(spark, sf):
    px = L.pixels(spark, sf).select("row", "col", (F.col("label") % 3).alias("value"))
    p = Z.polygonize(px, metric_grid(spark, sf), block=32)
    return p.select("region", "value", F.round(G.area(F.col("geom")), 4).alias("area"), F.col("geom")["type"].alias("kind"))


@query(
    "region_sizes",
    """, side as (select a.id, comp, 32 - 8*(select count(*) from cells x, cells y where x.id = a.id and y.v = x.v and abs(x.r-y.r)+abs(x.c-y.c) = 1) as s from comp a)
       select ((comp//25)*8)*2147483648::bigint + (comp%25)*8 as region, count(*)*64 as pixels, sum(s)::bigint as perimeter from side group by comp""",
    base=(_REGIONS,),
    recursive=True,
)
def region_sizes(spark, sf):
    px = L.pixels(spark, sf).select("row", "col", (F.col("label") % 3).alias("value"))
    return Z.region_sizes(px, block=16).select("region", "pixels", "perimeter")


@query(
    "change_polygons",
    """, b as (select row, col, abs(value)+0.1 as nir, 0.2 as red, abs(value)+0.1 + case when label=0 then 0.3 else 0.0 end as nir2,
         0.2 + case when label=1 then 0.2 else 0.0 end as red2 from pixels),
       c as (select (nir2-red2)/(nir2+red2) - (nir-red)/(nir+red) as change from b)
       select sign(change)::double as value, round(count(*)*100.0::double, 4) as area from c where abs(change) >= 0.15 group by 1""",
    base=(L.PIXELS,),
)
def change_polygons(spark, sf):
    """Two dates compared, changed pixels turned into polygons, areas summed by direction."""
    from .raster_queries import index_change

    ch = index_change(spark, sf).select("row", "col", "value")
    p = Z.polygonize(ch, metric_grid(spark, sf))
    return p.groupBy("value").agg(F.round(F.sum(G.area(F.col("geom"))), 4).alias("area"))


@query(
    "contour_levels",
    """, m as (select min(value) as lo, max(value) as hi from pixels)
       select k::bigint as k, round(0.03 + (ceil((lo-0.03)/0.1)+k)*0.1, 6) as level from m, range(200) t(k) where 0.03 + (ceil((lo-0.03)/0.1)+k)*0.1 <= hi""",
    base=(L.PIXELS,),
)
def contour_levels(spark, sf):
    return Z.contour_levels(L.pixels(spark, sf), 0.1, 0.03).select("k", F.round("level", 6).alias("level"))


_SQUARES = """m as (select min(value) as lo from pixels), q as (select a.row, a.col, a.value as tl, b.value as tr, c.value as bl, d.value as br from pixels a
  join pixels b on b.row = a.row and b.col = a.col+1 join pixels c on c.row = a.row+1 and c.col = a.col join pixels d on d.row = a.row+1 and d.col = a.col+1),
l as (select 0.03 + (ceil((lo-0.03)/0.15)+k)*0.15 as level from m, range(200) t(k)),
s as (select q.*, level, (tl>level)::int + (tr>level)::int*2 + (bl>level)::int*4 + (br>level)::int*8 as cs,
  (level-tl)/(tr-tl) as t, (level-bl)/(br-bl) as b, (level-tl)/(bl-tl) as f, (level-tr)/(br-tr) as g from q join l on level >= least(tl,tr,bl,br) and level < greatest(tl,tr,bl,br)),
len as (select level, case cs when 1 then sqrt(t*t+f*f) when 14 then sqrt(t*t+f*f) when 2 then sqrt((1-t)*(1-t)+g*g) when 13 then sqrt((1-t)*(1-t)+g*g)
  when 4 then sqrt(b*b+(1-f)*(1-f)) when 11 then sqrt(b*b+(1-f)*(1-f)) when 8 then sqrt((1-b)*(1-b)+(1-g)*(1-g)) when 7 then sqrt((1-b)*(1-b)+(1-g)*(1-g))
  when 3 then sqrt(1+(g-f)*(g-f)) when 12 then sqrt(1+(g-f)*(g-f)) when 5 then sqrt(1+(t-b)*(t-b)) when 10 then sqrt(1+(t-b)*(t-b))
  when 6 then sqrt((1-t)*(1-t)+g*g) + sqrt(b*b+(1-f)*(1-f)) when 9 then sqrt(t*t+f*f) + sqrt((1-b)*(1-b)+(1-g)*(1-g)) end as d from s)"""


@query(
    "contour_lines",
    "select round(level, 6) as value, round(sum(d)*10, 3) as length from len group by 1",
    base=(L.PIXELS, _SQUARES),
)
def contour_lines(spark, sf):
    """Contour lines linked across blocks; their length per level equals the squares' total."""
    c = Z.contour(L.pixels(spark, sf), metric_grid(spark, sf), 0.15, 0.03, block=32, missing="edge")
    return c.groupBy(F.round("value", 6).alias("value")).agg(F.round(F.sum(G.length(F.col("geom"))), 3).alias("length"))
