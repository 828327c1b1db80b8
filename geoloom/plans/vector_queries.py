"""Queries over vector layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geom as G
from ..operators import joins as J
from ..operators import vector as V
from . import layers as L
from .registry import query

FLAT = ("minx", "miny", "maxx", "maxy")


def rounded(*names, places=6):
    return [F.round(F.col(n), places).alias(n) for n in names]


@query(
    "points_in_zones",
    """select n_nationkey, n_name, count(c_custkey) as n_points, round(avg(c_acctbal), 4) as avg_acctbal
       from zones left join points on x > w and x < e and y > s and y < n group by 1, 2""",
    base=(L.POINTS, L.ZONES),
)
def points_in_zones(spark, sf):
    """Flagship: points joined within zones, summarised per zone, empty zones kept."""
    zones = L.zones(spark, sf)
    hits = J.spatial_join(L.points(spark, sf), zones, "within").groupBy("n_nationkey").agg(
        F.count(F.lit(1)).alias("n_points"), F.avg("c_acctbal").alias("a")
    )
    return zones.select("n_nationkey", "n_name").join(hits, "n_nationkey", "left").select(
        "n_nationkey", "n_name", F.coalesce("n_points", F.lit(0)).alias("n_points"), F.round("a", 4).alias("avg_acctbal")
    )


@query(
    "layer_summary",
    "select 4326 as srid, count(*) as len, min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy, 'Point' as geom_types from points",
    base=(L.POINTS,),
)
def layer_summary(spark, sf):
    return V.read_summary(L.points(spark, sf)).select(
        "srid", "len", *FLAT, F.array_join("geom_types", ",").alias("geom_types")
    )


@query(
    "list_layers",
    """select 'boxes' as layer, 'Polygon' as geometry_type, count(*) as features from supplier
       union all select 'points', 'Point', count(*) from customer
       union all select 'zones', 'Polygon', count(*) from nation""",
)
def list_layers(spark, sf):
    container = None
    for name, layer in (("boxes", L.boxes), ("points", L.points), ("zones", L.zones)):
        rows = layer(spark, sf).select(F.lit(name).alias("layer"), "geom")
        container = rows if container is None else container.unionByName(rows)
    return V.list_layers(container)


def _bowties(spark, sf):
    """Supplier boxes; every third one has two corners swapped so that it crosses itself."""
    b = G.with_bbox(L.boxes(spark, sf))
    path = F.array(G.xy("minx", "miny"), G.xy("maxx", "maxy"), G.xy("maxx", "miny"), G.xy("minx", "maxy"), G.xy("minx", "miny"))
    empty = F.struct(F.lit("Polygon").alias("type"), F.array().cast(G.GEOM["parts"].dataType).alias("parts"))
    g = F.when(F.col("s_suppkey") % 3 == 0, G.polygon(path)).when(F.col("s_suppkey") % 10 == 1, empty).otherwise(F.col("geom"))
    return b.withColumn("geom", g).drop(*FLAT)


@query(
    "check_geometry",
    """select count(*) as len, count(*) filter (s_suppkey%3=0) as invalid,
       count(*) filter (s_suppkey%3<>0 and s_suppkey%10=1) as empty, false as valid from supplier""",
)
def check_geometry(spark, sf):
    return V.check_geometry(_bowties(spark, sf))


@query(
    "invalid_details",
    "select s_suppkey, 'Self-intersection' as reason from supplier where s_suppkey%3=0",
)
def invalid_details(spark, sf):
    return V.invalid_details(_bowties(spark, sf), "s_suppkey")


def _flawed(spark, sf):
    """Supplier boxes turned into seven kinds of polygons, by key: five invalid and two valid ones."""
    b = G.with_bbox(L.boxes(spark, sf)).withColumn("k", F.col("s_suppkey") % 7)
    x, y = F.col("minx"), F.col("miny")

    def square(dx: float, dy: float, side: float):
        u, v = x + dx, y + dy
        return F.array(G.xy(u, v), G.xy(u + side, v), G.xy(u + side, v + side), G.xy(u, v + side), G.xy(u, v))

    def shape(*parts):
        made = F.array(*(F.struct(F.array(*p).alias("rings")) for p in parts))
        return G.make(F.lit("Polygon" if len(parts) == 1 else "MultiPolygon"), made)

    bow = F.array(G.xy(x, y), G.xy(x + 8, y + 8), G.xy(x + 8, y), G.xy(x, y + 8), G.xy(x, y))
    shell, hole = square(0, 0, 8), square(1, 1, 4)
    kinds = {
        0: shape([bow]), 1: shape([shell, square(20, 1, 2)]), 2: shape([shell, hole, square(2, 2, 1)]), 3: shape([shell], [square(2, 2, 3)]),
        4: shape([shell], [square(8, 0, 8)]), 5: shape([shell, hole], [square(2, 2, 1)]), 6: shape([shell, hole, square(5, 5, 2)]),
    }
    g = None
    for k, s in kinds.items():
        g = F.when(F.col("k") == k, s) if g is None else g.when(F.col("k") == k, s)
    return b.select("s_suppkey", g.alias("geom"), "srid")


@query(
    "invalid_reasons",
    """select s_suppkey, case s_suppkey % 7 when 0 then 'Self-intersection' when 1 then 'Hole lies outside shell' when 2 then 'Holes are nested'
       when 3 then 'Nested shells' else 'Self-intersection' end as reason from supplier where s_suppkey % 7 < 5""",
)
def invalid_reasons(spark, sf):
    """A crossing, a hole outside its shell, a hole in a hole, a shell in a shell, and parts that share an edge."""
    return V.invalid_details(_flawed(spark, sf), "s_suppkey")


@query(
    "reproject_mercator",
    """select c_custkey, round(radians(x)*6378137.0, 3) as mx,
       round(ln(tan(pi()/4 + radians(y)/2))*6378137.0, 3) as my from points""",
    base=(L.POINTS,),
)
def reproject_mercator(spark, sf):
    p = V.reproject(L.points(spark, sf), "EPSG:3857", srid=4326)
    v = F.get(G.vertices(F.col("geom")), F.lit(0))
    return p.select("c_custkey", F.round(v["x"], 3).alias("mx"), F.round(v["y"], 3).alias("my"))


@query(
    "reproject_utm_round_trip",
    "select c_custkey, round(x, 5) as x, round(y, 5) as y from points",
    base=(L.POINTS,),
)
def reproject_utm_round_trip(spark, sf):
    """Every point to a zone near its own and back; the zones, six degrees wide, are taken six at a time."""
    p = L.points(spark, sf).withColumn("_band", F.least(F.floor((F.col("x") + 180) / 36), F.lit(9)))
    out = None
    for band in range(10):
        code = 32600 + 6 * band + 3
        own = p.where(F.col("_band") == band).select("c_custkey", "geom", "srid")
        back = V.reproject(V.reproject(own, code, srid=4326), 4326, srid=code)
        out = back if out is None else out.unionByName(back)
    v = F.get(G.vertices(F.col("geom")), F.lit(0))
    return out.select("c_custkey", F.round(v["x"], 5).alias("x"), F.round(v["y"], 5).alias("y"))


@query(
    "centroids_metric",
    """select id, round((x0+x1)/2, 6) as cx, round((y0+y1)/2, 6) as cy from detections""",
    base=(L.DETECTIONS,),
)
def centroids_metric(spark, sf):
    c = V.centroids(L.part_boxes(spark, sf), srid=3857)
    v = F.get(G.vertices(F.col("geom")), F.lit(0))
    return c.select("id", F.round(v["x"], 6).alias("cx"), F.round(v["y"], 6).alias("cy"))


@query(
    "measures",
    "select id, round((x1-x0)*(y1-y0), 6) as area, round(2*(x1-x0)+2*(y1-y0), 6) as perimeter from detections",
    base=(L.DETECTIONS,),
)
def measures(spark, sf):
    g = F.col("geom")
    return L.part_boxes(spark, sf).select(
        "id", F.round(G.area(g), 6).alias("area"), F.round(G.length(g), 6).alias("perimeter")
    )


@query(
    "bounding_box",
    "select min(w) as minx, min(s) as miny, max(e) as maxx, max(n) as maxy, (max(e)-min(w))*(max(n)-min(s)) as area from boxes",
    base=(L.BOXES,),
)
def bounding_box(spark, sf):
    return V.bounding_box(L.boxes(spark, sf)).select(*FLAT, G.area(F.col("geom")).alias("area"))


@query(
    "convex_hull",
    """, corners as (select unnest([{'x': w, 'y': s}, {'x': e, 'y': s}, {'x': e, 'y': n}, {'x': w, 'y': n}]) as p from boxes),
       distinct_pts as (select distinct p.x as x, p.y as y from corners),
       dirs as (select 2*pi()*d/720 as t from range(720) r(d)),
       support as (select t, max(x*cos(t) + y*sin(t)) as h from distinct_pts cross join dirs group by t)
       select t, round(h, 6) as support from (select round(t, 6) as t, h from support)""",
    base=(L.BOXES,),
)
def convex_hull(spark, sf):
    """The hull's support function in 720 directions equals that of all the corners."""
    hull = V.convex_hull(L.boxes(spark, sf)).select(F.explode(G.vertices(F.col("geom"))).alias("p"))
    d = F.explode(F.sequence(F.lit(0), F.lit(719))).alias("d")
    t = F.col("d") * 2 * F.pi() / 720
    return hull.select("p", d).groupBy("d").agg(
        F.max(F.col("p.x") * F.cos(t) + F.col("p.y") * F.sin(t)).alias("h")
    ).select(F.round(t, 6).alias("t"), F.round("h", 6).alias("support"))


@query(
    "simplify_collinear",
    "select id, 5 as n, round((x1-x0)*(y1-y0), 6) as area from detections",
    base=(L.DETECTIONS,),
)
def simplify_collinear(spark, sf):
    """Boxes whose edges were cut into quarters come back as five vertices."""
    b = L.dealt(L.part_boxes(spark, sf), "id")
    cuts = F.flatten(
        F.transform(
            G.path_segments(F.get(G.rings_of(F.col("geom")), F.lit(0))),
            lambda s: F.transform(
                F.array(*[F.lit(k / 4) for k in range(4)]),
                lambda t: G.xy(s["x1"] + t * (s["x2"] - s["x1"]), s["y1"] + t * (s["y2"] - s["y1"])),
            ),
        )
    )
    dense = b.withColumn("_p", cuts).withColumn("geom", G.polygon(F.concat("_p", F.slice("_p", 1, 1)))).drop("_p")
    s = V.simplify(dense, 0.01)
    return s.select("id", F.size(G.vertices(F.col("geom"))).alias("n"), F.round(G.area(F.col("geom")), 6).alias("area"))


def _regions(spark, sf):
    """Zones gathered into one multipolygon per region."""
    z = L.zones(spark, sf)
    parts = F.array_sort(F.collect_list(F.struct("n_nationkey", F.get(F.col("geom")["parts"], F.lit(0)).alias("p"))))
    return z.groupBy("n_regionkey").agg(parts.alias("a")).select(
        "n_regionkey", G.make("MultiPolygon", F.transform("a", lambda v: v["p"])).alias("geom"), F.lit(4326).alias("srid")
    )


@query(
    "explode_parts",
    """select n_regionkey, (row_number() over (partition by n_regionkey order by n_nationkey) - 1)::integer as part,
       'Polygon' as kind, w as minx, s as miny, e as maxx, n as maxy from zones""",
    base=(L.ZONES,),
)
def explode_parts(spark, sf):
    e = G.with_bbox(V.explode(_regions(spark, sf)))
    return e.select("n_regionkey", "part", F.col("geom")["type"].alias("kind"), *FLAT)


@query(
    "extract_lines",
    "select n_regionkey, count(*) as n_lines, round(sum(2*(e-w)+2*(n-s)), 6) as total from zones group by 1",
    base=(L.ZONES,),
)
def extract_lines(spark, sf):
    lines = V.lines_of(_regions(spark, sf))
    return lines.groupBy("n_regionkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(G.length(F.col("geom"))), 6).alias("total")
    )


@query(
    "points_along",
    """select id, count(*) as n, round(sum(px), 4) as sx, round(sum(py), 4) as sy from (
         select id, case when d < h then x1 when d < h+w then x1-(d-h) when d < 2*h+w then x0 else x0+(d-2*h-w) end as px,
                case when d < h then y0+d when d < h+w then y1 when d < 2*h+w then y1-(d-h-w) else y0 end as py
         from (select *, x1-x0 as w, y1-y0 as h, unnest(range(0, ((2*(x1-x0)+2*(y1-y0))/1.5)::bigint + 2))*1.5::double as d from detections)
         where d <= 2*w+2*h) group by id""",
    base=(L.DETECTIONS,),
)
def points_along(spark, sf):
    p = V.points_along(L.part_boxes(spark, sf), 1.5)
    v = F.get(G.vertices(F.col("geom")), F.lit(0))
    return p.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(v["x"]), 4).alias("sx"), F.round(F.sum(v["y"]), 4).alias("sy")
    )


@query(
    "grid_rectangle",
    """, b as (select min(x) as w, min(y) as s, max(x) as e, max(y) as n from points),
       c as (select unnest(range(0, ceil((e-w)/7.0)::bigint)) as col_id, * from b),
       r as (select unnest(range(0, ceil((n-s)/5.0)::bigint)) as row_id, * from c)
       select col_id, row_id, round(w+col_id*7.0, 6) as minx, round(s+row_id*5.0, 6) as miny,
       round(least(w+(col_id+1)*7.0, e), 6) as maxx, round(least(s+(row_id+1)*5.0, n), 6) as maxy from r""",
    base=(L.POINTS,),
)
def grid_rectangle(spark, sf):
    g = V.grid(spark, V.extent(L.points(spark, sf)), 7.0, 5.0)
    return g.select("col_id", "row_id", *rounded(*FLAT))


@query(
    "grid_hexagon",
    """, b as (select min(x) as w, min(y) as s, max(x) as e, max(y) as n from points),
       c as (select unnest(range(0, ceil((e-w)/7.5)::bigint + 1)) as col_id, * from b),
       r as (select unnest(range(0, ceil((n-s)/(sqrt(3.0)*5))::bigint + 1)) as row_id, * from c),
       k as (select *, w + col_id*7.5 as cx, s + row_id*sqrt(3.0)*5 + case when col_id%2=1 then sqrt(3.0)*2.5 else 0 end as cy from r)
       select col_id, row_id, round(cx, 6) as cx, round(cy, 6) as cy, round(1.5*sqrt(3.0)*25, 6) as area from k
       where cx+5 >= w and cx-5 <= e and cy+sqrt(3.0)*2.5 >= s and cy-sqrt(3.0)*2.5 <= n""",
    base=(L.POINTS,),
)
def grid_hexagon(spark, sf):
    g = V.grid(spark, V.extent(L.points(spark, sf)), 10.0, kind="hexagon")
    return g.select(
        "col_id", "row_id", F.round((F.col("minx") + F.col("maxx")) / 2, 6).alias("cx"),
        F.round((F.col("miny") + F.col("maxy")) / 2, 6).alias("cy"), F.round(G.area(F.col("geom")), 6).alias("area"),
    )


_SELECTIONS = {
    "eq": ("n_name", "NATION_7", "n_name = 'NATION_7'"),
    "neq": ("n_regionkey", "2.0", "n_regionkey <> 2"),
    "gt": ("n_nationkey", "9", "n_nationkey > 9"),
    "gte": ("n_name", "NATION_3", "n_name >= 'NATION_3'"),
    "lt": ("n_nationkey", "1e1", "n_nationkey < 10"),
    "lte": ("n_name", "5", "n_name <= '5'"),
    "contains": ("n_name", "N_1", "contains(n_name, 'N_1')"),
    "starts-with": ("n_name", "NATION_2", "n_name like 'NATION\\_2%' escape '\\'"),
    "is-null": ("tag", None, "n_nationkey % 4 < 2"),
    "is-not-null": ("tag", None, "n_nationkey % 4 >= 2"),
}


def _selection(operator, column, value):
    def run(spark, sf):
        tag = F.when(F.col("n_nationkey") % 4 == 0, F.lit(None)).when(F.col("n_nationkey") % 4 == 1, "").otherwise("t")
        z = L.zones(spark, sf).withColumn("tag", tag)
        return V.select_by_value(z, column, operator, value).select("n_nationkey", "n_name")

    return run


for _op, (_column, _value, _where) in _SELECTIONS.items():
    query(
        "select_value_" + _op.replace("-", "_"),
        f"select n_nationkey, n_name from nation where {_where}",
    )(_selection(_op, _column, _value))


@query(
    "select_value_numeric_text",
    "select event_id, value from events where value > 7.5",
)
def select_value_numeric_text(spark, sf):
    e = L.table(spark, sf, "events").withColumn("text_value", F.col("value").cast("string"))
    return V.select_by_value(e, "text_value", "gt", "7.5").select("event_id", "value")


@query(
    "geojson_bounds",
    "select min(w) as minx, min(s) as miny, max(e) as maxx, max(n) as maxy from boxes",
    base=(L.BOXES,),
)
def geojson_bounds(spark, sf):
    text = L.boxes(spark, sf).select(G.to_geojson(F.col("geom")).alias("j"))
    return V.geojson_bounds(text.select(G.from_geojson(F.col("j")).alias("geom")))


@query(
    "parse_bbox",
    """select s_suppkey, case when s_suppkey%6=0 then 'empty' when s_suppkey%6=1 then 'not four values'
         when s_suppkey%6=2 then 'not a number' when s_suppkey%6=3 then 'out of order'
         when s_suppkey%6=4 then 'longitude out of range' end as reason,
       case when s_suppkey%6=5 then 1.5::double end as west, case when s_suppkey%6=5 then -20.0::double end as south,
       case when s_suppkey%6=5 then 3.0::double end as east, case when s_suppkey%6=5 then (s_suppkey%90)::double end as north from supplier""",
)
def parse_bbox(spark, sf):
    k = F.col("s_suppkey")
    text = (
        F.when(k % 6 == 0, "").when(k % 6 == 1, "1,2,3").when(k % 6 == 2, "1,2,x,4")
        .when(k % 6 == 3, "3, 1, 2, 5").when(k % 6 == 4, "-190,1,2,5")
        .otherwise(F.concat(F.lit("1.5, -20, 3e0, "), (k % 90).cast("string")))
    )
    aoi = L.table(spark, sf, "supplier").select("s_suppkey", text.alias("aoi"))
    return V.parse_bbox(aoi, "aoi").select("s_suppkey", "reason", "west", "south", "east", "north")


@query(
    "point_density",
    """, c as (select floor(x/10)::bigint as cx, floor(y/10)::bigint as cy, count(*)::double as w from points group by 1, 2),
       o as (select dx, dy from (select unnest(range(-2, 3)) as dx), (select unnest(range(-2, 3)) as dy) where dx*dx+dy*dy <= 4)
       select cx+dx as cx, cy+dy as cy, round(sum(w)*0.5, 6) as density from c, o group by 1, 2""",
    base=(L.POINTS,),
)
def point_density(spark, sf):
    return V.point_density(L.points(spark, sf), 10.0, 2, 0.5).select("cx", "cy", F.round("density", 6).alias("density"))


@query(
    "class_breaks_quantile",
    """select class_id::integer as class_id, round(q[class_id+1], 6) as low, round(q[class_id+2], 6) as high from (
       select q, unnest(range(0, 5)) as class_id from (select quantile_cont(c_acctbal, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) as q from customer))""",
)
def class_breaks_quantile(spark, sf):
    return V.class_breaks(L.points(spark, sf), "c_acctbal", 5).select("class_id", *rounded("low", "high"))


@query(
    "class_breaks_equal_interval",
    """select class_id::integer as class_id, round(lo+(hi-lo)*class_id/4, 6) as low, round(lo+(hi-lo)*(class_id+1)/4, 6) as high from (
       select lo, hi, unnest(range(0, 4)) as class_id from (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer))""",
)
def class_breaks_equal(spark, sf):
    return V.class_breaks(L.points(spark, sf), "c_acctbal", 4, "equal-interval").select("class_id", *rounded("low", "high"))


@query(
    "classify_equal_interval",
    """select class_id, count(*) as n from (select least(floor((c_acctbal-lo)/((hi-lo)/4)), 3)::integer as class_id from customer,
       (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer)) group by 1""",
)
def classify_equal(spark, sf):
    return V.classify(L.points(spark, sf), "c_acctbal", 4, "equal-interval").groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "drawn_summary",
    """select 'Point' as kind, count(*) as n, min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy from points
       union all select 'Polygon', count(*), min(w), min(s), max(e), max(n) from boxes
       union all select 'all', (select count(*) from points) + (select count(*) from boxes),
         least((select min(x) from points), min(w)), least((select min(y) from points), min(s)),
         greatest((select max(x) from points), max(e)), greatest((select max(y) from points), max(n)) from boxes""",
    base=(L.POINTS, L.BOXES),
)
def drawn_summary(spark, sf):
    both = L.points(spark, sf).select("geom").unionByName(L.boxes(spark, sf).select("geom"))
    return V.drawn_summary(both)


# -- joins ----------------------------------------------------------------


@query(
    "spatial_join_intersects",
    """select a.s_suppkey as s_suppkey, b.n_nationkey as n_nationkey from boxes a join zones b
       on a.w <= b.e and a.e >= b.w and a.s <= b.n and a.n >= b.s""",
    base=(L.BOXES, L.ZONES),
)
def spatial_join_intersects(spark, sf):
    return J.spatial_join(L.boxes(spark, sf), L.zones(spark, sf)).select("s_suppkey", "n_nationkey")


@query(
    "spatial_join_within",
    """select a.s_suppkey as s_suppkey, b.n_nationkey as n_nationkey from boxes a join zones b
       on a.w >= b.w and a.e <= b.e and a.s >= b.s and a.n <= b.n""",
    base=(L.BOXES, L.ZONES),
)
def spatial_join_within(spark, sf):
    return J.spatial_join(L.boxes(spark, sf), L.zones(spark, sf), "within").select("s_suppkey", "n_nationkey")


@query(
    "spatial_join_contains",
    "select n_nationkey, c_custkey from zones join points on x > w and x < e and y > s and y < n",
    base=(L.POINTS, L.ZONES),
)
def spatial_join_contains(spark, sf):
    return J.spatial_join(L.zones(spark, sf), L.points(spark, sf), "contains").select("n_nationkey", "c_custkey")


@query(
    "spatial_join_left",
    """select c_custkey, n_nationkey from points left join zones on x >= w and x <= e and y >= s and y <= n""",
    base=(L.POINTS, L.ZONES),
)
def spatial_join_left(spark, sf):
    return J.spatial_join(L.points(spark, sf), L.zones(spark, sf), how="left", key="c_custkey").select("c_custkey", "n_nationkey")


@query(
    "spatial_join_suffixes",
    """select a.id as id_left, b.id as id_right, a.label as label_left, b.label as label_right from detections a join detections b
       on a.x0 <= b.x1 and a.x1 >= b.x0 and a.y0 <= b.y1 and a.y1 >= b.y0 where a.id < b.id""",
    base=(L.DETECTIONS,),
)
def spatial_join_self(spark, sf):
    b = L.part_boxes(spark, sf).select("id", "label", "geom", "srid")
    return J.spatial_join(b, b, srids=(3857, 3857), repeats=True).where("id_left < id_right").select("id_left", "id_right", "label_left", "label_right")


@query(
    "spatial_join_aligned_crs",
    "select c_custkey, n_nationkey from points join zones on x+0.03 > w and x+0.03 < e and y+0.03 > s and y+0.03 < n",
    base=(L.POINTS, L.ZONES),
)
def spatial_join_aligned(spark, sf):
    """Mercator zones are brought to the points' longitude/latitude before the test."""
    z = V.reproject(L.zones(spark, sf), 3857, srid=4326)
    p = L.points(spark, sf).withColumn("geom", G.point(F.col("x") + 0.03, F.col("y") + 0.03))
    return J.spatial_join(p, z, "within", srids=(4326, 3857)).select("c_custkey", "n_nationkey")


@query(
    "attribute_join",
    """select c_custkey, c_nationkey, n_nationkey, n_name from (select *, case when c_custkey%9=0 then null else c_nationkey end as k from customer) c
       left join (select n_nationkey, n_name, case when n_nationkey=3 then null else n_nationkey end as k from nation) n
       on c.k is not distinct from n.k""",
)
def attribute_join(spark, sf):
    c = L.table(spark, sf, "customer").withColumn("k", F.when(F.col("c_custkey") % 9 != 0, F.col("c_nationkey")))
    n = L.table(spark, sf, "nation").withColumn("k", F.when(F.col("n_nationkey") != 3, F.col("n_nationkey")))
    return J.attribute_join(c, n, "k", columns=["n_nationkey", "n_name"]).select("c_custkey", "c_nationkey", "n_nationkey", "n_name")


@query(
    "bbox_overlap_unknown_passes",
    "select id from items where not has_box or (west <= 40 and west + 1 + k%3 >= -10 and south <= 60 and south + 1 + k%2 >= 30)",
    base=(L.SCENES,),
)
def bbox_overlap_unknown(spark, sf):
    s = L.scene_items(spark, sf)
    return s.where(J.bbox_overlaps(F.col("bbox"), [-10, 30, 40, 60])).select("id")
