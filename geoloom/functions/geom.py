"""Geometry as Spark columns.

A geometry is one struct column::

    struct<type: string,
           parts: array<struct<rings: array<array<struct<x: double, y: double>>>>>>

Polygons keep the exterior as ring 0 and the holes after it, lines keep one path
per part, points keep one vertex per part.  Every function here returns a
``Column`` built from Spark's array functions, so it stays inside the JVM and is
usable in any select, filter or join condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(XY)
RINGS = T.ArrayType(RING)
PART = T.StructType([T.StructField("rings", T.ArrayType(RING))])
GEOM = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("parts", T.ArrayType(PART))]
)
GEOM_DDL = (
    "struct<type:string,parts:array<struct<rings:array<array<struct<x:double,y:double>>>>>>"
)
SEGMENT_DDL = "array<struct<x1:double,y1:double,x2:double,y2:double>>"

BBOX = ("minx", "miny", "maxx", "maxy")


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def let(value: Column, fn) -> Column:
    """Bind an expression once, so that it is not worked out again at every use."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def bound(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` for costly expressions: each is worked out once a row, whatever later conditions and columns read it."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda acc, v: acc + v)


# -- constructors ---------------------------------------------------------


def xy(x, y) -> Column:
    return F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y"))


def make(kind: Column | str, parts: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("type"), parts.alias("parts"))


def part(*rings: Column) -> Column:
    return F.struct(F.array(*rings).alias("rings"))


def point(x, y) -> Column:
    return make("Point", F.array(part(F.array(xy(x, y)))))


def box(minx, miny, maxx, maxy) -> Column:
    """A rectangle, counter-clockwise from its lower right corner."""
    a, b, c, d = (as_col(v) for v in (minx, miny, maxx, maxy))
    return make("Polygon", F.array(part(F.array(xy(c, b), xy(c, d), xy(a, d), xy(a, b), xy(c, b)))))


def polygon(*rings: Column) -> Column:
    return make("Polygon", F.array(part(*rings)))


def line(path: Column) -> Column:
    return make("LineString", F.array(part(path)))


def from_geojson(geometry: Column) -> Column:
    """GeoJSON geometry text to a geometry; an unknown type or bad text gives NULL."""
    kind = F.get_json_object(geometry, "$.type")
    text = F.get_json_object(geometry, "$.coordinates")

    def parsed(depth: int) -> Column:
        return F.from_json(text, "array<" * depth + "double" + ">" * depth)

    def vertex(c: Column) -> Column:
        return xy(F.get(c, F.lit(0)), F.get(c, F.lit(1)))

    def path(c: Column) -> Column:
        return F.transform(c, vertex)

    def rings(c: Column) -> Column:
        return F.struct(F.transform(c, path).alias("rings"))

    def single(c: Column) -> Column:
        return F.struct(F.array(c).alias("rings"))

    parts = (
        F.when(kind == "Point", F.array(single(F.array(vertex(parsed(1))))))
        .when(kind == "MultiPoint", F.transform(parsed(2), lambda v: single(F.array(vertex(v)))))
        .when(kind == "LineString", F.array(single(path(parsed(2)))))
        .when(kind == "MultiLineString", F.transform(parsed(3), lambda p: single(path(p))))
        .when(kind == "Polygon", F.array(rings(parsed(3))))
        .when(kind == "MultiPolygon", F.transform(parsed(4), rings))
    )
    return F.when(parts.isNotNull(), make(kind, parts))


def to_geojson(g: Column) -> Column:
    """A geometry as GeoJSON text."""

    def vertex(v: Column) -> Column:
        return F.array(v["x"], v["y"])

    def path(p: Column) -> Column:
        return F.transform(p, vertex)

    parts, kind = g["parts"], g["type"]
    first = F.get(parts, F.lit(0))["rings"]
    coords = (
        F.when(kind == "Point", F.to_json(vertex(F.get(F.get(first, F.lit(0)), F.lit(0)))))
        .when(kind == "MultiPoint", F.to_json(F.transform(vertices(g), vertex)))
        .when(kind == "LineString", F.to_json(path(F.get(first, F.lit(0)))))
        .when(kind == "MultiLineString", F.to_json(F.transform(rings_of(g), path)))
        .when(kind == "Polygon", F.to_json(F.transform(first, path)))
        .otherwise(F.to_json(F.transform(parts, lambda p: F.transform(p["rings"], path))))
    )
    return F.when(
        g.isNotNull(),
        F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), coords, F.lit("}")),
    )


# -- accessors ------------------------------------------------------------


def rings_of(g: Column) -> Column:
    """Every ring or path of a geometry."""
    return F.flatten(g["parts"]["rings"])


def vertices(g: Column) -> Column:
    return F.flatten(rings_of(g))


def path_segments(path: Column) -> Column:
    n = F.greatest(F.size(path) - 1, F.lit(0))
    return F.zip_with(
        F.slice(path, F.lit(1), n),
        F.slice(path, F.lit(2), n),
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )


def segments(g: Column) -> Column:
    return F.flatten(F.transform(rings_of(g), path_segments))


def is_empty(g: Column) -> Column:
    """True for NULL and for a geometry without vertices."""
    return g.isNull() | (F.coalesce(F.size(vertices(g)), F.lit(0)) <= 0)


def is_polygonal(g: Column) -> Column:
    return g["type"].isin("Polygon", "MultiPolygon")


def is_linear(g: Column) -> Column:
    return g["type"].isin("LineString", "MultiLineString")


def bbox(g: Column) -> dict[str, Column]:
    v = vertices(g)
    return {
        "minx": F.array_min(v["x"]),
        "miny": F.array_min(v["y"]),
        "maxx": F.array_max(v["x"]),
        "maxy": F.array_max(v["y"]),
    }


def with_bbox(df: DataFrame, geom: str = "geom", prefix: str = "") -> DataFrame:
    """Add the four bounding-box columns unless the table already carries them."""
    if all(f"{prefix}{k}" in df.columns for k in BBOX):
        return df
    sides = {"minx": ("array_min", "x"), "miny": ("array_min", "y"), "maxx": ("array_max", "x"), "maxy": ("array_max", "y")}
    return df.withColumns(
        {f"{prefix}{k}": F.expr(f"{fn}(flatten(flatten({geom}.parts.rings)).{c})") for k, (fn, c) in sides.items()}
    )


# -- measures -------------------------------------------------------------


def path_length(path: Column) -> Column:
    return F.aggregate(
        path_segments(path),
        F.lit(0.0),
        lambda acc, s: acc + F.hypot(s["x2"] - s["x1"], s["y2"] - s["y1"]),
    )


def length(g: Column) -> Column:
    return F.aggregate(
        segments(g),
        F.lit(0.0),
        lambda acc, s: acc + F.hypot(s["x2"] - s["x1"], s["y2"] - s["y1"]),
    )


def signed_area(path: Column) -> Column:
    """Shoelace area of a closed path, taken about its first vertex."""
    o = F.get(path, F.lit(0))
    return F.aggregate(
        path_segments(path),
        F.lit(0.0),
        lambda acc, s: acc
        + (s["x1"] - o["x"]) * (s["y2"] - o["y"])
        - (s["x2"] - o["x"]) * (s["y1"] - o["y"]),
    ) / F.lit(2.0)


def area(g: Column) -> Column:
    def part_area(p: Column) -> Column:
        return F.aggregate(
            F.transform(p["rings"], lambda r, i: F.abs(signed_area(r)) * F.when(i == 0, 1.0).otherwise(-1.0)),
            F.lit(0.0),
            lambda acc, a: acc + a,
        )

    total = F.aggregate(F.transform(g["parts"], part_area), F.lit(0.0), lambda acc, a: acc + a)
    return F.when(is_polygonal(g), total).otherwise(F.lit(0.0))


def _weighted(w: Column, x: Column, y: Column) -> Column:
    return F.struct(w.alias("w"), (w * x).alias("wx"), (w * y).alias("wy"))


def _balance(terms: Column, o: Column) -> Column:
    """The weighted mean position of terms taken about ``o``; NULL without weight."""
    summed = F.struct(total(terms["w"]).alias("w"), total(terms["wx"]).alias("wx"), total(terms["wy"]).alias("wy"))
    return let(summed, lambda m: F.when(m["w"] > 0, xy(o["x"] + m["wx"] / m["w"], o["y"] + m["wy"] / m["w"])))


def _ring_terms(ring: Column, sign: Column, o: Column) -> Column:
    """A ring's triangles about ``o``, signed so that the ring's area is positive times ``sign``."""

    def term(s: Column) -> Column:
        cross = (s["x1"] - o["x"]) * (s["y2"] - o["y"]) - (s["x2"] - o["x"]) * (s["y1"] - o["y"])
        return let(
            cross, lambda c: _weighted(c, (s["x1"] + s["x2"] - o["x"] * 2) / 3, (s["y1"] + s["y2"] - o["y"] * 2) / 3)
        )

    def orient(terms: Column) -> Column:
        return let(
            F.signum(total(terms["w"])) * sign,
            lambda k: F.transform(
                terms, lambda t: F.struct((t["w"] * k).alias("w"), (t["wx"] * k).alias("wx"), (t["wy"] * k).alias("wy"))
            ),
        )

    return let(F.transform(path_segments(ring), term), orient)


def centroid(g: Column) -> Column:
    """Area centroid of polygons, length centroid of lines, mean of points."""

    def about(o: Column) -> Column:
        triangles = F.flatten(
            F.transform(
                g["parts"],
                lambda p: F.flatten(
                    F.transform(p["rings"], lambda r, i: _ring_terms(r, F.when(i == 0, 1.0).otherwise(-1.0), o))
                ),
            )
        )
        edges = F.transform(
            segments(g),
            lambda s: _weighted(
                F.hypot(s["x2"] - s["x1"], s["y2"] - s["y1"]),
                (s["x1"] + s["x2"]) / 2 - o["x"], (s["y1"] + s["y2"]) / 2 - o["y"],
            ),
        )
        corners = F.transform(vertices(g), lambda v: _weighted(F.lit(1.0), v["x"] - o["x"], v["y"] - o["y"]))
        return F.coalesce(
            F.when(is_polygonal(g), _balance(triangles, o)),
            F.when(is_polygonal(g) | is_linear(g), _balance(edges, o)),
            _balance(corners, o),
        )

    c = let(F.get(vertices(g), F.lit(0)), about)
    return F.when(~is_empty(g), let(c, lambda v: point(v["x"], v["y"])))


def map_vertices(g: Column, fn) -> Column:
    """Apply ``fn(x, y) -> (x, y)`` to every vertex."""

    def moved(v: Column) -> Column:
        x, y = fn(v["x"], v["y"])
        return xy(x, y)

    parts = F.transform(
        g["parts"],
        lambda p: F.struct(F.transform(p["rings"], lambda r: F.transform(r, moved)).alias("rings")),
    )
    return F.when(g.isNotNull(), make(g["type"], parts))
