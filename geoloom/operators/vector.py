"""Single-layer vector operators.

A layer is a DataFrame of attribute columns plus ``geom`` (see ``functions.geom``)
and ``srid``.  Operators return lazy DataFrames unless the docstring says that one
small aggregate (an extent, a CRS code) is read first.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs as C
from ..functions import geom as G
from ..functions import predicates as P
from ..session import measure, one_of, require_columns
from .percentiles import group_percentiles
from .validity import with_reasons

STATISTICS = ("count", "sum", "mean", "min", "max", "median")
VALUE_OPERATORS = (
    "eq", "neq", "gt", "gte", "lt", "lte", "contains", "starts-with", "is-null", "is-not-null",
)


def extent(df: DataFrame, geom: str = "geom") -> tuple[float, float, float, float]:
    """The layer's bounds, read with one aggregate; an undefined extent is refused."""
    row = df.agg(*bounds_aggregates(geom)).first()
    if row[0] is None:
        raise ValueError("the layer has no valid geometry to measure")
    return tuple(row)


def bounds_aggregates(geom: str = "geom") -> list[Column]:
    b = G.bbox(F.col(geom))
    return [
        F.min(b["minx"]).alias("minx"), F.min(b["miny"]).alias("miny"),
        F.max(b["maxx"]).alias("maxx"), F.max(b["maxy"]).alias("maxy"),
    ]


# -- inspection -----------------------------------------------------------


def read_summary(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One row: CRS, columns, feature count, bounds and geometry types."""
    if geom not in df.columns:
        raise ValueError("no geometry column, so this is a table rather than a layer")
    return df.agg(
        F.max("srid").alias("srid"),
        F.count(F.lit(1)).alias("len"),
        *bounds_aggregates(geom),
        F.array_sort(F.collect_set(F.col(geom)["type"])).alias("geom_types"),
    ).withColumn("columns", F.lit(df.columns))


def list_layers(df: DataFrame, layer: str = "layer", geom: str = "geom") -> DataFrame:
    """The layers of a container table with geometry type and feature count."""
    kinds = F.array_sort(F.collect_set(F.col(geom)["type"]))
    return df.groupBy(layer).agg(
        F.when(F.size(kinds) <= 1, F.get(kinds, F.lit(0))).otherwise("Unknown").alias("geometry_type"),
        F.count(F.lit(1)).alias("features"),
    )


def with_validity(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Add ``empty`` and ``reason`` (NULL when the geometry is valid)."""
    return with_reasons(df, geom).withColumn("empty", G.is_empty(F.col(geom)))


def check_geometry(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One row: len, invalid, empty, valid."""
    checked = with_validity(df, geom)
    return checked.agg(
        F.count(F.lit(1)).alias("len"),
        F.count("reason").alias("invalid"),
        F.count_if(F.col("empty")).alias("empty"),
        F.coalesce(F.bool_and(F.col("reason").isNull() & ~F.col("empty")), F.lit(True)).alias("valid"),
    )


def invalid_details(df: DataFrame, order: str, geom: str = "geom", limit: int | None = None) -> DataFrame:
    """The invalid features by ``order`` with their reasons; with ``limit``, the first ones."""
    bad = with_validity(df, geom).where(F.col("reason").isNotNull())
    rows = bad.select(order, "reason").orderBy(order)
    return rows if limit is None else rows.limit(limit)


def drawn_features(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Per feature bounding box and centre; empty features are skipped."""
    kept = df.where(~G.is_empty(F.col(geom)))
    with_box = G.with_bbox(kept, geom)
    return with_box.withColumns(
        {
            "kind": F.col(geom)["type"],
            "cx": (F.col("minx") + F.col("maxx")) / 2,
            "cy": (F.col("miny") + F.col("maxy")) / 2,
        }
    )


def drawn_summary(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Counts and union bounds per geometry type, plus one row ``all``."""
    per = drawn_features(df, geom)
    tagged = per.select(F.explode(F.array(F.col("kind"), F.lit("all"))).alias("kind"), *G.BBOX)
    return (
        tagged.groupBy("kind")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("minx").alias("minx"), F.min("miny").alias("miny"),
            F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
        )
    )


# -- single-layer operators -----------------------------------------------


def reproject(df: DataFrame, dst_crs, geom: str = "geom", srid: int | None = None) -> DataFrame:
    src, dst = C.layer_srid(df, srid), C.parse_code(dst_crs)
    return df.withColumns(
        {geom: C.transform_geom(F.col(geom), src, dst), "srid": F.lit(dst)}
    ).drop(*G.BBOX)


def centroids(df: DataFrame, geom: str = "geom", srid: int | None = None) -> DataFrame:
    """Each feature's centroid, worked out in a metric CRS."""
    src, metric = C.metric_srid(df, geom, srid)
    g = G.centroid(C.transform_geom(F.col(geom), src, metric))
    moved = df.withColumn(geom, g).drop(*G.BBOX)
    return moved.withColumn(geom, C.transform_geom(F.col(geom), metric, src))


def bounding_box(df: DataFrame, geom: str = "geom") -> DataFrame:
    b = df.agg(F.max("srid").alias("srid"), *bounds_aggregates(geom))
    b = b.where(F.col("minx").isNotNull())
    return b.withColumn("geom", G.box("minx", "miny", "maxx", "maxy"))


def hull_points(xs: np.ndarray, ys: np.ndarray) -> list[int]:
    """Indices of the convex hull, counter-clockwise (monotone chain)."""
    order = np.lexsort((ys, xs))
    pts = [(xs[i], ys[i], i) for i in order]

    def half(points):
        out = []
        for p in points:
            while len(out) >= 2 and (
                (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])
            ) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = half(pts), half(pts[::-1])
    ring = lower[:-1] + upper[:-1]
    return [int(p[2]) for p in (ring or pts[:1])]


def convex_hull(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One hull around every vertex of the layer.

    Each partition keeps only its own hull, a few thousand buckets of those are
    reduced again, and the last step sees the hull vertices of the buckets alone.
    """
    pts = df.select(F.explode(G.vertices(F.col(geom))).alias("p")).select("p.x", "p.y").where("x is not null")

    def local(batches):
        kept = pd.DataFrame({"x": pd.Series(dtype=float), "y": pd.Series(dtype=float)})
        for batch in batches:
            both = pd.concat([kept, batch], ignore_index=True)
            kept = both.iloc[hull_points(both["x"].to_numpy(), both["y"].to_numpy())]
        yield kept

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[hull_points(pdf["x"].to_numpy(), pdf["y"].to_numpy())][["x", "y"]]

    partial = pts.mapInPandas(local, "x double, y double")
    partial = partial.groupBy((F.spark_partition_id() % 64).alias("b")).applyInPandas(
        lambda pdf: merge(pdf), "x double, y double"
    )

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = merge(pdf)
        return pd.DataFrame({"xs": [ring["x"].tolist()], "ys": [ring["y"].tolist()]})

    hull = partial.groupBy().applyInPandas(finish, "xs array<double>, ys array<double>")
    path = F.zip_with("xs", "ys", lambda x, y: G.xy(x, y))
    closed = F.concat(path, F.slice(path, 1, 1))
    n = F.size("xs")
    shape = (
        F.when(n >= 3, G.polygon(closed)).when(n == 2, G.line(path)).otherwise(
            G.point(F.get(F.col("xs"), F.lit(0)), F.get(F.col("ys"), F.lit(0)))
        )
    )
    return hull.where(n > 0).select(shape.alias("geom"))


def _keep_flags(xs: np.ndarray, ys: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker flags of one path, both ends always kept."""
    keep = np.zeros(len(xs), dtype=bool)
    if len(xs) == 0:
        return keep
    keep[0] = keep[-1] = True
    stack = [(0, len(xs) - 1)]
    while stack:
        i, j = stack.pop()
        if j - i < 2:
            continue
        dx, dy = xs[j] - xs[i], ys[j] - ys[i]
        px, py = xs[i + 1 : j] - xs[i], ys[i + 1 : j] - ys[i]
        norm = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / norm, 0, 1) if norm > 0 else np.zeros(len(px))
        d = np.hypot(px - t * dx, py - t * dy)
        k = int(np.argmax(d))
        if d[k] > tolerance:
            keep[i + 1 + k] = True
            stack += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep


def simplify(
    df: DataFrame, tolerance: float = 0.001, preserve_topology: bool = True, geom: str = "geom"
) -> DataFrame:
    """Drop vertices by Douglas-Peucker, tolerance in layer units.

    With ``preserve_topology`` a ring that would collapse keeps its vertices, and a
    valid geometry that would become invalid is left as it was.
    """
    measure("tolerance", tolerance)

    @F.pandas_udf("array<array<boolean>>")
    def flags(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if a is None else [
                    _keep_flags(np.asarray(x, float), np.asarray(y, float), tolerance).tolist()
                    for x, y in zip(a, b)
                ]
                for a, b in zip(xs, ys)
            ]
        )

    g = F.col(geom)
    rings = G.rings_of(g)
    kept = df.withColumn(
        "_keep",
        flags(
            F.transform(rings, lambda r: r["x"]), F.transform(rings, lambda r: r["y"])
        ),
    )
    least = F.when(G.is_polygonal(g), 4).otherwise(2)

    def shorten(ring: Column, index: Column) -> Column:
        short = F.filter(ring, lambda v, j: F.get(F.get(F.col("_keep"), index), j))
        fits = F.size(short) >= least
        return F.when(fits, short).otherwise(ring if preserve_topology else F.array().cast(G.RING))

    def part(p: Column, k: Column) -> Column:
        before = F.aggregate(
            F.slice(g["parts"], F.lit(1), k), F.lit(0), lambda acc, q: acc + F.size(q["rings"])
        )
        return F.struct(
            F.filter(F.transform(p["rings"], lambda r, i: shorten(r, before + i)), lambda r: F.size(r) > 0).alias("rings")
        )

    parts = F.transform(g["parts"], part)
    if not preserve_topology:
        parts = F.filter(parts, lambda p: F.size(p["rings"]) > 0)
    fine = ~g["type"].isin("Point", "MultiPoint")
    short = F.when(fine, G.make(g["type"], parts)).otherwise(g)
    out = kept.withColumn("_short", short)
    if preserve_topology:
        broke = F.expr(f"({P.invalid_reason('_short')}) is not null and ({P.invalid_reason(geom)}) is null")
        out = out.withColumn("_short", F.when(broke, g).otherwise(F.col("_short")))
    return out.withColumn(geom, F.col("_short")).drop("_short", "_keep", *G.BBOX)


def explode(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One row per part, attributes repeated; ``part`` is the part's position."""
    single = F.regexp_replace(F.col("_g")["type"], "^Multi", "")
    rows = df.withColumnRenamed(geom, "_g")
    rest = [c for c in rows.columns if c != "_g" and c not in G.BBOX]
    out = rows.select(*rest, "_g", F.posexplode_outer(F.col("_g")["parts"]).alias("part", "_p"))
    g = F.when(F.col("_p").isNotNull(), G.make(single, F.array(F.col("_p")))).otherwise(F.col("_g"))
    return out.select(*rest, "part", g.alias(geom))


def lines_of(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Lines themselves and every ring of polygons, one row each; points give none."""
    g = F.col(geom)
    useful = df.where(G.is_linear(g) | G.is_polygonal(g))
    rest = [c for c in df.columns if c != geom and c not in G.BBOX]
    out = useful.select(*rest, F.posexplode(G.rings_of(g)).alias("line", "_path"))
    return out.withColumn(geom, G.line(F.col("_path"))).drop("_path")


def points_along(
    df: DataFrame, interval: float, geom: str = "geom", max_points: int | None = None
) -> DataFrame:
    """Points at 0, i, 2i, ... along lines and all polygon rings, attributes carried.

    ``max_points`` reads one aggregate first and refuses a denser result.
    """
    measure("interval", interval, above_zero=True)
    if max_points is not None:
        total = lines_of(df, geom).agg(F.sum(G.length(F.col(geom)))).first()[0] or 0.0
        if total / interval + 1 > max_points:
            raise ValueError(f"interval {interval} would place more than {max_points} points")
    @F.pandas_udf("array<double>")
    def running(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda v: np.cumsum(v))

    rest = [c for c in df.columns if c != geom and c not in G.BBOX]
    lines = lines_of(df, geom).withColumn("_segs", G.segments(F.col(geom)))
    lines = lines.withColumn(
        "_ends",
        running(F.transform("_segs", lambda s: F.hypot(s["x2"] - s["x1"], s["y2"] - s["y1"]))),
    )
    segs = lines.select(
        *rest, "line", "_ends", F.size("_segs").alias("_n"), F.posexplode("_segs").alias("_i", "_s")
    ).withColumns(
        {
            "_end": F.get("_ends", F.col("_i")),
            "_start": F.coalesce(F.get("_ends", F.col("_i") - 1), F.lit(0.0)),
            "_last": F.col("_i") == F.col("_n") - 1,
        }
    )
    segs = segs.withColumn("_d", F.hypot(F.col("_s.x2") - F.col("_s.x1"), F.col("_s.y2") - F.col("_s.y1")))
    first = F.ceil(F.col("_start") / interval).cast("long")
    last = F.when(F.col("_last"), F.floor(F.col("_end") / interval)).otherwise(
        F.ceil(F.col("_end") / interval) - 1
    ).cast("long")
    steps = F.when(first <= last, F.sequence(first, last))
    placed = segs.select(*rest, "line", "_s", "_start", "_d", F.explode(steps).alias("k"))
    t = F.when(F.col("_d") > 0, (F.col("k") * F.lit(float(interval)) - F.col("_start")) / F.col("_d")).otherwise(0.0)
    x = F.col("_s.x1") + t * (F.col("_s.x2") - F.col("_s.x1"))
    y = F.col("_s.y1") + t * (F.col("_s.y2") - F.col("_s.y1"))
    return placed.select(*rest, "line", "k", G.point(x, y).alias(geom))


def grid(
    spark: SparkSession,
    bounds,
    cell_width: float,
    cell_height: float | None = None,
    kind: str = "rectangle",
    srid: int = 4326,
    max_cells: int | None = None,
) -> DataFrame:
    """A fishnet or hexagon grid over ``bounds``; cells carry ``col_id`` and ``row_id``.

    Rectangles in the last column and row end at the extent.  Hexagons are
    ``cell_width`` across the corners; those wholly outside are dropped.
    """
    one_of("kind", kind, ("rectangle", "hexagon"))
    measure("cell_width", cell_width, above_zero=True)
    height = measure("cell_height", cell_width if cell_height is None else cell_height, above_zero=True)
    west, south, east, north = map(float, bounds)
    if not (0 < east - west < math.inf and 0 < north - south < math.inf):
        raise ValueError(f"bounds {bounds!r} span no finite area")
    if kind == "rectangle":
        cols, rows = math.ceil((east - west) / cell_width), math.ceil((north - south) / height)
    else:
        r = cell_width / 2
        step_x, step_y = 1.5 * r, math.sqrt(3) * r
        cols, rows = math.ceil((east - west) / step_x) + 1, math.ceil((north - south) / step_y) + 1
    if max_cells is not None and cols * rows > max_cells:
        raise ValueError(f"{cols} columns by {rows} rows are more than max_cells={max_cells}")
    cells = spark.range(cols * rows).select(
        (F.col("id") % cols).alias("col_id"), F.floor(F.col("id") / cols).alias("row_id")
    )
    c, w = F.col("col_id"), F.col("row_id")
    if kind == "rectangle":
        cells = cells.withColumns(
            {
                "minx": F.lit(west) + c * F.lit(float(cell_width)),
                "miny": F.lit(south) + w * F.lit(height),
                "maxx": F.least(F.lit(west) + (c + 1) * F.lit(float(cell_width)), F.lit(east)),
                "maxy": F.least(F.lit(south) + (w + 1) * F.lit(height), F.lit(north)),
            }
        )
        return cells.withColumns({"geom": G.box("minx", "miny", "maxx", "maxy"), "srid": F.lit(srid)})
    cx = F.lit(west) + c * F.lit(step_x)
    cy = F.lit(south) + w * F.lit(step_y) + F.when(c % 2 == 1, F.lit(step_y / 2)).otherwise(F.lit(0.0))
    corner = [(r * math.cos(math.pi / 3 * k), r * math.sin(math.pi / 3 * k)) for k in (0, 1, 2, 3, 4, 5, 0)]
    ring = F.array(*[G.xy(cx + F.lit(x), cy + F.lit(y)) for x, y in corner])
    half = step_y / 2
    cells = cells.withColumns(
        {
            "minx": cx - F.lit(r), "maxx": cx + F.lit(r),
            "miny": cy - F.lit(half), "maxy": cy + F.lit(half),
            "geom": G.polygon(ring), "srid": F.lit(srid),
        }
    )
    return cells.where(
        (F.col("maxx") >= west) & (F.col("minx") <= east) & (F.col("maxy") >= south) & (F.col("miny") <= north)
    )


# -- selection and classification -----------------------------------------


def as_number(text: Column) -> Column:
    """Text as a finite double, NULL when it is not a plain decimal number."""
    plain = text.rlike(r"^\s*[-+]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][-+]?\d+(_\d+)*)?\s*$")
    value = F.regexp_replace(F.trim(text), "_", "").try_cast("double")
    finite = F.abs(value) != F.lit(float("inf"))
    return F.when(plain & finite, value)


def is_blank(column: Column, data_type: str) -> Column:
    blank = column.isNull() | (column.cast("string") == "")
    return blank | F.isnan(column) if data_type in ("double", "float") else blank


def select_by_value(df: DataFrame, column: str, operator: str, value=None) -> DataFrame:
    """Keep the rows whose cell satisfies ``operator`` against the text ``value``.

    Comparison is numeric when both sides are finite numbers and textual otherwise;
    an empty cell matches ``is-null`` alone.
    """
    require_columns(df, [column])
    cell = F.col(column)
    empty = is_blank(cell, dict(df.dtypes)[column])
    on_emptiness = {"is-null": empty, "is-not-null": ~empty}
    if one_of("operator", operator, VALUE_OPERATORS) in on_emptiness:
        return df.where(on_emptiness[operator])
    if value is None:
        raise ValueError(f"there is no value to test {column!r} with by {operator}")
    text, raw = cell.cast("string"), F.lit(str(value))
    left, right = as_number(text), as_number(raw)
    numeric = left.isNotNull() & right.isNotNull()

    def compare(op) -> Column:
        return F.when(numeric, op(left, right)).otherwise(op(text, raw))

    test = {
        "eq": lambda: compare(lambda a, b: a == b),
        "neq": lambda: compare(lambda a, b: a != b),
        "gt": lambda: compare(lambda a, b: a > b),
        "gte": lambda: compare(lambda a, b: a >= b),
        "lt": lambda: compare(lambda a, b: a < b),
        "lte": lambda: compare(lambda a, b: a <= b),
        "contains": lambda: F.contains(text, raw),
        "starts-with": lambda: F.startswith(text, raw),
    }[operator]()
    return df.where(~empty & F.coalesce(test, F.lit(False)))


def geojson_bounds(df: DataFrame, geom: str = "geom") -> DataFrame:
    """The box over every position of a collection of geometries."""
    return df.agg(*bounds_aggregates(geom)).where(F.col("minx").isNotNull())


def parse_bbox(df: DataFrame, column: str) -> DataFrame:
    """Validate ``w,s,e,n`` texts: four numbers, or the reason of the refusal."""
    pieces = F.split(F.col(column), r"\s*,\s*")
    w, s, e, n = (as_number(F.get(pieces, F.lit(i))) for i in range(4))
    reason = (
        F.when(F.col(column).isNull() | (F.trim(F.col(column)) == ""), "empty")
        .when(F.size(pieces) != 4, "not four values")
        .when(w.isNull() | s.isNull() | e.isNull() | n.isNull(), "not a number")
        .when((F.abs(w) > 180) | (F.abs(e) > 180), "longitude out of range")
        .when((F.abs(s) > 90) | (F.abs(n) > 90), "latitude out of range")
        .when((w >= e) | (s >= n), "out of order")
    )
    ok = reason.isNull()
    return df.withColumns(
        {
            "west": F.when(ok, w), "south": F.when(ok, s), "east": F.when(ok, e), "north": F.when(ok, n),
            "reason": reason,
        }
    )


def point_density(
    df: DataFrame, cell: float, radius_cells: int = 1, intensity: float = 1.0, weight: str | None = None,
    geom: str = "geom",
) -> DataFrame:
    """Weighted point counts per cell, each point spread over the cells within a radius.

    Points are first summed per cell, so a hot spot is one row before it is spread.
    """
    measure("cell", cell, above_zero=True)
    measure("intensity", intensity)
    pts = df.select(F.explode(G.vertices(F.col(geom))).alias("p"), *([F.col(weight)] if weight else []))
    value = F.col(weight).cast("double") if weight else F.lit(1.0)
    binned = pts.groupBy(
        F.floor(F.col("p.x") / cell).alias("cx"), F.floor(F.col("p.y") / cell).alias("cy")
    ).agg(F.sum(value).alias("w"))
    r = int(radius_cells)
    shifts = [
        (dx, dy) for dx in range(-r, r + 1) for dy in range(-r, r + 1) if dx * dx + dy * dy <= r * r
    ]
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in shifts])
    spread = binned.select("cx", "cy", "w", F.explode(offsets).alias("o"))
    return spread.groupBy(
        (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy")
    ).agg((F.sum("w") * F.lit(float(intensity))).alias("density"))


def class_breaks(df: DataFrame, column: str, k: int, scheme: str = "quantile") -> DataFrame:
    """One row per class: ``class_id`` 0..k-1 with ``low`` and ``high``."""
    one_of("scheme", scheme, ("quantile", "equal-interval"))
    if k < 1:
        raise ValueError("k must be at least 1")
    require_columns(df, [column])
    if scheme == "quantile":
        edges = group_percentiles(df, [], column, [i / k for i in range(k + 1)])
        array = F.array(*[F.col(f"p{i}") for i in range(k + 1)])
    else:
        edges = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
        array = F.array(*[F.col("lo") + (F.col("hi") - F.col("lo")) * i / k for i in range(k + 1)])
    return edges.select(F.posexplode(F.slice(array, 1, k)).alias("class_id", "low"), array.alias("e")).select(
        "class_id", "low", F.get(F.col("e"), F.col("class_id") + 1).alias("high")
    )


def classify(df: DataFrame, column: str, k: int, scheme: str = "quantile") -> DataFrame:
    """Add ``class_id``: the class whose half-open range holds the value, the top one closed."""
    breaks = class_breaks(df, column, k, scheme)
    inner = breaks.where("class_id > 0").agg(F.array_sort(F.collect_list("low")).alias("b"))
    position = F.size(F.filter(F.col("_b"), lambda b: b <= F.col(column)))
    tagged = df.withColumn("_b", inner.scalar())
    return tagged.withColumn("class_id", F.when(F.col(column).isNotNull(), position)).drop("_b")
