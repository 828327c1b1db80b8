"""Overlay operators built on the arrangement: dissolve, clip, overlay, buffer, repair."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs as C
from ..functions import geom as G
from ..functions import predicates as P
from ..session import cut_lineage, measure, one_of, over_cores, require_columns
from . import arrangement as A
from .joins import aligned, candidate_pairs, matched_pairs
from .percentiles import group_percentiles
from .validity import with_reasons
from .vector import STATISTICS, explode

OVERLAYS = ("intersection", "difference", "union")
LOCATIONS = ("intersects", "within", "contains", "disjoint")
TURNS = "array<struct<x:double,y:double,a0:double,sweep:double>>"
#: Fixed value: segments of a quarter circle in round buffers.
QUARTER = 16


def union_all(df: DataFrame, keys: list[str], geom: str = "geom", digits: int = 9) -> DataFrame:
    """The union of the polygons of each key: ``keys, geom``."""
    return A.arrange(A.polygon_segments(df, keys, geom), keys, "union", digits)


def merged(df: DataFrame, keys: list[str], geom: str = "geom", digits: int = 9) -> DataFrame:
    """One geometry per key, ``keys, geom``: the union of its polygons, else its distinct lines, else its distinct points."""
    g = F.col(geom)
    areas = union_all(df, keys, geom, digits)
    others = df.where(~G.is_polygonal(g) & ~G.is_empty(g))
    parts = others.select(*keys, G.is_linear(g).alias("_line"), F.explode(g["parts"]).alias("_p")).distinct()
    kinds = parts.groupBy(*keys).agg(F.max("_line").alias("_any"))
    own = parts.join(kinds, keys).where("_line = _any").groupBy(*keys, "_any").agg(F.array_sort(F.collect_set("_p")).alias("_parts"))
    single = F.when(F.col("_any"), "LineString").otherwise("Point")
    kind = F.when(F.size("_parts") > 1, F.concat(F.lit("Multi"), single)).otherwise(single)
    rest = own.select(*keys, G.make(kind, F.col("_parts")).alias("_other"))
    return areas.join(rest, keys, "full").select(*keys, F.coalesce("geom", "_other").alias("geom"))


def dissolve(df: DataFrame, column: str | None = None, order: str | None = None, geom: str = "geom", digits: int = 9) -> DataFrame:
    """One geometry, or one per value of ``column`` with the first non-NULL of every other column.

    ``order`` says which row comes first; NULL keys are dropped.
    """
    if column is None:
        one = df.select(geom, F.lit(0).alias("_k"), "srid")
        return merged(one, ["_k"], geom, digits).drop("_k").withColumn("srid", df.agg(F.max("srid")).scalar())
    require_columns(df, [column] + ([order] if order else []))
    rows = df.where(F.col(column).isNotNull())
    rest = [c for c in rows.columns if c not in (column, geom, *G.BBOX)]
    if rest and order is None:
        raise ValueError("dissolve keeps the first value of other columns: pass order=, or drop them")
    attributes = rows.groupBy(column).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest], F.count(F.lit(1)).alias("_n")
    ).drop("_n")
    return attributes.join(merged(rows, [column], geom, digits), column, "left")


def aggregate(df: DataFrame, column: str, statistic: str = "count", field: str | None = None, geom: str = "geom", digits: int = 9) -> DataFrame:
    """Polygons merged by ``column`` with one statistic: ``count`` or ``<field>_<statistic>``."""
    one_of("statistic", statistic, STATISTICS)
    if statistic != "count" and not field:
        raise ValueError(f"statistic {statistic!r} needs a numeric field to reduce")
    require_columns(df, [column] + ([field] if field else []))
    rows = df.where(G.is_polygonal(F.col(geom)) & F.col(column).isNotNull())
    name = "count" if statistic == "count" else f"{field}_{statistic}"
    if statistic == "median":
        values = group_percentiles(rows, [column], field, [0.5]).select(column, F.col("p0").alias(name))
    else:
        v = F.when(~F.isnan(F.col(field).cast("double")), F.col(field)) if field else None
        agg = {
            "count": lambda: F.count(F.lit(1)), "sum": lambda: F.coalesce(F.sum(v), F.lit(0)), "mean": lambda: F.avg(v),
            "min": lambda: F.min(v), "max": lambda: F.max(v),
        }[statistic]()
        values = rows.groupBy(column).agg(agg.alias(name))
    return union_all(rows, [column], geom, digits).join(values, column, "left")


def _half(path: Column, axis: str, at: Column, below: bool) -> Column:
    """A closed convex path cut to ``axis`` values not above (``below``) or not below ``at``."""
    gap = lambda v: (at - v[axis]) if below else (v[axis] - at)
    other = "y" if axis == "x" else "x"

    def kept(p: Column, q: Column) -> Column:
        """A side's start, if it stays, and the place where the side crosses the line."""
        cross = lambda a, b: p[other] + (q[other] - p[other]) * a / (a - b)
        place = lambda a, b: G.xy(at, cross(a, b)) if axis == "x" else G.xy(cross(a, b), at)
        return G.let(
            F.struct(gap(p).alias("a"), gap(q).alias("b")),
            lambda g: F.concat(F.when(g["a"] >= 0, F.array(p)).otherwise(F.array().cast(G.RING)), F.when(g["a"] * g["b"] < 0, F.array(place(g["a"], g["b"]))).otherwise(F.array().cast(G.RING))),
        )

    sides = F.zip_with(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))), kept)
    return G.let(F.flatten(sides), lambda r: F.concat(r, F.slice(r, 1, 1)))


def _in_box(ring: Column, box: list[Column], digits: int) -> Column:
    """A convex ring cut to a box, counter-clockwise, NULL without an area; vertices on straight lines go."""
    path = F.when(G.signed_area(ring) >= 0, ring).otherwise(F.reverse(ring))
    path = G.let(path, lambda r: _half(r, "x", box[0], False))
    path = G.let(path, lambda r: _half(r, "y", box[1], False))
    path = G.let(path, lambda r: _half(r, "x", box[2], True))
    path = G.let(path, lambda r: _half(r, "y", box[3], True))
    at = lambda v: F.rint(v * 10.0**digits) / 10.0**digits + F.lit(0.0)
    snapped = G.let(path, lambda r: F.transform(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), lambda v: G.xy(at(v["x"]), at(v["y"]))))
    # neighbours that snapping made equal are one vertex
    single = G.let(snapped, lambda r: F.filter(r, lambda v, i: v != F.get(r, F.pmod(i + 1, F.size(r)))))

    def corner(r: Column, v: Column, i: Column) -> Column:
        p, q = F.get(r, F.pmod(i - 1 + F.size(r), F.size(r))), F.get(r, F.pmod(i + 1, F.size(r)))
        ax, ay, bx, by = v["x"] - p["x"], v["y"] - p["y"], q["x"] - v["x"], q["y"] - v["y"]
        return F.abs(ax * by - ay * bx) > (F.abs(ax) + F.abs(ay)) * (F.abs(bx) + F.abs(by)) * 1e-12

    bent = G.let(single, lambda r: F.filter(r, lambda v, i: corner(r, v, i)))
    return G.let(bent, lambda r: F.when(F.size(r) >= 3, G.polygon(F.concat(r, F.slice(r, 1, 1)))))


def _pairs(left: DataFrame, right: DataFrame, lk: str, rk: str, geom: str) -> DataFrame:
    """Overlapping boxes as ``lk, rk, l_geom, r_geom`` with the box columns and rectangle flags."""

    def side(df: DataFrame, key: str, p: str) -> DataFrame:
        # dealt over all tasks, since one file may hold many rows
        boxed = G.with_bbox(df.select(F.col(key).alias("key"), F.col(geom).alias("geom")).repartition("key"), "geom")
        boxed = boxed.withColumn("rect", F.expr(P.is_rectangle("geom")))
        turns = F.when(~F.col("rect") & G.is_polygonal(F.col("geom")), _convex_turns(F.col("geom")))
        boxed = boxed.withColumn("convex", F.coalesce(F.size(turns) > 0, F.lit(False)))
        return boxed.select(*[F.col(c).alias(f"{p}_{c}") for c in boxed.columns])

    return cut_lineage(candidate_pairs(side(left, lk, "l"), side(right, rk, "r")))


def overlay(
    left: DataFrame, right: DataFrame, operation: str = "intersection", left_key: str | None = None, right_key: str | None = None,
    geom: str = "geom", srids: tuple[int, int] | None = None,
) -> DataFrame:
    """Combine two polygon layers.

    ``intersection`` gives the area of every overlapping pair with both sides' attributes
    (``_1``/``_2`` on equal names), ``difference`` the left area outside all right
    features, ``union`` one geometry.  The keys are unique per layer.
    """
    one_of("operation", operation, OVERLAYS)
    right = aligned(left, right, geom, srids)
    digits = A.digits_for(srids[0] if srids else None)
    if operation == "union":
        both = left.select(geom, "srid").unionByName(right.select(geom, "srid"))
        return dissolve(both, geom=geom, digits=digits)
    left = left.where(G.is_polygonal(F.col(geom)))
    right = right.where(G.is_polygonal(F.col(geom)))
    pairs = _pairs(left, right, left_key, right_key, geom)
    if operation == "intersection":
        return _intersection(left, right, pairs, left_key, right_key, geom, digits)
    # only left features with a real overlap need cutting
    near = pairs.where("l_minx < r_maxx and l_maxx > r_minx and l_miny < r_maxy and l_maxy > r_miny")
    touched = near.select(F.col("l_key").alias(left_key)).distinct()
    # nothing is left of those inside a box
    gone = near.where("r_rect and l_minx >= r_minx and l_maxx <= r_maxx and l_miny >= r_miny and l_maxy <= r_maxy").select(F.col("l_key").alias(left_key)).distinct()
    near = near.withColumnRenamed("l_key", left_key).join(gone, left_key, "left_anti")
    a = A.polygon_segments(near.select(left_key, F.col("l_geom").alias(geom)).dropDuplicates([left_key]), [left_key], geom, "a")
    b = A.polygon_segments(near.select(left_key, F.col("r_geom").alias(geom)), [left_key], geom, "b")
    cut = A.arrange(a.unionByName(b), [left_key], "difference", digits)
    rest = left.drop(*G.BBOX)
    kept = rest.join(touched, left_key, "left_anti")
    return kept.unionByName(rest.drop(geom).join(cut.withColumnRenamed("geom", geom), left_key))


def _intersection(left, right, pairs, lk, rk, geom, digits) -> DataFrame:
    inside = pairs.where("least(l_maxx, r_maxx) > greatest(l_minx, r_minx) and least(l_maxy, r_maxy) > greatest(l_miny, r_miny)")
    boxes = inside.where("l_rect and r_rect").select(
        "l_key", "r_key",
        G.box(F.greatest("l_minx", "r_minx"), F.greatest("l_miny", "r_miny"), F.least("l_maxx", "r_maxx"), F.least("l_maxy", "r_maxy")).alias("geom"),
    )
    # a convex shape in a box needs no arrangement
    other = inside.where("not (l_rect and r_rect)")
    single = "coalesce((r_rect and l_convex) or (l_rect and r_convex), false)"
    lb, rb = ([F.col(f"{p}_{c}") for c in G.BBOX] for p in "lr")
    cut = F.when(F.col("r_rect"), _in_box(F.get(G.rings_of(F.col("l_geom")), F.lit(0)), rb, digits)).otherwise(_in_box(F.get(G.rings_of(F.col("r_geom")), F.lit(0)), lb, digits))
    convex = G.bound(other.where(single), {"geom": cut}).where("geom is not null").select("l_key", "r_key", "geom")
    other = other.where(f"not {single}")
    keys = ["l_key", "r_key"]
    segs = A.polygon_segments(other, keys, "l_geom", "a").unionByName(A.polygon_segments(other, keys, "r_geom", "b"))
    shapes = boxes.unionByName(convex)
    if not other.isEmpty():
        shapes = shapes.unionByName(A.arrange(segs, keys, "intersection", digits))
    l_cols = [c for c in left.columns if c not in (geom, *G.BBOX)]
    r_cols = [c for c in right.columns if c not in (geom, "srid", *G.BBOX)]
    clash = set(l_cols) & set(r_cols)
    la = left.select(F.col(lk).alias("l_key"), *[F.col(c).alias(f"{c}_1" if c in clash else c) for c in l_cols])
    ra = right.select(F.col(rk).alias("r_key"), *[F.col(c).alias(f"{c}_2" if c in clash else c) for c in r_cols])
    return shapes.join(la, "l_key").join(ra, "r_key").drop("l_key", "r_key").withColumnRenamed("geom", geom)


def clip_vector(
    df: DataFrame, mask: DataFrame, key: str, geom: str = "geom", srids: tuple[int, int] | None = None, outline: bool = True
) -> DataFrame:
    """Features cut to the union of the mask; points inside or on it stay.  ``key`` is unique.

    Lines along the mask's outline stay as well, unless ``outline`` is false.
    """
    mask = aligned(df, mask, geom, srids)
    digits = A.digits_for(srids[0] if srids else None)
    numbered = mask.select(F.xxhash64(F.to_json(geom)).alias("_m"), geom).dropDuplicates(["_m"])
    pairs = _pairs(df, numbered, key, "_m", geom)
    rest = df.drop(*G.BBOX)
    dots = rest.where(~G.is_polygonal(F.col(geom)) & ~G.is_linear(F.col(geom)))
    # of several points only those that meet the mask stay
    each = explode(dots.select(key, geom), geom).withColumn("_id", F.struct(key, "part"))
    met = matched_pairs(each.select("_id", geom), numbered, "intersects", geom).select(F.col("l__id").alias("_id"), F.col("l_geom").alias("_g")).dropDuplicates(["_id"])
    points = met.groupBy(F.col(f"_id.{key}").alias(key)).agg(F.array_sort(F.collect_list(F.struct(F.col("_id.part").alias("at"), F.col("_g")["parts"][0].alias("p")))).alias("_p"))
    points = points.select(key, F.transform("_p", lambda v: v["p"]).alias("_p"))
    kept = dots.join(points, key).withColumn(geom, G.make(F.col(geom)["type"], F.col("_p"))).drop("_p")
    near = pairs.select(F.col("l_key").alias(key), F.col("l_geom"), F.col("r_geom"))
    one = near.select(key, "l_geom").dropDuplicates([key])
    b = A.polygon_segments(near, [key], "r_geom", "b")
    areas = A.arrange(A.polygon_segments(one, [key], "l_geom", "a").unionByName(b), [key], "intersection", digits)
    linear = near.where(G.is_linear(F.col("l_geom")))
    paths = A.clip_lines(
        A.line_segments(linear.select(key, "l_geom").dropDuplicates([key]), [key], "l_geom").unionByName(A.polygon_segments(linear, [key], "r_geom", "b")), [key], digits, outline
    )
    cut = areas.unionByName(paths).withColumnRenamed("geom", geom)
    return kept.unionByName(rest.drop(geom).join(cut, key))


def select_by_location(df: DataFrame, mask: DataFrame, predicate: str, key: str, geom: str = "geom", srids: tuple[int, int] | None = None) -> DataFrame:
    """Features by their relation to the union of the mask; NULL and empty ones never match.

    ``within`` looks inside the union, so a feature may lie across several mask
    features; ``contains`` asks for the whole mask.  ``key`` is unique per feature.
    """
    one_of("predicate", predicate, LOCATIONS)
    mask = aligned(df, mask, geom, srids)
    if mask.isEmpty():
        raise ValueError("the mask layer has no features")
    plain = df.drop(*G.BBOX)
    real = plain.where(~G.is_empty(F.col(geom)))
    probe = real.select(key, geom)

    def matched(layer: DataFrame, how: str) -> DataFrame:
        return matched_pairs(probe, layer.select(geom), how, geom).select(F.col(f"l_{key}").alias(key)).distinct()

    if predicate == "intersects":
        return real.join(matched(mask, "intersects"), key, "left_semi")
    if predicate == "disjoint":
        return real.join(matched(mask, "intersects"), key, "left_anti")
    if predicate == "contains":
        numbered = mask.select(F.xxhash64(F.to_json(geom)).alias("_m"), geom).where(~G.is_empty(F.col(geom))).dropDuplicates(["_m"])
        total = numbered.agg(F.count(F.lit(1)).alias("n"))
        found = matched_pairs(probe, numbered, "contains", geom).groupBy(F.col(f"l_{key}").alias(key)).agg(F.count(F.lit(1)).alias("n"))
        whole = found.withColumn("_all", total.scalar()).where("n = _all").select(key)
        return real.join(whole, key, "left_semi")
    # inside the union: every part of the feature inside one part of the dissolved mask
    parts = explode(dissolve(mask.select(geom, "srid"), geom=geom, digits=A.digits_for(srids[0] if srids else None)), geom)
    pieces = explode(probe, geom).withColumn("_id", F.struct(key, "part"))
    inside = matched_pairs(pieces.select("_id", geom), parts.select(geom), "within", geom).select(F.col("l__id").alias("_id")).distinct()
    # of several points some may lie on the mask's outline, as long as one lies inside
    dots = pieces.where(F.col(geom)["type"] == "Point")
    touching = matched_pairs(dots.select("_id", geom), parts.select(geom), "intersects", geom).select(F.col("l__id").alias("_id")).distinct()
    missed = pieces.join(inside.unionByName(touching).distinct(), "_id", "left_anti").select(key).distinct()
    some = inside.select(F.col(f"_id.{key}").alias(key)).distinct()
    return real.join(missed, key, "left_anti").join(some, key, "left_semi")


def fix_geometry(df: DataFrame, key: str, geom: str = "geom", digits: int = 9) -> DataFrame:
    """Invalid polygons rebuilt by the even-odd rule; everything else passes through.

    A repair that comes out empty keeps the original.
    """
    checked = with_reasons(df.drop(*G.BBOX), geom, key).withColumn("_bad", F.col("reason").isNotNull() & G.is_polygonal(F.col(geom))).drop("reason")
    fixed = A.arrange(A.polygon_segments(checked.where("_bad"), [key], geom), [key], "even-odd", digits)
    out = checked.join(fixed.select(key, F.col("geom").alias("_fixed")), key, "left")
    return out.withColumn(geom, F.coalesce("_fixed", geom)).drop("_bad", "_fixed")


# -- buffer ---------------------------------------------------------------


def disc(x: Column, y: Column, r: float) -> Column:
    n = 4 * QUARTER
    corner = [(r * math.cos(2 * math.pi * k / n), r * math.sin(2 * math.pi * k / n)) for k in [*range(n), 0]]
    return G.polygon(F.array(*[G.xy(x + F.lit(a), y + F.lit(b)) for a, b in corner]))


def _strips(segs: DataFrame, keys: list[str], d: float) -> DataFrame:
    """A quadrilateral on the right side of each directed segment."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    nx, ny = (F.col("y2") - F.col("y1")) / length * d, -(F.col("x2") - F.col("x1")) / length * d
    ring = F.array(
        G.xy("x1", "y1"), G.xy(F.col("x1") + nx, F.col("y1") + ny), G.xy(F.col("x2") + nx, F.col("y2") + ny), G.xy("x2", "y2"), G.xy("x1", "y1")
    )
    return segs.where("x1 <> x2 or y1 <> y2").select(*keys, G.polygon(ring).alias("geom"))


def _wedges(corners: DataFrame, keys: list[str], d: float) -> DataFrame:
    """Round joins: fans at ``x, y`` from angle ``a0`` over ``sweep`` radians."""
    quantum = math.pi / 2 / QUARTER
    n = F.greatest(F.floor(F.col("sweep") / quantum + 0.5), F.lit(1)).cast("int")
    arc = F.transform(
        F.sequence(F.lit(0), n),
        lambda k: G.xy(F.col("x") + F.cos(F.col("a0") + F.col("sweep") * k / n) * d, F.col("y") + F.sin(F.col("a0") + F.col("sweep") * k / n) * d),
    )
    centre = F.array(G.xy("x", "y"))
    return corners.where("sweep > 1e-12").select(*keys, G.polygon(F.concat(centre, arc, centre)).alias("geom"))


def _corners(df: DataFrame, keys: list[str], geom: str) -> DataFrame:
    """Left turns of directed paths, where the right side needs a round join."""
    g = F.col(geom)
    closed = F.transform(
        g["parts"],
        lambda p: F.transform(p["rings"], lambda r, i: F.when((G.signed_area(r) >= 0) == (i == 0), r).otherwise(F.reverse(r))),
    )
    # lines run there and back again, so that both sides are right sides and ends are turns
    there = F.transform(g["parts"], lambda p: F.transform(p["rings"], lambda r: F.concat(r, F.slice(F.reverse(r), F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))))))
    paths = F.flatten(F.when(G.is_polygonal(g), closed).otherwise(there))
    rows = df.where(G.is_polygonal(g) | G.is_linear(g)).select(*keys, F.explode(paths).alias("_p"))
    segs = F.filter(G.path_segments(F.col("_p")), lambda s: (s["x1"] != s["x2"]) | (s["y1"] != s["y2"]))
    return rows.select(*keys, segs.alias("_s")).where("size(_s) > 0")


def _turns(segs: Column) -> Column:
    """The corners of a closed path of segments; the last segment meets the first again."""
    after = F.concat(F.slice(segs, F.lit(2), F.greatest(F.size(segs) - 1, F.lit(0))), F.slice(segs, 1, 1))

    def corner(s: Column, t: Column) -> Column:
        u, w = (F.atan2(v["y2"] - v["y1"], v["x2"] - v["x1"]) for v in (s, t))
        return F.struct(s["x2"].alias("x"), s["y2"].alias("y"), (u - math.pi / 2).alias("a0"), F.pmod(w - u, F.lit(2 * math.pi)).alias("sweep"))

    return F.zip_with(segs, after, corner)


def _convex_turns(g: Column) -> Column:
    """The corners of a convex polygon without holes or of a straight line, NULL for every other geometry.

    A closed path is convex when it turns left all the way, once around; a right turn adds a whole turn more.
    """
    ccw = lambda r: F.when(G.signed_area(r) >= 0, r).otherwise(F.reverse(r))
    there = lambda r: F.concat(r, F.slice(F.reverse(r), F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))))
    path = G.let(F.get(G.rings_of(g), F.lit(0)), lambda r: F.when(G.is_polygonal(g), ccw(r)).otherwise(there(r)))
    segs = F.filter(G.path_segments(path), lambda s: (s["x1"] != s["x2"]) | (s["y1"] != s["y2"]))
    once = lambda t: (F.size(t) > 0) & (F.abs(G.total(F.transform(t, lambda c: c["sweep"])) - 2 * math.pi) < 1e-9)
    turns = G.let(G.let(segs, _turns), lambda t: F.when(once(t), t))
    return F.when((G.is_polygonal(g) | G.is_linear(g)) & (F.size(G.rings_of(g)) == 1), turns)


def _grown_ring(turns: Column, d: float, digits: int) -> Column:
    """A convex path grown by ``d``: the fans' arcs one after another, joined by the strips' outer sides."""
    quantum = math.pi / 2 / QUARTER

    def arc(t: Column) -> Column:
        n = F.greatest(F.floor(t["sweep"] / quantum + 0.5), F.lit(1)).cast("int")
        at = lambda v: F.rint(v * 10.0**digits) / 10.0**digits + F.lit(0.0)
        steps = F.when(t["sweep"] > 1e-12, F.sequence(F.lit(0), n)).otherwise(F.array(F.lit(0)))
        return F.transform(steps, lambda k: G.let(t["a0"] + t["sweep"] * k / n, lambda a: G.xy(at(t["x"] + F.cos(a) * d), at(t["y"] + F.sin(a) * d))))

    return G.let(F.flatten(F.transform(turns, arc)), lambda p: G.polygon(F.concat(p, F.slice(p, 1, 1))))


def buffer(
    df: DataFrame, distance: float, key: str, unit: str = "meters", dissolved: bool = False, geom: str = "geom", srid: int | None = None
) -> DataFrame:
    """Geometries grown by ``distance``; metres are applied in a metric CRS and brought back.

    Every segment gives a strip, every outer corner a fan of 16 steps per quarter turn;
    their union with the shape itself is the buffer; that of a convex shape needs no arrangement, its outline is
    written down at once.  ``dissolved`` merges all of them.  ``key`` is unique.
    """
    measure("distance", distance)
    one_of("unit", unit, ("meters", "degrees"))
    src, metric = C.metric_srid(df, geom, srid) if unit == "meters" else (C.layer_srid(df, srid),) * 2
    d = float(distance)
    base = df.drop(*G.BBOX).withColumn(geom, C.transform_geom(F.col(geom), src, metric))
    digits = A.digits_for(metric)
    # read by several steps, and few bytes may be many rows
    turned = cut_lineage(over_cores(base, key).withColumn("_turns", _convex_turns(F.col(geom)) if d > 0 else F.lit(None).cast(TURNS)))
    v = F.get(G.vertices(F.col(geom)), F.lit(0))
    shape = F.when(F.col(geom)["type"] == "Point", G.let(v, lambda p: disc(p["x"], p["y"], d))).otherwise(_grown_ring(F.col("_turns"), d, digits))
    plain = F.coalesce((F.col(geom)["type"] == "Point") | F.col("_turns").isNotNull(), F.lit(False))
    easy = turned.where(plain).withColumn(geom, shape).drop("_turns")
    hard = turned.where(~plain).drop("_turns")
    if not dissolved and hard.isEmpty():
        return easy.withColumn(geom, C.transform_geom(F.col(geom), metric, src))
    others = hard.select(key, geom)
    many = others.where(F.col(geom)["type"] == "MultiPoint").select(key, F.explode(G.vertices(F.col(geom))).alias("p"))
    many = many.select(key, G.let(F.col("p"), lambda p: disc(p["x"], p["y"], d)).alias("geom"))
    own = others.where(G.is_polygonal(F.col(geom))).select(key, F.col(geom).alias("geom"))
    paths = _corners(others, [key], geom)
    strips = _strips(paths.select(key, F.explode("_s").alias("s")).select(key, "s.*"), [key], d)
    fans = paths.select(key, F.explode(_turns(F.col("_s"))).alias("t")).select(key, "t.*")
    # a right turn needs no fan; turning straight back (half a turn) is a line's end
    fans = fans.where(F.col("sweep") <= math.pi + 1e-9)
    pieces = own.unionByName(strips).unionByName(_wedges(fans, [key], d)).unionByName(many)
    if dissolved:
        every = pieces.unionByName(easy.select(key, F.col(geom).alias("geom"))).select(F.lit(0).alias("_k"), "geom")
        return union_all(every, ["_k"], "geom", digits).select(C.transform_geom(F.col("geom"), metric, src).alias(geom), F.lit(src).alias("srid"))
    grown = union_all(pieces, [key], "geom", digits)
    # a feature without a geometry, or with an empty one, keeps its row
    out = hard.drop(geom).join(grown.withColumnRenamed("geom", geom), key, "left").unionByName(easy)
    return out.withColumn(geom, C.transform_geom(F.col(geom), metric, src))
