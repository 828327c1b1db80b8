"""Joins between layers.

Catalyst plans a join on ranges alone as a nested loop.  ``candidate_pairs`` gives
it an equi-join instead: every box is binned at a grid level fitting its size, and a
copy of it visits the coarser levels that the other side uses.  Two boxes meet at the
coarser of their two levels, so a visitor is only joined with boxes that are at home
there, never with another visitor: one huge box costs as many rows as it has
neighbours.  A pair counts only in the one cell that holds the lower left corner of
the overlap, so no pair appears twice and no distinct is needed afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs as C
from ..functions import geom as G
from ..functions import predicates as P
from ..session import cut_lineage, one_of, over_cores, require_columns

PREDICATES = ("intersects", "within", "contains")
#: Cells are never finer than 2**-20 units; points sit at this level.
FINEST_LEVEL = -20
#: Features that share a geometry are dealt in parts of about so many; two parts meet in a cell.
MEMBERS = 4096
CELL = ("_pair", "_i", "_j")


def grid_level(width: Column, height: Column) -> Column:
    """The power-of-two cell size that a box of these sides spans at most twice."""
    side = F.greatest(width, height)
    level = F.when(side > 0, F.ceil(F.log2(side))).otherwise(F.lit(FINEST_LEVEL)).cast("int")
    return F.greatest(level, F.lit(FINEST_LEVEL))


def cell_index(level: Column, x: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level)).cast("long")


def _cells(df: DataFrame, levels: Column, own: str, prefix: str) -> DataFrame:
    """One row per usable level and grid cell that the row's box touches."""
    lo_x, lo_y, hi_x, hi_y = (F.col(f"{prefix}{c}") for c in G.BBOX)
    level = F.col("_level")
    at = df.withColumn("_level", F.explode(levels)).where(level >= F.col(own))
    at = at.withColumn("_cx", F.explode(F.sequence(cell_index(level, lo_x), cell_index(level, hi_x))))
    return at.withColumn("_cy", F.explode(F.sequence(cell_index(level, lo_y), cell_index(level, hi_y))))


def candidate_pairs(left: DataFrame, right: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Pairs whose bounding boxes overlap (edges count), each exactly once.

    ``left`` has the box in ``l_minx..l_maxy``, ``right`` in ``r_minx..r_maxy``;
    their other columns must not clash.  ``group`` names columns both sides share
    that must be equal too.
    """
    lv = grid_level(F.col("l_maxx") - F.col("l_minx"), F.col("l_maxy") - F.col("l_miny"))
    rv = grid_level(F.col("r_maxx") - F.col("r_minx"), F.col("r_maxy") - F.col("r_miny"))
    left = left.where("l_minx is not null").withColumn("_ll", lv)
    right = right.where("r_minx is not null").withColumn("_rl", rv)
    # the levels in use: at most ~60 whatever the table sizes
    none = F.array().cast("array<int>")
    l_used = F.coalesce(left.agg(F.collect_set("_ll").alias("levels")).scalar(), none)
    r_used = F.coalesce(right.agg(F.collect_set("_rl").alias("levels")).scalar(), none)
    lc = _cells(left, F.array_union(r_used, F.array("_ll")), "_ll", "l_")
    rc = _cells(right, F.array_union(l_used, F.array("_rl")), "_rl", "r_")
    # meeting 0: left at home with any right; meeting 1: left visiting a right that is at home
    lc = lc.withColumn("_meeting", F.when(F.col("_level") == F.col("_ll"), 0).otherwise(1))
    home = F.when(F.col("_level") == F.col("_rl"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rc = rc.withColumn("_meeting", F.explode(home))
    pairs = lc.join(rc, [*(group or []), "_meeting", "_level", "_cx", "_cy"])
    overlap = (
        (F.col("l_minx") <= F.col("r_maxx")) & (F.col("l_maxx") >= F.col("r_minx"))
        & (F.col("l_miny") <= F.col("r_maxy")) & (F.col("l_maxy") >= F.col("r_miny"))
    )
    level = F.col("_level")
    owner = (F.col("_cx") == cell_index(level, F.greatest("l_minx", "r_minx"))) & (
        F.col("_cy") == cell_index(level, F.greatest("l_miny", "r_miny"))
    )
    return pairs.where(overlap & owner).drop("_meeting", "_level", "_cx", "_cy", "_ll", "_rl")


def _prefixed(df: DataFrame, prefix: str, geom: str) -> DataFrame:
    """Rename every column with a prefix and add the box columns."""
    boxed = G.with_bbox(df.select([c for c in df.columns if c not in G.BBOX]), geom)
    return boxed.select([F.col(c).alias(prefix + c) for c in boxed.columns])


def aligned(left: DataFrame, right: DataFrame, geom: str = "geom", srids: tuple[int, int] | None = None) -> DataFrame:
    """The right layer in the left layer's CRS; equal codes are a no-op."""
    a, b = srids if srids else (C.layer_srid(left), C.layer_srid(right))
    if a == b:
        return right
    return right.withColumns({geom: C.transform_geom(F.col(geom), b, a), "srid": F.lit(a)}).drop(*G.BBOX)


def _exact(predicate: str) -> Column:
    """The exact test on ``l_geom``/``r_geom``; boxes and points skip the outline test."""
    test = {"intersects": P.intersects, "within": P.within, "contains": P.contains}[predicate]
    strictly = "l_minx > r_minx and l_minx < r_maxx and l_miny > r_miny and l_miny < r_maxy"
    dot = {"intersects": "true", "within": strictly, "contains": "false"}[predicate]
    boxes = {
        "intersects": "true", "within": P.box_inside("l_", "r_"), "contains": P.box_inside("r_", "l_"),
    }[predicate]
    return F.expr(
        f"case when l_geom.type = 'Point' and r__rect then {dot} when l__rect and r__rect then {boxes}"
        f" else {test('l_geom', 'r_geom', 'l_', 'r_')} end"
    )


def matched_pairs(
    left: DataFrame, right: DataFrame, predicate: str, geom: str = "geom", group: list[str] | None = None
) -> DataFrame:
    """All ``l_*``/``r_*`` columns of the pairs that satisfy the predicate."""
    one_of("predicate", predicate, PREDICATES)
    lp = _prefixed(left.withColumn("_rect", F.expr(P.is_rectangle(geom))).withColumnRenamed(geom, "geom"), "l_", "geom")
    rp = _prefixed(right.withColumn("_rect", F.expr(P.is_rectangle(geom))).withColumnRenamed(geom, "geom"), "r_", "geom")
    return candidate_pairs(lp, rp, group).where(_exact(predicate)).drop("l__rect", "r__rect")


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    predicate: str = "intersects",
    how: str = "inner",
    geom: str = "geom",
    srids: tuple[int, int] | None = None,
    key: str | None = None,
    repeats: bool = False,
) -> DataFrame:
    """Attach the right layer's attributes to each left feature that matches.

    One row per match; names in both layers get ``_left`` and ``_right``.  ``left``
    keeps unmatched features with NULL right columns; ``key`` names a column that is
    unique in the left layer (without one, a hash of the whole row stands in).
    ``repeats`` is for inner joins of layers in which many features share a geometry:
    each pair of different geometries is tested once and then dealt to its features, which
    meet in cells of bounded size that are spread over all cores.
    """
    one_of("how", how, ("inner", "left"))
    if repeats and how != "inner":
        raise ValueError("repeats needs an inner join")
    right = aligned(left, right, geom, srids)
    skip = {geom, "srid", *G.BBOX}
    l_names = [c for c in left.columns if c not in G.BBOX]
    r_names = [c for c in right.columns if c not in skip]
    both = set(l_names) & set(r_names)
    l_out = {c: f"{c}_left" if c in both else c for c in l_names}
    r_out = {c: f"{c}_right" if c in both else c for c in r_names}
    if repeats:
        lp, rp = (with_row_key(df.select(c), "_shape", geom) for df, c in ((left, l_names), (right, [*r_names, geom])))
        shapes = [df.groupBy("_shape").agg(F.first(geom).alias(geom), F.ceil(F.count(F.lit(1)) / MEMBERS).alias("_parts")) for df in (lp, rp)]
        met = matched_pairs(*shapes, predicate, geom).select(
            F.col("l__shape").alias("_a"), F.col("r__shape").alias("_b"), F.col("l__parts").alias("_m"), F.col("r__parts").alias("_n")
        )
        met = cut_lineage(met.withColumn("_pair", F.monotonically_increasing_id()))
        a = lp.select(F.col("_shape").alias("_a"), *[F.col(c).alias(o) for c, o in l_out.items()])
        b = rp.select(F.col("_shape").alias("_b"), *[F.col(c).alias(o) for c, o in r_out.items()])
        a, b = _in_cells(a, met, "_a", l_out[geom], ("_m", "_i"), ("_n", "_j")), _in_cells(b, met, "_b", "", ("_n", "_j"), ("_m", "_i"))
        return a.join(b, list(CELL)).select(*l_out.values(), *r_out.values())
    if how == "inner":
        pairs = matched_pairs(left, right, predicate, geom)
        return pairs.select(
            *[F.col(f"l_{'geom' if c == geom else c}").alias(o) for c, o in l_out.items()],
            *[F.col(f"r_{c}").alias(o) for c, o in r_out.items()],
        )
    # Only the row key and what the test needs travel through the join.
    if key:
        tagged = left.select(l_names).withColumn("_id", F.col(key))
        probe = tagged.select("_id", geom)
    else:
        tagged = with_row_key(left.select(l_names), "_id")
        probe = tagged.select("_id", geom).dropDuplicates(["_id"])
    pairs = matched_pairs(probe, right, predicate, geom)
    matches = pairs.select(F.col("l__id").alias("_id"), *[F.col(f"r_{c}").alias(o) for c, o in r_out.items()])
    renamed = tagged.select("_id", *[F.col(c).alias(o) for c, o in l_out.items()])
    return renamed.join(matches, "_id", "left").drop("_id")


def _in_cells(members: DataFrame, met: DataFrame, shape: str, geom: str, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """The members of a shape in the cells of its pairs: each is in one part of its own shape and meets all of the other's."""
    (count, part), (others, each) = own, other
    values = [c for c in members.columns if c != shape]
    content = F.xxhash64(F.to_json(F.struct(F.lit(0), *[c for c in values if c != geom])))
    placed = members.join(met, shape).withColumn(part, F.when(F.col(count) > 1, F.pmod(content, F.col(count))).otherwise(0))
    placed = placed.withColumn(each, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)))
    return over_cores(placed.select(*CELL, *values), *CELL)


def with_row_key(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """A key from the row's own content, or that of some columns: equal rows share it, and it survives retries."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}), 256))


def attribute_join(
    left: DataFrame, right: DataFrame, field: str, join_field: str | None = None, columns: list[str] | None = None,
    geom: str = "geom",
) -> DataFrame:
    """Left join of a table's columns on equal key values; NULL keys match NULL keys.

    Both key columns stay when their names differ; other clashes get ``_x``/``_y``.
    """
    require_columns(left, [field])
    key = join_field or field
    require_columns(right, [key])
    keep = list(columns) if columns else [c for c in right.columns if c not in (key, geom)]
    require_columns(right, keep)
    picked = list(dict.fromkeys([key, *keep]))
    clash = (set(left.columns) & set(picked)) - ({field} if key == field else set())
    r = right.select([F.col(c).alias("_r_" + c) for c in picked])
    joined = left.join(r, F.col(field).eqNullSafe(F.col("_r_" + key)), "left")
    out = [F.col(c).alias(f"{c}_x" if c in clash else c) for c in left.columns]
    out += [
        F.col("_r_" + c).alias(f"{c}_y" if c in clash else c)
        for c in picked
        if not (c == key and key == field)
    ]
    return joined.select(out)


def bbox_overlaps(box: Column, bounds) -> Column:
    """Whether an item's ``bbox`` array meets the bounds; an unknown box passes.

    Four elements are west, south, east, north; six carry heights in between.
    """
    if bounds is None:
        return F.lit(True)
    west, south, east, north = (float(v) for v in bounds)
    flat = F.size(box) >= 6
    item = [F.get(box, F.lit(0)), F.get(box, F.lit(1)),
            F.when(flat, F.get(box, F.lit(3))).otherwise(F.get(box, F.lit(2))),
            F.when(flat, F.get(box, F.lit(4))).otherwise(F.get(box, F.lit(3)))]
    w, s, e, n = (v.try_cast("double") for v in item)
    test = (w <= east) & (e >= west) & (s <= north) & (n >= south)
    known = w.isNotNull() & s.isNotNull() & e.isNotNull() & n.isNotNull()
    return F.when(known, test).otherwise(F.lit(True))
