"""Polygon arrangement as Spark joins: union, intersection, difference, repair.

The work is on a table of directed segments (interior on the left), keyed by the output
geometry they belong to, with a role A or B:

1. equal segments collapse to one weighted row, so copies of a shape cost nothing;
2. segments are binned on a grid sized to their key, and a self-join per cell finds
   crossings and touching ends; every segment is cut there;
3. each piece needs the number of A and B shapes above it.  Inside its cell the pieces
   overhead are counted; a running sum over grid lines gives the count at the cell's
   corner, so no ray leaves its cell;
4. pieces whose two sides differ under the wanted rule are the result's boundary.

In a union, cells that lie wholly inside the A shapes are known before step 2 from their corner's count and the
segments in them.  Only segments outside these cells are cut, so that shapes many deep do not cost the square of their depth.

Only step 5, putting one result's edges in order, is a grouped kernel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom as G
from ..session import cut_lineage
from .linking import join_chains, link_rings

#: Coverage is counted along a slanted direction, so that upright edges are ordinary ones.
SHEAR = 0.0137035999
#: Segments a grid cell should hold on average.
PER_CELL = 24
#: The same for unions: smaller cells lie inside the shapes more often.
PER_UNION_CELL = 2
CELL = ("_cx", "_cy")
SEG = ("x1", "y1", "x2", "y2")
WEIGHTS = ("wa", "wb", "ln")

RULES = {
    "union": lambda a, b: (a > 0) | (b > 0),
    "intersection": lambda a, b: (a > 0) & (b > 0),
    "difference": lambda a, b: (a > 0) & ~(b > 0),
    "even-odd": lambda a, b: F.pmod(a, F.lit(2)) == 1,
}


def _slant(x, y) -> Column:
    return G.as_col(x) + G.as_col(y) * F.lit(SHEAR)


def polygon_segments(df: DataFrame, keys: list[str], geom: str = "geom", role: str = "a") -> DataFrame:
    """Directed segments of polygons, exteriors counter-clockwise and holes clockwise."""
    area = (
        "aggregate(zip_with(slice(r, 1, greatest(size(r) - 1, 0)), slice(r, 2, greatest(size(r) - 1, 0)), "
        "(p, q) -> (p.x - r[0].x) * (q.y - r[0].y) - (q.x - r[0].x) * (p.y - r[0].y)), 0.0D, (acc, v) -> acc + v)"
    )
    rings = f"flatten(transform({geom}.parts, t -> transform(t.rings, (r, i) -> if(({area} >= 0) = (i = 0), r, reverse(r)))))"
    segs = df.where(f"{geom}.type in ('Polygon', 'MultiPolygon')").select(*keys, F.expr(rings).alias("_r"))
    steps = (
        "explode(flatten(transform(_r, r -> zip_with(slice(r, 1, greatest(size(r) - 1, 0)), slice(r, 2, greatest(size(r) - 1, 0)), "
        "(p, q) -> struct(p.x as x1, p.y as y1, q.x as x2, q.y as y2))))) as s"
    )
    return _weighted(segs.selectExpr(*[f"`{k}`" for k in keys], steps).select(*keys, "s.*"), role)


def line_segments(df: DataFrame, keys: list[str], geom: str = "geom") -> DataFrame:
    g = F.col(geom)
    segs = df.where(G.is_linear(g)).select(*keys, F.explode(G.segments(g)).alias("s"))
    return _weighted(segs.select(*keys, "s.*"), "line")


def _weighted(segs: DataFrame, role: str) -> DataFrame:
    return segs.withColumns(
        {"wa": F.lit(int(role == "a")), "wb": F.lit(int(role == "b")), "ln": F.lit(int(role == "line"))}
    )


def _canonical(df: DataFrame, keys: list[str], digits: int) -> DataFrame:
    """Snap ends, point every segment the same way (weights change sign) and merge equal ones."""
    snapped = df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in SEG})
    snapped = snapped.where("x1 <> x2 or y1 <> y2")
    a, b = F.struct(_slant("x1", "y1"), F.col("y1")), F.struct(_slant("x2", "y2"), F.col("y2"))
    flip = a > b
    turned = snapped.withColumn("_f", flip).select(
        *keys, F.when(F.col("_f"), F.col("x2")).otherwise(F.col("x1")).alias("x1"), F.when(F.col("_f"), F.col("y2")).otherwise(F.col("y1")).alias("y1"),
        F.when(F.col("_f"), F.col("x1")).otherwise(F.col("x2")).alias("x2"), F.when(F.col("_f"), F.col("y1")).otherwise(F.col("y2")).alias("y2"),
        F.when(F.col("_f"), -F.col("wa")).otherwise(F.col("wa")).alias("wa"), F.when(F.col("_f"), -F.col("wb")).otherwise(F.col("wb")).alias("wb"), "ln",
    )
    return turned.groupBy(*keys, *SEG).agg(*[F.sum(w).alias(w) for w in WEIGHTS])


def _grid(segs: DataFrame, keys: list[str], per_cell: int = PER_CELL) -> DataFrame:
    """Cell size and origin per key, ``_across`` cells a side; a small key gets one cell."""
    x_lo, x_hi = _slant("x1", "y1"), _slant("x2", "y2")
    ext = segs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(x_lo).alias("lx"), F.max(x_hi).alias("hx"),
        F.min(F.least("y1", "y2")).alias("ly"), F.max(F.greatest("y1", "y2")).alias("hy"),
    )
    side = F.greatest(F.col("hx") - F.col("lx"), F.col("hy") - F.col("ly"), F.lit(1e-9))
    small = F.col("n") < 4 * PER_CELL
    ext = ext.withColumn("_across", F.when(small, F.lit(1)).otherwise(F.floor(F.sqrt(F.col("n") / per_cell))))
    ext = ext.withColumn("_s", side * F.when(small, 3.0).otherwise(1.0) / F.col("_across"))
    # an odd offset keeps vertices off the grid lines
    return ext.select(
        *keys, "_s", (F.col("lx") - F.col("_s") * 0.381966).alias("_ox"), (F.col("ly") - F.col("_s") * 0.414214).alias("_oy"), "_across"
    )


def _bin(df: DataFrame, pad: float) -> DataFrame:
    """One row per grid cell that a segment passes through."""
    s, ox, oy = F.col("_s"), F.col("_ox"), F.col("_oy")
    xa, xb = _slant("x1", "y1"), _slant("x2", "y2")
    ya, yb = F.least("y1", "y2"), F.greatest("y1", "y2")
    at = df.withColumn("_cx", F.explode(F.sequence(F.floor((xa - pad - ox) / s), F.floor((xb + pad - ox) / s))))
    at = at.withColumn("_cy", F.explode(F.sequence(F.floor((ya - pad - oy) / s), F.floor((yb + pad - oy) / s))))
    mx, my = ox + (F.col("_cx") + 0.5) * s - xa, oy + (F.col("_cy") + 0.5) * s - F.col("y1")
    dx, dy = xb - xa, F.col("y2") - F.col("y1")
    return at.where(F.abs(dx * my - dy * mx) <= (s * 0.7072 + pad) * F.hypot(dx, dy))


def binned(segs: DataFrame, keys: list[str]) -> DataFrame:
    """``segs`` once for each grid cell that they pass through, ``_cx, _cy``, the cells sized to their key."""
    grid = _grid(segs, keys)
    return _bin(segs.join(grid, keys), 1e-9)


def _tolerance(digits: int) -> float:
    """How near to a segment a point touches it."""
    return 2 * 10.0**-digits


def _walls(lines: DataFrame, keys: list[str], sign: int = 1) -> DataFrame:
    """Where gridded segments cross the grid's upright lines: ``keys, _cx, _cy, ka, kb``, the steps of the counts at the cells' corners."""
    s, ox, oy = F.col("_s"), F.col("_ox"), F.col("_oy")
    first, last = F.ceil((_slant("x1", "y1") - ox) / s), F.ceil((_slant("x2", "y2") - ox) / s) - 1
    lines = lines.where("wa <> 0 or wb <> 0").withColumns({"_f": first, "_l": last}).where("_f <= _l")
    lines = lines.withColumn("_cx", F.explode(F.sequence("_f", "_l")))
    run = _slant("x2", "y2") - _slant("x1", "y1")
    hit = F.col("y1") + F.try_divide(ox + F.col("_cx") * s - _slant("x1", "y1"), run) * (F.col("y2") - F.col("y1"))
    return lines.select(*keys, "_cx", (F.floor((hit - oy) / s) - 1).alias("_cy"), (F.col("wa") * -sign).alias("ka"), (F.col("wb") * -sign).alias("kb"))


def _corners(steps: DataFrame, keys: list[str], *others: str) -> DataFrame:
    """Running sums of ``steps``, one a cell: ``ka, kb``, how many A and B shapes lie over the cell's upper left corner."""
    down = Window.partitionBy(*keys, "_cx").orderBy(F.desc("_cy"))
    return steps.select(*keys, *CELL, *others, F.sum("ka").over(down).alias("ka"), F.sum("kb").over(down).alias("kb"))


def _losses(segs: DataFrame, keys: list[str], digits: int) -> DataFrame:
    """The steps of ``_corners`` in all cells, with ``_loss`` in those that a segment passes; ``segs`` are gridded.

    On the way from a cell's upper left corner to any point in it, first along its upper side and then down, a
    segment of the cell takes away the A shapes above it or adds those below; a falling one that leaves through the
    upper side may do the reverse.  No point of the cell lies under fewer A shapes than its corner less ``_loss``.
    """
    at = _bin(segs.where("wa <> 0 or wb <> 0 or ln <> 0"), _tolerance(digits))
    top = F.col("_oy") + (F.col("_cy") + 1) * F.col("_s")
    either = (F.col("y1") >= top) & (F.col("y2") <= top)
    loss = F.when(either, F.abs("wa")).otherwise(F.greatest(F.col("wa"), F.lit(0)))
    none = F.lit(0).cast("long")
    passed = at.select(*keys, *CELL, none.alias("ka"), none.alias("kb"), loss.alias("_loss"))
    walls = _walls(segs, keys).withColumn("_loss", F.lit(None).cast("long"))
    return passed.unionByName(walls).groupBy(*keys, *CELL).agg(*[F.sum(c).alias(c) for c in ("ka", "kb", "_loss")])


def _split(segs: DataFrame, keys: list[str], digits: int, outer: DataFrame | None = None) -> DataFrame:
    """Cut every segment where another crosses or touches it, with ``outer`` at least where they do so in its cells."""
    tol = _tolerance(digits)
    binned = _bin(segs, tol)
    cell = [*keys, *CELL]
    if outer is not None:
        binned = binned.join(outer, cell, "left_semi")
    left = binned.select(*cell, *[F.col(c).alias("a_" + c) for c in SEG])
    right = binned.select(*cell, *[F.col(c).alias("b_" + c) for c in SEG])
    pairs = left.join(right, cell).where(
        "struct(a_x1, a_y1, a_x2, a_y2) < struct(b_x1, b_y1, b_x2, b_y2)"
        f" and greatest(a_x1, a_x2) + {tol} >= least(b_x1, b_x2) and greatest(b_x1, b_x2) + {tol} >= least(a_x1, a_x2)"
        f" and greatest(a_y1, a_y2) + {tol} >= least(b_y1, b_y2) and greatest(b_y1, b_y2) + {tol} >= least(a_y1, a_y2)"
    )

    def touch(seg: str, px: str, py: str) -> str:
        """A point on a segment but not at its ends."""
        dx, dy = f"({seg}_x2 - {seg}_x1)", f"({seg}_y2 - {seg}_y1)"
        ux, uy = f"({px} - {seg}_x1)", f"({py} - {seg}_y1)"
        dot, norm = f"({ux} * {dx} + {uy} * {dy})", f"({dx} * {dx} + {dy} * {dy})"
        return (
            f"(abs({ux} * {dy} - {uy} * {dx}) <= {tol} * sqrt({norm}) and {dot} > {tol} * sqrt({norm}) "
            f"and {dot} < {norm} - {tol} * sqrt({norm}))"
        )

    flags = pairs.selectExpr(
        "*", f"{touch('a', 'b_x1', 'b_y1')} as b1", f"{touch('a', 'b_x2', 'b_y2')} as b2",
        f"{touch('b', 'a_x1', 'a_y1')} as a1", f"{touch('b', 'a_x2', 'a_y2')} as a2",
        "((a_x2 - a_x1) * (b_y2 - b_y1) - (a_y2 - a_y1) * (b_x2 - b_x1)) as den",
        "((b_x1 - a_x1) * (b_y2 - b_y1) - (b_y1 - a_y1) * (b_x2 - b_x1)) as num_t",
        "((b_x1 - a_x1) * (a_y2 - a_y1) - (b_y1 - a_y1) * (a_x2 - a_x1)) as num_u",
    )
    p = "struct(round(a_x1 + try_divide(num_t, den) * (a_x2 - a_x1), {0}) + 0.0 as x, round(a_y1 + try_divide(num_t, den) * (a_y2 - a_y1), {0}) + 0.0 as y)".format(digits)
    proper = "not (a1 or a2 or b1 or b2) and den <> 0 and try_divide(num_t, den) > 0 and try_divide(num_t, den) < 1 and try_divide(num_u, den) > 0 and try_divide(num_u, den) < 1"
    a, b = "struct(a_x1 as x1, a_y1 as y1, a_x2 as x2, a_y2 as y2)", "struct(b_x1 as x1, b_y1 as y1, b_x2 as x2, b_y2 as y2)"
    cuts = flags.where(f"a1 or a2 or b1 or b2 or ({proper})").selectExpr(
        *[f"`{k}`" for k in keys],
        f"""explode(filter(array(
          case when b1 then struct({a} as s, struct(b_x1 as x, b_y1 as y) as p) end, case when b2 then struct({a} as s, struct(b_x2 as x, b_y2 as y) as p) end,
          case when a1 then struct({b} as s, struct(a_x1 as x, a_y1 as y) as p) end, case when a2 then struct({b} as s, struct(a_x2 as x, a_y2 as y) as p) end,
          case when {proper} then struct({a} as s, {p} as p) end, case when {proper} then struct({b} as s, {p} as p) end), c -> c is not null)) as c""",
    ).selectExpr(*[f"`{k}`" for k in keys], "c.s.*", "c.p as p")
    none = [F.lit(0).cast("long").alias(w) for w in WEIGHTS]
    rows = segs.select(*keys, *SEG, *WEIGHTS, F.lit(None).cast(G.XY).alias("p")).unionByName(cuts.select(*keys, *SEG, *none, "p"))
    grouped = rows.groupBy(*keys, *SEG).agg(*[F.sum(w).alias(w) for w in WEIGHTS], F.collect_set("p").alias("ps"))
    along = F.expr(
        "transform(array_sort(transform(concat(array(struct(x1 as x, y1 as y), struct(x2 as x, y2 as y)), ps), "
        "q -> struct((q.x - x1) * (x2 - x1) + (q.y - y1) * (y2 - y1) as d, q.x as x, q.y as y))), q -> struct(q.x as x, q.y as y))"
    )
    pieces = grouped.withColumn("_q", along).select(*keys, *WEIGHTS, F.explode(G.path_segments(F.col("_q"))).alias("s"))
    return _canonical(pieces.select(*keys, "s.*", *WEIGHTS), keys, digits)


def _coverage(pieces: DataFrame, keys: list[str], grid: DataFrame, outer: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """Pieces with ``ca, cb``: how many A and B shapes lie just above them.

    With ``outer`` only pieces with their middle in one of its cells; ``more`` are steps of other segments' counts.
    """
    gridded = pieces.join(grid, keys)
    live = _bin(gridded.where("wa <> 0 or wb <> 0"), 0.0)
    s, ox, oy = F.col("_s"), F.col("_ox"), F.col("_oy")
    mx = (_slant("x1", "y1") + _slant("x2", "y2")) / 2
    my = (F.col("y1") + F.col("y2")) / 2
    mids = gridded.withColumns({"_mx": mx, "_my": my}).withColumns(
        {"_cx": F.floor((F.col("_mx") - ox) / s), "_cy": F.floor((F.col("_my") - oy) / s)}
    )
    cell = [*keys, *CELL]
    if outer is not None:
        live, mids = live.join(outer, cell, "left_semi"), mids.join(outer, cell, "left_semi")
    other = live.select(
        *cell, _slant("x1", "y1").alias("sx1"), F.col("y1").alias("sy1"), _slant("x2", "y2").alias("sx2"), F.col("y2").alias("sy2"),
        F.col("x1").alias("ox1"), F.col("x2").alias("ox2"), F.col("wa").alias("va"), F.col("wb").alias("vb"),
    )
    top, edge = oy + (F.col("_cy") + 1) * s, ox + F.col("_cx") * s
    y_at = F.col("sy1") + F.try_divide(F.col("_mx") - F.col("sx1"), F.col("sx2") - F.col("sx1")) * (F.col("sy2") - F.col("sy1"))
    x_at = F.col("sx1") + F.try_divide(top - F.col("sy1"), F.col("sy2") - F.col("sy1")) * (F.col("sx2") - F.col("sx1"))
    me = (F.col("ox1") == F.col("x1")) & (F.col("sy1") == F.col("y1")) & (F.col("ox2") == F.col("x2")) & (F.col("sy2") == F.col("y2"))
    over = (F.col("sx1") <= F.col("_mx")) & (F.col("_mx") < F.col("sx2")) & ~me & (y_at > F.col("_my")) & (y_at <= top)
    rising = (F.col("sy1") <= top) & (F.col("sy2") > top)
    falling = (F.col("sy2") <= top) & (F.col("sy1") > top)
    beside = (rising | falling) & (x_at > edge) & (x_at <= F.col("_mx"))
    step = F.when(over, -1).otherwise(0) - F.when(beside & rising, 1).when(beside & falling, -1).otherwise(0)
    local = mids.select(*cell, *SEG, "_mx", "_my", "_s", "_ox", "_oy").join(other, cell)
    local = local.withColumn("_t", step).where("_t <> 0").groupBy(*keys, *SEG).agg(
        F.sum(F.col("_t") * F.col("va")).alias("la"), F.sum(F.col("_t") * F.col("vb")).alias("lb")
    )
    # counts at the upper left corner of every cell in use, from crossings of the grid lines
    used = mids.select(*cell, F.lit(0).cast("long").alias("ka"), F.lit(0).cast("long").alias("kb"))
    steps = used.unionByName(_walls(gridded, keys))
    if more is not None:
        steps = steps.unionByName(more)
    corners = _corners(steps.groupBy(*cell).agg(F.sum("ka").alias("ka"), F.sum("kb").alias("kb")), keys)
    out = mids.join(corners, cell).join(local, [*keys, *SEG], "left")
    return out.select(
        *keys, *SEG, *WEIGHTS, (F.col("ka") + F.coalesce("la", F.lit(0))).alias("ca"), (F.col("kb") + F.coalesce("lb", F.lit(0))).alias("cb")
    )


def _covered(segs: DataFrame, keys: list[str], digits: int, union: bool = False) -> DataFrame:
    """Pieces with their coverage; ``union`` leaves out those known to lie inside the A shapes."""
    # each step is read several times by the next one, so it is written once
    merged = cut_lineage(_canonical(segs, keys, digits))
    grid = cut_lineage(_grid(merged, keys, PER_UNION_CELL if union else PER_CELL))
    gridded = merged.join(grid, keys)
    if not union or grid.where("_across > 1").isEmpty():
        pieces = cut_lineage(_split(gridded, keys, digits))
        return _coverage(pieces, keys, grid)
    # cells with a point that may lie outside; a piece that reaches from one of them into another cell was cut at all
    # that crosses it on the way, so all of it lies inside
    steps = cut_lineage(_losses(gridded, keys, digits))
    outer = cut_lineage(_corners(steps, keys, "_loss").where("ka <= _loss").select(*keys, *CELL))
    near = cut_lineage(_bin(gridded, _tolerance(digits)).join(outer, [*keys, *CELL], "left_semi").select(*gridded.columns).dropDuplicates([*keys, *SEG]))
    pieces = cut_lineage(_split(near, keys, digits, outer))
    # the counts' steps of the segments that were not cut
    rest = steps.select(*keys, *CELL, "ka", "kb").unionByName(_walls(near, keys, -1))
    return _coverage(pieces, keys, grid, outer, rest)


def boundary_edges(segs: DataFrame, keys: list[str], rule: str, digits: int = 9) -> DataFrame:
    """Directed boundary edges of the result, interior on the left; no geometry is built."""
    test = RULES[rule]
    covered = _covered(segs, keys, digits, rule == "union")
    up = test(F.col("ca"), F.col("cb"))
    down = test(F.col("ca") - F.col("wa"), F.col("cb") - F.col("wb"))
    edge = covered.withColumns({"_up": up, "_down": down}).where("_up <> _down")
    flip = ~F.col("_up")
    return edge.select(
        *keys, F.when(flip, F.col("x2")).otherwise(F.col("x1")).alias("x1"), F.when(flip, F.col("y2")).otherwise(F.col("y1")).alias("y1"),
        F.when(flip, F.col("x1")).otherwise(F.col("x2")).alias("x2"), F.when(flip, F.col("y1")).otherwise(F.col("y2")).alias("y2"),
    )


def arrange(segs: DataFrame, keys: list[str], rule: str, digits: int = 9) -> DataFrame:
    """One polygonal geometry per key; keys whose result is empty have no row."""
    return link_rings(boundary_edges(segs, keys, rule, digits), keys, eps=1e-12)


def arranged_area(segs: DataFrame, keys: list[str], rule: str, digits: int = 9) -> DataFrame:
    """The result's area per key, from its edges alone: a plain sum at any size."""
    e = boundary_edges(segs, keys, rule, digits)
    return e.groupBy(*keys).agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"))


def clip_lines(segs: DataFrame, keys: list[str], digits: int = 9, outline: bool = True) -> DataFrame:
    """Line pieces covered by the B shapes, chained again per key; those along the outline of their union stay with ``outline``."""
    above, below = F.col("cb") > 0, F.col("cb") - F.col("wb") > 0
    inside = above | below if outline else above & below
    kept = _covered(segs, keys, digits).where((F.col("ln") > 0) & inside)
    types = dict(kept.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", paths array<array<array<double>>>"

    def link(key, pdf: pd.DataFrame) -> pd.DataFrame:
        ends = [((a, b), (c, d)) for a, b, c, d in pdf[list(SEG)].itertuples(index=False)]
        degree = pd.Series([e for pair in ends for e in pair]).value_counts()
        # a node where more than two pieces meet ends the paths there
        name = lambda i, e: e if degree[e] <= 2 else (*e, i)
        starts = [name(2 * i, s) for i, (s, _) in enumerate(ends)]
        stops = [name(2 * i + 1, t) for i, (_, t) in enumerate(ends)]
        chains = join_chains(starts, stops, [[s, t] for s, t in ends])
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "paths": [[[list(p) for p in c[2]] for c in chains]]})

    out = kept.select(*keys, *SEG).groupBy(*keys).applyInPandas(link, schema)
    parts = F.transform("paths", lambda p: F.struct(F.array(F.transform(p, lambda v: G.xy(v[0], v[1]))).alias("rings")))
    kind = F.when(F.size("paths") == 1, "LineString").otherwise("MultiLineString")
    return out.select(*keys, G.make(kind, parts).alias("geom"))


def digits_for(srid: int | None) -> int:
    """Snapping places: 9 in degrees, 6 in metres."""
    return 9 if srid in (None, 4326) else 6


