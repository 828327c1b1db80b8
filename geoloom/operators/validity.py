"""Validity of polygons, ring by ring, as joins.

Segments of one feature meet in grid cells, so an outline of any length is tested against its own neighbourhood only.
Where no segments clash, every ring lies wholly inside or outside every other, and one point of it
tells: rings whose boxes overlap are joined by bins, and the nesting of shells and holes follows from who
lies inside whom.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom as G
from ..functions import predicates as P
from ..session import cut_lineage
from . import arrangement as A
from .joins import candidate_pairs

CLASH, OUTSIDE, HOLES, SHELLS = "Self-intersection", "Hole lies outside shell", "Holes are nested", "Nested shells"


def _rings(df: DataFrame, key: str, geom: str) -> DataFrame:
    """``key, part, ring, v``: the closed rings of polygons without repeated vertices."""
    parts = df.where(G.is_polygonal(F.col(geom))).select(F.col(key).alias("key"), F.posexplode(F.col(geom)["parts"]).alias("part", "_p"))
    rings = parts.select("key", "part", F.posexplode(F.col("_p")["rings"]).alias("ring", "v"))
    steps = F.filter("v", lambda p, i: (i == 0) | (p != F.get("v", i - 1)))
    return rings.select("key", "part", "ring", steps.alias("v"))


def _clashes(rings: DataFrame) -> DataFrame:
    """``key`` of the features with segments that cross, lie on each other, or touch within one ring but for neighbours."""
    n = F.size("v") - 1
    segs = rings.withColumn("n", n).where("n > 0").select(
        "key", "part", "ring", "n", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("v", i).alias("p"), F.get("v", i + 1).alias("q")))).alias("i", "s")
    )
    segs = segs.select("key", "part", "ring", "n", "i", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"))
    segs = cut_lineage(segs)
    binned = A.binned(segs, ["key"])
    own = [c for c in segs.columns if c != "key"]
    left = binned.select("key", "_cx", "_cy", F.struct(*own).alias("s"))
    right = binned.select("key", "_cx", "_cy", F.struct(*own).alias("t"))
    next_to = "((t.i = s.i + 1) or (s.i = 0 and t.i = s.n - 1))"
    same = "(s.part = t.part and s.ring = t.ring)"
    # along each other: both ends of one on the line of the other, and more than a point in common
    along = (
        f"({P.side('s', 't.x1', 't.y1')} = 0 and {P.side('s', 't.x2', 't.y2')} = 0 and "
        "case when s.x1 <> s.x2 then least(greatest(s.x1, s.x2), greatest(t.x1, t.x2)) > greatest(least(s.x1, s.x2), least(t.x1, t.x2)) "
        "else least(greatest(s.y1, s.y2), greatest(t.y1, t.y2)) > greatest(least(s.y1, s.y2), least(t.y1, t.y2)) end)"
    )
    first = "struct(s.part, s.ring, s.i) < struct(t.part, t.ring, t.i)"
    clash = f"{P.crosses('s', 't')} or {along} or ({same} and not {next_to} and {P.meets('s', 't')})"
    return left.join(right, ["key", "_cx", "_cy"]).where(first).where(clash).select("key").distinct()


def _inside(rings: DataFrame) -> DataFrame:
    """``key, pa, ra, pb, rb``: ring a of a feature lies inside ring b of it; rings do not cross."""
    boxed = rings.select(
        "key", "part", "ring", "v", F.array_min("v.x").alias("minx"), F.array_min("v.y").alias("miny"), F.array_max("v.x").alias("maxx"), F.array_max("v.y").alias("maxy")
    )

    def side(p: str, names: tuple[str, str, str]) -> DataFrame:
        return boxed.select("key", *(F.col(c).alias(a) for c, a in zip(("part", "ring", "v"), names)), *(F.col(c).alias(f"{p}_{c}") for c in G.BBOX))

    pairs = candidate_pairs(side("l", ("pa", "ra", "va")), side("r", ("pb", "rb", "vb")), ["key"]).where("not (pa = pb and ra = rb)")
    pairs = pairs.where("l_minx >= r_minx and l_maxx <= r_maxx and l_miny >= r_miny and l_maxy <= r_maxy")
    pairs = pairs.withColumn("g", G.polygon(F.col("vb")))
    # a point of a that is not on b: a vertex, or the middle of an edge
    middles = "transform(sequence(0, size(va) - 2), i -> struct((va[i].x + va[i + 1].x) / 2 as x, (va[i].y + va[i + 1].y) / 2 as y))"
    told = f"array_max(filter(transform(concat(va, {middles}), p -> {{}}), w -> w <> 0))"
    test = P.let(P.outline("g"), lambda o: told.format(P.place("p.x", "p.y", o)))
    return pairs.where(f"coalesce({test}, 0) = 1").select("key", "pa", "ra", "pb", "rb")


def reasons(df: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """``key, reason`` of every invalid feature; ``key`` is unique.  NULL and empty geometries are no invalid ones."""
    shape = df.select(F.col(key).alias("key"), F.expr(P.shape_reason(geom)).alias("reason"), F.col(geom).alias("geom"))
    simple = shape.where("reason is not null").select("key", "reason")
    rings = cut_lineage(_rings(shape.where("reason is null"), "key", "geom"))
    clash = cut_lineage(_clashes(rings))
    clear = rings.join(clash, "key", "left_anti")
    several = clear.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    clear = cut_lineage(clear.join(several, "key", "left_semi"))
    inside = cut_lineage(_inside(clear))
    held = inside.where("ra > 0 and pa = pb and rb = 0").select("key", F.col("pa").alias("part"), F.col("ra").alias("ring"))
    outside = clear.where("ring > 0").select("key", "part", "ring").join(held, ["key", "part", "ring"], "left_anti").select("key")
    holes = inside.where("ra > 0 and rb > 0 and pa = pb").select("key")
    in_hole = inside.where("ra = 0 and rb > 0").select("key", "pa", "pb")
    shells = inside.where("ra = 0 and rb = 0").select("key", "pa", "pb").join(in_hole, ["key", "pa", "pb"], "left_anti").select("key")
    found = clash.withColumn("w", F.lit(0))
    for i, part in enumerate((outside, holes, shells), 1):
        found = found.unionByName(part.withColumn("w", F.lit(i)))
    names = F.array(*map(F.lit, (CLASH, OUTSIDE, HOLES, SHELLS)))
    ranked = found.groupBy("key").agg(F.min("w").alias("w")).select("key", F.get(names, F.col("w")).alias("reason"))
    return simple.unionByName(ranked).withColumnRenamed("key", key)


def with_reasons(df: DataFrame, geom: str = "geom", key: str | None = None) -> DataFrame:
    """``df`` with ``reason``, NULL where the geometry is valid or empty; without a ``key`` rows are numbered first."""
    own = "_row" if key is None else key
    base = df if key else cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    found = cut_lineage(reasons(base, own, geom))
    out = base.join(found, own, "left")
    return out.drop("_row") if key is None else out

