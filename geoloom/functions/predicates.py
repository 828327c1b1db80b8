"""Exact geometry tests as SQL expressions.

Each function takes SQL texts (column names or expressions) and returns SQL text;
``F.expr`` turns it into a column.  Text keeps these long expressions to one parse,
where building the same tree call by call from Python costs seconds per query.
``let`` binds a sub-expression once, so an outline is built once per pair and not
once per tested vertex.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

_names = count()


def _var(prefix: str) -> str:
    return f"{prefix}_{next(_names)}"


def let(value: str, body) -> str:
    v = _var("v")
    return f"get(transform(array({value}), {v} -> {body(v)}), 0)"


def exists(array: str, test) -> str:
    v = _var("e")
    return f"exists({array}, {v} -> {test(v)})"


def forall(array: str, test) -> str:
    v = _var("a")
    return f"forall({array}, {v} -> {test(v)})"


def filtered(array: str, test) -> str:
    v = _var("f")
    return f"filter({array}, {v} -> {test(v)})"


def rings(g: str) -> str:
    return f"flatten({g}.parts.rings)"


def vertices(g: str) -> str:
    return f"flatten({rings(g)})"


def segments(g: str) -> str:
    r, a, b = _var("r"), _var("p"), _var("q")
    n = f"greatest(size({r}) - 1, 0)"
    return (
        f"flatten(transform({rings(g)}, {r} -> zip_with(slice({r}, 1, {n}), slice({r}, 2, {n}), "
        f"({a}, {b}) -> struct({a}.x as x1, {a}.y as y1, {b}.x as x2, {b}.y as y2))))"
    )


def polygonal(kind: str) -> str:
    return f"{kind} in ('Polygon', 'MultiPolygon')"


def linear(kind: str) -> str:
    return f"{kind} in ('LineString', 'MultiLineString')"


def dots(kind: str) -> str:
    return f"{kind} in ('Point', 'MultiPoint')"


def outline(g: str) -> str:
    """What the tests need of a geometry: its segments, vertices and kind."""
    return f"struct({segments(g)} as s, {vertices(g)} as v, {polygonal(g + '.type')} as areal, {g}.type as type)"


def side(s: str, px: str, py: str) -> str:
    return f"(({s}.x2 - {s}.x1) * ({py} - {s}.y1) - ({s}.y2 - {s}.y1) * ({px} - {s}.x1))"


def on_segment(px: str, py: str, s: str) -> str:
    return (
        f"({side(s, px, py)} = 0 and {px} between least({s}.x1, {s}.x2) and greatest({s}.x1, {s}.x2)"
        f" and {py} between least({s}.y1, {s}.y2) and greatest({s}.y1, {s}.y2))"
    )


def ray_crosses(px: str, py: str, s: str) -> str:
    """Whether a ray from the point towards +x crosses the segment (half-open rule)."""
    return (
        f"((({s}.y1 > {py}) != ({s}.y2 > {py})) and "
        f"{px} < ({s}.x2 - {s}.x1) * ({py} - {s}.y1) / ({s}.y2 - {s}.y1) + {s}.x1)"
    )


def place(px: str, py: str, o: str) -> str:
    """1 inside a polygon, 0 on a boundary, path or point, -1 elsewhere; ``o`` is an outline."""
    touching = exists(f"{o}.s", lambda s: on_segment(px, py, s))
    same = exists(f"{o}.v", lambda v: f"({v}.x = {px} and {v}.y = {py})")
    crossings = filtered(f"{o}.s", lambda s: ray_crosses(px, py, s))
    return f"case when {touching} or {same} then 0 when {o}.areal and size({crossings}) % 2 = 1 then 1 else -1 end"


def locate(px: str, py: str, g: str) -> str:
    return let(outline(g), lambda o: place(px, py, o))


def crosses(s: str, t: str) -> str:
    """Proper crossing: the two segments share one point interior to both."""
    return (
        f"(signum({side(s, t + '.x1', t + '.y1')}) * signum({side(s, t + '.x2', t + '.y2')}) < 0 and "
        f"signum({side(t, s + '.x1', s + '.y1')}) * signum({side(t, s + '.x2', s + '.y2')}) < 0)"
    )


def meets(s: str, t: str) -> str:
    return (
        f"({crosses(s, t)} or {on_segment(t + '.x1', t + '.y1', s)} or {on_segment(t + '.x2', t + '.y2', s)}"
        f" or {on_segment(s + '.x1', s + '.y1', t)} or {on_segment(s + '.x2', s + '.y2', t)})"
    )


def boxes_meet(a: str, b: str) -> str:
    """Boxes as column prefixes: ``l_`` stands for l_minx, l_miny, l_maxx, l_maxy."""
    return f"({a}minx <= {b}maxx and {a}maxx >= {b}minx and {a}miny <= {b}maxy and {a}maxy >= {b}miny)"


def box_inside(a: str, b: str) -> str:
    return f"({a}minx >= {b}minx and {a}maxx <= {b}maxx and {a}miny >= {b}miny and {a}maxy <= {b}maxy)"


def near(segs: str, box: str) -> str:
    """The segments that meet a box; keeps pair tests short on long outlines."""
    return filtered(
        segs,
        lambda s: f"(least({s}.x1, {s}.x2) <= {box}maxx and greatest({s}.x1, {s}.x2) >= {box}minx"
        f" and least({s}.y1, {s}.y2) <= {box}maxy and greatest({s}.y1, {s}.y2) >= {box}miny)",
    )


def intersects(a: str, b: str, ba: str, bb: str) -> str:
    """The two geometries share at least one point."""

    def seen(v: str, o: str) -> str:
        return f"{place(v + '.x', v + '.y', o)} >= 0"

    def test(p: str, q: str) -> str:
        edges = let(
            near(f"{q}.s", ba),
            lambda ts: exists(near(f"{p}.s", bb), lambda s: exists(ts, lambda t: meets(s, t))),
        )
        return f"({exists(p + '.v', lambda v: seen(v, q))} or {exists(q + '.v', lambda v: seen(v, p))} or {edges})"

    exact = let(outline(a), lambda p: let(outline(b), lambda q: test(p, q)))
    return f"coalesce({boxes_meet(ba, bb)} and {exact}, false)"


def within(a: str, b: str, ba: str, bb: str) -> str:
    """``a`` inside ``b`` with interiors meeting: boundary contact alone is not enough."""

    def test(p: str, q: str) -> str:
        m = _var("m")
        middle = f"transform({p}.s, {m} -> struct(({m}.x1 + {m}.x2) / 2 as x, ({m}.y1 + {m}.y2) / 2 as y))"
        w = _var("w")
        places = f"transform(concat({p}.v, {middle}), {w} -> {place(w + '.x', w + '.y', q)})"
        no_cross = let(
            near(f"{q}.s", ba), lambda ts: f"not {exists(p + '.s', lambda s: exists(ts, lambda t: crosses(s, t)))}"
        )
        corners = filtered(
            f"{q}.v", lambda v: f"{v}.x between {ba}minx and {ba}maxx and {v}.y between {ba}miny and {ba}maxy"
        )
        holds_corner = exists(corners, lambda v: f"{place(v + '.x', v + '.y', p)} = 1")
        r = _var("r")
        ends = f"flatten(transform({rings(b)}, {r} -> array(get({r}, 0), element_at({r}, -1))))"
        at_ends = forall(f"{p}.v", lambda v: f"array_contains({ends}, {v})")

        def judged(pl: str) -> str:
            covered = f"({forall(pl, lambda k: k + ' >= 0')} and {no_cross})"
            return (
                f"case when {p}.areal and {q}.areal then {covered} and not {holds_corner}"
                f" when {q}.areal then {covered} and {exists(pl, lambda k: k + ' = 1')}"
                f" when ({linear(p + '.type')} and {linear(q + '.type')}) or ({dots(p + '.type')} and {dots(q + '.type')}) then {covered}"
                f" when {dots(p + '.type')} and {linear(q + '.type')} then {covered} and not {at_ends} else false end"
            )

        return let(places, judged)

    exact = let(outline(a), lambda p: let(outline(b), lambda q: test(p, q)))
    return f"coalesce({box_inside(ba, bb)} and {exact}, false)"


def contains(a: str, b: str, ba: str, bb: str) -> str:
    return within(b, a, bb, ba)


def is_rectangle(g: str) -> str:
    """Whether a polygon is exactly its own bounding box."""

    def test(v: str) -> str:
        box = (
            f"struct(array_min({v}.x) as minx, array_min({v}.y) as miny, array_max({v}.x) as maxx, array_max({v}.y) as maxy)"
        )

        def corners(b: str) -> str:
            turns = (
                f"(get({v}, 0).x = get({v}, 1).x) != (get({v}, 1).x = get({v}, 2).x) and get({v}, 0) != get({v}, 2)"
                f" and get({v}, 1) != get({v}, 3)"
            )
            on = forall(v, lambda p: f"({p}.x = {b}.minx or {p}.x = {b}.maxx) and ({p}.y = {b}.miny or {p}.y = {b}.maxy)")
            return f"({on} and {turns} and {b}.minx < {b}.maxx and {b}.miny < {b}.maxy)"

        return f"(size({v}) = 5 and {let(box, corners)})"

    return f"coalesce({g}.type = 'Polygon' and size({rings(g)}) = 1 and {let(vertices(g), test)}, false)"


def shape_reason(g: str) -> str:
    """Why the rings or paths of a geometry are none; NULL otherwise, or when it is empty."""
    short = exists(rings(g), lambda q: f"size({q}) < 4")
    stub = exists(rings(g), lambda q: f"size({q}) < 2")
    opened = exists(rings(g), lambda q: f"get({q}, 0) != element_at({q}, -1)")
    few = "'Too few points in geometry component'"
    return (
        f"case when {g} is null or coalesce(size({vertices(g)}), 0) <= 0 then null"
        f" when {linear(g + '.type')} and {stub} then {few}"
        f" when not ({polygonal(g + '.type')}) then null when {short} then {few} when {opened} then 'Ring is not closed' end"
    )


def invalid_reason(g: str) -> str:
    """Why one short outline is invalid, by all pairs of its segments; ``validity.reasons`` tests whole layers."""
    r, k, s, i = _var("r"), _var("k"), _var("s"), _var("i")
    a, b = _var("p"), _var("q")
    n = f"greatest(size({r}) - 1, 0)"
    numbered = (
        f"flatten(transform({rings(g)}, ({r}, {k}) -> transform(zip_with(slice({r}, 1, {n}), slice({r}, 2, {n}), "
        f"({a}, {b}) -> struct({a}.x as x1, {a}.y as y1, {b}.x as x2, {b}.y as y2)), "
        f"({s}, {i}) -> struct({s}.x1 as x1, {s}.y1 as y1, {s}.x2 as x2, {s}.y2 as y2, {k} as k, {i} as i, {n} as n))))"
    )

    def clash(s: str, t: str) -> str:
        next_to = f"({t}.i = {s}.i + 1 or ({s}.i = 0 and {t}.i = {s}.n - 1))"
        overlap = (
            f"greatest({s}.x1, {s}.x2) >= least({t}.x1, {t}.x2) and greatest({t}.x1, {t}.x2) >= least({s}.x1, {s}.x2)"
            f" and greatest({s}.y1, {s}.y2) >= least({t}.y1, {t}.y2) and greatest({t}.y1, {t}.y2) >= least({s}.y1, {s}.y2)"
        )
        return (
            f"(({s}.k < {t}.k or ({s}.k = {t}.k and {s}.i < {t}.i)) and {overlap} and "
            f"({crosses(s, t)} or ({s}.k = {t}.k and not {next_to} and {meets(s, t)})))"
        )

    crossing = let(numbered, lambda segs: exists(segs, lambda s: exists(segs, lambda t: clash(s, t))))
    return f"coalesce({shape_reason(g)}, case when {polygonal(g + '.type')} and {crossing} then 'Self-intersection' end)"


def as_column(text: str) -> Column:
    return F.expr(text)
