"""Paths from pieces that name their successors, at any length.

Every piece has at most one successor and at most one predecessor.  Pieces that stand together are linked
inside a task by list ranking on arrays.  What is left, one piece for each stretch inside a batch, is ordered by
pointer doubling: a self-join on the piece that each one has jumped to so far doubles the distance, so a path
over n stretches takes log2 n rounds, and no task ever sees a whole path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows that are linked together inside a task.
BATCH_ROWS = 1 << 15


def runs(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece the first one of its run, its place in it, and whether the run is closed; -1 ends a run.

    A closed run begins with its least piece.
    """
    n = len(nxt)
    before = np.full(n, -1)
    before[nxt[nxt >= 0]] = np.flatnonzero(nxt >= 0)

    def back(before):
        jump, first, place = before.copy(), np.arange(n), (before >= 0).astype(np.int64)
        for _ in range(max(1, n.bit_length())):
            on = np.flatnonzero(jump >= 0)
            if not len(on):
                break
            to = jump[on]
            first[on], place[on], jump[on] = first[to], place[on] + place[to], jump[to]
        return jump, first, place

    jump, first, place = back(before)
    closed = jump >= 0
    if closed.any():
        least, jump = np.arange(n), np.where(closed, before, np.arange(n))
        for _ in range(max(1, n.bit_length())):
            least = np.minimum(least, least[jump])
            jump = jump[jump]
        _, first, place = back(np.where(closed & (least == np.arange(n)), -1, before))
    return first, place, closed


def together(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Record batches put together to tables of at least ``rows`` rows, as long as there are any."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def paths(node: np.ndarray, nxt: np.ndarray, x: np.ndarray, y: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, dict]:
    """The runs of pieces from ``x, y`` to ``x2, y2``: the index of each first piece, and the columns of ``PATH``.

    ``nxt`` holds names of ``node``; a name that is not there ends a run.
    """
    by = np.argsort(node, kind="stable")
    at = np.minimum(np.searchsorted(node[by], nxt), max(len(node) - 1, 0))
    to = np.where(node[by][at] == nxt, by[at], -1) if len(node) else nxt
    first, place, closed = runs(to)
    order = np.lexsort((place, first))
    heads = np.flatnonzero(np.append(True, first[order][1:] != first[order][:-1])) if len(node) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(node))
    last, begin = order[ends - 1], order[heads]
    offsets = pa.array(np.append(heads, len(node)), pa.int32())
    columns = {
        "node": pa.array(node[begin], pa.int64()), "nxt": pa.array(nxt[last], pa.int64()), "closed": pa.array(closed[begin]),
        "xs": pa.ListArray.from_arrays(offsets, pa.array(x[order])), "ys": pa.ListArray.from_arrays(offsets, pa.array(y[order])),
        "ex": pa.array(x2[last]), "ey": pa.array(y2[last]),
    }
    return begin, columns


PATH = "node long, nxt long, closed boolean, xs array<double>, ys array<double>, ex double, ey double"


def linked(pieces: DataFrame, keys: list[str], rows: int = BATCH_ROWS) -> DataFrame:
    """Runs of ``pieces(keys, node, nxt, x1, y1, x2, y2)`` as far as they stand together: ``keys`` and ``PATH``."""
    types = dict(pieces.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), PATH])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in together(batches, rows):
            node, nxt, *ends = (t.column(c).to_numpy() for c in ("node", "nxt", "x1", "y1", "x2", "y2"))
            begin, columns = paths(node, nxt, *ends)
            own = t.select(keys).take(pa.array(begin))
            yield from pa.table({**{k: own.column(k) for k in keys}, **columns}).to_batches(max_chunksize=4096)

    return pieces.select(*keys, "node", "nxt", "x1", "y1", "x2", "y2").mapInArrow(run, schema)


def _to_ends(state: DataFrame, least: bool) -> DataFrame:
    """``state(node, jump)`` with ``last`` and ``d``: the last piece ahead and the number of pieces up to it.

    With ``least`` rounds end once only closed paths are left, whose ``jump`` stays set and whose ``least`` is
    that of the whole path.
    """
    state = state.select("node", "jump", F.col("node").alias("least"), F.col("node").alias("last"), F.lit(1).cast("long").alias("d"))
    open_ = None
    while True:
        ahead = state.select(F.col("node").alias("jump"), F.col("jump").alias("j2"), F.col("least").alias("l2"), F.col("last").alias("t2"), F.col("d").alias("d2"))
        state = state.join(ahead, "jump", "left").select(
            "node", F.col("j2").alias("jump"), F.least("least", "l2").alias("least"), F.coalesce("t2", "last").alias("last"),
            (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"), (F.col("l2") < F.col("least")).alias("fell"),
        )
        state = cut_lineage(state)
        left, fell = state.agg(F.count("jump"), F.count_if(F.col("fell") & F.col("jump").isNotNull())).first()
        if not left or (least and left == open_ and not fell):
            return state
        open_ = left


def ordered(pieces: DataFrame) -> DataFrame:
    """``node, path, place, closed`` for ``pieces(node, nxt)``: places ascend along each path.

    ``nxt`` may name a piece that does not exist, which ends the path.
    """
    state = _to_ends(pieces.select("node", F.col("nxt").alias("jump")), True)
    out = state.where("jump is null").select("node", F.col("last").alias("path"), (-F.col("d")).alias("place"), F.lit(False).alias("closed"))
    around = state.where("jump is not null").select("node", F.col("least").alias("path"))
    if around.isEmpty():
        return out
    cut = around.join(pieces, "node").select("node", "path", F.when(F.col("nxt") != F.col("path"), F.col("nxt")).alias("jump"))
    cut = cut_lineage(cut)
    ranked = _to_ends(cut.select("node", "jump"), False)
    return out.unionByName(ranked.join(cut.select("node", "path"), "node").select("node", "path", (-F.col("d")).alias("place"), F.lit(True).alias("closed")))


def completed(runs_: DataFrame, keys: list[str]) -> DataFrame:
    """Whole paths from the ``runs_`` that ``linked`` gives: ``keys, path, closed, xs, ys, ex, ey``."""
    done = runs_.where("closed").select(*keys, F.col("node").alias("path"), "closed", "xs", "ys", "ex", "ey")
    rest = runs_.where("not closed")
    if rest.isEmpty():
        return done
    placed = rest.drop("closed").join(ordered(rest.select("node", "nxt")), "node")
    row = F.sort_array(F.collect_list(F.struct("place", "xs", "ys", "ex", "ey")))
    whole = placed.groupBy(*keys, "path", "closed").agg(row.alias("_r"))
    whole = whole.select(
        *keys, "path", "closed", F.flatten("_r.xs").alias("xs"), F.flatten("_r.ys").alias("ys"),
        F.element_at("_r", -1)["ex"].alias("ex"), F.element_at("_r", -1)["ey"].alias("ey"),
    )
    return done.unionByName(whole)


def z_code(x: Column, y: Column, low_x: float, low_y: float, side: float, bits: int = 16) -> Column:
    """The place of a point on a space-filling curve over a square."""

    def spread(v: Column, low: float) -> Column:
        n = F.least(F.greatest(F.floor((v - F.lit(low)) * F.lit((1 << bits) / side if side > 0 else 0.0)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return n

    return spread(x, low_x).bitwiseOR(F.shiftleft(spread(y, low_y), 1))


def side_by_side(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """``pieces`` sorted by key and place, so that neighbours share a task and a batch whatever the size of a key."""
    low_x, low_y, high_x, high_y = pieces.agg(F.min("x1"), F.min("y1"), F.max("x1"), F.max("y1")).first()
    if low_x is None:
        return pieces
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    code = z_code(F.col("x1"), F.col("y1"), low_x, low_y, max(high_x - low_x, high_y - low_y))
    dealt = pieces.withColumn("_z", code)
    return dealt.repartitionByRange(n, *keys, "_z").sortWithinPartitions(*keys, "_z").drop("_z")


def per_path(df: DataFrame, keys: list[str], run: Callable[[pa.Table], dict], more: str) -> DataFrame:
    """``run`` over tables of whole paths: its columns beside the ``keys`` and ``path``."""
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "path long", more])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rows, columns = run(t)
            own = t.select([*keys, "path"]).take(rows)
            yield from pa.table({**{k: own.column(k) for k in (*keys, "path")}, **columns}).to_batches()

    return df.mapInArrow(each, schema)
