"""Exact greedy non-maximum suppression as rounds of grouped maxima.

Greedy suppression keeps the best box, removes what overlaps it too much and goes on.
A box that is the best of everything it could overlap is kept whatever happens
elsewhere, so a round keeps all those local winners at once:

1. every live box is shrunk about its centre by the threshold and binned at grid levels
   that fit its size: two boxes that overlap by more than t still meet when both sides
   are cut to (1 - t) of their length, so they always share a cell;
2. the best box of each cell is a grouped maximum (combined before the shuffle);
3. a box that wins all of its cells is kept;
4. each cell then has at most one kept box, and live boxes are tested against it.

No pair list is built: the work of a round is linear in the live boxes, also where a
third of them lie on one spot.  Identical boxes are first reduced to their best one,
which cannot change the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import cell_index, grid_level

BOX = ("x0", "y0", "x1", "y1")


def box_area(p: str) -> Column:
    return F.greatest(F.col(p + "x1") - F.col(p + "x0"), F.lit(0.0)) * F.greatest(F.col(p + "y1") - F.col(p + "y0"), F.lit(0.0))


def iou(a: str = "a_", b: str = "b_") -> Column:
    """IoU of two boxes in prefixed columns; 0 without overlap."""
    w = F.least(a + "x1", b + "x1") - F.greatest(a + "x0", b + "x0")
    h = F.least(a + "y1", b + "y1") - F.greatest(a + "y0", b + "y0")
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = box_area(a) + box_area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def greedy_nms(
    boxes: DataFrame, threshold: float = 0.5, group: list[str] | None = None, score: str = "score", order: str = "id"
) -> DataFrame:
    """The rows kept by greedy suppression: best score first, ties by the lower ``order``.

    ``group`` (a class, an image) limits suppression to equal values; a box is removed
    when its IoU with a kept one is strictly greater than the threshold.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    group = group or []
    rank = F.struct(F.col(score).cast("double").alias("score"), (-F.col(order)).alias("order"))
    slim = boxes.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], F.col(order).alias("id"), *[F.col(c).cast("double").alias(c) for c in BOX], rank.alias("rank"))
    gs = [f"g{i}" for i in range(len(group))]
    flat = slim.where((F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0"))).select("id")
    solid = slim.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    if threshold >= 1:
        return boxes
    # copies of one box: only the best can survive
    live = solid.groupBy(*gs, *BOX).agg(F.max("rank").alias("rank")).withColumn("id", -F.col("rank.order"))
    half = (1 - threshold) * (1 + 1e-9) / 2
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    live = live.withColumns({"sx0": cx - w * half, "sy0": cy - h * half, "sx1": cx + w * half, "sy1": cy + h * half})
    level = grid_level(F.col("sx1") - F.col("sx0"), F.col("sy1") - F.col("sy0"))
    # boxes overlapping by more than t differ in size by at most 1/t
    reach = math.ceil(math.log2(1 / threshold)) if threshold > 0 else None
    if reach is None:
        top = live.agg(F.max(level).alias("l")).first()[0]
        levels = F.sequence(level, F.lit(top if top is not None else 0))
    else:
        levels = F.sequence(level, level + reach)
    live = cut_lineage(live.withColumn("levels", levels))
    kept = None
    while True:  # the best live box of all wins its cells, so every round keeps one at least
        binned = live.withColumn("lv", F.explode("levels"))
        binned = binned.withColumn("cx", F.explode(F.sequence(cell_index(F.col("lv"), F.col("sx0")), cell_index(F.col("lv"), F.col("sx1")))))
        binned = binned.withColumn("cy", F.explode(F.sequence(cell_index(F.col("lv"), F.col("sy0")), cell_index(F.col("lv"), F.col("sy1")))))
        cell = [*gs, "lv", "cx", "cy"]
        best = binned.groupBy(*cell).agg(F.max(F.struct("rank", "id", *BOX)).alias("b"))
        wins = best.groupBy("b.id").agg(F.count(F.lit(1)).alias("won"))
        spans = F.aggregate(
            "levels", F.lit(0).cast("long"),
            lambda acc, v: acc
            + (cell_index(v, F.col("sx1")) - cell_index(v, F.col("sx0")) + 1) * (cell_index(v, F.col("sy1")) - cell_index(v, F.col("sy0")) + 1),
        )
        winners = live.withColumn("need", spans).join(wins, "id").where("won = need").select("id")
        winners = cut_lineage(winners)
        kept = winners if kept is None else kept.unionByName(winners)
        # at most one winner per cell: the cell's best
        champions = best.withColumn("id", F.col("b.id")).join(winners, "id").select(*cell, *[F.col(f"b.{c}").alias("b_" + c) for c in BOX])
        hit = binned.select(*cell, "id", *[F.col(c).alias("a_" + c) for c in BOX]).join(champions, cell).where(iou() > threshold)
        gone = hit.select("id").unionByName(winners).distinct()
        live = cut_lineage(live.join(gone, "id", "left_anti"))
        if live.isEmpty():
            break
    keep = flat if kept is None else kept.unionByName(flat)
    return boxes.join(keep.select(F.col("id").alias(order)), order, "left_semi")
