"""Exact linear-interpolated percentiles, whole-table or per group, by one method at any size.

Equal values of a group count as one weighted row.  These rows are sorted by group and value over all
tasks (by range, so that a large group lies in many of them), running counts give each row its ranks, and
the rows that hold a wanted rank are picked.  No group is ever gathered in one task, and nothing depends on
the spread of the values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def percentile_names(ps) -> list[str]:
    return [f"p{i}" for i in range(len(ps))]


def running_before(counted: DataFrame, order: list[str], weight: str, out: str) -> DataFrame:
    """``counted`` with ``out``: the sum of ``weight`` over all rows that sort before it by ``order``.

    The ranges are stored, so that the sums of whole ranges and the rows inside them agree.
    """
    n = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(counted.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum(weight).alias("_all"))
    # one row a range
    base = sums.select("_range", (F.sum("_all").over(Window.orderBy("_range")) - F.col("_all")).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn(out, F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return placed.join(base, "_range").withColumn(out, F.col(out) + F.col("_base")).drop("_range", "_base")


def group_percentiles(df: DataFrame, keys: list[str], value: str, ps: list[float]) -> DataFrame:
    """One row per key with columns ``p0, p1, ...``, the percentiles ``ps`` (0..1) of ``value``.

    NULL and NaN values are left out; a group without values has no row.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *keys, F.col(value).cast("double").alias("_v")
    )
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = running_before(counts, [*keys, "_v"], "_n", "_before")
    extent = placed.groupBy(*keys).agg(F.min("_before").alias("_first"), F.sum("_n").alias("_total"))
    if keys:
        extent = extent.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
        both = placed.join(extent, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    else:
        both = placed.withColumn("_e", extent.select(F.struct("_first", "_total")).scalar()).select("_v", "_n", "_before", "_e.*")
    start = F.col("_before") - F.col("_first")

    def holds(rank):
        return (rank >= start) & (rank < start + F.col("_n"))

    wanted = [F.lit(float(p)) * (F.col("_total") - 1) for p in ps]
    lows = [F.floor(w) for w in wanted]
    highs = [F.least(low + 1, F.col("_total") - 1) for low in lows]
    any_rank = F.lit(False)
    for rank in (*lows, *highs):
        any_rank = any_rank | holds(rank)
    picked = both.where(any_rank).select(
        *keys, *[w.alias(f"_w{i}") for i, w in enumerate(wanted)],
        *[F.when(holds(r), F.col("_v")).alias(f"_{side}{i}") for side, rs in (("l", lows), ("h", highs)) for i, r in enumerate(rs)],
    )
    out = []
    for i, name in enumerate(percentile_names(ps)):
        low, high, rank = F.max(f"_l{i}"), F.max(f"_h{i}"), F.max(f"_w{i}")
        out.append((low + (high - low) * (rank - F.floor(rank))).alias(name))
    grouped = picked.groupBy(*keys).agg(*out)
    return grouped if keys else grouped.where("p0 is not null")
