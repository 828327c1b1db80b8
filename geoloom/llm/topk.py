"""Exact top-k inner products by an impact-ordered index, read score at a time.

Vectors are dealt into blocks.  The index of a block has, for each component, segments of vectors whose
component falls into one quantised level, with the least and greatest value in it.  Queries are taken in
batches, those with the same strongest component together.  A batch reads the components by descending
impact, all segments of one at once: the middles of the segments are added up as a matrix product, what they
may be off and what is still to be read make the bounds.  A query stops only when the bounds prove that few vectors
can still be among the best k: all others' upper bounds lie below the k-th score found before or the k-th lower bound.
Those are scored exactly, ties going to the smaller id, and the blocks' results are merged.

Blocks and parts of the queries meet in cells of bounded size; a cell is one group, so no row holds more than a vector.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, over_cores
from .textkit import prepare

#: Vectors of a cell, of an index, queries of a cell, of a batch, and pairs scored at once.
BLOCK_ROWS = 16384
INDEX_ROWS = 4096
PART_ROWS = 4096
QUERY_ROWS = 256
PAIR_ROWS = 1 << 16
LEVELS = 32


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """``k, v`` with ``v`` the components as ``floor(scale * x)``; rows with a null id, or a null or not finite component, go."""
    value = F.transform(F.col(column), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    good = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(key).isNotNull() & F.col(column).isNotNull() & good).select(F.col(key).cast("long").alias("k"), value.alias("v")).distinct()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, at] = flat
    return out


class Index:
    """Vectors by id, and the middle of the segment that each component of each falls into."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: int = LEVELS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        width = self.x.shape[1]
        self.low, self.high = self.x.min(0), self.x.max(0)
        self.peak = np.maximum(np.abs(self.low.astype(float)), np.abs(self.high.astype(float)))
        level = ((self.x - self.low) * levels // np.maximum(self.high - self.low + 1, 1)).astype(np.int64)
        segment = (level + np.arange(width) * levels).T.ravel()  # component after component
        by = np.argsort(segment, kind="stable")
        names, first, place = np.unique(segment[by], return_index=True, return_inverse=True)
        values = self.x.T.ravel()[by].astype(float)
        least = np.minimum.reduceat(values, first) if len(first) else values
        most = np.maximum.reduceat(values, first) if len(first) else values
        middle = np.empty(len(values), np.float32)
        middle[by] = ((least + most) / 2)[place]
        self.middle = middle.reshape(width, len(self.ids))
        self.half = np.zeros(width)
        np.maximum.at(self.half, names // levels, (most - least) / 2)

    def candidates(self, names: np.ndarray, q: np.ndarray, k: int, bar: np.ndarray, rounds: int = 4, few: int = 64) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``query's row, id, score`` of all members that may be among a query's k best, its own id left out.

        ``bar`` has a score for each query below which nothing is wanted, or minus infinity.
        """
        n, width = self.x.shape
        size, bar, out = np.abs(q.astype(float)), bar.copy(), []
        ends = np.maximum(q.astype(float) * self.low, q.astype(float) * self.high), np.minimum(q.astype(float) * self.low, q.astype(float) * self.high)
        most, least = (e.sum(1) for e in ends)
        # of queries whose sums of integers may not be exact in floating point every vector is scored
        exact = size @ self.peak < 2**52
        for row in np.flatnonzero(~exact):
            out += self._scored(np.array([row]), np.ones((1, n), bool), names, q)
        rows = np.flatnonzero(exact & (most >= bar))
        order = np.argsort(-(size[rows].sum(0) * (self.high - self.low)), kind="stable")
        sums = np.zeros((len(rows), n), np.float32)
        for i, (a, b) in enumerate(zip(np.searchsorted(self.ids, names[rows]), np.searchsorted(self.ids, names[rows], "right"))):
            sums[i, a:b] = -math.inf
        # what single precision may be off: a factor for each rounding of a product, a sum and the two values
        off = (width + 16) * 2.0**-22 * (size @ self.peak)
        parts = [p for p in np.array_split(order, rounds) if len(p)] or [order]
        for turn, part in enumerate(parts):
            sums += q[np.ix_(rows, part)].astype(np.float32) @ self.middle[part]
            most[rows] -= ends[0][np.ix_(rows, part)].sum(1)
            least[rows] -= ends[1][np.ix_(rows, part)].sum(1)
            off[rows] += size[np.ix_(rows, part)] @ self.half[part]
            new = np.flatnonzero(np.isneginf(bar[rows]))
            kth = np.full(len(rows), -math.inf)
            if len(new) and k <= n:
                kth[new] = np.partition(sums[new], n - k, axis=1)[:, n - k].astype(float) + (least - off)[rows[new]]
            need = (np.maximum(bar[rows], kth) - most[rows] - off[rows]).astype(np.float32)
            possible = sums >= np.nextafter(need, np.float32(-math.inf))[:, None]
            # the proof: all others end below the bar
            done = (np.count_nonzero(possible, axis=1) <= max(few, 2 * k)) | (turn == len(parts) - 1)
            if done.any():
                out += self._scored(rows[done], possible[done], names, q)
                rows, sums = rows[~done], sums[~done]
            if not len(rows):
                break
        return out

    def _scored(self, rows: np.ndarray, possible: np.ndarray, names: np.ndarray, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        row, at = np.nonzero(possible)
        row = rows[row]
        other = self.ids[at] != names[row]
        row, at = row[other], at[other]
        cuts = range(0, len(at), PAIR_ROWS)
        score = [np.einsum("ij,ij->i", self.x[at[c : c + PAIR_ROWS]], q[row[c : c + PAIR_ROWS]]) for c in cuts]
        return [(row, self.ids[at], np.concatenate(score))] if score else []

    def search(self, query: int, q: np.ndarray, k: int, rounds: int = 4, few: int = 64) -> list[tuple[int, int]]:
        """The k best ``id, score`` of this index for one query, its own id left out."""
        found = self.candidates(np.array([query]), q[None, :], k, np.full(1, -math.inf), rounds, few)
        _, ids, score = best(found, k)
        return list(zip(ids.tolist(), score.tolist()))


def best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, id, score`` of the k best of each row, in order."""
    row, ids, score = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(3))
    order = np.lexsort((ids, ~score, row))  # ~ turns the order of all integers, also of the least
    row, ids, score = row[order], ids[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], ids[kept], score[kept]


def search_cell(ids: np.ndarray, x: np.ndarray, names: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``query_id, vec_id, score`` of the k best of a cell's vectors for each of its queries."""
    near = np.argsort(np.argmax(np.abs(q), axis=1), kind="stable") if q.shape[1] else np.arange(len(q))
    names, q = names[near], q[near]
    cuts = [slice(a, a + QUERY_ROWS) for a in range(0, len(q), QUERY_ROWS)]
    bar = np.full(len(q), -math.inf)
    kept: list[list] = [[] for _ in cuts]
    for a in range(0, len(ids), INDEX_ROWS):
        index = Index(ids[a : a + INDEX_ROWS], x[a : a + INDEX_ROWS])
        for i, c in enumerate(cuts):
            row, found, score = best(kept[i] + index.candidates(names[c], q[c], k, bar[c]), k)
            kept[i] = [(row, found, score)]
            last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
            bar[c.start + row[last]] = np.nextafter(score[last].astype(float), -math.inf)
    rows = [(names[c][row], found, score) for c, part in zip(cuts, kept) for row, found, score in part]
    return tuple(np.concatenate([np.zeros(0, np.int64), *(r[i] for r in rows)]) for i in range(3))


def top_k(vectors: DataFrame, k: int = 5, query: str = "vec_id % 50 = 0", key: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best other vectors for each row that ``query`` selects.

    Vectors that are null or hold a null or not finite component, and rows with a null id, take no part;
    repeated rows count once and rows of one id are no candidates of each other; a shorter vector reads as
    filled up with zeros; equal scores rank by the smaller id; with fewer candidates all are returned; an
    empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    prepare(spark)
    base = cut_lineage(quantised(vectors, key, column, scale))
    # -1 - x instead of -x: the least of all integers has no opposite
    peak = F.greatest(F.array_max("v"), F.lit(-1) - F.array_min("v"))
    n, width, peak = base.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(peak)).first()
    kind = next(name for name, bits in (("smallint", 15), ("int", 31), ("bigint", 63)) if (peak or 0) < 2**bits)
    base, width = base.select("k", F.col("v").cast(f"array<{kind}>").alias("v")), width or 0
    asked = base.selectExpr("k", "v", f"k as {key}").where(query).select("k", "v")
    cores = spark.sparkContext.defaultParallelism
    n_blocks = max(1, math.ceil(n / BLOCK_ROWS), min(math.ceil(n / INDEX_ROWS), 3 * cores))
    n_parts = max(1, math.ceil(asked.count() / PART_ROWS))

    def cells(rows: DataFrame, block: Column, part: Column) -> DataFrame:
        """Rows dealt into the cells of a block and a part; where one is exploded, each of its cells gets a copy."""
        placed = rows.withColumn("block", block).withColumn("part", part)
        return over_cores(placed.select((F.col("block") * n_parts + F.col("part")).alias("cell"), "k", "v"), "cell")

    def deal(count: int, *columns) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int")

    def all_of(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids, names = (t.column("k").to_numpy() for t in (vectors, queries))
        found = (np.zeros(0, np.int64),) * 3
        if len(ids) and len(names):
            x, q = (_matrix(t.column("v").combine_chunks(), width) for t in (vectors, queries))
            found = search_cell(ids, x, names, q, k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))

    blocks = cells(base, deal(n_blocks, "k", "v"), all_of(n_parts)).groupBy("cell")
    parts = cells(asked, all_of(n_blocks), deal(n_parts, F.lit(1), "k")).groupBy("cell")
    found = blocks.cogroup(parts).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
