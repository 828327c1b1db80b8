"""Best-fit packing of documents into sequences of a fixed number of tokens.

Spark tokenises, counts the lengths, ranks the pieces of each length and gives every piece its place.  The
plan in between depends on the histogram alone (one row for each length, so at most ``capacity`` rows
whatever the corpus holds): a configuration linear program, whose columns are multisets of lengths that fit
into one sequence.

* Prices start near the length's part of a sequence (long pieces a little above it) and fall by
  multiplicative weights with the share of a length's pieces that the chosen columns cover.
* One knapsack table gives the dearest column through every length; the least covered lengths get theirs.
* No length is covered beyond its pieces.  The fractional uses are rounded, as far as pieces are left; what
  remains is solved again, and the last remainder goes where it fits best.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import codec, default_path
from .textkit import arrow_map

Column = tuple[tuple[int, int], ...]  # (length, copies), longest first


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """For each capacity the index of the length that its dearest filling takes first; -1 where none fits."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        n = fits[c]
        if n:
            value = best[c - lengths[:n]] + prices[:n]
            i = int(value.argmax())
            best[c], take[c] = value[i], i
    return take


def _column(first: int, take: np.ndarray, lengths: np.ndarray, left: np.ndarray, capacity: int) -> dict[int, int]:
    """The dearest column through length number ``first`` that the pieces ``left`` allow, as number -> copies."""
    out, room, i = {first: 1}, capacity - int(lengths[first]), 0
    while room > 0 and (i := int(take[room])) >= 0:
        if out.get(i, 0) >= left[i]:
            break
        out[i] = out.get(i, 0) + 1
        room -= int(lengths[i])
    # what a used-up length leaves is filled with the longest pieces that fit
    i = bisect_right(lengths, room) - 1
    while room > 0 and i >= 0:
        if out.get(i, 0) < left[i] and lengths[i] <= room:
            out[i] = out.get(i, 0) + 1
            room -= int(lengths[i])
            i = min(i, bisect_right(lengths, room) - 1)
        else:
            i -= 1
    return out


def _pass(left_of: dict[int, int], capacity: int, waste: int, rounds: int, columns: int, step: float, rate: float, bonus: float, stop: float) -> tuple[dict[Column, int], int]:
    """One solution of the program over ``left_of``, rounded, and the least waste above ``waste`` of a column found."""
    lengths = np.array(sorted(left_of), np.int64)
    need = np.array([left_of[n] for n in lengths.tolist()], np.float64)
    whole = need.astype(np.int64)
    share = np.zeros(len(lengths))
    weight: dict[tuple, float] = {}
    least = capacity
    for _ in range(rounds):
        open_ = np.flatnonzero(share < 1 - 1e-9)
        if share.mean() > stop:
            break
        part = lengths[open_] / capacity
        prices = part * np.exp(bonus * part - rate * (share[open_] - share[open_].mean()))
        take = _knapsack(lengths[open_], prices, capacity)
        for first in np.argsort(share[open_], kind="stable")[:columns].tolist():
            column = {int(open_[i]): n for i, n in _column(first, take, lengths[open_], whole[open_], capacity).items()}
            free = capacity - sum(int(lengths[i]) * n for i, n in column.items())
            if free > waste:
                least = min(least, free)
                continue
            at, many = np.fromiter(column, np.int64), np.fromiter(column.values(), np.float64)
            per = many / need[at]
            times = min(step / float(per.max()), float(((1 - share[at]) / per).min()))
            if times > 1e-9:
                share[at] += times * per
                key = tuple(sorted(column.items()))
                weight[key] = weight.get(key, 0.0) + times
    used: dict[Column, int] = {}
    left = whole.copy()
    for key, times in sorted(weight.items(), key=lambda x: -x[1]):
        times = min([max(1, round(times)), *(int(left[i]) // n for i, n in key)])
        if times > 0:
            name = tuple((int(lengths[i]), n) for i, n in sorted(key, reverse=True))
            used[name] = used.get(name, 0) + times
            for i, n in key:
                left[i] -= times * n
    return used, least


def solve(counts: dict[int, int], capacity: int, rounds: int = 30, columns: int = 128, step: float = 0.2, rate: float = 0.1, bonus: float = 1.0, waste: int = 0, stop: float = 0.9) -> dict[Column, int]:
    """Columns and how often each is used, so that every piece of the histogram ``counts`` has one place.

    A round prices a length at its part of a sequence, raised by ``bonus`` for long pieces and lowered by
    ``rate`` for a covered share above the mean; each chosen column covers at most ``step`` of a length.
    Columns that leave more than ``waste`` tokens free are not used, and a pass ends when the mean share
    covered exceeds ``stop``: what is left then still has the mix of lengths that packs without loss.  A pass
    that places little raises ``waste`` to the least that was found.  The last remainder of each such step is also packed by best fit,
    and the plan with the fewest sequences is taken.
    """
    full = {((n, 1),): k for n, k in counts.items() if n == capacity}
    left_of = {n: k for n, k in counts.items() if 0 < n < capacity and k > 0}
    used: dict[Column, int] = {}
    best: dict[Column, int] | None = None
    while True:
        found, least = _pass(left_of, capacity, waste, rounds, columns, step, rate, bonus, stop) if left_of else ({}, capacity)
        for column, times in found.items():
            used[column] = used.get(column, 0) + times
            for n, copies in column:
                left_of[n] -= times * copies
        left_of = {n: k for n, k in left_of.items() if k}
        if left_of and 8 * sum(found.values()) * capacity >= sum(n * k for n, k in left_of.items()):
            continue
        plan = dict(used)
        for column, times in _best_fit(left_of, capacity).items():
            plan[column] = plan.get(column, 0) + times
        if best is None or sum(plan.values()) < sum(best.values()):
            best = plan
        if not left_of:
            break
        # no plan has fewer sequences than what is used and the tokens that are left
        if sum(best.values()) <= sum(used.values()) - (-sum(n * k for n, k in left_of.items()) // capacity):
            break
        if waste >= capacity:
            break
        waste = min(capacity, max(least, 2 * waste))
    for column, times in full.items():
        best[column] = best.get(column, 0) + times
    return best


def _best_fit(left: dict[int, int], capacity: int) -> dict[Column, int]:
    """Each piece, longest first, goes where it leaves least room; equal sequences are handled together."""
    rooms: dict[int, dict[tuple, int]] = {}  # room -> contents -> sequences
    order: list[int] = []

    def add(room: int, content: tuple, times: int) -> None:
        if room not in rooms:
            rooms[room] = {}
            order.insert(bisect_left(order, room), room)
        rooms[room][content] = rooms[room].get(content, 0) + times

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(order, length)
            if at == len(order):
                copies = min(n, capacity // length)
                times = n // copies
                add(capacity - copies * length, ((length, copies),), times)
                n -= times * copies
                continue
            room = order[at]
            content, times = rooms[room].popitem()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            copies = min(n, room // length)
            now = min(times, n // copies)
            add(room - copies * length, (*content, (length, copies)), now)
            if times > now:
                add(room, content, times - now)
            n -= now * copies
    out: dict[Column, int] = {}
    for contents in rooms.values():
        for content, times in contents.items():
            out[content] = out.get(content, 0) + times
    return out


def tokenised_pieces(docs: DataFrame, capacity: int = 2048, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 0) -> DataFrame:
    """``key, piece, start, length, ids_crc32`` and the piece's rank among those of its length and task.

    A document's ids are followed by ``end_id``.  One longer than ``capacity`` is cut from its end, so that
    its first piece alone is shorter.
    """
    path = path or default_path()
    kind = docs.schema[key].dataType.simpleString()
    seen: dict[int, int] = {}

    def cut(rows, texts):
        c, task = codec(path), TaskContext.get().partitionId()
        doc, piece, start, length, crc, rank = [], [], [], [], [], []
        for i in range(len(texts)):
            ids = np.append(c.encode(texts.raw(i).decode()), np.uint32(end_id)).astype("<u4")
            at, n = 0, len(ids) % capacity or capacity
            while at < len(ids):
                doc.append(i)
                piece.append(-(-at // capacity))
                start.append(at)
                length.append(n)
                crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                rank.append(seen.get(n, 0))
                seen[n] = rank[-1] + 1
                at, n = at + n, capacity
        longs = [pa.array(x, pa.int64()) for x in (start, length, crc, rank)]
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *longs, pa.array([task] * len(doc), pa.int64())], ["k", "piece", "start", "length", "ids_crc32", "rank", "task"])

    base = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return arrow_map(base, cut, f"k {kind}, piece int, start long, length long, ids_crc32 long, rank long, task long", "t").withColumnRenamed("k", key)


def place(pieces: DataFrame, capacity: int = 2048, key: str = "doc_id") -> DataFrame:
    """Give each of the stored ``pieces`` its ``sequence_id`` and ``offset``."""
    by_task = cut_lineage(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    lengths, lows, copies, firsts, offsets, base = [], [], [], [], [], 0
    done: dict[int, int] = {}
    for column, times in sorted(solve(counts, capacity).items()):
        at = 0
        for length, n in column:
            low = done.get(length, 0)
            done[length] = low + n * times
            for x, v in ((lengths, length), (lows, low), (copies, n), (firsts, base), (offsets, at)):
                x.append(v)
            at += n * length
        base += times
    plan = np.array([lengths, lows, copies, firsts, offsets], np.int64)
    plan = plan[:, np.lexsort((plan[1], plan[0]))]

    def put(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            lo, hi = np.searchsorted(plan[0], length), np.searchsorted(plan[0], length, "right")
            at = np.zeros(len(batch), np.int64)
            for n in np.unique(length):  # the ranges of one length are ascending
                mine = length == n
                a, b = int(lo[mine][0]), int(hi[mine][0])
                at[mine] = a + np.searchsorted(plan[1][a:b], rank[mine], "right") - 1
            of = rank - plan[1][at]
            sequence = plan[3][at] + of // plan[2][at]
            offset = plan[4][at] + of % plan[2][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names)

    names = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    before = F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")
    ranked = pieces.join(by_task.select("task", "length", before.alias("before")), ["task", "length"])
    ranked = ranked.select(key, "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    kind = pieces.schema[key].dataType.simpleString()
    return ranked.mapInArrow(put, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = 2048, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document.

    A null or empty text is one piece that holds the end id alone; repeated rows are packed once each; an
    empty table gives no rows; other columns are not read.
    """
    return place(cut_lineage(tokenised_pieces(docs, capacity, key, text, path)), capacity, key)
