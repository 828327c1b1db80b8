"""Vectorised reading of text columns inside Arrow tasks: words, lines and hashes by array operations.

Everything here works on the UTF-8 bytes of one record batch.  A batch is cut into blocks of about a
megabyte, so memory is bounded by one block, or by the longest single text.  A null text reads as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one block of array work covers.
BLOCK_BYTES = 1 << 20
#: Bytes of one record batch between the JVM and Python.
BATCH_BYTES = 4 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)


def prepare(spark: SparkSession) -> None:
    """Bound the record batches by bytes and free shuffle files when a query ends.

    Only settings that still have Spark's own defaults are changed.
    """
    for key, default, value in (
        ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", f"{BATCH_BYTES}b"),
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"),
        ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false", "true"),
    ):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


def arrow_map(df: DataFrame, block: Callable[[pa.RecordBatch, "Texts"], pa.RecordBatch | pa.Table | None], schema: str, text: str = "text") -> DataFrame:
    """``mapInArrow`` where ``block`` gets rows whose ``text`` column amounts to about ``BLOCK_BYTES``."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in blocks(batch, text):
                out = block(rows, texts)
                if out is None:
                    continue
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def squeezed(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the ``text`` column compressed row by row, for texts that have to move through a shuffle."""
    schema = ", ".join(f"`{f.name}` {'binary' if f.name == text else f.dataType.simpleString()}" for f in df.schema)

    def block(rows, texts):
        z = zstandard.ZstdCompressor(level=3)
        packed = pa.array([z.compress(texts.raw(i)) for i in range(len(texts))], pa.binary())
        return rows.set_column(rows.schema.get_field_index(text), text, packed)

    return arrow_map(df, block, schema, text)


def arrow_map_squeezed(df: DataFrame, block: Callable, schema: str, text: str = "text") -> DataFrame:
    """``arrow_map`` over a table that ``squeezed`` made; the rows' ``text`` column stays compressed."""
    prepare(df.sparkSession)
    return df.mapInArrow(unsqueezed(block, text), schema)


def unsqueezed(block: Callable, text: str) -> Callable:
    """The function that gives ``block`` slices of a squeezed table and their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            at, packed = 0, batch.column(batch.schema.get_field_index(text))
            while at < len(batch):
                raws, size, first = [], 0, at
                while at < len(batch) and (size < BLOCK_BYTES or at == first):
                    raws.append(z.decompress(packed[at].as_py()))
                    size += len(raws[-1])
                    at += 1
                ends = np.cumsum([len(r) for r in raws])
                texts = Texts(np.frombuffer(b"".join(raws), np.uint8), ends - [len(r) for r in raws], ends)
                yield block(batch.slice(first, at - first), texts)

    return run


class Texts:
    """The texts of some rows: one byte array, and where each row starts and ends in it."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends

    def __len__(self) -> int:
        return len(self.starts)

    def raw(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def lengths(self) -> np.ndarray:
        return self.ends - self.starts


def blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of ``batch`` by bytes of ``column``; a longer text is a slice of its own."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    if not len(values):
        return
    _, where, what = values.buffers()
    offsets = np.frombuffer(where, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(what, np.uint8) if what is not None and what.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(values):
        to = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1
        to = min(max(to, at + 1), len(values))
        first = offsets[at]
        yield batch.slice(at, to - at), Texts(data[first : offsets[to]], offsets[at:to] - first, offsets[at + 1 : to + 1] - first)
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse modulo 2^64."""
    if len(_powers["up"]) < n:
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        size = max(n, BLOCK_BYTES + 1)
        for key, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=_U)
    return _powers["up"][:n], _powers["down"][:n]


#: Values of bytes for a second, independent hash of the same spans.
OTHER = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes: differences of one running polynomial sum.

    ``values`` are the numbers that bytes stand for, if not their own.

    Spans are hashed in groups that cover about ``BLOCK_BYTES``, so that memory stays bounded
    for a very long text too.  ``starts`` is ascending.
    """
    out = np.zeros(len(starts), _U)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(int(np.searchsorted(starts, base + BLOCK_BYTES)), at + 1)
        top = int(ends[at:to].max())
        up, down = _power(top - base + 1)
        sums = np.zeros(top - base + 1, _U)
        own = data[base:top].astype(_U) + _U(1) if values is None else values[data[base:top]]
        np.cumsum(own * up[: top - base], dtype=_U, out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)
        at = to
    return mix(out)


def word_spans(texts: Texts, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with ``member[byte]``, and each text's first word.

    The third array has one more entry than there are texts.  Runs never cross two texts.
    """
    inside = member[texts.data]
    edge = np.zeros(len(inside) + 1, np.bool_)
    if len(inside):
        edge[0] = inside[0]
        edge[-1] = inside[-1]
        edge[1:-1] = inside[1:] != inside[:-1]
    cuts = np.flatnonzero(edge)
    # where two texts touch, a run that goes on is cut in two
    joints = texts.starts[(texts.starts > 0) & (texts.starts < len(inside))]
    joints = np.unique(joints)
    joints = joints[inside[joints] & inside[joints - 1]]
    if len(joints):
        cuts = np.sort(np.concatenate([cuts, joints, joints]))
    starts, ends = cuts[0::2], cuts[1::2]
    first = np.append(np.searchsorted(starts, texts.starts), len(starts))
    return starts, ends, first


def owners(first: np.ndarray) -> np.ndarray:
    """For each word the index of its text, from the third result of ``word_spans``."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def line_spans(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines (split at each line feed; an empty text has one empty line), and first lines."""
    feeds = np.flatnonzero(texts.data == 10)
    count = np.searchsorted(feeds, texts.ends) - np.searchsorted(feeds, texts.starts) + 1
    first = np.concatenate([[0], np.cumsum(count)])
    starts, ends = np.zeros(first[-1], np.int64), np.zeros(first[-1], np.int64)
    starts[first[:-1]], ends[first[1:] - 1] = texts.starts, texts.ends
    after = np.ones(first[-1], np.bool_)
    after[first[:-1]] = False
    starts[after] = feeds + 1
    before = np.ones(first[-1], np.bool_)
    before[first[1:] - 1] = False
    ends[before] = feeds
    return starts, ends, first


def windows(values: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` consecutive values within one text, and the index of each run's first value."""
    n = len(values)
    if n < width:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.zeros(n - width + 1, _U)
    for k in range(width):
        h = h * _BASE + values[k : n - width + 1 + k]
    stop = np.repeat(first[1:], np.diff(first))
    at = np.arange(n - width + 1)
    whole = at + width <= stop[: n - width + 1]
    return mix(h[whole]), at[whole]


def table(members: str) -> np.ndarray:
    """A byte table that is true at the given ASCII characters."""
    out = np.zeros(256, np.bool_)
    out[np.frombuffer(members.encode(), np.uint8)] = True
    return out


#: ASCII white space, and what is not.
BLANK = table(" \t\n\v\f\r")
NOT_BLANK = ~BLANK
#: Lower case for A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of letters and digits: all bytes of non-ASCII characters count.
LETTERS = table("0123456789abcdefghijklmnopqrstuvwxyz")
LETTERS[128:] = True
