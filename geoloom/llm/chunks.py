"""BPE encoding with content-defined chunk reuse, and decoding.

1. A rolling hash cuts every text into chunks whose borders depend on nearby bytes alone, so a passage that
   many documents hold gives the same chunks in each of them.
2. Chunks are grouped by a 128-bit digest.  One that occurs more than once is encoded once, at its first
   occurrence; only digests travel, never the texts of chunks.
3. Each document takes the ids of its shared chunks, encodes what lies between them, and repairs every
   join: a window around it is encoded anew and grown until it agrees with what stands on both sides.

The window begins and ends at blanks between visible characters, where every match of the word pattern
starts anew; agreement means that the stored ids of both sides have a border there and that the window's
ids repeat theirs up to it.  A chunk without such places is encoded together with its neighbours.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .bpe import Codec, codec, default_path, safe_places
from .textkit import arrow_map, arrow_map_squeezed, squeezed

#: Bytes that the rolling hash sees, least bytes of a chunk, and the mask of hash bits that makes a border.
WINDOW = 16
LEAST_BYTES = 512
MASK = (1 << 10) - 1
#: Most bytes of a chunk; further borders follow at this distance.
MOST_BYTES = 1 << 16


def borders(data: np.ndarray, start: int, end: int, marks: np.ndarray) -> list[int]:
    """Chunk borders of the text ``data[start:end]`` relative to its start, both ends included.

    ``marks`` are the places of ``data`` after which the rolling hash makes a border.  None splits a character.
    """
    out, last = [0], 0
    own = marks[np.searchsorted(marks, start + WINDOW) : np.searchsorted(marks, end)] - start
    for m in [*own.tolist(), end - start]:
        while m - last > MOST_BYTES:
            last = _whole(data, start, last + MOST_BYTES)
            out.append(last)
        if m - last >= LEAST_BYTES and m < end - start:
            last = _whole(data, start, m)
            out.append(last)
    if end - start > out[-1] or len(out) == 1:
        out.append(end - start)
    return out


def _whole(data: np.ndarray, start: int, at: int) -> int:
    """``at`` or the first place before it where a UTF-8 character begins."""
    while at > 0 and data[start + at] & 0xC0 == 0x80:
        at -= 1
    return at


def rolling_marks(data: np.ndarray) -> np.ndarray:
    """Places whose preceding ``WINDOW`` bytes hash to zero under the mask; sums of doubled spans, no loop over bytes."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64)
    h, span, power = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1), 1, 0x01000193
    while span < WINDOW:
        h = h[:-span] * np.uint32(power) + h[span:]
        power = power * power & 0xFFFFFFFF
        span *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return np.flatnonzero((h >> np.uint32(20)) & np.uint32(MASK) == 0) + WINDOW


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def assemble(raw: bytes, cuts: list[int], known: dict[int, np.ndarray], c: Codec) -> np.ndarray:
    """The ids of the whole text, from the stored ids of the chunks in ``known`` and encodings of the rest."""
    if not known:
        return c.encode(raw.decode())
    # segments: shared chunks, and the stretches between them
    segments: list[tuple[int, int, np.ndarray | None]] = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if i in known:
            segments.append((a, b, known[i]))
        elif segments and segments[-1][2] is None:
            segments[-1] = (segments[-1][0], b, None)
        else:
            segments.append((a, b, None))
    out: list[np.ndarray] = []
    at, ids = segments[0][0], segments[0][2]
    stop = segments[0][1]
    for a, b, stored in segments[1:]:
        # [at, stop) holds ids that are right up to its last safe place; [a, b) follows it
        left = c.encode(raw[at:stop].decode()) if ids is None else ids
        right = c.encode(raw[a:b].decode()) if stored is None else stored
        joined = _repair(raw, at, a, b, left, right, c)
        if joined is None:  # no agreement inside the two: they are one
            ids, stop = c.encode(raw[at:b].decode()), b
            continue
        head, middle, tail, tail_at = joined
        out += [head, middle]
        at, stop, ids = tail_at, b, tail
    out.append(c.encode(raw[at:stop].decode()) if ids is None else ids)
    return np.concatenate(out)


def _repair(raw: bytes, at: int, a: int, b: int, left: np.ndarray, right: np.ndarray, c: Codec):
    """Ids before the window, of the window, and after it, and where the last begin; None without agreement.

    ``left`` encodes ``raw[at:a]``, ``right`` encodes ``raw[a:b]``.  The window starts with the safe places
    next to the join but one, and takes in further ones until its ids agree with both sides.
    """
    reach = 256
    left_ends = np.cumsum(c.widths[left]) + at
    right_ends = np.cumsum(c.widths[right]) + a
    while True:
        low, high = max(at, a - reach), min(b, a + reach)
        before = [low + p for p in safe_places(raw[low:a])]
        after = [a + p for p in safe_places(raw[a:high])]
        if len(before) >= 2 and len(after) >= 2:
            w0, w1, w2, w3 = before[-2], before[-1], after[0], after[1]
            i, j = np.searchsorted(left_ends, [w0, w1]) + 1
            k, m = np.searchsorted(right_ends, [w2, w3]) + 1
            if left_ends[i - 1] == w0 and left_ends[j - 1] == w1 and right_ends[k - 1] == w2 and right_ends[m - 1] == w3:
                window = c.encode(raw[w0:w3].decode())
                n, o = j - i, m - k
                if n + o <= len(window) and np.array_equal(window[:n], left[i:j]) and np.array_equal(window[len(window) - o :], right[k:m]):
                    return left[:i], window, right[m:], w3
        if low == at and high == b:
            return None
        reach *= 4


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, text, n_tokens, ids`` for every row of ``docs``; ``ids`` are little-endian unsigned 32-bit integers.

    A null text encodes as an empty one.  Repeated rows share every chunk and give repeated results; a null
    key is a key of its own; an empty table gives no rows; other columns are not read.
    """
    path = path or default_path()
    kind = docs.schema[key].dataType.simpleString()
    base = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    base = base.select("k", F.xxhash64("t").alias("h"), "t")

    def chunked(rows, texts):
        marks, at, seq, found = rolling_marks(texts.data), [], [], []
        for i, (s, e) in enumerate(zip(texts.starts.tolist(), texts.ends.tolist())):
            raw, cuts = texts.raw(i), borders(texts.data, s, e, marks)
            for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    at.append(i)
                    seq.append(n)
                    found.append(digest(raw[a:b]))
        take = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take), pa.array(seq, pa.int32()), pa.array(found, pa.binary())], ["k", "h", "seq", "digest"])

    chunks = cut_lineage(arrow_map(base, chunked, f"k {kind}, h long, seq int, digest binary", "t"))
    place = F.struct("k", "h", "seq")
    shared = chunks.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("p")).where("n > 1")
    wanted = shared.groupBy("p.k", "p.h").agg(F.collect_list(F.struct("p.seq", "digest")).alias("wanted"))

    def encoded(rows, texts):
        c, marks, names, ids = codec(path), rolling_marks(texts.data), [], []
        for i, wish in enumerate(rows.column(3).to_pylist()):
            cuts, raw = borders(texts.data, int(texts.starts[i]), int(texts.ends[i]), marks), texts.raw(i)
            for w in wish:
                names.append(w["digest"])
                ids.append(c.encode(raw[cuts[w["seq"]] : cuts[w["seq"] + 1]].decode()).astype(c.narrow).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(ids, pa.binary())], ["digest", "ids"])

    packed = squeezed(base, "t")
    first = packed.join(wanted, packed.k.eqNullSafe(wanted.k) & (packed.h == wanted.h)).select(packed.k, packed.h, "t", "wanted")
    # rows that repeat a first place are encoded with it; one result of each digest stays
    stored = cut_lineage(arrow_map_squeezed(first, encoded, "digest binary, ids binary", "t").groupBy("digest").agg(F.first("ids").alias("ids")))
    given = chunks.join(stored, "digest").groupBy("k", "h").agg(F.collect_set(F.struct("seq", "ids")).alias("given"))

    def whole(rows, texts):
        c, marks, ids = codec(path), rolling_marks(texts.data), []
        for i, parts in enumerate(rows.column(2).to_pylist()):
            known = {p["seq"]: np.frombuffer(p["ids"], c.narrow).astype(np.uint32) for p in parts or ()}
            cuts = borders(texts.data, int(texts.starts[i]), int(texts.ends[i]), marks) if known else []
            ids.append(assemble(texts.raw(i), cuts, known, c))
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array([texts.raw(i).decode() for i in range(len(texts))], pa.string()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["k", "t", "n_tokens", "ids"])

    full = packed.join(given, packed.k.eqNullSafe(given.k) & (packed.h == given.h), "left").select(packed.k, packed.t, "given")
    return arrow_map_squeezed(full, whole, f"k {kind}, t string, n_tokens long, ids binary", "t").select(F.col("k").alias(key), F.col("t").alias("text"), "n_tokens", "ids")


def decode(ids: DataFrame, key: str = "doc_id", column: str = "ids", path: str | None = None) -> DataFrame:
    """``key, n_tokens, ids, decoded`` of a table of encoded texts; a null reads as no ids and gives an empty text."""
    path = path or default_path()
    kind = ids.schema[key].dataType.simpleString()

    def run(batches):
        c = codec(path)
        for batch in batches:
            for at in range(0, max(len(batch), 1), 64):
                part = batch.slice(at, 64)
                texts = [c.decode(np.frombuffer(x or b"", np.uint32)).decode() for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["k", "n_tokens", "ids", "decoded"])

    n = F.expr(f"octet_length({column}) div 4")
    return ids.select(F.col(key).alias("k"), F.coalesce(n, F.lit(0)).cast("long").alias("n_tokens"), F.col(column).alias("ids")).mapInArrow(run, f"k {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("k", key)
