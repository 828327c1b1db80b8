"""Line deduplication: repeated runs of lines from a suffix array built by distributed prefix doubling.

A document is the sequence of its lines that hold a word (blank ends stripped); a line's symbol is its hash
of 128 bits.  Later copies of every run of at least ``min_words`` words that occurs twice anywhere in the
corpus are deleted; the first copy, by document id and line, stays.

1. Documents with equal sequences collapse to the one of least id; each other one is a later copy throughout.
2. Symbols that occur once cannot lie in a repeated run and leave the table.
3. Prefix doubling ranks the suffixes by their first 1, 2, 4, ... symbols.  A rank counts the suffixes before
   it: equal pairs of ranks are counted, the distinct pairs are sorted by range, and prefix sums over the
   partitions give the new ranks.  A prefix that occurs once leaves the table, and doubling ends at the
   longest run that can be needed: ``min_words`` lines.
4. The suffixes that share their first L lines are an interval of the suffix array whose longest common
   prefix is L or more; two overlapping ranks of spans 2^j name it.  The least position in the interval is the
   first copy.

Two kinds of intervals reveal every maximal repeated run: those of the shortest sufficient run that starts
at a line, and of the shortest that ends at it.  (Shrink any repeated run around one of its lines from both
sides while it keeps ``min_words`` words: what remains is of one of the two kinds.)
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import textkit as K

MIN_WORDS = 50


def lines(texts: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbol (two independent hashes), words and number of every line with a word, the first such line of each text, and the lines of each text."""
    ws, we, _ = K.word_spans(texts, K.NOT_BLANK)
    ls, le, first = K.line_spans(texts)
    a, b = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    worded = np.flatnonzero(b > a)
    starts, ends = ws[a[worded]], we[b[worded] - 1]
    hashes = np.stack([K.span_hashes(texts.data, starts, ends, values) for values in (None, K.OTHER)], 1)
    number = worded - np.repeat(first[:-1], np.diff(first))[worded]
    return hashes, (b - a)[worded], number, np.searchsorted(worded, first), np.diff(first)


def _digest(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def shortest_runs(words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """``start, length`` of the shortest runs of ``least`` words or more that start, or that end, at each line."""
    total = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    ends = np.searchsorted(total, total[:-1] + least)  # first end that suffices
    starts = np.searchsorted(total, total[1:] - least, "right") - 1  # last start that suffices
    forward = [(i, e - i) for i, e in enumerate(ends.tolist()) if e <= n]
    backward = [(s, i + 1 - s) for i, s in enumerate(starts.tolist()) if s >= 0]
    return sorted({*forward, *backward})


def _before(counted: DataFrame, order: list[str], n_parts: int) -> DataFrame:
    """``counted`` with ``before``: the sum of ``n`` over all rows that sort before it; no task sees more than one range."""
    dealt = cut_lineage(counted.repartitionByRange(n_parts, *order).withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy("range").agg(F.sum("n").alias("all"))
    base = sums.select("range", (F.sum("all").over(W.orderBy("range")) - F.col("all")).alias("base"))  # a row a range
    within = F.sum("n").over(W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return dealt.join(base, "range").withColumn("before", F.coalesce(within, F.lit(0)) + F.col("base")).drop("range", "base")


def suffix_ranks(symbols: DataFrame, levels: int) -> list[DataFrame]:
    """For each span 2^j, ``k, g, p, r``: the ranks of the suffixes of ``symbols(k, g, p, ...)`` by their first 2^j symbols.

    Only suffixes whose prefix occurs more than once are listed.  The rank is the place of the interval in the
    suffix array of those listed.
    """
    n_parts = int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out: list[DataFrame] = []
    pairs, names = symbols, [c for c in symbols.columns if c not in ("k", "g", "p")]
    for j in range(levels + 1):
        if j:
            span = 1 << (j - 1)
            at = W.partitionBy("k", "g").orderBy("p").rangeBetween(span, span)
            pairs, names = out[-1].withColumn("r2", F.max("r").over(at)).where("r2 is not null"), ["r", "r2"]
        counted = pairs.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        ranked = _before(counted, names, n_parts).select(*names, F.col("before").alias("new"))
        now = cut_lineage(pairs.join(ranked, names).select("k", "g", "p", F.col("new").alias("r")))
        out.append(now)
        if now.isEmpty():
            break
    return out


def later_copies(found: DataFrame, min_words: int) -> DataFrame:
    """``k, g, p, length`` of every shortest sufficient run that is not the first copy.

    ``found(k, g, hashes, words)`` holds the line hashes and word counts of the distinct documents.
    """
    kind = found.schema["k"].dataType.simpleString()

    def explode(batches):
        for batch in batches:
            hashes = [np.frombuffer(x.as_py(), np.int64).reshape(-1, 2) for x in batch.column(2)]
            words = [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in batch.column(3)]
            n = np.array([len(h) for h in hashes])
            begin = np.cumsum(n) - n
            starts, lengths = [], []
            for at, w in zip(begin.tolist(), words):
                for p, length in shortest_runs(w, min_words):
                    starts.append(at + p)
                    lengths.append(length)
            offsets = np.searchsorted(np.array(starts, np.int64), np.arange(n.sum() + 1))
            take = pa.array(np.repeat(np.arange(len(n)), n))
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(lengths, pa.int32()))
            place = np.arange(n.sum()) - np.repeat(begin, n)
            symbols = np.concatenate([*hashes, np.zeros((0, 2), np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(place, pa.int32()), pa.array(symbols[:, 0]), pa.array(symbols[:, 1]), runs], ["k", "g", "p", "s", "s2", "lengths"])

    every = cut_lineage(found.mapInArrow(explode, f"k {kind}, g long, p int, s long, s2 long, lengths array<int>"))
    # stored before it is joined back, so that Spark deals both sides anew and can split a hot symbol
    again = cut_lineage(every.groupBy("s", "s2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    symbols = cut_lineage(every.join(again, ["s", "s2"]))
    ranks = suffix_ranks(symbols.select("k", "g", "p", "s", "s2"), (min_words - 1).bit_length())
    runs = symbols.select("k", "g", "p", F.explode("lengths").alias("length"))
    levelled = None
    for j, level in enumerate(ranks):
        own = runs.where((F.col("length") >= 1 << j) & (F.col("length") < 2 << j))
        one = level.select("k", "g", "p", F.col("r").alias("r1"))
        two = level.select("k", "g", F.col("p").alias("last"), F.col("r").alias("r2"))
        named = own.join(one, ["k", "g", "p"]).withColumn("last", F.col("p") + F.col("length") - (1 << j)).join(two, ["k", "g", "last"])
        named = named.select("k", "g", "p", "length", "r1", "r2")
        levelled = named if levelled is None else levelled.unionByName(named)
    levelled = cut_lineage(levelled)
    interval = levelled.groupBy("length", "r1", "r2").agg(F.min(F.struct("k", "g", "p")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return levelled.join(cut_lineage(interval), ["length", "r1", "r2"]).where(F.struct("k", "g", "p") > F.col("first")).select("k", "g", "p", "length")


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs``, the text compressed, and last the runs of worded lines to delete (null: none)."""
    digest_, g_, k_, of_, runs_ = _free(docs.columns, ("digest", "g", "k", "of", "runs"))
    kind = docs.schema[key].dataType.simpleString()

    def block(rows, texts):
        hashes, words, _, first, _ = lines(texts)
        cut = [(int(a), int(b)) for a, b in zip(first[:-1], first[1:])]
        digests = [_digest(hashes[a:b]) for a, b in cut]
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(digests, pa.binary()), pa.array([int(words[a:b].sum()) for a, b in cut], pa.int64()), pa.array([hashes[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([words[a:b].astype("<u4").tobytes() for a, b in cut], pa.binary())],
            ["k", "digest", "total", "hashes", "words"],
        )

    base = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("k is not null")
    found = K.arrow_map(base, block, f"k {kind}, digest binary, total long, hashes binary, words binary", "t").where("digest is not null")
    found = cut_lineage(found.withColumn("g", F.xxhash64("digest")))
    distinct = cut_lineage(found.groupBy("digest").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("g", "total", "hashes", "words"))))
    runs = later_copies(distinct.where(F.col("total") >= min_words).select("k", "g", "hashes", "words"), min_words)
    some = runs.groupBy("k", "g").agg(F.collect_set(F.struct("p", "length")).alias(runs_))
    whole = F.array(F.struct(F.lit(0).alias("p"), (F.octet_length("hashes") / 16).cast("int").alias("length")))
    first = distinct.where("n > 1").select("digest", F.col("k").alias("least"))
    copies = found.where(F.col("total") >= min_words).join(first, "digest").where("k > least").select("k", "g", whole.alias(runs_))
    runs_of = some.unionByName(copies).dropDuplicates(["k", "g"]).withColumnsRenamed({"k": k_, "g": of_})

    schema = ", ".join(f"`{f.name}` {'binary' if f.name == text else f.dataType.simpleString()}" for f in docs.schema)

    def pack(rows, texts):
        hashes, _, _, first, _ = lines(texts)
        digests = [_digest(hashes[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        z = K.zstandard.ZstdCompressor(level=3)
        packed = pa.array([z.compress(texts.raw(i)) for i in range(len(texts))], pa.binary())
        rows = rows.set_column(rows.schema.get_field_index(text), text, packed)
        return rows.append_column(digest_, pa.array(digests, pa.binary()))

    packed = K.arrow_map(docs, pack, f"{schema}, `{digest_}` binary", text).withColumn(g_, F.xxhash64(digest_))
    same = (packed[key] == runs_of[k_]) & (packed[g_] == runs_of[of_])
    return packed.join(runs_of, same, "left").drop(k_, of_, g_, digest_)


def _free(columns: list[str], names) -> list[str]:
    """The ``names`` with underscores in front, as many as keep them apart from the ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken or not name.startswith("__"):
            name = "_" + name
        out.append(name)
    return out


def _kept_lines(n: int, number: np.ndarray, runs) -> np.ndarray:
    """Which of ``n`` lines stay; blank lines go where the lines on both sides of them do."""
    gone = np.zeros(len(number) + 1, np.bool_)
    for r in runs or ():
        gone[r["p"] : r["p"] + r["length"]] = True
    keep = np.ones(n, np.bool_)
    keep[number[gone[:-1]]] = False
    for i in np.flatnonzero(gone[:-1] & gone[1:]).tolist():
        keep[number[i] : number[i + 1]] = False
    return keep


def _each(rows, texts, at):
    """For every text its lines, which of them stay, and the words of all and of the deleted ones."""
    _, words, number, first, n_lines = lines(texts)
    for i, runs in enumerate(rows.column(at).to_pylist()):
        own = slice(first[i], first[i + 1])
        keep = _kept_lines(int(n_lines[i]), number[own], runs)
        yield i, keep, int(words[own][~keep[number[own]]].sum())


def _text(raw: bytes, keep: np.ndarray) -> bytes:
    return raw if keep.all() else b"\n".join(x for x, k in zip(raw.split(b"\n"), keep) if k)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``key, n_lines, n_deleted_lines, n_deleted_words, spans, clean_text`` for every row.

    ``spans`` lists the deleted lines as ``first-last`` from 0.  Rows with a null id are neither copies nor
    first copies and stay whole; rows that repeat an id and its text are one document and treated alike; a
    null or empty text has one empty line; an empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    base = docs.select(F.col(key).alias("k0"), F.col(text).cast("string").alias("t"))
    table = marked(base, "k0", "t", min_words)

    def block(rows, texts):
        out = []
        for i, keep, words in _each(rows, texts, 2):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], ~keep, [0]])))
            spans = ",".join(f"{a}-{b - 1}" for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()))
            out.append((len(keep), int((~keep).sum()), words, spans, _text(texts.raw(i), keep).decode()))
        types = [pa.int64()] * 3 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), types))], ["k", "n_lines", "n_deleted_lines", "n_deleted_words", "spans", "clean_text"])

    schema = f"k {kind}, n_lines long, n_deleted_lines long, n_deleted_words long, spans string, clean_text string"
    return K.arrow_map_squeezed(table, block, schema, "t").withColumnRenamed("k", key)


def keep_first_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` without later copies of runs; a document that has lost all its words goes."""
    table = marked(docs, key, text, min_words)
    at, where = len(docs.columns), docs.columns.index(text)

    def block(rows, texts):
        new, good = [], []
        for i, keep, words in _each(rows, texts, at):
            new.append(_text(texts.raw(i), keep).decode())
            good.append(words == 0 or bool(new[-1].strip()))
        out = rows.set_column(where, text, pa.array(new, pa.string())).select(docs_columns)
        return out.filter(pa.array(good))

    docs_columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return K.arrow_map_squeezed(table, block, schema, text)
