"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Texts become weighted sets of five-word shingles (words are runs of letters and digits, A-Z lower-cased; a
shingle that occurs n times weighs 1 + log2 n).  In ProbMinHash each element is a Poisson process whose rate
is its weight; an arrival falls into a random register, each register keeps the element that arrived there
first, and an element's process ends as soon as its next arrival is later than every register's.  The share
of equal registers estimates the probability Jaccard similarity of two texts.

1. Texts with equal words collapse to one, so copies cost one row each.
2. Registers are banded.  Bands with more than one member give candidates: the members of a band, in parts of
   bounded size for the large ones, are compared by their registers, and a maximum spanning forest of the
   estimates goes on, with each member's nearest neighbours.  Every part of a large band also gets the
   band's most central members, so a group of near copies of one text meets that text in every part.
3. Each candidate pair is verified on the shingles themselves: it is a link when the Jaccard or the
   probability Jaccard similarity reaches the threshold.
4. Links give connected components.  These are what the forest could see early.  The members of every band
   that still holds several of them are then compared whole, block against block, with their shingles at
   hand: a pair is verified where it meets first, unless its ends have been joined before, and what leaves a
   block is at most one link for each component in it.
5. A class is a component, named by its least document id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut_lineage
from . import textkit as K

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Registers are BANDS x ROWS; a pair at 0.8 shares no band with a chance of (1 - 0.8^5)^26 = 3e-5.
BANDS, ROWS = 26, 5
#: Members of a band that are compared together, and central ones that every part of a larger band gets.
PART_ROWS, CENTRAL = 512, 16
#: Estimates below this do not become candidates: five standard deviations under the threshold.
LEAST_ESTIMATE = 0.62
NEIGHBOURS = 3
#: Members on each side of what is compared at once after that; larger bands take several such blocks.
BLOCK_ROWS = 1024

_U = np.uint64


def shingles(texts: K.Texts, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """Text number, hash and count of every distinct shingle, by text and hash; and a digest of each text's words.

    A text of fewer words is one shingle; one without words has none, and no digest.
    """
    small = K.Texts(K.LOWER[texts.data], texts.starts, texts.ends)
    starts, ends, first = K.word_spans(small, K.LETTERS)
    words = K.span_hashes(small.data, starts, ends)
    n = np.diff(first)
    grams, at = K.windows(words, first, width)
    owner = K.owners(first)
    short = np.flatnonzero((n > 0) & (n < width))
    whole = [K.mix(np.bitwise_xor.reduce(K.mix(words[first[i] : first[i + 1]] + np.arange(n[i], dtype=_U) + _U(width))).reshape(1))[0] for i in short.tolist()]
    hashes = np.concatenate([grams, np.array(whole, _U)])
    of = np.concatenate([owner[at], short]) if len(hashes) else np.zeros(0, np.int64)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])) if len(hashes) else np.zeros(0, np.bool_)
    cuts = np.flatnonzero(new)
    counts = np.diff(np.append(cuts, len(hashes)))
    digests = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    return of[cuts], hashes[cuts], counts, digests


def registers(of: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, m: int) -> np.ndarray:
    """ProbMinHash of ``n`` weighted sets: for each set and register the element that arrives there first."""
    first, element = np.full(n * m, np.inf), np.zeros(n * m, _U)
    time = np.zeros(len(hashes))
    arrival, step = 0, 1
    while len(hashes):
        t = np.arange(arrival, arrival + step, dtype=_U)
        random = K.mix(hashes[:, None] * _U(0x9E3779B97F4A7C15) + (t + _U(1)) * _U(0xD1342543DE82EF95))
        gap = -np.log(((random >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
        when = time[:, None] + np.cumsum(gap, 1) / weights[:, None]
        register = ((K.mix(random) >> _U(32)) * _U(m) >> _U(32)).astype(np.int64) + of[:, None] * m
        flat, at = when.ravel(), register.ravel()
        np.minimum.at(first, at, flat)
        won = flat == first[at]
        element[at[won]] = np.repeat(hashes, step)[won]
        latest = first.reshape(n, m).max(1)
        time = when[:, -1]
        alive = time <= latest[of]
        hashes, of, weights, time = hashes[alive], of[alive], weights[alive], time[alive]
        arrival, step = arrival + step, 1 if arrival < 2 else 16
    return element.reshape(n, m)


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``k, digest, sketch`` for every row; null where the text has no words.  A register keeps 16 bits."""
    kind = docs.schema[key].dataType.simpleString()

    def block(rows, texts):
        of, hashes, counts, digests = shingles(texts)
        found = (K.mix(registers(of, hashes, 1 + np.log2(counts), len(texts), BANDS * ROWS)) >> _U(48)).astype("<u2")
        rows_ = [s.tobytes() if d else None for s, d in zip(found, digests)]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(digests, pa.binary()), pa.array(rows_, pa.binary())], ["k", "digest", "sketch"])

    base = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return K.arrow_map(base, block, f"k {kind}, digest binary, sketch binary", "t")


def candidate_pairs(x: np.ndarray) -> set[tuple[int, int]]:
    """Row pairs of a register matrix: a maximum spanning forest of the estimates, and each row's nearest rows."""
    n = len(x)
    if n == 2:
        return {(0, 1)} if (x[0] == x[1]).mean() >= LEAST_ESTIMATE else set()
    like = np.zeros((n, n), np.float32)
    for i in range(n - 1):
        like[i, i + 1 :] = (x[i + 1 :] == x[i]).mean(1)
    a, b = np.nonzero(like >= LEAST_ESTIMATE)
    if not len(a):
        return set()
    order = np.argsort(-like[a, b], kind="stable")
    out, root, degree = set(), list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(a[order].tolist(), b[order].tolist()):
        p, q = find(i), find(j)
        if p != q or degree[i] < NEIGHBOURS or degree[j] < NEIGHBOURS:
            root[p] = q
            degree[i] += 1
            degree[j] += 1
            out.add((i, j))
    return out


def _grouped(batches, columns: int, named: bool = False):
    """Runs of rows with equal values in the first ``columns`` columns, as lists of the other columns; with those values if ``named``."""
    name, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:columns] != name:
                if rows:
                    yield (name, rows) if named else rows
                name, rows = row[:columns], []
            rows.append(row[columns:])
    if rows:
        yield (name, rows) if named else rows


def band_members(reps: DataFrame) -> DataFrame:
    """``rep, number, band, n`` for the bands of ``reps(rep, sketch)`` that have more than one member."""
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("sketch", 1 + 2 * ROWS * i, 2 * ROWS)) for i in range(BANDS)))
    bands = reps.select("rep", F.posexplode(keys).alias("number", "band"))
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # stored before they are joined back, so that Spark deals both sides anew and can split a hot band
    return cut_lineage(bands.join(cut_lineage(sizes), "band"))


def candidates(reps: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct ``a, b`` (a < b) of ``reps(rep, sketch)`` that share a band, and may be similar, to begin with."""
    spark = reps.sparkSession
    kind = reps.schema["rep"].dataType.simpleString()
    degree = members.groupBy("rep").agg(F.sum("n").alias("degree"))
    parts = F.ceil(F.col("n") / PART_ROWS).cast("int")
    # the central members of a large band are those whose bands are largest; few of each task travel
    large = members.where(F.col("n") > PART_ROWS).join(degree, "rep")
    place = F.row_number().over(W.partitionBy("band").orderBy(F.desc("degree"), "rep"))
    central = large.withColumn("place", place).where(F.col("place") <= CENTRAL)
    central = central.select("band", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "rep")
    part = F.pmod(F.xxhash64("band", "rep"), parts).cast("int")
    dealt = members.select("band", part.alias("part"), "rep").unionByName(central)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.join(reps, "rep").select("band", "part", "rep", "sketch").repartition(n, "band", "part").sortWithinPartitions("band", "part", "rep")

    def run(batches):
        a, b = [], []
        for group in _grouped(batches, 2):
            own = dict(group)  # a central member may stand twice
            names = list(own)
            x = np.frombuffer(b"".join(own.values()), "<u2").reshape(len(names), -1)
            for i, j in candidate_pairs(x):
                a.append(min(names[i], names[j]))
                b.append(max(names[i], names[j]))
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def cross_members(members: DataFrame, named: DataFrame) -> DataFrame:
    """``band, number, lo, hi, part, rep, c``: who is compared with whom in the bands that hold several components of ``named(rep, c)``.

    A band of more than ``BLOCK_ROWS`` members is compared part against part.  Its most frequent component is
    dealt apart from the others: there is nothing to compare inside it.
    """
    own = cut_lineage(members.select("band", "number", "rep").join(named, "rep"))
    parts = own.groupBy("band", "c").agg(F.count(F.lit(1)).alias("n"))
    bands = parts.groupBy("band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("most"))
    bands = bands.where("n > most.n").select("band", "n", F.col("most.c").alias("main"), F.col("most.n").alias("mains"))
    blocks = F.ceil((F.col("n") - F.col("mains")) / BLOCK_ROWS).cast("int")
    bands = bands.withColumn("whole", F.col("n") <= BLOCK_ROWS)
    bands = bands.withColumn("p", F.when(F.col("whole"), 1).otherwise(blocks)).withColumn("q", F.when(F.col("whole"), 0).otherwise(F.ceil(F.col("mains") / BLOCK_ROWS).cast("int")))
    dealt = own.join(cut_lineage(bands), "band").withColumn("inside", ~F.col("whole") & (F.col("c") == F.col("main")))
    hashed = F.xxhash64("band", "rep")
    dealt = dealt.withColumn("part", F.when(F.col("inside"), F.col("p") + F.pmod(hashed, F.greatest("q", F.lit(1)))).otherwise(F.pmod(hashed, F.col("p"))).cast("int"))
    last = F.when(F.col("inside"), F.col("p") - 1).otherwise(F.col("p") + F.col("q") - 1)
    dealt = dealt.select("band", "number", "part", "rep", "c", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return dealt.select("band", "number", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "rep", "c")


class Shingled:
    """The shingle sets of a block, and the similarity of one of them to many."""

    def __init__(self, hashes: list[np.ndarray], counts: list[np.ndarray]):
        self.hashes, self.weights = hashes, [1 + np.log2(c) for c in counts]
        self.size = np.array([len(h) for h in hashes])
        self.at = np.append(0, np.cumsum(self.size))
        words, self.flat = np.unique(np.concatenate(hashes), return_inverse=True)
        self.share = np.concatenate([w / w.sum() for w in self.weights])
        self.even = np.array([bool((w == w[0]).all()) for w in self.weights])
        self.mark, self.load = np.zeros(len(words), np.int64), np.zeros(len(words))

    def linked(self, i: int, many: np.ndarray, threshold: float) -> np.ndarray:
        """Which of ``many`` reach the threshold with ``i``.

        The probability Jaccard similarity lies between s / (2 - s) and s, the sum of the lesser shares; only
        where these do not tell is it worked out.
        """
        own = self.flat[self.at[i] : self.at[i + 1]]
        self.mark[own], self.load[own] = 1, self.share[self.at[i] : self.at[i + 1]]
        begin = np.append(0, np.cumsum(self.size[many])[:-1])
        at = np.arange(self.size[many].sum()) + np.repeat(self.at[many] - begin, self.size[many])
        words = self.flat[at]
        both = np.add.reduceat(self.mark[words], begin)
        least = np.add.reduceat(np.minimum(self.load[words], self.share[at]), begin)
        self.mark[own], self.load[own] = 0, 0
        bar = threshold - 1e-12
        good = both / (self.size[i] + self.size[many] - both) >= bar
        open_ = ~good & (least >= bar - 1e-9) & ~(self.even[i] & self.even[many])
        for k in np.flatnonzero(open_).tolist():
            j = many[k]
            good[k] = similarity((self.hashes[i], self.weights[i]), (self.hashes[j], self.weights[j])) >= bar
        return many[good]


def _root(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def joining(x: np.ndarray, names: np.ndarray, part: np.ndarray, band: int, sets: Shingled, threshold: float) -> list[tuple[int, int]]:
    """Members of a block whose links join its components ``names``, at most one link for each but one of them.

    Pairs are compared in the first band that they share, unless their components have been joined before.
    """
    inner = part.min() == part.max()
    there = np.arange(len(x)) if inner else np.flatnonzero(part == part.max())
    root, now, out = list(range(int(names.max()) + 1)), names.copy(), []
    rows = x.reshape(len(x), -1, ROWS)
    for i in (there if inner else np.flatnonzero(part != part.max())).tolist():
        j = there[(now[there] != now[i]) & ((there > i) if inner else True)]
        if not len(j):
            continue
        same = rows[j] == rows[i]
        j = j[(same.mean((1, 2)) >= LEAST_ESTIMATE) & (same.all(2).argmax(1) == band)]
        if not len(j):
            continue
        before = len(out)
        for k in sets.linked(i, j, threshold).tolist():
            a, b = _root(root, int(names[i])), _root(root, int(names[k]))
            if a != b:
                root[a] = b
                out.append((i, k))
        if len(out) > before:
            now = np.array([_root(root, n) for n in range(len(root))])[names]
    return out


def cross_links(rows: DataFrame, threshold: float) -> DataFrame:
    """``src, dst``: components that links join, at most one link for each component in a block.

    ``rows(band, number, lo, hi, part, rep, c, sketch, hashes, counts)`` are the members of ``cross_members``
    with what is needed to compare and to verify them in place: a pair never leaves its block.
    """
    spark = rows.sparkSession
    kind = rows.schema["c"].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("band", "number", "lo", "hi", "part", "rep", "c", "sketch", "hashes", "counts")
    rows = rows.repartition(n, "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "rep")

    def run(batches):
        for group in _grouped(batches, 4, named=True):
            (_, band, _, _), members = group
            part, _, c, x, hashes, counts = zip(*members)
            x = np.frombuffer(b"".join(x), "<u2").reshape(len(x), -1)
            sets = Shingled([np.frombuffer(h, _U) for h in hashes], [np.frombuffer(k, "<u4") for k in counts])
            kinds, names = np.unique(np.array(c, object if isinstance(c[0], (str, bytes)) else None), return_inverse=True)
            found = joining(x, names, np.array(part), band, sets, threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([c[i] for i, _ in found]), pa.array([c[k] for _, k in found])], ["src", "dst"])

    return rows.mapInArrow(run, f"src {kind}, dst {kind}").distinct()


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the Jaccard and the probability Jaccard similarity of two (hashes, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    plain = len(both) / (len(a[0]) + len(b[0]) - len(both))
    if not len(both) or not ((a[1] != 1).any() or (b[1] != 1).any()):
        return plain
    x = np.concatenate([a[1], np.zeros(len(b[0]) - len(both))])
    y = np.zeros(len(x))
    y[i] = b[1][j]
    y[len(a[0]) :] = np.delete(b[1], j)
    ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    below = np.concatenate([[0], np.cumsum(y[order])])
    above = np.concatenate([np.cumsum(x[order][::-1])[::-1], [0]])
    at = np.searchsorted(ratio[order], ratio[i])
    return max(plain, float((1 / (above[at] / x[i] + below[at] / y[i])).sum()))


def shingle_sets(docs: DataFrame, nodes: DataFrame, reps: DataFrame, key: str, text: str, had: DataFrame | None = None) -> DataFrame:
    """``rep, hashes, counts`` for the ``nodes(rep)``, without those that ``had`` has."""
    kind = reps.schema["rep"].dataType.simpleString()
    nodes = nodes.select("rep").distinct().join(reps.select("rep", "digest"), "rep")
    nodes = nodes if had is None else nodes.join(had.select("rep"), "rep", "left_anti")
    base = docs.select(F.col(key).alias("rep"), F.col(text).cast("string").alias("t")).where(F.col("rep").isNotNull() & F.col("t").isNotNull())

    def block(rows, texts):
        of, hashes, counts, digests = shingles(texts)
        cuts = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
        good = [i for i, d in enumerate(rows.column(1).to_pylist()) if d == digests[i]]
        sets = [[x[cuts[i] : cuts[i + 1]].tobytes() for i in good] for x in (hashes, counts.astype("<u4"))]
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(good, pa.int64())), *(pa.array(s, pa.binary()) for s in sets)], ["rep", "hashes", "counts"])

    packed = K.squeezed(base, "t").join(nodes, "rep").select("rep", "digest", "t")
    return cut_lineage(K.arrow_map_squeezed(packed, block, f"rep {kind}, hashes binary, counts binary", "t").dropDuplicates(["rep"]))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` that are links."""
    kind = sets.schema["rep"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            left, right = [], []
            for a, b, *blobs in zip(*batch.columns):
                ha, ca, hb, cb = (np.frombuffer(x.as_py(), t) for x, t in zip(blobs, (_U, "<u4", _U, "<u4")))
                if similarity((ha, 1 + np.log2(ca)), (hb, 1 + np.log2(cb))) >= threshold - 1e-12:
                    left.append(a.as_py())
                    right.append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(left, batch.schema.field(0).type), pa.array(right, batch.schema.field(1).type)], ["a", "b"])

    one = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    two = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ha", "ca", "hb", "cb").mapInArrow(run, f"a {kind}, b {kind}")


def components(docs: DataFrame, reps: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """``rep, c`` for every one of ``reps(rep, digest, sketch)``: the component of its links, by its least member."""
    # an id that names several texts stands for the first of them; the others' links run through it
    one = cut_lineage(reps.drop("digest").dropDuplicates(["rep"]))
    members = band_members(one)
    pairs = cut_lineage(candidates(one, members))
    sets = shingle_sets(docs, pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))), reps, key, text)
    links = cut_lineage(verified(pairs, sets, threshold))
    classes = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), hubs=True)
    named = cut_lineage(one.select("rep").join(classes, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("c")))
    cross = cut_lineage(cross_members(members, named))
    if cross.isEmpty():
        return named
    sets = sets.unionByName(shingle_sets(docs, cross, reps, key, text, sets))
    joined = cut_lineage(cross_links(cross.join(one, "rep").join(sets, "rep"), threshold))
    if joined.isEmpty():
        return named
    joined = cut_lineage(connected_components(joined, hubs=True))
    return cut_lineage(named.join(joined, F.col("c") == F.col("node"), "left").select("rep", F.coalesce("component", "c").alias("c")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key, class_id, kept`` for every row; of each class the row with the least id is kept.

    A text without words (null, empty, signs alone) is like no other: its row is a class of its own.  A row
    with a null id is kept, and its class is null, unless other rows have its words: then it is dropped.
    Rows that repeat an id and its words are all kept or all dropped.  An empty table gives no rows; other
    columns are not read.
    """
    found = cut_lineage(sketches(docs, key, text))
    reps = found.where("digest is not null and k is not null").groupBy("digest").agg(F.min("k").alias("rep"), F.first("sketch").alias("sketch"))
    reps = cut_lineage(reps)
    named = components(docs, reps, key, text, threshold)
    named = reps.join(named, "rep").select("digest", F.col("c").alias("class"))
    out = found.select("k", "digest").join(named, "digest", "left").select("k", F.coalesce("class", "k").alias("class_id"))
    return out.select(F.col("k").alias(key), "class_id", F.coalesce(F.col("k") == F.col("class_id"), F.col("class_id").isNull()).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose document is kept, all columns."""
    gone = near_duplicates(docs, key, text, threshold).where("not kept and class_id is not null").select(key).distinct()
    return docs.join(gone, key, "left_anti").select(docs.columns)
