"""Near-duplicate vectors by cross-polytope hashing, with multiprobe buckets and verified pairs.

A hash turns a unit vector by three rounds of random signs and a fast Hadamard transform, and names the
greatest component by size and its sign: the nearest corner of the cross-polytope.  A bucket joins the hashes of HASHES
rotations and the label.  In each of TABLES tables a vector is at home in one bucket and visits the PROBES next
ones by what it loses there; it is compared with the vectors at home where it is at home or visits.

1. Equal vectors of a label collapse to one node.
2. Cores: in a bucket of the first table with many members, those close enough to the members' direction are
   linked with each other for certain, whatever they are: the angle between two is at most the sum of the angles to it.  Their
   links are counted, not compared, so a hot group of near copies costs one pass.
3. Members of a bucket are compared in blocks of bounded size; core against core of one is left out.  A pair that
   meets more than once counts where it meets first.  A block gives sums of links per vector, and a spanning forest of
   its links: never pairs.
4. Forests and cores give connected components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.components import connected_components
from ..session import cut_lineage
from .textkit import prepare

THRESHOLD = 0.93
#: Two vectors of 64 components at 0.93 meet in a table with 0.72 (measured), in none of 8 with 4e-5.
TABLES, HASHES, PROBES = 8, 2, 3
SEED = 20
#: Members on one side of what is compared at once, and members of a bucket before a core is sought.
BLOCK_ROWS, CORE_ROWS = 2048, 64
#: Members of blocks that are compared many blocks at a time.
SMALL_ROWS = 48
#: Tables whose buckets move through one shuffle.
ROUND_TABLES = 4


def units(x: np.ndarray) -> np.ndarray:
    """The rows of ``x`` at length 1, without overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of every row; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        pair = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def buckets(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """For each unit vector and table its home bucket, then the buckets it visits, best first: ``n, tables, 1 + probes``."""
    n, width = x.shape
    wide = 1 << max(1, (width - 1).bit_length())
    x = np.concatenate([x, np.zeros((n, wide - width))], 1)
    signs = np.random.default_rng([seed, wide]).choice([-1.0, 1.0], (tables, hashes, 3, wide))
    out = np.zeros((n, tables, 1 + probes), np.int64)
    rows, few = np.arange(n)[:, None], min(probes + 1, wide)
    for t in range(tables):
        name, loss = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for h in range(hashes):
            y = x
            for s in signs[t, h]:
                y = hadamard(y * s)
            size = np.abs(y)
            best = np.argsort(-size, 1, kind="stable")[:, :few]
            corner = best * 2 + (y[rows, best] < 0)
            lost = (size[rows, best[:, :1]] - size[rows, best]) ** 2
            name = (name[:, :, None] * (2 * wide) + corner[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + lost[:, None, :]).reshape(n, -1)
            keep = np.argsort(loss, 1, kind="stable")[:, : 1 + probes]
            name, loss = name[rows, keep], loss[rows, keep]
        out[:, t, : name.shape[1]] = name
        out[:, t, name.shape[1] :] = name[:, :1]  # fewer corners than probes: home again
    return out


def _name_type(width: int, hashes: int = HASHES) -> str:
    """The narrowest type that holds the name of a bucket of vectors of ``width`` components."""
    bits = hashes * (1 + max(1, (width - 1).bit_length()))
    return "<u2" if bits <= 16 else "<u4" if bits <= 32 else "<i8"


def _dense(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Vectors stored as binaries, shorter ones filled up with zeros."""
    size = np.dtype(kind).itemsize
    raw = b"".join(r.ljust(width * size, b"\0") for r in column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), width).astype(np.float64)


def read_rows(vectors: DataFrame, key: str, column: str, label: str) -> tuple[DataFrame, str]:
    """``k, label, node, v`` of every row, ``v`` the components as a binary, and their type there.

    ``node`` digests label and components; it is null for a row that takes no part.
    """
    double = vectors.schema[column].dataType.simpleString() != "array<float>"
    kind = "<f8" if double else "<f4"
    known, lname = vectors.schema[key].dataType.simpleString(), vectors.schema[label].dataType.simpleString()

    def run(batches):
        for batch in batches:
            nodes, raws = [], []
            for v, name in zip(batch.column(2), batch.column(1).to_pylist()):
                if not v.is_valid:
                    nodes.append(None)
                    raws.append(None)
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # one zero
                raws.append(x[: np.flatnonzero(x)[-1] + 1].tobytes())
                nodes.append(hashlib.blake2b(f"{name!r}:".encode() + raws[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(raws, pa.binary())], ["k", "label", "node", "v"])

    value = F.transform(F.col(column), lambda x: x.cast("double")) if double else F.col(column)
    good = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    good = F.col(key).isNotNull() & F.col(label).isNotNull() & good
    chosen = vectors.select(F.col(key).alias("k"), F.col(label).alias("label"), F.when(good, value).alias("v"))
    return chosen.mapInArrow(run, f"k {known}, label {lname}, node binary, v binary"), kind


def _middles(inside: DataFrame, kind: str, width: int) -> DataFrame:
    """``label, home, centre``: the summed directions of the members of each bucket of ``inside(label, home, v)``."""
    n_parts = int(inside.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrow, schema = to_arrow_type(inside.schema["label"].dataType), f"label {inside.schema['label'].dataType.simpleString()}, home long, centre binary"

    def rows(sums: dict):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], arrow), pa.array([k[1] for k in sums], pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["label", "home", "centre"])

    def early(batches):  # one row per bucket in a batch
        for batch in batches:
            sums: dict = {}
            for k, x in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), units(_dense(batch.column(2), kind, width))):
                sums[k] = sums[k] + x if k in sums else x
            yield rows(sums)

    def late(batches):
        sums: dict = {}
        for batch in batches:
            for label, home, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if sums and (label, home) not in sums:
                    yield rows(sums)
                    sums = {}
                sums[label, home] = sums.get((label, home), 0) + np.frombuffer(raw, "<f8")
        if sums:
            yield rows(sums)

    partial = inside.select("label", "home", "v").mapInArrow(early, schema)
    return partial.repartition(n_parts, "label", "home").sortWithinPartitions("label", "home").mapInArrow(late, schema)


def cores(nodes: DataFrame, kind: str, width: int, threshold: float) -> DataFrame:
    """``node, core``: the members of the cores of ``nodes(node, label, home, v)``, a core being named by its label and home.

    Two members of one core have a cosine above the threshold, by their angles to one direction.
    """
    many = nodes.groupBy("label", "home").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= CORE_ROWS).drop("n")
    inside = cut_lineage(nodes.join(cut_lineage(many), ["label", "home"]))
    middles = cut_lineage(_middles(inside, kind, width))
    half = np.cos(np.arccos(threshold) / 2) + 1e-9

    def near(batches):
        for batch in batches:
            c = _dense(batch.column(3), "<f8", width)
            good = np.flatnonzero(c.any(1))
            good = good[(units(_dense(batch.column(2), kind, width)[good]) * units(c[good])).sum(1) >= half] if len(good) else good
            take = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["node", "core"])

    return inside.join(middles, ["label", "home"]).select("node", "home", "v", "centre").mapInArrow(near, "node binary, core long")


def members(signed: DataFrame, per_table: int) -> DataFrame:
    """``table, label, bucket, lo, hi, part, home, node``: who is compared with whom, of ``signed(node, label, core, names)``.

    Members of one core need no comparison: in a bucket too large for one block the most frequent core is
    dealt apart from the rest, and never meets itself.
    """
    at, home = F.expr(f"pos div {per_table}").cast("int"), F.col("pos") % per_table == 0
    every = signed.select("node", "label", "core", "names", F.posexplode("names").alias("pos", "bucket"))
    every = every.where(home | (F.col("bucket") != F.get("names", F.col("pos") - F.col("pos") % per_table)))
    every = cut_lineage(every.select("node", "label", "core", "bucket", at.alias("table"), home.alias("home")))
    keys = ["table", "label", "bucket"]
    by_core = every.groupBy(*keys, "core").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("int")).alias("homes"))
    most = F.max(F.struct(F.when(F.col("core").isNotNull(), F.col("n")).otherwise(0).alias("n"), "core"))
    sizes = by_core.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("homes").alias("homes"), most.alias("most"))
    sizes = sizes.where("homes > 0 and n > 1 and n > most.n").select(*keys, "n", F.col("most.core").alias("main"), F.col("most.n").alias("mains"))
    sizes = sizes.withColumn("whole", F.col("n") <= BLOCK_ROWS)
    rest = F.ceil((F.col("n") - F.col("mains")) / BLOCK_ROWS).cast("int")
    sizes = sizes.withColumn("p", F.when(F.col("whole"), 1).otherwise(rest)).withColumn("q", F.when(F.col("whole"), 0).otherwise(F.ceil(F.col("mains") / BLOCK_ROWS).cast("int")))
    dealt = every.join(cut_lineage(sizes), keys)  # both stored, so that Spark can split a hot bucket
    inside = ~F.col("whole") & F.col("core").eqNullSafe(F.col("main")) & (F.col("mains") > 0)
    hashed = F.xxhash64("table", "bucket", "node")
    part = F.when(inside, F.col("p") + F.pmod(hashed, F.greatest("q", F.lit(1)))).otherwise(F.pmod(hashed, F.col("p"))).cast("int")
    last = F.when(inside, F.col("p") - 1).otherwise(F.col("p") + F.col("q") - 1)
    dealt = dealt.select(*keys, "node", "home", part.alias("part"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return dealt.select(*keys, F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "home", "node")


def _forest(i: np.ndarray, j: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``i, j`` that join what ``name`` tells apart, at most one for each two; ``name`` is brought up to date."""
    used = []
    while True:
        a, b = name[i], name[j]
        open_ = np.flatnonzero(a != b)
        if not len(open_):
            break
        i, j = i[open_], j[open_]
        high, low = np.maximum(a, b)[open_], np.minimum(a, b)[open_]
        high, pick = np.unique(high, return_index=True)
        to = np.arange(len(name))
        to[high] = low[pick]
        while (to[to] != to).any():
            to = to[to]
        name[:] = to[name]
        used.append((i[pick], j[pick]))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([u[s] for u in used] or [empty]) for s in (0, 1))


def _meets(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether pairs of rows of bucket names (home first) meet in a bucket at home or visiting."""
    return (one[:, :1] == two).any(1) | (one == two[:, :1]).any(1)


def _counted(i, j, core, names, home, table) -> tuple[np.ndarray, np.ndarray]:
    """The pairs ``i, j`` that count here: not inside one core, met in no earlier table and no lesser bucket of this one.

    ``table`` is a number, or an array with that of each member; ``names`` are the buckets by member, table and probe.
    """
    good = (home[i] | home[j]) & ((core[i] < 0) | (core[i] != core[j]))
    i, j = i[good], j[good]
    tables = np.broadcast_to(table, len(home))[i]
    for s in range(int(tables.max(initial=0))):
        new = (tables <= s) | ~_meets(names[i, s], names[j, s])
        i, j, tables = i[new], j[new], tables[new]
    a, b = names[i, tables], names[j, tables]
    # two buckets of one table: each at home in one and visiting the other; the lesser name counts
    both = (a[:, 0] != b[:, 0]) & (a[:, :1] == b).any(1) & (a == b[:, :1]).any(1)
    here = np.where(home[i], a[:, 0], b[:, 0])
    own = ~both | (here == np.minimum(a[:, 0], b[:, 0]))
    return i[own], j[own]


def compare(x: np.ndarray, many: np.ndarray, core: np.ndarray, names: np.ndarray, home: np.ndarray, part: np.ndarray, inner: bool, table: int, threshold: float):
    """Sums of links of each member of a block, and a forest of its links as two index arrays; ``core`` is -1 outside cores."""
    n, sums, name, found = len(x), np.zeros(len(x), np.int64), np.arange(len(x)), []
    if inner:
        kinds, counts = np.unique(core[core >= 0], return_counts=True)
        main = kinds[counts.argmax()] if len(kinds) else -2
        order = np.argsort(core == main, kind="stable")  # what needs comparing first
        left, right = order[core[order] != main], order
    else:
        left, right = np.flatnonzero(part != part.max()), np.flatnonzero(part == part.max())
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        i, j = np.nonzero(x[rows] @ x[right].T >= threshold)
        if inner:
            later = j > i + at  # ``right`` begins with ``left``
            i, j = i[later], j[later]
        i, j = _counted(rows[i], right[j], core, names, home, table)
        sums += np.bincount(i, many[j], n).astype(np.int64) + np.bincount(j, many[i], n).astype(np.int64)
        found.append(_forest(i, j, name))
    empty = np.zeros(0, np.int64)
    return sums, *(np.concatenate([f[s] for f in found] or [empty]) for s in (0, 1))


def compare_small(x: np.ndarray, many: np.ndarray, core: np.ndarray, names: np.ndarray, home: np.ndarray, block: np.ndarray, table: np.ndarray, threshold: float):
    """``compare`` for many small blocks at once; members stand block after block, ``block`` numbers them."""
    n = len(x)
    stop = np.searchsorted(block, block, "right")
    later = stop - np.arange(n) - 1
    i = np.repeat(np.arange(n), later)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
    near = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + 65536]], x[j[a : a + 65536]]) >= threshold for a in range(0, len(i), 65536)] or [np.zeros(0, np.bool_)])
    i, j = _counted(i[near], j[near], core, names, home, table)
    sums = np.bincount(i, many[j], n).astype(np.int64) + np.bincount(j, many[i], n).astype(np.int64)
    return sums, *_forest(i, j, np.arange(n))


def links(signed: DataFrame, kind: str, width: int, per_table: int, threshold: float) -> DataFrame:
    """``node, n, other``: sums of links of a node (``other`` null), and links ``node, other`` of a forest of them all."""
    tables = TABLES
    n_parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(members(signed, per_table))
    keys = ["table", "label", "bucket", "lo", "hi"]
    load = signed.select("node", "n", F.coalesce("core", F.lit(-1).cast("long")).alias("core"), "v", "sig")

    def told(node, sums, i, j):
        some = np.flatnonzero(sums).tolist()
        one = [node[r] for r in some] + [node[r] for r in i.tolist()]
        two = [None] * len(some) + [node[r] for r in j.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(one, pa.binary()), pa.array([*sums[some].tolist(), *[0] * len(i)], pa.int64()), pa.array(two, pa.binary())], ["node", "n", "other"])

    def columns(group):
        part, home, node, many, core, v, sig = zip(*group)
        x = units(_dense(pa.array(v, pa.binary()), kind, width))
        names = np.frombuffer(b"".join(sig), _name_type(width)).reshape(len(x), tables, per_table)
        return node, np.array(part), (x, np.array(many), np.array(core), names, np.array(home))

    def run(batches):
        held, sizes, of = [], [], []

        def small():
            node, _, loaded = columns(held)
            return told(node, *compare_small(*loaded, np.repeat(np.arange(len(sizes)), sizes), np.repeat(of, sizes), threshold))

        for (table, _, _, lo, hi), group in _grouped(batches, len(keys)):
            if len(group) <= SMALL_ROWS and lo == hi:
                held += group
                sizes.append(len(group))
                of.append(table)
                if len(held) >= BLOCK_ROWS:
                    yield small()
                    held, sizes, of = [], [], []
            else:
                node, part, loaded = columns(group)
                yield told(node, *compare(*loaded, part, lo == hi, table, threshold))
        if held:
            yield small()

    out = None
    for first in range(0, tables, ROUND_TABLES):
        rows = dealt.where((F.col("table") >= first) & (F.col("table") < first + ROUND_TABLES)).join(load, "node")
        rows = rows.select(*keys, "part", "home", "node", "n", "core", "v", "sig").repartition(n_parts, *keys).sortWithinPartitions(*keys, "node")
        found = cut_lineage(rows.mapInArrow(run, "node binary, n long, other binary"))
        out = found if out is None else out.unionByName(found)
    return out


def _grouped(batches, columns: int):
    """Runs of rows with equal values in the first ``columns`` columns: those values, and lists of the others."""
    name, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:columns] != name:
                if rows:
                    yield name, rows
                name, rows = row[:columns], []
            rows.append(row[columns:])
    if rows:
        yield name, rows


def near_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row: links join vectors of one label with a cosine of ``threshold`` or more.

    A vector that is null, zero, or holds a null or not finite component, and a row with a null id or label,
    link with nothing and are kept; the component of a null id is null.  Shorter vectors read as filled up with
    zeros.  Equal vectors of a label are linked; rows that repeat an id, label and vector are one vector.  Rows of one id with
    different vectors are different vectors.  An empty table gives no rows; other columns are not read.
    """
    prepare(vectors.sparkSession)
    found, kind = read_rows(vectors, key, column, label)
    found = cut_lineage(found)
    lname = found.schema["label"].dataType.simpleString()
    nodes = found.where("node is not null").dropDuplicates(["node", "k"]).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = cut_lineage(nodes)
    width = (nodes.agg(F.max(F.octet_length("v"))).first()[0] or 0) // np.dtype(kind).itemsize
    per_table = 1 + PROBES

    def sign(batches):
        for batch in batches:
            if len(batch):
                names = np.concatenate([buckets(units(_dense(batch.column(2).slice(a, 1024), kind, width))) for a in range(0, len(batch), 1024)]).reshape(len(batch), -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * names.shape[1], pa.int32()), pa.array(names.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), lists, pa.array([r.tobytes() for r in names.astype(_name_type(width))], pa.binary())], ["node", "label", "v", "n", "names", "sig"])

    signed = cut_lineage(nodes.select("node", "label", "v", "n").mapInArrow(sign, f"node binary, label {lname}, v binary, n long, names array<long>, sig binary"))
    core = cut_lineage(cores(signed.select("node", "label", F.col("names")[0].alias("home"), "v"), kind, width, threshold))
    signed = cut_lineage(signed.join(core, "node", "left"))
    pairs = links(signed, kind, width, per_table, threshold)
    whole = cut_lineage(signed.where("core is not null").groupBy("label", "core").agg(F.min("node").alias("first"), F.sum("n").alias("all")))
    inside = signed.where("core is not null").join(whole, ["label", "core"]).select("node", "first", (F.col("all") - F.col("n")).alias("n"))
    sums = pairs.where("other is null").select("node", "n").unionByName(inside.select("node", "n")).groupBy("node").agg(F.sum("n").alias("linked"))
    edges = pairs.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst"))
    edges = edges.unionByName(inside.where("node <> first").select(F.col("node").alias("src"), F.col("first").alias("dst")))
    joined = cut_lineage(connected_components(edges, hubs=True))
    named = cut_lineage(nodes.join(joined, "node", "left").select("node", "n", "k", F.coalesce("component", "node").alias("component")))
    least = cut_lineage(named.groupBy("component").agg(F.min("k").alias("component_id")))
    out = cut_lineage(named.join(least, "component").join(sums, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id"))
    out = found.select("k", "node").join(out, "node", "left").select("k", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "k").alias("component_id"))
    return out.select(F.col("k").alias(key), "n_links", "component_id", F.coalesce(F.col("k") == F.col("component_id"), F.lit(True)).alias("kept"))
