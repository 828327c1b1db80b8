"""A Merkle manifest of a table: leaves, roots, and a proof for every row, found by pointer jumping.

A leaf is the digest of a row's fields.  The leaves of one group, in order of their key, are the lowest level
of its tree: every run of eight nodes becomes one node until one is left, the group's root.  The group roots,
in order of the groups, are the lowest level of the tree above, whose root is that of the table.

Proofs: every inner node holds the siblings on its way to an ancestor, at first its parent.  Each self-join on
the ancestor appends the ancestor's segment to the node's and doubles the distance, until all of them reach
the root.  The leaves, which are seven eighths of all nodes, jump once, onto their finished parents.  Their key
is a run, so no key of that join has more than eight leaves.  Ancestors that many nodes share are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .textkit import prepare

RUN = 8
#: Bytes of a digest.
_D = 32
#: The number of the tree above the groups' trees.
_TOP = -1
_KEY = ["tree", "level", "idx"]


def leaf_of(columns: list[Column]) -> Column:
    """The digest of some values: each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return _digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``place``: their number from 0 in the given order, by ranges and the sizes of the ranges."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # the range above 33 bits, the place in it below
    dealt = cut_lineage(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", at))
    dealt = dealt.withColumn("range", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # as many rows as there are tasks
    before = sizes.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    return dealt.join(before, "range").withColumn("place", F.col("at") + F.col("before")).drop("at", "range", "before")


def _levels(nodes: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame]:
    """Inner nodes ``tree, level, idx, children, n, h`` above ``nodes(tree, idx, n, h)``, and the trees' roots ``tree, h``.

    ``n`` is the number of nodes on the node's own level of its tree, ``most`` the greatest of the lowest one.
    """
    roots = nodes.where("n = 1").select("tree", "h")
    inner, level = None, 0
    while most > 1:
        level, most = level + 1, -(-most // RUN)
        run = F.sort_array(F.collect_list(F.struct("idx", "h")))  # at most eight
        blob = F.aggregate(run, F.lit(b""), lambda a, x: F.concat(a, x["h"]))
        grouped = nodes.where("n > 1").groupBy("tree", F.shiftright("idx", 3).alias("up"), F.ceil(F.col("n") / RUN).alias("m")).agg(blob.alias("children"))
        nodes = cut_lineage(grouped.select("tree", F.lit(level).alias("level"), F.col("up").alias("idx"), "children", F.col("m").alias("n"), _digest(_hex(F.col("children"))).alias("h")))
        inner = nodes if inner is None else inner.unionByName(nodes)
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "h"))
    return inner, roots


def _step(children: Column, at: Column) -> Column:
    """The siblings of child ``at``: those left of it and those right of it, each as one binary."""
    left, right = F.substring(children, F.lit(1), at * _D), F.substring(children, (at + 1) * _D + 1, F.octet_length(children))
    return F.struct(left.alias("l"), right.alias("r"))


_NO_STEPS = "cast(array() as array<struct<l: binary, r: binary>>)"


def jumped(inner: DataFrame, trees: DataFrame) -> DataFrame:
    """``inner`` with ``steps``: the siblings of each inner node and of its ancestors below the root, upwards.

    ``trees(tree, levels)`` gives the height of each group's tree, which is the level of its root.
    """
    kids = inner.select("tree", "level", "idx", "children", F.explode(F.sequence(F.lit(0), (F.octet_length("children") / _D).cast("int") - 1)).alias("c"))
    kids = kids.select(*(F.col(c).alias(f"up_{c}") for c in _KEY), (F.col("idx") * RUN + F.col("c")).alias("child"), _step(F.col("children"), F.col("c")).alias("step"))
    below = kids.where("up_level > 1").withColumn("tree", F.col("up_tree")).withColumn("level", F.col("up_level") - 1).withColumn("idx", F.col("child"))
    # the lowest nodes of the tree above are the roots of the groups' trees
    tops = kids.where(f"up_tree = {_TOP} and up_level = 1").join(trees.where("levels > 0").withColumnRenamed("tree", "child"), "child").withColumn("tree", F.col("child")).withColumn("level", F.col("levels")).withColumn("idx", F.lit(0).cast("long"))
    columns = [*_KEY, F.array("step").alias("steps"), "up_tree", "up_level", "up_idx"]
    linked = below.select(*columns).unionByName(tops.select(*columns))
    state = cut_lineage(inner.select(*_KEY).join(linked, _KEY, "left").withColumn("steps", F.coalesce("steps", F.expr(_NO_STEPS))))
    while not state.where("up_level is not null").isEmpty():
        ahead = state.select(*(F.col(c).alias(f"up_{c}") for c in _KEY), F.col("steps").alias("more"), *(F.col(f"up_{c}").alias(f"on_{c}") for c in _KEY))
        state = state.join(ahead, [f"up_{c}" for c in _KEY], "left")
        state = state.select(*_KEY, F.concat("steps", F.coalesce("more", F.expr(_NO_STEPS))).alias("steps"), *(F.col(f"on_{c}").alias(f"up_{c}") for c in _KEY))
        state = cut_lineage(state)
    return inner.join(state.select(*_KEY, "steps"), _KEY)


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "lang", now: dict[str, Column] | None = None) -> DataFrame:
    """``key, leaf, subroot, root, steps, found`` for every row: its proof, and its leaf as found now.

    ``steps`` lists the siblings left and right of the path, level by level, as binaries of 32-byte digests.
    ``now`` gives fields another value than the one the manifest was made of, for ``found``.  Null keys and
    null groups come first; rows with equal keys stand by their leaves, so repeated rows each have a place and
    a proof; a null field is a field like any other; an empty table gives no rows; columns that are no field
    are not read.
    """
    prepare(docs.sparkSession)
    changed = [(now or {}).get(f, F.col(f)) for f in fields]
    rows = docs.select(F.col(key).alias("k"), F.col(group).cast("string").alias("g"), leaf_of([F.col(f) for f in fields]).alias("h"), leaf_of(changed).alias("found"))
    order = [F.asc_nulls_first("g"), F.asc_nulls_first("k"), F.asc("h")]
    leaves = numbered(rows.withColumn("found", F.when(F.col("found") != F.col("h"), F.col("found"))), order)
    groups = cut_lineage(leaves.groupBy("g").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n")))
    groups = cut_lineage(numbered(groups, [F.asc_nulls_first("g")]).withColumnRenamed("place", "tree"))
    most, n_trees = groups.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    leaves = leaves.join(groups.withColumnRenamed("g", "own"), F.col("g").eqNullSafe(F.col("own")))
    leaves = cut_lineage(leaves.select("k", "h", "found", "tree", (F.col("place") - F.col("start")).alias("idx"), "n"))
    inner, roots = _levels(leaves.select("tree", "idx", "n", "h"), most)
    roots = cut_lineage(roots)
    above, root = _levels(roots.select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("n"), "h"), n_trees)
    top = root.first()  # one digest
    levels = F.lit(0)
    for i in range(1, 64):
        if RUN ** (i - 1) < max(most, 1):
            levels = F.when(F.col("n") > F.lit(RUN ** (i - 1)), F.lit(i)).otherwise(levels)
    every = [x for x in (inner, above) if x is not None]
    subroots = roots.withColumnRenamed("h", "subroot")
    if every:
        every = every[0] if len(every) == 1 else every[0].unionByName(every[1])
        nodes = jumped(every, groups.select("tree", levels.cast("int").alias("levels")))
        nodes = nodes.select(F.col("tree").alias("t"), F.col("idx").alias("i"), "children", "steps").where("level = 1")
        alone = F.col("n") == 1
        mine = leaves.withColumn("t", F.when(alone, F.lit(_TOP).cast("long")).otherwise(F.col("tree"))).withColumn("own", F.when(alone, F.col("tree")).otherwise(F.col("idx")))
        mine = mine.withColumn("i", F.shiftright("own", 3)).withColumn("at", F.col("own").bitwiseAND(F.lit(RUN - 1)).cast("int"))
        mine = mine.join(nodes, ["t", "i"], "left")
        steps = F.when(F.col("children").isNull(), F.expr(_NO_STEPS)).otherwise(F.concat(F.array(_step(F.col("children"), F.col("at"))), F.col("steps")))
    else:
        mine, steps = leaves, F.expr(_NO_STEPS)
    out = mine.withColumn("steps", steps).join(subroots, "tree")
    return out.select(F.col("k").alias(key), F.col("h").alias("leaf"), "subroot", F.lit(bytes(top.h) if top else None).cast("binary").alias("root"), "steps", F.coalesce("found", "h").alias("found"))


def folded(leaf: Column, steps: Column) -> Column:
    """The root, as hexadecimal text, that follows from a leaf and the siblings on its way."""
    return F.aggregate(steps, _hex(leaf), lambda a, s: F.sha2(F.concat(_hex(s["l"]), a, _hex(s["r"])), 256))


def siblings_digest(steps: Column) -> Column:
    """One digest over all siblings of a proof, from the leaf's upwards, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(_hex(s["l"]), _hex(s["r"]))), ""), 256)


def audit(proved: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of a ``manifest``: digests as hexadecimal text."""
    table = proved.select(key, *(_hex(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), siblings_digest(F.col("steps")).alias("proof_sha256"), folded(F.col("found"), F.col("steps")).alias("folded_root"))
    return table.withColumn("verified", F.col("folded_root") == F.col("root"))
