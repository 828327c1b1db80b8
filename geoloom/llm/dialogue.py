"""Repair of conversations by the lightest derivation: an agenda over weighted deductions.

An item is a place in the rows of a conversation and a state of the grammar ``(s?(ua)+)?`` over the roles'
initials.  Keeping, re-roling, deleting a row and inserting one deduce an item from another; the weight is
the pair of cost and audit, the audit being the edits' initials.  Every edit is a superior function (its result is
never less than what it starts from), so the item that leaves the agenda first is final, and the work ends
when the goal is.

A long conversation is cut into segments of bounded size.  For each state that a segment may begin with the
agenda derives the lightest way to each state that it may end with; a second, binary deduction joins the way
up to a segment with the way through it.  Both keep ties in order: of two ways with equal cost to one item
neither audit begins with the other, since the edits left over would be insertions, which cost.

Texts move once, for the digests of the repaired conversations; the rest works on their digests.  A digest of one text is
read off in order, as rows stream by; nothing but its audit is held.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut_lineage
from .textkit import prepare

#: Rows of a segment.
SEGMENT_ROWS = 512
_BLANKS = " \t\n\v\f\r"
#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state after a row whose role may be chosen, and that role.
_NEXT = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_GOALS = (START, ASSISTANT)
_LEGAL = {"su", "ua", "au"}


def lightest(rows: list[tuple[str, bool, bool]], entry: int = START, every: bool = False) -> dict[int, tuple[int, str]]:
    """The least ``cost, audit`` from state ``entry`` through ``rows(initial, must go, truncated)``, by final state.

    Ends with the first final state that completes a conversation, or with all states if ``every``.
    """
    n, agenda, done = len(rows), [(0, "", 0, entry)], set()
    out: dict[int, tuple[int, str]] = {}
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n:
            out[q] = (cost, audit)
            if not every and q in _GOALS:
                break
        else:
            initial, gone, late = rows[i]
            heapq.heappush(agenda, (cost + 3, audit + "D", i + 1, q))
            if not gone:
                kept = _KEEP.get((q, initial))
                if kept is not None:
                    heapq.heappush(agenda, (cost + late, audit + "K", i + 1, kept))
                heapq.heappush(agenda, (cost + 2 + late, audit + "R", i + 1, _NEXT[q]))
        if (i, _NEXT[q]) not in done:
            heapq.heappush(agenda, (cost + 2, audit + "I", i, _NEXT[q]))
    return out


def _streamed(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


_UNIT = "seg long, blank long, duplicate long, truncated long, illegal long, first string, last string, least long, most long, turns long, turn long, ways array<struct<p: int, q: int, cost: long, audit: string>>"


def _unit(rows: list[tuple], inner: bool) -> list:
    """The counts of consecutive rows ``turn, initial, blank, seen, late, n`` of one conversation, and the ways through them."""
    blank = duplicate = truncated = illegal = turns = 0
    before, least, most, last, flat = None, None, None, None, []
    for turn, initial, is_blank, seen, late, n in rows:
        again = n if seen else n - 1
        blank += n if is_blank else 0
        duplicate += 0 if is_blank else again
        late = late and not (is_blank or seen)
        truncated += late
        illegal += (n - 1) * (initial * 2 not in _LEGAL) + (before is not None and before + initial not in _LEGAL)
        before = initial
        if turn is not None:
            turns += turn != last
            least, last = turn if least is None else least, turn
        flat += [(initial, is_blank or seen, late)] + [(initial, True, False)] * (n - 1)
    ways = [{"p": p, "q": q, "cost": c, "audit": a} for p in ((START,) if inner else range(4)) for q, (c, a) in lightest(flat, p, not inner).items()]
    return [blank, duplicate, truncated, illegal, rows[0][1], before, least, last, turns, rows[0][0], ways]


def _units(batches, kind: pa.DataType):
    """Segments of ``seg, k, turn, initial, blank, seen, late, n`` in order, one row per conversation in each."""

    def run(seg, groups):
        out = []
        for j, (k, rows) in enumerate(groups):
            # only the first and the last one of a segment can go on in another
            out.append((k, seg, *_unit(rows, 0 < j < len(groups) - 1)))
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, t) for c, t in zip(columns[1:], _UNIT_TYPES))], names=["k", *(f.split()[0] for f in _UNIT.split(", ") if ":" not in f), "ways"])

    name, groups = None, []
    for seg, k, *row in _streamed(batches):
        if seg != name:
            if groups:
                yield run(name, groups)
            name, groups = seg, []
        if not groups or groups[-1][0] != k:
            groups.append((k, []))
        groups[-1][1].append(row)
    if groups:
        yield run(name, groups)


_UNIT_TYPES = [*[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))]


def _joined(units: list[tuple]) -> tuple:
    """All the counts, the cost and the audit of one conversation, from its segments in order."""
    blank = duplicate = truncated = illegal = turns = 0
    least = most = before = None
    best = {START: (0, "")}
    for _, b, d, t, i, first, last, low, high, distinct, turn, ways in units:
        blank, duplicate, truncated = blank + b, duplicate + d, truncated + t
        illegal += i + (before is not None and before + first not in _LEGAL)
        before = last
        if low is not None:
            turns += distinct - (most == low)
            least, most = low if least is None else least, high
        new: dict[int, tuple[int, str]] = {}
        for w in ways:
            if w["p"] in best:
                c, a = best[w["p"]]
                way = (c + w["cost"], a + w["audit"])
                if w["q"] not in new or way < new[w["q"]]:
                    new[w["q"]] = way
        best = new
    cost, audit = min(best[q] for q in _GOALS if q in best)
    gaps = 0 if least is None else most - least + 1 - turns
    return gaps, blank, duplicate, truncated, illegal, cost, audit


def _conversations(batches, kind: pa.DataType):
    """``k`` and the results of ``_joined`` from units in order of ``k, seg``."""

    def flush(rows):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.string())], ["k", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    name, units, out, size = None, [], [], 0
    for k, *unit in _streamed(batches):
        if units and k != name:
            out.append((name, *_joined(units)))
            size, units = size + len(out[-1][-1]), []
            if len(out) >= 4096 or size > 1 << 20:
                yield flush(out)
                out, size = [], 0
        name = k
        units.append(tuple(unit))
    if units:
        out.append((name, *_joined(units)))
    if out:
        yield flush(out)


def edited(rows, audit: str):
    """The repaired ``role, text`` that an audit makes of ``rows(role, text)``."""
    q, at, rows = START, 0, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            q = _KEEP[q, role[:1]]
        else:
            q = _NEXT[q]
            role = _NAMES[q]
        yield role, text


def _dialogues(batches):
    """``k`` and the repaired rows of each conversation, from a row with its audit and then its own rows, in order.

    The rows of one are to be read to their end before the next one is asked for.
    """
    stream = _streamed(batches)
    row = next(stream, None)
    while row is not None:
        k, audit = row[0], row[1]

        def own():
            nonlocal row
            while (row := next(stream, None)) is not None and row[1] is None:
                yield row[2], row[3]

        rest = own()
        yield k, edited(rest, audit)
        for _ in rest:  # reads on to the next conversation; the audit has an edit for every row
            pass


def _digests(batches, kind: pa.DataType):
    """``k, repaired_sha256`` of the stream that ``_dialogues`` reads."""

    def flush(out):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], kind), pa.array([d for _, d in out], pa.string())], ["k", "repaired_sha256"])

    out: list[tuple] = []
    for k, rows in _dialogues(batches):
        h = hashlib.sha256()
        for i, (role, text) in enumerate(rows):
            h.update(f"{chr(10) if i else ''}{role}:{text}".encode())
        out.append((k, h.hexdigest()))
        if len(out) == 4096:
            yield flush(out)
            out = []
    if out:
        yield flush(out)


def _rows(batches, kind: pa.DataType):
    """``k, place, role, text`` of the stream that ``_dialogues`` reads."""

    def flush(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.int64(), pa.string(), pa.string()))], ["k", "place", "role", "text"])

    out, size = [], 0
    for k, rows in _dialogues(batches):
        for i, (role, text) in enumerate(rows):
            out.append((k, i, role, text))
            size += len(text) + 64
            if size > 1 << 20:
                yield flush(out)
                out, size = [], 0
    if out:
        yield flush(out)


def damaged(rows: DataFrame) -> DataFrame:
    """Test damage of ``conv_id, turn, role, text``: by a checksum of conversation and turn, rows are dropped, emptied,
    stripped of ``.!?``, repeated, or given to the user.  A null reads as one blank."""
    space = F.lit(" ")
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.coalesce(F.col("text").cast("string"), space)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("fault") == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), space))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    kept = rows.select("conv_id", "turn", "role", "text", fault.alias("fault")).where("fault <> 0")
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair(rows: DataFrame, key: str = "conv_id", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``key, gaps, blank, duplicate, truncated, illegal, cost, audit`` for every conversation of ``rows(key, turn, role, text)``.

    Rows stand by turn (null first), then role, then the digest of the text; equal rows are copies of each
    other, the later ones duplicates.  A null role or text reads as one blank; a role without a first
    character cannot be kept; a null key is a conversation of its own; an empty table gives no rows; other
    columns are not read.
    """
    spark = rows.sparkSession
    prepare(spark)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema[key].dataType.simpleString()
    one = _marked(rows, key)
    trimmed = F.rtrim(F.col("text"), F.lit(_BLANKS))
    one = one.select("k", "turn", "role", "digest", (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("late"))
    one = cut_lineage(one.groupBy("k", "turn", "role", "digest", "blank", "late").agg(F.count(F.lit(1)).cast("int").alias("n")))
    # turns as text before their number, so that a null one is the least
    order = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    again = one.where("not blank").groupBy("k", "role", "digest").agg(F.count(F.lit(1)).alias("times"), F.min(order).alias("first")).where("times > 1").drop("times")
    again = cut_lineage(again.withColumnsRenamed({"k": "k2", "role": "role2", "digest": "digest2"}))
    same = F.col("k").eqNullSafe(F.col("k2")) & (F.col("role") == F.col("role2")) & (F.col("digest") == F.col("digest2"))
    told = one.join(again, same, "left").withColumn("seen", F.coalesce(~F.col("blank") & (order > F.col("first")), F.lit(False)))
    by = [F.asc_nulls_first("k"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    told = told.select("k", "turn", "role", "digest", "blank", "late", "seen", "n").repartitionByRange(n_parts, *by).sortWithinPartitions(*by)
    told = cut_lineage(told.select("k", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "seen", "late", "n", F.monotonically_increasing_id().alias("at")))
    told = told.withColumn("seg", F.expr(f"at div {segment_rows}")).repartition(n_parts, "seg").sortWithinPartitions("seg", "at")
    arrow = to_arrow_type(rows.schema[key].dataType)
    units = told.select("seg", "k", "turn", "initial", "blank", "seen", "late", "n").mapInArrow(lambda b: _units(b, arrow), f"k {kind}, {_UNIT}")
    units = units.repartition(n_parts, "k").sortWithinPartitions("k", "seg")
    out = units.mapInArrow(lambda b: _conversations(b, arrow), f"k {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    return out.withColumnRenamed("k", key)


def _marked(rows: DataFrame, key: str) -> DataFrame:
    space = F.lit(" ")
    base = rows.select(F.col(key).alias("k"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    return base.withColumn("digest", F.unhex(F.md5("text")))


def _with_audits(rows: DataFrame, repairs: DataFrame, key: str) -> DataFrame:
    """``k, audit, role, text``: of every conversation a row with its audit, then its rows in order."""
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nothing = {"role": "string", "digest": "binary", "text": "string", "turn": "long"}
    texts = _marked(rows, key).withColumn("audit", F.lit(None).cast("string"))
    heads = repairs.select(F.col(key).alias("k"), "audit", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    every = heads.unionByName(texts).repartition(n_parts, "k")
    by = [F.asc_nulls_first("k"), F.desc(F.col("audit").isNotNull()), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    return every.sortWithinPartitions(*by).select("k", "audit", "role", "text")


def repaired_digests(rows: DataFrame, repairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key, repaired_sha256``: the digest of the lines ``role:text`` of every repaired conversation.

    ``repairs`` is what ``repair`` gives for ``rows``.  SHA-256 reads a text in order, so the rows of a
    conversation pass through one task, but none of them is held.
    """
    kind, arrow = rows.schema[key].dataType.simpleString(), to_arrow_type(rows.schema[key].dataType)
    return _with_audits(rows, repairs, key).mapInArrow(lambda b: _digests(b, arrow), f"k {kind}, repaired_sha256 string").withColumnRenamed("k", key)


def repaired_rows(rows: DataFrame, repairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key, place, role, text``: the rows of every repaired conversation, in order from 0."""
    kind, arrow = rows.schema[key].dataType.simpleString(), to_arrow_type(rows.schema[key].dataType)
    return _with_audits(rows, repairs, key).mapInArrow(lambda b: _rows(b, arrow), f"k {kind}, place long, role string, text string").withColumnRenamed("k", key)
