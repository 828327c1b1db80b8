import hashlib
import itertools
import random
import re
import zlib

from fixtures_llm import SF
from pyspark.sql import types as T

from geoloom.llm import dialogue
from geoloom.llm.queries import QUERIES

GRAMMAR = re.compile("(s?(ua)+)?")
#: What may begin such initials.
PREFIX = re.compile("s?(ua)*u?")
BLANKS = " \t\n\v\f\r"


def damage(rows):
    """Rows ``conv_id, turn, role, text`` after the damage."""
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if f:
            text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
            out += [(c, t, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or " ").encode(), hashlib.md5((" " if r[3] is None else r[3]).encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(BLANKS)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """By dynamic programming over places and all states of the grammar, without an agenda: cost, audit, repaired rows."""
    states = {"": (0, "", [])}  # the initials so far, shortened to what the grammar needs to know

    def put(new, s, way):
        if PREFIX.fullmatch(s):
            s = s if s in ("", "s") else "u" if s[-1] == "u" else "ua"
            if s not in new or way[:2] < new[s][:2]:
                new[s] = way

    def inserted(states):
        for _ in range(4):
            new = dict(states)
            for s, (c, a, r) in states.items():
                for role in ("user", "assistant"):
                    put(new, s + role[0], (c + 2, a + "I", [*r, (role, "")]))
            states = new
        return states

    for (_, _, role, text), fault in zip(rows, found):
        new: dict = {}
        for s, (c, a, r) in inserted(states).items():
            put(new, s, (c + 3, a + "D", r))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role:
                    put(new, s + role[0], (c + more, a + "K", [*r, (role, text)]))
                for other in ("user", "assistant"):
                    put(new, s + other[0], (c + 2 + more, a + "R", [*r, (other, text)]))
        states = new
    return min((w for s, w in inserted(states).items() if GRAMMAR.fullmatch(s)), key=lambda w: w[:2])


def brute(rows, every):
    out = []
    for c in {r[0] for r in every}:
        own = [(k, t, " " if role is None else role, " " if text is None else text) for k, t, role, text in in_order([r for r in rows if r[0] == c])]
        found, turns = faults(own), [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, repaired = cheapest(own, found)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((c, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as k", "'x' as digest", "0 as at", "5 as seg", "'a' as audit", "2 as n", "3 as fault", "4 as copy")


def results(spark, rows, segment_rows=dialogue.SEGMENT_ROWS):
    df = frame(spark, rows)
    found = dialogue.repair(df, segment_rows=segment_rows)
    digests = {r.conv_id: r.repaired_sha256 for r in dialogue.repaired_digests(df, found).collect()}
    return sorted(((*r, digests[r.conv_id]) for r in found.collect()), key=repr)


def conversations(seed, n, roles=("system", "user", "assistant"), most=12):
    r, rows = random.Random(seed), []
    for c in range(n):
        for t in range(r.randrange(1, most)):
            role = r.choice(roles) if r.random() < 0.4 else ("user", "assistant")[t % 2]
            text = r.choice(["Yes.", "No", " \n", "", "Say that again?", f"Word {r.randrange(9)}!", "Ends well. \n\t", None])
            rows.append((c, t + (r.random() < 0.1), role, text))
    return rows


def test_repairs_as_dynamic_programming(spark):
    rows = conversations(1, 60) + [(c + 1000, *r) for c, *r in conversations(2, 25, ("system", "user", "assistant", "tool", "", None, "Über"))]
    rows += [(2000, None, "user", "First."), (2000, 3, "user", "Last."), (2000, 3, "user", "Last."), (2001, None, None, None), (None, 1, "user", "No id."), (None, 0, "assistant", "Yes.")]
    rows += [(2002, i, "user", "Again.") for i in range(30)] + [(2003, 1, "user", "x" * 300_000), (2003, 2, "assistant", "ok.")]
    want = brute(rows, rows)
    assert results(spark, rows) == want
    assert results(spark, rows, 3) == want  # conversations cut into segments
    assert results(spark, [(1, i, r, "It is so." + str(i) + ".") for i, r in enumerate(["user"] * 100)], 16) == brute([(1, i, "user", "It is so." + str(i) + ".") for i in range(100)], [(1,)])
    assert results(spark, []) == []


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Still there?"), (1, 2, "assistant", "Yes"), (1, 3, "assistant", ""), (2, 0, "system", "Be kind.")]
    df = frame(spark, rows)
    found = dialogue.repair(df)
    got = sorted(tuple(r) for r in dialogue.repaired_rows(df, found).collect())
    assert {r.conv_id: r.audit for r in found.collect()} == {1: "KIKKD", 2: "D"}
    assert got == [(1, 0, "user", "Hi."), (1, 1, "assistant", ""), (1, 2, "user", "Still there?"), (1, 3, "assistant", "Yes")]


def test_agenda_ends_at_the_goal():
    rows = [(random.Random(i).choice("usa"), i % 7 == 3, i % 5 == 0) for i in range(40)]
    first = dialogue.lightest(rows)
    every = dialogue.lightest(rows, every=True)
    best = min(every[q] for q in (dialogue.START, dialogue.ASSISTANT))
    assert min(first[q] for q in first if q in (dialogue.START, dialogue.ASSISTANT)) == best


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_dialogue_repair"](spark, SF).collect()), key=repr) == brute(damage(rows), rows)
    sentences = frame(spark, conversations(4, 40))
    got = sorted(map(tuple, dialogue.damaged(sentences).collect()), key=repr)
    assert got == sorted(damage(conversations(4, 40)), key=repr)
