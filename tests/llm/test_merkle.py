import hashlib
import zlib

from fixtures_llm import SF, documents
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm import merkle
from geoloom.llm.queries import QUERIES

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root over some nodes, and for each of them its siblings, left and right, level by level."""
    steps, at, place = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(at) > 1:
        for k, p in enumerate(place):
            a = p // 8 * 8
            steps[k].append(("".join(at[a:p]), "".join(at[p + 1 : a + 8])))
            place[k] = p // 8
        at = [h(*at[a : a + 8]) for a in range(0, len(at), 8)]
    return at[0], steps


def brute(rows):
    """Rows ``doc_id, source, lang, n_chars, text`` as the query returns them."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in names}
    climbs = {g: climb([leaf(r) for r in ordered[g]]) for g in names}
    root, above = climb([climbs[g][0] for g in names]) if names else (None, [])
    out = []
    for g, up in zip(names, above):
        subroot, steps = climbs[g]
        for r, own in zip(ordered[g], steps):
            path, text = own + up, r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold = leaf((*r[:4], text))
            for left, right in path:
                fold = h(left, fold, right)
            out.append((r[0], leaf(r), subroot, root, h(*(x + y for x, y in path)), fold, fold == root))
    return sorted(out, key=repr)


def run(df):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    return sorted(map(tuple, merkle.audit(merkle.manifest(df, now={"text": tampered})).collect()), key=repr)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.IntegerType()), T.StructField("text", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as k", "'x' as h", "0 as tree", "5 as idx", "'l' as leaf", "2 as n", "3 as place", "'y' as g", "0 as at")


def test_trees_of_every_size(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(70)] + [(i, None, "de", None, "Ärger" * (i % 4)) for i in range(200, 209)]
    rows += [(300, "s", None, 1, "No language"), (301, "s", None, 2, None), (None, "s", "fr", 3, "No id"), (302, "s", "fr", 3, ""), (400, "s", "alone", 1, "A" * 200_000)]
    rows += [(5, "s2", "en", 5, "Text 5"), (5, "other", "en", 5, "Another text")]  # a repeated row, and a repeated id
    rows += [(500 + i, "s", f"l{i}", i, "UPPER") for i in range(70)]  # more groups than a run holds
    assert run(frame(spark, rows)) == brute(rows)


def test_small_tables(spark):
    assert run(frame(spark, [])) == []
    one = [(7, "s", "en", 1, "Alone")]
    assert run(frame(spark, one)) == brute(one)
    two = [(7, "s", "en", 1, "Alone"), (8, "s", "de", 1, "Too")]
    assert run(frame(spark, two)) == brute(two)
    assert len(merkle.manifest(documents(spark), fields=("doc_id", "text", "k"), group="k").collect()) == 20


def test_proofs_reject_other_leaves(spark):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(20)]
    proved = merkle.manifest(frame(spark, rows), now={"text": F.when(F.col("doc_id") == 3, F.lit("text 3")).otherwise(F.col("text"))})
    assert {r.doc_id for r in merkle.audit(proved).where("not verified").collect()} == {3}


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*FIELDS).collect()]
    assert sorted(map(tuple, QUERIES["op11_merkle_manifest"](spark, SF).collect()), key=repr) == brute(rows)
