import hashlib
import random
import re
from collections import defaultdict

from fixtures_llm import SF, documents, odd_texts, prose

from geoloom.llm import linedup
from geoloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, least):
    """Deleted lines of each (id, text): the longest earlier run at every line, if it has enough words."""
    where, gone = defaultdict(list), {}
    for k, text in sorted({(k, t or "") for k, t in rows if k is not None}):
        seq = [(i, x.strip(" \t\v\f\r"), len(WORD.findall(x))) for i, x in enumerate(text.split("\n")) if WORD.search(x)]
        out = gone.setdefault((k, text), set())
        for p in range(len(seq)):
            best = 0
            for other, q in where[seq[p][1]]:
                n = 0
                while p + n < len(seq) and q + n < len(other) and seq[p + n][1] == other[q + n][1]:
                    n += 1
                best = max(best, n)
            if best and sum(x[2] for x in seq[p : p + best]) >= least:
                out |= {x[0] for x in seq[p : p + best]}
            where[seq[p][1]].append((seq, p))
        for (i, *_), (j, *_) in zip(seq, seq[1:]):
            if i in out and j in out:  # blank lines between deleted ones
                out |= set(range(i, j))
    return gone


def want(rows, least):
    gone = brute(rows, least)
    for k, t in rows:
        lost = gone.get((k, t or ""), set())
        lines = (t or "").split("\n")
        yield repr((k, len(lines), len(lost), sum(len(WORD.findall(lines[i])) for i in lost), "\n".join(x for i, x in enumerate(lines) if i not in lost)))


def rows_of(df):
    return [repr((r.doc_id, r.n_lines, r.n_deleted_lines, r.n_deleted_words, r.clean_text)) for r in df.collect()]


def test_rows_as_brute_force(spark):
    assert sorted(rows_of(linedup.dedup_lines(documents(spark)))) == sorted(want(odd_texts(), 50))
    assert linedup.dedup_lines(documents(spark, [])).count() == 0


def test_random_runs(spark):
    r = random.Random(11)
    lines = [" ".join(f"w{i}" for _ in range(1 + i % 4)) for i in range(5)] + [""]
    rows = [(k, "\n".join(r.choice(lines) for _ in range(r.randint(1, 30)))) for k in range(40)]
    for least in (1, 7, 16):
        assert sorted(rows_of(linedup.dedup_lines(documents(spark, rows), min_words=least))) == sorted(want(rows, least))


def test_ranks_order_the_suffixes(spark):
    r = random.Random(2)
    seqs = {k: [r.randint(0, 3) for _ in range(20)] for k in range(6)}
    table = spark.createDataFrame([(k, 0, p, s) for k, seq in seqs.items() for p, s in enumerate(seq)], "k long, g long, p int, s long")
    for j, level in enumerate(linedup.suffix_ranks(table, 2)):
        span = 1 << j
        full = [(tuple(seq[p : p + span]), (k, p)) for k, seq in seqs.items() for p in range(len(seq) - span + 1)]
        count = defaultdict(int)
        for prefix, _ in full:
            count[prefix] += 1
        rank = {x: sum(n for y, n in count.items() if n > 1 and y < x) for x in count}
        assert {((x.k, x.p), x.r) for x in level.collect()} == {(at, rank[prefix]) for prefix, at in full if count[prefix] > 1}


def test_keep_first_copies(spark):
    passage = prose(90, 70)
    rows = [(1, "Head.\n" + passage), (2, passage), (3, "Other.\n\n" + passage + "\nTail."), (4, "  "), (5, None)]
    docs = documents(spark, rows)
    out = linedup.keep_first_copies(docs)
    assert out.dtypes == docs.dtypes
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, rows[0][1]), (3, "Other.\n\nTail."), (4, "  "), (5, "")]


def test_query_over_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    gone = brute(rows, 50)
    for r in QUERIES["op2_line_dedup"](spark, SF).collect():
        (key,) = [x for x in gone if x[0] == r.doc_id]
        assert r.n_deleted_lines == len(gone[key])
        assert r.clean_sha256 == hashlib.sha256("\n".join(x for i, x in enumerate(key[1].split("\n")) if i not in gone[key]).encode()).hexdigest()


def test_columns_may_have_any_name(spark):
    run = [prose(50 + i, 20) for i in range(4)]
    rows = [(1, "\n".join([prose(1, 30), *run])), (2, "\n".join([*run, prose(2, 30)]))]
    df = documents(spark, rows).selectExpr("*", "1 as __g", "'d' as __digest", "2 as __K", "3 as __of", "4 as __runs", "5 as ___g")
    kept = linedup.keep_first_copies(df)
    assert kept.columns == df.columns
    assert {r["doc_id"]: (r["text"], r["__g"], r["__runs"]) for r in kept.collect()} == {1: (rows[0][1], 1, 4), 2: (prose(2, 30), 1, 4)}
