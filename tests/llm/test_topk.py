import math
import random

import numpy as np
from fixtures_llm import SF

from geoloom.llm import topk
from geoloom.llm.queries import QUERIES


def brute(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault((i, tuple(math.floor(256 * float(np.float32(x))) for x in v)), 1)
    out = []
    for q, a in good:
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_rows_as_brute_force(spark):
    r = random.Random(5)
    same = [0.5] * 8
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(1000 + i, same) for i in range(200)]
    rows += [(0, rows[0][1]), (2000, None), (2050, [float("nan")] + [0.0] * 7), (2100, [None] + [0.0] * 7), (2150, [float("inf")] * 8), (None, same), (2200, [1.0, 2.0]), (2250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as k", "0 as v", "'b' as block", "3 as rank", "9 as score")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_k(df).collect())
    assert got == brute(rows, 5)
    assert topk.top_k(df.where("vec_id in (50, 51)")).count() == 1
    assert topk.top_k(df.limit(0)).count() == 0


def test_bounds_prove_the_answer():
    r = np.random.default_rng(2)
    x = r.integers(-600, 600, (900, 16))
    x[:30] += 2000
    index = topk.Index(np.arange(900), x)
    for q in range(0, 60, 7):
        want = sorted((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q)[:5]
        assert index.search(q, x[q], 5) == [(i, -s) for s, i in want]
        assert index.search(q, x[q], 5, rounds=16, few=0) == [(i, -s) for s, i in want]
    huge = topk.Index(np.arange(3), np.array([[2**30], [2**29], [1]]))
    assert huge.search(0, np.array([2**30]), 1) == [(1, 2**59)]


def test_query_over_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in QUERIES["op3_exact_topk"](spark, SF).collect()) == brute(rows, 5)


def test_cells_hold_vectors_and_nothing_wider(spark, monkeypatch):
    """Blocks and queries meet group by group: rows of megabytes that Spark takes for small ones were broadcast."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 60)
    monkeypatch.setattr(topk, "INDEX_ROWS", 60)
    monkeypatch.setattr(topk, "PART_ROWS", 2)
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(600)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert "Broadcast" not in found._jdf.queryExecution().toString()
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in found.collect()) == brute(rows, 5)


def test_a_cell_of_several_indexes_and_batches(monkeypatch):
    monkeypatch.setattr(topk, "INDEX_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 16)
    monkeypatch.setattr(topk, "PAIR_ROWS", 100)
    r = np.random.default_rng(3)
    plain, skewed, few = r.integers(-150, 150, (500, 12)), r.integers(-90, 90, (500, 12)), r.integers(-1, 2, (500, 3))
    skewed[:, 0] *= 40
    huge = r.integers(-(2**29), 2**29, (500, 2))
    for x in (plain, skewed, few, huge, np.full((500, 2), 7), plain[:3], np.zeros((9, 0), np.int64)):
        ids = r.permutation(len(x))
        names, q = ids[::7], x[::7]
        want = []
        for name, row in zip(names, q):
            hits = sorted((-int(s), int(i)) for i, s in zip(ids, x @ row) if i != name)
            want += [(int(name), i, -s) for s, i in hits[:5]]
        assert sorted(zip(*(c.tolist() for c in topk.search_cell(ids, x, names, q, 5)))) == sorted(want)
