import math

import numpy as np
from fixtures_llm import SF

from geoloom.llm import vectors
from geoloom.llm.queries import QUERIES


def brute(rows, threshold=0.93):
    """Rows ``vec_id, embedding, label``: links and components by comparing all pairs of one label."""
    distinct: dict = {}
    for k, v, label in rows:
        if k is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = tuple(float(np.float32(x)) + 0.0 for x in v)
            while not v[-1]:
                v = v[:-1]
            distinct.setdefault((label, v), set()).add(k)
    nodes = list(distinct)
    width = max([len(v) for _, v in nodes], default=1)
    x = np.array([np.pad(v, (0, width - len(v))) for _, v in nodes]).reshape(-1, width)
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x
    like = (x @ x.T >= threshold) & (np.array([[a[0] == b[0] for b in nodes] for a in nodes]).reshape(len(nodes), len(nodes)))
    many = np.array([len(distinct[n]) for n in nodes])
    links = {n: int(like[i] @ many) - 1 for i, n in enumerate(nodes)}
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(like)):
        root[find(i)] = find(j)
    least: dict = {}
    for i, n in enumerate(nodes):
        least[find(i)] = min(least.get(find(i), math.inf), *distinct[n])
    own = {n: least[find(i)] for i, n in enumerate(nodes)}
    out = []
    for k, v, label in rows:
        v = None if v is None or any(x is None for x in v) else tuple(float(np.float32(x)) + 0.0 for x in v)
        while v and not v[-1]:
            v = v[:-1]
        n = (label, v)
        here = k is not None and n in distinct
        c = own[n] if here else k
        out.append((k, links[n] if here else 0, c, True if k is None else k == c))
    return sorted(out, key=repr)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", "1 as k", "'x' as node", "0 as v", "5 as core", "'a' as bucket", "2 as n", "3 as home", "4 as part", "'t' as table", "6 as pos", "7 as names")


def got(df):
    return sorted(map(tuple, vectors.near_vectors(df).collect()), key=repr)


def around(r, base, cosine, n):
    """``n`` unit vectors at the given cosine to ``base``."""
    w = r.normal(size=(n, len(base)))
    w -= (w @ base)[:, None] * base
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    return cosine * base + math.sqrt(1 - cosine**2) * w


def unit(r, width=64):
    v = r.normal(size=width)
    return v / np.linalg.norm(v)


def test_rows_as_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=64).tolist(), i % 3) for i in range(150)]
    base = unit(r)
    rows += [(1000 + i, v.tolist(), 1) for i, v in enumerate(around(r, base, 0.998, 120))]  # a hot group: a core
    rows += [(2000 + i, v.tolist(), 1) for i, v in enumerate(around(r, base, 0.955, 40))]  # at its rim
    rows += [(3000 + i, (7.5 * base).tolist(), 1) for i in range(5)] + [(3100, base.tolist(), 2)]
    rows += [(4000, None, 1), (4001, base.tolist(), None), (4002, [0.0] * 64, 1), (4003, [float("nan")] + [1.0] * 63, 1), (4004, [None] + [1.0] * 63, 1), (4005, [float("inf")] * 64, 1), (None, base.tolist(), 1)]
    rows += [(4006, [], 1), (4007, [1.0, 2.0], 1), (4008, [1.0, 2.0, 0.0, -0.0], 1), (4009, [3e38] * 64, 1), (4010, [1e-44] * 64, 1)]
    rows += [rows[0], rows[150], (1000, rows[5][1], 1), (-5, rows[160][1], 1)]
    assert got(frame(spark, rows)) == brute(rows)
    assert got(frame(spark, [])) == []


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vectors, "CORE_ROWS", 8)
    r = np.random.default_rng(6)
    base = unit(r)
    rows = [(i, v.tolist(), 0) for i, v in enumerate([*around(r, base, 0.995, 90), *around(r, base, 0.96, 70)])]
    assert got(frame(spark, rows)) == brute(rows)
    monkeypatch.setattr(vectors, "CORE_ROWS", 10**9)  # no cores: everything compared
    assert got(frame(spark, rows)) == brute(rows)


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, the hardest to find, against brute force."""
    r = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        base = unit(r)
        rows += [(2 * i, base.tolist(), 0), (2 * i + 1, around(r, base, 0.9305, 1)[0].tolist(), 0)]
    want, have = brute(rows), got(frame(spark, rows))
    found = sum(x[1] for x in have) / sum(x[1] for x in want)
    print("recall", found)
    assert found >= 0.995
    assert all(x[1] <= y[1] for x, y in zip(have, want))


def test_query_over_the_whole_table(spark):
    rows = [(x.vec_id, x.embedding, x.label) for x in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_near_vectors"](spark, SF).collect()), key=repr) == brute(rows)
