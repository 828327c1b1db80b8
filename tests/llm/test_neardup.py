import math
import re
from collections import Counter

import numpy as np
from fixtures_llm import SF, documents, odd_texts, prose

from geoloom.llm import neardup
from geoloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def bag(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def like(a, b):
    plain = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    x, y = ({g: 1 + math.log2(n) for g, n in s.items()} for s in (a, b))
    every = x.keys() | y.keys()
    return max(plain, sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x.keys() & y.keys()))


def classes(rows, threshold=0.8, exact=True):
    """Brute force over all pairs of rows with an id: the class of each."""
    bags = [(k, bag(t)) for k, t in rows if k is not None]
    root = {k: k for k, _ in bags}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, x) in enumerate(bags):
        for b, y in bags[:i]:
            if x and y and len(x.keys() & y.keys()) >= 0.4 * max(len(x), len(y)) and (like(x, y) if len(x) < 400 else len(x.keys() & y.keys()) / len(x.keys() | y.keys())) >= threshold:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in root}


def edited(text, every, seed=0):
    words = text.split()
    for i in range(seed % every, len(words), every):
        words[i] = f"new{seed}x{i}"
    return " ".join(words)


def test_classes_as_brute_force(spark):
    base = prose(70, 300)
    rows = odd_texts() + [(500, base)] + [(501 + s, edited(base, 60, s)) for s in range(8)] + [(520, edited(base, 20, 3)), (521, edited(base, 12, 5)), (530, prose(71, 300) + base[:200])]
    out = neardup.near_duplicates(documents(spark, rows)).collect()
    want = classes(rows)
    assert len(out) == len(rows)
    assert {r.doc_id: r.class_id for r in out if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in out if r.doc_id is not None)
    # rows without an id: one repeats the words of row 1, the other has its own
    assert sorted(repr((r.class_id, r.kept)) for r in out if r.doc_id is None) == sorted(map(repr, [(1, False), (None, True)]))
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    kept = neardup.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns


def test_large_bands_are_cut_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART_ROWS", 8)
    base = prose(80, 400)
    rows = [(1000, base)] + [(i, edited(base, 50, i)) for i in range(60)]  # each is near the base, few are near each other
    out = neardup.near_duplicates(documents(spark, rows)).collect()
    assert {r.class_id for r in out} == {0}


def grown(text, more, seed):
    """``text`` with ``more`` words of its own at its end."""
    return text + "".join(f" own{seed}x{i}" for i in range(more))


def test_one_link_among_many_pairs_below_it(spark):
    base = prose(14, 420)
    rows = [(i, grown(base, 10, f"a{i}")) for i in range(30)]
    rows += [(30 + i, grown(grown(base, 10, f"b{i}" if i else "a0"), 100, "s14b")) for i in range(30)]  # 0 and 30: 0.83, the others 0.79
    want = classes(rows)
    assert set(want.values()) == {0}
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(documents(spark, rows)).collect()} == want


def test_links_across_parts_of_a_band(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART_ROWS", 2)
    monkeypatch.setattr(neardup, "CENTRAL", 0)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 4, raising=False)
    base = prose(92, 420)
    rows = [(i, grown(base, 60, f"t{i}")) for i in range(60)]  # a template that does not itself occur: 0.78
    rows += [(100 + i, grown(grown(base, 9, f"l{i % 15}"), 51, f"u{i}")) for i in range(30)]  # pairs of the same i % 15: 0.81
    big = grown(base, 60, "big")
    rows += [(200 + i, edited(big, 140, i)) for i in range(20)]  # one large component
    want = classes(rows)
    assert 20 < len(set(want.values())) < 90
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(documents(spark, rows)).collect()} == want


def test_registers_estimate_probability_jaccard():
    r = np.random.default_rng(3)
    a = {int(h): w for h, w in zip(r.integers(1, 2**62, 300), r.uniform(0.5, 3, 300))}
    b = dict(list(a.items())[:220]) | {int(h): w for h, w in zip(r.integers(1, 2**62, 90), r.uniform(0.5, 3, 90))}
    sets = [a, b]
    of = np.repeat([0, 1], [len(a), len(b)])
    m = 4096
    found = neardup.registers(of, np.array([h for s in sets for h in s], np.uint64), np.array([w for s in sets for w in s.values()]), 2, m)
    every = a.keys() | b.keys()
    exact = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in every) for i in a.keys() & b.keys())
    assert abs((found[0] == found[1]).mean() - exact) < 0.03
    x, y = (tuple(np.array(c) for c in zip(*sorted(s.items()))) for s in sets)
    plain = len(a.keys() & b.keys()) / len(every)
    assert abs(neardup.similarity(x, y) - max(plain, exact)) < 1e-9


def test_query_over_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert {r.doc_id: r.class_id for r in QUERIES["op5_near_duplicates"](spark, SF).collect()} == classes(rows)
