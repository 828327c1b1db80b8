import math
import random
import zlib

import numpy as np
from fixtures_llm import documents, odd_texts

from geoloom.llm import bpe, packing


def check(rows, texts, capacity):
    c = bpe.codec(bpe.default_path())
    want = {}
    for k, t in texts:
        ids = np.append(c.encode(t or ""), 0).astype("<u4")
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.setdefault((k, n, a, b - a, zlib.crc32(ids[a:b].tobytes())), []).append(1)
    got = {}
    places = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), sum(r.length for r in rows)


def test_pack(spark):
    out = packing.pack(documents(spark), 64)
    n, total = check(out.collect(), odd_texts(), 64)
    assert n <= math.ceil(total / 64) + 3
    assert packing.pack(documents(spark, [])).count() == 0


def test_plan_is_whole_and_tight():
    r = random.Random(3)
    for n, capacity in ((0, 100), (1, 100), (3000, 512), (60_000, 1024)):
        counts = {}
        for _ in range(n):
            length = min(capacity, 1 + int(r.expovariate(3 / capacity)))
            counts[length] = counts.get(length, 0) + 1
        plan, got = packing.solve(dict(counts), capacity), {}
        for column, times in plan.items():
            assert sum(a * b for a, b in column) <= capacity
            for a, b in column:
                got[a] = got.get(a, 0) + b * times
        assert got == counts
        assert sum(plan.values()) <= math.ceil(sum(a * b for a, b in counts.items()) / capacity) * 1.003 + 1


def test_hot_length():
    plan = packing.solve({700: 10_000_000, 640: 5_000_000, 2048: 7, 3: 2}, 2048)
    assert sum(plan.values()) <= 7 + (10_000_000 + 5_000_000) / 3 * 1.001 + 2


def test_lengths_that_never_fill_a_sequence():
    for n in (10, 100, 3000):
        assert sum(packing.solve({900: n, 600: n, 500: n}, 2048).values()) == n
    assert sum(packing.solve({1100: 40, 700: 40, 240: 40}, 2048).values()) == 40
    assert packing.solve({}, 2048) == {}
    assert packing.solve({1500: 1}, 2048) == {((1500, 1),): 1}
