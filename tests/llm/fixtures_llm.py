"""Small tables with the awkward rows that every operator has to take."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
WORDS = "amber birch cedar delta ember fjord grove heron inlet jetty knoll larch moss night ocean pine quartz ridge stone thorn umber vale wharf yarrow zenith".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = r.choice(WORDS)
        out.append(w.capitalize() if i % 9 == 0 else w + ("." if i % 9 == 8 or i == n - 1 else ""))
    return " ".join(out)


def odd_texts() -> list[tuple]:
    a = prose(1, 120)
    return [
        (1, a), (1, a), (2, a), (3, a + " One more."), (4, None), (5, ""), (6, " \n \n"), (None, a), (None, "lonely text"), (7, "é" * 70_000 + " Ω<|endoftext|> x"),
        (8, "short"), (9, "short"), (10, "MIT License and Apache License, the General Public License."), (11, "\n".join([prose(2, 60), prose(3, 8), prose(4, 60)])),
        (12, "\n".join([prose(5, 12), prose(4, 60), prose(2, 60)])), (13, "a\n" * 300), (14, "<<<>>> ### | | |"), (15, " " * 9000 + "x"), (16, "中文句子。" * 40), (17, prose(9, 30_000)),
    ]


def documents(spark, rows=None):
    """Rows ``(doc_id, text)`` as documents with further columns whose names clash with operators' own."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    df = spark.createDataFrame(odd_texts() if rows is None else rows, schema)
    return df.selectExpr("doc_id", "text", "'k' as k", "1 as t", "2 as h", "'r' as rep", "0 as digest", "'n' as n_tokens", "1 as class_id", "0 as g", "'s' as sketch", "false as kept", "'c' as clean_text")
