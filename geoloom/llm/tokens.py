"""Token counts: batch encoding in Arrow tasks that returns lengths only.

Batches are balanced by bytes.  A text above ``long_bytes`` is cut at safe boundaries (places that every
match of the word pattern respects, so that the counts of the parts add up), its parts are dealt out over
all tasks, and their counts are summed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec, default_path, pieces
from .textkit import arrow_map

#: Bytes above which a text is counted in parts; of one part.
LONG_BYTES = 1 << 18
PART_BYTES = 1 << 16


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 512, path: str | None = None, long_bytes: int = LONG_BYTES) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    A null text counts as empty: 0 bytes, 0 tokens, not over the limit.  A null key stays null; repeated rows
    give repeated results; an empty table gives none; other columns are not read.
    """
    path = path or default_path()
    kind = docs.schema[key].dataType.simpleString()
    base = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    short = base.where(F.octet_length("t") <= long_bytes)
    long = base.where(F.octet_length("t") > long_bytes).withColumn("h", F.xxhash64("t"))

    def count(rows, texts):
        c = codec(path)
        n = [len(c.encode(texts.raw(i).decode())) for i in range(len(texts))]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts.lengths()), pa.array(n, pa.int64())], ["k", "n_bytes", "n_tokens"])

    def cut(rows, texts):
        parts = [pieces(texts.raw(i), PART_BYTES) for i in range(len(texts))]
        many = np.array([len(p) for p in parts])
        take = pa.array(np.repeat(np.arange(len(texts)), many))
        return pa.RecordBatch.from_arrays(
            [rows.column(0).take(take), rows.column(2).take(take), pa.array(np.repeat(texts.lengths(), many)), pa.array(np.concatenate([np.arange(m) for m in many])), pa.array([x.decode() for p in parts for x in p], pa.string())],
            ["k", "h", "n_bytes", "part", "t"],
        )

    def count_part(rows, texts):
        c = codec(path)
        n = [len(c.encode(texts.raw(i).decode())) for i in range(len(texts))]
        return pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(n, pa.int64())], ["k", "h", "n_bytes", "part", "n"])

    parts = arrow_map(long, cut, f"k {kind}, h long, n_bytes long, part long, t string", "t").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    summed = arrow_map(parts, count_part, f"k {kind}, h long, n_bytes long, part long, n long", "t").groupBy("k", "h", "n_bytes")
    # rows that are equal in every way share a sum; each of them has one part 0
    summed = summed.agg(F.sum("n").alias("n"), F.count_if(F.col("part") == 0).alias("rows"))
    whole = summed.select("k", "n_bytes", F.expr("n div rows").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy")).drop("copy")
    counted = arrow_map(short, count, f"k {kind}, n_bytes long, n_tokens long", "t").unionByName(whole)
    return counted.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
