"""Live run traces with Structured Streaming: ingestion, text folding, usage totals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.catalog import collapse_space
from ..operators.history import flatten_usage
from ..sources.traces import parse_lines

BLOCK_SCHEMA = "cell_id long, step_index long, text string"
STATE_SCHEMA = "next_index long, start long, chunks array<string>, waiting array<struct<i:long,kind:string,content:string>>"


def ingest(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append parsed trace records to a Parquet table, exactly once per input file."""
    return (
        parse_lines(lines).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def fold_text_stream(steps: DataFrame, first_index: int = 0) -> DataFrame:
    """Finished text blocks as they close, one row each.

    ``steps`` has ``cell_id, step_index, type, content, reasoning``; the indices of a cell
    rise by one.  Steps that arrive early wait in the cell's state until the gap before
    them is filled, so late lines do not change the result.  A ``result`` step closes the
    pending block and drops the state.
    """
    rows = steps.select(
        F.col("cell_id").cast("long").alias("cell_id"), F.col("step_index").cast("long").alias("step_index"),
        F.when(F.col("type") == "result", "end")
        .when(F.col("type").isin("text", "text_delta") & ~F.coalesce("reasoning", F.lit(False)), F.col("type"))
        .otherwise("break").alias("kind"),
        F.coalesce("content", F.lit("")).alias("content"),
    )

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            nxt, start, chunks, waiting = state.get
            chunks, waiting = list(chunks), {w[0]: (w[1], w[2]) for w in waiting}
        else:
            nxt, start, chunks, waiting = first_index, -1, [], {}
        for pdf in batches:
            for i, kind, content in zip(pdf["step_index"], pdf["kind"], pdf["content"]):
                if int(i) >= nxt:
                    waiting[int(i)] = (kind, content)
        out, ended = [], False
        while nxt in waiting and not ended:
            kind, content = waiting.pop(nxt)
            visible = kind in ("text", "text_delta")
            if (not visible or (kind == "text" and content)) and chunks:
                out.append((start, "".join(chunks)))
                chunks = []
            if visible and content:
                start = nxt if not chunks else start
                chunks.append(content)
            ended = kind == "end"
            nxt += 1
        if ended:
            state.remove()
        else:
            state.update((nxt, start, chunks, [(i, *w) for i, w in sorted(waiting.items())]))
        yield pd.DataFrame(
            {"cell_id": [key[0]] * len(out), "step_index": [o[0] for o in out], "text": [o[1] for o in out]}
        )

    blocks = rows.groupBy("cell_id").applyInPandasWithState(fold, BLOCK_SCHEMA, STATE_SCHEMA, "append", "NoTimeout")
    return blocks.withColumn("text", collapse_space(F.col("text"))).where("text <> ''")


def usage_totals(rows: DataFrame) -> DataFrame:
    """Running usage per model from a stream of ``model, usage`` rows (update mode)."""
    return flatten_usage(rows).groupBy("model").agg(
        F.count(F.lit(1)).alias("responses"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("cache_read_tokens").alias("cache_read_tokens"),
    )
