"""Run traces: append-only JSON lines, read in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "type string, ts string, cell_id string, run_id string, model string, prompt string, status string, output string, "
    "error string, usage string, conversation_id string, messages string, response string, step string"
)
STEP = "type string, name string, args string, content string, tool_call_id string, reasoning boolean"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Record columns of a ``value`` text; blank and corrupt lines are skipped."""
    whole = F.trim(F.col("value"))
    body = F.from_json(whole, RECORD + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rest = [c for c in lines.columns if c != "value"]
    parsed = lines.where(whole != "").select(*rest, body.alias("r"))
    return parsed.where("r._bad is null and r.type is not null").select(*rest, "r.*").drop("_bad")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """All trace records under a folder with the file they came from."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    return parse_lines(lines)


def stream_trace(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.readStream.format("text").load(path))


def steps_of(records: DataFrame) -> DataFrame:
    """The step records with their fields as columns."""
    step = F.from_json("step", STEP)
    rest = [c for c in ("cell_id", "seq", "step_index", "ts") if c in records.columns]
    return records.where("type = 'step'").select(*rest, step.alias("s")).select(*rest, "s.*")


def write_trace(records: DataFrame, path: str) -> None:
    """Records as JSON lines partitioned by cell; a rerun replaces only its own cells."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell_id").json(path)
