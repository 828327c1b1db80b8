import gzip
import hashlib
import io
import json
import os
import zlib

from fixtures_llm import SF
from pyspark.sql import types as T

from geoloom.llm import warc
from geoloom.llm.queries import QUERIES

ROWS = [
    (1, "http://a/", "x" * 200), (2, "http://a/", "x" * 200), (3, None, "x" * 200), (3, None, "x" * 200), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""),
    (8, "u v\r\nX: y", "é" * 50), (9, "u", "é" * 50), (None, "u", "y" * 150), (10, "u", "y" * 150), (11, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (12, "u", "z" * 3_000_000),
]


def pages(spark, rows=ROWS):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
    return spark.createDataFrame(rows, schema).selectExpr("*", "1 as k", "'d' as digest", "0 as t", "0 as refers_to", "'p' as path")


def want(rows):
    first = {}
    for k, _, h in rows:
        if k is not None and len((h or "").encode()) >= 100:
            first[h] = min(k, first.get(h, k))
    for k, _, h in rows:
        raw = (h or "").encode()
        at = first.get(h) if len(raw) >= 100 else None
        again = at is not None and (k is None or k > at)
        yield repr((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", at if again else None))


def test_archive_round_trip(spark):
    got = [repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in warc.archive(pages(spark)).collect()]
    assert sorted(got) == sorted(want(ROWS))
    assert warc.archive(pages(spark, [])).count() == 0


def test_query_over_the_whole_table(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = [repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in QUERIES["op7_warc"](spark, SF).collect()]
    assert sorted(got) == sorted(want(rows))


def test_files(spark, tmp_path):
    made = warc.write_archives(warc.plan_records(pages(spark)), f"file://{tmp_path}").collect()
    assert sum(r.records for r in made) == len(ROWS)
    for r in made:
        raw = open(r.path.removeprefix("file://"), "rb").read()
        one = zlib.decompressobj(31)
        one.decompress(raw)
        assert one.eof and not one.unused_data  # a single stream
    index = warc.normalise(spark.createDataFrame([(r.path,) for r in made], "path string")).collect()
    assert len(index) == len(ROWS)
    for path in {r.path for r in index}:
        place = path.removeprefix("file://")
        raw = open(place, "rb").read()
        entries = [json.loads(x) for x in open(place.replace(".members.warc.gz", ".index.jsonl"))]
        assert [(e["offset"], e["length"]) for e in entries] == sorted((r.offset, r.length) for r in index if r.path == path)
        for e in entries:  # each member stands alone
            fields, payload, http = warc.parse(gzip.decompress(raw[e["offset"] : e["offset"] + e["length"]]))
            assert fields["warc-record-id"] == e["id"] and fields["warc-type"] == e["type"]
            assert len(payload) == (0 if e["type"] == "revisit" else int(http["content-length"]))
        assert list(warc.inflated_records(io.BytesIO(raw), 7)) == list(warc.inflated_records(io.BytesIO(raw)))
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".part")]
