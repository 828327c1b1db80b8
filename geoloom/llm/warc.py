"""WARC archives: written as one gzip stream a file, normalised to one member a record, and read by offset.

``write_archives`` makes whole-file streams, as a plain ``gzip`` of a WARC file does: nothing in them can be
read without inflating all that stands before.  ``normalise`` inflates each stream once, front to back, and
rewrites every record as a gzip member of its own beside a sidecar index (a JSON line a record with its
offset and length).  ``read_records`` fetches members by offset.  All files are in the shared folder; a file
is written under a name of its own and then moved to its place, so that a repeated task replaces it whole.

A payload of ``least`` bytes or more that equals an earlier page's is stored as a revisit record: the HTTP
header of the page without its body, with the digest and the id of the record that holds the body.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, new_step
from .textkit import prepare, squeezed, unsqueezed

LEAST_BYTES = 100
#: Bytes of records after which a task begins another archive.
ARCHIVE_BYTES = 1 << 28
READ_BYTES = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:x-page:(.*)>")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a place that executors share; Hadoop's one-slash form of a file URI is accepted."""
    path = re.sub(r"^file:/(?!/)", "file:///", path).replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(path)


class _Out:
    """A file that appears at its place when it is closed."""

    def __init__(self, path: str):
        self.fs, self.path = _open(path)
        self.fs.create_dir(self.path.rpartition("/")[0])
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out, self.at = self.fs.open_output_stream(self.part, compression=None), 0

    def write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def _urn(page) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def record(page, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:x-none")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, dict[str, str]]:
    """Header fields, payload and HTTP fields of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, payload, _fields(http)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def inflated_records(stream, read: int = READ_BYTES) -> Iterator[bytes]:
    """The records of a gzip stream of any number of members, one after another, with one record in memory."""
    unzip, kept, need = zlib.decompressobj(31), bytearray(), None
    while raw := stream.read(read):
        while raw:
            kept += unzip.decompress(raw)
            raw = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)
            while True:
                if need is None:
                    at = kept.find(b"\r\n\r\n")
                    if at < 0:
                        break
                    need = at + 4 + int(_fields(bytes(kept[:at]))["content-length"]) + 4
                if len(kept) < need:
                    break
                yield bytes(kept[:need])
                del kept[:need]
                need = None
    if kept:
        raise ValueError(f"an archive ends inside a record, {len(kept)} bytes of it are left")


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """``k, u, t, digest, refers_to`` for every page: its compressed payload, and the page it revisits or null.

    Only page ids and digests meet by digest; one with more than one page keeps its smallest id, and a page
    with that id is itself a response.
    """
    base = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("t"))
    light = base.where(F.octet_length("t") >= least).select("k", F.sha2("t", 256).alias("digest"))
    first = light.groupBy("digest").agg(F.min("k").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    # stored before it is joined back, so that Spark deals both sides anew and can split a hot digest
    again = light.join(cut_lineage(first.drop("n")), "digest").where("k is null or k > refers_to").distinct()
    packed = squeezed(base.withColumn("digest", F.sha2("t", 256)), "t")
    same = packed.k.eqNullSafe(again.k) & (packed.digest == again.digest)
    return packed.join(again, same, "left").select(packed.k, packed.u, packed.t, packed.digest, "refers_to").sortWithinPartitions("k", "digest")


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """``path, records`` of the whole-stream archives that hold the planned records; one or more for each task."""
    folder = folder.rstrip("/")
    prepare(planned.sparkSession)

    def run(batches):
        stream = _Stream(f"{folder}/mono-{TaskContext.get().partitionId():06d}")

        def block(rows, texts):
            keys, urls, digests, refers = (rows.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i, page in enumerate(keys):
                stream.add(record(page, urls[i], texts.raw(i), digests[i], refers[i], refers[i] is not None))

        for _ in unsqueezed(block, "t")(batches):
            pass
        made = stream.done()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], ["path", "records"])

    return planned.mapInArrow(run, "path string, records long")


class _Stream:
    """Archives of one task, each a single gzip stream."""

    def __init__(self, stem: str):
        self.stem, self.made, self.out = stem, [], None

    def add(self, raw: bytes) -> None:
        if self.out is None:
            path = f"{self.stem}-{len(self.made):03d}.warc.gz"
            self.out, self.zip, self.size = _Out(path), zlib.compressobj(6, zlib.DEFLATED, 31), 0
            self.made.append([path, 0])
        self.out.write(self.zip.compress(raw))
        self.size += len(raw)
        self.made[-1][1] += 1
        if self.size >= ARCHIVE_BYTES:
            self._end()

    def _end(self) -> None:
        self.out.write(self.zip.flush())
        self.out.close()
        self.out = None

    def done(self) -> list:
        if self.out is not None:
            self._end()
        return self.made


def normalise(archives: DataFrame) -> DataFrame:
    """``path, offset, length`` of every record after each archive of ``archives(path)`` is rewritten by members.

    The new file stands beside the old one, ``.members.warc.gz``, and so does its index, ``.index.jsonl``.
    """

    def one(path: str) -> Iterator[tuple[str, int, int]]:
        stem = path.removesuffix(".warc.gz")
        source, at = _open(path)
        out, index = _Out(f"{stem}.members.warc.gz"), _Out(f"{stem}.index.jsonl")
        with source.open_input_stream(at, compression=None) as stream:
            for raw in inflated_records(stream):
                offset, z = out.at, zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(z.compress(raw) + z.flush())
                fields = _fields(raw[: raw.index(b"\r\n\r\n")])
                entry = {"offset": offset, "length": out.at - offset, "type": fields["warc-type"], "uri": fields["warc-target-uri"], "id": fields["warc-record-id"], "digest": fields["warc-payload-digest"]}
                index.write(json.dumps(entry).encode() + b"\n")
                yield f"{stem}.members.warc.gz", offset, out.at - offset
        out.close()
        index.close()

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = list(one(path))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "offset", "length"])

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(n).mapInArrow(run, "path string, offset long, length long")


def read_records(index: DataFrame, kind: str = "long") -> DataFrame:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload`` of the records at ``path, offset, length``.

    A stored payload is held against the digest in its header; a revisit's size and digest are those of the
    full payload, its ``payload`` is null.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        at, stream = None, None
        for batch in batches:
            rows: list[list] = []
            size = 0
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != at:
                    source, place = _open(path)
                    at, stream = path, source.open_input_file(place)
                stream.seek(offset)
                fields, payload, http = parse(zlib.decompress(stream.read(length), 31))
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                revisit = fields["warc-type"] == "revisit"
                if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{path} at {offset}: the payload does not have the digest of its header")
                ids = [_ID.fullmatch(fields.get(x, ""))for x in ("warc-record-id", "warc-refers-to")]
                rows.append([ids[0][1] or None, fields["warc-target-uri"], fields["warc-type"], ids[1][1] if ids[1] else None, int(http["content-length"]), digest, None if revisit else payload])
                size += len(payload)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    out = index.mapInArrow(run, "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def archive(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Write ``pages`` as whole-stream archives, normalise them, and return the records read back.

    A null page has an empty payload, a null url the URI ``urn:x-none``; rows that repeat a page id and its
    payload are all responses or all revisits; a null id is written empty and comes back null, and never is
    the one others revisit; an empty table gives no archives and no rows; other columns are not read.
    """
    folder = folder or new_step(pages.sparkSession)
    made = cut_lineage(write_archives(plan_records(pages, key, url, html, least), folder))
    index = cut_lineage(normalise(made))
    return read_records(index, pages.schema[key].dataType.simpleString()).withColumnRenamed("page_id", key)
