"""WARC archives with an index that comes first, and reads of byte ranges through it.

Writing: each page becomes one compressed record. Pages whose equal payload (of at least `min_bytes`)
another page with a larger id has become revisit records. A task appends its records to archives of
about `archive_bytes` in the shared folder and returns an index row for each: file, offset, length, url
and digest. Files get names that no other attempt uses, and Spark keeps the index rows of the attempt
that counts, so a lost executor leaves at most a file no row points to.

Reading starts from the index: the selected records of an archive are sorted by offset, neighbouring
ranges are read in one go, and every payload is checked against its digest.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import Stages, query, table
from themeloom.sources.scan import shared_folder

MIN_BYTES = 1_000
ARCHIVE_BYTES = 256 * 1024 * 1024
GAP_BYTES = 64 * 1024
READ_BYTES = 4 * 1024 * 1024
DATE = "2024-01-01T00:00:00Z"

INDEX = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, file string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload string"


def uri(folder: str) -> str:
    """A folder as Spark names it (`file:/x`, `/x`, `s3://b/x`) for Arrow's file systems."""
    folder = re.sub(r"^file:/+", "/", folder)
    return "file://" + folder if folder.startswith("/") else folder


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None, kind: str):
    """One WARC 1.1 record as a gzip member of its own; a revisit holds the HTTP head only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    profile = ""
    if kind == "revisit":
        same = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        profile = f"WARC-Profile: {same}\r\nWARC-Refers-To: {record_id(refers_to)}\r\n"
    else:
        block += payload
    target = "" if url is None else f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}\r\n"
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_id(page_id)}\r\nWARC-Date: {DATE}\r\n{target}{profile}"
        f"WARC-Payload-Digest: sha1:{digest}\r\nX-Payload-Length: {len(payload)}\r\n"
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 4, mtime=0)


def parse_record(data: bytes) -> dict:
    """The fields of one record and its payload."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"cut record {fields.get('WARC-Record-ID')}")
    fields["payload"] = block.partition(b"\r\n\r\n")[2]
    return fields


def id_of(field: str | None) -> int | None:
    value = field[len("<urn:x-page:") : -1] if field else "null"
    return None if value == "null" else int(value)


def write_warc(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of `pages` (page_id, url, html; other columns are left out) and their index.

    A null html is an empty payload, a null url gives a record without a target. Of equal payloads of at
    least min_bytes the largest page_id is the response; rows that repeat that id are responses as well,
    null ids come before all others. Only digests that occur twice are joined back, and the join's
    sides can be split by Spark, so a payload that a third of all pages share spreads over tasks. The
    index is lazy: store it before reading, as a second run writes other archives.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    hashed = pages.select(
        "page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"),
        F.octet_length(payload).cast("long").alias("bytes"),
    )
    packed = hashed.mapInArrow(_pack, "page_id long, url string, digest string, bytes long, member binary")
    repeated = (
        hashed.where(F.col("bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("same"), "largest")
    )
    typed = packed.join(repeated, (F.col("digest") == F.col("same")) & (F.col("bytes") >= min_bytes), "left").select(
        "page_id", "url", "digest", "bytes", "member", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"),
    )
    return typed.mapInArrow(_writer(uri(folder), archive_bytes), INDEX)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Response records, compressed before they move."""
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            ids, urls, texts, digests, sizes = (c.to_pylist() for c in part.columns)
            members = [
                build_record(i, u, d, t.encode(), None, "response")
                for i, u, d, t in zip(ids, urls, digests, texts, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(3), part.column(4), pa.array(members, pa.binary())],
                ["page_id", "url", "digest", "bytes", "member"],
            )


def _writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "file", "offset", "length"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        stream, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for row in batch.to_pylist():
                    kind = "response" if row["refers_to"] is None else "revisit"
                    member = row["member"]
                    if kind == "revisit":
                        member = _revisit(member, row)
                    if stream is None or at >= archive_bytes:
                        if stream is not None:
                            stream.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        system.create_dir(base, recursive=True)
                        stream = system.open_output_stream(f"{base}/{name}", compression=None)
                    stream.write(member)
                    rows.append((row["page_id"], row["url"], kind, row["refers_to"], row["digest"], row["bytes"], name, at, len(member)))
                    at += len(member)
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)
        finally:
            if stream is not None:
                stream.close()

    return run


def _revisit(member: bytes, row: dict) -> bytes:
    payload = parse_record(member)["payload"]
    return build_record(row["page_id"], row["url"], row["digest"], payload, row["refers_to"], "revisit")


def read_warc(index: DataFrame, folder: str, gap_bytes: int = GAP_BYTES, read_bytes: int = READ_BYTES) -> DataFrame:
    """The records that the index rows select: RECORDS; a revisit has no payload.

    Ranges of one archive go to one task (an archive is bounded), sorted by offset. Ranges at most
    gap_bytes apart are read together, up to read_bytes at a time. A digest that does not fit stops it.
    """
    ranges = index.select("file", "offset", "length", "payload_digest").repartition("file")
    return ranges.sortWithinPartitions("file", "offset").mapInArrow(_reader(uri(folder), gap_bytes, read_bytes), RECORDS)


def _reader(folder: str, gap_bytes: int, read_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        handles: dict = {}
        for batch in batches:
            group: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file, offset, length, _ = row
                if group:
                    end = group[-1][1] + group[-1][2]
                    apart = file != group[0][0] or offset - end > gap_bytes
                    if apart or offset + length - group[0][1] > read_bytes:
                        yield _records(system, base, handles, group)
                        group = []
                group.append(row)
            if group:
                yield _records(system, base, handles, group)
        for handle in handles.values():
            handle.close()

    return run


def _records(system, base: str, handles: dict, group: list[tuple]) -> pa.RecordBatch:
    """One read for a run of neighbouring ranges."""
    file, start = group[0][:2]
    if file not in handles:
        for handle in handles.values():
            handle.close()
        handles.clear()
        handles[file] = system.open_input_file(f"{base}/{file}")
    data = handles[file].read_at(group[-1][1] + group[-1][2] - start, start)
    out: dict[str, list] = {f.split()[0]: [] for f in RECORDS.split(", ")}
    for _, offset, length, digest in group:
        fields = parse_record(data[offset - start : offset - start + length])
        revisit = fields["WARC-Type"] == "revisit"
        payload = fields["payload"]
        if fields["WARC-Payload-Digest"] != f"sha1:{digest}" or (not revisit and hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"{file} at {offset}: digest differs")
        out["page_id"].append(id_of(fields["WARC-Record-ID"]))
        out["url"].append(fields.get("WARC-Target-URI"))
        out["record_type"].append(fields["WARC-Type"])
        out["refers_to"].append(id_of(fields.get("WARC-Refers-To")))
        out["payload_digest"].append(digest)
        out["payload_bytes"].append(int(fields["X-Payload-Length"]))
        out["payload"].append(None if revisit else payload.decode())
    types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.string())) for k, v in out.items()], list(out))


@query(
    "op10_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
       m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS largest FROM p)
       SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
         CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
         CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to FROM m""",
)
def op10(spark, sf):
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    index = Stages(spark).keep(write_warc(table(spark, sf, "pages"), folder))
    return read_warc(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
