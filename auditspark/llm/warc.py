"""WARC archives: writing pages with revisits for equal payloads, and a splittable reader.

Writing: each record is a gzip member of its own. Tasks write archives under names that no other attempt uses, and the
written list of archives names those of the attempts that succeeded, so that a lost executor leaves at most a file that
nobody reads. Equal payloads are found by their SHA-1; the record with the largest page_id carries the payload, the
others are ``revisit`` records that refer to it. A payload that very many pages share is one row per task after
partial sums, and its join can be split.

Reading: archives are cut into byte ranges. A task looks for the gzip magic number in its range, takes a place as a
member only if its decoded beginning is a WARC header, and owns the records that begin inside its range, reading on past
the range's end where the last one does. After a record it goes on where the member ended. Bytes that are no member
are passed over, and so are members whose end is missing or damaged.

A null html is an empty payload. A null page_id is the smallest. Rows that repeat the page_id and the payload of a
response are responses too. A null url leaves the header out; line breaks in it are escaped. An empty table makes no archive
and gives no records. Very long payloads are held by one task, one at a time. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections import deque

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.batches import prepare
from auditspark.llm.tables import FILES
from auditspark.session import shared_folder, stored

#: payloads from this many bytes on are looked for again
LEAST = 0
#: bytes of a range that one task reads, and of an archive before the next one is begun
RANGE, ARCHIVE = 8 << 20, 256 << 20
DATE = "2020-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base-32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """A gzip member with one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def write(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write one record per page, and return the written list ``(path, size)`` of archives."""
    spark = prepare(pages.sparkSession)
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = slim.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    first = keyed.where(F.octet_length("html") >= least).groupBy("sha").agg(F.max("page_id").alias("response_id"))
    known = keyed.join(first, "sha", "left").withColumn("revisit", F.coalesce(F.octet_length("html") >= least, F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("response_id")))
    folder = f"{shared_folder(spark)}/auditspark-warc-{uuid.uuid4().hex}"

    def run(batches):
        out, path, size = None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    files, root = _file_system(folder)
                    files.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, size = f"{folder}/{name}", 0
                    out = files.open_output_stream(posixpath.join(root, name), compression=None)
                member = record(row["page_id"], row["url"], row["html"].encode(), row["response_id"], row["revisit"])
                out.write(member)
                size += len(member)
                if size >= ARCHIVE:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "size": [size]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size]})

    # a few archives for each core
    rows = known.select("page_id", "url", "html", "response_id", "revisit").coalesce(FILES * spark.sparkContext.defaultParallelism)
    made = rows.mapInArrow(run, "path string, size long")
    return stored(made, "archives")


def _file_system(path: str):
    return fs.FileSystem.from_uri(path)


class _Range:
    """Bytes of a file from a place on, read in chunks that are let go when they are passed."""

    def __init__(self, stream, start: int):
        self.stream, self.base, self.size, self.chunks = stream, start, 0, deque()
        stream.seek(start)

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from place ``at`` of the file; fewer at its end."""
        while self.base + self.size < at + n:
            more = self.stream.read(_CHUNK)
            if not more:
                break
            self.chunks.append(more)
            self.size += len(more)
        found, place = [], self.base
        for chunk in self.chunks:
            if place >= at + n:
                break
            if place + len(chunk) > at:
                found.append(chunk[max(0, at - place):at + n - place])
            place += len(chunk)
        return b"".join(found)

    def forget(self, at: int) -> None:
        """Nothing before ``at`` is asked for again."""
        while self.chunks and self.base + len(self.chunks[0]) <= at:
            self.base += len(self.chunks[0])
            self.size -= len(self.chunks.popleft())


def _member(source: _Range, at: int) -> tuple[bytes, int] | None:
    """The decoded member that begins at ``at`` and the place after it; None if there is no whole WARC record."""
    unpack, parts, place, seen = zlib.decompressobj(31), [], at, b""
    while not unpack.eof:
        data = source.get(place, _CHUNK)
        if not data:
            return None
        try:
            out = unpack.decompress(data)
        except zlib.error:
            return None
        if len(seen) < 7:
            seen += out[:7]
            if not b"WARC/1.".startswith(seen[:7]):
                return None
        parts.append(out)
        place += len(data)
    return (b"".join(parts), place - len(unpack.unused_data)) if seen[:7] == b"WARC/1." else None


def records_of(stream, start: int, end: int):
    """(headers, block) of each record that begins in [start, end) of a file."""
    source, at = _Range(stream, start), start
    while at < end:
        window = source.get(at, _CHUNK + 2)
        found = window.find(_MAGIC)
        if found < 0 or at + found >= end:
            if found >= 0 or len(window) < _CHUNK + 2:
                return
            at += _CHUNK
            source.forget(at)
            continue
        at += found
        member = _member(source, at)
        if member is None:
            at += 1
            continue
        content, at = member
        source.forget(at)
        head, _, rest = content.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        yield fields, rest[:int(fields.get("Content-Length", 0))]


_FIELDS = {"record_id": pa.string(), "record_type": pa.string(), "target_uri": pa.string(), "refers_to": pa.string(),
           "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}


def _parsed(fields: dict, block: bytes, payloads: bool) -> tuple:
    """A row of the record. A response's digest is worked out from its payload, a revisit's is that of its header."""
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields.get("WARC-Type") == "revisit"
    length = next((int(line[15:]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")), len(payload))
    said = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    return (fields.get("WARC-Record-ID"), fields.get("WARC-Type"), fields.get("WARC-Target-URI"), fields.get("WARC-Refers-To"),
            length if revisit else len(payload), said if revisit else digest(payload), payload if payloads and not revisit else None)


def read(archives: DataFrame, split: int = RANGE, payloads: bool = True) -> DataFrame:
    """The records of ``archives(path, size)``, read by byte ranges of ``split`` bytes."""
    spark = archives.sparkSession
    ranges = archives.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0).cast("long")), F.lit(split).cast("long"))).alias("start"))
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for item in batch.to_pylist():
                files, path = _file_system(item["path"])
                with files.open_input_file(path) as stream:
                    for fields, block in records_of(stream, item["start"], item["start"] + split):
                        rows.append(_parsed(fields, block, payloads))
                        held += 200 + (len(block) if payloads else 0)
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
        if rows:
            yield _batch(rows)

    return ranges.mapInArrow(run, "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), _FIELDS.values())], list(_FIELDS))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read the archives back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``."""

    def number(column: str):
        return F.regexp_extract(column, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")

    found = read(write(pages), payloads=False)
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"))
