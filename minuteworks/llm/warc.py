"""WARC archives: writing one record per page, and a reader that splits files anywhere.

Every record is a gzip member of its own.  A read task owns the records that start inside its byte
range: it looks for gzip magic, takes a candidate for a record only if it inflates to a WARC header,
its checksum holds and a further member or the file's end follows, and then goes from member to
member until one starts past its range.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from hashlib import sha1

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteworks.llm.common import scratch_path, written
from minuteworks.llm.tokens import slices_of

MAGIC = b"\x1f\x8b\x08"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CONTROL = re.compile(r"[\x00-\x20\x7f]")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(sha1(payload).digest()).decode()


def gzip_member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(kind: str, headers: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("WARC-Date", date), ("Content-Length", str(len(block)))]
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in lines), "", ""]).encode() + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    name = lambda i: f"<urn:page:{i}>"
    headers = [("WARC-Record-ID", name("none" if page_id is None else page_id))]
    if url is not None:
        headers.append(("WARC-Target-URI", CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    headers += [("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        return record("response", headers, HTTP + payload, date)
    headers += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return record("revisit", headers, HTTP, date)


def with_responses(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: of equal payloads of ``least_bytes`` or more the page
    with the smallest id is the response and has no ``refers_to``; the others name it."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    key = F.concat(F.sha1("payload"), F.md5("payload"))
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy(key.alias("key")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.withColumn("own", key).join(first, F.col("own") == F.col("key"), "left").select("page_id", "url", "payload", later.alias("refers_to"))


def write_warc(pages: DataFrame, out_dir: str, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Writes ``page_id, url, payload, refers_to`` rows to one archive per task; a row per archive:
    ``path, bytes``.  Archives of failed or repeated attempts are in no row."""
    base, top = pafs.FileSystem.from_uri(out_dir)
    base.create_dir(top)

    def write(batches):
        fs, folder = pafs.FileSystem.from_uri(out_dir)
        path, out, size = f"{folder}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for a, z in slices_of(batch.column(2)):
                for page_id, url, payload, refers_to in zip(*(batch.column(k)[a:z].to_pylist() for k in range(4))):
                    if out is None:
                        out = fs.open_output_stream(path, compression=None)
                        size += out.write(gzip_member(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", date), level))
                    size += out.write(gzip_member(page_record(page_id, url, payload, refers_to, date), level))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size]})

    return written(pages.mapInArrow(write, "path string, bytes long"), "warc-files")


class Tail:
    """The bytes of a file from a place on, read as they are asked for."""

    def __init__(self, file, start: int, size: int, step: int = 1 << 20):
        self.file, self.start, self.size, self.step, self.data = file, start, size, step, bytearray()

    def grow(self) -> bool:
        at = self.start + len(self.data)
        more = self.file.read_at(min(self.step, self.size - at), at) if at < self.size else b""
        self.data += more
        return bool(more)

    def forget(self, n: int) -> int:
        """Lets go of what stands before ``n``, once it is worth the move; returns where ``n`` is now."""
        if n < self.step:
            return n
        del self.data[:n]
        self.start += n
        return 0


def member(tail: Tail, at: int) -> tuple[bytes, int] | None:
    """The inflated member at ``at`` and the place after it, if it is a whole WARC record."""
    inflate, out, fed = zlib.decompressobj(31), [], at
    checked = False
    try:
        while not inflate.eof:
            if fed >= len(tail.data) and not tail.grow():
                return None
            part = tail.data[fed : fed + (1 << 16)]
            fed += len(part)
            out.append(inflate.decompress(part))
            if not checked and sum(map(len, out)) >= 5:
                checked = True
                if not b"".join(out).startswith(b"WARC/"):
                    return None
    except zlib.error:
        return None
    end = fed - len(inflate.unused_data)
    while len(tail.data) < end + 3 and tail.grow():
        pass
    follows = tail.data[end : end + 3]
    return (b"".join(out), end) if checked and follows in (b"", MAGIC) else None


def records_in(file, size: int, start: int, end: int):
    """``(offset, record)`` for the records of a file that start in ``[start, end)``."""
    tail, at = Tail(file, start, size), 0
    while tail.start + at < end:
        found = tail.data.find(MAGIC, at)
        if found < 0:
            at = tail.forget(max(at, len(tail.data) - 2))
            if not tail.grow():
                return
            continue
        at = found
        if tail.start + at >= end:
            return
        whole = member(tail, at)
        if whole is None:
            at += 1
            continue
        yield tail.start + at, whole[0]
        at = tail.forget(whole[1])


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


ROWS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(files: DataFrame, out_dir: str, range_bytes: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """The page records of archives (``path, bytes`` rows), each file read in ranges of
    ``range_bytes`` by as many tasks.  With ``payloads=False`` the payload column is null."""

    def number(name):
        value = name.removeprefix("<urn:page:").removesuffix(">")
        return None if value == "none" else int(value)

    def rows_of(file, row):
        for _, raw in records_in(file, row["bytes"], row["start"], min(row["start"] + range_bytes, row["bytes"])):
            headers, block = parsed(raw)
            if headers["WARC-Type"] not in ("response", "revisit"):
                continue
            payload = block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None
            length, digest = int(headers["WARC-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
            if payload is not None and (length, digest) != (len(payload), payload_digest(payload)):
                raise ValueError(f"damaged record {headers['WARC-Record-ID']} in {row['path']}")
            refers_to = headers.get("WARC-Refers-To")
            yield number(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), payload if payloads else None, length, digest, headers["WARC-Type"], refers_to and number(refers_to)

    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in ROWS.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def read(batches):
        fs = pafs.FileSystem.from_uri(out_dir)[0]
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as file:
                    wait, size = [], 0
                    for found in rows_of(file, row):
                        wait.append(found)
                        size += len(found[2] or b"") + 100
                        if size > 4_000_000:
                            yield batch_of(wait)
                            wait, size = [], 0
                    if wait:
                        yield batch_of(wait)

    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    # a fixed number: the rows are few and small, and adaptive execution would join them in one task
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(tasks, "path", "start").mapInArrow(read, ROWS)


def warc_round_trip(pages: DataFrame, least_bytes: int = 0, range_bytes: int = 8 << 20) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back, one row per page.

    A null html is an empty payload; equal payloads (empty ones too) have one response, the page
    with the smallest id; rows that repeat that id are responses too; a null id never is the
    smallest and is a revisit of the smallest that is not null, if there is one; other columns are
    ignored; an empty table writes no archive.
    """
    out_dir = scratch_path(pages.sparkSession, "warc")
    files = write_warc(with_responses(pages, least_bytes), out_dir)
    return read_warc(files, out_dir, range_bytes, payloads=False).drop("payload")
