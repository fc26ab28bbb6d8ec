"""WARC archives: a writer with revisit records and a sequential reader.

Every record is a gzip member of its own. Of records with equal payloads of at least
``least_bytes`` bytes the one with the smallest id is a ``response``, the others are
``revisit`` records that hold its id and the HTTP header of the full payload, but not the
payload; all smaller payloads are responses. If rows repeat that smallest id with the same
payload each of them is a response. A null id is larger than all others; if no id of a group
is known all of the group are responses. Null html is an empty payload, a null address is
``about:blank``; control characters and blanks in addresses are percent-encoded.

The reader inflates step by step, frames by Content-Length and checks block and payload
digests; a damaged or cut archive raises. It holds one buffer, not a record, unless payloads
are asked for.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.llm.common import new_path, saved, stored, whole_numbers
from paperlake.llm.tokenfile import open_fs

STEP = 1 << 16
FILE_BYTES = 256 << 20
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}/{payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, level: int = 6) -> bytes:
    """One gzip member: a response, or a revisit of page ``refers_to``."""
    own, revisit = digest(payload), refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, own)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', url or 'about:blank')}",
        f"WARC-Payload-Digest: sha1:{own}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, own)}", f"Page-Refers-To: {refers_to}"]
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n"
    return pack.compress(head) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


class _Members:
    """The inflated bytes of one member after the other, a buffer at a time."""

    def __init__(self, source):
        self.source, self.raw, self.zip, self.data, self.end = source, b"", None, b"", True

    def next(self) -> bool:
        """Goes to the next member; false at the end of the file."""
        if not self.end or self.data:
            raise ValueError("bytes after the end of a record")
        if not self.raw:
            self.raw = self.source.read(STEP)
        self.zip, self.end = zlib.decompressobj(31), False
        return bool(self.raw)

    def _fill(self) -> bool:
        if self.end:
            return False
        if not self.raw:
            self.raw = self.source.read(STEP)
            if not self.raw:
                raise EOFError("the archive ends inside a record")
        self.data += self.zip.decompress(self.raw, STEP)
        self.raw, self.end = (self.zip.unused_data, True) if self.zip.eof else (self.zip.unconsumed_tail, False)
        return True

    def line(self) -> bytes:
        at = 0
        while (i := self.data.find(b"\r\n", at)) < 0:
            at = max(0, len(self.data) - 1)
            if not self._fill():
                raise ValueError("a header line without an end")
        line, self.data = self.data[:i], self.data[i + 2 :]
        return line

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            while not self.data:
                if not self._fill():
                    raise EOFError("a record is shorter than its Content-Length")
            part, self.data = self.data[:n], self.data[n:]
            n -= len(part)
            yield part

    def finish(self) -> None:
        if b"".join(self.take(4)) != b"\r\n\r\n":
            raise ValueError("a record doesn't end after its Content-Length")
        while self._fill():
            pass


def _headers(members: _Members) -> tuple[str, dict[str, str]]:
    first, found = members.line().decode("utf-8", "surrogatepass"), {}
    while line := members.line():
        name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
        found[name.strip().lower()] = value.strip()
    return first, found


def _http(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}


def read_file(source, payloads: bool = False) -> Iterator[dict]:
    """The records of one archive in order; ``source`` has ``read(n)``."""
    members = _Members(source)
    while members.next():
        version, head = _headers(members)
        if not version.startswith("WARC/1."):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        block, payload, kept, http, seen = hashlib.sha1(), hashlib.sha1(), [], b"", None
        size = 0
        for part in members.take(int(head["content-length"])):
            block.update(part)
            if seen is None:
                http += part
                if (i := http.find(b"\r\n\r\n")) < 0:
                    continue
                seen, part = _http(http[:i]), http[i + 4 :]
            payload.update(part)
            size += len(part)
            if payloads:
                kept.append(part)
        members.finish()
        if seen is None:
            raise ValueError("a block without an HTTP header")
        told = head["warc-payload-digest"].removeprefix("sha1:")
        if base64.b32encode(block.digest()).decode() != head["warc-block-digest"].removeprefix("sha1:"):
            raise ValueError("a block fails its digest")
        if head["warc-type"] == "response":
            if base64.b32encode(payload.digest()).decode() != told or size != int(seen["content-length"]):
                raise ValueError("a payload fails its digest or length")
        elif size:
            raise ValueError("a revisit record with a payload")
        number = lambda name: int(head[name]) if name in head else None
        yield {"page_id": number("page-id"), "url": head["warc-target-uri"], "payload_bytes": int(seen["content-length"]), "payload_digest": told, "record_type": head["warc-type"], "refers_to": number("page-refers-to"), "payload": b"".join(kept) if payloads and head["warc-type"] == "response" else None}


FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType())])


def write(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 5, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes all rows to archives in the shared folder and returns their manifest (path,
    records), stored there too. ``page_id`` must hold whole numbers (null: no id). A task writes under names of its own and attempt, so only
    archives of tasks that ended well are listed."""
    whole_numbers(pages, page_id)
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.sha1("payload"))
    # combined before the shuffle: a payload that a third of all pages share is one row a task
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("key", "first")
    rows = rows.join(saved(groups), "key", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.select("page_id", "url", "payload", refers.alias("refers_to"))

    def run(batches):
        task, out, fs, path, records, size, files = TaskContext.get(), None, None, "", 0, 0, 0
        listed = lambda: pa.RecordBatch.from_pylist([{"path": path, "records": records}], pa.schema([("path", pa.string()), ("records", pa.int64())]))
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                for row in batch.slice(low, 64).to_pylist():
                    if out is None:
                        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{files}.warc.gz"
                        fs, at = open_fs(path)
                        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                        out, records, size, files = fs.open_output_stream(at, compression=None), 0, 0, files + 1
                    data = record(row["page_id"], row["url"], row["payload"], row["refers_to"], date, level)
                    out.write(data)
                    records, size = records + 1, size + len(data)
                    if size >= file_bytes:
                        out.close()
                        out = None
                        yield listed()
        if out is not None:
            out.close()
            yield listed()

    return stored(rows.mapInArrow(run, MANIFEST), "archives")


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of the archives: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to and payload (null for revisits and unless asked for)."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = open_fs(row["path"])
                held, n, size = [], 0, 0
                with fs.open_input_stream(at, compression=None) as source:
                    for found in read_file(source, payloads):
                        held.append(found)
                        n, size = n + 1, size + len(found["payload"] or b"")
                        if len(held) >= 4096 or size > STEP * 64:
                            yield pa.RecordBatch.from_pylist(held, pa.schema(FIELDS))
                            held, size = [], 0
                if n != row["records"]:
                    raise ValueError(f"{at} has {n} records, its manifest {row['records']}")
                if held:
                    yield pa.RecordBatch.from_pylist(held, pa.schema(FIELDS))

    return manifest.repartition(max(1, manifest.count()), "path").mapInArrow(run, ROWS)


#: The result of the query in DuckDB's SQL; base32 is taken from hexadecimal, 20 bits at a time.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
