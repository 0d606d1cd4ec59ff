"""WARC archives, written and read by an index.

Writing gives an index first: archive, offset, length, URL, digest and type of every record. Reading takes any selection
of the index, sorts it by place, joins neighbouring records into one byte range and reads only those ranges.
Every record is a gzip member of its own, as usual, so each can be read alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, new_folder, save, texts
from .storage import create, open_at

#: Bytes of one archive, of a gap that is read over rather than left out, and of one read at most (or one record).
ARCHIVE_BYTES, GAP, READ_BYTES = 1 << 30, 64 << 10, 8 << 20
#: Bytes of archives that one reading task gets, on average.
TASK_BYTES = 32 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: object) -> str:
    """A header value on one line."""
    return " ".join(str(value).split())


#: Header of our own with the URL as a JSON string, where it doesn't fit on a line as it is.
_RAW_URL = "Lodeseam-Target-JSON"


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has the HTTP head of the whole payload, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:lodeseam:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_field(url or '')}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is None or _field(url) != url:
        head.insert(5, f"{_RAW_URL}: {json.dumps(url)}")
    if revisit:
        head[2:2] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:lodeseam:page:{refers_to}>"]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC fields, HTTP head, payload) of one gzip member; raises ValueError if its digests or lengths don't fit."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block, tail = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if not lines[0].startswith("WARC/") or tail != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{digest(payload)}":
        raise ValueError("payload digest differs")
    return fields, http, payload


def _page(value: str) -> int | None:
    number = value.removeprefix("<urn:lodeseam:page:").removesuffix(">")
    return int(number) if number else None


INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"


def write(pages: DataFrame, folder: str | None = None, min_payload: int = 0) -> DataFrame:
    """Write every page as a WARC record and return the index (see INDEX).

    Of pages with equal payloads of at least `min_payload` bytes, those with the smallest page_id are responses (more than
    one only if rows repeat a page_id) and the others revisit it; shorter payloads are all responses. A null html is an
    empty payload, and a null url stays null. Null page_ids are never referred to: they are responses if no page of the
    payload has an id. A very long page is one record, held by one task. Other columns are ignored, whatever their names; an
    empty table gives an empty index.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html")).withColumn("n_bytes", F.octet_length("html"))
    first = rows.where(F.col("n_bytes") >= min_payload).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    marked = join_hot(rows, save(first, "first"), ["sha"], "n").select("page_id", "html", "url", "first")

    def run(batches):
        task, out, file, at, made = TaskContext.get().partitionId(), None, "", 0, 0
        for batch in batches:
            rows = []
            for page, html, url, first in zip(batch.column(0).to_pylist(), texts(batch, 1), *(batch.column(k).to_pylist() for k in (2, 3)), strict=True):
                if out is None:
                    (file, out), at, made = create(folder, f"part-{task:06d}-{made:03d}.warc.gz"), 0, made + 1
                sha, revisit = digest(html), first is not None and page != first
                data = record(page, url, html, sha, first, revisit)
                out.write(data)
                rows.append((file, at, len(data), page, url, sha, "revisit" if revisit else "response"))
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return save(marked.mapInArrow(run, INDEX), "index")


def ranges(index: DataFrame, gap: int = GAP, most: int = READ_BYTES, task: int = TASK_BYTES) -> DataFrame:
    """Byte ranges that cover the records of an index selection: (file, first, size, offsets array, lengths array).

    Records are sorted by file and offset; one joins the range before it if at most `gap` bytes lie between them and the
    range stays within `most` bytes. A task gets about `task` bytes of records, wherever they lie."""

    def run(batches):
        now = None  # file, first, end, offsets, lengths

        def rows(of):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in of]), pa.array([r[1] for r in of], pa.int64()), pa.array([r[2] - r[1] for r in of], pa.int64()), pa.array([r[3] for r in of], pa.list_(pa.int64())), pa.array([r[4] for r in of], pa.list_(pa.int64()))], names=["file", "first", "size", "offsets", "lengths"])

        for batch in batches:
            done = []
            for file, at, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if now and now[0] == file and at - now[2] <= gap and max(at + n, now[2]) - now[1] <= most:
                    now[2] = max(now[2], at + n)
                    now[3].append(at)
                    now[4].append(n)
                else:
                    if now:
                        done.append(now)
                    now = [file, at, at + n, [at], [n]]
            if done:
                yield rows(done)
        if now:
            yield rows([now])

    total = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.select("file", "offset", "length").repartitionByRange(max(1, -(-total // task)), "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "file string, first long, size long, offsets array<long>, lengths array<long>")


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read(index: DataFrame, payloads: bool = True, gap: int = GAP, most: int = READ_BYTES) -> DataFrame:
    """The records of an index selection (see RECORDS), read from the archives. payload_bytes and payload_digest are of the
    full payload; the payload itself is null for revisits and with payloads=False. A damaged record raises an error."""

    def run(batches):
        for batch in batches:
            file, held = None, None
            for name, first, size, offsets, lengths in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if name != file:
                    if held:
                        held.close()
                    file, held = name, open_at(name)
                held.seek(first)
                data, rows = held.read(size), []
                for at, n in zip(offsets, lengths, strict=True):
                    fields, http, payload = parse(data[at - first : at - first + n])
                    told = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    response = fields["WARC-Type"] == "response"
                    rows.append((_page(fields["WARC-Record-ID"]), json.loads(fields[_RAW_URL]) if _RAW_URL in fields else fields["WARC-Target-URI"], fields["WARC-Type"], told, fields["WARC-Payload-Digest"].removeprefix("sha1:"), _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, payload if response and payloads else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])
            if held:
                held.close()

    return ranges(index, gap, most).mapInArrow(run, RECORDS)
