"""WARC (5): archives written and read again, with a reader that salvages what damage leaves.

Writing: each task writes one archive of gzip members, a record each, to the shared folder, under a name of its own. Only the
names that successful tasks return are read, so a repeated task leaves a file that nothing refers to. Of pages with equal
payloads the least page_id is the response and the others are revisits.

Reading: the archives are cut into byte ranges, and a range's task reads the records that begin in it. Each record is checked:
gzip checksum, version line, lengths, and those of its payload's and block's digests that are there and of a known algorithm. After a failure the reader looks for the next valid member (or, in a
plain archive, the next version line with valid headers), goes on there, and reports the bytes between as a quarantined gap.
A record's damage never costs another record. A task holds one record and one block of the file at a time.

Defined results. Null html: an empty payload. Null url: no target. Null page_id: written without one; in a group of equal
payloads nulls are revisits unless all are null, then all are responses. Rows with the same page_id and payload are all
written alike. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_table, lookup, new_path, small_batches
from .files import Ranged, opened

VERSION, RANGE, BLOCK, LEAST_PAYLOAD = b"WARC/1.1", 32 << 20, 1 << 18, 0
MOST_TASKS = 100_000  # that read; beyond, a task reads several ranges
KNOWN = ("sha1", "sha256", "md5")  # algorithms of digests that are checked
FIRST_HEADERS = 1 << 16  # read first of a record in a plain archive; longer headers are read on
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, with its HTTP block; a revisit's block has the headers only."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    d = digest(payload)
    target = "".join(c for c in url or "" if c not in "\r\n")
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{d}')}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        *([("WARC-Target-URI", target)] if target else []),
        ("WARC-Payload-Digest", f"sha1:{d}"),
        *([("X-Page-ID", str(page_id))] if page_id is not None else []),
        *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}|{d}')}>"), ("X-Refers-To-Page-ID", str(refers_to))] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to: of equal payloads the least page_id is the response."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1("html"))
    groups = rows.where(F.octet_length("html") >= LEAST_PAYLOAD).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    named = lookup(rows, kept_table(groups.select("sha1", "first"), "payloads"), "sha1", spread=F.col("page_id"))
    return named.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, gzip: bool = True) -> DataFrame:
    """Writes pages to archives in folder; returns path, size and records of each."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    small_batches(spark)

    def to_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(folder)
        name, out, n, size = f"{uuid.uuid4().hex}.warc{'.gz' if gzip else ''}", None, 0, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                data = record(page_id, url, html.encode(), refers_to)
                if gzip:
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "size": [size], "records": [n]}, pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))

    return kept_table(marked(pages).mapInArrow(to_archives, "path string, size long, records long"), "manifest")


def member_at(file: Ranged, at: int) -> tuple[bytes, int] | None:
    """The content and end of the gzip member at an offset, or None if it isn't one or its checks fail."""
    if file.bytes_at(at, 3) != b"\x1f\x8b\x08":
        return None
    z, parts, here = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            block = file.bytes_at(here, BLOCK)
            if not block:
                return None
            parts.append(z.decompress(block))
            here += len(block)
            if len(parts) == 1 and not parts[0].startswith(b"WARC/"[: len(parts[0])]):
                return None
    except zlib.error:
        return None
    return b"".join(parts), here - len(z.unused_data)


def headers_of(data: bytes) -> tuple[dict[str, str], int] | None:
    """Headers (lower-case names) and where the block begins."""
    if not data.startswith(b"WARC/1.") or (end := data.find(b"\r\n\r\n")) < 0:
        return None
    found = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            return None
        found[k.strip().lower()] = v.strip()
    return (found, end + 4) if found.get("content-length", "").isdecimal() and "warc-type" in found else None


def headers_at(file: Ranged, at: int) -> tuple[dict[str, str], int] | None:
    """headers_of what begins at an offset of a plain archive, read on to the blank line while its lines are headers."""
    n = FIRST_HEADERS
    while True:
        data = file.bytes_at(at, n)
        if len(data) < n or not data.startswith(b"WARC/1.") or any(b":" not in x for x in data.split(b"\r\n")[1:-1]):
            return headers_of(data)
        n *= 2


def differs(said: str, data: bytes) -> bool:
    """Whether a digest of a known algorithm (base32 or hex) isn't that of the data. Digests are optional, and of any algorithm."""
    name, _, value = said.strip().partition(":")
    if name.lower() not in KNOWN or not value:
        return False
    found = hashlib.new(name.lower(), data).digest()
    return value.upper().rstrip("=") not in (base64.b32encode(found).decode().rstrip("="), found.hex().upper())


def parsed(data: bytes) -> dict | None:
    """A record's fields, or None if its lengths or its digest are wrong."""
    head = headers_of(data)
    if not head:
        return None
    headers, begin = head
    size = int(headers["content-length"])
    block = data[begin : begin + size]
    if len(block) < size or data[begin + size : begin + size + 4] != b"\r\n\r\n":
        return None
    http, blank, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x) if x is not None and x.lstrip("-").isdecimal() else None
    of, of_block = headers.get("warc-payload-digest", ""), headers.get("warc-block-digest", "")
    if differs(of_block, block):
        return None
    if headers["warc-type"] == "response":
        if not blank or differs(of, payload):
            return None
        n, of = len(payload), of if of.lower().startswith("sha1:") else f"sha1:{digest(payload)}"
    else:
        n = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
    return {"page_id": number(headers.get("x-page-id")), "url": headers.get("warc-target-uri"), "payload_bytes": n, "payload_digest": of.partition(":")[2].upper() or None, "record_type": headers["warc-type"], "refers_to": number(headers.get("x-refers-to-page-id")), "payload": payload, "end": begin + size + 4}


def record_at(file: Ranged, at: int, gzip: bool) -> tuple[dict, int] | None:
    if gzip:
        member = member_at(file, at)
        found = parsed(member[0]) if member else None
        return (found, member[1]) if found else None
    head = headers_at(file, at)
    if not head:
        return None
    found = parsed(file.bytes_at(at, head[1] + int(head[0]["content-length"]) + 4))
    return (found, at + found["end"]) if found else None


def next_mark(file: Ranged, at: int, gzip: bool) -> int:
    """Where the next member or version line may begin, at or after an offset; the file's size if nowhere."""
    mark = b"\x1f\x8b\x08" if gzip else b"WARC/1."
    while at < file.size:
        block = file.bytes_at(at, BLOCK)
        found = block.find(mark)
        if found >= 0:
            return at + found
        at += max(1, len(block) - len(mark) + 1)
    return file.size


def salvaged(file: Ranged, first: int, end: int, gzip: bool) -> Iterator[tuple[str, int, int, dict | None]]:
    """("record", start, end, fields) and ("gap", start, end, None) of what begins in [first, end).

    A range that isn't the file's first begins with the tail of the record before it, which that range's task reads: its
    first valid record is looked for, and what lies before it is no gap here. A gap belongs to the range of the record before
    it (at the file's beginning to the first), wherever it begins and ends; so records and gaps of all ranges tile the file.
    """
    at, known = first, first == 0
    while at < file.size and (known or at < end):
        found = record_at(file, at, gzip)
        if found and at >= end:
            return
        if found:
            yield "record", at, found[1], found[0]
            at, known = found[1], True
            continue
        lost, at = at, next_mark(file, at + 1, gzip)
        while at < file.size and (known or at < end) and not (found := record_at(file, at, gzip)):
            at = next_mark(file, at + 1, gzip)
        if known:
            yield "gap", lost, min(at, file.size), None


READ = "path string, kind string, start long, end long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(archives: DataFrame, payloads: bool = True, range_bytes: int = RANGE) -> DataFrame:
    """Records and gaps (kind) of archives (path, size). As many tasks read as there are byte ranges."""
    ranges = archives.select("path", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes))).alias("first"))
    # a row stands for range_bytes of reading, so rows are dealt by number: left to their own size, all would end in one task
    ranges = kept_table(ranges.select("path", "first"), "ranges")
    ranges = ranges.repartition(min(max(ranges.count(), 1), MOST_TASKS), "path", "first")
    names = [x.split()[0] for x in READ.split(", ")]
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for n, x in zip(names, READ.split(", "), strict=True)])

    def to_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = Ranged(path)
                for kind, start, end, found in salvaged(file, first, first + range_bytes, path.endswith(".gz")):
                    row = {"path": path, "kind": kind, "start": start, "end": end} | {n: (found or {}).get(n) for n in names[4:]}
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= 1000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                file.close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(to_records, READ)


def warc_query(pages: DataFrame) -> DataFrame:
    """Fails if what was written isn't read again as a whole."""
    archives = write(pages)
    rows = kept_table(read(archives, payloads=False).select("kind", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "records")
    written, found = archives.agg(F.sum("records")).first()[0] or 0, {r.kind: r.n for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if found.get("gap") or found.get("record", 0) != written:
        raise RuntimeError(f"{written} records written, read again: {found}")
    return rows.drop("kind")
