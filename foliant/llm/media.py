"""Media columns (10): a Spark data source over archive directories.

An archive is a ZIP file of media members. Reading plans byte ranges from the files' sizes alone; a range's task takes the
members that begin in it, by the archive's directory, streams them in Arrow batches of a few MB, and retries each member by
itself at its offset, by its own header. A member that fails for good gives a row with its error and costs no other member.
A directory counts only if its end record closes the file and it accounts for the file from its first byte on; a damaged one, or that
of an archive stored inside, doesn't. A row tells so then (offset -1), and the members are found by their own headers, one after
the other: each header's sizes tell where the next one stands, so that headers inside a member's data are none. Where one doesn't
stand, or a member can't be read, a row with an error says so, and the next mark is looked for. What the directory says
about members is null then. Each range walks the headers before it too, which reads their few bytes, and those members' data
only where the sizes follow it. Writing goes through
the same source: tasks write archives under temporary names, and the commit renames those of the tasks that count.

The query stores each text as a sound: 8-bit mono samples of a WAV file.

Defined results. Null text: as empty, 64 bytes 0. Equal texts give equal values. Null doc_id: a member without one. Repeated
rows are members of their own. An empty table gives an empty directory and an empty result.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import kept_table, new_path, small_batches, typed
from .files import Ranged, opened

UNIT, RANGE, BATCH, ARCHIVE, TRIES, RATE = 64, 16 << 20, 4 << 20, 128 << 20, 3, 8000
MEMBERS = "archive string, offset long, member string, about string, media binary, error string"
_SCHEMA = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("member", pa.string()), ("about", pa.string()), ("media", pa.binary()), ("error", pa.string())])


@dataclass
class Range(InputPartition):
    path: str
    first: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    members: int


LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
#: Marks of a directory's parts, and of all that may follow a member.
DIRECTORY = (b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x08")
AFTER = (LOCAL, *DIRECTORY)


def member_bytes(path: str, offset: int, tries: int = TRIES, wait: float = 0.2) -> tuple[bytes | None, str | None]:
    """(bytes, None) of the member at an offset, or (None, error) after `tries` tries, each with the file opened anew. The
    member's own header is all that is needed, so that other damage doesn't matter."""
    error = ""
    for k in range(tries):
        file = None
        try:
            file = Ranged(path)
            return own_member(file, offset)[1], None
        except Exception as e:  # noqa: BLE001  any fault of one member is its own
            error = f"{type(e).__name__}: {e}"
            time.sleep(wait * k)
        finally:
            if file:
                file.close()
    return None, error


def own_member(file: Ranged, at: int) -> tuple[str, bytes, int]:
    """Name, bytes and end of the member whose header is at an offset; its checksum follows it, or stands in the header."""
    head = file.bytes_at(at, LOCAL_SIZE)
    if len(head) < LOCAL_SIZE or head[:4] != LOCAL:
        raise ValueError("no member's header")
    flags, method, crc, packed, name_size, more = (int.from_bytes(head[i:j], "little") for i, j in ((6, 8), (8, 10), (14, 18), (18, 22), (26, 28), (28, 30)))
    name, begin = file.bytes_at(at + LOCAL_SIZE, name_size).decode(errors="replace"), at + LOCAL_SIZE + name_size + more
    if method == 0 and not flags & 8:
        data, end = file.bytes_at(begin, packed), begin + packed
    elif method == 8:
        z, parts, here = zlib.decompressobj(-15), [], begin
        while not z.eof:
            block = file.bytes_at(here, 1 << 18)
            if not block:
                raise ValueError("the member is cut off")
            parts.append(z.decompress(block))
            here += len(block)
        data, end = b"".join(parts), here - len(z.unused_data)
        if flags & 8:  # sizes and checksum follow the data
            after = file.bytes_at(end, 8)
            marked = after[:4] == b"PK\x07\x08"
            crc = int.from_bytes(after[4:8] if marked else after[:4], "little")
            end += next((n for n in (16 if marked else 12, 24 if marked else 20) if end + n == file.size or file.bytes_at(end + n, 4) in AFTER), 16 if marked else 12)
    else:
        raise ValueError(f"method {method}")
    if zlib.crc32(data) != crc:
        raise ValueError("wrong checksum")
    return name, data, end


def directory(file: Ranged) -> list[zipfile.ZipInfo]:
    """The archive's members by its directory; raises BadZipFile if that is damaged or another archive's."""
    try:
        archive = zipfile.ZipFile(file)
        infos, start, comment = archive.infolist(), archive.start_dir, len(archive.comment)
    except OSError:
        raise  # the storage's fault, not the archive's
    except Exception as e:
        raise zipfile.BadZipFile(f"{type(e).__name__}: {e}") from e
    offsets = sorted(i.header_offset for i in infos)
    if file.bytes_at(file.size - 22 - comment, 4) != b"PK\x05\x06":
        raise zipfile.BadZipFile("the end record doesn't close the file")
    if (offsets or [start])[0] != 0 or (offsets and offsets[-1] >= start):
        raise zipfile.BadZipFile("the directory doesn't account for the file")
    return infos


def header(file: Ranged, at: int) -> tuple[str, int] | None:
    """Name and place of the next header by the sizes of the one at an offset (-1 if they follow the data); None if there is none."""
    head = file.bytes_at(at, LOCAL_SIZE)
    if len(head) < LOCAL_SIZE or head[:4] != LOCAL:
        return None
    flags, packed, name_size, more = (int.from_bytes(head[i:j], "little") for i, j in ((6, 8), (18, 22), (26, 28), (28, 30)))
    begin = at + LOCAL_SIZE + name_size + more
    name = file.bytes_at(at + LOCAL_SIZE, name_size).decode(errors="replace")
    return name, -1 if flags & 8 else begin + packed


def is_directory(file: Ranged, at: int) -> bool:
    """Whether a directory begins at an offset: by its mark or, if that is damaged, by the next one, where its first entry ends."""
    entry = file.bytes_at(at, 46)
    if entry[:4] in DIRECTORY or len(entry) < 46:
        return entry[:4] in DIRECTORY
    return file.bytes_at(at + 46 + sum(int.from_bytes(entry[i : i + 2], "little") for i in (28, 30, 32)), 4) in DIRECTORY


def sound(file: Ranged, at: int) -> bool:
    try:
        own_member(file, at)
    except OSError:
        raise
    except Exception:  # noqa: BLE001  any fault of one member is its own
        return False
    return True


def next_header(file: Ranged, at: int) -> int:
    """Where the next header's mark stands, or the file's size."""
    while at < file.size:
        block = file.bytes_at(at, 1 << 18)
        if (found := block.find(LOCAL)) >= 0:
            return at + found
        at += max(1, len(block) - 3)
    return file.size


def walked(file: Ranged, end: int) -> Iterator[tuple[int, str | None, str | None]]:
    """Offset, name and fault of each member whose header begins before `end`, from the file's beginning, without its directory."""
    at = 0
    while at < min(end, file.size):
        if is_directory(file, at):  # members end where a directory begins
            return
        found = header(file, at)
        if not found:
            after = next_header(file, at + 1)
            yield at, None, f"no member's header in the bytes up to {after}"
            at = after
            continue
        name, after = found
        if after > file.size or (0 <= after < file.size and file.bytes_at(after, 4) not in AFTER and not is_directory(file, after) and not sound(file, at)):
            yield at, name, "the member's sizes are wrong"
            at = next_header(file, at + LOCAL_SIZE)
            continue
        if after < 0:
            try:
                after = own_member(file, at)[2]
            except OSError:
                raise
            except Exception as e:  # noqa: BLE001  any fault of one member is its own
                yield at, name, f"{type(e).__name__}: {e}"
                at = next_header(file, at + LOCAL_SIZE)
                continue
        yield at, name, None
        at = after


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[InputPartition]:
        fs, top = opened(self.path)
        files = [f for f in fs.get_file_info(pafs.FileSelector(top, allow_not_found=True)) if f.type == pafs.FileType.File and f.path.endswith(".zip")]
        found = [Range(f"{self.path.rstrip('/')}/{f.base_name}", at, at + self.range_bytes) for f in files for at in range(0, max(f.size, 1), self.range_bytes)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows, held = [], 0
        for row in self.members(partition):
            rows.append(row)
            held += len(row["media"] or b"")
            if held > BATCH:
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    def members(self, partition: Range) -> Iterator[dict]:
        path, file = partition.path, Ranged(partition.path)
        row = lambda offset, member, about, media, error: {"archive": path, "offset": offset, "member": member, "about": about, "media": media, "error": error}
        try:
            try:
                infos = directory(file)
            except zipfile.BadZipFile as e:
                if partition.first == 0:
                    yield row(-1, None, None, None, f"BadZipFile: {e}")
                for at, name, fault in walked(file, partition.end):
                    if at >= partition.first:
                        data, error = (None, fault) if fault else member_bytes(path, at)
                        yield row(at, name, None, data, error)
                return
            archive = zipfile.ZipFile(file)
            for info in infos:
                if not partition.first <= info.header_offset < partition.end:
                    continue
                try:
                    data, error = archive.read(info), None  # checks the member's CRC
                except Exception:  # noqa: BLE001
                    data, error = member_bytes(path, info.header_offset)
                yield row(info.header_offset, info.filename, info.comment.decode(errors="replace"), data, error)
        finally:
            file.close()


class ArchiveWriter(DataSourceArrowWriter):
    """Takes rows member, about, media."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Archives of about ARCHIVE bytes, so that reading a directory stays a small part of reading a range."""
        fs, top = opened(self.path)
        names, n, held, archive, out = [], 0, 0, None, None
        for batch in iterator:
            for row in batch.to_pylist():
                if archive is None:
                    fs.create_dir(top, recursive=True)
                    names.append(f"{uuid.uuid4().hex}.zip")
                    out = fs.open_output_stream(f"{top}/_{names[-1]}.tmp", compression=None)
                    archive, held = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1), 0
                info = zipfile.ZipInfo(row["member"])
                info.compress_type, info.comment = zipfile.ZIP_DEFLATED, row["about"].encode()
                archive.writestr(info, row["media"], compresslevel=1)
                n, held = n + 1, held + info.compress_size + 200
                if held > ARCHIVE:
                    archive.close()
                    out.close()
                    archive = None
        if archive is not None:
            archive.close()
            out.close()
        return Written(names, n)

    def commit(self, messages: list) -> None:
        fs, top = opened(self.path)
        fs.create_dir(top, recursive=True)
        for name in (x for m in messages if m for x in m.names):
            fs.move(f"{top}/_{name}.tmp", f"{top}/{name}")

    def abort(self, messages: list) -> None:
        fs, top = opened(self.path)
        for name in (x for m in messages if m for x in m.names):
            fs.delete_file(f"{top}/_{name}.tmp")


class MediaArchives(DataSource):
    """Options: path, a directory of archives; range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options["path"])


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of 8-bit mono samples."""
    n = len(samples)
    return b"RIFF" + (36 + n).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + b"\x01\x00\x01\x00" + rate.to_bytes(4, "little") * 2 + b"\x01\x00\x08\x00" + b"data" + n.to_bytes(4, "little") + samples


def samples_of(media: bytes) -> bytes:
    """The samples of such a file, by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        size = int.from_bytes(media[at + 4 : at + 8], "little")
        if media[at : at + 4] == b"data":
            if at + 8 + size > len(media):
                raise ValueError("the samples are cut off")
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def stored(docs: DataFrame) -> DataFrame:
    """member, about, media of each text."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode()
                media = wav(data + bytes(-len(data) % UNIT if data else UNIT))
                rows.append({"member": f"{doc_id if doc_id is not None else 'none'}.wav", "about": json.dumps({"doc_id": doc_id, "n_bytes": len(data)}), "media": media})
                held += len(media)
                if held > BATCH:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([_SCHEMA.field(n) for n in ("member", "about", "media")]))
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([_SCHEMA.field(n) for n in ("member", "about", "media")]))

    return docs.select("doc_id", "text").mapInArrow(members, "member string, about string, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature(samples: bytes) -> str:
    """Whole numbers of the samples: least, most, 1000 x mean, 1000 x mean absolute difference, crossings of 128."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    d = np.abs(np.diff(x))
    return f"min={x.min()};max={x.max()};mean={1000 * int(x.sum()) // len(x)};step={1000 * int(d.sum()) // max(len(d), 1)};cross={int(np.count_nonzero(np.diff(x >= 128)))}"


@F.pandas_udf(typed(FEATURES))
def features(media: pd.Series) -> pd.DataFrame:
    rows = []
    for m in media:
        p = samples_of(m)
        rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
    return pd.DataFrame(rows, columns=[x.split()[0] for x in FEATURES.split(", ")])


def archived(docs: DataFrame, folder: str | None = None) -> str:
    """Writes the texts to archives; returns their directory."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "media")
    spark.dataSource.register(MediaArchives)
    stored(docs).write.format("media_archives").mode("append").option("path", folder).save()
    return folder


def media(spark: SparkSession, folder: str, range_bytes: int = RANGE) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("range_bytes", str(range_bytes)).load(folder)


def media_query(docs: DataFrame) -> DataFrame:
    """Fails if a member is lost, or if there aren't as many as texts."""
    small_batches(docs.sparkSession, 128)
    rows = media(docs.sparkSession, archived(docs))
    about = F.from_json("about", "doc_id long, n_bytes long")
    fine = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("media member lost: "), F.col("error")))).otherwise(F.col("media"))
    read = kept_table(rows.select(about.alias("a"), features(fine).alias("f")).select("a.doc_id", "a.n_bytes", "f.*"), "features")
    if (found := read.count()) != (written := docs.count()):
        raise RuntimeError(f"{written} texts stored, read again: {found}")
    return read
