"""Archives that others wrote: stored archives inside, odd comments, damaged members, records without or with other digests."""

import base64
import hashlib
import io
import zipfile

import pytest

from foliant.llm import media, warc


def zipped(members, method=zipfile.ZIP_STORED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            info = zipfile.ZipInfo(name)
            info.compress_type, info.comment = method, comment
            z.writestr(info, data)
    return out.getvalue()


def found(spark, folder, ranges=(50, 400, 10**6)):
    rows = [sorted((r.offset, r.member, r.media and bytes(r.media), r.error) for r in media.media(spark, str(folder), n).collect()) for n in ranges]
    assert all(r == rows[0] for r in rows)  # the same at all range sizes
    return rows[0]


@pytest.mark.parametrize("cut", ["end record", "directory"])
def test_archive_inside_a_damaged_one(spark, tmp_path, cut):
    inner = zipped([("inner.wav", b"inside" * 20)])
    data = zipped([("outer.docx", inner), ("two.wav", b"second" * 30)])
    start = zipfile.ZipFile(io.BytesIO(data)).start_dir
    (tmp_path / "a.zip").write_bytes(data[:-22] + b"junk" + data[-18:] if cut == "end record" else data[:start])
    rows = found(spark, tmp_path)
    assert rows[0][0] == -1 and rows[0][3].startswith("BadZipFile")
    assert [(r[1], r[2], r[3]) for r in rows[1:]] == [("outer.docx", inner, None), ("two.wav", b"second" * 30, None)]


def test_comment_of_any_bytes(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped([("a.wav", b"x" * 99)], comment=b"\xff\xfe ok"))
    rows = media.media(spark, str(tmp_path)).collect()
    assert [(r.member, bytes(r.media), r.error) for r in rows] == [("a.wav", b"x" * 99, None)] and rows[0].about.endswith(" ok")


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_damaged_member_under_a_damaged_directory(spark, tmp_path, method):
    names = [f"{i}.wav" for i in range(4)]
    data = bytearray(zipped([(n, n.encode() * 100 + bytes(range(200))) for n in names], method))
    infos = zipfile.ZipFile(io.BytesIO(bytes(data))).infolist()
    at = infos[1].header_offset + 30 + len("1.wav")
    data[at : at + 40] = bytes(40) if method else b"#" * 40  # the second member's data
    data[infos[3].header_offset + 1] = 0  # the last one's header
    data[-22:-18] = b"junk"
    (tmp_path / "a.zip").write_bytes(bytes(data))
    rows = found(spark, tmp_path)
    assert [r[1] for r in rows if not r[3]] == ["0.wav", "2.wav"] or [r[1] for r in rows if not r[3]] == ["0.wav"]
    assert {r[0] for r in rows if r[3]} >= {-1, infos[1].header_offset} and {infos[2].header_offset, infos[3].header_offset} & {r[0] for r in rows if r[3]}


def test_streamed_members_without_directory(spark, tmp_path):
    """Sizes that follow the data, as streaming writers put them."""
    class Pipe(io.RawIOBase):
        def __init__(self):
            self.data = bytearray()

        def writable(self):
            return True

        def write(self, b):
            self.data += b
            return len(b)

    pipe = Pipe()
    with zipfile.ZipFile(pipe, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(5):
            z.writestr(f"{i}.wav", f"text {i} ".encode() * 60 + media.LOCAL)
    (tmp_path / "a.zip").write_bytes(bytes(pipe.data)[:-22])
    assert [(r[1], r[2], r[3]) for r in found(spark, tmp_path)[1:]] == [(f"{i}.wav", f"text {i} ".encode() * 60 + media.LOCAL, None) for i in range(5)]


def with_digest(i, said, block=None):
    data = warc.record(i, "http://x", b"payload %d" % i, None)
    head, body = data.split(b"\r\n\r\n", 1)
    lines = [x for x in head.split(b"\r\n") if not x.startswith(b"WARC-Payload-Digest")]
    return b"\r\n".join([*lines, *([b"WARC-Payload-Digest: " + said] if said else []), *([b"WARC-Block-Digest: " + block] if block else [])]) + b"\r\n\r\n" + body


def test_optional_digests(spark, tmp_path):
    sha256 = lambda x: base64.b32encode(hashlib.sha256(x).digest()).rstrip(b"=")
    said = [None, b"sha256:" + sha256(b"payload 1"), b"sha256:" + hashlib.sha256(b"payload 2").hexdigest().encode(), b"blake9:anything", b"sha1:" + warc.digest(b"payload 4").lower().encode(), b"sha1:" + warc.digest(b"other").encode(), b"sha256:" + sha256(b"other")]
    parts = [with_digest(i, x) for i, x in enumerate(said)] + [with_digest(7, None, b"sha1:" + warc.digest(b"other").encode())]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    archives = spark.createDataFrame([(str(tmp_path / "a.warc"), sum(map(len, parts)))], "path string, size long")
    rows = warc.read(archives).collect()
    assert {r.page_id: r.payload_digest for r in rows if r.kind == "record"} == {i: warc.digest(b"payload %d" % i) for i in range(5)}
    assert [(r.start, r.end) for r in rows if r.kind == "gap"] == [(sum(map(len, parts[:5])), sum(map(len, parts)))]
