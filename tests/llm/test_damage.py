"""Damage and dealing of archives: a broken directory, and the tasks that read."""

import zipfile

from foliant.llm import media, warc

from .test_operators import documents, pages


def test_media_directory_damage(spark, tmp_path):
    folder = media.archived(documents(spark, [f"text {i} " * 50 for i in range(40)]).repartition(2), str(tmp_path / "m"))
    before = {(r.archive, r.offset): r for r in media.media(spark, folder, 300).collect()}
    path = sorted((tmp_path / "m").glob("*.zip"))[0]
    data = bytearray(path.read_bytes())
    with zipfile.ZipFile(path) as z:
        at = z.start_dir
    data[-22:-18] = b"junk"  # the end record
    data[at : at + 4] = b"junk"
    path.write_bytes(data)
    after = media.media(spark, folder, 300).collect()
    assert [(r.archive, r.offset) for r in after if r.error] == [(next(a for a, _ in before if a.endswith(path.name)), -1)]
    found = {(r.archive, r.offset): r for r in after if not r.error}
    assert found.keys() == before.keys() and all(found[k].media == before[k].media for k in before)


def test_media_archives_are_cut(spark, tmp_path, monkeypatch):
    docs = documents(spark, [f"text {i} " * 50 for i in range(40)]).coalesce(1).collect()
    monkeypatch.setattr(media, "ARCHIVE", 1000)
    writer = media.ArchiveWriter(str(tmp_path / "c"))
    import pyarrow as pa

    rows = [{"member": f"{r.doc_id}.wav", "about": "{}", "media": media.wav(r.text.encode())} for r in docs]
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist(rows)])), None])
    assert len(list((tmp_path / "c").glob("*.zip"))) > 3 and media.media(spark, str(tmp_path / "c")).count() == 40


def test_warc_ranges_are_read_by_many_tasks(spark):
    df, html = pages(spark)
    archives = warc.write(df.repartition(4)).cache()
    ranges = sum(-(-r.size // 500) for r in archives.collect())
    out = warc.read(archives, range_bytes=500)
    assert out.rdd.getNumPartitions() == ranges > 4 and out.count() == len(html)
