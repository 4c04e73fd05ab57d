"""DOCX files made by hand, and uploads."""

import io
import zipfile

from pyspark.sql import functions as F

from foliant.plans import review
from foliant.plans.rules import Rule, RuleSet
from foliant.sources import parsers
from foliant.sources.docx import classified, read_docx
from foliant.sources.uploads import accepted, zip_fault

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = f'<w:styles {NS}><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/><w:rPr><w:rFonts w:ascii="SimSun"/><w:sz w:val="24"/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>'
BODY = (
    '<w:p><w:pPr><w:pStyle w:val="H2"/><w:jc w:val="center"/></w:pPr><w:r><w:t>甲 标题</w:t></w:r></w:p><w:p/>'
    '<w:p><w:pPr><w:spacing w:line="400" w:lineRule="exact" w:before="120"/><w:ind w:firstLine="480"/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="21"/></w:rPr><w:t>正文 一</w:t></w:r><w:r><w:br/><w:t>二</w:t></w:r></w:p>'
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>科目</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>金额</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>合计</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl>"
)


def test_docx(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{BODY}</w:body></w:document>")
        z.writestr("word/styles.xml", STYLES)
    (tmp_path / "bad.docx").write_bytes(b"PK\x03\x04 no zip")
    rows = {r.filename: r for r in read_docx(spark, str(tmp_path)).collect()}
    a = rows["a.docx"]
    assert [(b.id, b.page, b.type, b.level, b.text) for b in a.blocks] == [("b0", None, "heading", 2, "甲 标题"), ("b1", None, "paragraph", 0, "正文 一\n二"), ("b2", None, "table", 0, "科目 金额 | 合计 ")]
    assert (a.blocks[1].font.name, a.blocks[1].font.size, a.blocks[1].font.bold) == ("SimSun", 10.5, True)
    assert (a.blocks[0].layout.alignment, a.blocks[1].layout.line_spacing_pt, a.blocks[1].layout.first_line_indent_pt, a.blocks[1].layout.space_before_pt) == ("center", 20.0, 24.0, 6.0)
    assert a.blocks[2].table_data == [["科目", "金额"], ["合计", ""]] and (a.pages, a.word_count) == (0, 3 + 4 + 11)
    assert rows["bad.docx"].blocks == [] and rows["bad.docx"].parse_warnings
    found = review.findings(read_docx(spark, str(tmp_path)).where("filename = 'a.docx'"), RuleSet("t", "t", (Rule("R01", "budget_check"), Rule("R02", "page_limit", params={"section_limits": {"甲": 1}}))))
    assert found.where("checker = 'page_limit'").count() == 0  # no pages, no finding


def test_classes():
    assert [classified(*c) for c in (("标题 3", "x", 12), ("Heading", "x", 9), ("Normal", "一、甲", 16), ("Normal", "1.2 甲", 14), ("Normal", "甲", 14), ("Normal", "甲。", 16), ("Normal", "甲", 13.9), ("Normal", "甲" * 61, 16))] == [
        ("heading", 3), ("heading", 1), ("heading", 1), ("heading", 3), ("heading", 2), ("paragraph", 0), ("paragraph", 0), ("paragraph", 0)]


def zipped(members: dict[str, bytes], how: int = zipfile.ZIP_STORED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", how) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


PARTS = {"[Content_Types].xml": b"<Types/>", "word/document.xml": b"<w/>"}


def test_uploads(spark):
    docx = zipped(PARTS)
    files = spark.createDataFrame([("a.pdf", b"%PDF-1"), ("b.pdf", b"%PDF-1"), ("c.docx", b"%PDF-1"), ("d.docx", docx), ("e.pdf", b""), ("f.exe", b"MZ"), ("g.pdf", b"%PDF-" + b"x" * 900), ("h.docx", b"PKxx"), ("i.docx", zipped({"word/document.xml": b""})), ("j.pdf", docx)], "path string, content binary").withColumn("length", F.octet_length("content").cast("long")).withColumn("owner", F.lit(1))
    fine, rejected = accepted(files, "owner", 800)
    assert sorted((r.path, r.copies, r.kind) for r in fine.collect()) == [("a.pdf", 2, "pdf"), ("d.docx", 1, "docx")]
    assert {r.path: r.reason for r in rejected.collect()} == {"c.docx": "wrong_signature", "e.pdf": "empty", "f.exe": "wrong_signature", "g.pdf": "too_large", "h.docx": "damaged_zip", "i.docx": "missing_parts", "j.pdf": "wrong_signature"}


def test_zip_directories():
    assert zip_fault(zipped(PARTS)) is None and zip_fault(zipped(PARTS)[:-9]) == "damaged_zip" and zip_fault(zipped({})) == "missing_parts"
    bomb = zipped(PARTS | {"x": bytes(21 << 20)}, zipfile.ZIP_DEFLATED)
    assert zip_fault(bomb) == "suspicious_ratio" and zip_fault(bomb, 5 << 20) == "expands_too_far"
    assert zip_fault(zipped(PARTS | {"x": bytes(19 << 20)}, zipfile.ZIP_DEFLATED)) is None  # below the least size of a bomb
    assert zip_fault(zipped({f"m{i}": b"" for i in range(20_001)})) == "too_many_members"


def test_parsers(spark):
    files = spark.createDataFrame([("a.PDF",), ("b.tar.docx",), ("c",), (".pdf",), ("d.doc",), ("e.",), (None,)], "filename string")
    by_parser, unread = parsers.dispatched(files)
    assert {k: sorted(r.filename for r in v.collect()) for k, v in by_parser.items()} == {"pdf": [".pdf", "a.PDF"], "docx": ["b.tar.docx"]}
    assert {r.filename: r.reason[-4:] for r in unread.collect()} == {"c": "n: .", "d.doc": ".doc", "e.": "n: .", None: "n: ."}


def test_validity_of_parsed_documents(spark):
    code = [("b.py", b"2"), ("a.py", b"1")]
    made = parsers.fingerprint({"OCR_ENABLED": False}, code)
    assert made == parsers.fingerprint({"OCR_ENABLED": False, "OTHER": 1}, code[::-1]) and len(made) == 33
    assert made not in (parsers.fingerprint({"OCR_ENABLED": True}, code), parsers.fingerprint({"OCR_ENABLED": False}, [("b.py", b"3"), code[1]]))
    parsed = spark.createDataFrame([(1, "2", made), (2, "1", made), (3, "2", "old"), (4, None, made), (5, "2", None)], "id int, schema_version string, parser_fingerprint string")
    valid, stale = parsers.split_by_validity(parsed, "2", made)
    assert [r.id for r in valid.collect()] == [1] and sorted(r.id for r in stale.collect()) == [2, 3, 4, 5]
