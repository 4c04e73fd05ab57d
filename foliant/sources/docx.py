"""DOCX files as documents: read as binary files by Spark, parsed in tasks with the standard library, one row for each file.

Blocks have no page (page is null, pages is 0). Empty paragraphs are dropped, tables keep all their cells. A file that can't
be read gives a row without blocks and with the fault among its warnings.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans.ir import DOCUMENT

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: The font that a paragraph has where nothing says otherwise, the width of a block, alignments.
FONT, SIZE, WIDTH = "宋体", 12.0, 595.28
ALIGNMENTS = {"left": "left", "start": "left", "center": "center", "right": "right", "end": "right", "both": "justify"}
HEADING_CHARS, HEADING_SIZE = 60, 14.0


def attribute(node, path: str, name: str = "val") -> str | None:
    found = node.find("/".join(W + p for p in path.split("/"))) if node is not None else None
    return None if found is None else found.get(W + name)


def switched(node, name: str) -> bool | None:
    """Whether a property is on: present without a value, or with one that isn't off; null where it is absent."""
    found = node.find(W + name) if node is not None else None
    return None if found is None else found.get(W + "val", "1") not in ("0", "false", "off")


def text_of(p) -> str:
    out = []
    for node in p.iter():
        tag = node.tag.removeprefix(W)
        out.append((node.text or "") if tag == "t" else "\t" if tag == "tab" and node.get(W + "val") is None else "\n" if tag in ("br", "cr") else "")
    return "".join(out)


def font_of(style, p) -> dict:
    """The style's font, then what the runs say: of names and sizes the last, bold and italic if any run is."""
    found = {"name": FONT, "size": SIZE, "bold": False, "italic": False, "color": 0}
    for own in [style.find(W + "rPr") if style is not None else None, *[r.find(W + "rPr") for r in p.findall(W + "r")]]:
        if own is None:
            continue
        found["name"] = attribute(own, "rFonts", "ascii") or found["name"]
        found["size"] = float(attribute(own, "sz") or 2 * found["size"]) / 2
        found["bold"] = found["bold"] or bool(switched(own, "b"))
        found["italic"] = found["italic"] or bool(switched(own, "i"))
    return found | {"size": round(found["size"], 1)}


def layout_of(style, p, text: str) -> dict:
    def effective(path: str, name: str = "val") -> str | None:
        own = attribute(p.find(W + "pPr"), path, name)
        return own if own is not None else attribute(style.find(W + "pPr") if style is not None else None, path, name)

    twips = lambda v: None if v is None else round(float(v) / 20, 2)
    line, exact = effective("spacing", "line"), effective("spacing", "lineRule") in ("exact", "atLeast")
    hanging = effective("ind", "hanging")
    return {
        "alignment": ALIGNMENTS.get(effective("jc") or "", ""),
        "line_count": max(1, len(text.splitlines())),
        "line_spacing_pt": twips(line) if exact else None,
        "line_spacing_multiple": None if exact or line is None else round(float(line) / 240, 2),
        "first_line_indent_pt": twips(effective("ind", "firstLine")) if hanging is None else -twips(hanging),
        "left_indent_pt": twips(effective("ind", "left") or effective("ind", "start")),
        "right_indent_pt": twips(effective("ind", "right") or effective("ind", "end")),
        "space_before_pt": twips(effective("spacing", "before")),
        "space_after_pt": twips(effective("spacing", "after")),
    }


def classified(style_name: str, text: str, size: float) -> tuple[str, int]:
    """By the style's name, and its first digit from 1 to 6; else large, short text that doesn't end a sentence is a heading."""
    name, bare = style_name.lower(), text.strip()
    if "heading" in name or "标题" in name:
        return "heading", next((i for i in range(1, 7) if str(i) in name), 1)
    if len(bare) > HEADING_CHARS or size < HEADING_SIZE or bare.endswith("。"):
        return "paragraph", 0
    if re.match(r"[一二三四五六七八九十]、", bare):
        return "heading", 1
    return "heading", 3 if re.match(r"\d+\.\d+\.?\s", bare) else 2


def parsed(name: str, data: bytes) -> dict:
    row = {"doc_id": name, "filename": name.rsplit("/", 1)[-1], "pages": 0, "word_count": 0, "ocr_pages": [], "parse_warnings": [], "page_meta": [], "blocks": []}
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(W + "body")
            sheet = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else None
    except Exception as e:  # noqa: BLE001  one file's fault is its own
        return row | {"parse_warnings": [f"无法解析：{type(e).__name__}"]}
    styles = {s.get(W + "styleId"): s for s in (sheet.findall(W + "style") if sheet is not None else []) if s.get(W + "type") == "paragraph"}
    default = next((s for s in styles.values() if s.get(W + "default") == "1"), None)
    box = {"x0": 0.0, "y0": 0.0, "x1": WIDTH, "y1": 20.0}
    for node in body if body is not None else []:
        n, tag = len(row["blocks"]), node.tag.removeprefix(W)
        block = {"ord": n, "id": f"b{n}", "page": None, "bbox": box, "parse_warnings": []}
        if tag == "p" and (text := text_of(node)).strip():
            style = styles.get(attribute(node, "pPr/pStyle"), default)
            font = font_of(style, node)
            kind, level = classified(attribute(style, "name") or "Normal", text, font["size"])
            words = len(text.replace("\n", "").replace(" ", ""))
            row["word_count"] += words
            row["blocks"].append(block | {"type": kind, "level": level, "text": text, "font": font, "layout": layout_of(style, node, text), "words": words})
        elif tag == "tbl" and (rows := [["\n".join(text_of(p) for p in c.findall(W + "p")).strip() for c in r.findall(W + "tc")] for r in node.findall(W + "tr")]):
            text = " | ".join(" ".join(r) for r in rows)
            row["word_count"] += len(text)  # a table counts with its blanks
            row["blocks"].append(block | {"type": "table", "level": 0, "text": text, "font": {"name": "", "size": 0.0, "bold": False, "italic": False, "color": 0}, "table_data": rows, "words": len(text.replace("\n", "").replace(" ", ""))})
    return row


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Documents (see plans.ir) of the .docx files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)

    @F.pandas_udf("string")
    def as_json(names: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(parsed(n, c), ensure_ascii=False) for n, c in zip(names, contents, strict=True)])

    return files.select(F.from_json(as_json("path", "content"), DOCUMENT).alias("x")).select("x.*")
