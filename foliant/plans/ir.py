"""Documents as rows: one row for each, with its pages and blocks as arrays of structs in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = (
    "struct<ord:int,id:string,page:int,type:string,level:int,text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,"
    "font:struct<name:string,size:double,bold:boolean,italic:boolean,color:int>,"
    "layout:struct<alignment:string,line_count:int,line_spacing_pt:double,line_spacing_multiple:double,first_line_indent_pt:double,left_indent_pt:double,right_indent_pt:double,space_before_pt:double,space_after_pt:double>,"
    "table_data:array<array<string>>,image_hash:string,parse_warnings:array<string>,words:long>"
)
PAGE = "struct<page_number:int,width:double,height:double,status:string,text_chars:int,reason:string,image_area_ratio:double,ocr_attempted:boolean>"
DOCUMENT = f"doc_id string, filename string, pages int, word_count long, ocr_pages array<int>, parse_warnings array<string>, page_meta array<{PAGE}>, blocks array<{BLOCK}>"


def words(text: Column) -> Column:
    """Characters but line feeds and blanks."""
    return F.length(F.translate(F.coalesce(text, F.lit("")), "\n ", "")).cast("long")


def block(i: Column, kind: Column | str, text: Column, level: Column | int = 0, page: Column | int = 1) -> Column:
    """A block with nothing but its place, type, level and text."""
    lit = lambda x: F.lit(x) if not isinstance(x, Column) else x
    none = lambda t: F.lit(None).cast(t)
    box = F.struct(*[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])
    font = F.struct(F.lit("").alias("name"), F.lit(0.0).alias("size"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(0).alias("color"))
    fields = {
        "ord": i.cast("int"), "id": F.concat(F.lit("b"), (i + 1).cast("string")), "page": lit(page).cast("int"), "type": lit(kind), "level": lit(level).cast("int"), "text": text, "bbox": box, "font": font,
        "layout": none(BLOCK.split("layout:")[1].split(">,")[0] + ">"), "table_data": none("array<array<string>>"), "image_hash": none("string"), "parse_warnings": F.array().cast("array<string>"), "words": words(text),
    }
    # named field by field: the fields of a struct that is cast as a whole would be made again for each field that is read or changed
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def assembled(docs: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Document rows from the three IR tables, with two shuffles by doc_id; tables of documents stay narrow projections after."""
    fields = [f.split(":")[0] for f in ("page_number", "width", "height", "status", "text_chars", "reason", "image_area_ratio", "ocr_attempted")]
    meta = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).cast(f"array<{PAGE}>").alias("page_meta"))
    row = F.struct("ord", F.col("block_id").alias("id"), "page", "type", "level", "text", "bbox", "font", "layout", "table_data", "image_hash", "parse_warnings", words(F.col("text")).alias("words"))
    in_order = F.array_sort(F.collect_list(row), lambda a, b: a["ord"] - b["ord"]).cast(f"array<{BLOCK}>")
    body = blocks.groupBy("doc_id").agg(in_order.alias("blocks"))
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t)).alias(c)
    return docs.join(meta, "doc_id", "left").join(body, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("doc_id"), "filename", "pages", F.col("word_count").cast("long").alias("word_count"),
        empty("ocr_pages", "array<int>"), empty("parse_warnings", "array<string>"), empty("page_meta", f"array<{PAGE}>"), empty("blocks", f"array<{BLOCK}>"),
    )


def from_html(pages: DataFrame, doc_id: str = "page_id", html: str = "html") -> DataFrame:
    """Web pages as documents of one page: <h1>, <h2> and <h3> are headings, <p> and <li> paragraphs. No shuffle."""
    tag = r"(?is)<(h[1-3]|p|li)(?:\s[^>]*)?>(.*?)</(?:h[1-3]|p|li)>"
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(tag), F.lit(1)).alias("t"), F.regexp_extract_all(html, F.lit(tag), F.lit(2)).alias("x"))
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))
    head = lambda x: F.startswith(F.lower(x["t"]), F.lit("h"))
    blocks = F.transform(found, lambda x, i: block(i, F.when(head(x), "heading").otherwise("paragraph"), plain(x["x"]), F.when(head(x), F.substring(x["t"], 2, 1).try_cast("int")).otherwise(0)))
    return _rows(pages.select(F.col(doc_id).cast("string").alias("doc_id"), blocks.alias("blocks")))


def from_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heading_chars: int = 60) -> DataFrame:
    """Plain texts as documents: each line is a block, short ones are headings of level 1. No shuffle."""
    blocks = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda t, i: block(i, F.when(F.length(t) < heading_chars, "heading").otherwise("paragraph"), t, F.when(F.length(t) < heading_chars, 1).otherwise(0)))
    return _rows(docs.select(F.col(doc_id).cast("string").alias("doc_id"), blocks.alias("blocks")))


def _rows(df: DataFrame) -> DataFrame:
    meta = F.array(F.struct(F.lit(1), F.lit(595.0), F.lit(842.0), F.lit("ok"), F.lit(0), F.lit(""), F.lit(0.0), F.lit(False)).cast(PAGE))
    total = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b["words"])
    empty = lambda t: F.array().cast(t)
    return df.select("doc_id", F.col("doc_id").alias("filename"), F.lit(1).alias("pages"), total.alias("word_count"), empty("array<int>").alias("ocr_pages"), empty("array<string>").alias("parse_warnings"), meta.alias("page_meta"), "blocks")
