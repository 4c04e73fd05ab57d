"""Raw spans of text and tables, as a parser extracts them, to blocks in reading order.

spans: doc_id, page, span_id, text, font, size, flags, color, x0, y0, x1, y1; tables: doc_id, page, span_id, cells (array of arrays),
x0, y0, x1, y1. Blocks of both are numbered together by page, top, left and id (as a string), so that a table stands where
it is read. Rows are shuffled by document, once for its body size and once for its order; only one document's places meet.

Defined results. Null places count as 0, a null text as empty, null flags as none. Ties in all four places are in any order. Documents
without spans or tables have no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import derive
from foliant.functions.columns import strip

#: Bits of a span's flags, and the names that stand for fonts without one.
ITALIC, SERIF, MONO, BOLD = 2, 4, 8, 16
UNNAMED, MONO_NAME, SERIF_NAME, SANS_NAME = ("", "Unknown"), "等线", "宋体", "黑体"


def font(name: Column, size: Column, flags: Column, color: Column) -> Column:
    """struct<name, size, bold, italic, color> of a span. Sizes are cut to a tenth, half-even."""
    bits = F.coalesce(flags, F.lit(0)).cast("long")
    has = lambda bit: bits.bitwiseAND(bit) > 0
    guess = F.when(has(MONO), MONO_NAME).when(has(SERIF), SERIF_NAME).otherwise(SANS_NAME)
    known = F.when(~F.coalesce(name, F.lit("")).isin(*UNNAMED), name)
    return F.struct(F.coalesce(known, guess).alias("name"), F.bround(F.coalesce(size, F.lit(0.0)).cast("double"), 1).alias("size"), has(BOLD).alias("bold"), has(ITALIC).alias("italic"), F.coalesce(color, F.lit(0)).cast("int").alias("color"))


def blocks(spans: DataFrame, tables: DataFrame) -> DataFrame:
    """doc_id, ord, block_id, page, type, level, text, bbox, font, table_data, parse_warnings of each span and table."""
    box = F.struct(*[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).alias("bbox")
    ends = ["doc_id", F.col("span_id").cast("string").alias("block_id"), F.coalesce("page", F.lit(0)).cast("int").alias("page"), box]
    none = lambda kind: F.lit(None).cast(kind)
    text = spans.select(*ends, F.coalesce("text", F.lit("")).alias("text"), font(F.col("font"), F.col("size"), F.col("flags"), F.col("color")).alias("font"), none("array<array<string>>").alias("table_data"), F.array().cast("array<string>").alias("parse_warnings"))
    cells = derive.table_cells(F.col("cells"))
    table = tables.withColumn("read_", cells).select(*ends, derive.table_text(F.col("read_.cells")).alias("text"), font(none("string"), none("double"), F.lit(SERIF), none("int")).alias("font"), F.col("read_.cells").alias("table_data"), F.col("read_.warnings").alias("parse_warnings"))
    place = ["page", "bbox.y0", "bbox.x0", "block_id"]
    sized = text.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*place, F.col("font.size").alias("size")))).alias("s"))
    body = sized.select("doc_id", derive.body_size(F.transform("s", lambda x: x["size"])).alias("body"))
    kind = derive.classified(F.col("text"), F.col("font.bold"), F.col("font.size"), F.col("body"))
    read = text.join(body, "doc_id").withColumn("kind", kind).select(*text.columns, "kind.type", "kind.level")
    both = read.unionByName(table.withColumn("type", F.lit("table")).withColumn("level", F.lit(0)))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(*place)) - 1
    return both.select("doc_id", order.alias("ord"), "block_id", "page", "type", "level", "text", "bbox", "font", "table_data", "parse_warnings")


def page_chars(found: DataFrame) -> DataFrame:
    """doc_id, page, text_chars: characters of a page's blocks, without white space around them."""
    return found.groupBy("doc_id", "page").agg(F.sum(F.length(strip(F.col("text")))).cast("int").alias("text_chars"))
