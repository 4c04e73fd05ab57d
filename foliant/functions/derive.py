"""From what a parser extracts to blocks: classes of lines, layout signals, table cells, overlaps, chunks.

All are column functions over one page's or one document's arrays, so that they run where the row is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let, mode, of, strip, whole

#: Heading patterns in the order in which they are tried, with their levels; most characters of a heading by type size.
HEADINGS = ((r"\A[一二三四五六七八九十]+[、.]", 1), (r"\A（[一二三四五六七八九十]+）", 2), (r"(?U)\A\d+\.\d+(?:\.\d+)*", 3), (r"(?U)\A\d+[\.、](?!\d)", 2), (r"(?U)\A\(\d+\)", 2))
HEADING_CHARS, BODY_SIZE, TABLE_MARGIN = 30, 12.0, 2.0


def body_size(sizes: Column) -> Column:
    """The most frequent size, in halves of a point; 12 without any."""
    return F.coalesce(mode(F.transform(sizes, lambda s: F.bround(s * 2) / 2)), F.lit(BODY_SIZE))


def classified(text: Column, bold: Column, size: Column, body: Column) -> Column:
    """struct<type, level> of a line: numbers and signs alone are no heading; then patterns; then bold, larger and short."""
    t = strip(text)
    kind = lambda k, level: F.struct(F.lit(k).alias("type"), F.lit(level).alias("level"))
    out = F.when(whole(t, r"[\d\s\.、\-–—:;,()%]+"), kind("paragraph", 0))
    for pattern, level in HEADINGS:
        out = out.when(F.regexp_like(t, F.lit(pattern)), kind("heading", level))
    return out.when(bold & (size > body) & (F.length(t) < HEADING_CHARS), kind("heading", 2)).otherwise(kind("paragraph", 0))


def alignment(x0: Column, x1: Column, width: Column) -> Column:
    wide = F.greatest(x1 - x0, F.lit(0.0))
    return F.when((wide < width * 0.8) & (F.abs((x0 + x1) / 2 - width / 2) <= 10), "center").when((wide < width * 0.65) & (x1 >= width - 36), "right").otherwise("left")


def line_spacing(tops: Column) -> Column:
    """The median of the positive gaps between lines' tops, to hundredths; null for none."""
    ordered = F.array_sort(tops)
    gaps = let(ordered, lambda o: F.filter(F.transform(o, lambda y, i: y - F.get(o, i - 1)), lambda g: g > 0))

    def median(g: Column) -> Column:
        s, n = F.array_sort(g), F.size(g)
        mid = lambda k: F.get(s, F.floor(k).cast("int"))
        return F.when(n > 0, F.bround((mid((n - 1) / 2) + mid(n / 2)) / 2, 2))

    return let(gaps, median)


def first_indent(lefts: Column) -> Column:
    """How far the first line begins from the leftmost of the others, to hundredths; null for one line."""
    return F.when(F.size(lefts) >= 2, F.bround(F.get(lefts, F.lit(0)) - F.array_min(F.slice(lefts, 2, F.size(lefts))), 2))


def table_cells(rows: Column) -> Column:
    """struct<cells, warnings>: null cells and missing ones become empty, so that columns stay in place."""
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.coalesce(F.size(r), F.lit(0)))), F.lit(0))
    empty_rows = F.size(F.filter(rows, lambda r: r.isNull()))

    def made(w: Column) -> Column:
        cells = F.transform(rows, lambda r: F.transform(F.sequence(F.lit(0), w - 1), lambda i: F.coalesce(F.get(r, i), F.lit(""))))
        ragged = F.size(F.filter(rows, lambda r: r.isNotNull() & (F.size(r) < w)))
        told = F.array_compact(F.array(F.when(empty_rows > 0, F.concat(empty_rows.cast("string"), F.lit(" 行为空行，已按空单元格占位"))), F.when(ragged > 0, F.concat(ragged.cast("string"), F.lit(" 行长度不足最宽行，已补齐空单元格")))))
        nothing = lambda m: F.struct(F.array().cast("array<array<string>>").alias("cells"), F.array(F.lit(m)).alias("warnings"))
        return F.when(rows.isNull(), nothing("表格未提取到任何行")).when(w == 0, nothing("表格未提取到任何单元格")).otherwise(F.struct(cells.alias("cells"), told.alias("warnings")))

    return let(width, made)


def table_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda r: F.array_join(r, " ")), " | ")


def overlaps(a: Column, b: Column, margin: float = 0.0) -> Column:
    """Whether two boxes (x0, y0, x1, y1) overlap, the second widened by a margin."""
    return (a["x1"] > b["x0"] - margin) & (a["x0"] < b["x1"] + margin) & (a["y1"] > b["y0"] - margin) & (a["y0"] < b["y1"] + margin)


def outside_tables(blocks: Column, tables: Column) -> Column:
    """The page's text blocks (with bbox) that overlap no table: an anti join within the row."""
    return F.filter(blocks, lambda b: ~F.exists(tables, lambda t: overlaps(b["bbox"], t, TABLE_MARGIN)))


def image_share(images: Column, width: Column, height: Column) -> Column:
    """The images' areas together, as a share of the page, at most 1."""
    area = F.aggregate(images, F.lit(0.0), lambda a, b: a + F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0)))
    return F.least(F.lit(1.0), area / F.greatest(F.lit(1.0), width * height))


def unread_image(images: Column, texts: Column, width: Column, height: Column) -> Column:
    """Whether an image of half the page or more has no text box in it."""
    return F.exists(images, lambda i: ((i["x1"] - i["x0"]) * (i["y1"] - i["y0"]) >= 0.5 * F.greatest(F.lit(1.0), width * height)) & ~F.exists(texts, lambda t: overlaps(t, i)))


def chunks(items: Column, size, most: int, kind: str) -> Column:
    """Items in order, packed greedily: a chunk is closed when the next item would bring it over `most`. An item alone may be over.

    kind is the items' type.
    """
    state = f"struct<done:array<array<{kind}>>,now:array<{kind}>,n:long>"
    start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("done"), F.array().cast(f"array<{kind}>").alias("now"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        full = (F.size(s["now"]) > 0) & (s["n"] + size(x) > most)
        fresh = F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), F.array(x).alias("now"), size(x).cast("long").alias("n"))
        more = F.struct(s["done"].alias("done"), F.concat(s["now"], F.array(x)).alias("now"), (s["n"] + size(x)).cast("long").alias("n"))
        return F.when(full, fresh).otherwise(more).cast(state)

    return F.aggregate(items, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def placed(evidence: Column, blocks: Column) -> Column:
    """The first block whose text holds the evidence, blanks aside; null if none does."""
    bare = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s+", "")
    return let(bare(evidence), of(lambda e: F.get(F.filter(blocks, lambda b: (e != "") & F.contains(bare(b["text"]), e)), F.lit(0))))
