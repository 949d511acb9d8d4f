"""Lines of pages to blocks in reading order, and which pages show figures.

Lines: (doc, page, ord, x0, y0, x1, y1, text, font_size), with page_width and page_height where they matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.text import squeeze


def plain_line(text: Column) -> Column:
    """Without soft hyphens, single blanks."""
    return squeeze(F.replace(text, F.lit("­"), F.lit("")))


def margin_noise(text: Column, y0: Column, y1: Column, font: Column, height: Column) -> Column:
    """Short small lines in the top or bottom six hundredths of a page, and bare numbers."""
    small = (F.coalesce(font, F.lit(0.0)) == 0) | (font <= 11.5)
    top = (y1 <= height * 0.06) & (F.length(text) <= 80) & small
    bottom = (y0 >= height * 0.94) & (F.length(text) <= 140) & small
    return top | bottom | text.rlike("^\\d+$")


def shows_figure(drawings: Column, images: Column, text: Column) -> Column:
    """Whether a page has a figure: many drawings, two sizeable images, one of them with some drawings, or words of a figure with either.

    images: ARRAY(STRUCT(width, height)); sizeable is over 40000 pixels and less than six times as long as wide. A page that is one scanned image
    without such signs has none."""
    words = F.lower(F.coalesce(text, F.lit("")))
    cue = F.exists(F.array(*map(F.lit, ("figure", "fig.", "fig ", "graph", "chart"))), lambda k: F.contains(words, k))
    long, short = (lambda i: F.greatest(i["width"], i["height"])), (lambda i: F.least(i["width"], i["height"]))
    sizeable = F.size(F.filter(images, lambda i: (i["width"].cast("double") * i["height"] > 40000) & (short(i) > 0) & (long(i) / F.greatest(F.lit(1), short(i)) < 6)))
    return (drawings >= 60) | (sizeable >= 2) | (cue & ((sizeable >= 1) | (drawings >= 15))) | ((sizeable == 1) & (drawings >= 15))


def columns_of(lines: DataFrame) -> DataFrame:
    """lines with ``column``: spanning lines first, then left, then right; pages with few lines, or without both sides, have one.

    Lines between the columns go to the nearer one, whose mean moves with each, so a page is a unit of Python work; a page is bounded."""
    named = lines.schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named) + ", column int"

    def place(page: pa.Table) -> pa.Table:
        x0, x1 = page.column("x0").to_pylist(), page.column("x1").to_pylist()
        n, width = len(x0), page.column("page_width")[0].as_py() if page.num_rows else 0
        middle, gutter = width / 2, width * 0.05
        where = [0] * n
        if n >= 6:
            spans = {i for i in range(n) if (x0[i] < middle - gutter and x1[i] > middle + gutter) or x1[i] - x0[i] >= width * 0.45}
            rest = [i for i in range(n) if i not in spans]
            left = [i for i in rest if x0[i] < middle - gutter]
            right = [i for i in rest if x0[i] >= middle - gutter]
            if left and right:
                held = [g for g in (sorted(spans), left, right) if g]
                for c, group in enumerate(held):
                    for i in group:
                        where[i] = c
        return page.append_column("column", pa.array(where, pa.int32()))

    return lines.groupBy("doc", "page").applyInArrow(place, schema)


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc, page, column, block, bbox, text, line_count): runs of lines with small gaps and indents, as gaps and islands of each page's column."""
    by = Window.partitionBy("doc", "page", "column").orderBy("y0", "x0", "ord")
    before = {c: F.lag(c).over(by) for c in ("y1", "x0", "font_size")}
    font = F.greatest((before["font_size"] + F.col("font_size")) / 2, F.lit(1.0))
    same = (F.col("y0") - before["y1"] <= F.greatest(F.lit(10.0), font * 0.9)) & (F.abs(F.col("x0") - before["x0"]) <= 24)
    marked = lines.withColumn("break", F.when(same, 0).otherwise(1)).withColumn("n", F.row_number().over(by))
    islands = marked.withColumn("block", F.sum("break").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    joined = F.aggregate(parts, F.lit(""), lambda held, t: F.when(held == "", t).when(held.rlike("[A-Za-z]-$"), F.concat(F.regexp_replace(held, "-$", ""), t)).otherwise(F.concat(held, F.lit(" "), t)))
    box = F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1"))
    return islands.groupBy("doc", "page", "column", "block").agg(box.alias("bbox"), plain_line(joined).alias("text"), F.count("*").cast("int").alias("line_count"))


def reading_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of all pages without margin noise; a page's lines are cleaned, put into columns and merged."""
    kept = lines.withColumn("text", plain_line(F.col("text"))).where(F.col("text") != "")
    kept = kept.where(~margin_noise(F.col("text"), F.col("y0"), F.col("y1"), F.col("font_size"), F.col("page_height")))
    return paragraphs(columns_of(kept))


def parsed_lines(files: DataFrame, parser) -> DataFrame:
    """Lines by a parser of one's own: for a file's bytes it gives (page, width, height, x0, y0, x1, y1, text, font_size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(name, r[0], i, *map(float, r[1:7]), r[7], float(r[8] or 0)) for i, r in enumerate(parser(content.as_py()))]
                kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.float64()] * 6, pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc", "page", "ord", "page_width", "page_height", "x0", "y0", "x1", "y1", "text", "font_size"])

    return files.select("file", "content").mapInArrow(run, "doc string, page int, ord int, page_width double, page_height double, x0 double, y0 double, x1 double, y1 double, text string, font_size double")
