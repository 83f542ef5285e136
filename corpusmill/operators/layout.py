"""Page layout: repeated edges, reading order, headings by type size, tables, page assembly. Blocks follow schemas.BLOCK."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as X

# Item lines and labels as the page reader tells them.
PARSER_ITEM = r"(?i)^Item\s+\d+[A-C]?\.\s+\S"
PARSER_LABEL = r"^(,$|\d{4}(\s+\d{4})+\s+\()"


def is_edge() -> Column:
    """The block begins in the top tenth or ends in the bottom tenth of its page."""
    return (F.col("y0") <= F.col("page_height") * 0.1) | (F.col("y1") >= F.col("page_height") * 0.9)


def repeated_edges(blocks: DataFrame) -> DataFrame:
    """doc_id, key, n: frequency keys of edge blocks found at least max(2, ceil(0.6 * pages)) times in a document. Counts blocks, not pages."""
    pages = blocks.groupBy("doc_id").agg(F.count_distinct("page_number").alias("pages"))
    keys = blocks.where(is_edge()).select("doc_id", X.frequency_key(F.col("text")).alias("key")).where("key <> ''").groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    return keys.join(pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * 0.6))).select("doc_id", "key", "n")


def flag_edges(blocks: DataFrame) -> DataFrame:
    """blocks with `removed`: repeated edge text or a page number, at an edge."""
    keyed = blocks.withColumn("key", X.frequency_key(F.col("text")))
    known = repeated_edges(blocks).select("doc_id", "key", F.lit(True).alias("known"))
    removed = is_edge() & (F.coalesce("known", F.lit(False)) | X.is_page_number(F.col("key")))
    return keyed.join(known, ["doc_id", "key"], "left").withColumn("removed", F.coalesce(removed, F.lit(False))).drop("known", "key")


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks with `position` (from 1) on their page.

    One column: by top, then left. Two columns (some blocks end left of the middle and some begin right of it): spanning blocks
    above all columns, the left column, the right one, the other spanning blocks, each by top.
    """
    page = "partition by doc_id, page_number"
    side = blocks.withColumn("is_left", F.col("x1") <= F.col("page_width") / 2).withColumn("is_right", (F.col("x0") >= F.col("page_width") / 2) & ~F.col("is_left"))
    side = side.withColumn("two", F.expr(f"max(is_left) over ({page}) and max(x0 >= page_width / 2) over ({page}) and count(1) over ({page}) > 1"))
    side = side.withColumn("column_top", F.expr(f"min(case when is_left or is_right then y0 end) over ({page})"))
    zone = F.when(~F.col("two"), 0).when(F.col("is_left"), 1).when(F.col("is_right"), 2).when(F.col("y1") <= F.col("column_top"), 0).otherwise(3)
    ordered = side.withColumn("zone", zone).withColumn("tie", F.when(F.col("two"), F.lit(0.0)).otherwise(F.col("x0")))
    return ordered.withColumn("position", F.expr(f"row_number() over ({page} order by zone, y0, tie, x0, text)")).drop("is_left", "is_right", "two", "column_top", "zone", "tie")


def detect_headings(blocks: DataFrame) -> DataFrame:
    """doc_id, page_number, position, heading: blocks in larger or emphasised type, or Item lines, the first of equal ones. blocks: retained and ordered."""
    sizes = blocks.select("doc_id", "page_number", F.explode("font_sizes").alias("size")).where("size > 0")
    base = sizes.groupBy("doc_id", "page_number").agg(F.percentile("size", F.lit(0.5)).alias("base"))
    rows = blocks.join(base, ["doc_id", "page_number"]).withColumn("heading", X.clean(F.col("text")))
    top = F.coalesce(F.array_max("font_sizes"), F.lit(0.0))
    item = F.col("heading").rlike(PARSER_ITEM)
    stands_out = (top >= F.col("base") * 1.25) | (F.col("has_bold_span") & (top > F.col("base"))) | item
    rows = rows.where((F.col("heading") != "") & (F.length("heading") <= F.when(item, X.ITEM_CAP).otherwise(X.HEADING_CAP)) & ~F.col("heading").rlike(PARSER_LABEL) & stands_out)
    return rows.groupBy("doc_id", "page_number", "heading").agg(F.min("position").alias("position"))


def _filled(cell: Column) -> Column:
    return F.coalesce(X.strip(cell) != "", F.lit(False))


def is_usable_table(grid: Column) -> Column:
    """At least two columns and a row with two filled cells; if the first row is wider than three, also two columns with two filled cells each.

    Columns reach as far as the shortest row.
    """
    width = F.coalesce(F.array_max(F.transform(grid, F.size)), F.lit(0))
    narrow = F.coalesce(F.array_min(F.transform(grid, F.size)), F.lit(0))
    some_row = F.exists(grid, lambda r: F.size(F.filter(r, _filled)) >= 2)
    columns = F.when(narrow > 0, F.sequence(F.lit(1), narrow)).otherwise(F.array().cast("array<int>"))
    full = F.filter(columns, lambda c: F.size(F.filter(grid, lambda r: _filled(F.get(r, c - 1)))) >= 2)
    return (F.size(grid) > 0) & (width >= 2) & some_row & ((F.size(F.get(grid, F.lit(0))) <= 3) | (F.size(full) >= 2))


def markdown(grid: Column) -> Column:
    """The grid as a Markdown table: rows padded to the widest, cells cleaned, bars escaped, a rule under the first row."""

    def once(value: Column, use: Callable[[Column], Column]) -> Column:
        """use(value), with value computed once however often it stands in use."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def cells(r: Column) -> Column:
        return F.transform(r, lambda c: F.replace(X.clean_native(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")))

    def text(t: Column) -> Column:
        rule = F.array(line(F.array_repeat(F.lit("---"), t["width"])))
        rows = F.transform(t["grid"], lambda r: line(F.concat(cells(r), F.array_repeat(F.lit(""), t["width"] - F.size(r)))))
        return once(rows, lambda lines: F.array_join(F.concat(F.slice(lines, 1, 1), rule, F.slice(lines, 2, F.greatest(F.size(lines), F.lit(2)))), "\n"))

    return once(F.struct(grid.alias("grid"), F.array_max(F.transform(grid, F.size)).alias("width")), text)


def assemble_pages(blocks: DataFrame, tables: DataFrame | None = None, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, warnings): ordered, retained blocks joined by line breaks and cleaned; pages without text and tables become warnings.

    tables: doc_id, page_number, tables (array of Markdown); images: doc_id, page_number of pages with pictures. Pages keep their physical numbers.
    """
    kept = reading_order(flag_edges(blocks).where("not removed").drop("removed"))
    texts = kept.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda b: b["text"]), "\n").alias("raw"))
    heads = detect_headings(kept).groupBy("doc_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "heading"))), lambda h: h["heading"]).alias("headings"))
    every = blocks.select("doc_id", "page_number").distinct().join(texts, ["doc_id", "page_number"], "left").join(heads, ["doc_id", "page_number"], "left")
    every = every.join(tables, ["doc_id", "page_number"], "left") if tables is not None else every.withColumn("tables", F.array().cast("array<string>"))
    every = every.join(images.select("doc_id", "page_number").distinct().withColumn("has_image", F.lit(True)), ["doc_id", "page_number"], "left") if images is not None else every.withColumn("has_image", F.lit(False))
    none = F.array().cast("array<string>")
    every = every.select("doc_id", "page_number", X.clean(F.coalesce("raw", F.lit(""))).alias("text"), F.coalesce("tables", none).alias("tables"), F.coalesce("headings", none).alias("headings"), F.coalesce("has_image", F.lit(False)).alias("has_image"))
    empty = (F.col("text") == "") & (F.size("tables") == 0)
    pages = every.where(~empty).select("doc_id", "page_number", "text", "tables", "headings", F.length("text").alias("char_count"), X.quality(F.col("text")).alias("text_quality"))
    kind = F.when(F.col("has_image"), "scanned_page").otherwise("empty_page")
    missing = every.where(empty).select("doc_id", "page_number", kind.alias("kind"))
    poor = pages.where(F.col("text_quality") < X.LOW_QUALITY).select("doc_id", "page_number", F.lit("low_text_quality").alias("kind"))
    return pages, missing.union(poor)
