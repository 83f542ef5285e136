"""Section headings and subheadings of chunks, from the headings found on the pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as X


def located_headings(pages: DataFrame) -> DataFrame:
    """doc_id, page_number, ord, heading, off, is_section, is_sub: the valid headings of every page, with their offsets."""
    rows = pages.select("doc_id", "page_number", "text", F.posexplode("headings").alias("ord", "heading")).where(F.coalesce(X.is_valid_heading(F.col("heading")), F.lit(False)))
    return rows.select("doc_id", "page_number", "ord", "heading", X.heading_offset(F.col("heading"), F.col("text")).alias("off"), X.is_section(F.col("heading")).alias("is_section"), X.is_subheading(F.col("heading")).alias("is_sub"), X.is_item(F.col("heading")).alias("is_item"))


def _attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sections, subs = [], [], []
        for row in batch.to_pylist():
            pages, chunks = {p["no"]: p for p in row["pages"]}, row["chunks"]
            heads = {no: [h for h in p["heads"] if h] for no, p in pages.items() if p["heads"]}
            for chunk, place in zip(chunks, _places(chunks, pages), strict=True):
                section, sub = (chunk["section"], chunk["sub"]) if not heads else _heading(chunk, place, heads, row["structured"])
                ids.append(chunk["id"])
                sections.append(section)
                subs.append(sub)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(sections, pa.string()), pa.array(subs, pa.string())], names=["chunk_id", "new_section", "new_sub"])


def _places(chunks: list[dict], pages: dict) -> Iterator[tuple[int, int, bool]]:
    """(start, end, found) of each chunk on its first page; the search begins where the last chunk ended, on whatever page that was."""
    last = 0
    for c in chunks:
        page, text = (pages[c["page"]]["text"] or "" if c["page"] in pages else ""), c["text"]
        at = max(page.find(text, last), -1) if text and page else -1
        if at < 0 and text and page:
            at = page.find(text)
        start = at if at >= 0 else last
        last = start + len(text)
        yield start, last, at >= 0


def _heading(chunk: dict, place: tuple[int, int, bool], heads: dict, structured: bool) -> tuple[str | None, str | None]:
    start, end, found = place
    here = heads.get(chunk["page"], [])
    inside = [h["heading"] for h in here if start <= h["off"] <= end and h["is_section"]]
    if found and inside:
        return inside[-1], None
    sub = None
    for no in sorted((n for n in heads if n <= chunk["page"]), reverse=True):
        limit = None
        if no == chunk["page"] and found:  # a chunk that begins at a heading follows the headings within it
            begins = any(chunk["text"].lstrip().startswith(h["heading"]) for h in here)
            limit = end if begins else start
        before = [h for h in heads[no] if limit is None or h["off"] <= limit]
        if not before:
            continue
        if not structured:
            return before[-1]["heading"], sub
        named = [h for h in before if h["is_section"]]
        loose = [h for h in before if not h["is_section"] and h["is_sub"] and (not named or h["off"] > named[-1]["off"])]
        if loose and sub is None:
            sub = loose[-1]["heading"]
        if named:
            return named[-1]["heading"], sub
    return (inside[-1] if inside else None), sub


def attach_headings(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunks with section_heading and subheading from the nearest heading before them; ids stay.

    A section heading (an Item line or a section marker) inside a chunk's span comes first, then the last heading before it on its page,
    then those of earlier pages of the document. In a document with three or more Item headings only section headings name sections;
    others give subheadings. A document without valid headings keeps what its chunks had. One row of a document's pages and chunks goes to
    a worker, so memory is bounded by the largest document.
    """
    heads = located_headings(pages)
    by_page = heads.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("off", "ord", "heading", "is_section", "is_sub"))).alias("heads"))
    structured = heads.groupBy("doc_id").agg((F.count_if("is_item") >= 3).alias("structured"))
    texts = pages.select("doc_id", "page_number", "text").join(by_page, ["doc_id", "page_number"], "left")
    docs = texts.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("page_number").alias("no"), "text", "heads")).alias("pages"))
    per_doc = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", F.col("chunk_id").alias("id"), F.col("page_start").alias("page"), "text", F.col("section_heading").alias("section"), F.col("subheading").alias("sub")))).alias("chunks"))
    joined = per_doc.join(docs, "doc_id", "left").join(structured, "doc_id", "left").select("chunks", F.coalesce("pages", F.array()).alias("pages"), F.coalesce("structured", F.lit(False)).alias("structured"))
    found = joined.mapInArrow(_attach, "chunk_id string, new_section string, new_sub string")
    out = chunks.join(found, "chunk_id")
    return out.withColumn("section_heading", F.col("new_section")).withColumn("subheading", F.col("new_sub")).drop("new_section", "new_sub")


def carry_forward(chunks: DataFrame, headings: DataFrame) -> DataFrame:
    """chunk_id, heading: the last heading at or before each chunk in page and offset order, never across documents.

    chunks: chunk_id, doc_id, page, off; headings: doc_id, page, off, heading. An as-of join by one window over the union of both.
    """
    events = headings.select("doc_id", "page", "off", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("chunk_id"), "heading")
    events = events.unionByName(chunks.select("doc_id", "page", "off", F.lit(1).alias("kind"), "chunk_id", F.lit(None).cast("string").alias("heading")))
    last = F.expr("last(heading) ignore nulls over (partition by doc_id order by page, off, kind, chunk_id rows between unbounded preceding and current row)")
    return events.withColumn("found", last).where("kind = 1").select("chunk_id", F.col("found").alias("heading"))


def contained(chunks: DataFrame, headings: DataFrame) -> DataFrame:
    """chunk_id, heading: the last section heading whose offset lies in the chunk's span on its page. chunks: chunk_id, doc_id, page, off, stop."""
    h = headings.where("is_section").select(F.col("doc_id").alias("h_doc"), F.col("page").alias("h_page"), F.col("off").alias("h_off"), "heading")
    met = chunks.join(h, (F.col("doc_id") == F.col("h_doc")) & (F.col("page") == F.col("h_page")) & F.col("h_off").between(F.col("off"), F.col("stop")))
    return met.groupBy("chunk_id").agg(F.max_by("heading", F.struct("h_off", "heading")).alias("heading"))
