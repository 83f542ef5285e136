"""Pages to chunks: three strategies, table chunks, indices, ids and qualities."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions.packing import Packer
from corpusmill.operators import headings

STRATEGIES = ("fixed_size", "recursive", "structure_aware")
_PIECES = "doc_id string, page_number int, text_quality double, seq int, chunk_type string, section_heading string, text string"


def _cut(strategy: str, packer: Packer):
    def pieces(text: str, tables: list[str], headings: list[str]) -> Iterator[tuple[str, str | None, str]]:
        if text.strip():
            if strategy == "fixed_size":
                yield from (("text", None, c) for c in packer.by_sentence(text))
            elif strategy == "recursive":
                yield from (("text", None, c) for c in packer.recursive(text))
            else:
                yield from (("text", h, c) for h, c in packer.structured(text, headings))
        for table in tables:
            yield from (("table", None, c) for c in packer.table(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                rows = []
                for r in batch.slice(low, 512).to_pylist():
                    got = pieces(r["text"] or "", [t for t in r["tables"] or [] if t is not None], [h for h in r["headings"] or [] if h])
                    rows += [(r["doc_id"], r["page_number"], r["text_quality"], k, *p) for k, p in enumerate(got)]
                if rows:
                    types = (pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in _PIECES.split(", ")])

    return run


def usable_pages(pages: DataFrame) -> DataFrame:
    """Pages whose quality reaches the threshold; tables of the others go with them."""
    return pages.where(~(F.col("text_quality") < X.LOW_QUALITY) | F.col("text_quality").isNull())


def chunk_pages(pages: DataFrame, strategy: str = "fixed_size", size: int = 400, overlap: int = 39, least: int = 10, packer: Packer | None = None) -> DataFrame:
    """Chunks of all pages. A chunk lies on one page; indices run through a document, text before tables on a page.

    Its quality is the mean quality of the document's pages in its range, or 1 where there are none.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy {strategy!r}; known are {', '.join(STRATEGIES)}")
    packer = packer or Packer(size, overlap, least)
    rows = usable_pages(pages).select("doc_id", "page_number", "text", "tables", "headings", "text_quality")
    pieces = rows.mapInArrow(_cut(strategy, packer), _PIECES)
    out = pieces.withColumn("chunk_index", F.expr("row_number() over (partition by doc_id order by page_number, seq) - 1"))
    return out.select(
        X.chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("page_number"), F.col("page_number"), F.col("text")).alias("chunk_id"),
        "doc_id",
        "text",
        "chunk_type",
        F.col("page_number").alias("page_start"),
        F.col("page_number").alias("page_end"),
        "section_heading",
        F.lit(None).cast("string").alias("subheading"),
        X.token_count(F.col("text")).alias("token_count"),
        F.coalesce("text_quality", F.lit(1.0)).alias("text_quality"),
        "chunk_index",
    )


def skipped_pages(pages: DataFrame) -> DataFrame:
    """doc_id, skipped: how many pages of each document are left out for their quality; documents without such pages are not listed."""
    return pages.where(F.col("text_quality") < X.LOW_QUALITY).groupBy("doc_id").agg(F.count("*").alias("skipped"))


def chunk_documents(pages: DataFrame, strategy: str = "fixed_size", size: int = 400, overlap: int = 39, least: int = 10, packer: Packer | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, skipped): pages of poor quality left out and counted, the others cut, headings attached, qualities averaged.

    Headings and qualities come from the pages that are kept. skipped: skipped_pages().
    """
    kept = usable_pages(pages)
    chunks = headings.attach_headings(chunk_pages(kept, strategy, size, overlap, least, packer), kept)
    return with_page_quality(chunks, kept), skipped_pages(pages)


def with_page_quality(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunks with the mean quality of the pages in their range; theirs stays where no page is."""
    p = pages.select(F.col("doc_id").alias("p_doc"), F.col("page_number").alias("p_no"), F.col("text_quality").alias("p_quality"))
    spans = chunks.select("chunk_id", "doc_id", F.explode(F.sequence("page_start", F.greatest("page_start", "page_end"))).alias("no"))
    mean = spans.join(p, (F.col("doc_id") == F.col("p_doc")) & (F.col("no") == F.col("p_no"))).groupBy("chunk_id").agg(F.avg("p_quality").alias("mean_quality"))
    return chunks.join(mean, "chunk_id", "left").withColumn("text_quality", F.coalesce("mean_quality", "text_quality")).drop("mean_quality")
