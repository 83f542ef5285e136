"""Scans and sinks: PDF discovery and page readers, record tables, gold sets, query files, saved evidence, uploads."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import layout
from corpusmill.schemas import BLOCK, CHUNK, PAGE
from corpusmill.sources import pdf

PDF_SIGNATURE = bytes((0x25, 0x50, 0x44, 0x46, 0x2D))
#: Folders of the record table.
BUCKETS = 256
MAX_UPLOAD, MAX_EVIDENCE_BYTES, MAX_EVIDENCE_ITEMS = 50 << 20, 1 << 20, 100


def discover_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content, file_hash, doc_id, stem of every PDF below path, whatever the case of its suffix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    digest = F.sha2("content", 256)
    return files.select("path", "length", "content", digest.alias("file_hash"), X.document_id(digest).alias("doc_id"), F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"))


def pending(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose hash has no stored record. stored: file_hash."""
    return files.join(stored.select("file_hash").distinct(), "file_hash", "left_anti")


def ingest_status(files: DataFrame, stored: DataFrame) -> DataFrame:
    """path, file_hash, status: skipped where a record of the hash is stored, else pending."""
    known = stored.select("file_hash").distinct().withColumn("known", F.lit(True))
    return files.join(known, "file_hash", "left").select("path", "file_hash", F.when(F.col("known"), "skipped").otherwise("pending").alias("status"))


def _place(spark: SparkSession, path: str):
    """A path, and the file system it is on."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    where, system = _place(spark, path)
    return system.exists(where)


Reader = Callable[[bytes], list[dict]]


def pymupdf_reader() -> Reader:
    """Text blocks by the PyMuPDF library, where it is installed."""
    try:
        import pymupdf
    except ImportError as error:
        raise RuntimeError("PyMuPDF is not installed; give read_blocks() another reader") from error

    def read(content: bytes) -> list[dict]:
        out = []
        with pymupdf.open(stream=content, filetype="pdf") as doc:
            if doc.needs_pass:
                raise ValueError("encrypted")
            for number, page in enumerate(doc, 1):
                for block in page.get_text("dict")["blocks"]:
                    spans = [s for line in block.get("lines", []) for s in line["spans"]]
                    lines = ["".join(s["text"] for s in line["spans"]) for line in block.get("lines", [])]
                    if "".join(lines).strip():
                        x0, y0, x1, y1 = block["bbox"]
                        out.append({"page_number": number, "page_width": page.rect.width, "page_height": page.rect.height, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "text": "\n".join(lines), "font_sizes": [float(s["size"]) for s in spans if s["text"].strip()], "has_bold_span": any(s["flags"] & 16 for s in spans)})
        return out

    return read


def plain_reader() -> Reader:
    """Text blocks by the built-in reader."""
    return pdf.text_blocks


def read_blocks(files: DataFrame, reader: Callable[[], Reader] = plain_reader) -> DataFrame:
    """Blocks (schemas.BLOCK) of every file with `status` and `error`: a file that its reader rejects gives one row with status failed.

    reader is made once a worker. Page numbers are physical, from 1.
    """
    schema = pa.schema([(f.name, {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}[f.dataType.simpleString()]) for f in BLOCK] + [("status", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = None
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    read = read or reader()
                    rows = [{**b, "doc_id": doc, "status": "processed"} for b in read(content)] or [{"doc_id": doc, "status": "processed"}]
                except Exception as error:  # noqa: BLE001  a file that cannot be read fails by itself
                    rows = [{"doc_id": doc, "status": "failed", "error": f"{type(error).__name__}: {error}"}]
                yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in rows], schema)

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in BLOCK)
    return files.select("doc_id", "content").mapInArrow(run, f"{ddl}, status string, error string")


GridReader = Callable[[bytes], list[tuple[int, list[list[str | None]]]]]


def pdfplumber_grids() -> GridReader:
    """Ruled tables by the pdfplumber library, where it is installed; lines within three points count as one."""
    try:
        import pdfplumber
    except ImportError as error:
        raise RuntimeError("pdfplumber is not installed; give read_grids() another reader") from error

    def read(content: bytes) -> list[tuple[int, list[list[str | None]]]]:
        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return [(n, grid) for n, page in enumerate(pdf.pages, 1) for grid in page.extract_tables({"snap_tolerance": 3, "join_tolerance": 3})]

    return read


def plain_grids() -> GridReader:
    """Ruled tables by the built-in reader."""
    return pdf.ruled_tables


def read_grids(files: DataFrame, reader: Callable[[], GridReader] = plain_grids) -> DataFrame:
    """doc_id, page_number, grid, error: the tables of every file; a file whose tables cannot be read gives one row with an error, a warning rather than a failure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = None
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    read = read or reader()
                    rows = [(doc, n, grid, None) for n, grid in read(content)]
                except Exception as error:  # noqa: BLE001  tables that cannot be read are a warning
                    rows = [(doc, None, None, f"{type(error).__name__}: {error}")]
                if rows:
                    types = (pa.string(), pa.int32(), pa.list_(pa.list_(pa.string())), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "page_number", "grid", "error"])

    return files.select("doc_id", "content").mapInArrow(run, "doc_id string, page_number int, grid array<array<string>>, error string")


def page_tables(grids: DataFrame) -> DataFrame:
    """doc_id, page_number, tables: the usable grids of each page as Markdown, in a defined order."""
    good = grids.where(F.col("grid").isNotNull()).where(layout.is_usable_table(F.col("grid"))).select("doc_id", "page_number", layout.markdown(F.col("grid")).alias("markdown"))
    return good.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list("markdown")).alias("tables"))


def ingest(spark: SparkSession, folder: str, path: str, reader: Callable[[], Reader] = plain_reader, grids: Callable[[], GridReader] = plain_grids) -> DataFrame:
    """Read the PDF files below `folder` whose hash the record table at `path` does not hold, add their pages to it, and return
    path, doc_id, status (processed, skipped or failed), pages, tables, warnings, low_quality and error of every file.

    A file that cannot be read fails by itself; tables that cannot be read, empty and scanned pages are warnings.
    """
    found = discover_pdfs(spark, folder)
    records = read_pages(spark, path) if _exists(spark, path) else None
    stored = records.select(F.substring("doc_id", 5, 64).alias("file_hash")).distinct() if records is not None else spark.createDataFrame([], "file_hash string")
    once = pending(found, stored).groupBy("doc_id").agg(F.min_by("content", "path").alias("content"))  # equal files are one document
    steps = {name: f"{path.rstrip('/')}.{name}" for name in ("blocks", "grids", "status")}

    def kept(df: DataFrame, name: str) -> DataFrame:
        """df as a table beside the records, so that every file is read once."""
        df.write.mode("overwrite").parquet(steps[name])
        return spark.read.parquet(steps[name])

    blocks = kept(read_blocks(once, reader), "blocks")
    bad = blocks.where("status = 'failed'").select("doc_id", "error")
    tables = kept(read_grids(once.join(bad, "doc_id", "left_anti"), grids), "grids")
    named, good = page_tables(tables), blocks.where("status = 'processed' and page_number is not null").drop("status", "error")
    pages, warnings = layout.assemble_pages(good, named)
    # a page of tables alone has no block of text
    alone = named.join(good.select("doc_id", "page_number"), ["doc_id", "page_number"], "left_anti")
    none = F.array().cast("array<string>")
    pages = pages.unionByName(alone.select("doc_id", "page_number", F.lit("").alias("text"), "tables", none.alias("headings"), F.lit(0).alias("char_count"), F.lit(1.0).alias("text_quality")))
    pages = pages.join(found.groupBy("doc_id").agg(F.min("path").alias("source_file")), "doc_id")
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.size("tables")).alias("tables"), F.count_if(F.col("text_quality") < X.LOW_QUALITY).alias("low_quality"))
    trouble = warnings.select("doc_id").union(tables.where("error is not null").select("doc_id")).groupBy("doc_id").agg(F.count("*").alias("warnings"))
    status = found.select("path", "doc_id", "file_hash").join(stored.withColumn("known", F.lit(True)), "file_hash", "left").join(bad, "doc_id", "left")
    status = status.withColumn("status", F.when(F.col("known"), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("processed"))
    figures = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pages", "tables", "warnings", "low_quality")]
    out = kept(status.join(counts, "doc_id", "left").join(trouble, "doc_id", "left").select("path", "doc_id", "status", *figures, "error"), "status")
    write_pages(pages, path)
    for name in ("blocks", "grids"):
        _place(spark, steps[name])[1].delete(_place(spark, steps[name])[0], True)
    return out


def html_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Web pages as schemas.PAGE: first-level headings, the text of paragraphs and list items; navigation and footers are edges and go."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(nav|footer|script|style|head)\b[^>]*>.*?</\1>", " ")

    def bare(x: Column) -> Column:
        flat = F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " ")
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            flat = F.replace(flat, F.lit(entity), F.lit(char))
        return F.trim(flat)

    blocks = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<(h1|p|li)\b[^>]*>(.*?)</\1>"), F.lit(2)), bare), lambda s: s != "")
    heads = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<h1\b[^>]*>(.*?)</h1>"), F.lit(1)), bare), lambda s: s != "")
    rows = pages.select(F.col(key).cast("string").alias("doc_id"), F.lit(1).alias("page_number"), F.array_join(blocks, "\n").alias("text"), F.array().cast("array<string>").alias("tables"), F.array_distinct(heads).alias("headings"))
    return rows.select("*", F.length("text").alias("char_count"), X.quality(F.col("text")).alias("text_quality"))


def plain_pages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents of one page each as schemas.PAGE."""
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.lit(1).alias("page_number"), F.coalesce(text, F.lit("")).alias("text"), none.alias("tables"), none.alias("headings"))
    return rows.select("*", F.length("text").alias("char_count"), X.quality(F.col("text")).alias("text_quality"))


def turn_pages(conversations: DataFrame) -> DataFrame:
    """Conversations as documents with one page a turn."""
    none = F.array().cast("array<string>")
    rows = conversations.select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page_number"), F.coalesce("text", F.lit("")).alias("text"), none.alias("tables"), none.alias("headings"))
    return rows.select("*", F.length("text").alias("char_count"), X.quality(F.col("text")).alias("text_quality"))


def write_pages(pages: DataFrame, path: str) -> None:
    """The record table, in BUCKETS folders by a hash of the document; a run replaces only the documents it holds.

    Of the folders that the run's documents fall into, the other documents are read and written again beside them, to a new place first.
    """
    spark = pages.sparkSession
    fresh = pages.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
    if _exists(spark, path):
        old = read_pages(spark, path)
        touched = fresh.select("bucket").distinct()  # BUCKETS rows at most
        kept = old.join(F.broadcast(touched), "bucket", "left_semi").join(pages.select("doc_id").distinct(), "doc_id", "left_anti")
        fresh = fresh.unionByName(kept.select(fresh.columns))
    staged = f"{path.rstrip('/')}.staged"
    fresh.repartition("bucket", F.pmod(F.xxhash64("doc_id", "page_number"), F.lit(8))).sortWithinPartitions("bucket", "doc_id", "page_number").write.mode("overwrite").partitionBy("bucket").parquet(staged)
    spark.read.schema(fresh.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    where, system = _place(spark, staged)
    system.delete(where, True)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The record table of write_pages(), with its bucket."""
    return spark.read.parquet(path)


def read_page_records(spark: SparkSession, path: str) -> DataFrame:
    """Page records from JSON; a malformed record is an error. The quality is computed again, whatever is written."""
    rows = spark.read.schema(PAGE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    wrong = (F.col("char_count") != 0) & (F.col("char_count") != F.length("text"))
    return rows.withColumn("char_count", F.when(wrong, F.raise_error(F.lit("char_count does not match the text")).cast("int")).otherwise(F.col("char_count"))).withColumn("text_quality", X.quality(F.col("text")))


def write_chunk_lines(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, all fields but the subheading."""
    chunks.select(*(f.name for f in CHUNK if f.name != "subheading")).write.mode("overwrite").json(path)


def read_gold_set(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query, relevant_chunk_ids, note, version of a gold file."""
    files = spark.read.format("binaryFile").load(path).select(F.substring(F.sha2("content", 256), 1, 12).alias("version"), F.decode("content", "UTF-8").alias("body"))
    value = F.from_json("body", "struct<queries: array<struct<query: string, relevant_chunk_ids: array<string>, note: string>>>", {"mode": "FAILFAST"})
    return files.select("version", F.posexplode(value["queries"]).alias("n", "q")).select(F.col("n").cast("string").alias("query_id"), "q.query", F.array_sort(F.array_distinct("q.relevant_chunk_ids")).alias("relevant_chunk_ids"), "q.note", "version")


def query_lines(lines: DataFrame, column: str = "value", *keep: str) -> DataFrame:
    """Queries of a file, one a line, trimmed, beside the columns to keep; blank lines and lines that begin with # are left out."""
    return lines.select(*keep, X.strip(F.col(column)).alias("query")).where("query <> '' and not startswith(query, '#')")


def read_query_file(spark: SparkSession, path: str) -> DataFrame:
    out = query_lines(spark.read.text(path))
    if out.isEmpty():
        raise ValueError("the file has no queries")
    return out


def saved_evidence(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Items of a saved JSON list of at most 1 MiB and 100 items; item: the DDL of one."""
    files = spark.read.format("binaryFile").load(path)
    body = F.when(F.col("length") <= MAX_EVIDENCE_BYTES, F.decode("content", "UTF-8")).otherwise(F.raise_error(F.lit("saved evidence is too large")).cast("string"))
    value = F.from_json(body, f"array<struct<{item}>>", {"mode": "FAILFAST"})
    sized = F.when(F.size(value) <= MAX_EVIDENCE_ITEMS, value).otherwise(F.raise_error(F.lit("saved evidence has too many items")).cast(f"array<struct<{item}>>"))
    return files.select(F.explode(sized).alias("e")).select("e.*")


def upload_verdict(content: Column, length: Column, name: Column, content_type: Column, cap: int = MAX_UPLOAD) -> Column:
    """accepted, or why an upload is not: its type, name, size or signature."""
    kind = F.trim(F.lower(F.substring_index(content_type, ";", 1)))
    return F.when(kind != "application/pdf", "type").when(~X.is_safe_filename(name), "name").when((length > cap) | (length <= 0), "size").when(F.substring(content, 1, 5) != F.lit(PDF_SIGNATURE), "signature").otherwise("accepted")
