"""The engine's queries over the supplied tables, by name. Each takes a session and a data folder and returns a DataFrame.

plans.oracles holds the SQL that gives the same rows where SQL can.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import chunking, embed, evaluate, evidence, headings, index, layout, reports, retrieval, service
from corpusmill.sources import files
from corpusmill.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the role of chunks: a document is a page and a chunk of its own."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    return d.select(key.alias("chunk_id"), F.col("source").alias("doc_id"), "text", F.lit("text").alias("chunk_type"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.col("lang").alias("section_heading"), F.lit(None).cast("string").alias("subheading"), F.concat("source", F.lit(".pdf")).alias("source_file"), X.token_count(F.col("text")).alias("token_count"), F.lit(1.0).alias("text_quality"), "lang", F.col("doc_id").alias("n"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"), embed.hash_embedding(F.col("text")).alias("vector"))


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).withColumn("vector", embed.hash_embedding(F.col("text")))


def rounded(hits: DataFrame, *more: str) -> DataFrame:
    return hits.select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"), *more)


# --- retrieval -------------------------------------------------------------


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.bm25(asked(spark, d), corpus(spark, d)))


@query
def bm25_filtered_lang(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.bm25(asked(spark, d), corpus(spark, d), lang="de"))


@query
def bm25_min_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.bm25(asked(spark, d), corpus(spark, d), top_k=20, min_score=25.0))


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(queries, points): every row whose id is divisible by 20 against all rows."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("label"), "vec_id")
    return v.where("vec_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector"), v.drop("vec_id")


@query
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.dense(*vectors(spark, d)))


@query
def dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.dense(*vectors(spark, d), label="3"))


@query
def dense_min_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.dense(*vectors(spark, d), top_k=50, min_score=0.3))


@query
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(embed.hash_embedding(F.col("text"))).alias("pos", "value"))
    return rows.select("doc_id", "pos", F.round("value", 9).alias("value"))


@query
def dense_hash_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.dense(asked(spark, d), hashed(spark, d)))


@query
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.hybrid(asked(spark, d), hashed(spark, d)))


@query
def hybrid_rrf_k10(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.hybrid(asked(spark, d), hashed(spark, d), top_k=10, k=10))


@query
def rerank_fake(spark: SparkSession, d: str) -> DataFrame:
    q, c = asked(spark, d), corpus(spark, d)
    return rounded(retrieval.rerank(retrieval.bm25(q, c, top_k=20), q, c, retrieval.RerankConfig()))


@query
def hit_records(spark: SparkSession, d: str) -> DataFrame:
    q = asked(spark, d)
    hits = retrieval.with_payload(retrieval.bm25(q, corpus(spark, d)), corpus(spark, d), "bm25", q)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "chunk_id", "doc_id", "source_file", "page_start", "page_end", "section_heading", "chunk_type", F.round("score", 6).alias("score"), "retriever", "citation", X.snippet(F.col("text")).alias("snippet"))


# --- evaluation ------------------------------------------------------------


def relevance(spark: SparkSession, d: str) -> DataFrame:
    """A document is relevant to a query if it contains the query's text."""
    return evaluate.containing(asked(spark, d), corpus(spark, d))


@query
def eval_at_k(spark: SparkSession, d: str) -> DataFrame:
    q = asked(spark, d)
    out = evaluate.at_k(q, retrieval.bm25(q, corpus(spark, d), top_k=10), relevance(spark, d))
    return out.select("query_id", F.col("k").cast("int").alias("k"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query
def eval_mrr(spark: SparkSession, d: str) -> DataFrame:
    q = asked(spark, d)
    return evaluate.reciprocal_ranks(q, retrieval.bm25(q, corpus(spark, d), top_k=10), relevance(spark, d)).select("query_id", F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query
def eval_by_strategy(spark: SparkSession, d: str) -> DataFrame:
    q, gold, c = asked(spark, d), relevance(spark, d), hashed(spark, d)
    runs = {"bm25": retrieval.bm25(q, c, top_k=10), "dense": retrieval.dense(q, c, top_k=10)}
    out = evaluate.compared(q, runs | {"hybrid": retrieval.fuse(runs["dense"], runs["bm25"], 10)}, gold)
    return out.select("strategy", "k", *(F.round(m, 6).alias(m) for m in ("mean_precision", "mean_recall", "mrr")))


@query
def gold_version(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.gold_version(table(spark, d, "benchmark"), "text", "item_id")


# --- text and pages --------------------------------------------------------


def damaged(text: Column) -> Column:
    """Text with extraction artefacts put in, by its length."""
    kind = F.length(text) % 4
    return F.when(kind == 0, F.concat(text, F.lit("(cid:12)(cid:7)"))).when(kind == 1, F.concat(F.lit("��"), text)).when(kind == 2, F.concat(text, F.lit("\x01\x02"))).otherwise(text)


@query
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.quality(damaged(F.col("text"))).alias("quality"))


@query
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    broken = F.concat(F.lit("  "), F.replace(F.col("text"), F.lit("th"), F.lit("t-\nh")), F.lit("­ \n"))
    return table(spark, d, "documents").select("doc_id", F.sha2(X.clean(broken), 256).alias("clean_sha256"))


@query
def frequency_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.frequency_key(F.concat(F.lit("  Page "), "url")).alias("key"))


def edge_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a page of its source's report, with a header, the text and a footer."""
    docs = table(spark, d, "documents")
    parts = F.array(
        F.struct(F.lit(10.0).alias("y0"), F.lit(20.0).alias("y1"), F.concat(F.lit("Report  on "), "source", F.lit(" 2024")).alias("text")),
        F.struct(F.lit(200.0).alias("y0"), F.lit(600.0).alias("y1"), F.col("text").alias("text")),
        F.struct(F.lit(770.0).alias("y0"), F.lit(780.0).alias("y1"), F.concat(F.lit("Page "), F.col("doc_id").cast("string"), F.lit(" of 99")).alias("text")),
    )
    rows = docs.select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page_number"), F.explode(parts).alias("b"))
    return rows.select("doc_id", "page_number", F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), F.lit(50.0).alias("x0"), "b.y0", F.lit(560.0).alias("x1"), "b.y1", "b.text", F.array(F.lit(10.0)).alias("font_sizes"), F.lit(False).alias("has_bold_span"))


@query
def repeated_edges(spark: SparkSession, d: str) -> DataFrame:
    return layout.repeated_edges(edge_blocks(spark, d))


@query
def edge_removed(spark: SparkSession, d: str) -> DataFrame:
    return layout.flag_edges(edge_blocks(spark, d)).groupBy("doc_id").agg(F.count_if("removed").alias("removed"), F.count_if(~F.col("removed")).alias("kept"))


@query
def page_assembly(spark: SparkSession, d: str) -> DataFrame:
    pages, _ = layout.assemble_pages(edge_blocks(spark, d))
    return pages.select("doc_id", "page_number", "char_count", "text_quality", F.sha2("text", 256).alias("text_sha256"))


@query
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    x0, y0 = (key * 37 % 400).cast("double"), (key * 91 % 700).cast("double")
    blocks = table(spark, d, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_size").alias("page_number"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), x0.alias("x0"), y0.alias("y0"), (x0 + key % 180 + 20).alias("x1"), (y0 + 20).alias("y1"), key.cast("string").alias("text"))
    return layout.reading_order(blocks).select("doc_id", "page_number", F.col("position").cast("int").alias("position"), "text")


@query
def detected_headings(spark: SparkSession, d: str) -> DataFrame:
    """First-level headings of web pages and their first list item, by type size."""
    pages = files.html_pages(table(spark, d, "pages"))
    lines = pages.select("doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("n", "text"), "headings")
    big = F.array_contains("headings", F.col("text"))
    blocks = lines.select("doc_id", "page_number", (F.col("n") + 1).alias("position"), "text", F.array(F.when(big, 18.0).otherwise(10.0)).alias("font_sizes"), F.lit(False).alias("has_bold_span"))
    return layout.detect_headings(blocks).select("doc_id", "page_number", "position", "heading")


def word_grid(spark: SparkSession, d: str) -> DataFrame:
    """All words of each document as rows of three cells."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    docs = table(spark, d, "documents").select("doc_id", words.alias("w")).where("size(w) > 0")
    grid = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / 3).cast("int") - 1), lambda k: F.slice("w", k * 3 + 1, 3))
    return docs.select("doc_id", grid.alias("grid"))


@query
def usable_tables(spark: SparkSession, d: str) -> DataFrame:
    return word_grid(spark, d).select("doc_id", layout.is_usable_table(F.col("grid")).alias("usable"))


@query
def markdown_tables(spark: SparkSession, d: str) -> DataFrame:
    return word_grid(spark, d).select("doc_id", F.sha2(layout.markdown(F.col("grid")), 256).alias("markdown_sha256"))


@query
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return files.html_pages(table(spark, d, "pages")).select("doc_id", "char_count", F.array_join("headings", " / ").alias("headings"), "text_quality")


@query
def page_quality(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    poor = F.concat("text", F.when(F.length("text") % 3 == 0, F.repeat(F.lit("�"), 40)).otherwise(""))
    return reports.page_quality(files.turn_pages(c.withColumn("text", poor)))


@query
def query_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return files.query_lines(lines, "value", "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("query")).alias("chars"))


@query
def doc_identity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.document_id(F.upper(F.sha2("text", 256))).alias("identity"))


@query
def source_names(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("C:\\raw/"), "lang", F.lit("\\"), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    name = X.source_file(path)
    return table(spark, d, "documents").select("doc_id", name.alias("name"), X.title(F.regexp_replace(name, r"\.pdf$", ""), F.lit("")).alias("title"), X.is_safe_filename(name).alias("safe"))


@query
def upload_gate(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    name = F.concat(F.when(n % 5 == 0, "a/").otherwise(""), "source", F.lit(".pdf"))
    content = F.concat(F.when(n % 3 == 0, F.lit("%PDF-1.7 ")).otherwise(""), "text").cast("binary")
    kind = F.when(n % 7 == 0, "text/plain").otherwise("Application/PDF; charset=binary")
    return table(spark, d, "documents").select("doc_id", files.upload_verdict(content, F.length(content), name, kind, 20_000).alias("verdict"))


# --- chunks ----------------------------------------------------------------


@query
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = X.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("n"), F.sha2(F.array_join(s, "|"), 256).alias("sentences_sha256"))


@query
def recursive_split(spark: SparkSession, d: str) -> DataFrame:
    s = X.recursive_split(F.regexp_replace("text", r"\n", "\n\n"), 100)
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("n"), F.sha2(F.array_join(s, "|"), 256).alias("parts_sha256"))


@query
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.token_count(F.col("text")).alias("tokens"))


def _chunks(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    return chunking.chunk_pages(files.plain_pages(table(spark, d, "documents")), strategy, 100, 10, 10)


def _listed(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", "chunk_index", "token_count", "chunk_id")


@query
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return _listed(_chunks(spark, d, "fixed_size"))


@query
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return _listed(_chunks(spark, d, "recursive"))


@query
def chunk_structure(spark: SparkSession, d: str) -> DataFrame:
    pages = files.html_pages(table(spark, d, "pages"))
    return chunking.chunk_pages(pages, "structure_aware", 100, 10, 10).select("doc_id", "chunk_index", "section_heading", "token_count", "chunk_id")


@query
def chunk_tables(spark: SparkSession, d: str) -> DataFrame:
    tables = word_grid(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_number"), F.lit("").alias("text"), F.array(layout.markdown(F.col("grid"))).alias("tables"), F.array().cast("array<string>").alias("headings"), F.lit(1.0).alias("text_quality"))
    return _listed(chunking.chunk_pages(tables, "fixed_size", 100, 10, 10))


@query
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    cid = X.chunk_id(F.col("conv_id").cast("string"), F.col("turn"), F.lit(1), F.lit(2), F.col("text"))
    return c.select("conv_id", "turn", cid.alias("chunk_id"), X.point_id(cid).alias("point_id"))


@query
def chunk_quality(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of two turns each, with the mean quality of the turns they cover."""
    pages = files.turn_pages(table(spark, d, "conversations").withColumn("text", damaged(F.col("text"))))
    chunks = pages.select(F.concat_ws("-", "doc_id", F.col("page_number").cast("string")).alias("chunk_id"), "doc_id", F.col("page_number").alias("page_start"), (F.col("page_number") + 1).alias("page_end"), F.lit(1.0).alias("text_quality"))
    return chunking.with_page_quality(chunks, pages).select("chunk_id", F.round("text_quality", 6).alias("text_quality"))


@query
def mid_sentence(spark: SparkSession, d: str) -> DataFrame:
    tail = F.concat("text", F.when(F.length("text") % 3 == 0, '" )').otherwise(""))
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(X.ends_mid_sentence(tail)).alias("n_mid"))


# --- headings --------------------------------------------------------------


def capitals(text: Column) -> Column:
    """a to z in capitals; other letters, of which engines differ in their capitals, as they are."""
    return F.translate(text, string.ascii_lowercase, string.ascii_uppercase)


def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of each document, some in forms that headings take."""
    n, head = F.col("doc_id") + F.col("n"), F.regexp_replace("line", r"\s+", " ")
    kinds = [F.concat(F.lit("Item "), (n % 16).cast("string"), F.lit("A. "), head), capitals(head), F.concat(F.lit("Years ended "), head), F.concat(F.lit("("), head, F.lit(")")), F.concat(head, F.lit(", Inc.")), F.concat(F.lit("2013 and 201"), (n % 10).cast("string")), F.element_at(F.array(*map(F.lit, X.MARKERS)), (n % 7 + 1).cast("int")), head]
    pick = kinds[-1]
    for k, form in enumerate(kinds[:-1]):
        pick = F.when(n % 8 == k, form).otherwise(pick)
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select("doc_id", "n", pick.alias("h"))


@query
def heading_flags(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("h")
    return heading_lines(spark, d).select("doc_id", "n", X.is_table_label(h).alias("label"), X.is_company(h).alias("company"), X.is_item(h).alias("item"), X.is_marker(h).alias("marker"), X.is_section(h).alias("section"), X.is_valid_heading(h).alias("valid"), X.is_subheading(h).alias("sub"), X.is_line_heading(h).alias("line"))


@query
def heading_offsets(spark: SparkSession, d: str) -> DataFrame:
    h = F.concat(F.substring("text", 21, 25), F.when(F.col("doc_id") % 4 == 0, "\x7f").otherwise(""))
    return table(spark, d, "documents").select("doc_id", X.heading_offset(h, F.col("text")).alias("off"))


def turn_marks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, headings): turns of one role name the sections of the turns after them."""
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").cast("int").alias("page"), "role", "text")
    heads = c.where("role = 'user'").select("doc_id", "page", F.length("text").alias("off"), F.col("text").alias("heading"), F.lit(True).alias("is_section"))
    chunks = c.select(F.concat_ws("-", "doc_id", F.col("page").cast("string")).alias("chunk_id"), "doc_id", "page", F.lit(0).alias("off"), F.lit(120).alias("stop"))
    return chunks, heads


@query
def heading_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    chunks, heads = turn_marks(spark, d)
    return headings.carry_forward(chunks, heads)


@query
def contained_heading(spark: SparkSession, d: str) -> DataFrame:
    chunks, heads = turn_marks(spark, d)
    return headings.contained(chunks, heads)


@query
def attached_headings(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of conversations, a page a turn, each page's heading being its first words in capitals."""
    pages = files.turn_pages(table(spark, d, "conversations"))
    head = capitals(F.substring("text", 1, 24))
    pages = pages.withColumn("headings", F.array(head)).withColumn("text", F.concat(head, F.lit(" "), "text"))
    out = headings.attach_headings(chunking.chunk_pages(pages, "recursive", 60, 6, 5), pages)
    return out.select("doc_id", "chunk_index", "chunk_id", "section_heading", "subheading")


# --- token statistics and reports -----------------------------------------


@query
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    out = embed.token_stats(corpus(spark, d), ["lang"])
    return out.select("lang", "n", "n_over", F.round("percent_over", 6).alias("percent_over"), "median", "p95", "p99", "least", "most")


@query
def chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d).withColumn("strategy", F.lit("document")).withColumn("chunk_type", F.when(F.col("n") % 9 == 0, "table").otherwise("text"))
    out = reports.chunk_summary(c)
    return out.select("strategy", "doc_id", "n", F.round("mean_tokens", 6).alias("mean_tokens"), "median_tokens", "p95_tokens", F.round("mid_share", 6).alias("mid_share"), "n_tables")


def turn_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").cast("string").alias("doc_id"), "text", F.when(F.col("turn") % 3 == 0, "table").otherwise("text").alias("chunk_type"), F.col("turn").cast("int").alias("page_start"), F.col("turn").cast("int").alias("page_end"), F.when(F.length("text") % 4 == 0, None).otherwise(F.col("role")).alias("section_heading"), X.token_count(F.col("text")).alias("token_count"), F.col("turn").cast("int").alias("chunk_index"))


@query
def model_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Terms as model tokens against the estimate, by language and source."""
    rows = corpus(spark, d).withColumn("model_tokens", F.size(X.terms(F.col("text"))))
    out = reports.model_token_summary(rows, ["lang", "doc_id"], 400)
    return out.select("lang", "doc_id", "n", "n_over", F.round("percent_over", 6).alias("percent_over"), "median_model_tokens", "p95", "p99", "most", "median_tokens", F.round("median_ratio", 6).alias("median_ratio"))


@query
def index_run_totals(spark: SparkSession, d: str) -> DataFrame:
    actions = index.sync_actions(*index_sides(spark, d), SIDE_FIELDS)
    per_doc = actions.groupBy("doc_id").agg(*(F.count_if(F.col("action") == a).alias(n) for a, n in (("upsert", "upserted"), ("delete", "deleted"), ("patch", "payload_updated"))), F.count_if(F.col("action").isin("patch", "keep")).alias("skipped"))
    return reports.index_run_totals(per_doc)


@query
def document_states(spark: SparkSession, d: str) -> DataFrame:
    """Users' events in the role of document events."""
    names = ["accept", "start", "parsed", "indexed", "error", "delete", "erased", "interrupted"]
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.col("event_id").alias("seq"), F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 8 + 1).cast("int")).alias("event"))
    return service.document_states(e)


@query
def heading_coverage(spark: SparkSession, d: str) -> DataFrame:
    return reports.heading_coverage(turn_chunks(spark, d))


@query
def top_headings(spark: SparkSession, d: str) -> DataFrame:
    return reports.top_headings(turn_chunks(spark, d)).withColumn("place", F.col("place").cast("int"))


@query
def example_chunks(spark: SparkSession, d: str) -> DataFrame:
    return reports.example_chunks(turn_chunks(spark, d), 30)


@query
def ingestion_totals(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    page = F.struct(F.when(F.length("text") % 5 == 0, F.array(F.lit("| a |"))).otherwise(F.array().cast("array<string>")).alias("tables"), X.quality(damaged(F.col("text"))).alias("text_quality"))
    records = c.groupBy("conv_id").agg(F.collect_list(page).alias("pages"), F.collect_list(F.when(F.length("text") % 2 == 0, F.lit("low"))).alias("warnings"))
    status = F.when(F.col("conv_id") % 3 == 0, "skipped").when(F.col("conv_id") % 7 == 0, "failed").otherwise("processed")
    return reports.ingestion_totals(records.withColumn("status", status))


# --- index -----------------------------------------------------------------


def index_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(target, stored): all documents; and, as stored before, the labelled ones, those of poor quality without a file name, with all turns of conversations."""
    fields = ("id", "doc_id", "source_file", "section_heading")
    key = F.col("doc_id").cast("string")
    target = table(spark, d, "documents").select(F.concat(F.lit("d"), key).alias("id"), F.col("source").alias("doc_id"), F.concat("source", F.lit(".pdf")).alias("source_file"), F.col("lang").alias("section_heading"))
    labels = table(spark, d, "labels").select(F.concat(F.lit("d"), key).alias("id"), "quality")
    old = target.join(labels, "id").withColumn("source_file", F.when(F.col("quality") == 1, F.col("source_file")).otherwise("")).select(*fields)
    gone = table(spark, d, "conversations").select(F.concat(F.lit("c"), F.concat_ws("-", "conv_id", "turn")).alias("id"), F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("doc_id"), F.lit(None).cast("string").alias("source_file"), F.lit("").alias("section_heading"))
    return target, old.unionByName(gone)


SIDE_FIELDS = ["source_file", "section_heading"]


@query
def sync_actions(spark: SparkSession, d: str) -> DataFrame:
    return index.sync_actions(*index_sides(spark, d), SIDE_FIELDS)


@query
def sync_counts(spark: SparkSession, d: str) -> DataFrame:
    return index.sync_counts(*index_sides(spark, d), SIDE_FIELDS)


@query
def synced_index(spark: SparkSession, d: str) -> DataFrame:
    target, stored = index_sides(spark, d)
    target = target.withColumn("text", F.col("id"))
    stored = stored.withColumn("vector", embed.hash_embedding(F.lit("old")).cast("array<float>"))
    out = index.synchronise(target, stored, embed.hash_embedding)
    return out.select("id", "doc_id", "source_file", F.round(F.element_at("vector", 1).cast("double"), 4).alias("v1"))


@query
def inventory(spark: SparkSession, d: str) -> DataFrame:
    _, stored = index_sides(spark, d)
    managed = table(spark, d, "documents").groupBy(F.col("source").alias("doc_id")).agg(F.count("*").alias("chunk_count")).select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("filename"), F.when(F.col("chunk_count") % 5 == 0, "deleted").otherwise("ready").alias("status"), "chunk_count")
    return index.inventory(managed, stored)


@query
def ingest_skip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("file_hash"))
    stored = docs.join(table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("path")), "path", "left_semi").select("file_hash")
    return files.ingest_status(docs, stored)


@query
def index_scan(spark: SparkSession, d: str) -> DataFrame:
    """Points and payloads of each document of the stored side: ids by one scan, payloads by another."""
    _, stored = index_sides(spark, d)
    points = stored.withColumn("chunk_id", F.col("id")).withColumns({f: F.lit(None).cast("string") for f in index.FIELDS if f not in (*stored.columns, "chunk_id")})
    named = index.scan_payloads(points).groupBy("doc_id").agg(F.count_if(F.col("source_file") != "").alias("named"))
    return points.join(index.scan_ids(points), "id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("points")).join(named, "doc_id")


# --- evidence --------------------------------------------------------------


def turn_hits(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    name = F.when(F.length("text") % 11 == 0, F.concat(F.lit("dir/"), "role")).otherwise(F.concat("role", F.lit(".pdf")))
    return c.select(F.col("conv_id").cast("string").alias("query_id"), F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("role").alias("doc_id"), name.alias("source_file"), F.col("turn").cast("int").alias("page_start"), (F.col("turn") + F.length("text") % 3 - 1).cast("int").alias("page_end"), F.when(F.length("text") % 5 == 0, "Notes [1]").otherwise("Notes").alias("section_heading"), "text", F.col("turn").cast("int").alias("rank"))


@query
def evidence_valid(spark: SparkSession, d: str) -> DataFrame:
    return evidence.problem(turn_hits(spark, d)).select("query_id", "chunk_id", "problem")


@query
def evidence_labels(spark: SparkSession, d: str) -> DataFrame:
    h = turn_hits(spark, d)
    return evidence.labelled(h.union(h)).select("query_id", "chunk_id", "evidence_id")


@query
def evidence_budget(spark: SparkSession, d: str) -> DataFrame:
    return evidence.budget(evidence.labelled(turn_hits(spark, d)))


def stub_replies(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic stand-in for a model: quotes a part of the first evidence, sometimes altered or twice."""
    first = evidence.labelled(turn_hits(spark, d)).where("evidence_id = 'E1'")
    quote = F.substring("text", 3, 20)
    kind = F.length("text") % 5
    pick = F.struct("evidence_id", F.when(kind == 1, F.concat(quote, F.lit("#"))).otherwise(quote).alias("quote"))
    picks = F.when(kind == 2, F.array(pick, pick)).when(kind == 3, F.array().cast("array<struct<evidence_id: string, quote: string>>")).otherwise(F.array(pick))
    status = F.when(kind == 3, "insufficient_evidence").otherwise("answered")
    return first.select("query_id", status.alias("status"), picks.alias("selections"), F.lit(True).alias("valid"))


@query
def quote_validation(spark: SparkSession, d: str) -> DataFrame:
    return evidence.checked_selections(stub_replies(spark, d), evidence.labelled(turn_hits(spark, d)))


@query
def answers(spark: SparkSession, d: str) -> DataFrame:
    return evidence.rendered(stub_replies(spark, d), evidence.labelled(turn_hits(spark, d)))


@query
def reply_parse(spark: SparkSession, d: str) -> DataFrame:
    """Replies as JSON, some with a key that is not asked for or cut short."""
    r = stub_replies(spark, d)
    body = F.to_json(F.struct("status", "selections"))
    kind = F.col("query_id").cast("long") % 3
    broken = F.when(kind == 1, F.concat(F.lit('{"extra": 1, '), F.expr("substring(b, 2)"))).when(kind == 2, F.expr("substring(b, 1, length(b) - 2)")).otherwise(body)
    out = evidence.parsed(r.withColumn("b", body).select("query_id", broken.alias("reply")))
    return out.select("query_id", F.when(F.col("valid"), F.col("status")).alias("status"), "valid")


# --- control plane that is data processing ---------------------------------


@query
def latest_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The sixteen latest events of each user."""
    e = service.latest(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", 16, "ts", "event_id")
    return e.select("user_id", "event_id", F.col("place").cast("int").alias("place"))


@query
def login_limiter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return incremental.limit_attempts(e, 3, 86_400)


@query
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return incremental.windowed_counts(table(spark, d, "events"), "1 day").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
