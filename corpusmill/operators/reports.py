"""Corpus reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators.embed import token_stats


def chunk_summary(chunks: DataFrame) -> DataFrame:
    """strategy, doc_id (null: all documents): chunks, mean, interpolated median and nearest-rank 95th percentile of tokens, shares of text chunks that end within a sentence, tables.

    One rollup; the percentiles come from counts of distinct values, so no group is held as a list.
    """
    rows = chunks.withColumn("mid", (F.col("chunk_type") == "text") & X.ends_mid_sentence(F.col("text"))).withColumn("is_text", F.col("chunk_type") == "text")
    base = rows.rollup("strategy", "doc_id").agg(F.grouping("strategy").alias("g"), F.grouping("doc_id").alias("all_docs"), F.count("*").alias("n"), F.avg("token_count").alias("mean_tokens"), F.expr("percentile(token_count, 0.5)").alias("median_tokens"), F.count_if("is_text").alias("n_text"), F.count_if("mid").alias("n_mid"), (F.count("*") - F.count_if("is_text")).alias("n_tables")).where("g = 0")
    counts = rows.groupBy("strategy", "doc_id", "token_count").agg(F.count("*").alias("c"))
    both = counts.select("strategy", "doc_id", F.lit(0).alias("all_docs"), "token_count", "c").unionByName(counts.groupBy("strategy", "token_count").agg(F.sum("c").alias("c")).select("strategy", F.lit(None).cast("string").alias("doc_id"), F.lit(1).alias("all_docs"), "token_count", "c"))
    over = "over (partition by strategy, doc_id, all_docs"
    p95 = both.withColumn("upto", F.expr(f"sum(c) {over} order by token_count)")).withColumn("total", F.expr(f"sum(c) {over})")).groupBy("strategy", "doc_id", "all_docs").agg(F.min(F.when(F.col("upto") > F.least(F.floor(F.col("total") * 0.95), F.col("total") - 1), F.col("token_count"))).alias("p95_tokens"))
    keys = [base[k].eqNullSafe(p95[k]) for k in ("strategy", "doc_id", "all_docs")]
    out = base.join(p95, keys[0] & keys[1] & keys[2])
    share = F.when(F.col("n_text") > 0, F.col("n_mid") / F.col("n_text")).otherwise(0.0)
    return out.select(base["strategy"], base["doc_id"], "n", "mean_tokens", "median_tokens", "p95_tokens", share.alias("mid_share"), F.when(F.col("n_text") > 0, 1 - share).otherwise(0.0).alias("complete_share"), "n_tables")


def heading_coverage(chunks: DataFrame) -> DataFrame:
    """doc_id, with_heading, without_heading."""
    has = F.coalesce(F.col("section_heading") != "", F.lit(False))
    return chunks.groupBy("doc_id").agg(F.count_if(has).alias("with_heading"), F.count_if(~has).alias("without_heading"))


def top_headings(chunks: DataFrame, top_k: int = 10) -> DataFrame:
    """doc_id, heading, n, first_page, last_page, place: the most frequent headings of each document, ties by first page, then heading."""
    rows = chunks.where("section_heading <> ''").groupBy("doc_id", F.col("section_heading").alias("heading")).agg(F.count("*").alias("n"), F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"))
    return rows.withColumn("place", F.expr("row_number() over (partition by doc_id order by n desc, first_page, heading)")).where(F.col("place") <= top_k)


def example_chunks(chunks: DataFrame, least: int = 200) -> DataFrame:
    """doc_id, chunk_type, chunk_id: the first text chunk of at least so many tokens, else the first text chunk; the first table."""
    order = F.struct(F.when((F.col("chunk_type") == "text") & (F.col("token_count") < least), 1).otherwise(0).alias("late"), "chunk_index")
    return chunks.groupBy("doc_id", "chunk_type").agg(F.min_by("chunk_id", order).alias("chunk_id"))


def page_quality(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.col("text_quality") < X.LOW_QUALITY).alias("low_quality"))


def model_token_summary(chunks: DataFrame, keys: list[str], limit: int = 512) -> DataFrame:
    """Per key, over text chunks: count, rows over the limit and per cent, interpolated median, nearest-rank 95th and 99th and most of
    model_tokens, median of token_count, and the median ratio of the two."""
    rows = chunks.where("chunk_type = 'text'")
    stats = token_stats(rows, keys, "model_tokens", limit).drop("median", "least")
    medians = rows.groupBy(*keys).agg(F.expr("percentile(model_tokens, 0.5)").alias("median_model_tokens"), F.expr("percentile(token_count, 0.5)").alias("median_tokens"), F.expr("percentile(case when token_count > 0 then model_tokens / token_count end, 0.5)").alias("median_ratio"))
    return stats.join(medians, keys)


def index_run_totals(runs: DataFrame) -> DataFrame:
    """Sums over the sync counts of a run's documents."""
    return runs.agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("upserted", "deleted", "skipped", "payload_updated")))


def ingestion_totals(records: DataFrame) -> DataFrame:
    """One row of totals. records: status, pages (array of page structs), warnings (array)."""
    done = F.col("status") == "processed"
    return records.agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in ("processed", "skipped", "failed")),
        F.coalesce(F.sum(F.when(done, F.size("pages"))), F.lit(0)).alias("pages"),
        F.coalesce(F.sum(F.when(done, F.aggregate("pages", F.lit(0), lambda a, p: a + F.size(p["tables"])))), F.lit(0)).alias("tables"),
        F.coalesce(F.sum(F.when(done, F.size("warnings"))), F.lit(0)).alias("warnings"),
        F.coalesce(F.sum(F.when(done, F.size(F.filter("pages", lambda p: p["text_quality"] < X.LOW_QUALITY)))), F.lit(0)).alias("low_quality"),
    )
