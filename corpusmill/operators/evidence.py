"""Evidence-constrained answers: validate hits, label them, keep the budget, check quotes, render. Nothing a model says is trusted unless it is verbatim."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as X

MAX_CHUNKS, MAX_CHARS, MAX_REPLY = 12, 24_000, 131_072
STATUSES = ("answered", "insufficient_evidence", "conflicting_evidence")


def _blank(c: Column) -> Column:
    return F.coalesce(X.strip(c) == "", F.lit(True))


def problem(hits: DataFrame) -> DataFrame:
    """hits with `problem`: why one may not serve as evidence, null if it may."""
    ids = _blank(F.col("chunk_id")) | _blank(F.col("doc_id")) | _blank(F.col("source_file")) | _blank(F.col("text"))
    pages = F.coalesce((F.col("page_start") < 1) | (F.col("page_end") < F.col("page_start")), F.lit(True))
    why = F.when(ids, "blank field").when(F.col("source_file").rlike(r"[/\\\r\n\[\]]"), "file name").when(pages, "page range").when(F.coalesce(F.col("section_heading").rlike(r"[\r\n\[\]]"), F.lit(False)), "heading")
    return hits.withColumn("problem", why)


def labelled(hits: DataFrame) -> DataFrame:
    """Distinct hits of each query with evidence_id E1, E2, ... in rank order; conflicting rows of one chunk are an error."""
    fields = ["doc_id", "source_file", "page_start", "page_end", "text", "section_heading"]
    rows = hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.count_distinct(F.struct(*(F.coalesce(F.col(f).cast("string"), F.lit("\0")) for f in fields))).alias("kinds"), *(F.first(f).alias(f) for f in fields))
    checked = rows.withColumn("chunk_id", F.when(F.col("kinds") > 1, F.raise_error(F.lit("one chunk id has conflicting evidence")).cast("string")).otherwise(F.col("chunk_id")))
    label = F.concat(F.lit("E"), F.expr("row_number() over (partition by query_id order by rank, chunk_id)").cast("string"))
    return checked.withColumn("evidence_id", label).drop("kinds")


def json_text_length(c: Column) -> Column:
    """Length of a string as JSON with non-ASCII characters kept: quotes, and what escapes add."""
    short = F.length(c) - F.length(F.regexp_replace(c, r'["\\\n\r\t\x08\f]', ""))
    long = F.length(c) - F.length(F.regexp_replace(c, r"[\x00-\x07\x0B\x0E-\x1F]", ""))
    return F.length(c) + 2 + short + 5 * long


def budget(evidence: DataFrame) -> DataFrame:
    """query_id, n, chars, within: the size of the evidence as a JSON list with ', ' and ': ' separators, against the limits."""
    names = ("evidence_id", "doc_id", "source_file", "page_start", "page_end", "text")
    frame = 2 + sum(len(n) + 4 for n in names) + 2 * (len(names) - 1)
    body = json_text_length(F.col("evidence_id")) + json_text_length(F.col("doc_id")) + json_text_length(F.col("source_file")) + F.length(F.col("page_start").cast("string")) + F.length(F.col("page_end").cast("string")) + json_text_length(F.col("text"))
    sizes = evidence.groupBy("query_id").agg(F.count("*").alias("n"), (F.sum(body + frame) + 2 * (F.count("*") - 1) + 2).alias("chars"))
    return sizes.withColumn("within", (F.col("n") <= MAX_CHUNKS) & (F.col("chars") <= MAX_CHARS))


def parsed(replies: DataFrame) -> DataFrame:
    """replies (query_id, reply) with status and selections; `valid` is false for replies that are too long, malformed, or have other keys."""
    schema = "struct<status: string, selections: array<struct<evidence_id: string, quote: string>>>"
    value = F.from_json("reply", schema)
    raw = F.from_json("reply", "struct<selections: array<string>>")["selections"]
    keys = F.array_sort(F.json_object_keys("reply"))
    inner = F.forall(raw, lambda s: F.array_sort(F.json_object_keys(s)) == F.array(F.lit("evidence_id"), F.lit("quote")))
    sized = F.forall(value["selections"], lambda s: F.length(s["evidence_id"]).between(1, 20) & F.length(s["quote"]).between(1, 8000)) & (F.size(value["selections"]) <= MAX_CHUNKS)
    ok = (F.length("reply") <= MAX_REPLY) & (keys == F.array(F.lit("selections"), F.lit("status"))) & value["status"].isin(*STATUSES) & inner & sized
    return replies.select("query_id", value["status"].alias("status"), value["selections"].alias("selections"), F.coalesce(ok, F.lit(False)).alias("valid"))


def checked_selections(replies: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, status, valid: replies whose quotes are verbatim parts of the evidence they name.

    replies: query_id, status, selections, valid. Insufficient evidence means no selection; an answer means at least one, a conflict at
    least two pieces of evidence; none may repeat.
    """
    picks = replies.select("query_id", F.posexplode("selections").alias("pos", "s")).select("query_id", "pos", "s.evidence_id", "s.quote")
    known = evidence.select("query_id", "evidence_id", F.col("text").alias("source"))
    good = F.coalesce(F.contains("source", "quote") & (X.strip(F.col("quote")) != ""), F.lit(False))
    sums = picks.join(known, ["query_id", "evidence_id"], "left").withColumn("good", good).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_distinct("evidence_id", "quote").alias("n_pairs"), F.count_distinct("evidence_id").alias("n_ids"))
    rows = replies.join(sums, "query_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "n_good", "n_pairs", "n_ids")})
    fits = (F.col("n_good") == F.col("n")) & (F.col("n_pairs") == F.col("n"))
    ok = F.when(F.col("status") == "insufficient_evidence", F.col("n") == 0).when(F.col("status") == "answered", (F.col("n") > 0) & fits).when(F.col("status") == "conflicting_evidence", (F.col("n_ids") >= 2) & fits)
    return rows.select("query_id", "status", (F.col("valid") & F.coalesce(ok, F.lit(False))).alias("valid"))


INSUFFICIENT = "I don't have enough evidence in the retrieved documents to answer this question."


def rendered(replies: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, status, answer: quotes with their citations in the order selected."""
    picks = replies.select("query_id", "status", F.posexplode_outer("selections").alias("pos", "s")).select("query_id", "status", "pos", "s.evidence_id", "s.quote")
    cited = evidence.select("query_id", "evidence_id", X.citation(F.col("source_file"), F.col("page_start"), F.col("page_end"), F.col("section_heading")).alias("citation"))
    lines = picks.join(cited, ["query_id", "evidence_id"], "left").withColumn("line", F.concat(F.lit('"'), "quote", F.lit('" '), "citation"))
    # at most MAX_CHUNKS selections a query
    body = lines.groupBy("query_id", "status").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n\n").alias("body"))
    head = F.when(F.col("status") == "answered", "The retrieved documents state:").when(F.col("status") == "conflicting_evidence", "The retrieved evidence contains conflicting accounts; I cannot resolve them.")
    return body.select("query_id", "status", F.when(F.col("status") == "insufficient_evidence", INSUFFICIENT).otherwise(F.concat(head, F.lit("\n\n"), "body")).alias("answer"))


SYSTEM_PROMPT = "Answer only with verbatim quotes from the evidence, as JSON after the schema. If it does not suffice, say so."


def prompts(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, system, user: the messages for a provider."""
    records = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "doc_id", "source_file", "page_start", "page_end", "text"))).alias("evidence"))
    return queries.join(records, "query_id").select("query_id", F.lit(SYSTEM_PROMPT).alias("system"), F.to_json(F.struct(F.col("query").alias("question"), "evidence")).alias("user"))


def complete(messages: DataFrame, client: Callable[[], Callable[[str, str], str]]) -> DataFrame:
    """query_id, reply from a provider. client: made once a worker, a function from system and user messages to a reply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = client()
        for batch in batches:
            replies = [ask(s, u) for s, u in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(replies, pa.string())], names=["query_id", "reply"])

    return messages.select(F.col("query_id").cast("string").alias("query_id"), "system", "user").mapInArrow(run, "query_id string, reply string")
