"""Plain functions over the operators: retrieve by strategy, answer from evidence, document states."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import evidence, retrieval
from corpusmill.streaming.incremental import fold_in_order

MAX_QUESTION = 4000


@dataclass(frozen=True)
class Request:
    """How to retrieve. Bounds are those of a request from outside."""

    strategy: str = "hybrid"
    top_k: int = 5
    doc_id: str | None = None
    chunk_type: str | None = None
    min_score: float | None = None
    rerank: bool = False
    candidate_count: int = 20
    fusion_k: int = 60

    def __post_init__(self) -> None:
        retrieval.validate_top_k(self.top_k)
        if self.strategy not in RETRIEVERS:
            raise ValueError(f"unknown strategy {self.strategy!r}; known are {', '.join(RETRIEVERS)}")
        if self.rerank and self.top_k > self.candidate_count:
            raise ValueError("reranking needs top_k up to the number of candidates")

    def settings(self) -> dict[str, str | int | float | bool]:
        """What a report keeps of a run; values that are not set are left out."""
        return {k: v for k, v in asdict(self).items() if v is not None}


def _filters(r: Request) -> dict[str, str | None]:
    return {"doc_id": r.doc_id, "chunk_type": r.chunk_type}


RETRIEVERS: dict[str, Callable[[DataFrame, DataFrame, Request, int], DataFrame]] = {
    "dense": lambda q, index, r, k: retrieval.dense(q, index, k, r.min_score, **_filters(r)),
    "bm25": lambda q, index, r, k: retrieval.bm25(q, index, k, r.min_score, **_filters(r)),
    "hybrid": lambda q, index, r, k: retrieval.hybrid(q, index, k, r.fusion_k, r.min_score, **_filters(r)),
}


def valid_questions(queries: DataFrame) -> DataFrame:
    """queries, trimmed; a blank question or one of more than MAX_QUESTION characters is an error."""
    text = F.trim("query")
    bad = F.coalesce((text == "") | (F.length("query") > MAX_QUESTION), F.lit(True))
    return queries.withColumn("query", F.when(bad, F.raise_error(F.lit("a question must not be blank or too long")).cast("string")).otherwise(text))


def retrieve(queries: DataFrame, index: DataFrame, request: Request = Request("bm25"), scorer=retrieval.length_score) -> DataFrame:
    """Hits with payload and citation. queries: query_id, query, and vector for dense and hybrid; index: chunk payloads, and vector."""
    asked = valid_questions(queries)
    if request.rerank:
        found = RETRIEVERS[request.strategy](asked, index, request, request.candidate_count)
        hits = retrieval.rerank(found, asked, index, retrieval.RerankConfig(request.candidate_count, request.top_k), scorer)
        name = "reranked"
    else:
        hits, name = RETRIEVERS[request.strategy](asked, index, request, request.top_k), request.strategy
    return retrieval.with_payload(hits.select("query_id", "chunk_id", "score", "rank"), index, name, asked)


def answer(queries: DataFrame, hits: DataFrame, client: Callable[[], Callable[[str, str], str]]) -> DataFrame:
    """query_id, status, answer, reason for every query.

    The provider is asked only where there is evidence within the budget. Its reply counts only if it is well-formed and all its quotes are
    verbatim; else the status is invalid_response and there is no answer. Evidence that fails validation is an error. Replies are kept by
    checkpoint() where the session has a folder for it, so that the provider is asked once whatever executors are lost; the jobs run then.
    """
    checked = evidence.problem(hits)
    checked = checked.withColumn("text", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("evidence has an invalid "), "problem")).cast("string")).otherwise(F.col("text"))).drop("problem")
    known = evidence.labelled(checked)
    sizes = evidence.budget(known).select("query_id", "within")
    open_queries = queries.join(sizes.where("within"), "query_id").select("query_id", "query")
    messages = evidence.prompts(open_queries, known)
    replies = evidence.parsed(evidence.complete(messages, client))
    if queries.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        replies = replies.checkpoint()
    verdicts = evidence.checked_selections(replies, known).select("query_id", "valid")
    texts = evidence.rendered(replies.where("valid"), known).select("query_id", "answer")
    rows = queries.select("query_id").distinct().join(sizes, "query_id", "left").join(replies.select("query_id", "status"), "query_id", "left").join(verdicts, "query_id", "left").join(texts, "query_id", "left")
    reason = F.when(F.col("within").isNull(), "no_evidence").when(~F.col("within"), "evidence_budget_exceeded").when(~F.coalesce("valid", F.lit(False)), "invalid_response").when(F.col("status") == "insufficient_evidence", "model_abstained")
    rows = rows.withColumn("reason", reason)
    status = F.when(F.col("reason") == "invalid_response", "invalid_response").when(F.col("reason").isNotNull(), "insufficient_evidence").otherwise(F.col("status"))
    text = F.when(F.col("reason") == "invalid_response", F.lit(None).cast("string")).when(F.col("reason").isNotNull(), evidence.INSUFFICIENT).otherwise(F.col("answer"))
    return rows.select("query_id", status.alias("status"), text.alias("answer"), "reason")


# States of a managed document and the events that lead from one to another.
TRANSITIONS = {
    ("none", "accept"): "queued",
    ("failed", "accept"): "queued",
    ("deleted", "accept"): "queued",
    ("queued", "start"): "processing",
    ("processing", "parsed"): "indexing",
    ("indexing", "indexed"): "ready",
    ("processing", "error"): "failed",
    ("indexing", "compensated"): "failed",
    ("indexing", "uncertain"): "cleanup_required",
    ("cleanup_required", "compensated"): "failed",
    ("queued", "interrupted"): "failed",
    ("processing", "interrupted"): "failed",
    ("deleting", "erased"): "deleted",
}
BLOCKING = ("indexing", "cleanup_required", "deleting")


def next_state(state: str, event: str | None) -> str:
    """The state after an event; a delete leads from every state but deleted to deleting, and an event that does not apply changes nothing."""
    return "deleting" if event == "delete" and state != "deleted" else TRANSITIONS.get((state, event), state)


def document_states(events: DataFrame) -> DataFrame:
    """doc_id, status, readable: the state of each document after its events in order of `seq`. readable is false while cleaning up is due.

    Events stream through a task in order; only one state a document is held.
    """
    rows = events.select(F.col("doc_id").cast("string").alias("doc_id"), "seq", "event")
    states = fold_in_order(rows, "doc_id", ["seq", "event"], ["event"], "doc_id string, status string", lambda: "none", lambda state, row: (next_state(state, row[0]), None), lambda doc, state: (doc, state))
    return states.withColumn("readable", ~F.col("status").isin(*BLOCKING))


def latest(rows: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """The n latest rows of each key by the order columns, with `place` from 1; a window with a group limit."""
    by = ", ".join(f"{c} desc" for c in order)
    return rows.withColumn("place", F.expr(f"row_number() over (partition by {key} order by {by})")).where(F.col("place") <= n)
