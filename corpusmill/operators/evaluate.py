"""Retrieval quality from rankings and relevant chunks. ranking: query_id, chunk_id, rank; gold: query_id, chunk_id (one row a relevant chunk)."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import retrieval

DEFAULT_KS = (1, 3, 5, 10)


def parse_ks(text: str) -> tuple[int, ...]:
    ks = sorted({int(k) for k in text.split(",")})
    if not ks or ks[0] < 1:
        raise ValueError("ks must be positive")
    return tuple(ks)


def containing(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, chunk_id for every chunk whose text contains the query's text. queries: query_id, query; index: chunk_id, text.

    A chunk that contains a query has its inner terms, all but the first and last, as terms of its own; so the longest inner term finds
    the candidates. Queries without an inner term are compared with all chunks, as they must be. Up to QUERY_BLOCK queries, whose number
    is looked up when this is called, go to all workers and the chunks stay where they are; more are joined by term, and texts then by id.
    """
    terms = X.terms(F.col("query"))
    inner = F.slice(terms, 2, F.greatest(F.size(terms) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda t: F.struct(F.length(t).alias("n"), t.alias("term"))))["term"]
    probes = queries.where("query is not null").select("query_id", "query", longest.alias("term"))
    few = retrieval.few(probes)
    sent = F.broadcast if few else lambda rows: rows
    # a generator of one array keeps the terms from being found again in each place that uses them
    lists = index.select("chunk_id", "text", F.explode(F.array(X.terms(F.col("text")))).alias("terms"))
    kept = F.explode(F.array_distinct(retrieval.among("terms", probes.select("term").where("term is not null")))).alias("term")
    texts = index.select("chunk_id", "text")
    if few:
        near = lists.select("chunk_id", "text", kept).join(sent(probes), "term").where(F.contains("text", "query"))
    else:
        found = lists.select("chunk_id", kept).join(probes.where("term is not null").select("term", "query_id"), "term").select("query_id", "chunk_id")
        near = found.join(probes.select("query_id", "query"), "query_id").join(texts, "chunk_id").where(F.contains("text", "query"))
    short = texts.join(sent(probes.where("term is null")), F.contains("text", "query"))
    return near.select("query_id", "chunk_id").union(short.select("query_id", "chunk_id"))


def _relevant(gold: DataFrame) -> DataFrame:
    return gold.select("query_id", "chunk_id").distinct()


def judged(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """ranking and hit, 1 where gold has the query and chunk of a row, else 0. An id that is null is in no gold set.

    Chunk ids are compared null-safe, so that no filter on gold's goes below the distinct rows: all uses of them share one pass over gold.
    """
    known = _relevant(gold).select(F.col("query_id").alias("__query"), F.col("chunk_id").alias("__chunk"))
    rows = ranking.join(known, (F.col("query_id") == F.col("__query")) & F.col("chunk_id").eqNullSafe(F.col("__chunk")), "left")
    return rows.withColumn("hit", F.when(F.col("__query").isNotNull() & F.col("chunk_id").isNotNull(), 1).otherwise(0)).drop("__query", "__chunk")


def at_k(queries: DataFrame, ranking: DataFrame, gold: DataFrame, ks: tuple[int, ...] = DEFAULT_KS, by: tuple[str, ...] = ()) -> DataFrame:
    """by, query_id, k, precision, recall. Precision divides by the hits returned within k; both are 0 without hits or relevant chunks.

    by: further columns of queries and ranking, such as the strategy of several runs.
    """
    own = [*by, "query_id"]
    sizes = _relevant(gold).groupBy("query_id").agg(F.count("*").alias("size"))
    depths = F.explode(F.array(*(F.lit(k) for k in sorted(set(ks))))).alias("k")
    hits = judged(ranking, gold).select(*own, "chunk_id", "rank", "hit", depths).where("rank <= k")
    sums = hits.groupBy(*own, "k").agg(F.count("*").alias("returned"), F.sum("hit").alias("hits"), F.count_distinct(F.when(F.col("hit") == 1, F.col("chunk_id"))).alias("found"))
    out = queries.select(*own).distinct().select(*own, depths).join(sums, [*own, "k"], "left").join(sizes, "query_id", "left")
    return out.select(*own, "k", F.coalesce(F.col("hits") / F.col("returned"), F.lit(0.0)).alias("precision"), F.coalesce(F.col("found") / F.col("size"), F.lit(0.0)).alias("recall"))


def reciprocal_ranks(queries: DataFrame, ranking: DataFrame, gold: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, query_id, reciprocal_rank of the first relevant hit, 0 without one."""
    own = [*by, "query_id"]
    first = judged(ranking, gold).where("hit = 1").groupBy(*own).agg(F.min("rank").alias("first"))
    return queries.select(*own).distinct().join(first, own, "left").select(*own, F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def summary(queries: DataFrame, ranking: DataFrame, gold: DataFrame, ks: tuple[int, ...] = DEFAULT_KS, by: tuple[str, ...] = ()) -> DataFrame:
    """by, k, mean_precision, mean_recall, mrr; means run over all queries."""
    rows = at_k(queries, ranking, gold, ks, by).join(reciprocal_ranks(queries, ranking, gold, by), [*by, "query_id"])
    return rows.groupBy(*by, "k").agg(F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.avg("reciprocal_rank").alias("mrr"))


def compared(queries: DataFrame, runs: dict[str, DataFrame], gold: DataFrame, ks: tuple[int, ...] = DEFAULT_KS) -> DataFrame:
    """summary() of several rankings by `strategy`, in one pass over queries and gold."""
    every = functools.reduce(DataFrame.unionByName, [hits.select(F.lit(name).alias("strategy"), "query_id", "chunk_id", "rank") for name, hits in runs.items()])
    asked = queries.select(F.explode(F.array(*map(F.lit, runs))).alias("strategy"), "query_id")
    return summary(asked, every, gold, ks, ("strategy",))


def report_lines(summary_rows: DataFrame) -> DataFrame:
    """The summary as lines of text, by k."""
    return summary_rows.select(F.format_string("k=%d precision=%.3f recall=%.3f mrr=%.3f", "k", "mean_precision", "mean_recall", "mrr").alias("line"))


def per_query(queries: DataFrame, ranking: DataFrame, gold: DataFrame, ks: tuple[int, ...] = DEFAULT_KS) -> DataFrame:
    """query_id, query, relevant and retrieved chunk ids, recall_at_k, precision_at_k (maps by k as text), mrr: a report's row for each query."""
    at = at_k(queries, ranking, gold, ks).groupBy("query_id").agg(*(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("k").cast("string"), m)))).alias(f"{m}_at_k") for m in ("recall", "precision")))
    relevant = gold.groupBy("query_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("relevant_chunk_ids"))
    got = ranking.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda h: h["chunk_id"]).alias("retrieved_chunk_ids"))  # top_k a query
    none = F.array().cast("array<string>")
    rows = queries.select("query_id", "query").join(relevant, "query_id", "left").join(got, "query_id", "left").join(at, "query_id").join(reciprocal_ranks(queries, ranking, gold), "query_id")
    return rows.select("query_id", "query", F.coalesce("relevant_chunk_ids", none).alias("relevant_chunk_ids"), F.coalesce("retrieved_chunk_ids", none).alias("retrieved_chunk_ids"), "recall_at_k", "precision_at_k", F.col("reciprocal_rank").alias("mrr"))


def report(queries: DataFrame, ranking: DataFrame, gold: DataFrame, version: str, settings: dict[str, str | int | float | bool | None], ks: tuple[int, ...] = DEFAULT_KS) -> dict:
    """A run's report: data version, number of queries, ks, settings that JSON can hold, means, and a row for each query of the gold set.

    A gold set is made by hand and a report is read by a person: its rows come to the driver.
    """
    rows = [r.asDict() for r in per_query(queries, ranking, gold, ks).orderBy("query_id").collect()]
    mean = lambda values: sum(values) / len(values) if values else 0.0
    by_k = {m: {str(k): mean([r[f"{m}_at_k"][str(k)] for r in rows]) for k in sorted(set(ks))} for m in ("recall", "precision")}
    plain = {k: v for k, v in settings.items() if v is None or isinstance(v, (str, int, float, bool))}
    return {"dataset_version": version, "num_queries": len(rows), "ks": sorted(set(ks)), "retrieval_settings": plain, "mean_recall": by_k["recall"], "mean_precision": by_k["precision"], "mean_mrr": mean([r["mrr"] for r in rows]), "reranked": bool(plain.get("rerank")), "per_query": rows}


def report_text(found: dict) -> str:
    """A report as text for people."""
    known = found["retrieval_settings"]
    say = lambda name: known.get(name, "not recorded")
    lines = [f"Gold set {found['dataset_version']}: {found['num_queries']} queries", f"Strategy {say('strategy')}, reranked {found['reranked']}, top {say('top_k')}"]
    lines += [f"Cross-encoder {say('model_name')}, {say('candidate_count')} candidates"] if found["reranked"] else []
    lines += ["", "    k  recall  precision", *(f"{k:5d}  {found['mean_recall'][str(k)]:6.3f}  {found['mean_precision'][str(k)]:9.3f}" for k in found["ks"]), f"  MRR  {found['mean_mrr']:6.3f}", ""]
    for q in found["per_query"]:
        lines.append(f"{q['query']!r}: {len(q['retrieved_chunk_ids'])} hits, MRR {q['mrr']:.3f}, " + ", ".join(f"R@{k} {q['recall_at_k'][str(k)]:.2f}" for k in found["ks"]))
    return "\n".join(lines)


def gold_version(content: DataFrame, column: str = "content", *keep: str) -> DataFrame:
    """version, the first twelve digits of the SHA-256 of the gold file, beside the columns to keep."""
    return content.select(*keep, F.substring(F.sha2(column, 256), 1, 12).alias("version"))
