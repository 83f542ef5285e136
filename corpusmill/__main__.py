"""Command line: index pages, search an index, evaluate a gold set, report on chunks.

    python -m corpusmill ingest FOLDER PAGES
    python -m corpusmill compare PAGES [--size 400] [--overlap 39]
    python -m corpusmill index PAGES INDEX [--strategy recursive] [--size 400] [--overlap 39]
    python -m corpusmill search INDEX QUERY... [--file QUERIES] [--strategy hybrid] [--top-k 5] [--rerank]
    python -m corpusmill evaluate INDEX GOLD [--ks 1,3,5,10] [--out REPORT.json] [--text REPORT.txt]
    python -m corpusmill report INDEX
    python -m corpusmill token-limits INDEX [--limit 512]
    python -m corpusmill smoke INDEX
    python -m corpusmill erase INDEX DOC_ID

PAGES is Parquet in the layout of schemas.PAGE with a source_file column; texts are embedded by hash, the built-in model.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import chunking, embed, evaluate, index, reports, retrieval, service
from corpusmill.sources import files

DIMENSION, MODEL = 32, "hash"


def build_index(spark: SparkSession, args: argparse.Namespace) -> int:
    pages = spark.read.parquet(args.pages)
    chunks, skipped = chunking.chunk_documents(pages, args.strategy, args.size, args.overlap)
    left_out = skipped.agg(F.coalesce(F.sum("skipped"), F.lit(0))).first()[0]
    names = pages.select(F.col("doc_id").alias("d"), "source_file").groupBy("d").agg(F.min("source_file").alias("path"))
    rows = index.payloads(chunks.join(names, chunks.doc_id == names.d), F.col("path"), MODEL)
    index.write_index(rows.withColumn("vector", embed.hash_embedding(F.col("text"), DIMENSION).cast("array<float>")), args.index, DIMENSION, MODEL)
    print(f"{index.open_index(spark, args.index).count()} points; {left_out} pages of poor quality left out")
    return 0


def run_ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    files_read = files.ingest(spark, args.folder, args.pages)
    totals = files_read.groupBy("status").agg(F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("pages", "tables", "warnings", "low_quality"))).orderBy("status").collect()
    for r in totals:
        print(", ".join(f"{v} {k}" if k != "status" else f"{v}:" for k, v in r.asDict().items()))
    for r in files_read.where("status = 'failed'").orderBy("path").limit(20).collect():
        print(f"failed: {r['path']}: {r['error']}", file=sys.stderr)
    return 1 if any(r["status"] == "failed" for r in totals) else 0


def compare_chunking(spark: SparkSession, args: argparse.Namespace) -> int:
    pages = spark.read.parquet(args.pages)
    rows = None
    for name in chunking.STRATEGIES:
        part = chunking.chunk_documents(pages, name, args.size, args.overlap)[0].withColumn("strategy", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    reports.chunk_summary(rows).where("doc_id is null").orderBy("strategy").show(10, False)
    reports.example_chunks(rows.where(F.col("strategy") == "structure_aware")).orderBy("doc_id").show(20, False)
    return 0


def token_limits(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = index.open_index(spark, args.index).withColumn("model_tokens", F.size(X.terms(F.col("text"))))
    reports.model_token_summary(rows, ["doc_id"], args.limit).orderBy("doc_id").show(50, False)
    return 0


def smoke(spark: SparkSession, args: argparse.Namespace) -> int:
    """The index opens, its points are whole, and a text of its own is found by itself."""
    points = index.open_index(spark, args.index, DIMENSION, MODEL)
    n, bad = points.agg(F.count("*"), F.count_if(F.coalesce(F.size("vector") != DIMENSION, F.lit(True)) | F.coalesce(F.col("chunk_id") == "", F.lit(True)))).first()
    some = points.where("text <> ''").orderBy("chunk_id").limit(1).select("chunk_id", F.lit("q").alias("query_id"), F.substring("text", 1, service.MAX_QUESTION).alias("query"), embed.hash_embedding(F.col("text"), DIMENSION).alias("vector"))
    found = retrieval.dense(some, points, 5).join(some.select("chunk_id"), "chunk_id").count() if n else 0
    print(f"{n} points, {bad} broken, a text finds itself: {bool(found)}")
    return 0 if n and not bad and found else 1


def erase(spark: SparkSession, args: argparse.Namespace) -> int:
    print(f"{index.erase_document(spark, args.index, args.doc_id)} points deleted")
    return 0


def _queries(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    texts = list(args.query)
    if args.file:
        texts += [r["query"] for r in files.read_query_file(spark, args.file).collect()]  # what a person typed
    if not texts:
        raise ValueError("no query given")
    rows = spark.createDataFrame([(f"{k:05d}", q) for k, q in enumerate(texts)], "query_id string, query string")
    return rows.withColumn("vector", embed.hash_embedding(F.trim("query"), DIMENSION))


def search(spark: SparkSession, args: argparse.Namespace) -> int:
    points = index.open_index(spark, args.index, DIMENSION, MODEL)
    request = service.Request(args.strategy, args.top_k, args.doc_id, args.chunk_type, args.min_score, args.rerank)
    queries = _queries(spark, args).persist()
    hits = service.retrieve(queries, points, request).orderBy("query_id", "rank").collect()  # at most 100 a query
    for q in queries.orderBy("query_id").collect():
        print(f"# {q['query']}")
        own = [h for h in hits if h["query_id"] == q["query_id"]]
        for h in own:
            text = h["text"].replace("\n", " ")[:120]
            print(f"{h['rank']:3d}  {h['score']:.6f}  {h['citation']}  {text}")
        if not own:
            print("no results")
    return 0 if {h["query_id"] for h in hits} >= {q["query_id"] for q in queries.collect()} else 1


def run_evaluation(spark: SparkSession, args: argparse.Namespace) -> int:
    points, ks = index.open_index(spark, args.index, DIMENSION, MODEL), evaluate.parse_ks(args.ks)
    gold = files.read_gold_set(spark, args.gold)
    queries = gold.select("query_id", "query").withColumn("vector", embed.hash_embedding(F.trim("query"), DIMENSION))
    request = service.Request(args.strategy, max(args.top_k, *ks))
    hits = service.retrieve(queries, points, request)
    relevant = gold.select("query_id", F.explode("relevant_chunk_ids").alias("chunk_id"))
    version = gold.agg(F.min("version")).first()[0] or ""
    found = evaluate.report(queries, hits, relevant, version, request.settings(), ks)
    if args.out:  # a person's own files
        Path(args.out).parent.mkdir(parents=True, exist_ok=True)
        Path(args.out).write_text(json.dumps(found, indent=2, ensure_ascii=False, sort_keys=True) + "\n", encoding="utf-8")
    if args.text:
        Path(args.text).parent.mkdir(parents=True, exist_ok=True)
        Path(args.text).write_text(evaluate.report_text(found) + "\n", encoding="utf-8")
    print(evaluate.report_text(found))
    return 0


def report(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = index.open_index(spark, args.index).withColumn("strategy", F.lit("stored"))
    reports.chunk_summary(rows).orderBy("strategy", F.col("doc_id").asc_nulls_first()).show(50, False)
    reports.heading_coverage(rows).orderBy("doc_id").show(50, False)
    reports.top_headings(rows).orderBy("doc_id", "place").show(50, False)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(required=True)
    a = sub.add_parser("index")
    a.add_argument("pages")
    a.add_argument("index")
    a.add_argument("--strategy", default="recursive", choices=chunking.STRATEGIES)
    a.add_argument("--size", type=int, default=400)
    a.add_argument("--overlap", type=int, default=39)
    a.set_defaults(run=build_index)
    a = sub.add_parser("ingest")
    a.add_argument("folder")
    a.add_argument("pages")
    a.set_defaults(run=run_ingest)
    a = sub.add_parser("compare")
    a.add_argument("pages")
    a.add_argument("--size", type=int, default=400)
    a.add_argument("--overlap", type=int, default=39)
    a.set_defaults(run=compare_chunking)
    a = sub.add_parser("token-limits")
    a.add_argument("index")
    a.add_argument("--limit", type=int, default=512)
    a.set_defaults(run=token_limits)
    a = sub.add_parser("smoke")
    a.add_argument("index")
    a.set_defaults(run=smoke)
    a = sub.add_parser("erase")
    a.add_argument("index")
    a.add_argument("doc_id")
    a.set_defaults(run=erase)
    for name, run in (("search", search), ("evaluate", run_evaluation), ("report", report)):
        a = sub.add_parser(name)
        a.add_argument("index")
        if name == "search":
            a.add_argument("query", nargs="*")
            a.add_argument("--file")
            a.add_argument("--doc-id")
            a.add_argument("--chunk-type", choices=("text", "table"))
            a.add_argument("--min-score", type=float)
            a.add_argument("--rerank", action="store_true")
        if name == "evaluate":
            a.add_argument("gold")
            a.add_argument("--ks", default="1,3,5,10")
            a.add_argument("--out")
            a.add_argument("--text")
        if name != "report":
            a.add_argument("--strategy", default="hybrid", choices=sorted(service.RETRIEVERS))
            a.add_argument("--top-k", type=int, default=5)
        a.set_defaults(run=run)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("corpusmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return args.run(spark, args)
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
