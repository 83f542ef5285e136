"""A training-data pipeline: documents in, token ids out. Every stage reads all rows that the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.bpe import encode_decode
from corpusmill.llm.mixing import mixed_documents
from corpusmill.llm.ngram_join import ngram_classes
from corpusmill.llm.secrets import redact_secrets
from corpusmill.llm.shared import documents, new_path
from corpusmill.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go. Null and empty texts are scored like others; nothing goes if no model can be fitted."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles, the document with the least id stays.

    Documents without words link with nothing and stay. Ids are taken to be unique: rows that repeat an id and its text all stay or all
    go. Rows without an id go if a document with an id is in their group, else they all stay.
    """
    classes = ngram_classes(docs, size=5, percent=80)
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("component"))).select(F.col("doc_id").alias("kept_id"), F.col("mark").alias("kept_mark")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept.kept_id) & (F.xxhash64(docs.text) == kept.kept_mark), "left_semi")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by its kind in brackets; n_chars follows the text. Null and empty texts and all rows stay."""
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand once for each pass of the mix that takes them, in the order of the mix; those beyond their source's target go.

    Null sources are a source, null texts have no words, repeated rows are documents of their own.
    """
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text decoded from them, for every row; null texts count as empty."""
    rows = encode_decode(docs)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("bpe", bpe),
]

#: Most stages are trained models or hashes that SQL has no words for; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each result written as Parquet in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
