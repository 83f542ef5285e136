"""The thin queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.shared import documents, new_path


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.ngram_join import ngram_classes

    return ngram_classes(documents(spark, sf_dir)).select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.secrets import scan_secrets

    return scan_secrets(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.bpe import encode_decode

    rows = encode_decode(documents(spark, sf_dir))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.toxicity import score_toxicity

    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.mixing import mix

    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "slots", "first_slot", "second_slot")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.token_store import stored_offsets, write_store

    where = new_path(spark, "tokens")
    write_store(documents(spark, sf_dir), where)
    return stored_offsets(spark, where).withColumnRenamed("key", "doc_id")


def op8_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.lm import score_documents

    return score_documents(documents(spark, sf_dir))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.embed_dedup import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.mpeg import media_round_trip

    rows = media_round_trip(documents(spark, sf_dir))
    tail = F.expr("crc32(substring(payload, greatest(length(payload) - 15, 1), 16))")
    return rows.select(F.col("key").alias("doc_id"), "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "n_frames", "duration_num", "duration_den", "offsets")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


#: Reachability over links by recursion; only for operators whose rows SQL can give.
OP1 = r"""WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
d AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, d.v FROM r JOIN d ON r.v = d.u)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY 1) c USING (doc_id)"""

OP9 = """WITH RECURSIVE g AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
n AS (SELECT u, count(*) AS n FROM d GROUP BY 1),
r AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, d.v FROM r JOIN d ON r.v = d.u),
c AS (SELECT u, min(v) AS component_id FROM r GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1, "op9_embedding_near_dedup": OP9}
