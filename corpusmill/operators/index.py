"""The vector-and-payload index as a table: payloads, differences, synchronisation, scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.schemas import PAYLOAD

FIELDS = [f.name for f in PAYLOAD]


def payloads(chunks: DataFrame, source_file: Column, model: str) -> DataFrame:
    """id and the twelve payload columns of each chunk."""
    given = {"source_file": X.source_file(source_file), "embedding_model": F.lit(model)}
    return chunks.select(X.point_id(F.col("chunk_id")).alias("id"), *(given.get(f, F.col(f)).cast(PAYLOAD[f].dataType).alias(f) for f in FIELDS))


def differs(a: str, b: str, fields: list[str] = FIELDS) -> Column:
    """Whether two payloads differ; null, missing and empty are one value."""
    out = F.lit(False)
    for f in fields:
        x, y = (F.nullif(F.col(f"{side}.{f}").cast("string"), F.lit("")) for side in (a, b))
        out = out | ~x.eqNullSafe(y)
    return out


def sync_actions(target: DataFrame, stored: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """id, doc_id, action for every id of either side: upsert, delete, patch (payload differs; no embedding) or keep. One full outer join.

    Both hold id, doc_id and the payload fields. Repeated target ids count once.
    """
    t = target.dropDuplicates(["id"]).select("id", F.struct("doc_id", *fields).alias("t"))
    s = stored.select("id", F.struct("doc_id", *fields).alias("s"))
    action = F.when(F.col("s").isNull(), "upsert").when(F.col("t").isNull(), "delete").when(differs("t", "s", fields), "patch").otherwise("keep")
    return t.join(s, "id", "full").select("id", F.coalesce("t.doc_id", "s.doc_id").alias("doc_id"), action.alias("action"))


def sync_counts(target: DataFrame, stored: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """upserted, deleted, skipped, payload_updated. upserted counts rows of the target, repeated ones included; skipped includes patched ones."""
    # one row an id: how often the target has it, and whether the first of these differs from what is stored
    t = target.groupBy("id").agg(F.first(F.struct("doc_id", *fields)).alias("t"), F.count("*").alias("n"))
    met = t.join(stored.select("id", F.struct("doc_id", *fields).alias("s")), "id", "full")
    is_new, is_gone, n = F.col("s").isNull(), F.col("t").isNull(), F.coalesce("n", F.lit(0))
    changed = ~is_new & ~is_gone & differs("t", "s", fields)
    return met.agg(F.coalesce(F.sum(F.when(is_new, n)), F.lit(0)).alias("upserted"), F.count_if(is_gone).alias("deleted"), F.coalesce(F.sum(F.when(~is_new, n)), F.lit(0)).alias("skipped"), F.count_if(changed).alias("payload_updated"))


def synchronise(target: DataFrame, stored: DataFrame, embed, fields: list[str] = FIELDS) -> DataFrame:
    """The next state of the index: stored vectors with the target's payloads, and new points, which alone are embedded.

    stored: id, doc_id, the fields and vector; embed: a function from the text column to a vector column.
    """
    unique = target.dropDuplicates(["id"])
    old = unique.join(stored.select("id", "vector"), "id")
    new = unique.join(stored.select("id"), "id", "left_anti").withColumn("vector", embed(F.col("text")).cast("array<float>"))
    return old.unionByName(new)


def write_index(points: DataFrame, path: str, dimension: int, model: str) -> None:
    """Write the index as Parquet by document, sorted by chunk type; refuses vectors of another length."""
    checked = points.withColumn("vector", F.when(F.size("vector") == dimension, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector's length is not {dimension}")).cast("array<float>")))
    # a document of many chunks goes to several files
    checked.repartitionByRange("doc_id", F.xxhash64("id")).sortWithinPartitions("doc_id", "chunk_type").write.mode("overwrite").option("parquet.bloom.filter.enabled#doc_id", "true").parquet(f"{path}/points")
    points.sparkSession.createDataFrame([(dimension, model)], "dimension int, model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def open_index(spark: SparkSession, path: str, dimension: int | None = None, model: str | None = None) -> DataFrame:
    """The index's points; a ValueError where its dimension or model is another."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if dimension is not None and meta["dimension"] != dimension:
        raise ValueError(f"the index has dimension {meta['dimension']}, not {dimension}")
    if model is not None and meta["model"] != model:
        raise ValueError(f"the index was made by {meta['model']}, not {model}")
    return spark.read.parquet(f"{path}/points")


def scan_ids(points: DataFrame, doc_id: str | None = None) -> DataFrame:
    return (points if doc_id is None else points.where(F.col("doc_id") == doc_id)).select("id")


def scan_payloads(points: DataFrame, doc_id: str | None = None) -> DataFrame:
    """Payloads of points with a chunk id; the vectors are not read."""
    return (points if doc_id is None else points.where(F.col("doc_id") == doc_id)).where("chunk_id is not null and chunk_id <> ''").select(*FIELDS)


def delete_document(points: DataFrame, doc_id: str) -> DataFrame:
    return points.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id)))


def erase_document(spark: SparkSession, path: str, doc_id: str) -> int:
    """Delete a document from the index at `path`, confirm that none of its points is left, and return how many there were.

    The rest is written beside the index and takes its place by renaming; a failure before that leaves the index as it was.
    """
    points = spark.read.parquet(f"{path}/points")
    gone = scan_ids(points, doc_id).count()
    if gone:
        delete_document(points, doc_id).write.mode("overwrite").option("parquet.bloom.filter.enabled#doc_id", "true").parquet(f"{path}/points.rest")
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        system = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for a, b in (("points", "points.old"), ("points.rest", "points")):
            if not system.rename(place(f"{path}/{a}"), place(f"{path}/{b}")):
                raise RuntimeError(f"{a} cannot be renamed")
        system.delete(place(f"{path}/points.old"), True)
    if scan_ids(spark.read.parquet(f"{path}/points"), doc_id).count():
        raise RuntimeError("the deletion is not confirmed")
    return gone


def inventory(managed: DataFrame, points: DataFrame) -> DataFrame:
    """doc_id, filename, status, chunk_count: managed documents that are not deleted, and those that only the index knows, as external."""
    known = managed.where("status <> 'deleted'").select("doc_id", "filename", "status", "chunk_count")
    outside = points.join(managed.select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.min("source_file").alias("filename"), F.count("*").alias("chunk_count"))
    return known.unionByName(outside.select("doc_id", "filename", F.lit("external").alias("status"), "chunk_count"))
