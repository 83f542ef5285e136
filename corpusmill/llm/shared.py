"""Shared storage and small session helpers for the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a batch of rows between the JVM and Python, where the session has Spark's own default.
BATCH, _BATCH_KEY = "2m", "spark.sql.execution.arrow.maxBytesPerBatch"

#: A key with more than one in HOT of a table's rows is hot; so a table has fewer than HOT of them.
HOT = 256


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see: spark.checkpoint.dir of the session, or the context's own.

    Where neither is set, a temporary folder is made and registered in local mode, and any other master is an error: its executors
    would not see the folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = known.get() if known.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corpusmill-")
        spark.sparkContext.setCheckpointDir(path)
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = known.get()
    return path.rstrip("/")


def bounded(docs: DataFrame) -> DataFrame:
    """docs, once its session has a bound on the bytes of Arrow batches, so that memory does not follow the length of texts.

    Spark's default is 64 MiB, and its bound of 10,000 rows is none for long texts. A value the user has set stays.
    """
    spark = docs.sparkSession
    if not spark.sparkContext.getConf().contains(_BATCH_KEY) and spark.conf.get(_BATCH_KEY) == "67108864b":
        spark.conf.set(_BATCH_KEY, BATCH)
    return docs


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/corpusmill/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete all tables that operators of this application wrote to the shared folder; results not yet stored elsewhere go with them."""
    _delete(spark, _own_folder(spark))


def materialize(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder, in a folder for each value of the columns `parts`, and read it back, which cuts its
    lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*parts).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corpusmill_path = path
    return out


def discard(df: DataFrame, part: str = "") -> None:
    """Delete the files of a table made by materialize(), or those of a part (column=value), once nothing will read them again."""
    path = getattr(df, "_corpusmill_path", None)
    if path:
        _delete(df.sparkSession, f"{path}/{part}" if part else path)


def hot_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """big joined with small, which has one row a key, on an integer column that in big may hold few values in most rows.

    Rows of hot keys, fewer than HOT at any size, meet their rows of small in a broadcast and stay where they are; the others shuffle.
    big is read three times.
    """
    total = big.count()
    counts = big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    keys = counts.where(F.col("n") * HOT > total).select(key).collect()
    if not keys:
        return big.join(small, key, how)
    hot = F.broadcast(big.sparkSession.createDataFrame([tuple(k) for k in keys], f"{key} long"))
    cold = big.join(hot, key, "left_anti").join(small, key, how)
    return cold.unionByName(big.join(hot, key, "left_semi").join(F.broadcast(small.join(hot, key, "left_semi")), key, how))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
