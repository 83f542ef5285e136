"""Embedders and token statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


class Embedder(Protocol):
    """What a plug-in model offers. `load` runs once a worker and returns a function from texts to vectors."""

    dimension: int
    model_name: str

    def load(self) -> Callable[[list[str], bool], list[list[float]]]: ...


def embedding_udf(embedder: Embedder, is_query: bool = False, batch: int = 32, instruction: str = "", normalise: bool = True):
    """An Arrow function for a plug-in embedder: `batch` texts at a time, queries after the instruction, vectors of length one.

    Another number of vectors than texts, a vector of another dimension than the embedder's or with a number that is not finite is an error.
    """

    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder.load()
        for texts in batches:
            values, out = [instruction * is_query + t for t in texts.fillna("")], []
            for k in range(0, len(values), batch):
                part = values[k : k + batch]
                vectors = np.array([list(v) for v in model(part, is_query)], np.float64)
                if vectors.shape != (len(part), embedder.dimension) or not np.isfinite(vectors).all():
                    raise ValueError(f"the embedder gave no {len(part)} finite vectors of dimension {embedder.dimension}")
                if normalise:
                    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                    vectors = vectors / np.where(norms > 0, norms, 1)
                out += vectors.tolist()
            yield pd.Series(out)

    return run


def model_token_counts(load: Callable[[], Callable[[list[str]], list[int]]], batch: int = 256):
    """An Arrow function that counts a plug-in tokenizer's tokens of each text, 0 for null. `load` runs once a worker, when the first texts come."""

    @pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = None
        for texts in batches:
            count = count or load()
            values = [t for t in texts if t is not None]
            found = [n for k in range(0, len(values), batch) for n in count(values[k : k + batch])]
            if len(found) != len(values):
                raise ValueError(f"the tokenizer gave {len(found)} counts for {len(values)} texts")
            each = iter(found)
            yield pd.Series([0 if t is None else next(each) for t in texts], dtype="int32")

    return run


def hash_embedding(text: Column, dimension: int = 32) -> Column:
    """Deterministic built-in embedding: the bytes of the text's SHA-256 over 255, repeated to the dimension."""
    # the lambda's variable holds the digest, which would else be found again for each component
    digests = F.array(F.sha2(text, 256))
    return F.transform(digests, lambda d: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda k: F.conv(F.substring(d, (k % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255))[0]


def token_stats(rows: DataFrame, keys: list[str], tokens: str = "token_count", limit: int = 512) -> DataFrame:
    """Per key: count, rows over the limit and their per cent, upper median, nearest-rank 95th and 99th, least and most.

    Ranks come from counts of distinct values, so no group is held as a list.
    """
    by_value = rows.groupBy(*keys, F.col(tokens).alias("v")).agg(F.count("*").alias("n"))
    over = f"over (partition by {', '.join(keys)}" if keys else "over (partition by 1"
    ranked = by_value.withColumn("upto", F.expr(f"sum(n) {over} order by v)")).withColumn("total", F.expr(f"sum(n) {over})"))

    def at(q: float) -> Column:  # the least value with more than int(total * q) rows at or below it
        return F.min(F.when(F.col("upto") > F.least(F.floor(F.col("total") * q), F.col("total") - 1), F.col("v")))

    median = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("v")))
    more = F.coalesce(F.sum(F.when(F.col("v") > limit, F.col("n"))), F.lit(0))
    return ranked.groupBy(*keys).agg(F.sum("n").alias("n"), more.alias("n_over"), (100 * more / F.sum("n")).alias("percent_over"), median.alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.min("v").alias("least"), F.max("v").alias("most"))
