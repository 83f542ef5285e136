"""Batch retrieval: every retriever takes a table of queries and a table of chunks and returns ranked hits a query.

Scores are compared after rounding to nine digits, so that sums in another order do not change ranks; ties go by chunk id as text.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as X

K1, B = 1.2, 0.75
#: Query vectors compared at once; their table goes to every worker, and longer ones go in several rounds.
QUERY_BLOCK = 4096
#: Most distinct terms of queries by which the chunks' terms are filtered, and most cells that are scored at once in a task.
VOCABULARY, PIECE = 2**15, 2**20


def validate_top_k(top_k: int) -> int:
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= 100:
        raise ValueError("top_k must be an integer from 1 to 100")
    return top_k


def validate_query(query: str) -> str:
    if not isinstance(query, str) or not query.strip():
        raise ValueError("a query must be text that is not blank")
    return query.strip()


def filtered(index: DataFrame, **equal: str | None) -> DataFrame:
    """Rows whose columns equal the given values; None sets no filter."""
    for name, value in equal.items():
        if value is not None:
            index = index.where(F.col(name) == value)
    return index


def ranked(scores: DataFrame, top_k: int, *ties: Column) -> DataFrame:
    """query_id, chunk_id, score and rank of the best top_k of each query."""
    order = ", ".join(["round(score, 9) desc", *(f"__t{k}" for k in range(len(ties))), "cast(chunk_id as string)"])
    rows = scores.withColumns({f"__t{k}": t for k, t in enumerate(ties)}) if ties else scores
    rows = rows.withColumn("rank", F.expr(f"row_number() over (partition by query_id order by {order})")).where(F.col("rank") <= top_k)
    return rows.drop(*(f"__t{k}" for k in range(len(ties))))


class _Scorer:
    """BM25 of chunks that come in order of their ids, for the queries of one block; keeps what can be among each query's best."""

    def __init__(self, queries: pa.Table, top_k: int) -> None:
        lists, idf = queries.column("terms").combine_chunks(), queries.column("idf").combine_chunks().flatten().to_numpy()
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        self.vocabulary, self.top_k, self.mean = coded.dictionary, top_k, queries.column("mean")[0].as_py()
        self.query_ids, self.n = queries.column("id").combine_chunks(), len(lists)
        # the queries of a term stand side by side; a term's idf is the same in all of them
        self.query = np.repeat(np.arange(self.n), pc.list_value_length(lists).to_numpy())[order]
        self.asked = np.bincount(code, minlength=len(self.vocabulary))
        self.first = np.cumsum(self.asked) - self.asked
        self.idf = idf[order][self.first]
        self.top = np.zeros((top_k, self.n))
        self.rest, self.found = None, []

    def add(self, rows: pa.RecordBatch) -> None:
        """Rows of one id are one chunk; the last id's rows wait, as more of them can follow."""
        rows = pa.concat_batches([self.rest, rows]) if self.rest else rows
        ids = rows.column("id")
        null, plain = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null("")
        other = pc.not_equal(plain[1:], plain[:-1]).to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
        starts = np.r_[0, np.flatnonzero(other) + 1]
        self.rest = rows.slice(starts[-1])
        self._score(rows.slice(0, starts[-1]), starts[:-1])

    def _score(self, rows: pa.RecordBatch, starts: np.ndarray) -> None:
        if not len(starts):
            return
        lists, length = rows.column("terms"), rows.column("length").to_numpy()
        term = pc.index_in(lists.flatten(), self.vocabulary)
        known = term.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())[known]
        key, tf = np.unique(row * len(self.vocabulary) + term.drop_null().to_numpy().astype(np.int64), return_counts=True)
        row, term = np.divmod(key, len(self.vocabulary))
        part = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / (self.mean or 1)))
        chunk = np.searchsorted(starts, row, "right") - 1
        # pieces of whole chunks, by cells of the score table and by pairs of a posting and a query
        work = np.bincount(chunk, self.asked[term], len(starts)) + self.n
        piece = np.cumsum(work) // PIECE
        cuts = np.r_[np.flatnonzero(np.diff(piece, prepend=-1)), len(starts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            x, y = np.searchsorted(chunk, [a, b])
            times = self.asked[term[x:y]]
            at = np.arange(times.sum()) + np.repeat(self.first[term[x:y]] - np.cumsum(times) + times, times)
            cell = np.repeat((chunk[x:y] - a) * self.n, times) + self.query[at]
            score = np.bincount(cell, np.repeat(part[x:y], times), (b - a) * self.n).astype(np.float64)  # whole numbers where none matches
            self._keep(score.reshape(b - a, self.n), rows.column("id").take(pa.array(starts[a:b])))

    def _keep(self, score: np.ndarray, ids: pa.Array) -> None:
        self.top = np.partition(np.concatenate([self.top, score]), len(score), axis=0)[len(score) :]
        # a score more than one step of the rounding below top_k others has no rank
        rows, cols = np.nonzero((score > 0) & (score >= self.top.min(0) - 2e-9))
        self.found.append(pa.table({"query": cols, "score": score[rows, cols], "id": ids.take(pa.array(rows))}))
        if sum(map(len, self.found)) > max(PIECE // 4, 4 * self.top_k * self.n):
            self.found = [self._best()]

    def _best(self) -> pa.Table:
        """What is found and can still have a rank; of equal scores the first top_k ids."""
        t = pa.concat_tables(self.found)
        t = t.filter(pa.array(t.column("score").to_numpy() >= (self.top.min(0) - 2e-9)[t.column("query").to_numpy()]))
        t = t.take(pc.sort_indices(t, [("query", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
        query, score, at = t.column("query").to_numpy(), t.column("score").to_numpy(), np.arange(len(t))
        new = np.r_[True, (query[1:] != query[:-1]) | (score[1:] != score[:-1])][: len(t)]
        return t.filter(pa.array(at - np.maximum.accumulate(np.where(new, at, 0)) < self.top_k))

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.rest:
            rows, self.rest = self.rest, None
            self._score(rows, np.array([0]))
        if self.found:
            t = self._best()
            yield from pa.table({"query_id": self.query_ids.take(t.column("query").combine_chunks()), "chunk_id": t.column("id"), "score": t.column("score")}).to_batches()


def _scored(top_k: int):
    """The best scores of each unit of a block of queries and a part of the chunks; a unit's queries come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, scorer = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if (here := tuple(keys[a][:2])) != unit:
                    if scorer:
                        yield from scorer.end()
                    unit, held, scorer = here, [], None
                part = batch.slice(a, b - a)
                if keys[a][2] == 0:
                    held.append(part)
                elif held:
                    scorer = scorer or _Scorer(pa.Table.from_batches(held), top_k)
                    scorer.add(part)
        if scorer:
            yield from scorer.end()

    return run


def few(queries: DataFrame) -> bool:
    """Whether there are at most QUERY_BLOCK queries, so that they and their best hits can go to all workers; they are counted now."""
    return queries.limit(QUERY_BLOCK + 1).count() <= QUERY_BLOCK


def among(name: str, words: DataFrame) -> Column:
    """Those of the terms in the array column that are a term of words, which is looked up now; all terms with more than VOCABULARY words."""
    known = [r["term"] for r in words.distinct().limit(VOCABULARY + 1).toLocalIterator()]
    if len(known) > VOCABULARY:
        return F.col(name)
    # terms are letters, digits and underscores
    return F.expr(f"filter({name}, t -> t in ({', '.join(repr(w) for w in sorted(known))}))" if known else f"filter({name}, t -> false)")


def bm25(queries: DataFrame, index: DataFrame, top_k: int = 5, min_score: float | None = None, **equal: str | None) -> DataFrame:
    """query_id, chunk_id, score, rank by BM25 over the filtered index, whose statistics these are. Scores of 0 and less are left out.

    queries: query_id, query; index: chunk_id, text and what is filtered by. Queries of one id are one query, rows of one id one chunk.

    The queries' terms are looked up when this is called. Each chunk's list of them is sent once for the counts and once a block of
    queries to be scored: a task adds up the scores of some chunks for a block and passes on only what can be among the best, so that no
    pair of a term, or of a query, and a chunk is a row. With more than VOCABULARY terms, all terms of the chunks are sent.
    """
    validate_top_k(top_k)
    index = filtered(index, **equal)
    wanted = queries.select("query_id", F.explode(X.terms(F.coalesce("query", F.lit("")))).alias("term")).distinct()
    n, pairs = wanted.agg(F.count_distinct("query_id"), F.count("*")).first()
    # a generator of one array keeps the terms from being found again in each place that uses them
    lists = index.select("chunk_id", F.explode(F.array(X.terms(F.coalesce("text", F.lit(""))))).alias("terms"))
    # every use reads both columns, so that all share one shuffle
    chunks = lists.select("chunk_id", F.size("terms").cast("long").alias("length"), among("terms", wanted.select("term")).alias("terms")).groupBy("chunk_id", "length").agg(F.collect_list("terms").alias("lists"))
    copies = F.size("lists").cast("long")
    stats = chunks.agg(F.sum(copies).alias("total"), (F.sum(F.col("length") * copies) / F.sum(copies)).alias("mean"))
    df = chunks.select(F.explode(F.array_distinct(F.flatten("lists"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = wanted.join(df, "term").join(F.broadcast(stats))  # one row of statistics
    weights = weights.groupBy("query_id").agg(F.collect_list(F.struct("term", idf.alias("idf"))).alias("w"), F.first("mean").alias("mean"))
    width = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // QUERY_BLOCK), -(-pairs // (2 * PIECE)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = weights.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), every(width).alias("part"), F.lit(0).alias("role"), F.col("query_id").cast("string").alias("id"), F.lit(0).cast("long").alias("length"), F.col("w.term").alias("terms"), F.col("w.idf").alias("idf"), "mean")
    p = chunks.select(every(blocks).alias("block"), F.pmod(F.xxhash64("chunk_id"), F.lit(width)).cast("int").alias("part"), F.lit(1).alias("role"), F.col("chunk_id").cast("string").alias("id"), "length", F.flatten("lists").alias("terms"), F.lit(None).cast("array<double>").alias("idf"), F.lit(None).cast("double").alias("mean"))
    # a task has one part of each block; by hash of both some tasks would have several and others none
    dealt = q.unionByName(p).repartitionById(width, F.pmod(F.col("part") + F.col("block"), F.lit(width))).sortWithinPartitions("block", "part", "role", "id")
    scores = dealt.mapInArrow(_scored(top_k), _SCORES)
    scores = scores.select(F.col("query_id").cast(queries.schema["query_id"].dataType), F.col("chunk_id").cast(index.schema["chunk_id"].dataType), "score")
    if min_score is not None:
        scores = scores.where(F.col("score") >= min_score)
    return ranked(scores, top_k)


def _best(ids: pa.Array, q: np.ndarray, top_k: int):
    """For each batch of points, every (query, chunk) among a query's best top_k of the batch, ties at the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            fit = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), q.shape[1]), False)))
            if not len(fit):
                continue
            p = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), -1)
            norm = np.linalg.norm(p, axis=1, keepdims=True)
            score = q @ (p / np.where(norm > 0, norm, 1)).T
            rounded = np.round(score, 9)
            if len(fit) > top_k:
                edge = np.partition(rounded, len(fit) - top_k, axis=1)[:, len(fit) - top_k]
                rows, cols = np.nonzero(rounded >= edge[:, None])
            else:
                rows, cols = np.nonzero(np.ones(score.shape, bool))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), batch.column(0).take(pa.array(fit[cols])), pa.array(score[rows, cols])], names=["query_id", "chunk_id", "score"])

    return run


_SCORES = "query_id string, chunk_id string, score double"


def _unit(vectors: list[list[float]]) -> np.ndarray:
    q = np.array(vectors, np.float64)
    norm = np.linalg.norm(q, axis=1, keepdims=True)
    return q / np.where(norm > 0, norm, 1)


def _dealt(asked: DataFrame, rows: DataFrame, top_k: int) -> DataFrame:
    """The scores that can be among the best of each part of the points, for any number of queries."""
    width = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = -(-asked.count() // (QUERY_BLOCK // 2))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), every(width).alias("part"), F.lit(0).alias("role"), F.col("query_id").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    p = rows.select(every(blocks).alias("block"), F.pmod(F.xxhash64("chunk_id"), F.lit(width)).cast("int").alias("part"), F.lit(1).alias("role"), F.col("chunk_id").alias("id"), F.col("vector").cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, best = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (here := tuple(keys[a][:2])) != unit:
                    unit, held, best = here, [], None
                part = batch.slice(a, b - a)
                if keys[a][2] == 0:
                    held.append(part)
                elif held:
                    if best is None:
                        t = pa.Table.from_batches(held)
                        best = _best(t.column("id").combine_chunks(), _unit(t.column("vector").to_pylist()), top_k)
                    yield from best([pa.RecordBatch.from_arrays([part.column(3), part.column(4)], names=["chunk_id", "vector"])])

    dealt = q.unionByName(p).repartition(width, "block", "part").sortWithinPartitions("block", "part", "role")
    return dealt.mapInArrow(run, _SCORES)


def dense(queries: DataFrame, points: DataFrame, top_k: int = 5, min_score: float | None = None, **equal: str | None) -> DataFrame:
    """query_id, chunk_id, score, rank by exact cosine. queries: query_id, vector; points: chunk_id, vector and what is filtered by.

    Every worker compares its points with a block of the queries and passes on only what can be among the best. Up to QUERY_BLOCK
    queries go to all workers, and the points stay where they are; their number is looked up when this is called. More queries are dealt
    to blocks by hash, points to parts, and each block meets each part in a task: the points are then sent once a block, the queries
    once a part.
    """
    validate_top_k(top_k)
    rows = filtered(points, **equal).select(F.col("chunk_id").cast("string").alias("chunk_id"), "vector").where("vector is not null")
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector").where("vector is not null")
    table = asked.limit(QUERY_BLOCK + 1).toArrow()
    if not table.num_rows:
        out = points.sparkSession.createDataFrame([], _SCORES)
    elif table.num_rows <= QUERY_BLOCK:
        out = rows.mapInArrow(_best(table.column("query_id").combine_chunks(), _unit(table.column("vector").to_pylist()), top_k), _SCORES)
    else:
        out = _dealt(asked, rows, top_k)
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    return ranked(out, top_k)


def fuse(dense_hits: DataFrame, bm25_hits: DataFrame, top_k: int = 5, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: k / (k + rank) summed over both lists; ties by dense rank, then BM25 rank, a missing rank first."""
    validate_top_k(top_k)
    d = dense_hits.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
    b = bm25_hits.select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"))
    both = d.join(b, ["query_id", "chunk_id"], "full")

    def part(name: str) -> Column:
        return F.coalesce(F.lit(float(k)) / (k + F.col(name)), F.lit(0.0))

    scores = both.withColumn("score", part("dense_rank") + part("bm25_rank"))
    return ranked(scores, top_k, F.coalesce("dense_rank", F.lit(0)), F.coalesce("bm25_rank", F.lit(0)))


def hybrid(queries: DataFrame, points: DataFrame, top_k: int = 5, k: int = 60, min_score: float | None = None, **equal: str | None) -> DataFrame:
    """fuse() of dense and BM25 hits at depth top_k; min_score applies to both before. queries: query_id, query, vector."""
    return fuse(dense(queries, points, top_k, min_score, **equal), bm25(queries, points, top_k, min_score, **equal), top_k, k)


# The cross-encoder that is meant where none is named, and the variables that set a configuration.
RERANKER = "cross-encoder/ms-marco-MiniLM-L-6-v2"
RERANK_VARIABLES = {"model_name": "RERANKER_MODEL", "top_k": "RERANKER_TOP_K", "candidate_count": "RERANKER_CANDIDATE_COUNT", "batch_size": "RERANKER_BATCH_SIZE", "min_score": "RERANKER_MIN_SCORE"}


@dataclass(frozen=True)
class RerankConfig:
    """How to rerank. A model name that is not given, or blank, is that of the environment, else RERANKER; naming one loads nothing."""

    candidate_count: int = 20
    top_k: int = 5
    min_score: float | None = None
    batch_size: int = 32
    model_name: str | None = None

    def __post_init__(self) -> None:
        if not all(isinstance(x, int) and not isinstance(x, bool) for x in (self.candidate_count, self.top_k, self.batch_size)) or not self.candidate_count >= self.top_k >= 1 or self.batch_size < 1:
            raise ValueError("candidate_count must reach top_k, which must be at least 1, as must batch_size")
        names = [n for n in (self.model_name, os.environ.get(RERANK_VARIABLES["model_name"]), RERANKER) if n is not None]
        if not all(isinstance(n, str) for n in names):
            raise ValueError("a model's name must be text")
        object.__setattr__(self, "model_name", next(n.strip() for n in names if n.strip()))

    @classmethod
    def from_env(cls, **given) -> RerankConfig:
        """The settings given, then those of the environment, which are read only where none is given."""
        kinds = {"model_name": str, "min_score": float}
        found = {name: os.environ[key] for name, key in RERANK_VARIABLES.items() if name not in given and os.environ.get(key)}
        return cls(**{name: kinds.get(name, int)(value) for name, value in found.items()}, **given)


class CrossEncoder(Protocol):
    """What a plug-in scorer offers. `load` runs once a worker and returns a function from (query, text) pairs to scores."""

    def load(self) -> Callable[[list[tuple[str, str]]], list[float]]: ...


def encoder_scorer(encoder: CrossEncoder, batch_size: int = 32) -> Callable[[Column, Column], Column]:
    """A scorer for rerank(): the plug-in gets batch_size pairs at a time; another number of scores than pairs is an error."""

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        predict = encoder.load()
        for queries, texts in batches:
            pairs, out = list(zip(queries.to_pylist(), texts.to_pylist(), strict=True)), []
            for k in range(0, len(pairs), batch_size):
                part = pairs[k : k + batch_size]
                scores = [float(s) for s in predict(part)]
                if len(scores) != len(part):
                    raise ValueError(f"the scorer gave {len(scores)} scores for {len(part)} pairs")
                out += scores
            yield pa.array(out, pa.float64())

    return lambda query, text: run(F.coalesce(query, F.lit("")), F.coalesce(text, F.lit("")))


def length_score(query: Column, text: Column) -> Column:
    """Deterministic built-in cross-encoder."""
    return F.lit(1000.0) / (F.length(query) + F.length(text) + 1)


def rerank(hits: DataFrame, queries: DataFrame, index: DataFrame, config: RerankConfig, scorer: Callable[[Column, Column], Column] | CrossEncoder = length_score) -> DataFrame:
    """The candidates of each query in the order of the scorer's values, then of their first ranks. A score that is no finite number is an error.

    scorer: a function of the query and text columns, or a CrossEncoder, which is asked in batches of config.batch_size. The candidates of
    few() queries go to all workers, and the texts stay where they are.
    """
    if hasattr(scorer, "load"):
        scorer = encoder_scorer(scorer, config.batch_size)
    rows = hits.where(F.col("rank") <= config.candidate_count)
    rows = (F.broadcast(rows) if few(queries) else rows).join(index.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    value = scorer(F.col("query"), F.col("text"))
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    rows = rows.withColumn("first_rank", F.col("rank")).withColumn("score", F.when(bad, F.raise_error(F.lit("the scorer gave no finite number")).cast("double")).otherwise(value)).drop("rank", "text", "query")
    if config.min_score is not None:
        rows = rows.where(F.col("score") >= config.min_score)
    return ranked(rows, config.top_k, F.col("first_rank"))


def with_payload(hits: DataFrame, index: DataFrame, retriever: str, queries: DataFrame | None = None) -> DataFrame:
    """Hits as records with citation; a hit without file or text is an error.

    queries: those of the hits. If they are few() the hits go to all workers, and the payloads stay where they are.
    """
    def required(name: str) -> Column:
        return F.when(F.nullif(F.col(name), F.lit("")).isNull(), F.raise_error(F.lit(f"a hit has no {name}")).cast("string")).otherwise(F.col(name))

    rows = (F.broadcast(hits) if queries is not None and few(queries) else hits).join(index, "chunk_id")
    return rows.select("query_id", "rank", "chunk_id", "doc_id", required("source_file").alias("source_file"), "page_start", "page_end", "section_heading", "subheading", "chunk_type", required("text").alias("text"), "score", F.lit(retriever).alias("retriever"), X.citation(F.col("source_file"), F.col("page_start"), F.col("page_end"), F.col("section_heading")).alias("citation"))
