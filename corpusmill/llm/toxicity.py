"""Toxicity from two class-conditional Kneser-Ney bigram models.

p(w | class, v) backs off to p(w | class), whose counts are the distinct words before w in the class, and that to a distribution
shared by both classes, whose counts are the number of classes that know w. Every word of the counted texts has its probability, a rare
one near the shared one, so that it says little. A pair is discounted by DISCOUNT, and one seen fewer than `cutoff` times in both
classes together by all it has (Katz's cut-off): its mass goes to the backoff, which speaks for it. A word that no counted text
holds says nothing. A text's evidence is its log-likelihood ratio, normalised by
length, and the part of it that strong expressions carry; a logistic function fitted on other labelled rows turns it into a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.shared import bounded, discard, materialize
from corpusmill.llm.words import PUNCTUATED, Lookup, mix, words

#: Discount of counts, bound of a word's ratio, and the ratio above which an expression is a strong one.
DISCOUNT, CLIP, STRONG = 0.75, 5.0, 2.0
#: Weights of the logistic function where there are no rows to fit it on: it turns where strong evidence begins.
UNFITTED = (-4.0, 4.0, 4.0, 1.0)


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0x9E3779B97F4A7C15) + w)


def _before(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The word before each word of the same text; 0 at a text's start."""
    v = np.zeros_like(h)
    v[1:] = h[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    v[first] = 0
    return v


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column(0).to_numpy(zero_copy_only=False)
        for low, high, h, at in words(batch.column(1), PUNCTUATED):
            v, y = _before(h, at), np.repeat(label[low:high], np.diff(at))
            _, first, n = np.unique(_pair(v, h) * np.uint64(2) + y.astype(np.uint64), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(y[first], pa.int32()), pa.array(v[first].view(np.int64)), pa.array(h[first].view(np.int64)), pa.array(n)], names=["y", "v", "w", "n"])


@dataclass
class Model:
    """Probabilities of all counted words, and of the pairs above the cut-off, in the toxic (column 1) and the ordinary (column 0) model."""

    words: np.ndarray
    word_p: np.ndarray
    contexts: np.ndarray
    context_back: np.ndarray
    pairs: np.ndarray
    pair_p: np.ndarray
    weights: np.ndarray

    def prepare(self) -> None:
        self.find_word, self.find_context, self.find_pair = Lookup(self.words), Lookup(self.contexts), Lookup(self.pairs)

    def ratios(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each word, clipped; 0 for words that no counted text holds."""
        v = _before(h, at)
        out, known = np.zeros(len(h)), self.find_word.find(h)
        k = np.flatnonzero(known >= 0)
        if not len(k):
            return out
        context = self.find_context.find(v[k])
        back = np.where((context >= 0)[:, None], self.context_back[context], 1.0)
        p = back * self.word_p[known[k]]
        pair = self.find_pair.find(_pair(v[k], h[k]))
        seen = pair >= 0
        p[seen] += self.pair_p[pair[seen]]
        out[k] = np.clip(np.log(p[:, 1]) - np.log(p[:, 0]), -CLIP, CLIP)
        return out

    def evidence(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Per text: mean ratio, log of what strong expressions carry, and the same by length.

        A strong word counts by the logarithm of how often it stands in the text, so that a text which only repeats itself gains little.
        """
        r = self.ratios(h, at)
        n = np.diff(at)
        c = np.r_[0.0, np.cumsum(r)]
        size = np.maximum(n, 1)
        strong = np.zeros(len(n))
        k = np.flatnonzero(r > STRONG)
        if len(k):
            text = np.searchsorted(at, k, "right") - 1
            order = np.lexsort((h[k], text))
            k, text = k[order], text[order]
            first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (h[k][1:] != h[k][:-1])])
            many = np.diff(np.r_[first, len(k)])
            np.add.at(strong, text[first], np.maximum.reduceat(r[k] - STRONG, first) * np.log2(1 + many))
        return np.stack([(c[at[1:]] - c[at[:-1]]) / size, np.log1p(strong), 100 * strong / (size + 50.0)], 1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = self.weights[0] + evidence @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def held_out(key: Column, modulus: int = 3) -> Column:
    """crc32 of the key as text leaves 1; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == 1, F.lit(False))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; the ridge keeps separable data finite."""
    a, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def count_model(rows: DataFrame, known: DataFrame, per_class: int = 8000, cutoff: int = 4) -> Model | None:
    """The two models from at most per_class labelled texts a class; None where a class has no word. rows: key, body; known: key, y.

    The texts are the first by a hash of the key. Equal texts count once; with different labels they are toxic.
    """
    count_rows = [known.where(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(per_class) for y in (0, 1)]
    sample = rows.join(F.broadcast(count_rows[0].union(count_rows[1])), "key").groupBy("body").agg(F.max("y").alias("y"))  # 2 * per_class rows
    counted = sample.select("y", "body").mapInArrow(_bigrams, "y int, v long, w long, n long")
    pairs = counted.groupBy("v", "w").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"))
    pairs = materialize(pairs, "toxic-pairs")
    by_word = pairs.groupBy("w").agg(F.sum((F.col("n0") > 0).cast("long")).alias("c0"), F.sum((F.col("n1") > 0).cast("long")).alias("c1"))
    word_table = by_word.orderBy("w").toArrow()  # words of the bounded sample
    if not word_table.num_rows:
        discard(pairs)
        return None
    context = pairs.groupBy("v").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    kept = pairs.where(F.col("n0") + F.col("n1") >= cutoff).join(context, "v").orderBy("v", "w").toArrow()
    discard(pairs)

    def two(t: pa.Table, a: str, b: str) -> np.ndarray:
        return np.stack([t.column(a).to_numpy(), t.column(b).to_numpy()], 1).astype(float)

    c = two(word_table, "c0", "c1")
    n_types, tokens = (c > 0).sum(0).astype(float), c.sum(0)
    if not tokens.all():
        return None
    shared = (c > 0).sum(1, keepdims=True) / n_types.sum()
    word_p = (np.maximum(c - DISCOUNT, 0) + DISCOUNT * n_types * shared) / tokens
    v, w = (kept.column(x).to_numpy().view(np.uint64) for x in ("v", "w"))
    pair_p = np.maximum(two(kept, "n0", "n1") - DISCOUNT, 0) / np.maximum(two(kept, "t0", "t1"), 1)
    contexts, group = np.unique(v, return_inverse=True)
    back = np.ones((len(contexts), 2))
    np.subtract.at(back, group, pair_p)
    half = (x.astype(np.float32) for x in (word_p, np.maximum(back, 1e-6), pair_p))
    word_p, back, pair_p = half
    return Model(word_table.column("w").to_numpy().view(np.uint64), word_p, contexts, back, _pair(v, w), pair_p, np.array(UNFITTED))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 8000, calibration: int = 16000, cutoff: int = 4) -> Model | None:
    """The models from labelled rows that are not held out; None where a class has no row.

    Counts come from at most per_class rows of a class, equal texts counted once. The logistic function is fitted on at most
    `calibration` rows whose remainder is 2, scored by a model of the rows whose remainder is 0. Both samples are the first rows by a
    hash of the key. A key with several labels has the largest; null labels are no labels.
    """
    bounded(docs)
    known = labels.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("y")).where("key is not null and y is not null").groupBy("key").agg(F.max("y").alias("y"))
    rest = F.crc32(F.col("key").cast("string").cast("binary")) % 3
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("body")).where("key is not null and body is not null")
    model, half = (count_model(rows, known.where(part), per_class, cutoff) for part in (rest != 1, rest == 0))
    if model is None or half is None:
        return model
    picked = known.where(rest == 2).orderBy(F.xxhash64("key"), "key").limit(calibration)
    shared = docs.sparkSession.sparkContext.broadcast(half)
    sample = rows.join(F.broadcast(picked), "key").select("y", "body").mapInArrow(_evidence(shared), "key long, e0 double, e1 double, e2 double").toArrow()
    shared.destroy()
    x, y = np.stack([sample.column(f"e{k}").to_numpy() for k in range(3)], 1), sample.column("key").to_numpy().astype(float)
    if len(y) and 0 < y.mean() < 1:
        model.weights = _logistic(x, y)
    return model


def _ready(shared) -> Model:
    model = shared.value
    if not hasattr(model, "find_word"):
        model.prepare()
    return model


def _evidence(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _ready(shared)
        for batch in batches:
            key = batch.column(0).cast(pa.int64())
            for low, high, h, at in words(batch.column(1), PUNCTUATED):
                yield pa.RecordBatch.from_arrays([key.slice(low, high - low), *(pa.array(e) for e in model.evidence(h, at).T.copy())], names=["key", "e0", "e1", "e2"])

    return run


def score_column(model: Model | None, body: Column, spark: SparkSession) -> Column:
    """The score of each text, as a column: only the texts go to Python and only the scores come back."""
    if model is None:
        return F.lit(0.0)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = _ready(shared)
        for column in texts:
            scores = [ready.score(ready.evidence(h, at)) for _, _, h, at in words(column, PUNCTUATED)]
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0))

    return score(body)


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.7, **options) -> DataFrame:
    """key, held_out, score, predicted for every row of docs.

    score is in 0 to 1; a null or empty text, or one without words the models know, gets the score of no evidence. Without labelled
    rows of both classes every score is 0. Null keys and repeated rows are kept. An empty table gives no rows. Only key and text are read.
    The models are fitted, by several jobs, when this is called. options: those of fit().
    """
    score = score_column(fit(docs, labels, key, text, label, **options), F.col("body"), docs.sparkSession)
    scored = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("body")).select("key", score.alias("score"))
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.7, **options) -> DataFrame:
    """The rows of docs whose score is below the threshold, all columns as they are, whatever their names.

    Null and empty texts, null keys and repeated rows are judged as in score_toxicity(); nothing goes where no model can be fitted. An
    empty table gives no rows. options: those of fit().
    """
    return docs.where(score_column(fit(docs, labels, key, text, label, **options), docs[text], docs.sparkSession) < threshold)
