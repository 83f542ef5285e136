"""Gated recurrent language model in numpy, with a class-factored output softmax, trained by truncated backpropagation.

Vocabulary: the HEAD most frequent training words are predicted one by one, within classes of equal numbers of words; every other word
belongs to one of TAILS classes by its last letters, within which its probability follows the training counts, an unknown word being one more
type of its class. So the probabilities of all words and the end of the text sum to one. Counts are exact and of all training texts.

Training runs on every training text. The texts, as ids, are dealt by a hash of key and text into units of about UNIT tokens, and the
units into rounds, ROUNDS of them where the tokens are enough. In a round every unit starts from the same weights, carries the
state across its windows and resets it at a text's start; the units' weights, averaged by tokens in whole numbers, are the next round's
start. So neither the files nor the partitions that hold the texts have a part in the weights. Scoring carries the state through
the complete text. Counts of words beyond a table of bounded size meet the texts in a join on the word's hash.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import bounded, discard, materialize, shuffle_width
from corpusmill.llm.words import Lookup, mix, words

HEAD, CLASS, TAILS, HIDDEN = 1024, 32, 32, 16
N_HEAD = HEAD // CLASS
#: Word counts held in every worker: at most so many, 16 bytes each. Steps of a window in training and in scoring; widest batch.
LOCAL, WINDOW, SPAN, LANES = 1 << 18, 20, 32, 512
#: Tokens taken together in a worker; tokens of a unit of training, rounds of averaging, steps of weights a unit when they are averaged.
CHUNK, UNIT, ROUNDS, GRID = 1 << 20, 1 << 19, 8, 1 << 20
END = int(mix(np.array([0x5EED], np.uint64))[0])
RATE = 0.016


def tail_class(ends: np.ndarray) -> np.ndarray:
    return (mix(ends.astype(np.uint64) + np.uint64(77)) % np.uint64(TAILS)).astype(np.int32)


@dataclass
class Vocabulary:
    """Counts of the frequent words, ids of the head words, and normalisers of the tail classes."""

    keys: np.ndarray
    counts: np.ndarray
    head: np.ndarray  # positions in keys of the head words, most frequent first
    end_count: int
    tail_total: np.ndarray  # training tokens of each tail class
    tail_types: np.ndarray

    def prepare(self) -> None:
        self.lookup = Lookup(self.keys)
        self.rank = np.full(len(self.keys) + 1, -1, np.int32)
        self.rank[self.head] = np.arange(len(self.head))

    def ids(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input ids (head rank, or HEAD + tail class) and counts (-1: not in the table) of words."""
        at = self.lookup.find(h)
        rank = np.where(at >= 0, self.rank[at], -1)
        return np.where(rank >= 0, rank, HEAD + tail_class(ends)).astype(np.int32), np.where(at >= 0, self.counts[at], -1)


#: Input ids: head words, tail classes, start of text. Output classes: head classes, tail classes, end.
N_IN, START, N_OUT, END_CLASS, END_ID = HEAD + TAILS + 1, HEAD + TAILS, N_HEAD + TAILS + 1, N_HEAD + TAILS, HEAD + TAILS
SHAPES = {"x": (N_IN, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN, N_OUT), "cb": (N_OUT,), "w": (N_HEAD, HIDDEN, CLASS), "wb": (N_HEAD, CLASS)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def output_class(ids: np.ndarray) -> np.ndarray:
    """Class of target ids; END_ID is the end of the text."""
    return np.where(ids < HEAD, ids // CLASS, ids - HEAD + N_HEAD)


def initial(v: Vocabulary) -> np.ndarray:
    """Small seeded weights, and biases that make the untrained model the unigram model."""
    flat = np.random.default_rng(11).normal(0, 0.1, SIZE).astype(np.float32)
    p = views(flat)
    head = np.zeros(HEAD)
    head[: len(v.head)] = v.counts[v.head]
    p["wb"][:] = np.log(head + 0.5).reshape(N_HEAD, CLASS)
    p["wb"].reshape(-1)[len(v.head) :] = -30  # ids that no word has
    totals = np.r_[head.reshape(N_HEAD, CLASS).sum(1), v.tail_total, v.end_count]
    p["cb"][:] = np.log(totals + 0.5) - np.log(totals.sum() + 1)
    p["cb"][-(-len(v.head) // CLASS) : N_HEAD] = -30  # head classes without words
    return flat


def _forward(p: dict, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, list]:
    """States after each of the steps of ids (steps x lanes); fresh: where a text starts. Returns states, last state, what backward needs."""
    n = HIDDEN
    out, saved = np.empty((*ids.shape, n), np.float32), []
    inputs, starts, u = p["x"][ids], fresh.any(1), p["u"]
    for t in range(len(ids)):
        if starts[t]:
            h = h.copy()
            h[fresh[t]] = 0
        gx, gh = inputs[t], h @ u
        zr = gx[:, : 2 * n] + gh[:, : 2 * n]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:, :n], zr[:, n:]
        c = r * gh[:, 2 * n :]
        c += gx[:, 2 * n :]
        np.tanh(c, out=c)
        if keep:
            saved.append((h, z, r, c, gh[:, 2 * n :]))
        new = h - c
        new *= z
        new += c
        out[t] = h = new
    return out, h, saved


def _exp_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the rows of x, which is overwritten, and their sums; rows are shifted only where a value is large enough to need it."""
    if x.size and x.max() > 60:
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    return x, x.sum(1)


def _groups(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(head class, positions of its targets)."""
    at = np.flatnonzero(target < HEAD)
    cls = target[at] // CLASS
    order = np.argsort(cls, kind="stable")
    at, cls = at[order], cls[order]
    cuts = np.searchsorted(cls, np.arange(N_HEAD + 1))
    for k in range(N_HEAD):
        if cuts[k] < cuts[k + 1]:
            yield k, at[cuts[k] : cuts[k + 1]]


def log_probabilities(p: dict, states: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log of the model's probability of each target id; for tail ids that of the class only."""
    e, total = _exp_sums(states @ p["c"] + p["cb"])
    chosen = e[np.arange(len(target)), output_class(target)].astype(np.float64) / total
    for k, at in _groups(target):
        e, total = _exp_sums(states[at] @ p["w"][k] + p["wb"][k])
        chosen[at] *= e[np.arange(len(at)), target[at] % CLASS] / total
    return np.log(np.maximum(chosen, 1e-300))


def gradients(p: dict, ids: np.ndarray, fresh: np.ndarray, target: np.ndarray, weight: np.ndarray, h0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the mean log-likelihood of one window by backpropagation through it, and the last state."""
    steps, lanes = ids.shape
    states, last, saved = _forward(p, ids, fresh, h0, True)
    flat_s, flat_t, flat_w = states.reshape(-1, HIDDEN), target.reshape(-1), weight.reshape(-1)
    grad = np.zeros(SIZE, np.float32)
    g = views(grad)
    scale = np.float32(1 / max(1.0, flat_w.sum()))
    d, total = _exp_sums(flat_s @ p["c"] + p["cb"])
    share = flat_w * scale
    d *= (-share / total)[:, None]
    d[np.arange(len(flat_t)), output_class(flat_t)] += share
    g["c"][:], g["cb"][:] = flat_s.T @ d, d.sum(0)
    ds = d @ p["c"].T
    for k, at in _groups(flat_t):
        s = flat_s[at]
        e, total = _exp_sums(s @ p["w"][k] + p["wb"][k])
        e *= (-share[at] / total)[:, None]
        e[np.arange(len(at)), flat_t[at] % CLASS] += share[at]
        g["w"][k], g["wb"][k] = s.T @ e, e.sum(0)
        ds[at] += e @ p["w"][k].T
    ds = ds.reshape(steps, lanes, HIDDEN)
    n, dh = HIDDEN, np.zeros((lanes, HIDDEN), np.float32)
    dg = np.empty((steps, lanes, 3 * n), np.float32)
    u_t, starts = p["u"].T.copy(), fresh.any(1)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, hc = saved[t]
        dh = dh + ds[t]
        dc = dh * (1 - z) * (1 - c * c)
        a = dg[t]
        a[:, :n] = dh * (h - c) * z * (1 - z)
        a[:, n : 2 * n] = dc * hc * r * (1 - r)
        a[:, 2 * n :] = dc
        gh = a.copy()
        gh[:, 2 * n :] *= r
        g["u"] += h.T @ gh
        dh = dh * z
        dh += gh @ u_t
        if starts[t]:
            dh[fresh[t]] = 0
    order = np.argsort(ids.reshape(-1), kind="stable")
    sorted_ids = ids.reshape(-1)[order]
    first = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
    g["x"][sorted_ids[first]] = np.add.reduceat(dg.reshape(-1, 3 * n)[order], first, axis=0)
    return grad, last


class Trainer:
    """Adam over windows of token streams; the state goes from window to window. before: steps of earlier rounds, for the rate."""

    def __init__(self, flat: np.ndarray, before: int = 0):
        self.flat, self.m, self.v, self.k, self.tokens, self.before = flat.copy(), np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0, 0, before

    def run(self, ids: np.ndarray, target: np.ndarray, fresh: np.ndarray) -> None:
        """One pass over a stream: inputs, targets, and where texts start."""
        n = len(ids)
        lanes = int(np.clip(n // 1500, 8, LANES))
        length = -(-n // lanes)
        length = -(-length // WINDOW) * WINDOW
        pad = lanes * length - n
        weight = np.r_[np.ones(n, np.float32), np.zeros(pad, np.float32)].reshape(lanes, length).T
        ids, target, fresh = (np.r_[x, np.full(pad, fill, x.dtype)].reshape(lanes, length).T for x, fill in ((ids, START), (target, END_ID), (fresh, True)))
        h, p = np.zeros((lanes, HIDDEN), np.float32), views(self.flat)
        for t in range(0, length, WINDOW):
            s = slice(t, t + WINDOW)
            grad, h = gradients(p, ids[s], fresh[s], target[s], weight[s], h)
            self.k += 1
            self.m += 0.1 * (grad - self.m)
            self.v += 0.001 * (grad * grad - self.v)
            rate = RATE / (1 + (self.before + self.k) / 400) * np.sqrt(1 - 0.999**self.k) / (1 - 0.9**self.k)
            self.flat += np.float32(rate) * self.m / (np.sqrt(self.v) + np.float32(1e-8))
        self.tokens += n


def score_texts(p: dict, ids: np.ndarray, target: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log_probabilities() of the tokens of consecutive texts with offsets at.

    Texts are laid end to end in lanes of about equal length; the lanes stand by length, so that those with tokens left are the first ones.
    """
    n = np.diff(at)
    total = int(at[-1])
    lanes = int(np.clip(total // 4096, 1, LANES))
    heap, where = [(0, k) for k in range(lanes)], np.zeros((len(n), 2), np.int64)
    for k in np.argsort(-n, kind="stable").tolist():
        size, lane = heap[0]
        where[k] = size, lane
        heapq.heapreplace(heap, (size + int(n[k]), lane))
    lengths = np.zeros(lanes, np.int64)
    for size, lane in heap:
        lengths[lane] = size
    order = np.argsort(-lengths, kind="stable")
    place = np.empty(lanes, np.int64)
    place[order] = np.arange(lanes)
    lengths = lengths[order]
    col = np.repeat(place[where[:, 1]], n)
    # a lane's tokens lie one after another in flat arrays
    begin = np.r_[0, np.cumsum(lengths)[:-1]]
    spot = begin[col] + np.repeat(where[:, 0] - at[:-1], n) + np.arange(total)
    flat_ids, flat_goal, flat_new = np.empty(total, np.int32), np.empty(total, np.int32), np.zeros(total, bool)
    flat_ids[spot], flat_goal[spot] = ids, target
    flat_new[spot[at[:-1]]] = True
    logs = np.empty(total)
    h = np.zeros((lanes, HIDDEN), np.float32)
    for t in range(0, int(lengths[0]), SPAN):
        active = int(np.searchsorted(-lengths, -t, "left"))  # lanes longer than t
        steps = np.arange(t, min(t + SPAN, int(lengths[0])))
        grid = begin[None, :active] + steps[:, None]
        inside = steps[:, None] < lengths[None, :active]
        grid = np.where(inside, grid, 0)
        states, last, _ = _forward(p, np.where(inside, flat_ids[grid], START), inside & flat_new[grid], h[:active], False)
        h[:active] = last
        logs[grid[inside]] = log_probabilities(p, states[inside], flat_goal[grid[inside]])
    return logs[spot]


def _streams(batches: Iterator[pa.RecordBatch], v: Vocabulary, first: int) -> Iterator[tuple]:
    """(rows, hashes, ends, ids, counts, targets, inputs, fresh, offsets) of about CHUNK tokens; offsets count the end of each text."""
    held, size = [], 0

    def flush() -> tuple:
        rows = np.concatenate([x[0] for x in held])
        n = np.concatenate([np.diff(x[2]) for x in held])
        h, tails = np.concatenate([x[1] for x in held]), np.concatenate([x[3] for x in held])
        ids, counts = v.ids(h, tails)
        at = np.r_[0, np.cumsum(n + 1)]
        target, inputs = np.full(at[-1], END_ID, np.int32), np.empty(at[-1], np.int32)
        inside = np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        target[inside] = ids
        inputs[1:] = target[:-1]
        inputs[at[:-1]] = START
        fresh = np.zeros(at[-1], bool)
        fresh[at[:-1]] = True
        return rows, h, tails, counts, inside, target, inputs, fresh, at

    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for low, high, h, at, tails in words(batch.column(first), ends=True):
            held.append((keys[low:high], h, at, tails))
            size += len(h)
            if size >= CHUNK:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def grouped(parts: list, texts: int) -> pa.RecordBatch:
        h, first, n = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_counts=True)
        k = tail_class(np.concatenate([p[1] for p in parts])[first]) if len(h) else np.zeros(0, np.int64)
        h, n, k = np.r_[h, np.uint64(END)], np.r_[n, texts], np.r_[k, -1]
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(k.astype(np.int32))], names=["h", "n", "k"])

    parts, size, texts = [], 0, 0
    for batch in batches:
        for low, high, h, _, ends in words(batch.column(0), ends=True):
            parts.append((h, ends))
            size, texts = size + len(h), texts + high - low
            if size >= 1 << 22:
                yield grouped(parts, texts)
                parts, size, texts = [], 0, 0
    if texts:
        yield grouped(parts, texts)


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int, int]:
    """The bounded part of the counts, with N (training tokens) and V (distinct ones)."""
    level = F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(F.log2(F.col("c").cast("double")) * 256))
    table = counts.groupBy(level.cast("int").alias("level")).agg(F.count("*").alias("words"), F.sum("c").alias("tokens"), F.min("c").alias("least")).orderBy(F.desc("level")).toArrow()
    n, v = sum(table.column("tokens").to_pylist()), sum(table.column("words").to_pylist())
    held, least = 0, None
    for many, low in zip(table.column("words").to_pylist(), table.column("least").to_pylist(), strict=True):
        held += many
        if held > LOCAL:
            break
        least = low
    top = counts.where(F.col("c") >= least if least is not None else F.lit(False)).where("k >= 0").orderBy(F.desc("c"), "h").toArrow()  # at most LOCAL rows
    keys, c, k = (top.column(x).to_numpy() for x in ("h", "c", "k"))
    head = np.arange(min(HEAD, len(keys)))
    sums = counts.where("k >= 0").groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()
    total, types = np.zeros(TAILS), np.zeros(TAILS)
    total[sums.column("k").to_numpy()], types[sums.column("k").to_numpy()] = sums.column("c").to_numpy(), sums.column("n").to_numpy()
    np.subtract.at(total, k[head], c[head])
    np.subtract.at(types, k[head], 1)
    end = counts.where("k = -1").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    return Vocabulary(keys.view(np.uint64), c, head, int(end), total, types), int(n), int(v)


def _ready(shared) -> Vocabulary:
    v = shared.value
    if not hasattr(v, "lookup"):
        v.prepare()
    return v


def _encoded(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(mark, ids) of rows (mark, body): target ids of a text and its end, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _ready(shared)
        for marks, _, _, _, _, target, _, _, at in _streams(batches, v, 1):
            data, ends = target.astype("<u2").tobytes(), (2 * at).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), len(marks), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(marks), ids], names=["mark", "ids"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, part, ids) of rows (unit, ids), those of a unit together. A unit has one part, but where equal rows make it long."""
    held, size, last, part = [], 0, None, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"unit": pa.array([last], pa.int64()), "part": pa.array([part], pa.int32()), "ids": pa.array([b"".join(held)], pa.binary())})

    for batch in batches:
        for unit, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (unit != last or size >= 4 * UNIT):  # bytes: twice a unit's tokens
                yield row()
                held, size, part = [], 0, part + 1 if unit == last else 0
            part = part if unit == last else 0
            last = unit
            held.append(ids)
            size += len(ids)
    if held:
        yield row()


def _train(weights) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (pos, value): the units' weights in steps of 1 / GRID, times their tokens, added up; at SIZE their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, before = weights.value
        total = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                target = np.frombuffer(ids.as_buffer(), "<u2").astype(np.int32)
                fresh = np.r_[True, target[:-1] == END_ID]
                trainer = Trainer(flat, before)
                trainer.run(np.where(fresh, START, np.r_[START, target[:-1]]).astype(np.int32), target, fresh)
                steps = np.round(np.clip(trainer.flat.astype(np.float64), -64, 64) * GRID).astype(np.int64) * trainer.tokens
                total += np.r_[steps, trainer.tokens]
        if total[SIZE]:
            yield pa.RecordBatch.from_pydict({"pos": pa.array(np.arange(SIZE + 1), pa.int32()), "value": pa.array(total)})

    return run


def train(texts: DataFrame, shared, flat: np.ndarray, tokens: int) -> np.ndarray:
    """Weights after all rounds. texts: key, body; flat: where training starts; tokens: those of all texts, which set rounds and units."""
    spark = texts.sparkSession
    rounds = min(ROUNDS, max(1, -(-tokens // UNIT)))
    units = rounds * max(1, -(-tokens // (rounds * UNIT)))
    marked = texts.select(F.xxhash64("key", "body").alias("mark"), "body").mapInArrow(_encoded(shared), "mark long, ids binary")
    dealt = marked.withColumn("unit", F.pmod("mark", F.lit(units))).repartition(shuffle_width(spark), "unit").sortWithinPartitions("unit", "mark").select("unit", "ids")
    table = materialize(dealt.mapInArrow(_packed, "unit long, part int, ids binary"), "units")
    for k in range(rounds):
        weights = spark.sparkContext.broadcast((flat, k * UNIT // (WINDOW * int(np.clip(UNIT // 1500, 8, LANES)))))
        # a task for each core at most: whole numbers add up to the same whatever task a unit is in
        rows = table.where(F.col("unit") % rounds == k).select("ids").repartition(min(units // rounds, spark.sparkContext.defaultParallelism))
        got = rows.mapInArrow(_train(weights), "pos int, value long").groupBy("pos").agg(F.sum("value").alias("value")).toArrow()  # SIZE + 1 rows
        weights.destroy()
        if got.num_rows:
            sums = np.zeros(SIZE + 1)
            sums[got.column("pos").to_numpy()] = got.column("value").to_numpy()
            flat = (sums[:-1] / sums[-1] / GRID).astype(np.float32)
    discard(table)
    return flat


_SCORED = "uid long, h long, tf int, n_tokens long, known long, base double, score double"


def _score(shared, flat: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = _ready(shared), views(flat)
        tail_log = np.log10(v.tail_total + 0.5 * (v.tail_types + 1))
        names = [c.split()[0] for c in _SCORED.split(", ")]
        for rows, h, tails, counts, inside, target, inputs, _, at in _streams(batches, v, 1):
            logs = score_texts(p, inputs, target, at) / np.log(10)
            value = np.where(counts >= 0, np.log10(np.maximum(counts, 0) + 0.5), 0.0)  # of words outside the table the join adds it
            per_token = np.full(len(target), np.log10(v.end_count + 0.5))
            per_token[inside] = value
            logs[inside] += np.where(target[inside] >= HEAD, value - tail_log[tail_class(tails)], 0)
            known = np.full(len(target), v.end_count > 0)
            known[inside] = counts > 0
            base, score, seen = (np.add.reduceat(x, at[:-1], dtype=kind) for x, kind in ((per_token, float), (logs, float), (known, np.int64)))
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int64)), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int32()), pa.array(n.astype(np.int64)), pa.array(seen.astype(np.int64)), pa.array(base), pa.array(score)], names=names)
            text = np.repeat(np.arange(len(n)), n - 1)
            rare = np.flatnonzero(counts < 0)
            order = rare[np.lexsort((h[rare], text[rare]))]
            if len(order):
                first = np.flatnonzero(np.r_[True, (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])])
                tf = np.diff(np.r_[first, len(order)]).astype(np.int32)
                at_h, at_row = h[order[first]].view(np.int64), rows[text[order[first]]].astype(np.int64)
                for k in range(0, len(first), 1 << 17):
                    s = slice(k, k + (1 << 17))
                    m = len(at_h[s])
                    yield pa.RecordBatch.from_arrays([pa.array(at_row[s]), pa.array(at_h[s]), pa.array(tf[s]), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names=names)

    return run


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 5) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; logarithms are of base 10.

    Training texts are those whose crc32 of the key as text does not leave 1; a null key trains. A null or empty text consists of the
    end token. Repeated rows are texts of their own. Without training texts the counts are 0 and all probabilities uniform over one
    unknown type. An empty table gives no rows. Other columns are not read. Equal tables give equal scores, but for the rounding of
    single-precision sums, whatever files and partitions hold them. Counting and training run when this is called.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("key").cast("string").cast("binary")) % modulus == 1, F.lit(False))
    rows = bounded(docs).select(F.col(key).cast("long").alias("key"), F.col(text).alias("body"))
    learned = rows.where(~held).select("key", F.coalesce("body", F.lit("")).alias("body"))
    counts = learned.select("body").mapInArrow(_count, "h long, n long, k int").groupBy("h").agg(F.sum("n").alias("c"), F.max("k").alias("k"))
    counts = materialize(counts, "counts")
    v, n_train, n_types = vocabulary(counts)
    shared = spark.sparkContext.broadcast(v)
    flat = train(learned, shared, initial(v), n_train)
    numbered = rows.withColumn("uid", F.monotonically_increasing_id())
    scored = materialize(_scored_rows(numbered, shared, flat), "scored")
    texts = scored.where("h is null").select("uid", "row_key", "n_tokens", "known", "base", "score")
    rare = scored.where("h is not null").select("uid", "h", "tf")
    met = rare.join(counts.select("h", "c"), "h", "left").select("uid", (F.col("tf") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.5))).alias("more"), F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("more_known"))
    met = met.groupBy("uid").agg(F.sum("more").alias("more"), F.sum("more_known").alias("more_known"))
    out = texts.join(met, "uid", "left").withColumn("more", F.coalesce("more", F.lit(0.0)))
    norm = float(np.log10(n_train + 0.5 * (n_types + 1)))
    hold = F.coalesce(F.crc32(F.col("row_key").cast("string").cast("binary")) % modulus == 1, F.lit(False))
    return out.select(F.col("row_key").alias(key), hold.alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + F.col("more") - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("score") + F.col("more")).alias("score"))


def _scored_rows(numbered: DataFrame, shared, flat: np.ndarray) -> DataFrame:
    """_score() with the key of each text beside its row number."""
    inner = _score(shared, flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[int, int | None] = {}

        def tapped() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys.update(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
                yield batch

        for out in inner(tapped()):
            row = [keys.pop(u) if h is None else None for u, h in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)] if out.column(1).null_count else [None] * out.num_rows
            yield out.append_column("row_key", pa.array(row, pa.int64()))

    return numbered.select("uid", "body", "key").mapInArrow(run, f"{_SCORED}, row_key long")
