"""Byte-level BPE encoding with a pair occurrence index, and decoding.

All distinct words of a block of texts lie in one symbol array with links to their neighbours. The index maps each rank that occurs to
the positions of its pair. Ranks are applied in ascending order, each to all its positions at once; a merge changes the pairs of
its neighbours, whose positions go to the lists of their ranks. A vocabulary builds a token before any merge that uses it, so new
pairs always rank higher and one ascending sweep is complete; the constructor checks that.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import bounded
from corpusmill.llm.tokenizers_io import byte_alphabet, vocabulary_path
from corpusmill.llm.words import Lookup, text_buffer

#: Bytes of text taken together, and most words whose ids a worker keeps.
BLOCK, KEPT = 2 << 20, 200_000


class PairIndexBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_alphabet()
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            if all(c in letters for c in token):
                self.token_bytes[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.byte_id = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        born = np.full(size, -1)
        born[self.made] = np.arange(len(pairs))
        if (born[self.left] >= np.arange(len(pairs))).any() or (born[self.right] >= np.arange(len(pairs))).any():
            raise ValueError("a merge uses a token that a later merge makes")
        self.find = Lookup(self._key(self.left, self.right))
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def _ranks(self, sym: np.ndarray, nxt: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.find.find(self._key(sym[at], sym[nxt[at]]))

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each of the words (no empty ones), by one ascending sweep over the ranks that occur in any of them."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[ends - 1] = -1
        prv[ends - lengths] = -1
        at = np.flatnonzero(nxt >= 0).astype(np.int32)
        rank = self._ranks(sym, nxt, at)
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        index: dict[int, list[np.ndarray]] = {}
        active, cuts = np.unique(rank, return_index=True)
        for r, part in zip(active.tolist(), np.split(at, cuts[1:]) if len(active) else [], strict=True):
            index[r] = [part]
        heap = active.tolist()
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            follow = nxt[pos]
            good = (sym[pos] == self.left[r]) & (follow >= 0)
            pos, follow = pos[good], follow[good]
            good = sym[follow] == self.right[r]
            pos, follow = pos[good], follow[good]
            if not len(pos):
                continue
            if self.left[r] == self.right[r] and len(pos) > 1:  # of overlapping occurrences the leftmost goes first
                begins = np.r_[True, follow[:-1] != pos[1:]]
                start = np.maximum.accumulate(np.where(begins, np.arange(len(pos)), 0))
                even = (np.arange(len(pos)) - start) % 2 == 0
                pos, follow = pos[even], follow[even]
            after = nxt[follow]
            sym[pos] = self.made[r]
            sym[follow] = -1
            nxt[pos] = after
            inner = after >= 0
            prv[after[inner]] = pos[inner]
            before = prv[pos]
            changed = np.concatenate((before[before >= 0], pos[inner]))
            if not len(changed):
                continue
            new = self._ranks(sym, nxt, changed)
            changed, new = changed[new >= 0], new[new >= 0]
            if not len(new):
                continue
            order = np.argsort(new, kind="stable")
            changed, new = changed[order], new[order]
            cuts = np.flatnonzero(new[1:] != new[:-1]) + 1
            for k, part in zip(new[np.r_[0, cuts]].tolist(), np.split(changed, cuts), strict=True):
                if k in index:
                    index[k].append(part)
                else:
                    index[k] = [part]
                    heapq.heappush(heap, k)
        live = sym >= 0
        count = np.cumsum(live)
        return np.split(sym[live], count[ends - 1][:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; special strings get their ids."""
        split: list[list[str]] = []
        fresh: dict[str, str] = {}  # of equal words one object stays
        same = fresh.setdefault
        for text in texts:
            parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
            split.append([same(x, x) for k, part in enumerate(parts) for x in ([part] if k % 2 else self.pattern.findall(part))])
        cache = self.cache
        if len(cache) > KEPT:
            cache.clear()
        todo = [w for w in fresh if w not in cache]
        for w in self.special:
            cache[w] = np.array([self.special[w]], np.int32).tobytes()
        todo = [w for w in todo if w not in self.special]
        if todo:
            cache.update(zip(todo, (x.tobytes() for x in self.encode_words([w.encode() for w in todo])), strict=True))
        return [np.frombuffer(b"".join(map(cache.__getitem__, parts)), np.int32) for parts in split]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def text_blocks(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text."""
    at, low = text_buffer(column)[1], 0
    while low < len(column):
        high = min(max(int(np.searchsorted(at, at[low] + limit, "right")) - 1, low + 1), len(column))
        yield low, high
        low = high


def _round_trip(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for low, high in text_blocks(batch.column(1), BLOCK):
                ids = bpe.encode([x or "" for x in batch.column(1).slice(low, high - low).to_pylist()])
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in ids])], pa.int32())
                decoded = pa.array([bpe.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(offsets, flat), decoded], names=["key", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, ids array<int>, decoded string for every row: the byte-level BPE ids of the text and the text decoded from them.

    A null or empty text has no ids and decodes to "". Null keys and repeated rows are kept. An empty table gives no rows. Other
    columns are not read. Special strings inside texts become their single ids and decode to themselves.
    """
    rows = bounded(docs).select(F.col(key).cast("long").alias("key"), F.col(text).alias("body"))
    return rows.mapInArrow(_round_trip(path or vocabulary_path()), "key long, ids array<int>, decoded string").withColumnRenamed("key", key)
