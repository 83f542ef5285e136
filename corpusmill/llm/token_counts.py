"""Token counts: batches of about equal bytes, encoded by the library, of which only lengths are kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import bounded
from corpusmill.llm.tokenizers_io import library, pieces, vocabulary_path
from corpusmill.llm.words import text_buffer

#: Characters of a part of a long text, and bytes of a batch handed to the library.
PIECE, BATCH = 1 << 16, 1 << 20


def _lengths(path: str) -> Callable[[list[str]], list[int]]:
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    lib = library(path)
    return lambda texts: [len(x) for x in lib.encode_batch_fast(texts, add_special_tokens=False)]


def _count(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, cut = _lengths(path), not path.endswith(".model")
        for batch in batches:
            column = batch.column(1)
            n_bytes = np.diff(text_buffer(column)[1])
            n_tokens = np.zeros(len(column), np.int64)
            rows: list[int] = []
            texts: list[str] = []
            held = 0.0
            for k, value in enumerate(column):
                text = value.as_py() or ""
                wide = n_bytes[k] / max(len(text), 1)  # bytes a character
                for part in pieces(text, PIECE) if cut else [text]:
                    rows.append(k)
                    texts.append(part)
                    held += wide * len(part)
                    if held >= BATCH:
                        np.add.at(n_tokens, rows, lengths(texts))
                        rows, texts, held = [], [], 0.0
            if texts:
                np.add.at(n_tokens, rows, lengths(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens)], names=["key", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, limit: int = 1024) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for every row of docs; path: a tokenizers .json or a sentencepiece .model file.

    Texts longer than PIECE are cut at white space after a non-space character, where no byte-level token can cross (sentencepiece
    texts stay whole). A null text counts as empty: 0 bytes, 0 tokens. Null keys and repeated rows are kept as they are. An empty
    table gives no rows. Other columns are not read.
    """
    rows = bounded(docs).select(F.col(key).cast("long").alias("key"), F.col(text).alias("body"))
    out = rows.mapInArrow(_count(path or vocabulary_path()), "key long, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
