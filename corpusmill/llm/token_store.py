"""Token ids on disk: every document compressed by itself with one shared zstandard dictionary.

A store is a Parquet table of containers, so that Spark's commit protocol covers lost executors, and a dictionary beside it.
A container holds consecutive documents in ascending key order:

    magic "TKD1" | uint32 documents | uint8 bytes of an id | 32 bytes SHA-256 of the dictionary
    uint64 offsets[documents + 1] of the frames, from the end of the header
    int64 keys[documents] | uint32 ids[documents] | uint8 null key[documents] | frames

An offset and the dictionary are all that reading one document takes. Beside a container stand the least and greatest of its keys, so that
Parquet's statistics lead to the few containers that can hold a document. Ids are little-endian unsigned, two bytes where the vocabulary
allows it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.shared import bounded, shuffle_width
from corpusmill.llm.tokenizers_io import library, pieces, rank_encoder, vocabulary_path

MAGIC = b"TKD1"
#: Documents of a container, and bytes of frames after which one ends.
DOCS, BYTES = 64, 1 << 20
#: The dictionary is trained on pieces of at most SAMPLE_CHARS characters of at most SAMPLE documents, the least by a hash of key and text.
SAMPLE, SAMPLE_CHARS, DICTIONARY = 1500, 1 << 14, 1 << 16
#: A part of a text without a safe place to cut within so many characters goes to the tokenizers library.
PIECE = 1 << 16


def pack(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if width == 2 else "<u4")


def encode_text(text: str, path: str) -> np.ndarray:
    """The ids that the tokenizers library gives. The same vocabulary is read by a faster encoder, the library takes what that cannot:
    other kinds of vocabularies and long parts without a safe place to cut."""
    fast = rank_encoder(path)

    def one(part: str) -> np.ndarray:
        if fast is None or len(part) > 2 * PIECE:
            return np.array(library(path).encode(part, add_special_tokens=False).ids, np.uint32)
        return np.asarray(fast.encode_to_numpy(part, allowed_special="all", disallowed_special=()))

    return one(text) if len(text) <= PIECE else np.concatenate([one(p) for p in pieces(text, PIECE)])


def train_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """Dictionary bytes; empty where the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples, threads=0).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def build_container(keys: list[int | None], counts: list[int], frames: list[bytes], width: int, digest: bytes) -> bytes:
    n = len(keys)
    offsets = np.r_[0, np.cumsum([len(f) for f in frames])].astype("<u8")
    head = MAGIC + struct.pack("<IB", n, width) + digest
    return b"".join([head, offsets.tobytes(), np.array([k or 0 for k in keys], "<i8").tobytes(), np.array(counts, "<u4").tobytes(), np.array([k is None for k in keys], np.uint8).tobytes(), *frames])


class Container:
    """Random access to the documents of a container."""

    def __init__(self, blob: bytes, dictionary: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token container")
        self.n, self.width = struct.unpack_from("<IB", blob, 4)
        if blob[9:41] != hashlib.sha256(dictionary).digest():
            raise ValueError("the container was written with another dictionary")
        at = 41
        self.offsets = np.frombuffer(blob, "<u8", self.n + 1, at)
        at += 8 * (self.n + 1)
        keys = np.frombuffer(blob, "<i8", self.n, at)
        self.counts = np.frombuffer(blob, "<u4", self.n, at + 8 * self.n)
        nulls = np.frombuffer(blob, np.uint8, self.n, at + 12 * self.n)
        self.keys = [None if z else int(k) for k, z in zip(keys, nulls, strict=True)]
        self.start, self.blob = at + 13 * self.n, blob
        self.reader = decompressor(dictionary)

    def find(self, key: int) -> list[int]:
        """Places of the documents with this key."""
        return [k for k, x in enumerate(self.keys) if x == key]

    def ids(self, k: int) -> np.ndarray:
        a, b = (self.start + int(self.offsets[k + i]) for i in (0, 1))
        return unpack(self.reader.decompress(self.blob[a:b]), self.width)


_READERS: dict[bytes, zstandard.ZstdDecompressor] = {}


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    if dictionary not in _READERS:
        _READERS.clear()
        _READERS[dictionary] = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
    return _READERS[dictionary]


_CONTAINERS = "shard int, block int, tokens long, low long, high long, blob binary"


def _write(path: str, end_id: int, width: int, dictionary: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        writer = zstandard.ZstdCompressor(level=1, **more)
        digest, shard, number = hashlib.sha256(dictionary).digest(), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        counts: list[int] = []
        frames: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            there = [k for k in keys if k is not None]
            columns = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([sum(counts)], pa.int64()), pa.array([min(there, default=None)], pa.int64()), pa.array([max(there, default=None)], pa.int64()), pa.array([build_container(keys, counts, frames, width, digest)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _CONTAINERS.split(", ")])

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode_text(value.as_py() or "", path), np.uint32(end_id))
                frames.append(writer.compress(pack(ids, width)))
                keys.append(key)
                counts.append(len(ids))
                held += len(frames[-1])
                if len(keys) >= DOCS or held >= BYTES:
                    yield flush()
                    keys, counts, frames, held, number = [], [], [], 0, number + 1
        if keys:
            yield flush()

    return run


def write_store(docs: DataFrame, where: str, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = 2) -> None:
    """Write the token ids of every document, `end_id` appended, to the store at `where`, in ascending order of key, then text.

    Ids are those of the tokenizers library for the file at `path`. Documents are dealt by range of (key, hash of the text), so a
    repeated key is no hot one. Null keys come first; null texts count as empty and consist of the end id; repeated rows are all written.
    An empty table gives a store without containers. With too few texts to train a dictionary (fewer than 16 that are not empty) the
    frames have none, and the dictionary's table says so: its bytes are empty.
    """
    spark = docs.sparkSession
    path = path or vocabulary_path()
    size = library(path).get_vocab_size(with_added_tokens=True)
    width = 2 if max(size, end_id + 1) <= 1 << 16 else 4
    rows = bounded(docs).select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text)).alias("salt"), F.col(text).alias("body"))
    mark = F.xxhash64("key", "salt")
    picked = rows.where(F.length("body") > 0).select(mark.alias("mark")).distinct().orderBy("mark").limit(SAMPLE)
    # a piece of each text, from anywhere in it
    begin = F.pmod(F.col("mark"), F.greatest(F.length("body") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    texts = rows.withColumn("mark", mark).join(F.broadcast(picked), "mark").select("mark", F.substring("body", begin.cast("int"), F.lit(SAMPLE_CHARS)).alias("piece")).distinct().orderBy("mark", "piece").limit(SAMPLE)
    dictionary = train_dictionary([pack(encode_text(t, path), width) for t in texts.select("piece").toArrow().column(0).to_pylist()])
    spark.createDataFrame([(bytearray(dictionary), hashlib.sha256(dictionary).hexdigest(), path)], "dictionary binary, sha256 string, vocabulary string").coalesce(1).write.parquet(f"{where}/dictionary")
    dealt = rows.repartitionByRange(shuffle_width(spark), "key", "salt").sortWithinPartitions("key", "salt", "body").select("key", "body")
    dealt.mapInArrow(_write(path, end_id, width, dictionary), _CONTAINERS).write.option("compression", "none").parquet(f"{where}/containers")


def load_dictionary(spark: SparkSession, where: str) -> bytes:
    return bytes(spark.read.parquet(f"{where}/dictionary").first()["dictionary"])


def read_store(spark: SparkSession, where: str, per_document: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply per_document to (shard, block, position, key, ids) of every stored document; each container is checked and decoded once."""
    dictionary = load_dictionary(spark, where)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple]:
            for batch in batches:
                for shard, block, blob in zip(*(batch.column(k) for k in range(3)), strict=True):
                    c = Container(blob.as_buffer().to_pybytes(), dictionary)
                    for k in range(c.n):
                        yield shard.as_py(), block.as_py(), k, c.keys[k], c.ids(k)

        yield from per_document(every())

    return spark.read.parquet(f"{where}/containers").select("shard", "block", "blob").mapInArrow(run, schema)


def read_document(spark: SparkSession, where: str, key: int) -> list[np.ndarray]:
    """The ids of the documents with this key, in the store's order: of the containers only those whose bounds hold the key are
    read, and of these only the document's own frame is decompressed."""
    dictionary = load_dictionary(spark, where)
    found = spark.read.parquet(f"{where}/containers").where((F.col("low") <= key) & (F.col("high") >= key)).orderBy("shard", "block").select("blob")
    boxes = (Container(bytes(r["blob"]), dictionary) for r in found.toLocalIterator())
    return [box.ids(k) for box in boxes for k in box.find(key)]


def _checksums(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names, out, before, last = ("key", "shard", "block", "before", "n_tokens", "ids_crc32"), [], 0, None
    for shard, block, _, key, ids in rows:
        before = before if (shard, block) == last else 0
        last = (shard, block)
        out.append((key, shard, block, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        before += len(ids)
        if len(out) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)


def stored_offsets(spark: SparkSession, where: str) -> DataFrame:
    """key, start (ids of all documents before it in the store), n_tokens, ids_crc32, read back from the files.

    Sums run over containers within a shard and then over shards, whose number is that of the write's partitions.
    """
    table = spark.read.parquet(f"{where}/containers").select("shard", "block", "tokens")
    within = table.withColumn("in_shard", F.expr("sum(tokens) over (partition by shard order by block) - tokens"))
    shards = table.groupBy("shard").agg(F.sum("tokens").alias("total")).withColumn("ahead", F.expr("sum(total) over (order by shard) - total")).select("shard", "ahead")
    base = within.join(shards, "shard").select(F.col("shard").cast("long").alias("shard"), F.col("block").cast("long").alias("block"), (F.col("in_shard") + F.col("ahead")).alias("base"))
    rows = read_store(spark, where, _checksums, "key long, shard long, block long, before long, n_tokens long, ids_crc32 long")
    return rows.join(base, ["shard", "block"]).select("key", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
