"""Streaming forms: synchronising an index by micro-batches, and the login limiter as a fold over an event log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators.index import FIELDS, synchronise


def sync_stream(chunks: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame], None], embed, checkpoint: str, fields: list[str] = FIELDS, **trigger) -> StreamingQuery:
    """Keep an index in step with a stream of chunk payloads: each micro-batch replaces the documents it holds.

    load returns the stored points, store writes the next state (to another place than load's until it is complete). A batch that is
    replayed after a failure gives the same state. trigger: as for DataStreamWriter.trigger.
    """

    def step(batch: DataFrame, _: int) -> None:
        stored = load()
        touched = batch.select("doc_id").distinct()
        rest = stored.join(touched, "doc_id", "left_anti")
        fresh = synchronise(batch, stored.join(touched, "doc_id", "left_semi"), embed, fields)
        store(rest.unionByName(fresh.select(rest.columns)))

    writer = chunks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and type; works on a stream and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")) if events.isStreaming else events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def fold_in_order(rows: DataFrame, key: str, order: list[str], carry: list[str], schema: str, start: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple | None]], end: Callable[[object, object], tuple | None] = lambda key, state: None) -> DataFrame:
    """A fold over each key's rows in order, in memory for one state: rows stream through a task sorted by key.

    step takes the state and a row's carried columns and returns the next state and what to emit, or None; end what to emit of a key and
    its last state. The rows of a key are read in one task, one after another, but never held together.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False
        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for k, *row in zip(*columns, strict=True):
                if not begun or k != now:
                    if begun and (last := end(now, state)) is not None:
                        out.append(last)
                    now, state, begun = k, start(), True
                state, emitted = step(state, tuple(row))
                if emitted is not None:
                    out.append(emitted)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out])
        if begun and (last := end(now, state)) is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, last, strict=True))])

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartition(width, key).sortWithinPartitions(key, *order).select(key, *carry)
    return sorted_rows.mapInArrow(run, schema)


def limit_attempts(attempts: DataFrame, most: int = 5, seconds: int = 900) -> DataFrame:
    """event_id, allowed for attempts (event_id, key, at in seconds): a key's window begins with its first attempt and admits `most`.

    A window ends `seconds` after its beginning; the next attempt begins another. State is one pair a key; a key's attempts are read in order.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        (begin, n), (event, at) = state, row
        begin, n = (at, 1) if begin is None or at >= begin + seconds else (begin, n + 1)
        return (begin, n), (event, n <= most)

    return fold_in_order(attempts, "key", ["at", "event_id"], ["event_id", "at"], "event_id long, allowed boolean", lambda: (None, 0), step)
