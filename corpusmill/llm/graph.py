"""Connected components of an undirected graph given as an edge table, without gathering it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import discard, hot_join, materialize

#: Nodes that a task holds while it shrinks its edges.
HELD = 1 << 20


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of one partition by (node, least node it reaches) pairs, a flat forest; one of HELD nodes makes room for the next."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def flat() -> Iterator[pa.RecordBatch]:
        nodes = list(up)
        for k in range(0, len(nodes), 1 << 16):
            part = nodes[k : k + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"u": pa.array(part, pa.int64()), "v": pa.array([root(x) for x in part], pa.int64())})
        up.clear()

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > HELD:
            yield from flat()
    yield from flat()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node long, component long): for every node of an edge its component's least node.

    edges: two long columns. Self loops and repeats are allowed; rows with a null end are left out; no edges give no rows.
    Each partition first shrinks its edges to a flat forest, then large-star and small-star rounds (Kiveris et al., 2014)
    run until every node points at its least one. Minima are aggregated before the shuffle, and the edges of hot nodes meet them in a
    broadcast, so a hot node costs no more than others. The rounds run when this is called.
    """
    a, b = edges.columns[:2]
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    now = materialize(edges.mapInArrow(_forest, "u long, v long").where("u <> v").distinct(), "cc")
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = materialize(hot_join(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")  # u > v
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: a node hands its neighbours below it, and itself, to the least of them
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        nxt = materialize(small, "cc")
        heads = nxt.select(F.col("v").alias("u")).distinct()
        loose = nxt.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u").union(nxt.join(heads, "u", "left_semi").select("u")).limit(1).count()
        discard(now)
        discard(large)
        now = nxt
        if not loose:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
