"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame operations alone.

The documents of a source, in an order shuffled by hash, form a stream of words that may be passed twice. The stream is cut into blocks of
equal length. Slot t of the schedule takes the point frac(t * golden ratio); the source whose interval of the cumulative weights
holds the point owns the slot, and the k-th slot of a source reads the k-th block of its stream, until the source's target is
reached. What the mix takes of a source is fixed by its target; the schedule says when. A document comes where the first of its blocks comes,
in each pass. Ranks within a source and places within a stream are sums over groups of bounded size first, and over the groups
then, so a source with a third of all rows is not one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import materialize, shuffle_width

#: Words of a block; hash groups of a source's documents, at least; slots of a group of the schedule.
BLOCK, GROUPS, CHUNK = 128, 4096, 4096
GOLDEN = 0.6180339887498949
#: Fraction of 2**20 times the golden ratio's fraction, so that points keep their precision at any slot.
GOLDEN_STEP = 0.6077874097403510
#: Cells of the unit interval by which a point finds its source; most sources whose table is broadcast.
CELLS, BROADCAST_SOURCES = 1024, 1 << 16

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blanks and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, weight, target for a table of one row per source (source, source_size).

    Weights repeat over the sources in code point order, null last. Sources share `share` of all sizes by weight; a target stops at
    `most` times its source's size, and the excess goes to the others by weight, until none is above. In closed form: with sources
    ordered by size per weight, the capped ones are a prefix of that order, and the rest share what is left.
    """
    # UTF-8 byte order is code point order; the number of rows is that of the sources
    order = sizes.withColumn("k", F.expr("row_number() over (order by source is null, cast(source as binary))") - 1)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("k") % len(weights) + 1).cast("int"))
    rows = order.withColumn("weight", w).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = "(order by ratio, k rows between unbounded preceding and 1 preceding)"
    rows = rows.withColumn("capped", F.expr(f"coalesce(sum(cap) over {before}, 0D)")).withColumn("used", F.expr(f"coalesce(sum(weight) over {before}, 0D)"))
    rows = rows.withColumn("total", F.expr("sum(source_size) over ()") * share).withColumn("weights", F.expr("sum(weight) over ()"))
    # a source is capped if its cap is at most its part of what the sources before it leave
    level = (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("used"))
    rows = rows.withColumn("level", level).withColumn("is_capped", F.col("ratio") <= F.col("level"))
    rows = rows.withColumn("rest", F.expr("min(case when not is_capped then struct(ratio, k, level) end) over ()")["level"])
    target = F.when(F.col("is_capped"), F.col("cap")).otherwise(F.col("weight") * F.col("rest"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _placed(rows: DataFrame) -> DataFrame:
    """rows with `start`, the words before the document in its source's stream. rows: source, size, mark, copy."""
    groups = max(GROUPS, 16 * shuffle_width(rows.sparkSession))  # follows the cluster's partitions
    rows = rows.withColumn("part", F.pmod(F.col("mark"), F.lit(groups)).cast("int"))
    rows = rows.withColumn("within", F.expr("sum(size) over (partition by source, part order by mark, copy rows between unbounded preceding and current row) - size"))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.withColumn("ahead", F.expr("sum(part_size) over (partition by source order by part rows between unbounded preceding and current row) - part_size"))
    p = parts.select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), "ahead")
    return rows.join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part"))).withColumn("start", F.col("within") + F.col("ahead")).drop("p_source", "p_part", "ahead", "within")


def point(slot: Column) -> Column:
    """frac(slot * golden ratio), in two steps."""
    far, near = F.floor(slot / (1 << 20)) * F.lit(GOLDEN_STEP), slot % (1 << 20) * F.lit(GOLDEN)
    x = far - F.floor(far) + near
    return x - F.floor(x)


def schedule(plan: DataFrame, n_slots: int, n_sources: int, block: int = BLOCK) -> DataFrame:
    """slot, source, block (rank of the slot in its source), tokens: the slots of the mix in order.

    plan: targets() with `goal`, the whole words to take. Slots beyond a source's goal are void and left out. Sources that the
    points left short, by a few slots at most, get their last blocks at the end, from slot n_slots on.
    """
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda df: df)
    ranged = plan.where("goal > 0").withColumn("k", F.expr("row_number() over (order by source is null, cast(source as binary))"))
    ranged = ranged.withColumn("high", F.expr("sum(goal) over (order by k)") / F.expr("sum(goal) over ()")).withColumn("low", F.expr("coalesce(lag(high) over (order by k), 0D)"))
    cells = ranged.select("k", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    slots = plan.sparkSession.range(n_slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("point")).withColumn("cell", F.floor(F.col("point") * CELLS))
    slots = slots.join(small(cells), "cell").where("point >= low and point < high").select("slot", "k")
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / CHUNK)).withColumn("inner", F.expr("row_number() over (partition by k, chunk order by slot) - 1"))
    counts = slots.groupBy("k", "chunk").agg(F.count("*").alias("n")).withColumn("ahead", F.expr("sum(n) over (partition by k order by chunk) - n"))
    ranked = slots.join(counts.select("k", "chunk", "ahead"), ["k", "chunk"]).select("slot", "k", (F.col("ahead") + F.col("inner")).alias("block"))
    have = counts.groupBy("k").agg(F.sum("n").alias("have"))
    short = ranged.select("k", F.ceil(F.col("goal") / block).alias("wanted")).join(have, "k", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < wanted")
    tail = short.select("k", F.explode(F.sequence(F.col("have"), F.col("wanted") - 1)).alias("block")).select((F.lit(n_slots) + F.col("block")).alias("slot"), "k", "block")
    every = ranked.unionByName(tail).join(small(ranged.select("k", "source", "goal")), "k").where(F.col("block") * block < F.col("goal"))
    return every.select("slot", "source", "block", F.least(F.lit(block), F.col("goal") - F.col("block") * block).alias("tokens"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK) -> DataFrame:
    """key, body, source, size, source_size, target, taken, passes, slots, first_slot, second_slot for every row of docs: what the mix takes of it.

    body: hash of the text. size: words of the text, 0 for null and empty texts. taken: words of the document in the scheduled blocks,
    those of a second pass counted again; passes: in how many passes any of it, or a document without words where it stands, is
    taken; slots: how many slots of the schedule hold any of it; first_slot, second_slot: the first of them in either pass, or null. The
    taken words of a source add up to its target, rounded down. `most` is at most 2. A null source is a source like others,
    the last. Repeated rows and null keys count as documents of their own. Equal tables give equal results whatever their order.
    An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("body"))
    # repeated rows are told apart by their rank among equals
    rows = rows.withColumn("copy", F.expr("row_number() over (partition by key, source, body, size order by key)"))
    rows = materialize(rows.withColumn("mark", F.xxhash64("key", "body", "copy")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialize(targets(sizes, weights, share, most).withColumn("goal", F.floor(F.col("target") + 1e-9).cast("long")), "mix-plan")
    total, n_sources = plan.agg(F.coalesce(F.sum("goal"), F.lit(0)), F.count("*")).first()
    slots = schedule(plan, -(-int(total) // block) + 2 * n_sources, n_sources, block)
    p = plan.select(F.col("source").alias("p_source"), "source_size", "target", "goal")
    placed = _placed(rows).join(F.broadcast(p) if n_sources <= BROADCAST_SOURCES else p, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    placed = placed.withColumn("passes", (F.col("start") < F.col("goal")).cast("int") + (F.col("start") + F.col("source_size") < F.col("goal")).cast("int"))
    placed = materialize(placed, "mix-placed")
    keys = ["key", "body", "copy", "source", "size", "source_size", "target", "passes"]
    # the documents' words in both passes are runs of the doubled stream; each meets the blocks it touches, one without words that where it stands
    runs = placed.where("passes > 0").select(*keys, "start", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"))
    runs = runs.withColumn("a", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("b", F.col("a") + F.col("size"))
    runs = runs.select(*keys, "pass", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor(F.greatest(F.col("a"), F.col("b") - 1) / block))).alias("block"))
    s = slots.select(F.col("source").alias("s_source"), F.col("block").alias("s_block"), "tokens", "slot")
    met = runs.join(s, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("block") == F.col("s_block")))
    part = F.least(F.col("b"), F.col("block") * block + F.col("tokens")) - F.greatest(F.col("a"), F.col("block") * block)
    of_pass = [F.min(F.when(F.col("pass") == k, F.col("slot"))).alias(name) for k, name in enumerate(("first_slot", "second_slot"))]
    taken = met.groupBy(*keys).agg(F.sum(F.greatest(part, F.lit(0))).alias("taken"), F.count("*").alias("slots"), *of_pass)
    rest = placed.where("passes = 0").select(*keys, *(F.lit(k).cast("long").alias(n) for n, k in (("taken", 0), ("slots", 0), ("first_slot", None), ("second_slot", None))))
    out = taken.unionByName(rest)
    return out.select(F.col("key").alias(key), "body", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "passes", "slots", "first_slot", "second_slot")


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of docs, all columns, once for each pass in which the mix takes any of the document, in the order of the schedule's slots.

    Rows that the mix does not take are left out. Null keys, sources and texts, repeated rows and empty texts are treated as in mix(); an
    empty table gives no rows; columns may have any names.
    """
    plan = mix(docs, key, text, source, **options).where("passes > 0")
    plan = plan.select(F.col(key).cast("long").alias("__key"), F.col("body").alias("__body"), F.col("source").alias("__source"), "passes", "first_slot", "second_slot")
    # equal rows are alike: the n-th of them takes the n-th greatest number of passes
    plan = plan.withColumn("__copy", F.expr("row_number() over (partition by __key, __source, __body order by passes desc, first_slot)"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select("row", F.col(f"row.`{key}`").cast("long").alias("k"), F.col(f"row.`{source}`").cast("string").alias("s"), F.xxhash64(f"row.`{text}`").alias("b"))
    rows = rows.withColumn("c", F.expr("row_number() over (partition by k, s, b order by k)"))
    met = rows.join(plan, F.col("k").eqNullSafe(F.col("__key")) & F.col("s").eqNullSafe(F.col("__source")) & (F.col("b") == F.col("__body")) & (F.col("c") == F.col("__copy")))
    passed = met.select("row", "k", F.explode(F.slice(F.array("first_slot", "second_slot"), F.lit(1), F.col("passes"))).alias("slot"))
    ordered = passed.repartitionByRange(shuffle_width(docs.sparkSession), "slot", "k").sortWithinPartitions("slot", "k")
    return ordered.select("row.*")
