"""Set-similarity self-join of texts on word n-grams: rare-first prefix filtering with length, positional and suffix filters.

Plan, all of it distributed:

1. One pass over the texts gives every text's n-gram set size and a 128-bit set signature. Texts with equal sets form a class; only
   classes are joined from here on, so copies never pair up with each other. The same pass sends the n-grams, packed and by ranges of
   their hashes, to one exact count of all of them; the number of ranges, and with it the width of the hashes, follows the number of
   shuffle partitions. The frequent n-grams go to a table of bounded size: of all frequencies the least that lets them fit is the cut.
2. A second pass orders each set by (frequency, hash), the rare-first order, n-grams below the cut first, and emits the prefix: with
   threshold t and set size n the n - ceil(t*n) + 1 first members. Two sets that reach t share a member of both prefixes.
3. n-grams in the prefix of one class only are dropped. For the others, first one pivot per n-gram is paired with the members (a
   star, linear in the list), after the length and positional filters, and each pair is verified.
4. Linked classes are contracted. What is left are pairs of components that share a prefix n-gram and pass the filters with the best of
   their members; pairs of classes are not listed. The members of the larger component, in parts, meet the classes of the smaller one.
   Connectivity is therefore exact although a group of near copies is never expanded into all its pairs.

Verification of two classes applies a suffix filter (a bound on the overlap by partition of the tails) and then counts the exact
intersection; that of a part of a component counts a class against all members of its length through one sorted list of their n-grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.graph import components
from corpusmill.llm.shared import bounded, discard, hot_join, materialize, shuffle_width
from corpusmill.llm.words import mix, shingles, words

#: Bits of a hash within its range; n-grams that a worker counts at once.
REST, CHUNK = 24, 1 << 21

#: Most n-grams of the frequency table, and most bits of its cells' numbers; a cell takes half a byte.
FREQUENT, CELL_BITS = 1 << 24, 27

#: A table of where texts go, up to this length and 48 bytes a row, is broadcast; its length is checked first, longer ones shuffle.
BROADCAST_ROWS = 1 << 17

#: Members of a component, and classes compared with them, in one run.
PART = 64


def set_identity(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit signatures of a set of hashes (a sum and an exclusive or of mixed members)."""
    m = mix(s ^ np.uint64(0xA5A5A5A5DEADBEEF))
    return int(m.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix(m + np.uint64(1))).astype(np.int64))


def need(na: int, nb: int, percent: int) -> int:
    """Least intersection with 100 * inter >= percent * union."""
    return -(-percent * (na + nb) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def ranges(width: int) -> int:
    """Number of ranges of hashes, in bits, for so many shuffle partitions."""
    return min(20, max(8, (8 * width - 1).bit_length()))


def level(count: np.ndarray) -> np.ndarray:
    """Frequencies of 2 and more as numbers from 1 to 15, in their order."""
    return np.minimum(15, np.ceil(np.log2(count))).astype(np.uint8)


def pack(rest: np.ndarray) -> bytes:
    """Ascending numbers below 2**24 as three planes of bytes of their differences."""
    step = np.diff(rest.astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    return step.view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(3, -1).astype(np.uint32)
    return np.cumsum(planes[0] | planes[1] << np.uint32(8) | planes[2] << np.uint32(16), dtype=np.uint32)


def _counted(grams: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(range, packed n-grams, counts of a byte each) of the n-grams given; a greater count stands in several entries."""
    code = np.sort(grams >> np.uint64(64 - bits - REST))
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    code, count = code[first], np.diff(np.r_[first, len(code)])
    times = (count + 254) // 255
    if times.max(initial=1) > 1:
        last = np.cumsum(times) - 1
        left = count - 255 * (times - 1)
        code, count = np.repeat(code, times), np.full(times.sum(), 255)
        count[last] = left
    cuts = np.searchsorted(code, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(REST))
    rest, count = (code & np.uint64((1 << REST) - 1)).astype(np.uint32), count.astype(np.uint8)
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        s = slice(cuts[r], cuts[r + 1])
        yield r, pack(rest[s]), count[s].tobytes()


def _profile(size: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ("row_key", "mark", "n", "s1", "s2", "range", "grams", "counts")

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        part: list[tuple[int, bytes, bytes]] = []
        for row in _counted(np.concatenate(held), bits):
            part.append(row)
            if len(part) == 512:
                yield ranged(part)
                part = []
        if part:
            yield ranged(part)

    def ranged(part: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        r, grams, counts = zip(*part, strict=True)
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(r), pa.int64()) for _ in range(5)), pa.array(r, pa.int32()), pa.array(grams, pa.binary()), pa.array(counts, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for low, high, h, at in words(batch.column(2)):
                for k in range(low, high):
                    s = shingles(h[at[k - low] : at[k - low + 1]], size)
                    if len(s):
                        held.append(s)
                        many += len(s)
                        rows.append((len(s), *set_identity(s)))
                    else:
                        rows.append((0, 0, 0))
                if many >= CHUNK:
                    yield from counted(held)
                    held, many = [], 0
            figures = [pa.array(x) for x in np.array(rows, np.int64).reshape(-1, 3).T.copy()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *figures, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.binary())], names=names)
        if held:
            yield from counted(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, grams, counts), those of a range together: the n-grams that occur twice or more, with their levels; in a last row how
    many have each level."""
    now, held, hist = None, [], np.zeros(16, np.int64)

    def done() -> pa.RecordBatch:
        rest = np.concatenate([unpack(g) for g, _ in held])
        count = np.concatenate([np.frombuffer(c, np.uint8) for _, c in held]).astype(np.int64)
        order = np.argsort(rest, kind="stable")
        rest, count = rest[order], count[order]
        first = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
        count, rest = np.add.reduceat(count, first), rest[first]
        more = count > 1
        levels = level(count[more])
        np.add.at(hist, levels, 1)
        return row(now, pack(rest[more]), levels.tobytes(), None)

    def row(*values) -> pa.RecordBatch:
        types = (pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["range", "grams", "levels", "hist"])

    for batch in batches:
        for r, g, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if r != now and held:
                yield done()
                held = []
            now = r
            held.append((g, c))
    if held:
        yield done()
        yield row(None, None, None, hist.tolist())


def _above(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, levels = [], []
            for g, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.frombuffer(x, np.uint8)
                grams.append(pack(unpack(g)[x >= least]))
                levels.append(x[x >= least].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary()), pa.array(levels, pa.binary())], names=["range", "grams", "levels"])

    return run


def frequent(counts: DataFrame) -> np.ndarray:
    """The table of the frequent n-grams: levels by the last bits of their codes, two a byte, 0 for the others. counts: range, grams, counts.

    At most FREQUENT n-grams come to the driver, 4 bytes each; the least level taken is the first one with which they are so few.
    """
    spark = counts.sparkSession
    merged = counts.repartition(shuffle_width(spark), "range").sortWithinPartitions("range").mapInArrow(_merge, "range int, grams binary, levels binary, hist array<long>")
    merged = materialize(merged, "frequencies")
    hist = np.zeros(17, np.int64)
    for level_, many in merged.where("hist is not null").select(F.posexplode("hist")).groupBy("pos").agg(F.sum("col")).collect():  # 16 rows
        hist[level_] = many
    above = np.cumsum(hist[::-1])[::-1]
    least = max(1, int(np.argmax(above <= FREQUENT)))
    got = merged.where("range is not null").select("range", "grams", "levels").mapInArrow(_above(least), "range int, grams binary, levels binary").toArrow()
    cells = np.zeros(1 << min(CELL_BITS, max(12, int(8 * above[least]).bit_length())) - 1, np.uint8)
    for r, g, x in zip(*(got.column(k) for k in range(3)), strict=True):
        x = np.frombuffer(x.as_buffer(), np.uint8)
        order = np.argsort(x, kind="stable")  # of several in a cell the greatest is written last
        at = ((unpack(g.as_buffer()).astype(np.int64) | r.as_py() << REST) & (2 * len(cells) - 1))[order]
        for half, keep in ((0, 0xF0), (1, 0x0F)):
            mine = (at & 1) == half
            now = cells[at[mine] >> 1]
            cells[at[mine] >> 1] = now & keep | np.maximum(now >> 4 * half & 15, x[order][mine]) << 4 * half
    discard(merged)
    return cells


def levels_of(cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = (codes & np.uint64(2 * len(cells) - 1)).astype(np.int64)
    return cells[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & 15


def _prefixes(size: int, percent: int, bits: int, table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = table.value, set()
        shift = np.uint64(64 - bits - REST)
        for batch in batches:
            for low, high, h, at in words(batch.column(0)):
                parts: list[list[np.ndarray]] = []
                for k in range(low, high):
                    s = shingles(h[at[k - low] : at[k - low + 1]], size)
                    if not len(s) or (cls := set_identity(s)[0]) in seen:
                        continue
                    seen.add(cls)
                    if len(seen) > 1 << 17:
                        seen.clear()
                    p = prefix_length(len(s), percent)
                    top = np.lexsort((s, levels_of(cells, s >> shift)))[:p]
                    parts.append([s[top].view(np.int64), np.full(p, cls), np.full(p, len(s), np.int32), np.arange(p, dtype=np.int32)])
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["gram", "cls", "n", "pos"])

    return run


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """Upper bound of the intersection of two sorted arrays: split both at a median and add the smaller part sizes."""
    if not depth or len(x) < 8 or len(y) < 8:
        return min(len(x), len(y))
    pivot = x[len(x) // 2]
    i, j = np.searchsorted(x, pivot), np.searchsorted(y, pivot)
    return suffix_bound(x[:i], y[:j], depth - 1) + suffix_bound(x[i:], y[j:], depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets reach the threshold: lengths, the suffix filter, then the count."""
    least = need(len(x), len(y), percent)
    if min(len(x), len(y)) < least or suffix_bound(x, y) < least:
        return False
    both = np.concatenate((x, y))
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= least


class Members:
    """Sets of a part of a component, under one sorted list of their n-grams."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent, self.n = sets, percent, np.array([len(s) for s in sets])
        if len(sets) > 1:
            grams = np.concatenate(sets)
            order = np.argsort(grams, kind="stable")
            self.grams, self.owner = grams[order], np.repeat(np.arange(len(sets)), self.n)[order]

    def links(self, y: np.ndarray) -> np.ndarray:
        """Numbers of the members that y links with."""
        if len(self.sets) == 1:
            return np.arange(int(linked(self.sets[0], y, self.percent)))
        low, high = np.searchsorted(self.grams, y, "left"), np.searchsorted(self.grams, y, "right")
        many = high - low
        at = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        inter = np.bincount(self.owner[at], minlength=len(self.n))
        return np.flatnonzero(100 * inter >= self.percent * (self.n + len(y) - inter))


def _verify(size: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (host, part, salt, role, cls, body) in this order: the texts of a part of a host (role 0) stand before its guests' (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, sets, members, last = None, [], [], None, None
        for batch in batches:
            host, part, salt, role, cls = (batch.column(k).to_pylist() for k in range(5))
            out = []
            for low, high, h, at in words(batch.column(5)):
                for k in range(low, high):
                    here = (host[k], part[k], salt[k])
                    if (here, role[k], cls[k]) == last:
                        continue  # rows without a key may come more than once
                    s = shingles(h[at[k - low] : at[k - low + 1]], size)
                    if not len(s) or set_identity(s)[0] != cls[k]:
                        continue  # another text under the same key and hash
                    last = (here, role[k], cls[k])
                    if unit != here:
                        unit, ids, sets, members = here, [], [], None
                    if role[k] == 0:
                        ids.append(cls[k])
                        sets.append(s)
                    elif sets:
                        members = members or Members(sets, percent)
                        out += [(ids[m], cls[k]) for m in members.links(s).tolist()]
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _close(percent: int):
    """Length filter, and positional filter on one shared prefix member: what may be shared before it, itself, and the shorter rest.

    x and y hold of one or more classes the least and greatest set size (n, most), the greatest number of members before (m) and after (rest).
    """
    lengths = (100 * F.col("x.most") >= percent * F.col("y.n")) & (100 * F.col("y.most") >= percent * F.col("x.n"))
    bound = F.least("x.m", "y.m") + 1 + F.least("x.rest", "y.rest")
    return lengths & (bound * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n")))


def _candidates(posts: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of components that share an n-gram and pass the filters. posts: gram, comp, single, n, pos, m.

    single, of a pair: both components are of one class. One row an n-gram and component is paired, with the best figures of its members. For two components of one class each, every common
    member up to the last shared prefix one is counted, and bounds the overlap once more.
    """
    sides = posts.groupBy("gram", "comp").agg(F.min("single").alias("single"), F.min("n").alias("n"), F.max("n").alias("most"), F.max("m").alias("m"), F.max(F.col("n") - F.col("pos") - 1).alias("rest"))
    side = F.struct("single", "n", "most", "m", "rest")
    sides = sides.withColumn("lists", F.expr("count(1) over (partition by gram)")).where("lists > 1")  # the others give no pairs
    sides = materialize(sides.drop("lists"), "sides")
    left, right = sides.select("gram", F.col("comp").alias("a"), side.alias("x")), sides.select("gram", F.col("comp").alias("b"), side.alias("y"))
    met = left.join(right, "gram").where((F.col("a") < F.col("b")) & _close(percent))
    shared = met.groupBy("a", "b").agg(F.count("*").alias("k"), F.min(F.col("x.single") & F.col("y.single")).alias("single"), F.max("x.n").alias("na"), F.max("y.n").alias("nb"), F.min("x.rest").alias("ra"), F.min("y.rest").alias("rb"))
    bound = F.col("k") + F.least("ra", "rb")
    return shared.where(~F.col("single") | (bound * (100 + percent) >= percent * (F.col("na") + F.col("nb")))).select("a", "b", "single")


def _parts(number: str) -> Column:
    return F.ceil(F.col(number) / PART).cast("int")


def _among(cls: str, parts: str) -> Column:
    return F.pmod(F.xxhash64(cls), F.col(parts)).cast("int")


def ngram_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """Groups of texts linked by 100 * |A & B| >= percent * |A | B| over distinct word n-grams.

    docs: `key` an integer column, `text` a string column; other columns are not read, whatever their names.
    Returns key, n_shingles, component (least key reachable by links, itself included), mark (xxhash64 of the text): one row per input row.

    Null and empty texts and texts without words have no n-grams, link with nothing and are their own component. Texts with fewer
    words than `size` have one n-gram, the whole sequence. Rows that repeat a key each return a row and count as one node. Rows with a null
    key link like others; their component is null if no keyed row is reachable. An empty table gives no rows. The jobs run when
    this is called.
    """
    spark = docs.sparkSession
    bits = ranges(shuffle_width(spark))
    base = bounded(docs).select(F.col(key).cast("long").alias("row_key"), F.col(text).alias("body"))
    base = base.select("row_key", F.xxhash64("body").alias("mark"), "body")
    found = base.mapInArrow(_profile(size, bits), "row_key long, mark long, n long, s1 long, s2 long, range int, grams binary, counts binary")
    table = materialize(found.withColumn("kind", F.when(F.col("range").isNull(), "rows").otherwise("counts")), "profile", "kind")
    shared = spark.sparkContext.broadcast(frequent(table.where("kind = 'counts'").select("range", "grams", "counts")))
    discard(table, "kind=counts")
    rows = table.where("kind = 'rows'").select("row_key", "mark", "n", "s1", "s2")
    # the text of a class is that of its row with the least key, or of any row where none has a key
    first = F.min(F.struct(F.col("row_key").isNull().alias("no_key"), "row_key", "mark"))
    sets = rows.where("n > 0").groupBy("s1", "s2", "n").agg(first.alias("first")).select("s1", "s2", "n", F.col("first.row_key").alias("rep"), F.col("first.mark").alias("mark"))
    reps = sets.groupBy(F.col("s1").alias("cls")).agg(F.min(F.struct(F.col("rep").isNull(), "rep", "mark")).alias("r")).select("cls", F.col("r.rep").alias("rep"), F.col("r.mark").alias("rep_mark"))

    posts = base.select("body").mapInArrow(_prefixes(size, percent, bits, shared), "gram long, cls long, n int, pos int")
    posts = posts.repartition(shuffle_width(spark), "gram").dropDuplicates(["gram", "cls"])
    posts = posts.withColumn("lists", F.expr("count(1) over (partition by gram)")).where("lists > 1").drop("lists")
    # m: members of the same prefix before this one that are in shared lists, the only ones that a partner can have
    posts = posts.selectExpr("gram", "cls", "n", "pos", "row_number() over (partition by cls order by pos) - 1 as m", "count(1) over (partition by cls) as held")
    posts = materialize(posts, "postings")
    shared.destroy()

    def verified(pairs: DataFrame, members: DataFrame | None = None) -> DataFrame:
        """Linked classes a, b among the pairs (a, b) of groups. members: grp, cls of groups of several classes; others are classes themselves.

        Of a pair the larger group, or the one in more pairs, is the host. Its classes, in parts of about PART, meet the guests' classes, in
        runs of about PART; every text goes to the runs that need it, once.
        """
        degree = pairs.select(F.explode(F.array("a", "b")).alias("grp")).groupBy("grp").agg(F.count("*").alias("deg"))
        if members is None:
            degree = degree.withColumn("size", F.lit(1).cast("long"))
        else:
            sizes = members.groupBy("grp").agg(F.count("*").alias("size"))
            degree = degree.join(sizes, "grp", "left").withColumn("size", F.coalesce("size", F.lit(1)))
        degree = materialize(degree, "degrees")
        sided = pairs
        for side in ("a", "b"):
            sided = hot_join(sided, degree.select(F.col("grp").alias(side), F.struct("size", "deg", F.col("grp").alias("id")).alias(f"w{side}")), side)
        sided = materialize(sided.select(F.greatest("wa", "wb").alias("h"), F.least("wa", "wb").alias("g")).select(F.col("h.id").alias("host"), F.col("h.size").alias("size"), F.col("g.id").alias("guest"), F.col("g.size").alias("guests")), "sided")
        hosts = sided.groupBy("host").agg(F.max("size").alias("size"), F.sum("guests").alias("guests")).select("host", _parts("size").alias("parts"), _parts("guests").alias("salts"))
        hosts = materialize(hosts, "hosts")
        calls = hot_join(sided.select("host", "guest"), hosts, "host")
        inside = hosts
        if members is None:
            calls, inside = calls.withColumn("cls", F.col("guest")), inside.withColumn("cls", F.col("host"))
        else:
            calls = calls.join(members.withColumnRenamed("grp", "guest"), "guest", "left").withColumn("cls", F.coalesce("cls", "guest"))
            several = hot_join(members.withColumnRenamed("grp", "host"), hosts, "host")
            inside = several.unionByName(hosts.join(members.select(F.col("grp").alias("host")).distinct(), "host", "left_anti").withColumn("cls", F.col("host")))
        guests = calls.select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), _among("cls", "salts").alias("salt"), F.lit(1).alias("role"), "cls")
        inside = inside.select("host", _among("cls", "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), "cls")
        routes = materialize(guests.unionByName(inside).join(reps, "cls").select("host", "part", "salt", "role", "cls", "rep", "rep_mark"), "routes")
        few = routes.count() <= BROADCAST_ROWS  # its size is known here; beyond the bound the join shuffles
        texts = base.join(F.broadcast(routes) if few else routes, base.row_key.eqNullSafe(routes.rep) & (base.mark == routes.rep_mark)).select("host", "part", "salt", "role", "cls", "body")
        dealt = texts.repartition(shuffle_width(spark), "host", "part", "salt").sortWithinPartitions("host", "part", "salt", "role", "cls")
        out = materialize(dealt.mapInArrow(_verify(size, percent), "a long, b long").distinct(), "verified")
        for t in (degree, sided, hosts, routes):
            discard(t)
        return out

    # The pivot of an n-gram is the member with most of its prefix in shared lists: an original rather than an edited copy.
    full = F.col("held") / (F.col("n") - F.expr(f"cast(ceil({percent} * n / 100.0) as int)") + 1)
    side = F.struct("cls", "n", F.col("n").alias("most"), "m", (F.col("n") - F.col("pos") - 1).alias("rest"))
    pivots = posts.groupBy("gram").agg(F.max(F.struct(full.alias("f"), (-F.col("cls")).alias("c"), side.alias("y"))).alias("p")).select("gram", "p.y")
    star = posts.select("gram", side.alias("x")).join(pivots, "gram").where((F.col("x.cls") != F.col("y.cls")) & _close(percent))
    star = materialize(star.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct(), "pairs")
    links = verified(star)
    comp = materialize(components(links), "stars")

    tagged = posts.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("gram", F.coalesce("component", "cls").alias("comp"), F.col("component").isNull().alias("single"), "n", "pos", "m")
    tried = star.withColumn("single", F.lit(True))  # pairs of classes that were compared above
    across = materialize(_candidates(tagged, percent).join(tried, ["a", "b", "single"], "left_anti").select("a", "b"), "pairs")
    more = verified(across, comp.select(F.col("component").alias("grp"), F.col("node").alias("cls")))
    comp = materialize(components(links.union(more)), "classes")
    for t in (posts, star, across):
        discard(t)

    joined = sets.withColumnRenamed("s1", "cls").join(comp.withColumnRenamed("node", "cls"), "cls", "left").select(F.col("cls").alias("c1"), F.col("s2").alias("c2"), F.col("n").alias("c_n"), "rep", F.coalesce("component", "cls").alias("grp"))
    joined = materialize(joined, "groups")
    ids = hot_join(joined, joined.groupBy("grp").agg(F.min("rep").alias("component")), "grp").select("c1", "c2", "c_n", "component")
    alone = rows.where("n = 0").select("row_key", "n", F.col("row_key").alias("component"), "mark")
    full_rows = rows.where("n > 0").join(ids, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n") == F.col("c_n"))).select("row_key", "n", "component", "mark")
    return full_rows.union(alone).select(F.col("row_key").alias(key), F.col("n").alias("n_shingles"), "component", "mark")
