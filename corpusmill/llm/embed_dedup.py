"""Near-duplicate vectors of equal label by cosine: PCA-ordered tiled comparison with suffix-norm bounds.

Equal vectors of a label form a class, counted once. Classes are rotated to the principal axes of all vectors, ordered by variance, and
laid in blocks along a curve through the leading axes. Two blocks meet in a task only if their boxes on the leading axes are close enough
for the threshold; a block is as large as memory allows, so a vector goes to few tasks. In the task, blocks are cut into tiles; two tiles
whose centres are further apart than their radii and the threshold allow are passed over. For the rest, products are added up over
leading axes; what the other axes can add is at most the product of the suffix norms, so a pair is dropped as soon as that cannot
lift it to the threshold. What is left is decided by the cosine of the original vectors in double precision. A task returns its classes'
numbers of partners and a forest of their links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.graph import components
from corpusmill.llm.shared import bounded, materialize

#: Vectors of a tile, axes added at a time, and slack for rounding in the bounds.
TILE, STEP, SLACK = 512, 16, 1e-9
#: Components of a block's vectors, together (8 bytes each in a task), and least vectors of a block.
BLOCK, LEAST = 1 << 20, 512
#: Leading axes of the curve and bits of each; leading axes of a block's box.
CURVE, CURVE_BITS, LEAD = 4, 4, 8


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_width(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vector in the batch."""
    column = batch.column(at)
    widths = np.asarray(pc.list_value_length(column))
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        yield rows, _matrix(column.take(pa.array(rows)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in _by_width(batch, 0):
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            d = x.shape[1]
            sums.setdefault(d, np.zeros(d * d + d + 1))
            sums[d] += np.r_[(x.T @ x).ravel(), x.sum(0), len(x)]
    for d, total in sums.items():
        yield pa.RecordBatch.from_pydict({"d": pa.array(np.full(len(total), d), pa.int32()), "pos": pa.array(np.arange(len(total)), pa.int32()), "value": pa.array(total)})


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector, the axes as columns by descending variance of the unit vectors. vectors: one array column."""
    got = vectors.mapInArrow(_moments, "d int, pos int, value double").groupBy("d", "pos").agg(F.sum("value").alias("value")).toArrow()
    out = {}
    for d in set(got.column("d").to_pylist()):
        part = got.filter(pc.equal(got.column("d"), d))
        flat = np.zeros(d * d + d + 1)
        flat[part.column("pos").to_numpy()] = part.column("value").to_numpy()
        mean = flat[d * d : -1] / flat[-1]
        _, axes = np.linalg.eigh(flat[: d * d].reshape(d, d) / flat[-1] - np.outer(mean, mean))
        out[d] = axes[:, ::-1].copy()
    return out


def _leading(axes: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the projections of the unit vectors on the leading axes, and their place on the curve (bits of the axes in turn)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, curve = np.zeros((batch.num_rows, LEAD)), np.zeros(batch.num_rows, np.int32)
            for rows, x in _by_width(batch, batch.schema.get_field_index("vec")):
                p = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes[x.shape[1]][:, :LEAD]
                lead[rows, : p.shape[1]] = p
            cell = np.clip((lead[:, :CURVE] + 1) / 2 * (4 << CURVE_BITS), 0, (4 << CURVE_BITS) - 1).astype(np.int32)
            cell = np.clip(cell - ((4 << CURVE_BITS) - (1 << CURVE_BITS)) // 2, 0, (1 << CURVE_BITS) - 1)  # the middle quarter holds most vectors
            for bit in range(CURVE_BITS):
                for axis in range(CURVE):
                    curve |= (cell[:, axis] >> bit & 1) << (bit * CURVE + CURVE - 1 - axis)
            yield batch.append_column("lead", pa.FixedSizeListArray.from_arrays(pa.array(lead.ravel()), LEAD).cast(pa.list_(pa.float64()))).append_column("curve", pa.array(curve))

    return run


def near_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) with cosine of x[i] and y[j] at or above the threshold; same: y is x, and only i < j."""
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    u, v = (x / nx[:, None]) @ axes, (y / ny[:, None]) @ axes
    d, low = u.shape[1], threshold - SLACK
    # suffix norms at the ends of the steps
    ends = [*range(STEP, d, STEP), d]
    su = np.sqrt(np.maximum(np.cumsum(u[:, ::-1] ** 2, 1)[:, ::-1], 0))
    sv = np.sqrt(np.maximum(np.cumsum(v[:, ::-1] ** 2, 1)[:, ::-1], 0))
    total = u[:, : ends[0]] @ v[:, : ends[0]].T
    able = total + (np.outer(su[:, ends[0]], sv[:, ends[0]]) if ends[0] < d else 0) >= low
    if same:
        able &= np.triu(np.ones((len(x), len(x)), bool), 1)
    i, j = np.nonzero(able)
    partial = total[i, j]
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        for k in range(0, len(i), 1 << 16):
            s = slice(k, k + (1 << 16))
            partial[s] += np.einsum("nd,nd->n", u[i[s], a:b], v[j[s], a:b])
        keep = partial + (su[i, b] * sv[j, b] if b < d else 0) >= low
        i, j, partial = i[keep], j[keep], partial[keep]
    exact = np.empty(len(i))
    for k in range(0, len(i), 1 << 16):
        s = slice(k, k + (1 << 16))
        exact[s] = np.einsum("nd,nd->n", x[i[s]], y[j[s]]) / (nx[i[s]] * ny[j[s]])
    good = exact >= threshold
    return i[good], j[good]


def tiled_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """near_pairs() of the tiles of x and y that are not too far apart. Unit vectors with cosine t are sqrt(2 - 2t) apart."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    def tiles(z: np.ndarray) -> list[tuple[slice, np.ndarray, float]]:
        out = []
        for k in range(0, len(z), TILE):
            unit = z[k : k + TILE] / np.linalg.norm(z[k : k + TILE], axis=1, keepdims=True)
            centre = unit.mean(0)
            out.append((slice(k, k + len(unit)), centre, float(np.sqrt(((unit - centre) ** 2).sum(1).max()))))
        return out

    left = tiles(x)
    right = left if same else tiles(y)
    for p, (s, centre, radius) in enumerate(left):
        for q, (t, other, far) in enumerate(right):
            if (same and q < p) or np.linalg.norm(centre - other) - radius - far > reach:
                continue
            i, j = near_pairs(x[s], y[t], axes, threshold, same and p == q)
            yield i + s.start, j + t.start


def _compare(axes: dict[int, np.ndarray], threshold: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("curve", "ascending"), ("rep", "ascending")])
        rep, many = table.column("rep").to_numpy(), table.column("many").to_numpy()
        x = _matrix(table.column("vec").combine_chunks())
        block, same = table.column("block").to_numpy(), table.column("a")[0] == table.column("b")[0]
        cut = len(rep) if same else int(np.searchsorted(block, table.column("a")[0].as_py(), "right"))
        degree, up = np.zeros(len(rep), np.int64), np.arange(len(rep))

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for i, j in tiled_pairs(x[:cut], x if same else x[cut:], axes[x.shape[1]], threshold, same):
            j = j if same else j + cut
            np.add.at(degree, i, many[j])
            np.add.at(degree, j, many[i])
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                p, q = root(p), root(q)
                if p != q:
                    up[max(p, q)] = min(p, q)
        hit = np.flatnonzero(degree)
        return pa.table({"rep": pa.array(rep[hit], pa.int64()), "degree": pa.array(degree[hit], pa.int64()), "root": pa.array(rep[[root(k) for k in hit.tolist()]] if len(hit) else rep[:0], pa.int64())})

    return run


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93) -> DataFrame:
    """key, n_links, component_id, kept for every row.

    n_links: other rows of the same label with cosine at or above the threshold; component_id: least key reachable by links; kept:
    it is the row's own key. Vectors that are null, empty, zero or hold null or non-finite components, rows with a null label and
    rows with a null key link with nothing and are their own component (kept is false for a null key). Vectors of different
    lengths do not link. Vectors of numbers other than floats are compared as doubles. Repeated rows count as rows of their own. An empty
    table gives no rows. Other columns are not read. The jobs run when this is called.
    """
    v = F.col("vec")
    kind = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"
    rows = bounded(vectors).select(F.col(key).cast("long").alias("key"), F.col(vector).cast(f"array<{kind}>").alias("vec"), F.col(label).cast("string").alias("label"))
    usable = F.col("label").isNotNull() & F.col("key").isNotNull() & v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = rows.where("usable").groupBy("label", "vec").agg(F.min("key").alias("rep"), F.count("*").alias("many"))
    classes = materialize(classes, "vectors")
    axes = principal_axes(classes.select("vec"))
    placed = classes.mapInArrow(_leading(axes), f"label string, vec array<{kind}>, rep long, many long, lead array<double>, curve int").withColumn("width", F.size("vec"))
    placed = materialize(placed, "placed")
    # places on the curve are 2 ** (CURVE * CURVE_BITS) at most; a crowded one is dealt by hash
    spots = placed.groupBy("label", "width", "curve").agg(F.count("*").alias("n"))
    spots = spots.withColumn("ahead", F.expr("sum(n) over (partition by label, width order by curve) - n"))
    blocked = placed.join(spots, ["label", "width", "curve"])
    room = F.greatest(F.lit(LEAST), F.floor(F.lit(BLOCK) / F.col("width")))
    blocked = blocked.withColumn("block", F.floor((F.col("ahead") + F.pmod(F.xxhash64("rep"), F.col("n"))) / room).cast("int"))
    blocked = materialize(blocked.select("label", "width", "block", "curve", "vec", "rep", "many", "lead"), "blocks")
    ends = [e for k in range(LEAD) for e in (F.min(F.col("lead")[k]).alias(f"lo{k}"), F.max(F.col("lead")[k]).alias(f"hi{k}"))]
    boxes = blocked.groupBy("label", "width", "block").agg(*ends)
    # unit vectors with cosine t are sqrt(2 - 2t) apart, on some axes no further
    gap = sum((F.greatest(F.lit(0.0), F.col(f"x.lo{k}") - F.col(f"y.hi{k}"), F.col(f"y.lo{k}") - F.col(f"x.hi{k}")) ** 2 for k in range(LEAD)), F.lit(0.0))
    meets = boxes.alias("x").join(boxes.alias("y"), ["label", "width"]).where((F.col("x.block") <= F.col("y.block")) & (gap <= 2 - 2 * threshold + 1e-6))
    meets = materialize(meets.select("label", "width", F.col("x.block").alias("a"), F.col("y.block").alias("b")), "meets")
    ways = meets.withColumn("block", F.col("a")).unionByName(meets.where("a < b").withColumn("block", F.col("b")))
    spread = blocked.drop("lead").join(ways, ["label", "width", "block"])
    found = spread.groupBy("label", "width", "a", "b").applyInArrow(_compare(axes, threshold), "rep long, degree long, root long")
    found = materialize(found, "links")
    degrees = found.groupBy("rep").agg(F.sum("degree").alias("degree"))
    comp = components(found.select("rep", "root").where("rep <> root")).withColumnRenamed("node", "rep")
    known = classes.join(degrees, "rep", "left").join(comp, "rep", "left")
    known = known.select(F.col("label").alias("c_label"), F.col("vec").alias("c_vec"), (F.coalesce("degree", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    known = materialize(known, "classes")
    joined = rows.where("usable").join(known, (F.col("label") == F.col("c_label")) & (F.col("vec") == F.col("c_vec"))).select("key", "n_links", "component_id")
    alone = rows.where("not usable").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    out = joined.union(alone)
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
