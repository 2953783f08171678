"""Near-duplicate vectors: tiles compared in the order of principal components, with early stops.

Vectors are cut into cells by medians of their leading components (a k-d tree over a bounded sample)
and cells into tiles of bounded size.  Two cells whose boxes are too far apart for the threshold never
meet.  Of two tiles that do, leading components are multiplied first; what the rest can add is bounded
by the product of the norms of the rest, and rows and columns that cannot reach the threshold any more
drop out.  What is left is computed from the original vectors in double precision.

Tiles meet twice: first as sketches, leading components and the norm of the rest as 32-bit floats; then
only the vectors that the sketches left over meet whole.  A pair of tiles returns, for each vector with links, how many and one edge to its local component, so
output follows the vectors, not the pairs.  Equal vectors are one, counted as many times.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteworks.llm.common import written
from minuteworks.llm.graph import connected_components

#: Rounding in bounds is far below this, for 64-bit and 32-bit floats.
SLACK, SKETCH_SLACK = 1e-9, 1e-5
STAGES = (8, 16, 32)
SKETCH = 16


def prepared(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, dim, key, vec``: the components as doubles; ``vec`` is null for those that link with
    nothing (null, empty or zero vectors, null or non-finite components, a null id)."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            out = []
            for i, v in zip(ids.to_pylist(), lists):
                x = None
                if v.is_valid and i is not None and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                    most = np.abs(x).max(initial=0.0)
                    # scaled by a power of two, which is exact, so that squares stay in range
                    x = np.ldexp(x, -int(np.frexp(most)[1])) if np.isfinite(most) and most > 0 else None
                out.append(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array([None if x is None else len(x) for x in out], pa.int32()), pa.array([None if x is None else x.tobytes() for x in out], pa.binary())], names=["vec_id", "dim", "vec"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, "vec_id long, dim int, vec binary").withColumn("key", F.sha2("vec", 256))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Cells:
    """Principal axes and a k-d tree of medians, both from a sample; any sample gives right results."""

    def __init__(self, sample: np.ndarray, rows: int, per_cell: int, most_cells: int):
        x = unit(sample)
        _, axes = np.linalg.eigh(x.T @ x)
        self.axes = np.ascontiguousarray(axes[:, ::-1])
        x = x @ self.axes
        self.depth = 0
        while (1 << (self.depth + 1)) <= min(most_cells, rows / per_cell) and (1 << (self.depth + 1)) * 8 <= len(x):
            self.depth += 1
        self.split: list[list[tuple[int, float]]] = []
        cell = np.zeros(len(x), np.int64)
        for level in range(self.depth):
            cuts = []
            for c in range(1 << level):
                mine = x[cell == c]
                spread = mine[:, : min(16, x.shape[1])].var(axis=0) if len(mine) else np.zeros(1)
                axis = int(np.argmax(spread))
                cuts.append((axis, float(np.median(mine[:, axis])) if len(mine) else 0.0))
            self.split.append(cuts)
            cell = self._down(x, cell, cuts)

    @staticmethod
    def _down(x, cell, cuts):
        axis = np.array([c[0] for c in cuts])[cell]
        at = np.array([c[1] for c in cuts])[cell]
        return cell * 2 + (x[np.arange(len(x)), axis] > at)

    def of(self, x: np.ndarray) -> np.ndarray:
        cell = np.zeros(len(x), np.int64)
        for cuts in self.split:
            cell = self._down(x, cell, cuts)
        return cell

    def partners(self, threshold: float) -> list[list[int]]:
        """For each cell those from itself on whose boxes may hold a partner: for unit vectors the
        squared distance is ``2 - 2 * cosine``."""
        n, dim = 1 << self.depth, self.axes.shape[0]
        low, high = np.full((n, dim), -np.inf), np.full((n, dim), np.inf)
        for c in range(n):
            for level, cuts in enumerate(self.split):
                node = c >> (self.depth - level)
                axis, at = cuts[node]
                if (c >> (self.depth - level - 1)) & 1:
                    low[c, axis] = max(low[c, axis], at)
                else:
                    high[c, axis] = min(high[c, axis], at)
        most = 2 - 2 * threshold + SLACK
        out = []
        for c in range(n):
            gap = np.maximum(0, np.maximum(low[c] - high[c:], low[c:] - high[c]))
            out.append((c + np.flatnonzero((gap**2).sum(axis=1) <= most)).tolist())
        return out


def links_between(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, threshold: float):
    """Yields ``rows, columns`` of links between unit vectors; ``rx, ry`` are the rotated ones."""
    dim = x.shape[1]
    edges = [0, *(s for s in STAGES if s < dim), dim]
    tails = [[np.sqrt((r[:, e:] ** 2).sum(axis=1)) for r in (rx, ry)] for e in edges[1:-1]]
    for start in range(0, len(x), 1024):
        rows, cols = np.arange(start, min(start + 1024, len(x))), np.arange(len(y))
        part = np.zeros((len(rows), len(cols)))
        for (a, b), (tx, ty) in zip(zip(edges, edges[1:]), tails):
            part += rx[rows, a:b] @ ry[cols, a:b].T
            alive = part + tx[rows][:, None] * ty[cols][None, :] >= threshold - SLACK
            r, c = alive.any(axis=1), alive.any(axis=0)
            if not r.any():
                break
            part = part[np.ix_(r, c)] if not (r.all() and c.all()) else part
            rows, cols = rows[r], cols[c]
        else:
            i, j = np.nonzero(x[rows] @ y[cols].T >= threshold)
            if len(i):
                yield rows[i], cols[j]


def sketches(rotated: np.ndarray) -> np.ndarray:
    """Leading components, and the norm of what follows the first 8 and what follows all of them."""
    norm = lambda at: np.sqrt((rotated[:, at:] ** 2).sum(axis=1))[:, None]
    lead = rotated[:, :SKETCH]
    lead = np.hstack([lead, np.zeros((len(lead), SKETCH - lead.shape[1]))])
    return np.hstack([lead, norm(8), norm(SKETCH)]).astype("<f4")


def left_over(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two tiles' sketches may reach the threshold with some row of the other tile."""
    own, other = np.zeros(len(x), bool), np.zeros(len(y), bool)
    for start in range(0, len(x), 1024):
        rows, cols = np.arange(start, min(start + 1024, len(x))), np.arange(len(y))
        for upto, norm in ((8, SKETCH), (SKETCH, SKETCH + 1)):
            alive = x[rows, :upto] @ y[cols, :upto].T + np.outer(x[rows, norm], y[cols, norm]) >= threshold - SKETCH_SLACK
            rows, cols = rows[alive.any(axis=1)], cols[alive.any(axis=0)]
            if not len(rows):
                break
        own[rows] = other[cols] = True
    return own, other


def local_roots(n: int, links) -> np.ndarray:
    """For each node the smallest node of its component under the links."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for i, j in links:
            least = np.minimum(root[i], root[j])
            np.minimum.at(root, i, least)
            np.minimum.at(root, j, least)
        root = root[root]
        if np.array_equal(root, before):
            return root


def near_vectors(vectors: DataFrame, threshold: float = 0.95, tile_rows: int = 4096, sample_rows: int = 8192, most_cells: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors are linked when their cosine in double precision is ``threshold`` or more; only vectors
    of equal dimension are compared.  Null, empty and zero vectors, and those with null or non-finite
    components, have no links, as have rows with a null id.  Rows that repeat an id are one node: the
    links of its vectors add up, and each row has a result row.  Other columns are ignored; an empty
    table gives an empty result.  Axes and cells come from a sample of ``sample_rows`` vectors, which
    affects speed alone.
    """
    spark = vectors.sparkSession
    rows = written(prepared(vectors, id_col, vec_col), "vectors")
    classes = written(rows.where("vec IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times"), F.first("dim").alias("dim"), F.first("vec").alias("vec")), "vector-classes")
    found = None
    # one pass for each dimension that occurs; as a rule there is one
    for dim, n in sorted((r.dim, r["count"]) for r in classes.groupBy("dim").count().collect()):
        mine = classes.where(F.col("dim") == dim)
        sample = mine.orderBy(F.xxhash64("key"), "key").limit(sample_rows).select("vec").collect()  # bounded
        cells = Cells(np.stack([np.frombuffer(r.vec, "<f8") for r in sample]), n, tile_rows, most_cells)
        out = written(compare_tiles(spark, mine, cells, threshold, tile_rows), "tile-links")
        found = out if found is None else found.union(out)
    if found is None:
        stats, labels = None, None
    else:
        stats = found.groupBy("id").agg(F.sum("links").alias("links"))
        labels = connected_components(found.select("id", "root"))
    own = classes.select(F.col("key").alias("of"), "rep", "times")
    out = rows.join(own, F.col("key") == F.col("of"), "left").select("vec_id", "rep", "times")
    if stats is not None:
        out = out.join(stats, F.col("rep") == F.col("id"), "left").drop("id")
        out = out.join(labels.withColumnRenamed("id", "node"), F.col("rep") == F.col("node"), "left")
    else:
        out = out.withColumns({"links": F.lit(0), "component": F.lit(None).cast("long")})
    component = F.coalesce("component", "rep", "vec_id")
    n_links = F.coalesce("links", F.lit(0)) + F.coalesce("times", F.lit(1)) - 1
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def compare_tiles(spark, mine: DataFrame, cells: Cells, threshold: float, tile_rows: int) -> DataFrame:
    """``id, root, links``: a row for each vector with links, in each pair of tiles it has them in."""
    shared = spark.sparkContext.broadcast(cells)

    def assign(batches):
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                x = unit(np.stack([np.frombuffer(v.as_buffer(), "<f8") for v in batch.column(2)])) @ own.axes
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v.tobytes() for v in sketches(x)], pa.binary()), pa.array(own.of(x).astype(np.int32))], names=["rep", "times", "vec", "sketch", "cell"])

    numbered = mine.select("rep", "times", "vec").mapInArrow(assign, "rep long, times long, vec binary, sketch binary, cell int")
    # a number for each class, fixed by writing: an id may repeat with different vectors
    placed = written(numbered.withColumn("n", F.monotonically_increasing_id()), "placed-vectors")
    # at most most_cells rows each
    parts = {r.cell: -(-r["count"] // tile_rows) for r in placed.groupBy("cell").count().collect()}
    tiles_of = F.broadcast(spark.createDataFrame(list(parts.items()), "of int, tiles int"))
    partners = [(c, d, parts[d]) for c, near in enumerate(cells.partners(threshold)) for d in near if c in parts and d in parts]
    pairs = [(c, d, n, "a") for c, d, n in partners] + [(d, c, parts[c], "b") for c, d, _ in partners]
    near = F.broadcast(spark.createDataFrame(pairs, "of int, other int, others int, side string"))  # most_cells squared at most
    tiles = placed.join(tiles_of, F.col("cell") == F.col("of")).select("cell", F.pmod(F.xxhash64("n"), F.col("tiles")).cast("int").alias("sub"), "n", "sketch")
    packed = tiles.groupBy("cell", "sub").agg(F.collect_list(F.struct("n", "sketch")).alias("rows"))  # about tile_rows
    spread = packed.join(near, F.col("cell") == F.col("of")).select("*", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("osub"))
    me, you = F.struct("cell", "sub"), F.struct(F.col("other").alias("cell"), F.col("osub").alias("sub"))
    # a tile meets another once, and itself once
    spread = spread.where(F.when(F.col("cell") == F.col("other"), F.when(F.col("side") == "a", F.col("sub") <= F.col("osub")).otherwise(F.col("sub") > F.col("osub"))).otherwise(True))
    left = F.col("side") == "a"
    keyed = spread.select(F.when(left, me).otherwise(you).alias("first"), F.when(left, you).otherwise(me).alias("second"), left.alias("is_first"), "rows")
    pair = "first struct<cell: int, sub: int>, second struct<cell: int, sub: int>"
    axes = cells.axes

    def first_look(table):
        sides = {}
        for flag, entries in zip(table.column("is_first").to_pylist(), table.column("rows").combine_chunks()):
            e = entries.values
            sides[flag] = e.field("n").to_numpy(), np.stack([np.frombuffer(v.as_buffer(), "<f4") for v in e.field("sketch")])
        own, other = left_over(sides[True][1], sides.get(False, sides[True])[1], threshold)
        if False not in sides:
            own, other = own | other, other[:0]
        ids = np.concatenate([sides[True][0][own], *([sides[False][0][other]] if False in sides else [])])
        flags = np.arange(len(ids)) < own.sum()
        same_pair = lambda name: pa.chunked_array([table.column(name).combine_chunks().take(pa.array(np.zeros(len(ids), np.int64)))])
        return pa.table({"first": same_pair("first"), "second": same_pair("second"), "is_first": pa.array(flags), "n": pa.array(ids)})

    def compare(table):
        flags = table.column("is_first").to_numpy()
        every, times = table.column("rep").to_numpy(), table.column("times").to_numpy()
        order = np.argsort(~flags, kind="stable")
        every, times, n = every[order], times[order], int(flags.sum())
        x = unit(np.stack([np.frombuffer(v, "<f8") for v in table.column("vec").to_pylist()])[order])
        same = n == len(every)
        shift, y = (0, x) if same else (n, x[n:])
        x = x[:n]
        count, links = np.zeros(len(every), np.int64), []
        for i, j in links_between(x, y, x @ axes, y @ axes, threshold):
            if same:
                i, j = i[i < j], j[i < j]
            np.add.at(count, i, times[j + shift])
            np.add.at(count, j + shift, times[i])
            links.append((i, j + shift))
        order = np.argsort(every, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        roots = every[order][local_roots(len(every), [(rank[i], rank[j]) for i, j in links])[rank]]
        has = np.flatnonzero(count)
        return pa.table({"id": pa.array(every[has]), "root": pa.array(roots[has]), "links": pa.array(count[has])})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    over = written(keyed.repartition(tasks, "first", "second").groupBy("first", "second").applyInArrow(first_look, f"{pair}, is_first boolean, n long"), "vectors-left")
    whole = over.join(placed.select("n", "rep", "times", "vec"), "n")
    return whole.repartition(tasks, "first", "second").groupBy("first", "second").applyInArrow(compare, "id long, root long, links long")
