"""Near-duplicate documents: MinHash with tensored banding, every link confirmed on full sets.

Two small collections of bands are computed, ``A_1..A_m`` and ``B_1..B_m``, each of ``k`` minima.
Table ``(i, j)`` is keyed by the pair ``(A_i, B_j)``: ``m * m`` tables of ``2 * k`` minima each from
``2 * m * k`` minima, where plain banding computes ``m * m * 2 * k``.  With ``m=12, k=3`` a pair of
Jaccard similarity 0.8 meets in no table with a chance of 4 in 10,000, one of 0.85 with 2 in 100,000.

Equal sets are one class first, so copies never meet in the tables.  Links are then found in three
passes, none of which emits all pairs of a bucket:

1. every member of a bucket is compared with the bucket's smallest id; components of these links;
2. where a bucket still holds several components, each member outside its largest one is compared with
   one member of the largest, a different one in every bucket; components again;
3. what is outside even now is compared with the members of other components that it shares a table
   with, tile by tile: bitmaps of the sets rule out most pairs for certain, full sets decide the rest.
   A pair is looked at once, in the first band of ``A`` that it shares.

In the first two passes minima rule out pairs before the full sets do: of the pairs at 0.8 one in 100,000
has fewer equal minima than ``least_share``.

Pairs inside one component need no further look: they cannot change the components.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from minuteworks.llm.common import small_batches, text_or_empty, without_ids, written
from minuteworks.llm.graph import connected_components, with_components
from minuteworks.llm.tokens import slices_of

U64 = np.uint64


class Shingler:
    """Shingle sets as sorted 64-bit hashes.  Words: whole text, A-Z lower-cased, split at the
    characters ``[\\x20\\x09-\\x0D]``; ``width`` words make a shingle, a shorter text is one."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and blanks only
        if not words:
            return np.empty(0, U64)
        hashes = np.array(list(map(xxh3_64_intdigest, words)), U64)
        width = min(self.width, len(hashes))
        n = len(hashes) - width + 1
        mixed = np.full(n, width, U64)
        for k in range(width):
            mixed = scramble(mixed * U64(0x9E3779B97F4A7C15) + hashes[k : k + n])
        return np.unique(mixed)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=4)
def seeds(n: int) -> np.ndarray:
    return scramble(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95))


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """``n`` minima of independent hashes of a set, as 32-bit integers."""
    out = np.full(n, np.iinfo(np.uint64).max, U64)
    for k in range(0, len(shingles), 4096):  # bounded memory for very long texts
        part = shingles[k : k + 4096, None] ^ seeds(n)[None, :]
        part *= U64(0xBF58476D1CE4E5B9)
        part ^= part >> U64(32)
        part *= U64(0x94D049BB133111EB)
        out = np.minimum(out, part.min(axis=0))
    return (out >> U64(32)).astype(np.uint32)


def bands(mins: np.ndarray, m: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The bands A and B of rows of minima, 64 bits each, different for every position."""
    parts = mins.reshape(len(mins), 2 * m, k).astype(U64)
    key = np.broadcast_to(np.arange(1, 2 * m + 1, dtype=U64)[None, :], parts.shape[:2]).copy()
    for j in range(k):
        key = scramble(key * U64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key[:, :m], key[:, m:]


def list_column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width), pa.int32()), pa.array(values.ravel(), kind))


def signatures(docs: DataFrame, width: int, m: int, k: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, mins``: the key is a 128-bit digest of the whole set."""

    def run(batches):
        make = Shingler(width)
        for batch in batches:
            for a, z in slices_of(batch.column(1)):
                sets = [make(t) for t in batch.column(1)[a:z].to_pylist()]
                mins = np.stack([minima(s, 2 * m * k) for s in sets]).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:z], pa.array([len(s) for s in sets], pa.int64()), pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), list_column(mins, pa.int32())],
                    names=["doc_id", "n_shingles", "set_key", "mins"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, mins array<int>")


def table_keys(reps: DataFrame, m: int, k: int) -> DataFrame:
    """``key, rep``: the keys of the ``m * m`` tables of each representative."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                mins = part.column(1).flatten().to_numpy().view(np.uint32).reshape(part.num_rows, -1)
                a, b = bands(mins, m, k)
                pairs = scramble(a[:, :, None] * U64(0x9E3779B97F4A7C15) + b[:, None, :]).reshape(part.num_rows, -1)
                rep = np.repeat(part.column(0).to_numpy(), m * m)
                yield pa.RecordBatch.from_arrays([pa.array(pairs.ravel().view(np.int64)), pa.array(rep)], names=["key", "rep"])

    return reps.select("rep", "mins").mapInArrow(run, "key long, rep long")


def shingle_sets(ids: DataFrame, docs: DataFrame, width: int, most_broadcast: int = 2_000_000) -> DataFrame:
    """``id, shingles`` (sorted 64-bit hashes) of the documents named in ``ids``, made again from their texts.

    The ids are broadcast while there are at most ``most_broadcast`` of them (16 MB), else the texts are
    shuffled to them.
    """
    ids = written(ids.distinct(), "set-ids")
    few = F.broadcast(ids) if ids.count() <= most_broadcast else ids

    def make_sets(batches):
        make = Shingler(width)
        for batch in batches:
            for a, z in slices_of(batch.column(1)):
                sets = [make(t).tobytes() for t in batch.column(1)[a:z].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], pa.array(sets, pa.binary())], names=["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text")).join(few, "id", "left_semi")
    # an id may repeat, with an empty set in one of its rows
    return written(texts.mapInArrow(make_sets, "id long, shingles binary").where("length(shingles) > 0"), "shingle-sets")


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets have ``100 * both >= percent * either``."""
    sets = shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs, width)

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # repeated ids: any of their sets may confirm the pair
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(compare, "a long, b long")


def similar_enough(percent: int, least_share: float, n: int):
    """SQL over ``x`` and ``y`` rows: sizes that allow the similarity, and minima that make it likely.
    At similarity 0.8 a share of 0.6 among 72 equal minima is 4 standard errors away."""
    return (
        f"100 * least(x.n_shingles, y.n_shingles) >= {percent} * greatest(x.n_shingles, y.n_shingles) AND "
        f"aggregate(zip_with(x.mins, y.mins, (p, q) -> int(p = q)), 0, (s, v) -> s + v) >= {int(least_share * n)}"
    )


def minhash_components(docs: DataFrame, width: int = 5, percent: int = 80, m: int = 12, k: int = 3, least_share: float = 0.6) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when their sets of ``width``-word shingles have Jaccard similarity of at
    least ``percent`` in 100; a component's smallest id is kept.  A null or empty text, or one of
    blanks, has an empty set and is linked with nothing.  Rows that repeat an id are one node, with a
    result row each.  A row with a null id is linked with nothing.  Other columns are ignored; an
    empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        rows, classes = components_of_classes(docs, width, percent, m, k, least_share)
    named = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("set_key")).alias("set_key"))
    out = named.join(classes, F.col("set_key") == F.col("of"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def components_of_classes(docs: DataFrame, width: int, percent: int, m: int, k: int, least_share: float) -> tuple[DataFrame, DataFrame]:
    """The documents' signatures, and ``of`` (a set's key) with its ``component_id``; both written."""
    rows = written(signatures(docs, width, m, k), "signatures")
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets are one class; its smallest id stands for it
    reps = written(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("mins").alias("mins")), "set-classes")

    # dealt anew: the table just written has few, small files, and each row becomes ``m * m``
    keys = table_keys(reps.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rep"), m, k)
    shared = keys.groupBy("key").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(keys.join(shared, "key"), "table-members")
    facts = reps.select("rep", "n_shingles", "mins")
    allowed = similar_enough(percent, least_share, 2 * m * k)

    def linked(pairs: DataFrame) -> DataFrame:
        near = pairs.distinct().join(facts.select(F.col("rep").alias("b"), F.struct("n_shingles", "mins").alias("y")), "b")
        near = near.join(facts.select(F.col("rep").alias("a"), F.struct("n_shingles", "mins").alias("x")), "a")
        return written(confirmed(written(near.where(allowed).select("a", "b"), "near-pairs"), docs, width, percent), "links")

    links = linked(members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")))
    labels = connected_components(links)

    # buckets of three or more that still hold several components: those outside its largest one meet
    # one of its members, another in every bucket
    placed, mixed = mixed_buckets(members.where("n > 2"), labels)
    inside = F.col("component_id") == F.col("main")
    leads = mixed.where(inside).groupBy("key").agg(F.min(F.struct(F.xxhash64("rep", "key").alias("h"), F.col("rep").alias("rep"))).alias("first"))
    outside = mixed.where(~inside).select("key", F.col("rep").alias("b"))
    links = links.union(linked(outside.join(leads.select("key", F.col("first.rep").alias("a")), "key").select("a", "b")))
    labels = connected_components(links)

    # what still is outside meets all that it shares a table with, in tiles
    placed, mixed = mixed_buckets(placed.select("key", "rep"), labels)
    rest = mixed.groupBy("rep", "component_id").agg(F.max((~inside).cast("int")).alias("outside"))
    more = links_of_rest(written(rest.join(facts, "rep"), "rest"), docs, width, percent, m, k)
    if more is not None:
        labels = connected_components(links.union(more))

    classes = written(with_components(reps.select("set_key", "rep"), "rep", labels).select(F.col("set_key").alias("of"), "component_id"), "classes")
    return rows, classes


def mixed_buckets(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, rep, component_id`` of all members, and those of buckets with several components, with
    ``main``, the one that is largest in all."""
    placed = written(with_components(members.select("key", "rep"), "rep", labels), "placed-members")
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sized = placed.join(sizes, F.col("component_id") == F.col("component"), "left").withColumn("size", F.coalesce("size", F.lit(0)))
    several = sized.groupBy("key").agg(F.max(F.struct("size", "component_id")).alias("most"), F.min("component_id").alias("c0"), F.max("component_id").alias("c1")).where("c0 <> c1")
    return placed, placed.join(several.select("key", F.col("most.component_id").alias("main")), "key")


TILE = "bucket long, p int, q int"


def links_of_rest(rest: DataFrame, docs: DataFrame, width: int, percent: int, m: int, k: int, tile_rows: int = 512, tile_bytes: int = 16_000_000) -> DataFrame | None:
    """Links ``a, b`` between documents of ``rest`` (``rep, component_id, outside, n_shingles, mins``) that
    share a table, are not in one component yet, and of which one is ``outside``; None if there are none.

    The members of a bucket of an ``A`` band are dealt into tiles bounded by rows and by bytes of sets, and
    every two tiles of a bucket meet in one group.  A first look at bands, sizes and bitmaps names the
    members of each group that may have a link; their full sets then meet in the same groups.  Both looks
    return at most a row for each member of a group, never its pairs.
    """
    tasks = int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = shingle_sets(rest.select(F.col("rep").alias("id")), docs, width)
    members = written(banded(rest.join(sets, F.col("rep") == F.col("id")).drop("id"), m, k), "rest-bands")
    each = members.select("rep", "component_id", "outside", F.posexplode("a").alias("i", "bucket"), (8 * F.col("n_shingles")).alias("bytes"))
    shared = (
        each.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("component_id").alias("c0"), F.max("component_id").alias("c1"), F.max("outside").alias("any"))
        .where("c0 <> c1 AND any = 1")
        .select("bucket", F.greatest(F.ceil(F.col("n") / tile_rows), F.ceil(F.col("bytes") / tile_bytes)).cast("int").alias("tiles"))
    )
    dealt = members.select("*", F.posexplode("a").alias("i", "bucket")).drop("mins").join(shared, "bucket")
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("rep", "bucket"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    groups = dealt.select("bucket", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "i", "rep", "component_id", "outside", "n_shingles", "a", "b", "bits")

    def first_look(table):
        column = lambda name: table.column(name).to_numpy()
        hit = possible(column("component_id"), column("outside"), column("n_shingles"), rows_of(table.column("a")), rows_of(table.column("b")), table.column("bits").to_pylist(), column("tile"), int(column("i")[0]), percent)
        return table.select(["bucket", "p", "q", "rep"]).filter(pa.array(hit))

    def full_sets(table):
        ids = table.column("rep").to_numpy()
        root = set_links([np.frombuffer(v, U64) for v in table.column("shingles").to_pylist()], percent)
        order = np.argsort(ids, kind="stable")
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        found = ids[order] != least[root][order]
        return pa.table({"a": pa.array(least[root][order][found]), "b": pa.array(ids[order][found])})

    hits = written(groups.repartition(tasks, "bucket", "p", "q").groupBy("bucket", "p", "q").applyInArrow(first_look, f"{TILE}, rep long"), "rest-hits")
    if hits.isEmpty():
        return None
    again = hits.distinct().join(sets, F.col("rep") == F.col("id")).select("bucket", "p", "q", "rep", "shingles")
    return written(again.repartition(tasks, "bucket", "p", "q").groupBy("bucket", "p", "q").applyInArrow(full_sets, "a long, b long"), "links")


def rows_of(lists: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    return lists.combine_chunks().flatten().to_numpy().reshape(len(lists), -1)


def bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each shingle, in four to eight times as many bits (a power of two) as there are."""
    n = 1 << max(6, (4 * len(shingles) - 1).bit_length())
    bits = np.zeros(n, bool)
    bits[(shingles & U64(n - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def possible(component, outside, size, a, b, bits, tile, band: int, percent: int) -> np.ndarray:
    """For each member of a group whether some partner may reach the similarity: of another component (and
    of the other tile, where two meet), one of the two outside, with a ``B`` band in common, no ``A`` band
    before ``band`` in common, and sizes and bitmaps that allow it.

    Bits of one that the other lacks are shingles the other lacks, so what bitmaps rule out is certain.
    """
    maps = [np.frombuffer(v, U64) for v in bits]
    words = np.array([len(v) for v in maps])
    by_words = {}  # all maps of a length, and those of twice the length folded to it
    for w in np.unique(words):
        own = np.zeros((len(maps), w), U64)
        for j in np.flatnonzero((words == w) | (words == 2 * w)):
            own[j] = maps[j] if words[j] == w else maps[j][:w] | maps[j][w:]
        by_words[w] = own
    two, place, hit = tile.min() != tile.max(), np.arange(len(maps)), np.zeros(len(maps), bool)
    for x in np.flatnonzero(outside):
        ok = (component != component[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])) & ((outside == 0) | (place > x))
        if two:
            ok &= tile != tile[x]
        y = np.flatnonzero(ok)
        y = y[(b[y] == b[x]).any(axis=1)]
        if band and len(y):
            y = y[~(a[y, :band] == a[x, :band]).any(axis=1)]
        least = np.minimum(words[y], words[x])
        for w in np.unique(least):
            mine = y[least == w]
            p, q = by_words[w][x], by_words[w][mine]
            both = np.minimum(size[x] - np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64), size[mine] - np.bitwise_count(q & ~p).sum(axis=1, dtype=np.int64))
            near = mine[100 * both >= percent * (size[x] + size[mine] - both)]
            if len(near):
                hit[x] = True
                hit[near] = True
    return hit


def set_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each of several sets of distinct values the first one of its component under links."""
    size = np.array([len(s) for s in sets])
    root = np.arange(len(sets))
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    mark = np.zeros(len(values), bool)
    for x in range(len(sets) - 1):
        mine = place[ends[x] - size[x] : ends[x]]
        mark[mine] = True
        both = np.add.reduceat(mark[place[ends[x] :]], ends[x:-1] - ends[x], dtype=np.int64)
        mark[mine] = False
        for y in x + 1 + np.flatnonzero(100 * both >= percent * (size[x] + size[x + 1 :] - both)):
            if root[x] != root[y]:
                low, high = sorted((root[x], root[y]))
                root[root == high] = low
    return root


def banded(rows: DataFrame, m: int, k: int) -> DataFrame:
    """Replaces the full sets by the bands ``a`` and ``b`` as arrays and a bitmap."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            mins = batch.column(at("mins")).flatten().to_numpy().view(np.uint32).reshape(batch.num_rows, -1)
            a, b = (list_column(np.ascontiguousarray(v).view(np.int64), pa.int64()) for v in bands(mins, m, k))
            bits = pa.array([bitmap(np.frombuffer(v.as_buffer(), U64)) for v in batch.column(at("shingles"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, a, b, bits], names=[*names, "a", "b", "bits"])

    names = ["rep", "component_id", "outside", "n_shingles"]
    return rows.select(*names, "mins", "shingles").mapInArrow(run, "rep long, component_id long, outside int, n_shingles long, a array<bigint>, b array<bigint>, bits binary")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are the kept ones of their components, with all their columns, whatever
    these are called.  Rows with a null or empty text, or a null id, stay; rows that repeat a kept id all
    stay, those that repeat another one all go; an empty table stays empty."""
    gone = minhash_components(docs, **options).where(~F.col("kept")).select("doc_id").distinct()
    return without_ids(docs, gone, "doc_id")
