"""Packing documents into sequences by a grouping genetic algorithm on islands.

Texts become pieces of at most ``capacity`` tokens; a full piece is a sequence of its own.  The other
pieces are dealt by hash into shards of bounded size.  Each shard is evolved on several islands, from
groupings of its pieces in shaken orders: an individual is a list of bins; crossover injects well-filled bins of one parent whole into another,
drops the bins that now hold a document twice, and best-fits the displaced documents, longest first.
After an epoch every island sends its elite to the next one and evolves again.  Bins that end up short
of full are opened again, and their pieces, far fewer, are dealt into fewer shards for another round of
more generations, so that only the last round leaves a remainder.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteworks.llm.common import small_batches, text_or_empty, written
from minuteworks.llm.tokens import chunk_tokenizer, slices_of

Bin = tuple[int, ...]


class Bins:
    """Open bins for best fit: the fullest bin that still takes a piece gets it."""

    def __init__(self, size: list[int], capacity: int, bins=()):
        self.size, self.capacity = size, capacity
        self.bins = [list(b) for b in bins]
        self.free = sorted((capacity - sum(size[i] for i in b), k) for k, b in enumerate(self.bins))

    def put(self, pieces, rng=None, shake: float = 0.25) -> "Bins":
        """Best fit, longest first; with ``rng`` lengths count for up to ``shake`` less in the order."""
        pieces = list(pieces)
        shaken = rng.uniform(1 - shake, 1, len(pieces)).tolist() if rng else [1] * len(pieces)
        for _, i in sorted((-self.size[i] * f, i) for i, f in zip(pieces, shaken)):
            at = bisect_left(self.free, (self.size[i], -1))
            if at < len(self.free):
                room, k = self.free.pop(at)
                self.bins[k].append(i)
            else:
                room, k = self.capacity, len(self.bins)
                self.bins.append([i])
            insort(self.free, (room - self.size[i], k))
        return self

    def done(self) -> list[Bin]:
        return [tuple(b) for b in self.bins]


def fitness(bins: list[Bin], size: list[int], capacity: int) -> float:
    """Mean squared fill: fewer and more unevenly filled bins score higher."""
    return sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(mother: list[Bin], father: list[Bin], size: list[int], capacity: int, rng) -> list[Bin]:
    """Injects some of the father's well-filled bins into the mother."""
    fill = np.array([sum(size[i] for i in b) for b in father])
    full = np.argsort(-fill, kind="stable")[: max(1, len(father) // 2)]
    chosen = rng.permutation(full)[: rng.integers(1, max(2, len(full)))]
    injected = [father[k] for k in chosen]
    taken = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in mother:
        if taken.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in taken]
    return Bins(size, capacity, injected + kept).put(displaced, rng if rng.random() < 0.5 else None).done()


def mutate(bins: list[Bin], size: list[int], capacity: int, rng, share: float = 0.1) -> list[Bin]:
    """Opens the emptiest bins and some others, and best-fits their pieces in a shaken order."""
    order = np.argsort([sum(size[i] for i in b) for b in bins], kind="stable")
    n = max(2, int(share * len(bins)))
    gone = {*order[: n // 2 + 1].tolist(), *rng.permutation(len(bins))[: n // 2].tolist()}
    return Bins(size, capacity, [b for k, b in enumerate(bins) if k not in gone]).put((i for k in gone for i in bins[k]), rng).done()


def evolve(size: list[int], capacity: int, population: list[list[Bin]], seed: int, generations: int, members: int = 4, per_excess: int = 10, most_generations: int = 40) -> list[list[Bin]]:
    """The population after some generations, best first; ends early at the least possible number of bins.

    Individuals that are missing are best-fit groupings of pieces in shaken orders, far from the best one, so
    that crossover has different bins to choose from.  There are
    ``generations``, and ``per_excess`` more for each bin over the least, up to ``most_generations`` more.
    """
    rng = np.random.default_rng(seed)
    least = -(-sum(size) // capacity)
    population = list(population)
    while len(population) < members:
        population.append(Bins(size, capacity).put(range(len(size)), rng, 0.25 + 0.3 * len(population) / members).done())
    scores = [(len(b), -fitness(b, size, capacity)) for b in population]  # each individual is scored once
    order = sorted(range(len(population)), key=scores.__getitem__)
    population, scores = [population[k] for k in order], [scores[k] for k in order]
    for _ in range(generations + min(most_generations, per_excess * (len(population[0]) - least))):
        if len(population[0]) <= least or len(population) < 2:
            break
        a, b = rng.choice(min(len(population), members), 2, replace=False)
        child = crossover(population[a], population[b], size, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, size, capacity, rng)
        if set(child) not in map(set, population):
            score = (len(child), -fitness(child, size, capacity))
            at = bisect_right(scores, score)
            population.insert(at, child)
            scores.insert(at, score)
            del population[members:], scores[members:]
    return population[:members]


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` if asked for) of every text's pieces."""

    def run(batches):
        encode, end = chunk_tokenizer(vocabulary).encode_array, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for a, z in slices_of(batch.column(1), 2_000_000):
                rows, (found, ends) = [], encode(batch.column(1)[a:z])
                for doc_id, own in zip(batch.column(0)[a:z].to_pylist(), np.split(found, ends[:-1])):
                    data = own.tobytes() + end
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None))
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(columns if with_ids else columns[:5], names=names if with_ids else names[:5])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def pack_pieces(pieces: DataFrame, capacity: int = 4096, shard_size: int = 2000, islands: int = 2, generations: int = 8, rounds: int = 3, full_enough: float = 0.999) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``, and any other columns) with ``sequence_id``
    and a gapless ``offset`` in each sequence.  Repeated rows are packed one by one."""
    # a number for each piece, fixed by writing
    numbered = written(pieces.withColumn("_n", F.monotonically_increasing_id()), "pieces")
    open_ = written(numbered.where(F.col("length") < capacity).select("_n", "length"), "open-pieces")
    placed = numbered.where(F.col("length") == capacity).select("_n", F.format_string("full-%d", "_n").alias("bin"), F.lit(0).cast("long").alias("offset"))
    for step in range(rounds):
        n = open_.count()
        if not n:
            break
        # the last round leaves at most one short bin in each shard
        size = shard_size if step < rounds - 1 else 4 * shard_size
        shards = -(-n // size)
        packed = written(packed_shards(open_, shards, capacity, islands, generations * 4**step, step), "packed")
        last = step == rounds - 1 or shards == 1
        short = (F.col("fill") < full_enough * capacity) & F.lit(not last)
        placed = placed.union(packed.where(~short).select("_n", "bin", "offset"))
        open_ = packed.where(short).select("_n", "length")
        if last:
            break
    names = written(placed.select("bin").where("offset = 0").withColumn("sequence_id", F.monotonically_increasing_id()), "sequences")
    named = placed.join(names.withColumnRenamed("bin", "_bin"), F.col("bin") == F.col("_bin")).select(F.col("_n").alias("_m"), "sequence_id", "offset")
    return numbered.join(named, F.col("_n") == F.col("_m")).drop("_n", "_m")


def packed_shards(open_: DataFrame, shards: int, capacity: int, islands: int, generations: int, step: int) -> DataFrame:
    """``_n, length, bin, offset, fill``: two epochs on every island with migration between them."""
    shard = F.pmod(F.xxhash64("_n", F.lit(step)), F.lit(shards)).cast("int")
    # a shard holds about shard_size rows, whatever the table
    rows = open_.groupBy(shard.alias("shard")).agg(F.sort_array(F.collect_list(F.struct("length", "_n"))).alias("rows"))
    rows = written(rows.select("shard", "rows", F.transform("rows", lambda r: r["length"]).alias("sizes")), "shards")
    tasks = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.select("shard", "sizes", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island")).repartition(tasks, "shard", "island")

    def epoch(number, grown):
        def run(batches):
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    start = [[tuple(b) for b in p] for p in row.get("population") or []]
                    seed = zlib.crc32(f"{step} {number} {row['shard']} {row['island']}".encode())
                    found = evolve(row["sizes"], capacity, start, seed, generations)
                    score = fitness(found[0], row["sizes"], capacity)
                    out.append({"shard": row["shard"], "island": row["island"], "population": found, "n_bins": len(found[0]), "score": score})
                yield from pa.Table.from_pylist(out, schema=kinds).to_batches() if out else ()

        return grown.mapInArrow(run, "shard int, island int, population array<array<array<int>>>, n_bins int, score double")

    kinds = pa.schema([("shard", pa.int32()), ("island", pa.int32()), ("population", pa.list_(pa.list_(pa.list_(pa.int32())))), ("n_bins", pa.int32()), ("score", pa.float64())])
    first = written(epoch(1, spread), "islands")
    # the elite (the best individual) moves to the next island of its shard
    elite = first.select(F.col("shard").alias("s"), F.pmod(F.col("island") + 1, F.lit(islands)).alias("i"), F.slice("population", 1, 1).alias("elite"))
    meet = first.join(elite, (F.col("shard") == F.col("s")) & (F.col("island") == F.col("i"))).join(rows.select(F.col("shard").alias("r"), "sizes"), F.col("shard") == F.col("r"))
    second = written(epoch(2, meet.select("shard", "sizes", "island", F.concat("elite", "population").alias("population")).repartition(tasks, "shard", "island")), "islands")
    best = second.groupBy("shard").agg(F.min_by(F.element_at("population", 1), F.struct("n_bins", -F.col("score"), "island")).alias("bins"))
    bins = best.join(rows.select(F.col("shard").alias("r"), "rows"), F.col("shard") == F.col("r")).select("shard", "rows", F.posexplode("bins").alias("k", "members"))
    members = F.transform("members", lambda i: F.element_at("rows", i + 1))
    fill = F.aggregate("members", F.lit(0).cast("long"), lambda s, r: s + r["length"])
    laid = bins.select(F.format_string(f"{step}-%d-%d", "shard", "k").alias("bin"), members.alias("members")).select("bin", fill.alias("fill"), F.posexplode("members").alias("at", "row"), "members")
    before = F.aggregate(F.slice("members", 1, F.col("at")), F.lit(0).cast("long"), lambda s, r: s + r["length"])
    return laid.select(F.col("row._n").alias("_n"), F.col("row.length").alias("length"), "bin", before.alias("offset"), "fill")


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = 4096, **options) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null text is an empty one and has the end id only; only documents longer than ``capacity`` are
    cut, and a text without a blank is one chunk for the tokenizer, however long; repeated and null ids
    have their own pieces; other columns are ignored; an empty table gives
    an empty result.
    """
    with small_batches(docs.sparkSession):
        return pack_pieces(pieces_of(docs, vocabulary, end_id, capacity), capacity, **options)
