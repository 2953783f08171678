import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from minuteworks.llm import packing as P
from minuteworks.llm.tokens import ChunkTokenizer, vocabulary_path


def valid(bins, size, capacity):
    return sorted(i for b in bins for i in b) == list(range(len(size))) and all(sum(size[i] for i in b) <= capacity for b in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60), st.integers(0, 5))
def test_evolution_keeps_solutions_whole(size, seed):
    start = P.Bins(size, 100).put(range(len(size))).done()
    for bins in P.evolve(size, 100, [], seed, 12):
        assert valid(bins, size, 100)
    assert len(P.evolve(size, 100, [start], seed, 12)[0]) <= len(start)


def test_crossover_injects_whole_bins():
    size = [60, 40, 50, 50, 70, 30, 20]
    mother, father = [(0, 5), (4,), (2, 1), (3, 6)], [(0, 1), (2, 3), (4, 5), (6,)]
    child = P.crossover(mother, father, size, 100, np.random.default_rng(0))
    assert valid(child, size, 100) and any(b in child for b in father[:3])


def test_it_beats_best_fit():
    greedy = evolved = 0
    for seed in range(6):
        size = np.random.default_rng(seed).integers(25, 45, 60).tolist()
        start = P.Bins(size, 100).put(range(60)).done()
        best = P.evolve(size, 100, [], seed, 300, 6)[0]
        assert -(-sum(size) // 100) <= len(best) <= len(start)
        greedy, evolved = greedy + len(start), evolved + len(best)
    assert evolved < greedy


def checked(rows, docs, capacity):
    """Rows tile all documents and sequences are gapless; returns the number of sequences."""
    library = ChunkTokenizer(vocabulary_path("word_bpe_49k.json")).library
    left, places = defaultdict(list), defaultdict(list)
    for r in rows:
        left[r.doc_id].append((r.start, r.piece, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    for doc_id, texts in docs.items():
        want = []
        for text in texts:
            ids = library.encode(text or "", add_special_tokens=False).ids + [1]
            for k, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                want.append((at, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
        assert sorted(left.pop(doc_id)) == sorted(want)
    assert not left
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (3, "again"), (None, "no id"), (5, "a b c"), (5, "a b c")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, length int")
    by = defaultdict(list)
    for i, t in rows:
        by[i].append(t)
    assert checked(P.pack_documents(docs).collect(), by, 4096) == 3
    assert P.pack_documents(docs.limit(0)).count() == 0


def test_whole_table_in_few_sequences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by = {r.doc_id: [r.text] for r in docs.collect()}
    for options in ({}, {"shard_size": 20, "islands": 3}):
        rows = P.pack_documents(docs, **options).collect()
        n, least = checked(rows, by, 4096), -(-sum(r.length for r in rows) // 4096)
        assert n <= least + 2


def best_fit(size, capacity):
    return len(P.Bins(size, capacity).put(range(len(size))).done())


def sequences(spark, size):
    pieces = spark.createDataFrame([(k, n) for k, n in enumerate(size)], "piece_id long, length long")
    rows = P.pack_pieces(pieces).collect()
    assert sorted(r.piece_id for r in rows) == list(range(len(size)))
    return len({r.sequence_id for r in rows})


def test_islands_beat_best_fit_with_production_parameters(spark):
    """Lengths of which two or three fill a sequence: best fit leaves room that crossover closes."""
    for low, high in ((1000, 1900), (400, 2200)):
        size = np.random.default_rng(low).integers(low, high, 4000).tolist()
        assert -(-sum(size) // 4096) <= sequences(spark, size) < best_fit(size, 4096)


def test_islands_on_lengths_of_documents(spark):
    """Log-normal lengths, as those of documents, where best fit nearly reaches the least possible number:
    islands do so too, and crossover gets there from orders that are shaken the most."""
    size = np.clip(np.random.default_rng(3).lognormal(6.4, 0.8, 8000), 20, 4000).astype(int).tolist()
    rng = np.random.default_rng(0)
    start = [P.Bins(size, 4096).put(range(len(size)), rng).done() for _ in range(4)]
    assert len(P.evolve(size, 4096, start, 0, 8)[0]) < min(map(len, start))
    assert sequences(spark, size) <= best_fit(size, 4096) + 1


def test_crossover_reaches_the_bound_on_lengths_of_the_table(monkeypatch):
    """On shards of lengths of ``documents``, islands start from shaken groupings over the least number of
    bins; crossover alone, without mutation, and the migration of elites bring them down."""
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()]
    lengths = [n for n in (len(t) // 3 + 1 for t in texts) if n < 4096]
    crossed, plain = [], P.crossover

    def counted(*args):
        crossed.append(1)
        return plain(*args)

    monkeypatch.setattr(P, "crossover", counted)
    monkeypatch.setattr(P, "mutate", lambda bins, *rest: bins)

    def excess(generations):
        out = 0
        for k in range(5):
            size = lengths[k::5]
            islands = [P.evolve(size, 4096, [], 10 * k + i, generations, most_generations=5 * generations) for i in range(2)]
            if generations:
                islands = [P.evolve(size, 4096, [islands[1 - i][0], *islands[i]], 10 * k + i + 5, generations) for i in range(2)]
            out += sum(len(p[0]) for p in islands) - 2 * -(-sum(size) // 4096)
        return out

    start = excess(0)
    assert not crossed
    assert excess(8) < start and crossed


def test_individuals_are_scored_once(monkeypatch):
    scored, plain = [], P.fitness
    monkeypatch.setattr(P, "fitness", lambda *args: (scored.append(1), plain(*args))[1])
    size = np.random.default_rng(4).integers(1000, 1900, 300).tolist()
    P.evolve(size, 4096, [], 0, 20, most_generations=0)
    assert len(scored) <= 4 + 20


def test_words_between_signs_need_no_pattern():
    """Their ids are the library's, as are those of chunks that look like them."""
    coder, split = ChunkTokenizer(vocabulary_path("word_bpe_49k.json")), []
    plain = coder.find
    coder.find = lambda text: (split.append(text), plain(text))[1]
    simple = ["haus&&&", '"word",', "(so)", "année", "l'", "Été...", "ñu&&"]
    odd = ["'she", "\"'she", "don't,", "''s", "été's", "'été", "İzmir,", "<|endoftext|>", "(<|endoftext|>)", "<|", "a<|", "a1,", "&&&", "ªº,", "́a,", "ﬁ,", "K,"]
    for texts in (simple, odd, simple + odd):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in coder.encode(texts)] == [coder.library.encode(t, add_special_tokens=False).ids for t in texts]
        if texts is simple:
            assert not split
    assert split
