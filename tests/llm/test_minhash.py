import numpy as np

from minuteworks.llm import minhash as M
from minuteworks.llm.graph import connected_components


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) or frozenset([tuple(words)])


def brute(rows, width=5, percent=80):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if s and t and min(len(s), len(t)) >= 0.8 * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_components(spark):
    edges = [(2, 1), (3, 2), (9, 8), (8, 7), (5, 5)] + [(k, k + 1) for k in range(100, 160)] + [(1000, k) for k in range(1001, 1050)] + [(160, 1049)]
    df = connected_components(spark.createDataFrame(edges, "a long, b long"))
    found = {r.id: r.component for r in df.collect()}
    want = {2: 1, 3: 1, 8: 7, 9: 7, **{k: 100 for k in [*range(101, 161), *range(1000, 1050)]}}
    assert found == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_planted_groups(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for group in range(6):
        base = list(rng.choice(words, 200))
        for _ in range(25):  # near the threshold: a chain of copies of copies too
            copy = list(base)
            for at in rng.integers(0, 200, rng.integers(0, 16)):
                copy[at] = words[rng.integers(3000)]
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.3:
                base = copy
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one "), (n + 6, rows[3][1]), (n + 7, rows[3][1].upper()), (n + 8, "a b " * 40_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_shingles int, key string")
    for width in (2, 5):
        assert got(M.minhash_components(docs, width=width)) == brute(rows, width)
    assert sorted(r.doc_id for r in M.drop_near_copies(docs).collect()) == sorted(i for i, v in brute(rows).items() if v[2])
    assert M.drop_near_copies(docs).columns == docs.columns


def test_rest_of_a_bucket_is_compared(spark):
    """0 is near 1 and 2 is near 3, but 0 is not near 2: the pass over rests must find 2 and 3."""
    base = [f"w{k}" for k in range(400)]
    far = [*base[:300], *(f"z{k}" for k in range(100))]
    rows = [(0, " ".join(base)), (1, " ".join(base + ["e"])), (2, " ".join(far)), (3, " ".join(far + ["f"])), (4, " ".join(far[:-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(M.minhash_components(docs, width=2)) == brute(rows, 2)


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "x y z"), (7, "x y z"), (9, "a b c")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.component_id, r.kept) for r in M.minhash_components(docs).collect()), key=str)
    assert rows == sorted([(None, None, True), (4, 4, True), (4, 4, True), (7, 4, False), (9, 4, False)], key=str)
    assert M.minhash_components(docs.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(M.minhash_components(docs, width=2)) == brute(rows, 2)


def test_tiles_of_a_hot_bucket_lose_no_link(spark, monkeypatch):
    """Many edits of one text, most of them near 0.8: tiles of three rows find what a comparison of all finds."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(120):
        copy = list(base)
        for at in rng.integers(0, 120, rng.integers(5, 14)):
            copy[at] = f"e{rng.integers(40)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole, seen = M.links_of_rest, []

    def in_small_tiles(*args):
        seen.append(whole(*args, tile_rows=3))
        return seen[-1]

    monkeypatch.setattr(M, "links_of_rest", in_small_tiles)
    got_small = got(M.minhash_components(docs, width=2))
    assert got_small == brute(rows, 2) and len(seen) == 1


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(12)
    for n in (1, 3, 40, 500, 1100):
        one = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        other = np.unique(np.concatenate([one[: -(-9 * len(one) // 10)], rng.integers(0, 1 << 62, n // 10).astype(np.uint64)]))
        sets, size = [one, other], np.array([len(one), len(other)])
        both = len(np.intersect1d(one, other))
        near = 100 * both >= 80 * (size.sum() - both)
        zero = np.zeros((2, 2), np.int64)
        hit = M.possible(np.array([1, 2]), np.array([1, 1]), size, zero, zero, [M.bitmap(s) for s in sets], np.zeros(2, int), 0, 80)
        assert hit.all() or not near
        assert (M.set_links(sets, 80).tolist() == [0, 0]) == near
