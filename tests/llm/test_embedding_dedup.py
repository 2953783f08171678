import numpy as np
import pytest

from minuteworks.llm import embedding_dedup as E


def brute(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links, parent = {}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, x) in enumerate(good):
        for j, y in good[:n]:
            if len(x) == len(y) and (x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold or np.array_equal(x, y)):
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (links.get(i, 0), find(i), find(i) == i) for i, _ in rows}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("tile_rows, most_cells", [(4096, 256), (25, 8), (10, 1)])
def test_clusters(spark, tile_rows, most_cells):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        center = rng.normal(size=24) * np.linspace(3, 0.2, 24)
        for _ in range(rng.integers(1, 5) if k else 60):
            rows.append((len(rows) * 3 % 1009, (center + rng.normal(size=24) * rng.choice([0, 0.05, 0.3])).tolist()))
    n = 2000
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 24), (n + 3, [1.0] * 23 + [None]), (n + 4, [float("nan")] * 24), (n + 5, [float("inf")] + [1.0] * 23), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (n + 8, rows[0][1]), (n + 9, rows[0][1])]
    rows = list({r[0]: r for r in rows}.values())
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, key int")
    assert got(E.near_vectors(df, tile_rows=tile_rows, most_cells=most_cells)) == brute(rows)


def test_empty_null_and_repeated_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert E.near_vectors(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 0.0])], schema)
    rows = sorted(((r.vec_id, r.component_id) for r in E.near_vectors(df).collect()), key=str)
    assert rows == sorted([(None, None), (1, 1), (1, 1), (2, 1), (3, 1)], key=str)
    assert got(E.near_vectors(spark.createDataFrame([(1, None)], schema))) == {1: (0, 1, True)}


def test_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert got(E.near_vectors(df)) == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_norms_out_of_range(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [1.0, 1.0]), (5, [5e-324, 5e-324]), (6, [1.0, -1.0]), (7, [1.7e308, -1.7e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(E.near_vectors(df)) == {**{i: (4, 1, i == 1) for i in range(1, 6)}, 6: (1, 6, True), 7: (1, 6, False)}
