from pyspark.sql import functions as F

from minuteworks.llm.exact_dedup import drop_exact_copies, exact_dedup

ROWS = [(1, "a b"), (2, "ab"), (3, " a\tb "), (4, None), (5, ""), (6, " \n"), (7, "A b"), (8, "é"), (9, "é "), (10, "a b"), (11, "x" * 200_000), (12, "x" * 200_000)]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in ROWS], "doc_id long, text string, h int, norm string")
    want = {}
    strip = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    for i, t in ROWS:
        group = [(-len(u or ""), j) for j, u in ROWS if strip(u) == strip(t)]
        want[i] = (min(group)[1], len(group), min(group)[1] == i)
    for hash_of in (lambda c: F.unhex(F.md5(c)), lambda c: F.lit(b"one for all")):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs, hash_of=hash_of).collect()}
        assert got == want
    assert drop_exact_copies(docs).columns == docs.columns
    assert sorted(r.doc_id for r in drop_exact_copies(docs).collect()) == sorted(i for i, w in want.items() if w[2])


def test_empty_null_and_repeated_ids(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a"), (2, "a"), (2, "a")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()) == [(0, 2, 3, False), (2, 2, 3, True), (2, 2, 3, True)]
