import random
import re
from itertools import permutations
from math import factorial

import duckdb
import pytest

from minuteworks.llm import filter_audit as A
from minuteworks.llm.queries import OP11_SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mask_of(text):
    words = WORD.findall(text)
    bad = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text)]
    return "".join(x for x, b in zip("ABCD", bad) if b)


def plain(docs, labels):
    """``docs``: (id, text, lang); ``labels``: (id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    order = lambda i: (i is None, i or 0)
    least = {}
    for i, text, _ in docs:
        least[text or ""] = min(least.get(text or "", order(i)), order(i))
    rows = {}
    for i, text, lang in docs:
        text = text or ""
        rows.setdefault(lang or "", []).append((mask_of(text) + ("E" if order(i) > least[text] else ""), i in good, i in toxic))
    out = []
    for part, found in rows.items():
        steps, shapley = [], dict.fromkeys("ABCDE", 0)
        for o in permutations("ABCDE"):
            left = found
            for k, x in enumerate(o, 1):
                gone, left = [r for r in left if x in r[0]], [r for r in left if x not in r[0]]
                shapley[x] += len(gone)
                steps.append((part, "".join(o), k, len(left), len(gone), sum(x in r[0] for r in found) - len(gone), sum(r[0] == x for r in found), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_every_order_once_by_adjacent_swaps():
    for n in range(7):
        order = list("ABCDEFGH"[:n])
        seen = {"".join(order)}
        for p in A.adjacent_swaps(n):
            order[p : p + 2] = order[p + 1], order[p]
            seen.add("".join(order))
        assert len(seen) == factorial(n)


def test_swapped_diagram_is_the_diagram_of_its_order():
    rng = random.Random(3)
    for _ in range(30):
        counts = {"".join(x for x in "ABCD" if rng.random() < 0.4): (rng.randint(1, 9),) for _ in range(rng.randint(1, 12))}
        swapped = A.Diagram("ABCD", counts)
        for p in A.adjacent_swaps(4):
            swapped.swap(p)
            fresh = A.Diagram("".join(swapped.order), counts)
            assert list(swapped.all_pass()) == list(fresh.all_pass())
            assert shape(swapped.root) == shape(fresh.root)


def shape(node):
    return node if node is None or node[0] == "leaf" else (node[0], shape(node[1]), shape(node[2]))


def test_nulls_ties_repeats_long_texts_and_clashing_names(spark):
    long = "word " * 300_000
    many = " ".join(f"w{k}" for k in range(250))
    docs = [
        (1, many, "en"), (2, many, "de"), (3, many, "en"), (4, None, "en"), (5, "", None), (6, "", ""), (7, long, "en"), (8, long, "en"), (9, many + " #", "de"), (9, many + " #", "de"),
        (None, many, "en"), (None, "only without id", "fr"), (None, "only without id", "fr"), (10, "ABC Def", "en"), (11, " ".join("ab" * 10), "en"), (12, "É" * 10 + "A", "en"), (13, many.upper(), "es"), (13, "other text", "en"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (3, None, 1), (9, 1, None), (None, 1, 1), (99, 1, 1), (13, 1, 0)]
    d = spark.createDataFrame([(*r, 0, "x", "y", "z") for r in docs], "doc_id long, text string, lang string, id int, hash string, mask string, good string")
    m = spark.createDataFrame([(*r, "q") for r in labels], "doc_id long, quality int, toxic int, mask string")
    got = rows_of(A.filter_audit(d, m))
    assert got == plain(docs, labels)
    assert len(got) == 600 * len({r[2] or "" for r in docs})
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert A.filter_audit(none, m).count() == 0
    assert rows_of(A.filter_audit(d, m.limit(0))) == plain(docs, [])


def test_other_filters_and_bad_names(spark):
    docs = spark.createDataFrame([(1, "ab", "x"), (2, "b", "x"), (3, "ab", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    masks = A.failure_masks(docs, labels, lambda t: {"P": t.contains("a"), "N": t.isNull()}, copies="Z")
    assert {r["mask"]: r.docs for r in masks.collect()} == {"P": 1, "PZ": 1, "": 1}
    assert A.audit_filters(masks, "PZN").count() == 18
    for names in ("", "AA", "ABCDEFGHI"):
        with pytest.raises(ValueError):
            A.audit_filters(masks, names)


def test_whole_table_against_brute_force_and_sql(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    want = plain([(r.doc_id, r.text, r.lang) for r in docs.collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    frame = A.filter_audit(docs, labels)
    assert rows_of(frame) == want
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(frame.columns)} FROM ({OP11_SQL})").fetchall()) == want
