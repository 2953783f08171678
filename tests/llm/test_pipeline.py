from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as C
from minuteworks.llm import quality as Q
from minuteworks.llm import secrets as X
from minuteworks.llm.common import table
from tests.llm.test_minhash import brute
from tests.llm.test_packing import checked


def test_masks():
    text = "a password=abcdefghijklmnop0123456789abcdef b " + "AKIA" + "A" * 16
    spans = X.find_secrets(text, X.token_counter("byte_bpe_50k.tiktoken"))
    assert X.masked(text, spans, "[secret]") == "a [secret] b [secret]"
    assert X.masked("plain", [], "[secret]") == "plain"


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = Q.train(docs, Q.grade_of(table(spark, sf_dir, "labels")))
    good = {i: r.text for i, r in rows.items() if model.tails([Q.features(r.text or "")])[0, -1] >= 0.5}
    first = {}
    for i, t in sorted(good.items(), key=lambda r: (-len(r[1] or ""), r[0])):
        first.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), i)
    single = {i: good[i] for i in first.values()}
    kept = [i for i, v in brute(list(single.items())).items() if v[2]]
    count = X.token_counter("byte_bpe_50k.tiktoken")
    final = {i: [X.masked(t, X.find_secrets(t, count), "[secret]")] for i in kept if (t := single[i] or "") is not None}
    out = C.run(spark, sf_dir).collect()
    assert {r.doc_id for r in out} == set(final)
    by = defaultdict(list, final)
    checked(out, by, 4096)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert len(C.STAGES) == 5


ROWS = [
    (1, "plain words of a fair text " * 20, "en", "a", 1, "x", "y"),
    (1, "plain words of a fair text " * 20, "en", "a", 1, "x", "y"),
    (2, None, None, None, None, None, None),
    (None, "plain words of a fair text " * 20, "en", "a", 1, "x", "y"),
    (3, "", "en", "a", 0, "x", "y"),
    (4, "one two three four five six seven eight", "en", "a", 1, "x", "y"),
    (4, "token=abcdefghijklmnop0123", "en", "a", 1, "x", "y"),
    (5, "one two three four five six seven  EIGHT", "en", "a", 1, "x", "y"),
]


def stage_input(spark, columns="_dropped string, _gone string"):
    return spark.createDataFrame(ROWS, f"doc_id long, text string, lang string, source string, n_chars int, {columns}")


def test_stages_take_nulls_repeats_and_any_columns(spark, sf_dir):
    """Null ids and texts, empty texts, repeated rows and ids, and names that operators use inside."""
    for columns in ("_dropped string, _gone string", "id string, key string", "of string, rep string", "h string, rank string", "kept string, length string"):
        docs = stage_input(spark, columns)
        left = {name: stage(spark, docs, sf_dir) for name, stage in C.STAGES}
        for name, _ in C.STAGES[:-1]:
            assert left[name].columns == docs.columns
        rows = lambda name: sorted(((r.doc_id, r.text) for r in left[name].collect()), key=str)
        both = sorted(((r[0], r[1]) for r in ROWS), key=str)
        assert set(rows("quality")) <= set(both)
        # equal texts: doc 1 twice (its id is the smallest), the null id stays, of null and empty text the smaller id
        assert rows("exact_dedup") == sorted([r for r in both if r != (3, "")], key=str)
        # 4 and 5 are one set of words: all rows of 4 stay, 5 goes; blank ones and the null id stay
        assert rows("minhash_dedup") == sorted([r for r in both if r[0] != 5], key=str)
        assert len(rows("secrets")) == len(ROWS) and (4, "[secret]") in rows("secrets") and (2, None) in rows("secrets")
        packed = left["packing"].collect()
        assert len(packed) == len(ROWS) and {r.doc_id for r in packed} == {1, 2, 3, 4, 5, None}


def test_very_long_texts_in_the_row_wise_stages(spark, sf_dir):
    """A fair text of a megabyte stays whole through quality; secrets anywhere in one are masked, the rest stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fair = " ".join(r.text for r in docs.where("lang = 'en' AND length(text) > 1500").orderBy("doc_id").limit(60).collect())
    long = (fair + " ") * (1_000_000 // len(fair) + 1)
    rows = docs.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(1).withColumn("text", F.lit(long)))
    graded = C.quality(spark, docs.unionByName(rows.where("text IS NOT NULL").withColumn("doc_id", F.lit(10**9).cast("long"))), sf_dir)
    kept = graded.where("doc_id = 1000000000").collect()
    assert [r.text for r in kept] == [long]
    secret = "password=abcdefghijklmnop1"
    planted = rows.withColumn("text", F.concat(F.lit(secret + " "), "text", F.lit(" " + secret)))
    (got,) = C.secrets(spark, planted, sf_dir).where("text IS NOT NULL").collect()
    assert got.text.startswith("[secret] ") and got.text.endswith(" [secret]") and secret not in got.text and len(got.text) > 1_000_000
    assert C.secrets(spark, rows.limit(0), sf_dir).count() == 0
