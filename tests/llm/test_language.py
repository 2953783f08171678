import math
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from minuteworks.llm import language as L


def brute_phrases(text, sample):
    """Phrases of a greedy parse; a symbol that is not in the sample is one."""
    n = i = 0
    while i < len(text):
        j, place = i + 1, 0
        while j < len(text) and (place := sample.find(text[i : j + 1], place)) >= 0:  # no longer phrase stands before it
            j += 1
        n, i = n + 1, j
    return n


def brute_symbols(text, alphabet):
    """Letters of the alphabet, others as five digits, the rest as spaces."""
    out = []
    for c in text.lower():
        if c in alphabet:
            out.append(L.FIRST + alphabet.index(c))
        elif c.isalpha():
            out += [L.DIGIT + int(d, 16) for d in f"{ord(c):05x}"]
        else:
            out.append(L.SPACE)
    return bytes(out)


@settings(max_examples=80, deadline=None)
@given(st.text("abx. 日本", max_size=60), st.lists(st.text("abxq. 日語", min_size=1, max_size=40), min_size=1, max_size=9))
def test_phrases_against_brute_force(sample, texts):
    alphabet, coded = L.learned({"one": [sample + "a", "bb"], "two": ["ba" * 9]}, 2)
    own = L.CrossParser(alphabet, dict(coded))
    got = own.phrases([own.codes(t) for t in texts])
    for row, text in zip(got, texts):
        codes = own.codes(text).tobytes()
        assert codes == brute_symbols(text, alphabet)
        for k, (_, s) in enumerate(coded):
            assert row[k] == brute_phrases(codes, s)


def test_ties_and_large_scripts(spark):
    """Equal entropies: the first language by name.  Scripts of many letters stay apart."""
    alphabet, coded = L.learned({"xb": ["same text here"], "xa": ["same text here"]})
    assert L.CrossParser(alphabet, dict(coded)).predict(["same text", "日本"]) == [("xa", 0.0), ("xa", 0.0)]
    one, two = ("".join(chr(a + k * 7 % 400) + " " * (k % 5 == 0) for k in range(600)) for a in (0x4E00, 0x6000))
    rows = [(k, one, "zh") for k in range(30)] + [(k, two, "zj") for k in range(30, 60)]
    got = L.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    by = {r.doc_id: r for r in got}
    assert {by[k].lang_pred for k in range(30)} == {"zh"} and {by[k].lang_pred for k in range(30, 60)} == {"zj"}


def test_columns_of_any_name_and_long_rows_only(spark):
    rows = [(k, ("the cat sat on the mat " if k % 2 else "der hund und die katze ") * 300, "en" if k % 2 else "de", k, "x", 1) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, id long, of string, h int")
    got = L.identify_language(docs, most_chars=2000).collect()
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in got) and len(got) == 40


def test_whole_query_against_brute_force(spark, sf_dir):
    """Every prediction and score of the table, by a parse of each text with plain string search."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    texts = L.sample_texts(docs, held_out)
    learnable = {}
    for r in docs.where(~held_out).collect():
        learnable.setdefault(r.lang, []).append(r.text or "")
    for lang, parts in texts.items():
        assert all(any(t in text for text in learnable[lang]) for t in parts)  # none held out
        assert sum(map(len, parts)) <= 40_000
    alphabet, coded = L.learned(texts)
    rows = {r.doc_id: r for r in L.identify_language(docs).collect()}
    for d in docs.collect():
        r = rows.pop(d.doc_id)
        if not d.text or not any(map(str.isalpha, d.text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        symbols = brute_symbols(d.text, alphabet)
        bits = {lang: brute_phrases(symbols, s) * math.log2(len(s)) / len(symbols) for lang, s in coded}
        best = min(sorted(bits), key=bits.get)
        second = min(b for lang, b in bits.items() if lang != best)
        assert r.lang_pred == best and abs(r.score - (1 - bits[best] / second)) < 1e-9
    assert not rows


def test_cases(spark):
    rows = [(k, "the cat sat on the mat with a hat " * 4, "en") for k in range(0, 40)] + [(k, "der hund und die katze sind zu haus " * 4, "de") for k in range(40, 80)]
    rows += [(k, t, "en") for k, t in ((200, "½ ²"), (201, "Ⅷ ①"), (202, "٣ 12 _"))] + [(203, "ª", "en")]  # numbers are no letters
    rows += [(100, None, "en"), (101, "123 .. !", "de"), (102, "", None), (103, "und die katze " * 30_000, None), (104, "日本語", None), (None, "the cat", "en"), (1, "the mat", "en")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = [r.asDict() for r in L.identify_language(docs).collect()]
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[k]["lang_pred"] for k in (100, 101, 102, 103, None)] == ["und", "und", "und", "de", "en"]
    assert [by[k]["lang_pred"] == "und" for k in (200, 201, 202, 203)] == [True, True, True, False]
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert L.identify_language(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify_language(docs.drop("lang").selectExpr("*", "cast(null as string) AS lang")).collect()} == {"und"}


def test_long_rows_teach(spark):
    """A language whose rows are all long is learned from passages of all of it, and shares are fair."""
    assert L.fair_shares([10, 1000, 50, 1000], 300) == [10, 120, 50, 120] and L.fair_shares([5, 5], 100) == [5, 5] and L.fair_shares([], 5) == []
    rows = [(k, "uno dos tres cuatro cinco " * 400 + "zwanzig " * 400, "mix") for k in range(20)] + [(k, "the cat sat on the mat", "en") for k in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = L.sample_texts(docs, F.lit(False), most_docs=8, most_chars=4000)
    assert sum(map(len, texts["mix"])) <= 4000 and any("zwanzig" in t for t in texts["mix"]) and any("cuatro" in t for t in texts["mix"])
    assert all(t == "the cat sat on the mat" for t in texts["en"])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
