import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from minuteworks.llm import simple8b as S
from minuteworks.llm.tokens import ChunkTokenizer, vocabulary_path

WIDE = st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(WIDE, max_size=400), st.sampled_from([7, 64, 2048]))
def test_round_trip(values, block):
    ids = np.array(values, np.uint64)
    found = [S.decode_words(w, e) for w, e in S.encode_blocks(ids, block)]
    assert np.array_equal(np.concatenate(found) if found else ids[:0], ids)


def test_words_are_filled():
    assert len(S.encode_blocks(np.zeros(60, np.uint64), 60)[0][0]) == 1
    assert len(S.encode_blocks(np.full(4, 2**15 - 1, np.uint64), 60)[0][0]) == 1
    words, escapes = S.encode_blocks(np.array([2**60], np.uint64), 60)[0]
    assert words[0] & np.uint64(15) == S.ESCAPE and list(escapes) == [2**60]


TEXTS = ["", None, "Hello, world's end", "éÀ œuf ß İ Σς ﬁ", "a b\x1cc d", "éx 12x3!?", "日本語 テスト", "word " * 5000, "<|endoftext|> x<|startoftext|>", "\t\n ", "don't I'll 've"]


def test_files_match_the_library(spark):
    rows = [(k * 7 if k else None, t, k) for k, t in enumerate(TEXTS)] + [(7, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = sorted(map(tuple, S.token_files(docs).collect()), key=lambda r: r[1])
    library = ChunkTokenizer(vocabulary_path("word_bpe_49k.json")).library
    want, start = [], 0
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(str((r[0], r[2], r[3])) for r in got) == sorted(map(str, want))
    for r in got:
        assert r[1] == start
        start += r[2]


def test_empty_table(spark):
    assert S.token_files(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_matches_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    library = ChunkTokenizer(vocabulary_path("word_bpe_49k.json")).library
    start = 0
    got = {r.doc_id: r for r in S.token_files(docs).collect()}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
