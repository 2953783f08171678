from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from minuteworks.llm import pieces as P
from minuteworks.llm.tokens import vocabulary_path

PATH = vocabulary_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = ["", " ", "  ", "a", " a", "a ", "  two  spaces  ", "line\nbreak\n\n x", "▁ mark ▁▁x", "é ü 日本語 😀 \u0000", "</s> <s> <unk> <0x0A>", "word " * 30_000, "x" * 5000, "\t tab   nbsp　"]


def check(text, coder):
    ids, named = coder.ids(text)
    assert ids.tolist() == LIBRARY.encode(text) and named == " ".join(map(str, ids))
    begins, ends = coder.spans(text, ids)
    data = text.encode()
    proto = LIBRARY.encode(text, return_type="proto")
    assert len(ids) == len(begins) == len(ends)
    for p, a, z in zip(proto.pieces, begins, ends):
        assert 0 <= a <= z <= len(data)
        assert data[a:z].decode() == p.surface
    assert b"".join(data[a:z] for a, z in zip(begins, ends)) == data


@pytest.mark.parametrize("text", TEXTS)
def test_cases(text):
    check(text, P.piece_coder("piece_bpe_32k.model"))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab ▁é\n日😀.1"), max_size=30))
def test_any_text(text):
    check(text, P.piece_coder("piece_bpe_32k.model"))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_compiled_map_against_the_library(rule):
    from sentencepiece import sentencepiece_model_pb2

    own = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(own.serialized_model_proto())
    normalize = P.Normalizer(model.normalizer_spec)
    for text in [*TEXTS[:11], "ﬁne Ａｂｃ ①½ ㌔ é ＡＢＣ  　x　", "ΑΒΓ ß İ", "a​b ­ c"]:
        want = own.normalize(text)
        norm, place = normalize(text)
        assert norm.decode() == want
        assert len(place) == len(norm) + 1 and (np.diff(place) >= 0).all() and place[-1] <= len(text.encode())


def test_query_rows(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, None, "x"), (3, "again", "x")]
    got = P.piece_digests(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    want = []
    for doc_id, text, _ in rows:
        ids = LIBRARY.encode(text or "", add_eos=True)
        want.append((doc_id, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str)
    spans = {r.doc_id: r for r in P.encode_with_offsets(spark.createDataFrame([(1, "a é")], "doc_id long, text string")).collect()}[1]
    assert spans.ids[-1] == 2 and spans.begins[-1] == spans.ends[-1] == 4 and len(spans.ids) == len(spans.ends)
    assert P.piece_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in P.piece_digests(docs).collect():
        ids = LIBRARY.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == sha256(LIBRARY.decode(ids).encode()).hexdigest()
