import random
from array import array
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from minuteworks.llm import byte_bpe as B
from minuteworks.llm.tokens import vocabulary_path

NAMES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]
TEXTS = ["", " ", "  ", "a", " a", "a ", "two  spaces \n here", "\n\nline\r\n end.\n", "it's he'll 'twas ''s", "日本語 😀 é 　x y", "12 345,6 a1b2", "x" * 5000, "ab" * 40_000, "<|endoftext|>", "tab\tone\x1ctwo \x85 three", "Word, word. (word) \"word\""]
CODERS = {name: B.byte_coder(name, None) for name in NAMES}
LIBRARY = {name: tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.rank, special_tokens={}) for name, coder in CODERS.items()}


def check(text, name=NAMES[0]):
    assert array("I", CODERS[name].ids(text)).tolist() == LIBRARY[name].encode_ordinary(text)


@pytest.mark.parametrize("name", NAMES)
def test_cases(name):
    for text in TEXTS:
        check(text, name)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abehint 's\né日😀.1,"), max_size=40))
def test_any_text(text):
    check(text)


@pytest.mark.parametrize("name", NAMES)
def test_tokens_side_by_side(name):
    rng, tokens = random.Random(5), CODERS[name].token
    for _ in range(3000):
        check(b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6))).decode("utf-8", "ignore"), name)


def test_full_memories_change_nothing():
    small = B.ByteCoder(vocabulary_path(NAMES[0]), public_tokenizers.PATTERN, most_bytes=4000)
    rng = random.Random(8)
    for _ in range(300):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(20))
        assert array("I", small.ids(text)).tolist() == LIBRARY[NAMES[0]].encode_ordinary(text)
    assert small.spaced.held <= 4000


def test_backtracking_needs_no_well_formed_ranks(tmp_path):
    """Ranks in any order, as the library merges them."""
    import base64

    rng = random.Random(2)
    for trial in range(30):
        tokens = [bytes([b]) for b in range(256)]
        extra = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(25)}
        ranks = {t: k for k, t in enumerate(tokens + sorted(extra, key=lambda t: rng.random()))}
        path = tmp_path / f"{trial}.tiktoken"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
        coder, library = B.ByteCoder(str(path), r"\S+|\s+"), tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        for _ in range(200):
            data = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30)))
            got = array("I", coder.piece(data)).tolist()
            assert got == library.encode_ordinary(data.decode())


def test_a_vocabulary_without_all_bytes(tmp_path):
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"YQ== 0")
    with pytest.raises(ValueError):
        B.ByteCoder(str(path), r"\S+")


def want(text):
    ids = LIBRARY[NAMES[0]].encode_ordinary(text)
    return len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest()


def test_query_rows(spark):
    rows = [(k, t, "x", [1]) for k, t in enumerate(TEXTS)] + [(None, None, "x", None), (3, "again", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, data string, ids array<int>")
    got = sorted((tuple(r) for r in B.byte_digests(docs).collect()), key=str)
    assert got == sorted(((r[0], *want(r[1] or "")) for r in rows), key=str)
    assert B.byte_digests(docs.limit(0)).count() == 0


def test_decoding_alone(spark):
    rows = [(1, [64, 65]), (2, []), (3, None), (4, [50000] * 3)]
    tokens = CODERS[NAMES[0]].token
    got = {r.doc_id: bytes(r["data"]) for r in B.decode_bytes(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    assert got == {i: b"".join(tokens[k] for k in ids or []) for i, ids in rows}


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = [tuple(r) for r in B.byte_digests(docs).collect()]
    assert sorted(got) == sorted((i, *want(t)) for i, t in texts.items())
