"""Byte-level BPE: encoding by backtracking from longest matches, and decoding.

A sequence of tokens is the BPE of its bytes exactly when each two neighbours alone are the BPE of theirs:
merges run by rank, so what happens within two neighbours does not depend on the rest as long as nothing
merges across their outer ends, and the first merge across a boundary would happen to the pair alone, too.
So a text is encoded from the left by longest tokens; where a token does not go with the one before it, the
next shorter one is tried, and where none goes, the token before it is shortened.  At every place only one
token can end (the last one of the BPE up to there), so a place that led nowhere is never entered again and
the time is linear.  Bytes stand as Latin-1 characters for the Aho-Corasick automaton that finds the longest
tokens.  Whether two tokens go together is found once by merging their bytes, and remembered.
"""

from __future__ import annotations

import base64
import os
import sys
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteworks.llm.common import text_or_empty
from minuteworks.llm.tokens import slices_of, vocabulary_path


#: Signs that are a match of their own after letters (not the apostrophe, which may begin a contraction).
SIGNS = frozenset(".,;:!?)")


class Memo:
    """A dictionary bounded in bytes: when the newer half is full it becomes the older half, and what is
    found there moves on.  Values are small or kept only for keys up to ``longest`` characters."""

    def __init__(self, most_bytes: int, longest: int = 64):
        self.half, self.longest, self.held = most_bytes // 2, longest, 0
        self.new, self.old = {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        number = isinstance(key, int)
        if number or len(key) <= self.longest:
            self.new[key] = value
            self.held += 100 if number else sys.getsizeof(key) + sys.getsizeof(value) + 100  # and a slot
            if self.held > self.half:
                self.old, self.new, self.held = self.new, {}, 0


class ByteCoder:
    def __init__(self, path: str, pattern: str, most_bytes: int = 160_000_000):
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        if missing := [b for b in range(256) if bytes([b]) not in self.rank]:
            raise ValueError(f"no token for the bytes {missing}")
        self.pieces = regex.compile(pattern).findall
        self.alone = [array("I", [k]).tobytes() for k in range(max(self.rank.values()) + 1)]
        self.token = [b""] * (max(self.rank.values()) + 1)
        self.size = array("i", [0]) * len(self.token)
        automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.token[rank], self.size[rank] = token, len(token)
            automaton.add_word(token.decode("latin-1"), rank)
        automaton.make_automaton()
        self.matches = automaton.iter
        #: for every token the next shorter one that begins like it, or -1
        self.shorter = array("i", [-1]) * len(self.token)
        for token, rank in self.rank.items():
            self.shorter[rank] = next((self.rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank), -1)
        self.together, self.bare, self.spaced = Memo(most_bytes // 4), Memo(most_bytes // 8), Memo(most_bytes * 5 // 8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens are the BPE of their bytes; ``left`` is -1 for the first token of all,
        which has to be the BPE of its own."""
        key = left << 32 | right
        found = self.together.get(key)
        if found is None:
            found = self._stay_apart(self.token[left] if left >= 0 else b"", self.token[right])
            self.together.put(key, found)
        return found

    def _stay_apart(self, left: bytes, right: bytes) -> bool:
        rank, border, data = self.rank.get, len(left), left + right
        never = len(self.token)
        ends = [*range(len(data) + 1)]
        best = [rank(data[k : k + 2], never) for k in ends[:-2]]
        while best and (least := min(best)) < never:
            k = best.index(least)
            if ends[k + 1] == border:
                return False
            del ends[k + 1], best[k]
            if k < len(best):
                best[k] = rank(data[ends[k] : ends[k + 2]], never)
            if k:
                best[k - 1] = rank(data[ends[k - 1] : ends[k + 1]], never)
        return len(ends) == (3 if left else 2)

    def piece(self, data: bytes) -> bytes:
        """The ids of one match of the pattern."""
        whole = self.rank.get(data)
        if whole is not None:
            return self.alone[whole]
        size, shorter, known = self.size, self.shorter, self.together.new
        end = len(data)
        longest = [0] * end if end < 64 else array("i", bytes(4 * end))
        for to, rank in self.matches(data.decode("latin-1")):
            longest[to + 1 - size[rank]] = rank  # ends ascend, so the longest comes last
        blocked, out, at, token, before = bytearray(end + 1), array("I"), 0, longest[0], -1
        while True:
            to = at + size[token]
            if not blocked[to]:
                fits = known.get(before << 32 | token)
                if fits is None:
                    fits = self.compatible(before, token)
                    known = self.together.new
                if fits:
                    out.append(token)
                    if to == end:
                        return out.tobytes()
                    at, before, token = to, token, longest[to]
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:
                blocked[at] = 1
                token = out.pop()
                at -= size[token]
                before = out[-1] if out else -1

    def _pieces(self, text: str) -> bytes:
        out, get = [], self.bare.get
        for piece in self.pieces(text):
            ids = get(piece)
            if ids is None:
                ids = self.piece(piece.encode())
                self.bare.put(piece, ids)
            out.append(ids)
        return b"".join(out)

    def _spaced(self, word: str) -> bytes:
        """The ids of a word after one space.  Letters are one match, and so is a sign after them."""
        ids = self.spaced.get(word)
        if ids is None:
            if word.isalpha():
                ids = self.piece(b" " + word.encode())
            elif word[-1] in SIGNS and word[:-1].isalpha():
                return self._spaced(word[:-1]) + self.alone[self.rank[word[-1].encode()]]
            else:
                ids = self._pieces(" " + word)
            self.spaced.put(word, ids)
        return ids

    def ids(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers.

        The pattern always cuts before one space between two characters that are no white space, so what
        stands between such spaces is looked up as a whole; texts with other white space beside a space
        are looked up match by match.
        """
        head, *words = text.split(" ")
        if not words:
            return self._pieces(head)
        if not head or head[-1].isspace():
            return self._pieces(text)
        found = list(map(self.spaced.new.get, words))
        if None in found:
            if any(f is None and (not w or w[0].isspace() or w[-1].isspace()) for w, f in zip(words, found)):
                return self._pieces(text)
            known = self._spaced
            found = [known(w) if f is None else f for w, f in zip(words, found)]
        return self._pieces(head) + b"".join(found)


@lru_cache(maxsize=2)
def byte_coder(vocabulary: str, pattern: str | None) -> ByteCoder:
    """One for each Python worker, vocabulary and pattern."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return ByteCoder(vocabulary if os.path.sep in vocabulary else vocabulary_path(vocabulary), pattern)


@lru_cache(maxsize=2)
def token_table(vocabulary: str) -> pa.Array:
    """The bytes of each id; ids without a token are null."""
    with open(vocabulary if os.path.sep in vocabulary else vocabulary_path(vocabulary), "rb") as file:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, file)}
    return pa.array([found.get(k) for k in range(max(found) + 1)], pa.binary())


def encode_bytes(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, without special tokens.

    ``vocabulary`` is a file of ranks and ``pattern`` cuts texts into what is merged separately (the
    vocabulary package's own by default).  No shuffle.  A null text is an empty one, which has no ids;
    repeated ids have a row each; a null id stays null; other columns are ignored, whatever they are
    called; an empty table gives an empty result.  A text has to fit a worker as one string; a match of
    the pattern takes about six bytes for each of its bytes while it is merged.
    """

    def run(batches):
        coder = byte_coder(vocabulary, pattern)
        for batch in batches:
            for a, z in slices_of(batch.column(1)):
                found = [coder.ids(text) for text in batch.column(1)[a:z].to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
                ids = pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], pa.ListArray.from_arrays(pa.array(offsets), ids)], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_bytes(coded: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``doc_id, ids, data``: the bytes that the ids of each row of ``coded`` (``doc_id, ids``) stand for.
    Null ids are none; an id outside the vocabulary is an error."""

    def run(batches):
        table = token_table(vocabulary)
        size = pc.fill_null(pc.binary_length(table), 0).to_numpy()
        for batch in batches:
            lists = pc.fill_null(batch.column(1), pa.scalar([], pa.list_(pa.int32())))
            lengths = np.asarray(pc.list_value_length(lists))
            ends = np.cumsum(lengths)
            every = lists.flatten()
            bytes_to = np.concatenate([[0], np.cumsum(size[every.to_numpy()])])
            parts = bytes_to[ends] // 64_000_000
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(lengths)]
            for a, z in zip(cuts, cuts[1:]):
                if z == a:
                    continue
                first = int(ends[a] - lengths[a])
                tokens = pc.take(table, every[first : int(ends[z - 1])])
                if tokens.null_count:
                    raise ValueError("an id stands for no token")
                data = b"".join(tokens.to_pylist()) if tokens.offset else tokens.buffers()[2]
                offsets = (np.concatenate([[first], ends[a:z]]) - first).astype(np.int64)
                offsets = (bytes_to[offsets + first] - bytes_to[first]).astype(np.int32)
                texts = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(offsets.tobytes()), data if data is not None else pa.py_buffer(b"")])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], lists[a:z], texts], names=["doc_id", "ids", "data"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, data binary")


def byte_digests(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, decodes the ids, and digests both: ``doc_id, n_tokens, ids_sha256`` of the
    decimal ids with commas between them, and ``decoded_sha256`` of the decoded bytes."""
    coded = encode_bytes(docs, vocabulary, pattern, id_col, text_col)
    return decode_bytes(coded, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256")
    )
