"""Token ids of whole texts by the ``tokenizers`` library, one call for each distinct word.

The tokenizer (lower case, split by a pattern, byte-pair merges inside each split) never merges
across white space, so a text's ids are the ids of its chunks between ASCII white space, one after
the other.  Chunks and the words inside them repeat: Arrow finds the distinct chunks of a slice, a cache
bounded in bytes keeps the ids of words in each Python worker, and only other words reach the library.
Most chunks are one word between signs (`"word",`), which needs no pattern.
Chunks outside the Latin blocks, where normalisation may change more than case, go to the library whole.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: How the vocabulary's pre-tokenizer splits lower-case text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Printable characters of the Latin blocks: each is its own NFC form, and lower() maps each alone.
PLAIN = regex.compile(r"[!-~¡-ɏ]+")
#: ASCII characters that the pattern takes in one run.
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
BYTE_SIGNS = SIGNS.encode()


def vocabulary_path(name: str) -> str:
    """Where the vocabulary lies on the machine that runs this; called inside tasks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter for each byte in byte-level vocabularies: printable bytes stand for themselves,
    the others for the letters from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in own)
    moved = {b: 0x100 + k for k, b in enumerate(rest)}
    return [chr(moved.get(b, b)) for b in range(256)]


class WordCache:
    """Ids of words, bounded in bytes: when the newer half is full it becomes the older half, and what is
    found there moves on, so frequent words stay.  Long words are not kept."""

    def __init__(self, most_bytes: int, longest: int = 64):
        self.half, self.longest, self.held = most_bytes // 2, longest, 0
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def keep(self, word: bytes, ids: bytes) -> None:
        if len(word) <= self.longest:
            self.new[word] = ids
            self.held += len(word) + len(ids) + 180  # two objects and a slot
            if self.held > self.half:
                self.old, self.new, self.held = self.new, {}, 0


class ChunkTokenizer:
    def __init__(self, path: str, most_bytes: int = 60_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.words = WordCache(most_bytes)
        self.find = regex.compile(WORDS).findall
        self.letters = byte_letters()

    def _word(self, word: bytes) -> bytes:
        """The ids of a lower-case word that the pattern does not split."""
        ids = self.words.new.get(word)
        if ids is None:
            ids = self.words.old.get(word)
            if ids is None:
                mapped = word.decode() if word.isascii() else "".join([self.letters[b] for b in word])
                ids = array("I", [t.id for t in self.tokenize(mapped)]).tobytes()
            self.words.keep(word, ids)
        return ids

    def _chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():
            return self._word(chunk.lower())
        core = chunk.strip(BYTE_SIGNS)
        if core.isalpha():
            head, _, tail = chunk.partition(core)
            if head != b"'" and b"<|" not in head:  # 's and others are split; special tokens are whole
                ids = self._word(core.lower())
                return (self._word(head) if head else b"") + ids + (self._word(tail) if tail else b"")
        text = chunk.decode("utf-8", "replace")
        if not PLAIN.fullmatch(text) or "<|" in text:
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        text = text.lower()
        if text.isalpha():
            return self._word(text.encode())
        core = text.rstrip(SIGNS)
        if core.isalpha():
            return self._word(core.encode()) + self._word(text[len(core) :].encode())
        return b"".join([self._word(w.encode()) for w in self.find(text)])

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids end.  Only distinct chunks
        become Python objects."""
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens keep their case
            texts = pc.ascii_lower(texts)
        # ASCII white space only: what else counts as white space is left to the library
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        # far quicker than to_pylist
        distinct = coded.dictionary.cast(pa.binary() if coded.dictionary.type == pa.string() else pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        known = self.words.new.get
        values = [known(c) or self._chunk(c) if c else c for c in distinct]
        pool = np.frombuffer(b"".join(values), "<u4")
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        start = np.cumsum(size) - size
        codes = coded.indices.to_numpy()
        out = []
        for at in range(0, len(codes), 1 << 18):
            part = codes[at : at + (1 << 18)]
            n = size[part]
            before = np.cumsum(n) - n
            out.append(pool[np.repeat(start[part] - before, n) + np.arange(n.sum())])
        ends = np.concatenate([[0], np.cumsum(size[codes])])[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]
        return np.concatenate(out) if out else np.empty(0, "<u4"), ends

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_array(pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()))
        return [ids[a:z].tobytes() for a, z in zip([0, *ends[:-1].tolist()], ends.tolist())]


@lru_cache(maxsize=2)
def chunk_tokenizer(name: str) -> ChunkTokenizer:
    """One for each Python worker and vocabulary."""
    return ChunkTokenizer(name if os.path.sep in name else vocabulary_path(name))


def slices_of(texts: pa.Array, most_bytes: int = 1_000_000):
    """Bounds of slices of about ``most_bytes``, taken before any text becomes a Python string."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    ends = np.cumsum(size) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(size)]
    return [(int(a), int(z)) for a, z in zip(cuts, cuts[1:]) if z > a]
