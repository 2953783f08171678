"""SentencePiece encoding that keeps offsets, and decoding.

The text is normalised here by the model's compiled character map (a double-array trie): at every
place the longest prefix with a rule is replaced, else one character is copied, and each normalised
byte remembers the source byte it came from.  Every piece is then projected to the span of original
bytes that it stands for.

No piece has anything but the space mark before a space mark, so no merge runs from one word into the
next: a text's ids are those of its words, and words repeat.  A bounded cache in each worker keeps
them; new words go to the ``sentencepiece`` library.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteworks.llm.common import text_or_empty
from minuteworks.llm.tokens import slices_of, vocabulary_path

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*")


class CharacterMap:
    """Longest-prefix rules of a compiled map: the trie's size, its units, replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.texts = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of ``data[at:]`` with a rule, and its replacement."""
        units = self.units
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        found, node = None, offset(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            unit = units[node]
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.texts.index(b"\0", found[1])
        return found[0], self.texts[found[1] : end]


class Normalizer:
    def __init__(self, spec):
        self.rules = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and the end) the source byte it stands for."""
        data = text.encode("utf-8", "replace")
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.rules.units and not self.squeeze and self.escape:
            return self._plain(data)
        return self._general(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Without rules: every character copied, every space a mark of three bytes."""
        raw = np.frombuffer(data, np.uint8)
        place = np.arange(len(raw))
        place = np.maximum.accumulate(np.where(raw & 0xC0 != 0x80, place, 0))
        place = np.repeat(place, np.where(raw == 0x20, 3, 1))
        head = 3 if self.prefix else 0
        norm = (MARK.encode() if self.prefix else b"") + data.replace(b" ", MARK.encode())
        return norm, np.concatenate([np.zeros(head, np.int64), place, [len(raw)]])

    def _general(self, data: bytes) -> tuple[bytes, np.ndarray]:
        units, at = [], 0
        while at < len(data):
            rule = self.rules.longest(data, at)
            if rule:
                units.append((at, rule[1]))
                at += rule[0]
            else:
                n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                units.append((at, data[at : at + n]))
                at += n
        end = len(data)
        if self.squeeze:
            while units and units[0][1] in (b" ", b""):
                units.pop(0)
        space = MARK.encode() if self.escape else b" "
        out, place, after_space = bytearray(), [], self.squeeze
        if not units:
            return b"", np.full(1, end)
        if self.prefix:
            out += space
            place += [units[0][0]] * len(space)
        for source, new in units:
            while after_space and self.squeeze and new.startswith(b" "):
                new = new[1:]
            for b in new:
                byte = space if b == 0x20 else bytes([b])
                out += byte
                place += [source] * len(byte)
            if new:
                after_space = new.endswith(b" ")
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                end = place[-len(space)]
                del place[-len(space) :]
        return bytes(out), np.array([*place, end])


class PieceCoder:
    def __init__(self, path: str, most_bytes: int = 160_000_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.normalize = Normalizer(model.normalizer_spec)
        byte, user = 6, 4
        self.bytes_of = np.array([1 if p.type == byte else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.by_word = self.normalize.prefix and not self.normalize.rules.units and not self.normalize.squeeze and model.trainer_spec.byte_fallback and not any(p.type == user or re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces)
        self.most_bytes, self.held, self.known = most_bytes, 0, {}

    def _learn(self, words: set[str]) -> dict[str, tuple[str, bytes]]:
        """The ids of words that are not known; those that are not long become known."""
        new = {}
        for w, ids in zip(words, self.library.encode(list(words), num_threads=1)):
            # one mark alone: the library returns nothing for an empty text
            ids = ids if w else [self.library.piece_to_id(MARK)]
            found = new[w] = " ".join(map(str, ids)), np.array(ids, "<u4").tobytes()
            if len(w) <= 64:
                self.known[w] = found
                self.held += len(w) + len(found[0]) + len(found[1]) + 250  # four objects and a slot
        if self.held > self.most_bytes:
            self.known, self.held = {}, 0
        return new

    def ids(self, text: str) -> tuple[np.ndarray, str]:
        """The ids, and the same as decimal numbers joined by one space."""
        if not text:
            return np.empty(0, "<u4"), ""
        if not self.by_word:
            ids = self.library.encode(text)
            return np.array(ids, "<u4"), " ".join(map(str, ids))
        # a word stands without its first mark, which the library puts before it
        words = text.split(" ")
        if "" in words or MARK in text:
            words = [w[1:] for w in WORD.findall(MARK + text.replace(" ", MARK))]
        found = list(map(self.known.get, words))
        if None in found:
            new = self._learn({w for w, f in zip(words, found) if f is None})
            found = [f or new[w] for w, f in zip(words, found)]
        return np.frombuffer(b"".join([f[1] for f in found]), "<u4"), " ".join([f[0] for f in found])

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the pieces in the UTF-8 bytes of ``text``.  Of the bytes that stand for
        one character, the last one's piece has its span and the others' are empty."""
        norm, place = self.normalize(text)
        size = self.bytes_of[ids]
        if size.sum() != len(norm):  # unknown pieces stand for what they cover
            proto = self.library.encode(text, return_type="proto")
            size = np.array([self.bytes_of[p.id] if self.library.is_byte(p.id) else len(p.piece.encode()) for p in proto.pieces], np.int64)
        ends = np.cumsum(size)
        return place[ends - size], place[ends]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@lru_cache(maxsize=2)
def piece_coder(name: str) -> PieceCoder:
    return PieceCoder(name if os.path.sep in name else vocabulary_path(name))


def encode_with_offsets(docs: DataFrame, model: str = "piece_bpe_32k.model", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, begins, ends``: the ids of every whole text with the end id, and for each id the
    span of UTF-8 bytes of the text it stands for; the end id has an empty span at the end."""

    def run(batches):
        coder = piece_coder(model)
        for batch in batches:
            for a, z in slices_of(batch.column(1)):
                rows = []
                for text in batch.column(1)[a:z].to_pylist():
                    ids, _ = coder.ids(text)
                    begins, ends = coder.spans(text, ids)
                    size = len(text.encode("utf-8", "replace"))
                    rows.append((np.append(ids, end_id).astype(np.int32), np.append(begins, size), np.append(ends, size)))
                columns = [pa.array([r[k] for r in rows], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], *columns], names=["doc_id", "ids", "begins", "ends"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, begins array<long>, ends array<long>")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"


def piece_digests(docs: DataFrame, model: str = "piece_bpe_32k.model", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text: the number of ids with the end id, the SHA-256 of the ids
    and of the decoded text, and the CRC-32 of the spans (begins, then ends, as 64-bit integers).

    No shuffle.  A null text is an empty one, which has the end id only; repeated ids have a row each;
    a null id stays null; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        coder, last = piece_coder(model), str(end_id)
        for batch in batches:
            for a, z in slices_of(batch.column(1)):
                rows = []
                for text in batch.column(1)[a:z].to_pylist():
                    ids, named = coder.ids(text)
                    begins, ends = coder.spans(text, ids)
                    every = np.append(ids, np.uint32(end_id))
                    rows.append((len(every), sha256(f"{named} {last}".strip().encode()).hexdigest(), sha256(coder.decode(every).encode()).hexdigest(), zlib.crc32(ends.tobytes(), zlib.crc32(begins.tobytes()))))
                n, ids_sha, text_sha, crc = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:z], pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(crc, pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, DIGESTS)
