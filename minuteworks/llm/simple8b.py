"""Simple-8b coding of token ids, and files of it that can be read in parts.

A 64-bit word holds a selector in its low 4 bits and as many ids of equal width as fit in the other
60 bits.  Ids are coded in blocks of ``BLOCK``; every block begins a new word, so blocks are packed
and unpacked side by side with NumPy.  A value of more than 60 bits is an escape: its word has
selector 15 and an index into the escapes after the block's words.

File layout (little-endian)::

    "S8BTOK01"
    blocks: words (u64 * n_words), escapes (u64 * n_escapes)
    footer: i64 n_docs, n_ids, n_blocks
            doc ids (i64 * n_docs), null flags (u8 * n_docs), tokens per document (i64 * n_docs)
            block table (i64 * 3 * n_blocks): byte offset, words, escapes
    i64 footer length, "S8BTOK01"

Block ``k`` holds the ids ``k * BLOCK`` up to ``(k + 1) * BLOCK`` of the file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minuteworks.llm.common import scratch_path, small_batches, text_or_empty, written
from minuteworks.llm.tokens import chunk_tokenizer, slices_of

MAGIC = b"S8BTOK01"
BLOCK = 2048
#: Selector k packs COUNTS[k] ids of 60 // COUNTS[k] bits.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
ESCAPE = 15


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block of ``ids`` (any unsigned integers) its words and its escapes."""
    ids = ids.astype(np.uint64, copy=False)
    n = len(ids)
    rows = -(-n // block)
    if not rows:
        return []
    values = np.zeros(rows * block + COUNTS[0], np.uint64)
    values[:n] = ids
    # bits of each id; 64 stops a word from reaching over a block's or the input's end
    width = np.full((rows, block + COUNTS[0]), 64, np.uint8)
    flat = np.full(rows * block, 64, np.uint8)
    flat[:n] = np.maximum(bit_length(ids), 1)
    width[:, :block] = flat.reshape(rows, block)
    # the largest count that fits from each position: widths of spans by doubling
    choice = np.full((rows, block), len(COUNTS), np.uint8)  # none: an escape
    spans, low = {1: width}, int(flat.min())
    for k in range(len(COUNTS) - 1, -1, -1):
        count = COUNTS[k]
        bits = 60 // count
        if bits < low:
            break
        choice[span_max(spans, count)[:, :block] <= bits] = k
    # every block walks from word to word at the same time
    counts = np.array([*COUNTS, 1])
    ends = np.minimum(block, n - np.arange(rows) * block)
    at, alive, starts, picks = np.zeros(rows, np.int64), np.arange(rows), [], []
    while len(alive):
        pick = choice[alive, at[alive]]
        starts.append(alive * block + at[alive])
        picks.append(pick)
        at[alive] += counts[pick]
        alive = alive[at[alive] < ends[alive]]
    start, pick = np.concatenate(starts), np.concatenate(picks)
    order = np.argsort(start, kind="stable")
    start, pick = start[order], pick[order]
    words = np.empty(len(start), np.uint64)
    for k, count in enumerate(COUNTS):
        mine = np.flatnonzero(pick == k)
        if len(mine):
            word = np.full(len(mine), k, np.uint64)
            for j in range(count):
                word |= values[start[mine] + j] << np.uint64(4 + j * (60 // count))
            words[mine] = word
    escaped = np.flatnonzero(pick == len(COUNTS))
    row = start // block
    first = np.searchsorted(row, np.arange(rows + 1))
    first_escape = np.searchsorted(escaped, first)
    words[escaped] = np.uint64(ESCAPE) | ((np.arange(len(escaped)) - first_escape[row[escaped]]).astype(np.uint64) << np.uint64(4))
    escapes = values[start[escaped]]
    return [(words[first[r] : first[r + 1]], escapes[first_escape[r] : first_escape[r + 1]]) for r in range(rows)]


def bit_length(ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ids), np.uint8)
    rest = ids
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= (1 << step)
        out += (big * step).astype(np.uint8)
        rest = np.where(big, rest >> np.uint64(step), rest)
    return out + (rest > 0)


def span_max(spans: dict[int, np.ndarray], count: int) -> np.ndarray:
    """The largest width among ``count`` neighbours from each position on; past the row's end 64."""
    if count not in spans:
        half = max(c for c in spans if c < count)
        base = spans[half] if half * 2 >= count else span_max(spans, (count + 1) // 2)
        half = half if half * 2 >= count else (count + 1) // 2
        shift = count - half
        out = np.full_like(base, 64)
        out[:, :-shift] = np.maximum(base[:, :-shift], base[:, shift:])
        spans[count] = out
    return spans[count]


def decode_words(words: np.ndarray, escapes: np.ndarray, escape_base: np.ndarray | None = None) -> np.ndarray:
    """The ids of words of one block, or of several with the first escape of each word's block."""
    pick = (words & np.uint64(15)).astype(np.int64)
    counts = np.array([*COUNTS, 0, 1])[pick]
    ends = np.cumsum(counts)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint64)
    for k in np.unique(pick):
        mine = np.flatnonzero(pick == k)
        at, payload = ends[mine] - counts[mine], words[mine] >> np.uint64(4)
        if k == ESCAPE:
            out[at] = escapes[payload.astype(np.int64) + (0 if escape_base is None else escape_base[mine])]
            continue
        bits = 60 // COUNTS[k]
        mask = np.uint64((1 << bits) - 1)
        for j in range(COUNTS[k]):
            out[at + j] = (payload >> np.uint64(j * bits)) & mask
    return out


class Writer:
    """Writes one file; holds a few blocks at a time."""

    def __init__(self, stream, at_once: int = 256):
        self.stream, self.at_once = stream, at_once
        self.stream.write(MAGIC)
        self.place, self.table = len(MAGIC), []
        self.docs, self.nulls, self.tokens, self.wait, self.waiting = [], [], [], [], 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.tokens.append(len(ids))
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.at_once * BLOCK:
            self.flush(self.waiting // BLOCK * BLOCK)

    def flush(self, n: int) -> None:
        ids = np.concatenate(self.wait) if self.wait else np.empty(0, np.uint32)
        out = []
        for words, escapes in encode_blocks(ids[:n]):
            self.table.append((self.place, len(words), len(escapes)))
            out += [words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes()]
            self.place += 8 * (len(words) + len(escapes))
        self.stream.write(b"".join(out))
        self.wait, self.waiting = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self.flush(self.waiting)
        footer = struct.pack("<3q", len(self.docs), sum(self.tokens), len(self.table))
        footer += np.array(self.docs, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.tokens, "<i8").tobytes() + np.array(self.table, "<i8").tobytes()
        self.stream.write(footer + struct.pack("<q", len(footer)) + MAGIC)
        self.stream.close()


class Reader:
    """Reads any ids of one file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(16, size - 16)
        if tail[8:] != MAGIC or file.read_at(8, 0) != MAGIC:
            raise ValueError("not a token file")
        footer = file.read_at(n := struct.unpack("<q", tail[:8])[0], size - 16 - n)
        docs, self.n_ids, blocks = struct.unpack_from("<3q", footer)
        self.docs = np.frombuffer(footer, "<i8", docs, 24)
        self.nulls = np.frombuffer(footer, "u1", docs, 24 + 8 * docs)
        self.tokens = np.frombuffer(footer, "<i8", docs, 24 + 9 * docs)
        self.table = np.frombuffer(footer, "<i8", 3 * blocks, 24 + 17 * docs).reshape(blocks, 3)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` up to ``end``: only the blocks that hold them are read."""
        if start >= end:
            return np.empty(0, np.uint64)
        a, z = start // BLOCK, -(-end // BLOCK)
        part = self.table[a:z]
        first, last = part[0, 0], part[-1, 0] + 8 * (part[-1, 1] + part[-1, 2])
        data = np.frombuffer(self.file.read_at(int(last - first), int(first)), "<u8")
        at = (part[:, 0] - first) // 8
        if not part[:, 2].any():
            found = decode_words(data, np.empty(0, np.uint64))
        else:
            found = np.concatenate([decode_words(data[p : p + w], data[p + w : p + w + e]) for p, (_, w, e) in zip(at, part)])
        return found[start - a * BLOCK : end - a * BLOCK]


FILES = "file int, path string, n_docs long, n_ids long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, out_dir: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends ``end_id`` and writes the ids in ascending order of ids, a file
    for each range of them.  Returns a row for each file: ``file`` (its rank), ``path``, ``n_docs``,
    ``n_ids``; files of failed or repeated attempts are in no row.

    The text is shuffled once, by ranges of the id; an id that is null comes first.
    """
    import pyarrow.fs as pafs

    ranged = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    pafs.FileSystem.from_uri(out_dir)[0].create_dir(pafs.FileSystem.from_uri(out_dir)[1])

    def write(batches):
        import uuid

        fs, folder = pafs.FileSystem.from_uri(out_dir)
        encode, end, writer, rank = chunk_tokenizer(vocabulary).encode_array, np.array([end_id], "<u4"), None, TaskContext.get().partitionId()
        path = f"{folder}/part-{rank:06d}-{uuid.uuid4().hex}.s8b"
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, z in slices_of(texts, 2_000_000):
                found, ends = encode(texts[a:z])
                for doc_id, own in zip(ids[a:z], np.split(found, ends[:-1])):
                    if writer is None:
                        writer = Writer(fs.open_output_stream(path))
                    writer.add(doc_id, np.concatenate([own, end]))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([rank], pa.int32()), "path": [path], "n_docs": [len(writer.docs)], "n_ids": [int(sum(writer.tokens))]})

    with small_batches(docs.sparkSession):
        return written(ranged.mapInArrow(write, FILES), "token-files")


def read_token_files(files: DataFrame, out_dir: str, ids_at_once: int = 4_000_000) -> DataFrame:
    """Reads the files back, in parts of about ``ids_at_once`` ids that end at documents' ends.
    A row per document: ``doc_id, start`` (ids of all before it), ``n_tokens, ids_crc32``."""
    import pyarrow.fs as pafs

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs = pafs.FileSystem.from_uri(out_dir)[0]
                with fs.open_input_file(row["path"]) as file:
                    reader = Reader(file)
                    ends = np.cumsum(reader.tokens)
                    lo, hi = row["part"] * ids_at_once, (row["part"] + 1) * ids_at_once
                    starts = ends - reader.tokens
                    a, z = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
                    while a < z:  # some blocks at a time
                        b = max(a + 1, int(np.searchsorted(starts, starts[a] + 500_000)))
                        b = min(b, z)
                        ids, base = reader.ids(int(starts[a]), int(ends[b - 1])).astype("<u4"), starts[a]
                        crc = [zlib.crc32(ids[starts[k] - base : ends[k] - base].tobytes()) for k in range(a, b)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reader.docs[a:b], mask=reader.nulls[a:b].astype(bool)), pa.array(starts[a:b] + row["before"]), pa.array(reader.tokens[a:b]), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        a = b

    # one row per file: few, whatever the number of documents
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n_ids") / ids_at_once) - 1).cast("int"))
    parts = files.withColumn("before", before).select("file", "path", "before", F.explode(numbers).alias("part"))
    # a fixed number: the rows are few and small, and adaptive execution would join them in one task
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(tasks, "file", "part").mapInArrow(read, DOCS)


def token_files(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """Writes the ids of all ``docs`` to the shared folder and reads them back, one row per document.

    A null text is an empty one and has the end id only; repeated ids have a row each; other columns
    are ignored; an empty table writes no file.
    """
    out_dir = scratch_path(docs.sparkSession, "token-ids")
    return read_token_files(write_token_files(docs, out_dir, vocabulary, end_id), out_dir)
