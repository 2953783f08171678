"""Secrets in whole texts: fixed patterns, and a token-efficiency test for random strings.

A vocabulary learned from ordinary text needs few tokens for words and many for random strings.  A
run of 20 or more characters of the base64 alphabets whose characters per token fall under
``max_ratio`` is reported as ``random``, unless it is a known digest (hex of a usual length), an
identifier (UUID, plain numbers) or inside a span found by a pattern.  Of a run that as a whole is not
under the ratio, the stretches that are under it are reported.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteworks.llm.common import text_or_empty
from minuteworks.llm.tokens import slices_of, vocabulary_path

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Runs that may hold an access key, a hex string or a random string; each of these lies in one run.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
INNER_UUID = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])")
PART = re.compile(r"[^/=_-]+")


@lru_cache(maxsize=2)
def token_counter(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(vocabulary), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return TokenSizes(encoding)


class TokenSizes:
    """How many tokens a text has; ``of`` gives the bytes of each."""

    def __init__(self, encoding):
        self.encoding = encoding

    def of(self, text: str) -> list[int]:
        return list(map(len, self.encoding.decode_tokens_bytes(self.encoding.encode_ordinary(text))))

    def __call__(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


def is_identifier(run: str) -> bool:
    """Known digests, UUIDs, and numbers, also several with signs between them."""
    return bool(DIGEST.match(run) and len(run) in DIGEST_LENGTHS or UUID.match(run) or not any(c.isalpha() for c in run))


def without_readable_ends(run: str, start: int, end: int, count_tokens, max_ratio: float, min_length: int) -> tuple[int, int]:
    """The stretch without the words up to its first and from its last ``/ = - _`` that are over the ratio."""
    over = lambda piece: len(piece) > 3 and len(piece) / count_tokens(piece) >= max_ratio
    while (m := PART.search(run, start, end)) and m.end() < end and end - m.end() >= min_length and (m.end() - m.start() <= 3 and m.start() > start or over(m[0])):
        start = m.end() + 1
    while (at := max(run.rfind(c, start, end) for c in "/=-_")) >= 0 and at - start >= min_length and (at + 1 == end or over(run[at + 1 : end])):
        end = at
    return start, end


def random_stretches(run: str, count_tokens, max_ratio: float, min_length: int) -> list[tuple[int, int]]:
    """Stretches of an ASCII run under the ratio: its parts between ``/ = - _``, and windows of whole
    tokens, at least ``min_length`` characters long, anywhere in it; those that overlap are one.
    Identifiers are left out.  The signs, and numbers between them, do not count for the ratio of a
    window, which is not reported if they are more than a quarter of ``min_length``."""
    known = [m.span() for m in INNER_UUID.finditer(run)]
    parts = [m.span() for m in PART.finditer(run)]
    known += [(a, z) for a, z in parts if z - a >= min_length and is_identifier(run[a:z]) and not run[a:z].isdigit()]
    held = np.zeros(len(run) + 1, np.int64)
    for a, z in known:
        held[a + 1 : z + 1] = 1
    held = held.cumsum().tolist()
    inside = lambda a, z: held[z] > held[a]
    counted = np.zeros(len(run) + 1, np.int64)
    for a, z in parts:
        if not run[a:z].isdigit():
            counted[a + 1 : z + 1] = 1
    counted = counted.cumsum().tolist()
    found = [(a, z) for a, z in parts if z - a >= min_length and not is_identifier(run[a:z]) and not inside(a, z) and (z - a) / count_tokens(run[a:z]) < max_ratio]
    ends = list(accumulate(count_tokens.of(run), initial=0))
    wordy = list(accumulate((counted[z] > counted[a] for a, z in zip(ends, ends[1:])), initial=0))
    lo = 0
    for hi in range(1, len(ends)):
        while ends[hi] - ends[lo + 1] >= min_length:
            lo += 1
        a, z = ends[lo], ends[hi]
        chars = counted[z] - counted[a]
        if z - a >= min_length and 4 * chars >= 3 * min_length and chars < max_ratio * (wordy[hi] - wordy[lo]) and not inside(a, z):
            found.append((a, z))
    joined_up: list[tuple[int, int]] = []
    for a, z in sorted(found):
        if joined_up and a < joined_up[-1][1]:
            joined_up[-1] = (joined_up[-1][0], max(z, joined_up[-1][1]))
        else:
            joined_up.append((a, z))
    return [without_readable_ends(run, a, z, count_tokens, max_ratio, min_length) for a, z in joined_up]


class Cover:
    """Whether a span lies inside one of some spans: sorted by start, with the furthest end so far."""

    def __init__(self, spans):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((z for _, z in spans), max))

    def __call__(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        return k > 0 and end <= self.ends[k - 1]


def find_secrets(text: str, count_tokens, max_ratio: float = 2.0, min_length: int = 20) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` in code points, end exclusive, by start and then kind."""
    low = text.lower()
    found = []
    if any(w in low for w in WORDS):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    runs = [(m.start(), m[0]) for m in RUN.finditer(text)]
    for at, run in runs:
        if "AKIA" in run:
            found += [(at + m.start(), "access", at + m.end()) for m in ACCESS.finditer(run) if len(m[0]) >= 18]
        found += [(at + m.start(), "hex", at + m.end()) for m in HEX.finditer(run) if len(m[0]) >= 16]
    within = Cover((a, z) for a, _, z in found)
    for at, run in runs:
        run = run.rstrip("=")
        if len(run) >= min_length and not is_identifier(run) and not within(at, at + len(run)):
            whole = len(run) / count_tokens(run) < max_ratio
            parts = [(0, len(run))] if whole else random_stretches(run, count_tokens, max_ratio, min_length)
            found += [(at + a, "random", at + z) for a, z in parts if not within(at + a, at + z)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", max_ratio: float = 2.0) -> DataFrame:
    """A row per document: its spans, how many of each kind, and the SHA-256 of the pattern spans.

    No shuffle.  A null or empty text has no spans; repeated ids have a row each; a null id stays
    null; other columns are ignored; an empty table gives an empty result.
    """

    def scan(batches):
        count = token_counter(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, z in slices_of(texts):
                each = [find_secrets(t, count, max_ratio) for t in texts[a:z].to_pylist()]
                counts = [pa.array([sum(s[1] == kind for s in spans) for spans in each], pa.int64()) for kind in KINDS]
                base = [sha256(joined(s for s in spans if s[1] != "random").encode()).hexdigest() for spans in each]
                yield pa.RecordBatch.from_arrays([ids[a:z], *counts, pa.array(base), pa.array([joined(s) for s in each])], names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(scan, RESULT)


def redact_secrets(docs: DataFrame, mask: str = "[secret]", vocabulary: str = "byte_bpe_50k.tiktoken", max_ratio: float = 2.0) -> DataFrame:
    """All rows and columns of ``docs``, with every span of ``text`` replaced by ``mask`` (spans that
    overlap by one mask) and ``n_chars``, if there is one, counted anew.  Texts without secrets, null
    ones too, stay as they are.  Each row stands for itself, so rows that repeat an id or have none are
    masked like all others; a text has to fit a worker as one string; an empty table stays empty."""
    schema, names = docs.schema, docs.columns
    text_at = names.index("text")

    def run(batches):
        count = token_counter(vocabulary)
        for batch in batches:
            for a, z in slices_of(batch.column(text_at)):
                part = batch.slice(a, z - a)
                texts = [t and masked(t, find_secrets(t, count, max_ratio), mask) for t in part.column(text_at).to_pylist()]
                columns = part.columns
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if "n_chars" in names:
                    at = names.index("n_chars")
                    changed = [len(t) if t is not None and t != old else n for t, old, n in zip(texts, part.column(text_at).to_pylist(), columns[at].to_pylist())]
                    columns[at] = pa.array(changed, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def masked(text: str, spans, mask: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])
