"""Language identification by cross-parsing.

For each language a suffix automaton is built over a bounded sample of labelled text.  A text is
parsed greedily into the longest phrases that occur in a language's sample; the phrases it takes,
times the bits to name a place in that sample, over the text's length, estimate its entropy under
that language.  The language with the least wins.

The automata become one transition table whose failing transitions already start the next phrase,
so all texts of a slice walk through all languages together with NumPy.  The most frequent letters of
the sample have a symbol of their own; every other letter is spelled by five symbols, the digits of
its number, so large scripts stay apart while the table stays narrow.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minuteworks.llm.common import text_or_empty
from minuteworks.llm.tokens import slices_of

#: Letters, and a few numbers that ``\\w`` takes for them; :func:`has_letter` tells these apart.
LETTER_LIKE = re.compile(r"[^\W\d_]")
SPACE, BREAK, DIGIT, FIRST, SPELLED = 0, 1, 2, 18, 255
DIGITS = 5
FLAG = 1 << 30


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode category L)."""
    return any(m[0].isalpha() for m in LETTER_LIKE.finditer(text))


@lru_cache(maxsize=1)
def letter_points() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def suffix_automaton(codes: list[int], symbols: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``codes``, a row per state, -1 for none."""
    nxt, link, length, last = [[-1] * symbols], [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append([-1] * symbols)
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and nxt[p][c] < 0:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q][:])
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p][c] == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return np.array(nxt, np.int32)


class CrossParser:
    """``sample``: for each language the codes of its text."""

    def __init__(self, alphabet: str, sample: dict[str, bytes]):
        self.alphabet, self.languages = alphabet, sorted(sample)
        self.width = FIRST + len(alphabet)
        self.code = np.where(letter_points(), SPELLED, SPACE).astype(np.uint8)
        for k, c in enumerate(alphabet):
            self.code[ord(c)] = FIRST + k
        tables, self.roots, base = [], [], 0
        for name in self.languages:
            table = suffix_automaton(list(sample[name]), self.width)
            root, alone = table[0].copy(), len(table)
            # a failing transition ends the phrase; the next one begins with the same symbol, and is that
            # symbol alone (the last state) if the sample lacks it
            again = np.where(root >= 0, root, alone) + base
            table = np.where(table >= 0, table + base, again | FLAG)
            table[0] = again
            table = np.vstack([table, again | FLAG])
            tables.append(table)
            self.roots.append(base)
            base += len(table)
        self.table = np.concatenate(tables).astype(np.int32).ravel() if tables else np.empty(0, np.int32)
        self.bits = np.array([math.log2(max(2, len(sample[name]))) for name in self.languages])

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
        codes = self.code[points]
        spelled = codes == SPELLED
        if not spelled.any():
            return codes
        size = np.where(spelled, DIGITS, 1)
        out = np.repeat(codes, size)
        at, rest = (np.cumsum(size) - size)[spelled], points[spelled]
        for d in range(DIGITS):
            out[at + d] = DIGIT + (rest >> np.uint32(4 * (DIGITS - 1 - d)) & np.uint32(15))
        return out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each coded text under each language."""
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        flat = np.concatenate(texts).astype(np.int32) if len(texts) else np.empty(0, np.int32)
        start = (np.cumsum(size) - size)[order]
        still = len(texts) - np.searchsorted(np.sort(size), np.arange(1, size.max(initial=0) + 1))
        state = np.tile(np.array(self.roots, np.int32), (len(texts), 1))
        count = np.zeros_like(state)
        few = 6  # below this many texts a plain loop is quicker
        t = 0
        while t < len(still) and still[t] > few:
            k = still[t]
            found = self.table[state[:k] * self.width + flat[start[:k] + t][:, None]]
            count[:k] += found >> 30
            state[:k] = found & (FLAG - 1)
            t += 1
        if t < len(still):
            step, width = memoryview(self.table), self.width
            for row in range(int(still[t])):
                rest = flat[start[row] + t : start[row] + size[order[row]]].tolist()
                for k in range(len(self.languages)):
                    s, n = int(state[row, k]), 0
                    for c in rest:
                        s = step[s * width + c]
                        if s >= FLAG:
                            n += 1
                            s -= FLAG
                    count[row, k] += n
        out = np.empty_like(count)
        out[order] = count + 1
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        named = [k for k, t in enumerate(texts) if has_letter(t)] if self.languages else []
        out = [("und", 0.0)] * len(texts)
        if named:
            coded = [self.codes(texts[k]) for k in named]
            bits = self.phrases(coded) * self.bits[None, :] / np.array([len(c) for c in coded])[:, None]
            for k, row in zip(named, bits):
                best = int(np.argmin(row))
                rest = min((b for i, b in enumerate(row) if i != best), default=math.inf)
                out[k] = (self.languages[best], float(1 - row[best] / rest) if math.isfinite(rest) else 1.0)
        return out


@lru_cache(maxsize=1)
def parser(alphabet: str, sample: tuple[tuple[str, bytes], ...]) -> CrossParser:
    return CrossParser(alphabet, dict(sample))


def fair_shares(sizes: list[int], most: int) -> list[int]:
    """How much each may have of ``most`` together: what small ones leave goes to the others in equal parts."""
    out, left = [0] * len(sizes), most
    order = sorted(range(len(sizes)), key=lambda k: sizes[k])
    for done, k in enumerate(order):
        out[k] = min(sizes[k], left // (len(sizes) - done))
        left -= out[k]
    return out


def sample_texts(docs: DataFrame, held_out, most_docs: int = 48, most_chars: int = 40_000, passage: int = 200) -> dict[str, list[str]]:
    """For each language passages of at most ``most_docs`` labelled rows: the bounded sample that is learned
    from.

    Rows are drawn by the hash of their id and text alone: each of ``most_docs`` parts of the hashes offers
    the row with the least one.  An automaton holds about ``most_chars`` characters, which the rows share
    fairly: a short row teaches whole, a longer one by passages of about ``passage`` characters that are
    spread evenly over all of it, so rows of any length teach.
    """
    n = F.char_length(text_or_empty())
    rows = docs.where(F.col("lang").isNotNull() & ~held_out).select("lang", F.xxhash64("doc_id", "text").alias("h"), n.alias("n")).where("n > 0")
    offered = rows.groupBy("lang", F.pmod("h", F.lit(most_docs)).alias("part")).agg(F.min(F.struct("h", "n")).alias("first"))
    by_lang: dict[str, list] = {}
    for r in offered.select("lang", "first.*").collect():  # most_docs for each language
        by_lang.setdefault(r.lang, []).append(r)
    chosen = []
    for lang, mine in sorted(by_lang.items()):
        mine.sort(key=lambda r: r.h)
        for r, share in zip(mine, fair_shares([r.n for r in mine], most_chars)):
            if share:
                chosen.append((lang, r.h, 1 if share == r.n else max(1, share // passage), share))
    if not chosen:
        return {}
    wanted = F.broadcast(docs.sparkSession.createDataFrame(chosen, "_of string, _h long, pieces int, share int"))
    texts = docs.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text", n.alias("n"))
    size = (F.col("share") / F.col("pieces")).cast("int")
    step = (F.col("n") - size) / F.greatest(F.col("pieces") - 1, F.lit(1))
    cut = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda k: F.substring("text", (k * step).cast("int") + 1, size))
    found = texts.join(wanted, (F.col("h") == F.col("_h")) & (F.col("lang") == F.col("_of"))).select("lang", "h", cut.alias("parts")).distinct().collect()
    out: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r.lang, r.h)):
        out.setdefault(r.lang, []).extend(r.parts)
    return {lang: parts for lang, parts in out.items() if any(map(has_letter, parts))}


def learned(texts: dict[str, list[str]], letters: int = 61) -> tuple[str, tuple[tuple[str, bytes], ...]]:
    """The letters with a symbol of their own (the ``letters`` most frequent ones) and the coded sample of
    each language."""
    counts = Counter(c for parts in texts.values() for text in parts for c in text.lower() if c.isalpha())
    alphabet = "".join(sorted(sorted(counts, key=lambda c: (-counts[c], c))[:letters]))
    coder = CrossParser(alphabet, {})
    # passages are told apart, so that no phrase runs from one into the next
    sample = {lang: bytes([BREAK]).join(coder.codes(t).tobytes() for t in parts) for lang, parts in texts.items()}
    return alphabet, tuple(sorted(sample.items()))


RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def identify_language(docs: DataFrame, most_docs: int = 48, most_chars: int = 40_000) -> DataFrame:
    """A row per document: ``doc_id, held_out, lang_pred, score``.

    Learns from at most ``most_docs`` rows and ``most_chars`` characters for each language (see
    :func:`sample_texts`), of rows with a language whose ``crc32`` of the id modulo 4 is not 2 and predicts all
    rows from their text alone.  A text that is null or has no letter is ``und`` with score 0, as is
    every text if there is nothing to learn from.  The score is how much more the second language
    needs (0 to 1; 1 with one language).  Equal languages: the first by name.  Ids may repeat; a null
    id is not held out; other columns are ignored; an empty table gives an empty result.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(learned(sample_texts(docs, held_out, most_docs, most_chars)))

    def predict(batches):
        own = parser(*shared.value)
        for batch in batches:
            for a, z in slices_of(batch.column(2), 4_000_000):
                part = batch.slice(a, z - a)
                found = own.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(predict, RESULT)
