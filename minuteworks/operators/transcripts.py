"""Transcripts: cleaning, runs, stitching, arbitration, glossaries, evidence, integrity."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from minuteworks.functions import lexicon as L
from minuteworks.functions.text import contains_any, let, normalized_words, occurrences, starts_with_any, strip, words
from minuteworks.sources.scratch import written

# ---- cleaning -----------------------------------------------------------------------------


def without_ends(segment: Column, kind: str) -> Column:
    """Without characters of the class ``kind`` at both ends; a look at the first and the last one spares the
    search of a segment that has none there."""
    ends = F.concat(F.substring(segment, 1, 1), F.substring(segment, -1, 1)).rlike(f"(?U){kind}")
    return F.when(ends, F.regexp_replace(segment, f"(?U)^{kind}+|{kind}+$", "")).otherwise(segment)


def bare(segment: Column) -> Column:
    return F.lower(without_ends(segment, r"[.!?,\-\s]"))


def clean_transcript(text: Column) -> Column:
    """Drops noise segments and repeated neighbours; segments are joined by two spaces.

    Segments end after a line feed, after ``.!?`` before white space or the end, and at two spaces.
    Thanks that stand alone once stay, unless an outro occurs anywhere.
    """
    # looking behind at every character costs the most, so only texts that have such a place are split
    parts = F.when(text.rlike(r"(?U)\n|[.!?]\s|  "), F.split(text, r"(?U)(?<=\n)|(?<=[.!?])(?=\s)|  ")).otherwise(F.array(text))
    trimmed = F.filter(F.transform(parts, lambda s: without_ends(s, r"\s")), lambda s: s != "")
    pairs = F.transform(trimmed, lambda s: F.struct(s.alias("s"), bare(s).alias("n")))
    outro = let(F.lower(text), lambda t: contains_any(t, L.NOISE_PREFIXES))

    def facts(pairs: Column) -> Column:
        thanks = F.size(F.filter(pairs, lambda p: p["n"].isin(*L.SPOKEN_THANKS)))
        return F.struct(pairs.alias("pairs"), ((thanks <= 1) & ~outro).alias("spoken_only"))

    def kept(f: Column, p: Column) -> Column:
        noise = p["n"].isin(*L.NOISE_EXACT) & ~(p["n"].isin(*L.SPOKEN_THANKS) & f["spoken_only"])
        return (p["n"] != "") & ~noise & ~starts_with_any(p["n"], L.NOISE_PREFIXES)

    def joined(good: Column) -> Column:
        # neighbours are compared once: each kept segment and the one before it
        first = F.filter(good, lambda p, i: (i == 0) | (p["n"] != F.get(good, i - 1)["n"]))
        return F.array_join(F.transform(first, lambda p: p["s"]), "  ")

    return let(let(pairs, facts), lambda f: let(F.filter(f["pairs"], lambda p: kept(f, p)), joined))


def hallucination_penalty(text: Column, phrases=L.INVENTED) -> Column:
    return occurrences(text, phrases)


# ---- parts and runs -----------------------------------------------------------------------


def latest_run(attempts: DataFrame) -> DataFrame:
    """Rows of each recording's newest run; all of them where no row has a run.  Ties: larger id."""
    newest = attempts.where("run_id IS NOT NULL").groupBy("recording_id").agg(F.max(F.struct("created_at", "run_id")).alias("newest"))
    rows = attempts.join(newest, "recording_id", "left")
    return rows.where(F.col("newest").isNull() | (F.col("run_id") == F.col("newest.run_id"))).drop("newest")


def concat_parts(parts: DataFrame) -> DataFrame:
    """Cleaned parts that are not empty, in the order of chunks, joined by a blank line."""
    rows = parts.select("recording_id", "chunk_index", clean_transcript(F.col("text")).alias("text")).where("text <> ''")
    ordered = F.sort_array(F.collect_list(F.struct("chunk_index", "text")))
    return rows.groupBy("recording_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("transcript"), F.count(F.lit(1)).alias("n_parts"))


def complete_recordings(parts: DataFrame, expected: DataFrame) -> DataFrame:
    """``recording_id, n_expected, n_ok, n_failed, missing, complete`` of every expected recording."""
    seen = parts.groupBy("recording_id").agg(F.count_if(~F.col("failed")).alias("n_ok"), F.count_if("failed").alias("n_failed"), F.collect_set(F.when(~F.col("failed"), F.col("chunk_index").cast("int"))).alias("ok"))
    rows = expected.join(seen, "recording_id", "left").fillna(0, ["n_ok", "n_failed"])
    every = F.when(F.col("n_expected") > 0, F.sequence(F.lit(0), F.col("n_expected").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    missing = F.array_except(every, F.coalesce("ok", F.array().cast("array<int>")))
    return rows.select("recording_id", "n_expected", "n_ok", "n_failed", F.size(missing).alias("n_missing"), ((F.col("n_failed") == 0) & (F.size(missing) == 0) & (F.col("n_ok") == F.col("n_expected"))).alias("complete"))


LONGEST_SEAM, SHORTEST_SEAM = 40, 4


def plain(word: str) -> str:
    return "".join(c for c in word if c.isalnum()).lower()


#: What ``plain`` deletes from words with blanks between them: of any text, and of bytes of ASCII.
NOT_PLAIN = re.compile(r"[^\w ]|_")
NOT_PLAIN_BYTES = bytes(b for b in range(128) if b != 32 and not chr(b).isalnum())
LOWER_BYTES = bytes(range(256)).lower()


def plain_words(new: list[str]) -> list[str]:
    """``plain`` of each word, none of which holds white space, in one pass."""
    text = " ".join(new)
    flat = text.encode().translate(LOWER_BYTES, NOT_PLAIN_BYTES).decode() if text.isascii() else NOT_PLAIN.sub("", text).lower()
    return flat.split(" ") if new else []


def seam(tail: list[str], head: list[str]) -> int:
    """Words of ``head`` that repeat the end of ``tail``: the longest stretch of 4 to 40 words of which
    four in five agree; both are normalised, and empty words agree with nothing."""
    most = min(len(tail), len(head), LONGEST_SEAM)
    common = {*tail[len(tail) - most :]}.intersection(head[:most]) - {""}
    if not common:
        return 0
    places: dict[str, list[int]] = {w: [] for w in common}
    for back in range(1, most + 1):
        if tail[-back] in common:
            places[tail[-back]].append(back)
    # a word ``back`` from the end of one and at ``i`` in the other agree in the stretch of back + i words
    agree = [0] * (2 * most)
    for i, word in enumerate(head[:most]):
        for back in places.get(word, ()):
            agree[back + i] += 1
    return next((k for k in range(most, SHORTEST_SEAM - 1, -1) if 5 * agree[k] >= 4 * k), 0)


#: Chunks of a recording that one stretch of rows holds, and words of a part that leave 40 whatever is cut.
BLOCK, LONG_PART = 64, 2 * LONGEST_SEAM


def joined(tail: list[str], new: list[str]) -> tuple[int, list[str]]:
    """Words of a part that repeat what stands before it, and the normalised end of both together."""
    k = seam(tail, plain_words(new[:LONGEST_SEAM]))
    rest = plain_words(new[max(k, len(new) - LONGEST_SEAM) :])
    return k, (tail + rest)[-LONGEST_SEAM:]


def fold_blocks(batches, kind: pa.DataType, most: int = 1_000_000):
    """Sorted rows of ``recording_id, block, chunk_index, text``: the text of each block without repeated
    words.  What comes before a later block is not known here, so its parts are ``open`` until one of 80
    words, after which 40 words stand whatever was cut; the end of a block with known words is its ``tail``."""
    now, tail, seq, held, size, out = None, None, 0, [], 0, []

    def flush():
        nonlocal held, size, seq
        if held:
            out.append((*now, seq, "kept", " ".join(held), None))
            held, size, seq = [], 0, seq + 1

    def end():
        flush()
        if now is not None and tail is not None:
            out.append((*now, seq, "tail", None, tail))

    def batch():
        types = [kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
        columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(types)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["recording_id", "block", "seq", "kind", "text", "tail"])

    for rows in batches:
        for recording, block, text in zip(*(rows.column(k).to_pylist() for k in (0, 1, 3))):
            if (recording, block) != now:
                end()
                now, tail, seq = (recording, block), [] if block == 0 else None, 0
                out.append((*now, -1, "kept", "", None))  # a recording of blank parts has a row too
            new = (text or "").split()
            if not new:
                continue
            if tail is None:
                out.append((*now, seq, "open", " ".join(new), None))
                seq += 1
                tail = plain_words(new[-LONGEST_SEAM:]) if len(new) >= LONG_PART else None
                continue
            k, tail = joined(tail, new)
            held += new[k:]
            size += sum(map(len, new[k:]))
            if size > most:
                flush()
        if out:
            yield batch()
    end()
    if out:
        yield batch()


def stitch(parts: DataFrame, prepare=None) -> DataFrame:
    """``recording_id, transcript``: parts in the order of chunks, without the words that a part
    repeats from the end of what stands before it.  Recordings of blank parts only give ``''``.

    Blocks of 64 chunks are folded in parallel, whatever recording they belong to.  The first parts of a
    block, up to one of 80 words, wait for the end of the block before: these few and the ends are folded
    for each recording, and one ordered concatenation follows.  Where all parts of a long recording are
    shorter than 80 words, all of them wait.  ``prepare`` is applied to each text after the shuffle.
    """
    kind = dict(parts.dtypes)["recording_id"]
    block = F.greatest(F.coalesce(F.floor(F.col("chunk_index") / BLOCK), F.lit(0)), F.lit(0)).cast("long")
    rows = parts.select("recording_id", block.alias("block"), "chunk_index", "text").repartition("recording_id", "block").sortWithinPartitions("recording_id", "block", "chunk_index", "text")
    if prepare is not None:
        rows = rows.withColumn("text", prepare(F.col("text")))
    arrow = to_arrow_type(parts.schema["recording_id"].dataType)
    schema = f"recording_id {kind}, block long, seq long, kind string, text string, tail array<string>"
    folded = written(rows.mapInArrow(lambda batches: fold_blocks(batches, arrow), schema), "stitched")

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        tail, texts = [], []
        group = group.sort_values(["block", "seq"], kind="stable")
        for kind, text, after in zip(group["kind"], group["text"], group["tail"]):
            if kind == "tail":
                tail = list(after)
                texts.append(None)
            else:
                new = text.split()
                k, tail = joined(tail, new)
                texts.append(" ".join(new[k:]))
        return group.assign(text=texts)[group["kind"] == "open"][["recording_id", "block", "seq", "text"]]

    waiting = folded.where("kind IN ('open', 'tail')")
    later = waiting.where("kind = 'open'").select("recording_id").distinct()
    resolved = waiting.join(later, "recording_id", "left_semi").groupBy("recording_id").applyInPandas(resolve, f"recording_id {kind}, block long, seq long, text string")
    every = folded.where("kind = 'kept'").select("recording_id", "block", "seq", "text").unionByName(resolved)
    ordered = F.sort_array(F.collect_list(F.struct("block", "seq", "text")))
    texts = F.filter(F.transform(ordered, lambda p: p["text"]), lambda t: t != "")
    return every.groupBy("recording_id").agg(F.array_join(texts, " ").alias("transcript"))


def near_windows(windows: list[str], target: str, most: int) -> np.ndarray:
    """Whether each window is within ``most`` edits of ``target``: bit-parallel rows of the distance table,
    a bit for each character of the target, for all windows at once.

    Targets of more than 64 characters use Python's long integers, window by window."""
    m = len(target)
    near = np.zeros(len(windows), bool)
    fit = [k for k, w in enumerate(windows) if abs(len(w) - m) <= most]
    if m == 0:
        near[fit] = True
        return near
    if m > 64:
        for k in fit:
            near[k] = long_distance(windows[k], target) <= most
        return near
    fit.sort(key=lambda k: -len(windows[k]))
    size = np.array([len(windows[k]) for k in fit])
    if not len(size):
        return near
    letters = {c: i + 1 for i, c in enumerate(dict.fromkeys(target))}
    places = np.zeros(len(letters) + 1, np.uint64)
    for at, c in enumerate(target):
        places[letters[c]] |= np.uint64(1 << at)
    codes = np.zeros((size[0] if len(size) else 0, len(fit)), np.intp)
    for column, k in enumerate(fit):
        codes[: len(windows[k]), column] = [letters.get(c, 0) for c in windows[k]]
    one, top = np.uint64(1), np.uint64(m - 1)
    up = np.full(len(fit), np.iinfo(np.uint64).max)
    down = np.zeros(len(fit), np.uint64)
    score = np.full(len(fit), m)
    for step, row in enumerate(codes):
        n = int(np.count_nonzero(size > step))  # windows are longest first
        p, q, eq = up[:n], down[:n], places[row[:n]]
        x = eq | q
        h = (((eq & p) + p) ^ p) | eq
        more, less = q | ~(h | p), p & h
        score[:n] += (more >> top & one).astype(np.int64) - (less >> top & one).astype(np.int64)
        more, less = more << one | one, less << one
        up[:n], down[:n] = less | ~(x | more), more & x
    near[fit] = score <= most
    return near


def long_distance(text: str, target: str) -> int:
    """The edit distance, by the same rows as integers of any length."""
    m = len(target)
    every, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for at, c in enumerate(target):
        places[c] = places.get(c, 0) | 1 << at
    up, down, score = every, 0, m
    for c in text:
        eq = places.get(c, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(h | up) & every, up & h
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | ~(x | more) & every, more & x
    return score


def restore_terms(mixed: str, microphone: str, terms) -> str:
    """Glossary terms of several words that the microphone text has and the mixed one nearly has,
    longest first, put in place of the first near window, its closing punctuation kept."""
    heard = " ".join(map(plain, microphone.split()))
    tokens = mixed.split()
    flat = [plain(t) for t in tokens]
    for term in sorted((t.strip() for t in terms if len(t.split()) >= 2), key=lambda t: -len(t.encode())):
        wanted = [plain(w) for w in term.split()]
        target, n = " ".join(wanted), len(wanted)
        if target not in heard or target in " ".join(flat):
            continue
        most = min(3, max(1, len(target) // 10))
        near = near_windows([" ".join(flat[at : at + n]) for at in range(len(flat) - n + 1)], target, most)
        if near.any():
            at = int(near.argmax())
            closing = re.search(r"[\W_]*\Z", tokens[at + n - 1])[0]
            tokens[at : at + n] = [term + closing]
            flat[at : at + n] = [plain(term + closing)]
    return " ".join(tokens)


def arbitrate_tracks(tracks: DataFrame, glossary: DataFrame) -> DataFrame:
    """``recording_id, chunk_index, text`` from ``mixed`` and ``microphone`` texts of each chunk; the
    glossary has ``recording_id, term``.  The helper sees only chunks that both tracks and a term have."""
    terms = glossary.groupBy("recording_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    rows = tracks.select("recording_id", "chunk_index", "mixed", "microphone", clean_transcript(F.col("mixed")).alias("m"), clean_transcript(F.col("microphone")).alias("c")).join(terms, "recording_id", "left")
    count = lambda c: F.size(F.filter(normalized_words(c), lambda w: F.length(w) >= 2))
    noisier = (hallucination_penalty(F.col("mixed")) > hallucination_penalty(F.col("microphone"))) & (count(F.col("m")) < 4) & (count(F.col("c")) >= 4)
    use_mic = F.coalesce((F.col("m") == "") | noisier, F.lit(False)) & F.col("microphone").isNotNull()
    plain_mixed = F.col("microphone").isNull() | (F.col("c") == "") | F.col("terms").isNull()

    @F.pandas_udf("string")
    def restored(m: pd.Series, c: pd.Series, t: pd.Series, skip: pd.Series) -> pd.Series:
        return pd.Series([a if s else restore_terms(a, b, list(x)) for a, b, x, s in zip(m, c, t, skip)], dtype=object)

    text = restored("m", "c", "terms", plain_mixed | use_mic)
    # tokens are joined by one space wherever both tracks have words, with or without a term
    spaced = F.array_join(words(F.col("m")), " ")
    return rows.select("recording_id", "chunk_index", F.when(use_mic, F.col("c")).when(F.col("microphone").isNull() | (F.col("c") == ""), F.col("m")).when(F.col("terms").isNull(), spaced).otherwise(text).alias("text"))


# ---- glossary -----------------------------------------------------------------------------


def build_glossary(rows: DataFrame, max_terms: int = 1000, max_chars: int = 64_000, max_term: int = 100) -> DataFrame:
    """``recording_id, term, rank, error``: terms of ``source`` (recording before default), ``ord`` and
    ``raw``; split at commas, semicolons and line feeds; the first spelling of a term stays; ``error``
    names what makes the glossary invalid."""
    split = rows.select("recording_id", (F.col("source") != "recording").cast("int").alias("later"), "ord", F.posexplode(F.split("raw", r"[,;\n]")).alias("pos", "term"))
    terms = split.withColumn("term", strip("term")).where("term <> ''")
    first = terms.groupBy("recording_id", F.lower("term").alias("folded")).agg(F.min(F.struct("later", "ord", "pos", "term")).alias("f"))
    order = Window.partitionBy("recording_id").orderBy("f.later", "f.ord", "f.pos")
    ranked = first.select("recording_id", "f.term", F.row_number().over(order).alias("rank"), F.sum(F.length("f.term")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("chars"))
    bad = F.when(F.col("term").rlike(r"\p{Cntrl}"), "control").when(F.length("term") > max_term, "too_long").when(F.col("rank") > max_terms, "too_many").when(F.col("chars") > max_chars, "too_large")
    return ranked.select("recording_id", "term", "rank", bad.alias("error"))


def prompt_terms(glossary: DataFrame, max_terms: int = 64, max_chars: int = 2000) -> DataFrame:
    """``recording_id, n_terms, prompt``: the longest prefix that fits; it ends at the first term that
    does not, even if later ones would."""
    order = Window.partitionBy("recording_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    size = F.sum(F.length("term") + 2).over(order) - 2
    # sizes only grow, so nothing after the first term that does not fit can fit
    fits = glossary.withColumn("size", size).withColumn("over", (F.col("size") > max_chars) | (F.col("rank") > max_terms))
    kept = fits.where(~F.col("over"))
    ordered = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return kept.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_terms"), F.array_join(F.transform(ordered, lambda t: t["term"]), ", ").alias("prompt"))


#: The pieces of a target of ``size`` characters: one more than the edits it allows, so one is untouched.
PIECES = "transform(sequence(0, most), i -> struct(i AS i, CAST(floor(i * size / (most + 1)) AS INT) AS begin, CAST(floor((i + 1) * size / (most + 1)) AS INT) AS end))"
#: Where the untouched piece ``i`` can stand in a candidate that is ``longer`` by so much: at most ``i`` edits
#: are before it, and at most ``most - i`` after it.
SHIFTS = "filter(sequence(-3, 3), d -> abs(d) <= p.i AND abs(d - longer) <= most - p.i AND p.begin + d >= 0 AND p.end + d <= length(candidate))"


def glossary_near_matches(transcripts: DataFrame, glossary: DataFrame) -> DataFrame:
    """``recording_id, term, candidate, pos``: for each term that does not occur, the first window of
    as many words within its edit distance (a tenth of its length, 1 to 3).

    Distinct windows meet terms by an index: a term is cut into one more piece than the edits it allows,
    one of which has to stand in a near window unchanged, shifted by no more than the edits around it.
    Windows and terms join by recording, size and piece, so only windows that share a piece are compared,
    and those of one recording are spread over all tasks.
    """
    texts = transcripts.select("recording_id", normalized_words(F.col("text")).alias("w"))
    terms = glossary.select("recording_id", "term", normalized_words(F.col("term")).alias("t")).where(F.size("t") > 0)
    terms = terms.withColumns({"target": F.array_join("t", " "), "n": F.size("t")})
    allowed = lambda size: F.least(F.lit(3), F.greatest(F.lit(1), F.floor(size / 10))).cast("int")
    terms = terms.withColumn("size", F.length("target")).withColumn("most", allowed(F.col("size")))
    absent = terms.join(texts.select("recording_id", F.array_join("w", " ").alias("flat")), "recording_id").where(~F.col("flat").contains(F.col("target"))).drop("flat", "t")
    keyed = absent.withColumn("p", F.explode(F.expr(PIECES))).select("recording_id", "term", "target", "n", "size", "most", F.col("p.i").alias("i"), F.expr("substring(target, p.begin + 1, p.end - p.begin)").alias("piece"))
    lengths = absent.select("recording_id", "n").distinct()
    starts = F.when(F.size("w") >= F.col("n"), F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).otherwise(F.array().cast("array<int>"))
    windows = texts.join(lengths, "recording_id").select("recording_id", "n", F.explode(F.transform(starts, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("w", i, F.col("n")), " ").alias("candidate")))).alias("x"))
    windows = windows.groupBy("recording_id", "n", F.col("x.candidate").alias("candidate")).agg(F.min("x.pos").alias("pos"))
    sizes = F.sequence(F.greatest(F.lit(1), F.length("candidate") - 3), F.length("candidate") + 3)
    windows = windows.withColumn("size", F.explode(sizes)).withColumn("most", allowed(F.col("size"))).withColumn("longer", F.length("candidate") - F.col("size")).where("abs(longer) <= most")
    # only sizes that a term of the recording has
    shapes = absent.select(F.col("recording_id").alias("r"), F.col("n").alias("m"), F.col("size").alias("s")).distinct()
    windows = windows.join(shapes, (F.col("recording_id") == F.col("r")) & (F.col("n") == F.col("m")) & (F.col("size") == F.col("s")), "left_semi")
    windows = windows.withColumn("k", F.explode(F.expr(f"flatten(transform({PIECES}, p -> transform({SHIFTS}, d -> struct(p.i AS i, substring(candidate, p.begin + d + 1, p.end - p.begin) AS piece))))")))
    windows = windows.select("recording_id", "n", "size", F.col("k.i").alias("i"), F.col("k.piece").alias("piece"), "candidate", "pos")
    # beyond 3, the most that any term allows, the distance is -1
    close = keyed.join(windows, ["recording_id", "n", "size", "i", "piece"]).where(F.expr("levenshtein(candidate, target, 3) BETWEEN 0 AND most"))
    found = close.groupBy("recording_id", "term").agg(F.min(F.struct("pos", "candidate")).alias("f"))
    return found.select("recording_id", "term", "f.candidate", (F.col("f.pos") - 1).alias("pos"))


def glossary_conflicts(transcripts: DataFrame, attempts: DataFrame, glossary: DataFrame) -> DataFrame:
    """``recording_id, term``: heard in some attempt, absent from the transcript."""
    flat = lambda c: F.array_join(normalized_words(F.col(c)), " ")
    terms = glossary.select("recording_id", "term", flat("term").alias("target")).where("target <> ''")
    absent = terms.join(transcripts.select("recording_id", flat("text").alias("flat")), "recording_id").where(~F.col("flat").contains(F.col("target")))
    heard = attempts.select("recording_id", flat("text").alias("said"))
    return absent.join(heard, "recording_id").where(F.col("said").contains(F.col("target"))).select("recording_id", "term").distinct()


# ---- evidence and integrity ---------------------------------------------------------------


def revisions(transcripts: DataFrame, attempts: DataFrame) -> DataFrame:
    """``recording_id, transcript_sha256, revision_id``: the hash of the text, and of it with the
    attempts' audio hashes in the order of (chunk, creation, name)."""
    hashes = attempts.groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "created_at", "attempt_name", "audio_sha256"))).alias("a"))
    audio = F.array_join(F.transform(F.filter("a", lambda x: x["audio_sha256"].isNotNull()), lambda x: x["audio_sha256"]), ":")
    rows = transcripts.select("recording_id", F.sha2("text", 256).alias("transcript_sha256")).join(hashes, "recording_id", "left")
    return rows.select("recording_id", "transcript_sha256", F.sha2(F.concat("transcript_sha256", F.lit(":"), F.coalesce(audio, F.lit(""))), 256).alias("revision_id"))


ANCHORS = "evidence_id string, chunk_index int, i int, start_s double, end_s double, text string, char_start int, char_end int"


def evidence_anchors(transcripts: DataFrame, attempts: DataFrame, revision: DataFrame) -> DataFrame:
    """A row per time range of each attempt (its segments, or words if it has none) with the code
    points where its text stands in the transcript at or after the last hit; null where it does not.

    The cursor runs through a recording in the order of (chunk, creation, name): one group, one task.
    """
    ranges = F.when(F.size(F.coalesce("segments", F.array())) > 0, F.col("segments")).otherwise(F.col("words"))
    rows = attempts.select("recording_id", "chunk_index", "created_at", "attempt_name", F.posexplode(ranges).alias("i", "r"))
    rows = rows.select("recording_id", "chunk_index", "created_at", "attempt_name", "i", F.col("r.start").alias("start_s"), F.col("r.end").alias("end_s"), strip("r.text").alias("text"))
    texts = transcripts.select("recording_id", F.col("text").alias("transcript"))

    def locate(ranges: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        ranges = ranges.sort_values(["chunk_index", "created_at", "attempt_name", "i"], kind="stable")
        transcript = texts["transcript"].iloc[0] if len(texts) else ""
        cursor, spans = 0, []
        for text in ranges["text"]:
            at = transcript.find(text, cursor) if text else -1
            if at >= 0:
                cursor = at + len(text)
            spans.append((at, cursor) if at >= 0 else (None, None))
        out = ranges[["recording_id", "chunk_index", "i", "start_s", "end_s", "text"]].copy()
        out["char_start"] = pd.array([s[0] for s in spans], dtype="Int32")
        out["char_end"] = pd.array([s[1] for s in spans], dtype="Int32")
        return out

    kind = dict(attempts.dtypes)["recording_id"]
    found = rows.groupBy("recording_id").cogroup(texts.groupBy("recording_id")).applyInPandas(locate, f"recording_id {kind}, chunk_index int, i int, start_s double, end_s double, text string, char_start int, char_end int")
    named = F.sha2(F.concat_ws(":", "revision_id", F.col("chunk_index").cast("string"), F.col("i").cast("string"), F.format_string("%.3f", "start_s"), F.format_string("%.3f", "end_s")), 256)
    ids = revision.select(F.col("recording_id").alias("_r"), "revision_id")
    return found.join(ids, F.col("recording_id") == F.col("_r")).withColumn("evidence_id", named).drop("revision_id", "_r")


def blocking_quality(quality: DataFrame) -> DataFrame:
    """``recording_id, blocking``: warnings that need review, joined; null where none does."""
    grave = F.filter(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: ~starts_with_any(w, L.ADVISORY))
    none = F.size(F.coalesce("warnings", F.array().cast("array<string>"))) == 0
    text = F.when(F.col("requires_review"), F.when(none, "capture quality requires review").when(F.size(grave) > 0, F.array_join(grave, "; ")))
    return quality.select("recording_id", text.alias("blocking"))


def integrity_report(transcripts: DataFrame, attempts: DataFrame, glossary: DataFrame, quality: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Issues (``recording_id, code, detail, advisory``) and reports (``recording_id, n_issues,
    n_attempts, requires_review``): any issue that is not advisory asks for review."""
    issue = lambda df, code, detail, advisory=False: df.select("recording_id", F.lit(code).alias("code"), detail.alias("detail"), F.lit(advisory).alias("advisory"))
    counted = attempts.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_attempts"), F.max((F.size(F.coalesce("segments", F.array())) + F.size(F.coalesce("words", F.array())) > 0).cast("int")).alias("timed"))
    state = transcripts.select("recording_id").join(counted, "recording_id", "left").fillna(0)
    issues = issue(glossary_near_matches(transcripts, glossary), "glossary_near_match", F.col("term"))
    issues = issues.unionByName(issue(glossary_conflicts(transcripts, attempts, glossary), "glossary_conflict", F.col("term")))
    issues = issues.unionByName(issue(state.where("n_attempts = 0"), "missing_provenance", F.lit("no attempt")))
    issues = issues.unionByName(issue(state.where("n_attempts > 0 AND timed = 0"), "missing_timestamps", F.lit("no time ranges"), True))
    blocked = blocking_quality(quality).where("blocking IS NOT NULL").join(transcripts.select("recording_id"), "recording_id", "left_semi")
    issues = issues.unionByName(issue(blocked, "capture_quality", F.col("blocking")))
    summed = issues.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_issues"), F.bool_or(~F.col("advisory")).alias("grave"))
    report = state.join(summed, "recording_id", "left").select("recording_id", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), "n_attempts", F.coalesce("grave", F.lit(False)).alias("requires_review"))
    return issues, report


def accept_revisions(current: DataFrame, accepted: DataFrame, max_bytes: int = 10_000_000) -> DataFrame:
    """Transcripts with accepted texts put in place; blank and oversized ones change nothing."""
    good = accepted.where((strip("text") != "") & (F.octet_length("text") <= max_bytes)).select("recording_id", F.col("text").alias("_new"))
    return current.join(good, "recording_id", "left").withColumns({"accepted": F.col("_new").isNotNull(), "text": F.coalesce("_new", "text")}).drop("_new")
