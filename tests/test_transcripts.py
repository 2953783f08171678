import random
import re
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from minuteworks.operators import transcripts as X


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "text string").select(expr(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Thank you for watching!", ""),
        ("We ship today. Thanks for watching this video to the end. Bye all.", "We ship today.  Bye all."),
        ("Terima kasih.", "Terima kasih."),
        ("Terima kasih. Terima kasih.", ""),
        ("Terima kasih. Jangan lupa subscribe ya.", ""),
        ("Kami bilang terima kasih kepada tim.", "Kami bilang terima kasih kepada tim."),
        ("Version 2.0 is out. Version 2.0 is out. Done", "Version 2.0 is out.  Done"),
        ("yes\nyes\nno", "yes  no"),
        ("yes. Subscribe. YES!", "yes."),
        ("... \n subscribe", ""),
        ("", ""),
    ],
)
def test_clean(spark, raw, want):
    assert one(spark, raw, X.clean_transcript) == want


def stitch(spark, *parts):
    df = spark.createDataFrame([("r", k, p) for k, p in parts], "recording_id string, chunk_index int, text string")
    return X.stitch(df).first().transcript


def test_stitch(spark):
    assert stitch(spark, (0, "a b c d e"), (1, "B, c D! e f g")) == "a b c d e f g"
    assert stitch(spark, (0, "a b c"), (1, "x y z")) == "a b c x y z"
    assert stitch(spark, (0, "a b c d"), (1, " "), (2, None), (3, "a b c d e")) == "a b c d e"
    assert stitch(spark, (10000, "late"), (9999, "early")) == "early late"
    assert stitch(spark, (0, "one two three four five six"), (1, "seven"), (2, "four five six seven eight")) == "one two three four five six seven eight"
    assert stitch(spark, (0, "a b c d e"), (1, "a b X d e f")) == "a b c d e f"
    assert stitch(spark, (0, "- - - -"), (1, "- - - -")) == "- - - - - - - -"


def test_latest_run(spark):
    rows = [("a", 0, "x", "1"), ("a", 1, "y", "2"), ("a", 2, None, "3"), ("b", 0, None, "1"), ("b", 1, None, "2"), ("c", 0, "p", "1"), ("c", 1, "q", "1")]
    df = spark.createDataFrame(rows, "recording_id string, chunk_index int, run_id string, created_at string")
    assert sorted((r.recording_id, r.chunk_index) for r in X.latest_run(df).collect()) == [("a", 1), ("b", 0), ("b", 1), ("c", 1)]


def test_arbitration(spark):
    rows = [
        ("r", 0, "we met acme korporation, today", "we met acme corporation today"),
        ("r", 1, "Thank you for watching", "we talk about the plan now"),
        ("r", 2, "mixed only here", None),
        ("r", 3, "", "only the microphone"),
        ("r", 4, "nothing like it", "said acme corporation"),
        ("s", 0, "a  b", "c"),
    ]
    tracks = spark.createDataFrame(rows, "recording_id string, chunk_index int, mixed string, microphone string")
    terms = spark.createDataFrame([("r", "Acme Corporation"), ("r", "single")], "recording_id string, term string")
    got = {(r.recording_id, r.chunk_index): r.text for r in X.arbitrate_tracks(tracks, terms).collect()}
    assert got == {("r", 0): "we met Acme Corporation, today", ("r", 1): "we talk about the plan now", ("r", 2): "mixed only here", ("r", 3): "only the microphone", ("r", 4): "nothing like it", ("s", 0): "a b"}


def test_glossary(spark):
    rows = [("r", "default", 0, "Kubernetes; alpha"), ("r", "recording", 1, "kubernetes, Beta\nbeta,,"), ("s", "recording", 0, "x" * 101 + ",a\tb")]
    built = X.build_glossary(spark.createDataFrame(rows, "recording_id string, source string, ord int, raw string"))
    got = sorted((r.recording_id, r.rank, r.term, r.error) for r in built.collect())
    assert got == [("r", 1, "kubernetes", None), ("r", 2, "Beta", None), ("r", 3, "alpha", None), ("s", 1, "x" * 101, "too_long"), ("s", 2, "a\tb", "control")]
    ranked = spark.createDataFrame([("r", "aa", 1), ("r", "b" * 50, 2), ("r", "c", 3)], "recording_id string, term string, rank int")
    assert X.prompt_terms(ranked, 64, 10).first().prompt == "aa"


def test_near_matches_and_conflicts(spark):
    texts = spark.createDataFrame([("r", "We use Kuberneter Cluster and more"), ("s", "tiny")], "recording_id string, text string")
    terms = spark.createDataFrame([("r", "kubernetes cluster"), ("r", "and more"), ("s", "much longer term"), ("s", "spoken")], "recording_id string, term string")
    assert [tuple(r) for r in X.glossary_near_matches(texts, terms).collect()] == [("r", "kubernetes cluster", "kuberneter cluster", 2)]
    heard = spark.createDataFrame([("s", "was spoken here"), ("s", "spoken")], "recording_id string, text string")
    assert [tuple(r) for r in X.glossary_conflicts(texts, heard, terms).collect()] == [("s", "spoken")]


def test_evidence_cursor(spark):
    kind = "array<struct<start: double, end: double, text: string>>"
    texts = spark.createDataFrame([("r", "ab cd ab é ef")], "recording_id string, text string")
    rows = [("r", 1, "t", "n", [], [(0.0, 1.0, "ef")]), ("r", 0, "t", "n", [(0.0, 1.0, " ab "), (1.0, 2.0, "ab"), (2.0, 3.0, "cd"), (3.0, 4.0, "é")], [(9.0, 9.0, "ab")])]
    attempts = spark.createDataFrame([(*r, "h") for r in rows], f"recording_id string, chunk_index int, created_at string, attempt_name string, segments {kind}, words {kind}, audio_sha256 string")
    got = sorted((r.chunk_index, r.i, r.char_start, r.char_end) for r in X.evidence_anchors(texts, attempts, X.revisions(texts, attempts)).collect())
    assert got == [(0, 0, 0, 2), (0, 1, 6, 8), (0, 2, None, None), (0, 3, 9, 10), (1, 0, 11, 13)]


def test_integrity(spark):
    texts = spark.createDataFrame([("a", "one"), ("b", "two")], "recording_id string, text string")
    kind = "array<struct<text: string>>"
    attempts = spark.createDataFrame([("a", "one", [], [])], f"recording_id string, text string, segments {kind}, words {kind}")
    terms = spark.createDataFrame([], "recording_id string, term string")
    quality = spark.createDataFrame([("a", True, ["track_imbalance: x"]), ("b", True, [])], "recording_id string, requires_review boolean, warnings array<string>")
    issues, report = X.integrity_report(texts, attempts, terms, quality)
    assert sorted((r.recording_id, r.code) for r in issues.collect()) == [("a", "missing_timestamps"), ("b", "capture_quality"), ("b", "missing_provenance")]
    assert {r.recording_id: r.requires_review for r in report.collect()} == {"a": False, "b": True}


def test_ten_thousand_segments(spark):
    """Facts about the whole text are made once, not for each segment."""
    import time

    from minuteworks.operators import transcripts as X

    text = "  ".join(f"Terima kasih. Segment {k} is here." for k in range(5_000))
    df = spark.createDataFrame([(text,)], "text string")
    began = time.time()
    got = df.select(X.clean_transcript(F.col("text")).alias("t")).first().t
    assert got.count("Segment") == 5_000 and "Terima" not in got and time.time() - began < 20


def plain_fold(texts):
    """The transcript by one pass over all parts."""
    out, tail = [], []
    for text in texts:
        new = (text or "").split()
        flat = [X.plain(w) for w in new]
        k = X.seam(tail, flat)
        out += new[k:]
        tail = (tail + flat[k:])[-X.LONGEST_SEAM :]
    return " ".join(out)


@pytest.mark.parametrize("longest", [12, 60, 140])
def test_stitched_blocks_are_the_plain_fold(spark, monkeypatch, longest):
    """Small blocks, parts of all lengths, overlaps, repeats, blanks: as one fold over all of them."""
    monkeypatch.setattr(X, "BLOCK", 3)
    rng, rows, want = random.Random(longest), [], {}
    for recording in range(25):
        source = [f"w{rng.randint(0, 40)}" if rng.random() < 0.8 else "-" for _ in range(1500)]
        at, texts = 0, []
        for _ in range(rng.randint(1, 14)):
            n = rng.randint(0, longest)
            texts.append(" ".join(source[at : at + n]) if rng.random() < 0.95 else rng.choice(["", None]))
            at = max(0, at + n - rng.choice([0, 0, 5, 12, 40]))
        want[recording] = plain_fold(texts)
        rows += [(recording, k, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    got = X.stitch(spark.createDataFrame(rows, "recording_id long, chunk_index int, text string")).collect()
    assert {r.recording_id: r.transcript for r in got} == want


def test_one_long_recording_is_spread_over_tasks(spark):
    """100,000 parts of one recording: no task folds more than its share, and the text is the plain fold's."""
    n = 100_000
    parts = spark.range(n, numPartitions=8).select(F.lit("hot").alias("recording_id"), F.col("id").cast("int").alias("chunk_index"), F.array_join(F.transform(F.sequence(F.col("id") * 80, F.col("id") * 80 + 89), lambda k: F.concat(F.lit("w"), k.cast("string"))), " ").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = X.stitch(parts).select(F.md5("transcript").alias("m")).first().m
        rows = parts.select("recording_id", F.floor(F.col("chunk_index") / X.BLOCK).alias("block")).repartition("recording_id", "block")
        share = rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == md5(" ".join(f"w{k}" for k in range(80 * n + 10)).encode()).hexdigest()
    assert share < n / 2  # of four tasks


def test_bit_parallel_distances():
    rng = random.Random(7)
    for _ in range(300):
        target = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90)))
        most = rng.randint(0, 3)
        windows = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 90))) for _ in range(5)]
        for _ in range(8):  # some that are near
            w = list(target)
            for _ in range(rng.randint(0, 4)):
                at = rng.randint(0, len(w))
                rng.choice([lambda: w.insert(at, rng.choice("abcé")), lambda: w and w.pop(min(at, len(w) - 1)), lambda: w and w.__setitem__(min(at, len(w) - 1), "d")])()
            windows.append("".join(w))
        assert X.near_windows(windows, target, most).tolist() == [distance(w, target) <= most for w in windows]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_matches_by_pieces_are_all_near_matches(spark):
    """Against all windows and terms; edits of every kind, at every place, in terms of 1 to 3 words."""
    rng, texts, glossary = random.Random(11), [], []
    for recording in range(12):
        terms = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 3))) for _ in range(10)]
        words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(60)]
        for term in terms:
            w = list(term)
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, len(w) - 1)
                rng.choice([lambda: w.insert(at, "x"), lambda: len(w) > 1 and w.pop(at), lambda: w.__setitem__(at, "y")])()
            words.insert(rng.randint(0, len(words)), "".join(w))
        texts.append((recording, " ".join(words)))
        glossary += [(recording, t) for t in {*terms}]
    got = {(r.recording_id, r.term): (r.candidate, r.pos) for r in X.glossary_near_matches(spark.createDataFrame(texts, "recording_id long, text string"), spark.createDataFrame(glossary, "recording_id long, term string")).collect()}
    want = {}
    for recording, text in texts:
        words = text.split()
        for r, term in glossary:
            n, most = len(term.split()), min(3, max(1, len(term) // 10))
            if r == recording and term not in " ".join(words):
                found = next(((" ".join(words[k : k + n]), k) for k in range(len(words) - n + 1) if distance(" ".join(words[k : k + n]), term) <= most), None)
                if found:
                    want[recording, term] = found
    assert got == want and want


def test_seams_and_words_are_those_of_the_plain_definition():
    def slow(tail, head):
        for k in range(min(len(tail), len(head), X.LONGEST_SEAM), X.SHORTEST_SEAM - 1, -1):
            if 5 * sum(x == y != "" for x, y in zip(tail[-k:], head)) >= 4 * k:
                return k
        return 0

    rng = random.Random(3)
    for _ in range(3000):
        tail = [rng.choice(["a", "b", "", "c"]) for _ in range(rng.randrange(60))]
        head = tail[-rng.randrange(1, 50) :] + [rng.choice(["a", "d", ""]) for _ in range(rng.randrange(30))] if rng.random() < 0.7 else [rng.choice("abx") for _ in range(rng.randrange(60))]
        head = [rng.choice(["z", w, w, w, w, w]) for w in head]
        assert X.seam(tail, head) == slow(tail, head)
    given = ["It's_1", "--", "ΑΣ_2", "İx", "¼½", "a\u0301b", "Ⅻ", "_", "STRASSE", "x²"]
    for n in range(len(given) + 1):
        assert X.plain_words(given[:n]) == [X.plain(w) for w in given[:n]]
    ascii_words = [chr(a) + chr(b) for a in range(33, 127) for b in range(33, 127)]
    assert X.plain_words(ascii_words) == [X.plain(w) for w in ascii_words]


def test_parts_become_rows_without_the_whole_document(spark):
    """No generator may carry all words of a document into each of its rows."""
    from minuteworks.plans.speech import overlapping_parts

    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300)))], "recording_id long, text string")
    parts = overlapping_parts(docs)
    assert [(r.chunk_index, r.n, r.text.split()[0], len(r.text.split())) for r in parts.collect()] == [(0, 300, "w0_0", 120), (1, 300, "w108_108", 132), (2, 300, "w228_228", 72)]
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Generate posexplode\(.*?\), \[\d+\]", plan)  # the words are dropped there


def test_cleaning_of_ends_and_of_texts_in_one_segment(spark):
    texts = ["one segment", " ends ", "a.b", "a. b", "x\n", "\u00a0a\u2003", "a  a", ".,!", "", "A-\nb. B", "b.\u2028c"]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").orderBy("i").select(X.clean_transcript(F.col("text")).alias("t")).collect()]
    assert got == ["one segment", "ends", "a.b", "a.  b", "x", "a", "a", "", "", "A-  b.", "b.  c"]
