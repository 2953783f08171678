"""Queries over transcripts, glossaries and evidence, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minuteworks.functions import lexicon as L
from minuteworks.functions.text import meaningful_word_count, normalized_words, words
from minuteworks.operators import transcripts as X
from minuteworks.plans.tables import ORACLES, QUERIES, query

DOCS = "SELECT doc_id AS recording_id, text FROM documents"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("recording_id"), "text")


def on_documents(name: str, sql: str | None):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(documents(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return function

    return register


def overlapping_parts(docs: DataFrame, size: int = 120, overlap: int = 12) -> DataFrame:
    """Windows of ``size`` words with the ``overlap`` words before them in front; every word carries
    its place, so that a seam is where it was cut.  ``n``: the words of the document.

    Windows are cut before they become rows, so no row carries all words of its document."""
    w = F.transform(words(F.col("text")), lambda x, i: F.concat(x, F.lit("_"), i.cast("string")))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(size)), lambda i: i < F.size("w"))
    first = lambda at: F.greatest(at - overlap, F.lit(0))
    text = lambda at: F.array_join(F.slice("w", first(at) + 1, at + size - first(at)), " ")
    parts = F.transform(starts, lambda at: F.struct(F.size("w").alias("n"), text(at).alias("text")))
    return docs.select("recording_id", w.alias("w")).select("recording_id", F.posexplode(parts).alias("chunk_index", "p")).select("recording_id", "chunk_index", "p.n", "p.text")


@on_documents("transcript_assembly", """
    SELECT recording_id, len(w) AS n_words, length(array_to_string(w, ' ')) AS n_chars, sha256(array_to_string(w, ' ')) AS transcript_sha256
    FROM (SELECT doc_id AS recording_id, list_transform(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), lambda x, i: x || '_' || (i - 1)) AS w FROM documents) WHERE len(w) > 0
""")
def transcript_assembly(docs: DataFrame) -> DataFrame:
    """Cuts documents into overlapping parts, cleans and stitches them, and hashes the transcripts."""
    whole = X.stitch(overlapping_parts(docs), X.clean_transcript)
    return whole.select("recording_id", F.size(F.split("transcript", " ")).cast("long").alias("n_words"), F.length("transcript").cast("long").alias("n_chars"), F.sha2("transcript", 256).alias("transcript_sha256"))


on_documents("x7_stitch", """
    SELECT recording_id, md5(array_to_string(w, ' ')) AS transcript_md5
    FROM (SELECT doc_id AS recording_id, list_transform(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), lambda x, i: x || '_' || (i - 1)) AS w FROM documents) WHERE len(w) > 0
""")(lambda d: X.stitch(overlapping_parts(d, 60, 30)).select("recording_id", F.md5("transcript").alias("transcript_md5")))
NORM = "list_filter(list_transform(string_split_regex({0}, '\\s+'), lambda w: lower(regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g'))), lambda w: w <> '')"
quoted = lambda items: ", ".join(f"'{i}'" for i in items)
any_prefix = lambda c, items: "(" + " OR ".join(f"starts_with({c}, '{i}')" for i in items) + ")"


def clean_sql(source: str) -> str:
    """``source`` has ``key, text``: the cleaned text without look-around, by marks at boundaries."""
    cut = "replace(replace(regexp_replace(text, '([.!?])(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(10), chr(10) || chr(1)), '  ', chr(1))"
    bare = "lower(regexp_replace(s, '^[.!?,\\-\\s]+|[.!?,\\-\\s]+$', '', 'g'))"
    outro = " OR ".join(f"contains(lower(text), '{p}')" for p in L.NOISE_PREFIXES)
    return f"""
    SELECT key, coalesce(array_to_string(list_transform(list_filter(k, lambda p, i: i = 1 OR p.n <> k[i - 1].n), lambda p: p.s), '  '), '') AS text FROM (
      SELECT key, list_filter(p, lambda x: x.n <> '' AND NOT {any_prefix('x.n', L.NOISE_PREFIXES)} AND NOT (x.n IN ({quoted(L.NOISE_EXACT)}) AND NOT (x.n IN ({quoted(L.SPOKEN_THANKS)}) AND NOT outro AND len(list_filter(p, lambda y: y.n IN ({quoted(L.SPOKEN_THANKS)}))) <= 1))) AS k FROM (
        SELECT key, {outro} AS outro, list_transform(list_filter(list_transform(string_split({cut}, chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> ''), lambda s: {{'s': s, 'n': {bare}}}) AS p FROM ({source})))"""


ATTEMPTS = "attempts"
query("x1_latest_run", ATTEMPTS, """
    SELECT a.recording_id, a.chunk_index, a.run_id FROM attempts a LEFT JOIN (SELECT DISTINCT ON (recording_id) recording_id, run_id FROM attempts WHERE run_id IS NOT NULL ORDER BY recording_id, created_at DESC, run_id DESC) r USING (recording_id)
    WHERE r.run_id IS NULL OR a.run_id = r.run_id
""")(lambda a: X.latest_run(a).select("recording_id", "chunk_index", "run_id"))
on_documents("x2_normalized_words", f"SELECT recording_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM (SELECT recording_id, {NORM.format('text')} AS w FROM ({DOCS}))")(
    lambda d: d.select("recording_id", normalized_words(F.col("text")).alias("w")).select("recording_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("words_md5"))
)
query("x3_clean_transcript", "raw_text", f"SELECT key AS recording_id, length(text) AS n_chars, md5(text) AS text_md5 FROM ({clean_sql('SELECT recording_id AS key, text FROM raw_text')})")(
    lambda r: r.select("recording_id", X.clean_transcript(F.col("text")).alias("t")).select("recording_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))
)
query("x4_hallucination_penalty", "raw_text", "SELECT recording_id, CAST(" + " + ".join(f"(length(text) - length(replace(lower(text), '{p}', ''))) // {len(p)}" for p in L.INVENTED) + " AS INT) AS penalty FROM raw_text")(
    lambda r: r.select("recording_id", X.hallucination_penalty(F.col("text")).alias("penalty"))
)
on_documents("x5_meaningful_words", f"SELECT recording_id, CAST(len(list_filter({NORM.format('text')}, lambda w: length(w) >= 2)) AS INT) AS n_words FROM ({DOCS})")(lambda d: d.select("recording_id", meaningful_word_count(F.col("text")).alias("n_words")))
MIXED = "SELECT recording_id || '/' || chunk_index AS key, text || ' smal golden ring.' AS text FROM attempts"
query("x6_arbitrate_tracks", ATTEMPTS, f"""
    SELECT recording_id, chunk_index, CASE WHEN chunk_index % 3 = 0 THEN text ELSE replace(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' '), 'smal golden ring', 'small golden ring') END AS text
    FROM (SELECT CAST(split_part(key, '/', 1) AS BIGINT) AS recording_id, CAST(split_part(key, '/', 2) AS INT) AS chunk_index, text FROM ({clean_sql(MIXED)}))
""")(
    lambda a: X.arbitrate_tracks(
        a.select("recording_id", "chunk_index", F.concat("text", F.lit(" smal golden ring.")).alias("mixed"), F.when(F.col("chunk_index") % 3 != 0, F.concat("text", F.lit(" small golden ring."))).alias("microphone")),
        a.select("recording_id", F.explode(F.array(F.lit("small golden ring"), F.array_join(F.slice(words(F.col("text")), 2, 2), " "))).alias("term")).distinct(),
    )
)
query("x8_concat_parts", ATTEMPTS, f"""
    SELECT CAST(split_part(key, '/', 1) AS BIGINT) AS recording_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY CAST(split_part(key, '/', 2) AS INT))) AS transcript_md5, count(*) AS n_parts
    FROM ({clean_sql("SELECT recording_id || '/' || chunk_index AS key, text FROM attempts")}) WHERE text <> '' GROUP BY 1
""")(lambda a: X.concat_parts(a).select("recording_id", F.md5("transcript").alias("transcript_md5"), "n_parts"))
query("x9_complete_recordings", ATTEMPTS, """
    SELECT recording_id, n_expected, n_ok, n_failed, CAST(n_expected - n_ok AS INT) AS n_missing, n_failed = 0 AND n_ok = n_expected AS complete
    FROM (SELECT recording_id, max(chunk_index) + CASE WHEN recording_id % 3 = 0 THEN 2 ELSE 1 END AS n_expected, count(*) FILTER (NOT failed) AS n_ok, count(*) FILTER (failed) AS n_failed FROM attempts GROUP BY 1)
""")(lambda a: X.complete_recordings(a, a.groupBy("recording_id").agg((F.max("chunk_index") + F.when(F.col("recording_id") % 3 == 0, 2).otherwise(1)).alias("n_expected"))))
GLOSSARY = """terms AS (SELECT DISTINCT ON (recording_id, lower(term)) recording_id, term, source <> 'recording' AS later, ord, pos FROM (SELECT recording_id, source, ord, trim(u.t, ' ') AS term, u.p AS pos FROM glossary, LATERAL (SELECT unnest(string_split_regex(raw, '[,;\\n]')) AS t, generate_subscripts(string_split_regex(raw, '[,;\\n]'), 1) AS p) u) WHERE term <> '' ORDER BY recording_id, lower(term), later, ord, pos),
    ranked AS (SELECT recording_id, term, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY later, ord, pos) AS INT) AS rank FROM terms)"""
query("x10_build_glossary", "glossary", f"WITH {GLOSSARY} SELECT recording_id, term, rank, CAST(NULL AS VARCHAR) AS error FROM ranked")(X.build_glossary)
query("x11_prompt_prefix", "glossary", f"""WITH {GLOSSARY}, sized AS (SELECT *, sum(length(term) + 2) OVER (PARTITION BY recording_id ORDER BY rank) - 2 AS size FROM ranked)
    SELECT recording_id, count(*) AS n_terms, string_agg(term, ', ' ORDER BY rank) AS prompt FROM sized WHERE size <= 300 AND rank <= 20 GROUP BY 1""")(lambda g: X.prompt_terms(X.build_glossary(g), 20, 300))
NEAR = """w AS (SELECT recording_id, string_agg(word, ' ' ORDER BY ord) AS flat, string_split(string_agg(word, ' ' ORDER BY ord), ' ') AS w FROM brand_texts GROUP BY 1),
    t AS (SELECT recording_id, term, len(string_split(term, ' ')) AS n, least(3, greatest(1, length(term) // 10)) AS most FROM brand_terms),
    c AS (SELECT t.recording_id, t.term, p.i AS pos, array_to_string(w.w[p.i + 1 : p.i + t.n], ' ') AS candidate, t.most FROM t JOIN w USING (recording_id), LATERAL (SELECT unnest(range(len(w.w) - t.n + 1)) AS i) p WHERE NOT contains(w.flat, t.term)),
    hits AS (SELECT DISTINCT ON (recording_id, term) recording_id, term, candidate, CAST(pos AS INT) AS pos FROM c WHERE levenshtein(candidate, term) <= most ORDER BY recording_id, term, pos)"""
brand_text = lambda b: b.groupBy("recording_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "word"))), lambda x: x["word"]), " ").alias("text"))
query("x12_glossary_near_matches", "brand_texts brand_terms", f"WITH {NEAR} SELECT * FROM hits")(lambda b, t: X.glossary_near_matches(brand_text(b), t))
query("x13_glossary_conflicts", "brand_texts brand_terms", """
    SELECT DISTINCT t.recording_id, t.term FROM brand_terms t WHERE NOT contains((SELECT string_agg(word, ' ' ORDER BY ord) FROM brand_texts b WHERE b.recording_id = t.recording_id AND ord % 2 = 0), t.term)
      AND contains((SELECT string_agg(word, ' ' ORDER BY ord) FROM brand_texts b WHERE b.recording_id = t.recording_id), t.term)
""")(lambda b, t: X.glossary_conflicts(brand_text(b.where("ord % 2 = 0")), brand_text(b), t))
WHOLE = "SELECT recording_id, string_agg(text, chr(10) ORDER BY chunk_index) AS text FROM attempts GROUP BY recording_id"
spoken = lambda a: a.groupBy("recording_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("text"))
query("x14_revisions", ATTEMPTS, f"""
    SELECT recording_id, sha256(t.text) AS transcript_sha256, sha256(sha256(t.text) || ':' || h) AS revision_id FROM ({WHOLE}) t JOIN (SELECT recording_id, string_agg(audio_sha256, ':' ORDER BY chunk_index, created_at, attempt_name) AS h FROM attempts GROUP BY 1) USING (recording_id)
""")(lambda a: X.revisions(spoken(a), a))


def with_ranges(a: DataFrame) -> DataFrame:
    """Sentences as time ranges; every fifth attempt has none."""
    piece = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda s: s != "")
    ranges = F.transform(piece, lambda s, i: F.struct(i.cast("bigint").alias("id"), (i * 2.5).alias("start"), (i * 2.5 + 2).alias("end"), s.alias("text")))
    none = F.array().cast("array<struct<id:bigint,start:double,end:double,text:string>>")
    return a.withColumns({"segments": F.when(F.col("chunk_index") % 5 == 4, none).otherwise(ranges), "words": none})


query("x15_evidence_anchors", ATTEMPTS, """
    WITH whole AS (SELECT recording_id, string_agg(text, chr(10) ORDER BY chunk_index) AS t, sha256(string_agg(text, chr(10) ORDER BY chunk_index)) AS sha, string_agg(audio_sha256, ':' ORDER BY chunk_index, created_at, attempt_name) AS h FROM attempts GROUP BY 1),
      cut AS (SELECT recording_id, chunk_index, created_at, attempt_name, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS s FROM attempts WHERE chunk_index % 5 <> 4),
      r AS (SELECT recording_id, chunk_index, i - 1 AS i, created_at, attempt_name, regexp_replace(s[i], '^\\s+|\\s+$', '', 'g') AS text FROM cut, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) u),
      l AS (SELECT recording_id, list({'t': text, 'c': CAST(0 AS BIGINT), 'o': chunk_index || ':' || i} ORDER BY chunk_index, created_at, attempt_name, i) AS l FROM r GROUP BY 1),
      f AS (SELECT recording_id, unnest(string_split(rtrim(list_reduce(list_prepend({'t': '', 'c': CAST(0 AS BIGINT), 'o': ''}, l), lambda a, x: {'t': '',
          'c': CASE WHEN x.t <> '' AND contains(substr(t, a.c + 1), x.t) THEN a.c + strpos(substr(t, a.c + 1), x.t) - 1 + length(x.t) ELSE a.c END,
          'o': a.o || x.o || ':' || CASE WHEN x.t <> '' AND contains(substr(t, a.c + 1), x.t) THEN CAST(a.c + strpos(substr(t, a.c + 1), x.t) - 1 AS VARCHAR) ELSE '' END || ','}).o, ','), ',')) AS o FROM l JOIN whole USING (recording_id))
    SELECT r.recording_id, r.chunk_index, CAST(r.i AS INT) AS i, r.i * 2.5::DOUBLE AS start_s, r.i * 2.5::DOUBLE + 2 AS end_s, r.text, CAST(nullif(split_part(o, ':', 3), '') AS INT) AS char_start, CAST(nullif(split_part(o, ':', 3), '') AS INT) + CAST(length(r.text) AS INT) AS char_end,
           sha256(sha256(w.sha || ':' || w.h) || ':' || r.chunk_index || ':' || r.i || ':' || printf('%.3f', r.i * 2.5::DOUBLE) || ':' || printf('%.3f', r.i * 2.5::DOUBLE + 2)) AS evidence_id
    FROM f JOIN r ON r.recording_id = f.recording_id AND r.chunk_index = CAST(split_part(o, ':', 1) AS INT) AND r.i = CAST(split_part(o, ':', 2) AS BIGINT) JOIN whole w ON w.recording_id = r.recording_id
""")(lambda a: X.evidence_anchors(spoken(a), with_ranges(a), X.revisions(spoken(a), a).select(F.col("recording_id").alias("r"), "revision_id").withColumnRenamed("r", "recording_id")))
query("x16_blocking_quality", "reports", """
    SELECT recording_id, CASE WHEN requires_review THEN CASE recording_id % 4 WHEN 0 THEN 'capture quality requires review' WHEN 2 THEN 'mic_missing: c; mixed_clipping: d' WHEN 3 THEN 'mic_overrun: e' END END AS blocking FROM reports
""")(X.blocking_quality)
def brand_attempts(b: DataFrame) -> DataFrame:
    """Three attempts a recording; recordings ending in 7 have none, those ending in 3 no time ranges."""
    texts = brand_text(b.where("recording_id NOT LIKE '%7'").withColumn("recording_id", F.struct("recording_id", (F.col("ord") % 3).alias("part"))))
    none = F.array().cast("array<struct<text:string>>")
    ranges = F.when(~F.col("recording_id.recording_id").endswith("3"), F.array(F.struct("text"))).otherwise(none)
    return texts.select(F.col("recording_id.recording_id").alias("recording_id"), "text", ranges.alias("segments"), none.alias("words"))


ALL_KINDS = f"""
    WITH even AS (SELECT * FROM brand_texts WHERE ord % 2 = 0), {NEAR.replace("brand_texts", "even")},
    said AS (SELECT recording_id, string_agg(word, ' ' ORDER BY ord) AS text FROM brand_texts WHERE recording_id NOT LIKE '%7' GROUP BY recording_id, ord % 3),
    n AS (SELECT w.recording_id, count(s.text) AS n_attempts FROM w LEFT JOIN said s USING (recording_id) GROUP BY 1),
    issues AS (
      SELECT recording_id, 'glossary_near_match' AS code, term AS detail, false AS advisory FROM hits
      UNION ALL SELECT DISTINCT t.recording_id, 'glossary_conflict', t.term, false FROM brand_terms t JOIN w USING (recording_id) JOIN said s USING (recording_id) WHERE NOT contains(w.flat, t.term) AND contains(s.text, t.term)
      UNION ALL SELECT recording_id, 'missing_provenance', 'no attempt', false FROM n WHERE n_attempts = 0
      UNION ALL SELECT recording_id, 'missing_timestamps', 'no time ranges', true FROM n WHERE n_attempts > 0 AND recording_id LIKE '%3'
      UNION ALL SELECT w.recording_id, 'capture_quality', CASE r.recording_id % 4 WHEN 0 THEN 'capture quality requires review' WHEN 2 THEN 'mic_missing: c; mixed_clipping: d' ELSE 'mic_overrun: e' END, false
        FROM reports r JOIN w ON w.recording_id = 'Brand#' || r.recording_id WHERE r.requires_review AND r.recording_id % 4 <> 1)
    SELECT n.recording_id, count(i.code) AS n_issues, n.n_attempts, coalesce(bool_or(NOT i.advisory), false) AS requires_review,
           coalesce(string_agg(i.code || ':' || i.detail || ':' || i.advisory, '|' ORDER BY i.code || ':' || i.detail || ':' || i.advisory), '') AS issues
    FROM n LEFT JOIN issues i USING (recording_id) GROUP BY 1, 3
"""


@query("x17_integrity_all_kinds", "brand_texts brand_terms reports", ALL_KINDS)
def integrity_all_kinds(b: DataFrame, t: DataFrame, r: DataFrame) -> DataFrame:
    """Every second word as transcript, all words as attempts, reports of the same number as quality."""
    quality = r.withColumn("recording_id", F.concat(F.lit("Brand#"), F.col("recording_id").cast("string")))
    issues, report = X.integrity_report(brand_text(b.where("ord % 2 = 0")), brand_attempts(b), t, quality)
    listed = issues.groupBy("recording_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "code", "detail", F.col("advisory").cast("string")))), "|").alias("issues"))
    return report.join(listed, "recording_id", "left").fillna("", ["issues"])


query("x17_integrity_report", "brand_texts brand_terms reports", ALL_KINDS.replace("    SELECT n.recording_id, count(i.code)", "    SELECT * EXCLUDE (issues) FROM (SELECT n.recording_id, count(i.code)") + ")")(lambda b, t, r: integrity_all_kinds(b, t, r).drop("issues"))


query("x18_accept_revisions", ATTEMPTS, f"""
    SELECT t.recording_id, n.text IS NOT NULL AS accepted, md5(coalesce(n.text, t.text)) AS text_md5 FROM ({WHOLE}) t LEFT JOIN (SELECT recording_id, text FROM attempts WHERE chunk_index = 1 AND strlen(text) <= 900) n USING (recording_id)
""")(lambda a: X.accept_revisions(spoken(a), a.where("chunk_index = 1"), 900).select("recording_id", "accepted", F.md5("text").alias("text_md5")))
