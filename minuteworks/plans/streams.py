"""Queries over streams: each reads its table as a stream and runs over all that is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from minuteworks.operators import capture as Q
from minuteworks.plans.adapters import ADAPTERS, adapt, with_adapters
from minuteworks.plans.speech import overlapping_parts
from minuteworks.plans.tables import ORACLES, QUERIES, query
from minuteworks.sources import files as S
from minuteworks.sources.scratch import shared_dir
from minuteworks.streaming import live as K

FRAMES = """SELECT CAST(l_orderkey AS BIGINT) AS recording_id, TIMESTAMP '2024-01-01 00:00:00' + CAST(l_orderkey % 1000 AS INT) * INTERVAL '1' MINUTE AS started_at,
               CAST(floor(l_extendedprice * 10) AS BIGINT) AS elapsed_ms, CAST(l_quantity AS BIGINT) AS bytes FROM {lineitem}"""
ADAPTERS["frames"] = FRAMES
#: The same, and a tick a day later for every hundredth order, so that the last chunks come out too.
ADAPTERS["ticking_frames"] = FRAMES + """
        UNION ALL SELECT CAST(NULL AS BIGINT) AS recording_id, TIMESTAMP '2024-01-02 20:00:00' AS started_at, CAST(0 AS BIGINT) AS elapsed_ms, CAST(0 AS BIGINT) AS bytes FROM {lineitem} WHERE l_orderkey % 100 = 1 AND l_linenumber = 1"""


def stream_of(spark, sf_dir, table):
    """A table as a stream: its file, or the files of its folder."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{table}.parquet").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{table}.parquet*")


def projected(spark, sf_dir, adapter, table):
    return spark.sql(ADAPTERS[adapter], **{table: stream_of(spark, sf_dir, table)})


def windowed(name, operator, sql):
    """The windows over a stream of the table, in append mode: each comes out when it is closed."""

    def run(spark, sf_dir):
        frames = projected(spark, sf_dir, "ticking_frames", "lineitem")
        return K.drained(spark, operator(frames.withColumn("started_at", F.col("started_at").cast("timestamp"))))

    QUERIES[name] = run
    ORACLES[name] = with_adapters("frames", sql)


windowed("k1_chunk_windows", K.chunk_windows, "SELECT recording_id, CAST(elapsed_ms // 180000 AS INT) AS chunk_index, count(*) AS n_frames, CAST(sum(bytes) AS BIGINT) AS bytes FROM frames GROUP BY ALL")
windowed("k2_overlap_windows", K.overlap_windows, """
    SELECT recording_id, chunk_index, count(*) AS n_frames, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT recording_id, CAST(elapsed_ms // 180000 AS INT) AS chunk_index, bytes FROM frames UNION ALL SELECT recording_id, CAST(elapsed_ms // 180000 + 1 AS INT), bytes FROM frames WHERE elapsed_ms % 180000 >= 175000) GROUP BY ALL
""")


def claims(spark, sf_dir):
    return K.drained(spark, K.claims(projected(spark, sf_dir, "claim_events", "events").withColumn("ts", F.col("ts").cast("timestamp"))))


QUERIES["k6_claims"] = claims
ORACLES["k6_claims"] = with_adapters("claim_events", """
    SELECT path, CAST(split_part(o, ':', 1) AS BIGINT) AS seq, e.action, e.run_id, split_part(o, ':', 2) AS outcome FROM (
      SELECT path, unnest(string_split(rtrim(list_reduce(list_prepend({'run': '', 'act': '', 'out': ''}, l), lambda a, x: {
          'run': CASE WHEN trim(x.run) = '' THEN a.run WHEN x.act = 'claim' THEN CASE WHEN a.run = '' THEN x.run ELSE a.run END WHEN a.run = x.run THEN '' ELSE a.run END, 'act': '',
          'out': a.out || x.out || ':' || CASE WHEN trim(x.run) = '' THEN 'invalid' WHEN x.act = 'claim' THEN CASE WHEN a.run IN ('', x.run) THEN 'accepted' ELSE 'rejected' END WHEN a.run = x.run THEN 'released' ELSE 'ignored' END || ','}).out, ','), ',')) AS o
      FROM (SELECT path, list({'run': run_id, 'act': action, 'out': CAST(seq AS VARCHAR)} ORDER BY ts, seq) AS l FROM claim_events GROUP BY path)) r
    JOIN claim_events e USING (path) WHERE e.seq = CAST(split_part(o, ':', 1) AS BIGINT)
""")


def turn_parts(spark, sf_dir, turns, expected):
    """Turns of conversations as parts of a recording; ``expected`` makes their number of the turns'."""
    last = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    ts = F.timestamp_seconds(1_704_067_200 + F.col("turn") * 60)
    return turns.join(last, "conv_id").select("conv_id", F.col("conv_id").cast("string").alias("recording_id"), F.col("turn").cast("int").alias("chunk_index"), expected.alias("n_expected"), (F.col("turn") == 6).alias("failed"), "text", ts.alias("ts"))


def live(spark, sf_dir):
    parts = turn_parts(spark, sf_dir, stream_of(spark, sf_dir, "conversations"), F.col("n")).drop("conv_id")
    return K.drained(spark, K.live_transcripts(parts), typed=True).select("recording_id", "status", "n_parts")


def word_parts(docs):
    """Parts of 120 words that repeat the twelve words before them."""
    return overlapping_parts(docs).select("recording_id", "chunk_index", F.ceil(F.col("n") / 120).alias("n_expected"), F.lit(False).alias("failed"), "text", F.timestamp_seconds(1_704_067_200 + F.col("chunk_index")).alias("ts"))


def assembled(spark, sf_dir):
    """Parts of documents that overlap by twelve words, as a stream: whole transcripts come out."""
    rows = word_parts(stream_of(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("recording_id"), "text"))
    return K.drained(spark, K.live_transcripts(rows), typed=True).select("recording_id", "status", F.md5("transcript").alias("transcript_md5"))


QUERIES["k3_live_assembly"] = assembled
NUMBERED = """
    SELECT CAST(doc_id AS VARCHAR) AS recording_id, list_transform(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), lambda x, i: x || '_' || (i - 1)) AS w FROM documents"""
ORACLES["k3_live_assembly"] = f"SELECT recording_id, 'complete' AS status, md5(array_to_string(w, ' ')) AS transcript_md5 FROM ({NUMBERED}) WHERE len(w) > 0"


def clock():
    """A part of another recording, hours later: the watermark passes all that waits."""
    return F.struct(F.lit("clock").alias("recording_id"), F.lit(0).alias("chunk_index"), F.lit(1).cast("long").alias("n_expected"), F.lit(True).alias("failed"), F.lit("tick").alias("text"), F.timestamp_seconds(F.lit(1_704_067_200 + 9 * 3600)).alias("ts"))


def ticking(parts, when):
    columns = ["recording_id", "chunk_index", "n_expected", "failed", "text", "ts"]
    own = F.struct(*[F.col(c).cast("long").alias(c) if c == "n_expected" else F.col(c) for c in columns])
    return parts.select(F.explode(F.when(when, F.array(own, clock())).otherwise(F.array(own))).alias("r")).select("r.*")


def waits(spark, sf_dir):
    """Every third recording lacks a part: it waits until the watermark passes, and is ``open``."""
    parts = turn_parts(spark, sf_dir, stream_of(spark, sf_dir, "conversations"), F.col("n") + (F.col("conv_id") % 3 == 0).cast("int"))
    rows = ticking(parts.withColumn("failed", F.lit(False)), (F.col("conv_id") % 11 == 0) & (F.col("chunk_index") == 0))
    out = K.drained(spark, K.live_transcripts(rows), typed=True).where("recording_id <> 'clock'")
    return out.select("recording_id", "status", "n_parts", F.col("transcript").isNull().alias("without_text"))


QUERIES["k4_wait_limit"] = waits
ORACLES["k4_wait_limit"] = "SELECT CAST(conv_id AS VARCHAR) AS recording_id, CASE WHEN conv_id % 3 = 0 THEN 'open' ELSE 'complete' END AS status, count(*) AS n_parts, conv_id % 3 = 0 AS without_text FROM conversations GROUP BY conv_id"


def late_parts(spark, sf_dir):
    """The stream misses the last part of every third document (which is ``open``), and every fifth one says
    that it has a part less than it has (which comes late); both are whole after the batch."""
    number = F.col("recording_id").cast("long")
    docs = lambda d: d.select(F.col("doc_id").cast("string").alias("recording_id"), "text")
    parts = word_parts(docs(stream_of(spark, sf_dir, "documents")))
    last = F.col("chunk_index") + 1 == F.col("n_expected")
    rows = parts.where(~(last & ((number % 3 == 0) | (number % 5 == 0)) & (F.col("n_expected") > 1)))
    rows = rows.withColumn("n_expected", F.when((number % 5 == 0) & (number % 3 != 0) & (F.col("n_expected") > 1), F.col("n_expected") - 1).otherwise(F.col("n_expected")))
    live = K.drained(spark, K.live_transcripts(ticking(rows, (number % 11 == 0) & (F.col("chunk_index") == 0))), typed=True)
    every = word_parts(docs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return K.rebuilt_in_batch(live, every).select("recording_id", "source", F.md5("transcript").alias("transcript_md5"))


QUERIES["k4_late_parts"] = late_parts
ORACLES["k4_late_parts"] = f"""
    SELECT recording_id, CASE WHEN len(w) > 120 AND (recording_id::BIGINT % 3 = 0 OR recording_id::BIGINT % 5 = 0) THEN 'batch' ELSE 'live' END AS source, md5(array_to_string(w, ' ')) AS transcript_md5
    FROM ({NUMBERED}) WHERE len(w) > 0"""
QUERIES["k3_live_transcripts"] = live
ORACLES["k3_live_transcripts"] = "SELECT CAST(conv_id AS VARCHAR) AS recording_id, CASE WHEN max(turn) >= 6 THEN 'failed' ELSE 'complete' END AS status, count(*) AS n_parts FROM conversations GROUP BY conv_id"

ADAPTERS["handoff_events"] = """
    SELECT CAST(user_id AS VARCHAR(20)) AS audio_path, event_id AS seq, CASE WHEN event_type IN ('purchase', 'error') THEN 'finished' ELSE 'handoff' END AS kind, date_trunc('day', ts) AS handed_at, ts FROM {events}"""


def handoffs(spark, sf_dir):
    events = projected(spark, sf_dir, "handoff_events", "events").withColumns({c: F.col(c).cast("timestamp") for c in ("handed_at", "ts")}).withColumn("audio_path", F.col("audio_path").cast("string"))
    return K.drained(spark, K.dedupe_handoffs(events), typed=True).select("audio_path", "seq", F.col("handed_at").cast("timestamp_ntz").alias("handed_at"), "outcome")


QUERIES["k5_dedupe_handoffs"] = handoffs
ORACLES["k5_dedupe_handoffs"] = with_adapters("handoff_events", """
    SELECT e.audio_path, e.seq, e.handed_at, split_part(o, ':', 2) AS outcome FROM (
      SELECT audio_path, unnest(string_split(rtrim(list_reduce(list_prepend({'seen': [''], 'day': '', 'kind': '', 'active': false, 'out': ''}, l), lambda a, x: {
          'seen': CASE WHEN x.kind = 'handoff' THEN list_append(a.seen, x.day) ELSE a.seen END, 'day': '', 'kind': '',
          'active': CASE WHEN x.kind = 'finished' THEN false WHEN list_contains(a.seen, x.day) THEN a.active ELSE true END,
          'out': a.out || CASE WHEN x.kind = 'finished' THEN '' ELSE x.out || ':' || CASE WHEN list_contains(a.seen, x.day) THEN 'duplicate' WHEN a.active THEN 'active' ELSE 'accepted' END || ',' END}).out, ','), ',')) AS o
      FROM (SELECT audio_path, list({'seen': [''], 'day': CAST(handed_at AS VARCHAR), 'kind': kind, 'active': false, 'out': CAST(seq AS VARCHAR)} ORDER BY ts, seq) AS l FROM handoff_events GROUP BY audio_path)) r
    JOIN handoff_events e ON e.audio_path = r.audio_path AND e.seq = CAST(split_part(o, ':', 1) AS BIGINT) WHERE o <> ''
""")


def traces(spark, sf_dir):
    """The stream-stream join over log lines.  When all are read, a command and an answer of a clock, a day
    after the newest line, come from a second source: the watermark passes both sides, and every command
    that still waits for an answer comes out."""
    lines = projected(spark, sf_dir, "log_lines", "events").withColumn("logged_at", F.col("logged_at").cast("timestamp"))
    folder = f"{shared_dir(spark)}/clock-{uuid.uuid4().hex}"
    spark.createDataFrame([], lines.schema).write.parquet(folder)

    def tick():
        newest = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max(F.col("ts").cast("timestamp")).alias("t")).where("t IS NOT NULL")
        kinds = F.explode(F.array(F.lit("received"), F.lit("completed"))).alias("kind")
        row = {"line_id": F.lit(-1).cast("long"), "logged_at": F.col("t") + F.expr("INTERVAL 1 DAY"), "message": F.concat(F.lit("ipc.command."), "kind"), "request_id": F.concat(F.lit("clock-"), "kind"), "command": F.lit("clock"), "duration_ms": F.lit(None).cast("double")}
        newest.select("t", kinds).select(*[c.alias(n) for n, c in row.items()]).write.mode("append").parquet(folder)

    ticks = spark.readStream.schema(lines.schema).parquet(folder)
    found = K.drained(spark, K.command_traces_stream(lines.unionByName(ticks)), closing=tick)
    return found.where("NOT startswith(request_id, 'clock-')").select("request_id", "command", "outcome")


QUERIES["k7_command_traces"] = traces
ORACLES["k7_command_traces"] = with_adapters("log_lines", """
    SELECT r.request_id, r.command, d.outcome FROM (SELECT * FROM log_lines WHERE message = 'ipc.command.received') r
    LEFT JOIN (SELECT request_id, CASE WHEN message = 'ipc.command.failed' THEN 'failed' ELSE 'completed' END AS outcome FROM log_lines WHERE message <> 'ipc.command.received' AND request_id <> '-') d USING (request_id)
""")
ADAPTERS["publish_jobs"] = "SELECT doc_id AS saved_note_id, doc_id % 2 = 0 AS publish, 'recording' AS source, '2024-03-05T08:30:00Z' AS recorded_at, 'UTC' AS timezone, doc_id AS updated_at FROM {documents}"
query("s12_search_export", "notes publish_jobs", "SELECT user_id, id AS note_id, md5(content) AS text_md5 FROM notes WHERE NOT is_deleted AND id % 2 = 0")(
    lambda n, j: S.export_documents(n, j).select("user_id", F.get_json_object("document", "$.metadata.note_id").cast("long").alias("note_id"), F.md5(F.get_json_object("document", "$.text")).alias("text_md5"))
)
query("s4_parse_response", "turns", "SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN 'text' WHEN 2 THEN 'segments' END AS error, CASE WHEN turn % 4 IN (0, 3) THEN role END AS text, CASE turn % 4 WHEN 3 THEN 1 ELSE 0 END AS n_ok FROM turns")(
    lambda t: S.parse_asr_response(t.select("conv_id", "turn", F.concat(F.lit("{"), F.when(F.col("turn") % 4 != 1, F.concat(F.lit('"text":"'), "role", F.lit('"'))).otherwise('"x":1'), F.when(F.col("turn") % 4 == 2, ',"segments":[{"id":1,"text":"a"}]').when(F.col("turn") % 4 == 3, ',"segments":[{"id":1,"start":0,"end":1,"text":"a"}]').otherwise(""), F.lit("}")).alias("json")), "json").select("conv_id", "turn", "error", "text", F.size(F.filter("segments", lambda s: s["start"].isNotNull())).alias("n_ok"))
)
ADAPTERS["binary_chunks"] = "SELECT page_id AS recording_id, html FROM {pages}"
query("q3_pcm_levels", "binary_chunks", """
    SELECT recording_id, round(coalesce(list_avg(list_transform(v, lambda x: CASE WHEN abs(x) >= 32700 THEN 1.0 ELSE 0.0 END)), 0), 6) AS clipped_ratio,
           round(CASE WHEN list_sum(list_transform(v, lambda x: x * x)) > 0 THEN greatest(10 * log10(list_avg(list_transform(v, lambda x: (x / 32768.0::DOUBLE) * (x / 32768.0::DOUBLE)))), -120) ELSE -120 END, 6) AS rms_dbfs
    FROM (SELECT recording_id, list_transform(list_transform(range(len(h) // 4), lambda i: CAST('0x' || substr(h, 4 * i + 3, 2) || substr(h, 4 * i + 1, 2) AS INT)), lambda x: CAST(CASE WHEN x > 32767 THEN x - 65536 ELSE x END AS DOUBLE)) AS v
          FROM (SELECT recording_id, hex(encode(html)) AS h FROM binary_chunks))
""")(lambda p: Q.pcm_levels(p.select("recording_id", F.encode("html", "UTF-8").alias("content"))).withColumns({c: F.round(c, 6) for c in ("clipped_ratio", "rms_dbfs")}))
#: Four samples for each row of an order: chunks of the rows of 6,000 order keys with one return flag.
ADAPTERS["sound"] = """
    SELECT concat(l_returnflag, '-', CAST(CAST(floor(l_orderkey / 6000) AS BIGINT) AS VARCHAR(20))) AS recording_id, l_orderkey AS k, l_linenumber AS n,
           CAST(floor(l_extendedprice * 10) AS BIGINT) % 65536 - 32768 AS s0, l_partkey * 7919 % 20001 - 10000 AS s1, l_suppkey * 104729 % 2001 - 1000 AS s2, (l_orderkey * 31 + l_linenumber * 17) % 20001 - 10000 AS s3 FROM {lineitem}"""


def packed_sound(rows):
    """The samples of a chunk in order, as little-endian 16-bit numbers."""
    ordered = F.sort_array(F.collect_list(F.struct("k", "n", "s0", "s1", "s2", "s3")))
    samples = lambda c: F.flatten(F.transform(c, lambda r: F.array(*[r[f"s{i}"].cast("int") for i in range(4)])))
    word = lambda v: F.lpad(F.hex(v.bitwiseAND(F.lit(0xFFFF))), 4, "0")
    swapped = lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))
    return rows.groupBy("recording_id").agg(ordered.alias("l")).select("recording_id", F.unhex(F.array_join(F.transform(samples(F.col("l")), lambda v: swapped(word(v))), "")).alias("content"))


def recurrence_sql():
    """Both filters, one sample after the other, and the power of what is heard, as a fold over a list."""
    (b0, b1, b2, a1, a2), (c0, c1, c2, d1, d2) = Q.K_WEIGHTING
    y = f"({b0} * x.x + a.p)"
    z = f"({c0} * {y} + a.r)"
    step = f"""{{'x': 0.0::DOUBLE, 'p': {b1} * x.x - {a1} * {y} + a.q, 'q': {b2} * x.x - {a2} * {y}, 'r': {c1} * {y} - {d1} * {z} + a.s, 's': {c2} * {y} - {d2} * {z},
        'power': a.power + CASE WHEN abs({z}) > 3e-4 THEN {z} * {z} ELSE 0 END, 'active': a.active + CASE WHEN abs({z}) > 3e-4 THEN 1 ELSE 0 END}}"""
    none = "'p': 0.0::DOUBLE, 'q': 0.0::DOUBLE, 'r': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'power': 0.0::DOUBLE, 'active': 0.0::DOUBLE"
    return f"list_reduce(list_prepend({{'x': 0.0::DOUBLE, {none}}}, list_transform(v, lambda s: {{'x': s / 32768.0::DOUBLE, {none}}})), lambda a, x: {step})"


query("q10_chunk_loudness", "sound", f"""
    WITH c AS (SELECT recording_id, flatten(list([s0, s1, s2, s3] ORDER BY k, n, s0, s1, s2, s3)) AS v FROM sound GROUP BY recording_id), f AS (SELECT recording_id, len(v) AS n, {recurrence_sql()} AS t FROM c)
    SELECT recording_id, CASE WHEN n >= 4800 AND t.active >= 2400 AND t.power / t.active > 1e-12 THEN round(-0.691 + 10 * log10(t.power / t.active), 6) END AS lufs FROM f
""")(lambda s: Q.chunk_loudness(packed_sound(s)).withColumn("lufs", F.round("lufs", 6)))
