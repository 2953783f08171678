"""Queries over notes, tasks, accounts, jobs, logs and capture quality, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from minuteworks.operators import capture as Q
from minuteworks.operators import jobs as J
from minuteworks.operators import logs as G
from minuteworks.operators import notes as N
from minuteworks.operators import tasks as T
from minuteworks.plans.adapters import adapt, with_adapters

NOW = datetime(2024, 1, 20, 12, 0, 0)
NOW_SQL = "TIMESTAMP '2024-01-20 12:00:00'"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, adapters: str, sql: str | None):
    """Registers a function of the named adapters' DataFrames."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(*(adapt(spark, sf_dir, a) for a in adapters.split()))
        if sql is not None:
            ORACLES[name] = with_adapters(adapters, sql)
        return function

    return register


def text_of(tags: str) -> str:
    return f"array_to_string({tags}, '|')"


joined = lambda c: F.array_join(c, "|")

# ---- notes ----
query("n1_active_notes", "notes", "SELECT id, user_id, title, created_at FROM notes WHERE NOT is_deleted")(lambda n: N.active_notes(n).select("id", "user_id", "title", "created_at"))
query("n2_visible_tags", "notes", f"SELECT id, {text_of('list_filter(tags, lambda t: NOT starts_with(t, ' + chr(39) + 'internal-' + chr(39) + '))')} AS tags FROM notes")(lambda n: N.visible_tags(n).select("id", joined("tags").alias("tags")))
query("n3_tag_metadata", "notes", """
    SELECT id, CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-03-05 08:30:00' END AS recorded_at,
           list_filter(tags, lambda t: starts_with(t, 'internal-timezone:'))[1][19:] AS recording_timezone FROM notes
""")(lambda n: N.decode_tag_metadata(n).select("id", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"), "recording_timezone"))
query("n4_merge_tags", "notes note_patches", """
    SELECT p.id, CASE WHEN p.tags IS NULL THEN NULL ELSE array_to_string(list_concat(list_filter(p.tags, lambda t: NOT starts_with(t, 'internal-')), list_filter(n.tags, lambda t: starts_with(t, 'internal-'))), '|') END AS tags
    FROM note_patches p JOIN notes n USING (id)
""")(lambda n, p: n.alias("n").join(p.alias("p"), "id").select("id", joined(N.merged_tags(F.col("n.tags"), F.col("p.tags"))).alias("tags")))
query("n5_title_errors", "note_requests", """
    SELECT request_id, regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS title, CASE WHEN length(regexp_replace(title, '^\\s+|\\s+$', '', 'g')) = 0 THEN 'empty' WHEN length(regexp_replace(title, '^\\s+|\\s+$', '', 'g')) > 240 THEN 'too_long' END AS title_error FROM note_requests
""")(lambda r: N.validate_titles(r).select("request_id", "title", "title_error"))
query("n6_request_errors", "note_requests", """
    SELECT request_id, CASE WHEN strlen(timezone) < 1 OR strlen(timezone) > 64 THEN 'timezone' WHEN recorded_at = 'yesterday' THEN 'recorded_at' END AS request_error FROM note_requests
""")(lambda r: N.validate_note_requests(r).select("request_id", "request_error"))
query("n7_insert_once", "notes note_requests", """
    SELECT r.request_id, r.user_id, r.job_id, h.note_id,
           CASE WHEN h.note_id IS NOT NULL THEN 'existing' WHEN r.request_id = min(r.request_id) OVER (PARTITION BY r.user_id, r.job_id) THEN 'insert' ELSE 'duplicate' END AS action
    FROM note_requests r LEFT JOIN (SELECT user_id, t, min(id) AS note_id FROM (SELECT user_id, id, unnest(tags) AS t FROM notes) GROUP BY ALL) h ON h.user_id = r.user_id AND h.t = 'internal-job:' || replace(r.job_id, 'job-', '')
""")(lambda n, r: N.insert_once(n, r.withColumn("job_id", F.regexp_replace("job_id", "job-", ""))).withColumn("job_id", F.concat(F.lit("job-"), "job_id")))
query("n8_patch_notes", "notes note_patches", """
    SELECT p.id, p.user_id, outcome, CASE WHEN outcome = 'updated' THEN coalesce(p.title, n.title) ELSE n.title END AS title,
           CASE WHEN outcome = 'updated' THEN coalesce(p.content, n.content) ELSE n.content END AS content,
           CASE WHEN outcome = 'updated' THEN coalesce(p.is_favorite, n.is_favorite) ELSE n.is_favorite END AS is_favorite,
           array_to_string(CASE WHEN outcome = 'updated' AND p.tags IS NOT NULL THEN list_concat(['red', 'red'], list_filter(n.tags, lambda t: starts_with(t, 'internal-'))) ELSE n.tags END, '|') AS tags
    FROM note_patches p LEFT JOIN (SELECT * FROM notes WHERE NOT is_deleted) n ON n.id = p.id AND n.user_id = p.user_id,
    LATERAL (SELECT CASE WHEN n.id IS NULL THEN 'not_found' WHEN p.expected_updated_at <> n.updated_at THEN 'conflict' ELSE 'updated' END AS outcome)
""")(lambda n, p: N.patch_notes(n, p).withColumn("tags", joined("tags")))
query("n9_soft_delete", "notes note_patches", "SELECT id, user_id, is_deleted OR (id, user_id) IN (SELECT (id, user_id) FROM note_patches) AS is_deleted FROM notes")(lambda n, p: N.soft_delete(n, p, ["id", "user_id"]).select("id", "user_id", "is_deleted"))
query("n9_toggle_favorite", "notes note_patches", "SELECT p.id, p.user_id, NOT n.is_favorite AS is_favorite FROM note_patches p LEFT JOIN notes n ON n.id = p.id AND n.user_id = p.user_id AND NOT n.is_deleted")(lambda n, p: N.toggle_favorite(n, p.select("id", "user_id")))
query("n10_search_totals", "notes", """
    SELECT user_id, count(*) AS n_unarchived, count(*) FILTER (contains(lower(title), 'ether') OR contains(lower(content), 'ether') OR contains(lower(array_to_string(tags, '|')), 'ether')) AS n_matched
    FROM notes WHERE NOT is_archived AND NOT is_deleted GROUP BY user_id
""")(lambda n: N.search_totals(n, "  ETHER "))
query("n11_ranked_search", "notes", """
    SELECT id, score FROM (SELECT id, CASE WHEN starts_with(lower(title), 'th') THEN 0 WHEN regexp_matches(lower(content), '(^|\\s)th') THEN 1 WHEN contains(lower(title) || ' ' || lower(content), 'th') THEN 2 END AS score FROM notes)
    WHERE score IS NOT NULL ORDER BY score, id LIMIT 25
""".replace("\\\\", "\\"))(lambda n: N.ranked_search(n, "Th", "title", "content", "id", 25).select("id", "score"))
# ---- tasks and accounts ----
KNOWN = "status IN ('backlog', 'this_week', 'today', 'done') AND NOT is_deleted"
query("t1_active_tasks", "tasks", "SELECT id, user_id, status, position FROM tasks WHERE NOT is_deleted")(lambda t: T.active_tasks(t).select("id", "user_id", "status", "position"))
query("t2_patch_tasks", "tasks task_updates", "SELECT p.id, t.id IS NOT NULL AS found, CASE WHEN t.id IS NOT NULL THEN p.status END AS status, t.title FROM task_updates p LEFT JOIN tasks t ON t.id = p.id AND NOT t.is_deleted")(
    lambda t, p: T.patch_tasks(t, p.withColumn("title", F.lit(None).cast("string")), ["status", "title"])
)
query("t3_toggle_completion", "tasks task_updates", f"""
    SELECT id, CASE WHEN id IN (SELECT id FROM task_updates) THEN CASE WHEN completed_at IS NULL THEN {NOW_SQL} END ELSE completed_at END AS completed_at FROM tasks
""")(lambda t, u: T.toggle_completion(t.withColumn("completed_at", F.col("completed_at").cast("timestamp_ntz")), u, NOW).select("id", F.col("completed_at").cast("timestamp_ntz").alias("completed_at")))
query("t4_apply_positions", "tasks task_updates", """
    SELECT t.id, coalesce(u.position, t.position) AS position, coalesce(u.status, t.status) AS status FROM tasks t
    LEFT JOIN (SELECT DISTINCT ON (id) id, position, status FROM task_updates ORDER BY id, seq DESC) u USING (id) WHERE NOT t.is_deleted
""")(lambda t, u: T.apply_positions(t, u).select("id", "position", "status"))
query("t5_clear_column", "tasks task_moves", "SELECT id, is_deleted OR EXISTS (SELECT 1 FROM task_moves m WHERE m.user_id = t.user_id AND m.status = t.status) AS is_deleted FROM tasks t")(lambda t, m: T.clear_column(t, m).select("id", "is_deleted"))
query("t6_task_board", "tasks", f"""
    SELECT id, user_id, status, CAST(CASE WHEN coalesce(duration_minutes, 0) > 0 THEN duration_minutes ELSE 20 END AS VARCHAR) || ' Min' AS duration_label, completed_at IS NOT NULL AS is_done,
           CAST(row_number() OVER (PARTITION BY user_id, status ORDER BY position, id) AS INT) AS place FROM tasks WHERE {KNOWN}
""")(T.task_board)
query("t7_column_progress", "tasks", f"""
    SELECT user_id, status, count(*) AS n_tasks, count(completed_at) AS n_done, CAST(round(100.0 * count(completed_at) / count(*)) AS INT) AS percent FROM tasks WHERE {KNOWN} GROUP BY ALL
""")(T.column_progress)
query("t8_move_task", "tasks task_moves", """
    SELECT id, user_id, status, CAST(row_number() OVER (PARTITION BY user_id, status ORDER BY k, i) - 1 AS INT) AS position FROM (
      SELECT r.id, r.user_id, r.status, r.i, CASE WHEN m.user_id IS NULL OR greatest(from_index, to_index) >= n THEN r.i WHEN r.i = from_index THEN to_index + CASE WHEN to_index > from_index THEN 0.5 ELSE -0.5 END ELSE r.i END AS k
      FROM (SELECT id, user_id, status, row_number() OVER (PARTITION BY user_id, status ORDER BY position, id) - 1 AS i, count(*) OVER (PARTITION BY user_id, status) AS n FROM tasks WHERE NOT is_deleted) r
      LEFT JOIN task_moves m ON m.user_id = r.user_id AND m.status = r.status)
""")(T.move_task)
query("a1_duplicate_accounts", "users account_requests", "SELECT request_id FROM account_requests WHERE email IN (SELECT email FROM users) OR username IN (SELECT username FROM users)")(T.duplicate_accounts)
query("a2_connections", "connections", "SELECT id, user_id, provider, created_at, provider_data->>'$.login' AS login, provider_data->>'$.email' AS email, provider_data->>'$.name' AS name FROM connections")(T.connections)
query("a2_insert_connections", "connections", """
    SELECT id, (user_id, provider) NOT IN (SELECT (user_id, provider) FROM connections WHERE id % 3 = 0) AND id = min(id) OVER (PARTITION BY user_id, provider) AS accepted FROM connections WHERE id % 3 <> 0
""")(lambda c: T.insert_connections(c.where("id % 3 = 0"), c.where("id % 3 <> 0")))
query("a0_public_users", "users", "SELECT id, email, username, is_verified FROM users")(T.public_users)
# ---- jobs ----
TRANSIENT_SQL = "(" + " OR ".join(f"contains(lower(coalesce(error, '')), '{p}')" for p in J.TRANSIENT) + ")"
KIND = f"CASE WHEN status = 'failed' THEN CASE WHEN coalesce(attempt, 0) >= 4 THEN 'terminal' WHEN {TRANSIENT_SQL} THEN 'retryable' ELSE 'terminal' END END"
MINUTES = f"CASE WHEN {KIND} = 'retryable' THEN least(power(2, greatest(0, coalesce(attempt, 1) - 1)), 16) END"
RECOVER = f"""coalesce(attempt, 0) < 4 AND status NOT IN ('complete', 'partial') AND CASE WHEN status = 'failed' THEN coalesce({KIND} = 'retryable', false) AND (next_attempt_at IS NULL OR next_attempt_at <= {NOW_SQL})
    ELSE repairing_fallback OR upgrading_ai OR status IN ('importing', 'transcribing', 'extracting', 'synthesizing', 'saving') END"""
query("j1_validate_manifests", "manifests", """
    SELECT job_id, v AS schema_version, CASE WHEN coalesce(v, 0) NOT IN (1, 2) THEN 'schema_version'
        WHEN v = 1 AND trim(coalesce(job_id, '')) = '' THEN 'job_id' WHEN v = 1 AND trim(coalesce(CASE WHEN attempt IS NULL THEN transcript ELSE audio_path END, '')) = '' THEN 'audio_path' WHEN v = 1 AND trim(coalesce(status, '')) = '' THEN 'status'
        WHEN v = 2 AND trim(coalesce(owner, '')) = '' THEN 'recording_id' WHEN v = 2 AND (trim(coalesce(enhancement_mode, '')) = '' OR trim(coalesce(transcript, '')) = '') THEN 'language_or_timezone'
        WHEN v = 2 AND right(job_id, 1) <> right(owner, 1) THEN 'directory' WHEN coalesce(fallback_version, 1) - 1 < 0 THEN 'generation' END AS reject_reason
    FROM (SELECT *, CASE WHEN saved_note_id IS NOT NULL THEN transcription_pipeline_version END AS v FROM manifests)
""")(
    lambda m: J.validate_manifests(
        m.select(
            "job_id", F.when(F.col("saved_note_id").isNotNull(), F.col("transcription_pipeline_version")).alias("schema_version"), F.when(F.col("attempt").isNull(), F.col("transcript")).otherwise(F.col("audio_path")).alias("audio_path"), "status",
            F.col("owner").alias("recording_id"), F.col("enhancement_mode").alias("language"), F.col("transcript").alias("timezone"), F.concat(F.lit("owner-"), F.substring("job_id", -1, 1)).alias("directory"), (F.coalesce("fallback_version", F.lit(1)) - 1).alias("generation"),
        )
    ).select("job_id", "schema_version", "reject_reason")
)
query("j2_failure_class", "manifests", f"SELECT job_id, {KIND} AS failure_kind FROM manifests")(lambda m: J.classify_failures(m).select("job_id", "failure_kind"))
query("j3_next_attempt", "manifests", f"SELECT job_id, CAST({MINUTES} AS INT) AS retry_minutes, {NOW_SQL} + to_minutes(CAST({MINUTES} AS INT)) AS retry_at, CAST(least(2 * power(2, coalesce(attempt, 0)), 60) AS INT) AS upload_backoff_s FROM manifests")(
    lambda m: J.schedule_retries(m, NOW).select("job_id", "retry_minutes", F.col("retry_at").cast("timestamp_ntz").alias("retry_at"), "upload_backoff_s")
)
query("j4_recoverable", "manifests", f"SELECT job_id, status FROM manifests WHERE {RECOVER}")(lambda m: J.recoverable(m, NOW).select("job_id", "status"))
query("j5_import_queue", "manifests", f"SELECT job_id, owner, CAST(row_number() OVER (PARTITION BY owner ORDER BY updated_at, job_id) AS INT) AS place FROM manifests WHERE source = 'import' AND owner IS NOT NULL AND {RECOVER}")(lambda m: J.import_queue(m, NOW).select("job_id", "owner", "place"))
query("j5_recording_queue", "manifests", f"SELECT job_id, owner, updated_at FROM manifests WHERE source <> 'import' AND (owner IS NULL OR owner = 'owner-3') AND {RECOVER}")(lambda m: J.recording_queue(m, "owner-3", NOW).select("job_id", "owner", "updated_at"))
query("j6_rerun_plan", "manifests", """
    SELECT job_id, plan, plan = 'upgrade' AS drops_sections, trim(coalesce(transcript, '')) <> '' AND coalesce(transcription_pipeline_version, 0) < 3 AS refresh_transcript FROM (
      SELECT *, CASE WHEN (status = 'partial' OR repairing_fallback) AND saved_note_id IS NOT NULL AND coalesce(fallback_version, 0) < 1 THEN 'repair'
                     WHEN status = 'partial' AND enhancement_mode = 'extractive-fallback' AND coalesce(ai_pipeline_version, 0) < 16 THEN 'upgrade' ELSE 'none' END AS plan FROM manifests)
""")(lambda m: J.plan_reruns(m).select("job_id", "plan", "drops_sections", "refresh_transcript"))


def outcomes_of(m):
    """An outcome for most jobs; the message is the one that the job has already."""
    kinds = F.array(*[F.lit(k) for k in ("begin", "retry_by_user", "pause", "failure", "finish", "accept", "no_speech")])
    e = F.substring("job_id", 5, 20).cast("long")
    return m.where(e % 11 < 7).select("job_id", F.element_at(kinds, (e % 11 + 1).cast("int")).alias("outcome"), (e % 2 == 0).alias("needs_review"), (e % 3 == 0).alias("used_fallback"), (e % 5 == 0).alias("degraded"), F.when(e % 4 != 0, F.coalesce("error", F.col("source"))).alias("outcome_error"))


query("j7_apply_outcomes", "manifests", f"""
    WITH m AS (SELECT *, CAST(substr(job_id, 5) AS BIGINT) AS e, CAST(substr(job_id, 5) AS BIGINT) % 11 AS o, generation % 3 <> 0 AS prepared FROM manifests),
    said AS (SELECT *, CASE WHEN e % 4 <> 0 THEN coalesce(error, source) END AS message FROM m),
    kinds AS (SELECT *, {TRANSIENT_SQL.replace("error", "message")} AND coalesce(attempt, 1) < 4 AS passes FROM said)
    SELECT job_id,
      CAST(CASE o WHEN 0 THEN coalesce(attempt, 0) + 1 WHEN 1 THEN 1 WHEN 2 THEN greatest(0, coalesce(attempt, 1) - 1) ELSE attempt END AS INT) AS attempt,
      CASE o WHEN 3 THEN 'failed' WHEN 4 THEN CASE WHEN e % 2 = 0 THEN 'partial' ELSE 'complete' END WHEN 5 THEN 'complete' WHEN 6 THEN 'complete' WHEN 2 THEN CASE WHEN source = 'import' AND NOT prepared THEN 'importing' ELSE 'transcribing' END ELSE status END AS status,
      CASE o WHEN 4 THEN CASE WHEN e % 3 = 0 THEN 'extractive-fallback' WHEN e % 5 = 0 THEN 'hybrid' ELSE 'ai' END WHEN 5 THEN 'ai' ELSE enhancement_mode END AS enhancement_mode,
      CAST(CASE WHEN o IN (4, 5) THEN 16 ELSE ai_pipeline_version END AS INT) AS ai_pipeline_version,
      CAST(CASE WHEN o = 4 AND e % 3 = 0 THEN 1 WHEN o = 5 THEN NULL ELSE fallback_version END AS INT) AS fallback_version,
      CASE WHEN o = 3 THEN message WHEN o = 4 THEN CASE WHEN e % 2 = 0 THEN coalesce(message, '{J.FALLBACK_NOTICE}') END WHEN o IN (2, 5, 6) THEN NULL ELSE error END AS error,
      CASE WHEN o = 3 THEN CASE WHEN passes THEN 'retryable' ELSE 'terminal' END WHEN o >= 7 THEN {KIND} END AS failure_kind,
      CASE WHEN o = 3 AND passes THEN {NOW_SQL} + to_minutes(CAST(least(power(2, greatest(0, coalesce(attempt, 1) - 1)), 16) AS INT)) WHEN o >= 7 THEN next_attempt_at END AS next_attempt_at,
      CASE WHEN o = 6 THEN '' ELSE transcript END AS transcript, CAST(CASE WHEN o = 6 THEN 3 ELSE transcription_pipeline_version END AS INT) AS transcription_pipeline_version
    FROM kinds
""")(lambda m: J.apply_outcomes(J.classify_failures(m).withColumn("import_prepared", F.col("generation") % 3 != 0), outcomes_of(m), NOW).withColumn("next_attempt_at", F.col("next_attempt_at").cast("timestamp_ntz")))
query("j8_note_routes", "notes manifests", """
    SELECT n.id AS note_id, CASE WHEN s.job_id IS NOT NULL THEN 'recording' WHEN a.job_id IS NOT NULL THEN 'retry_processing' WHEN n.id % 3 = 0 THEN 'missing_recording_source' ELSE 'note' END AS route, coalesce(s.job_id, a.job_id) AS job_id
    FROM notes n
    LEFT JOIN (SELECT DISTINCT ON (saved_note_id) saved_note_id, job_id FROM manifests WHERE trim(coalesce(transcript, '')) <> '' AND saved_note_id IS NOT NULL ORDER BY saved_note_id, updated_at DESC, job_id DESC) s ON s.saved_note_id = n.id
    LEFT JOIN (SELECT DISTINCT ON (k) k, job_id FROM (SELECT saved_note_id AS k, job_id, updated_at FROM manifests UNION ALL SELECT failure_note_id, job_id, updated_at FROM manifests) WHERE k IS NOT NULL ORDER BY k, updated_at DESC, job_id DESC) a ON a.k = n.id
""")(lambda n, m: J.note_routes(n.withColumn("is_recording", F.col("id") % 3 == 0), m))
query("j9_publication_gate", "manifests", "SELECT job_id, NOT (status = 'partial' OR coalesce(failure_note_id IS NOT NULL, false) OR coalesce(attempt, 0) > 4 OR repairing_fallback) AS publish FROM manifests")(
    lambda m: J.publishable(m.withColumns({"processing_degraded": F.col("status") == "partial", "has_failed_section": F.col("failure_note_id").isNotNull(), "transcript_requires_review": F.col("attempt") > 4, "note_was_edited": F.col("repairing_fallback")})).select("job_id", "publish")
)
query("j10_illegal_transitions", "state_log", f"""
    SELECT recording_id, generation, f AS from_state, state AS to_state FROM (SELECT *, lag(state) OVER (PARTITION BY recording_id ORDER BY generation) AS f FROM state_log)
    WHERE f <> state AND (f || '>' || state) NOT IN ({", ".join(f"'{a}>{b}'" for a, b in J.TRANSITIONS)})
""")(J.illegal_transitions)
def generation_writes(m):
    """A write for each event of a path: what it expects, what it writes, and by which rule."""
    path = F.col("audio_path").cast("long")
    expected = F.when(F.col("attempt").isNotNull(), F.floor(F.col("generation") / 2) + F.col("attempt") % 2)
    return m.select(F.col("audio_path").alias("job_id"), F.col("generation").alias("seq"), expected.alias("expected"), (F.coalesce(expected, F.lit(0)) + F.when(F.col("saved_note_id").isNull(), 2).otherwise(1)).alias("next"), (path % 2 + 1).alias("version"))


def stored_generations(m):
    """Two in three paths are stored already, by generations 0 to 2; the others are new."""
    path = F.col("audio_path").cast("long")
    return m.select(F.col("audio_path").alias("job_id"), (path % 5 % 3).alias("generation")).where(path % 3 != 0).distinct()


query("j11_generations", "manifests", """
    WITH w AS (
      SELECT audio_path AS job_id, generation AS seq, CAST(audio_path AS BIGINT) AS p, coalesce(CASE WHEN attempt IS NOT NULL THEN generation // 2 + attempt % 2 END, 0) AS expected,
             CASE WHEN saved_note_id IS NULL THEN 2 ELSE 1 END AS step FROM manifests
    ), walked AS (
      SELECT job_id, list_reduce(list_prepend({'stored': CASE WHEN p % 3 <> 0 THEN p % 5 % 3 ELSE -1 END, 'expected': 0::BIGINT, 'step': 0, 'version': 0::BIGINT, 'out': ''}, l), lambda a, x: {
        'stored': a.stored + CASE WHEN x.version = 2 AND a.stored < 0 OR x.expected <> greatest(a.stored, 0) OR x.version = 2 AND x.step <> 1 THEN 0 ELSE 1 END, 'expected': 0::BIGINT, 'step': 0, 'version': 0::BIGINT,
        'out': a.out || x.out || ':' || CASE WHEN x.version = 2 AND a.stored < 0 THEN 'missing' WHEN x.expected <> greatest(a.stored, 0) THEN 'conflict' WHEN x.version = 2 AND x.step <> 1 THEN 'invalid' ELSE 'accepted' END || ','}).out AS o
      FROM (SELECT job_id, p, list({'stored': 0::BIGINT, 'expected': expected, 'step': step, 'version': p % 2 + 1, 'out': CAST(seq AS VARCHAR)} ORDER BY seq) AS l FROM w GROUP BY job_id, p)
    )
    SELECT job_id, CAST(split_part(x, ':', 1) AS BIGINT) AS seq, split_part(x, ':', 2) AS outcome FROM (SELECT job_id, unnest(string_split(rtrim(o, ','), ',')) AS x FROM walked)
""")(lambda m: J.apply_generations(stored_generations(m), generation_writes(m)))
query("j12_stage_timings", "manifests", """
    SELECT stage, status, enhancement_mode, count(*) AS n, avg(ms) AS mean_ms, quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms, max(ms) AS max_ms
    FROM (SELECT 'transcribe' AS stage, status, enhancement_mode, value_ms AS ms FROM manifests UNION ALL SELECT 'save', status, enhancement_mode, value_ms * 2 FROM manifests) GROUP BY ALL
""")(lambda m: J.stage_timings(m.withColumn("timings_ms", F.create_map(F.lit("transcribe"), F.col("value_ms"), F.lit("save"), F.col("value_ms") * 2))))
query("j13_error_bucket", "manifests", """
    SELECT job_id, stage, CASE WHEN error IS NULL THEN NULL WHEN stage = 'import' AND regexp_matches(lower(error), 'no such file|not found') THEN 'source_missing' WHEN stage = 'import' AND regexp_matches(lower(error), 'disk full|no space|permission denied|hard.link|publish') THEN 'not_saved'
           WHEN stage = 'import' AND regexp_matches(lower(error), 'decode|codec|corrupt|truncat|invalid|unsupported|empty') THEN 'bad_audio' WHEN stage = 'processing' AND regexp_matches(lower(error), 'no speech|no usable text') THEN 'no_speech'
           WHEN stage = 'processing' AND regexp_matches(lower(error), 'api.?key|unauthorized') THEN 'credentials' WHEN stage = 'processing' AND regexp_matches(lower(error), 'network|time.?out|connection') THEN 'network'
           WHEN stage = 'screenshot' AND regexp_matches(lower(error), 'permission') THEN 'screen_permission' ELSE stage || '_failed' END AS bucket
    FROM (SELECT job_id, error, CASE WHEN source = 'import' THEN 'import' WHEN generation % 3 = 0 THEN 'screenshot' ELSE 'processing' END AS stage FROM manifests)
""")(lambda m: J.error_bucket(m.withColumn("stage", F.when(F.col("source") == "import", "import").when(F.col("generation") % 3 == 0, "screenshot").otherwise("processing")), "stage").select("job_id", "stage", "bucket"))
query("j5_reset_imports", "manifests", f"""
    SELECT job_id, r AS reset, CASE WHEN r THEN CASE WHEN generation % 3 = 0 THEN 'importing' ELSE 'transcribing' END ELSE status END AS status, CASE WHEN r THEN 0 ELSE attempt END AS attempt, CASE WHEN r THEN NULL ELSE error END AS error
    FROM (SELECT *, source = 'import' AND (status = 'failed' OR coalesce(attempt, 0) >= {J.MAX_ATTEMPTS} AND status IN ({", ".join(f"'{s}'" for s in J.IN_FLIGHT)})) AS r FROM manifests)
""")(lambda m: J.reset_imports(m.withColumn("import_prepared", F.col("generation") % 3 != 0)).select("job_id", "reset", "status", "attempt", "error"))
#: Zones of two and three parts, without a slash, in lower case, and unknown ones.
SOME_ZONES = ("Asia/Jakarta", "America/Argentina/Buenos_Aires", "Etc/GMT+5", "UTC", "america/new_york", "Mars/Phobos", "Nowhere", "Europe/Berlin", "", "Pacific/Port_Moresby")
SOME_ZONES_SQL = "[" + ", ".join(f"'{z}'" for z in SOME_ZONES) + "][(id % 10 + 1)::INT]"
query("j14_import_times", "notes", f"""
    WITH z AS (SELECT id, CASE WHEN id % 13 = 5 THEN 'soon' WHEN id % 13 = 7 THEN '2024-02-30T10:00' WHEN id % 13 = 8 THEN '2024-3-05T10:00' ELSE strftime(created_at, '%Y-%m-%dT%H:%M') END AS t, {SOME_ZONES_SQL} AS zone FROM notes),
    c AS (SELECT *, try_strptime(t, '%Y-%m-%dT%H:%M') AS local, (SELECT min(name) FROM pg_timezone_names() n WHERE lower(n.name) = lower(z.zone)) AS known FROM z)
    SELECT id, CASE WHEN NOT regexp_full_match(t, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d') OR local IS NULL THEN 'local_time' WHEN known IS NULL THEN 'timezone' WHEN (local AT TIME ZONE known) AT TIME ZONE known <> local THEN 'local_time' END AS error,
           CASE WHEN regexp_full_match(t, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d') AND (local AT TIME ZONE known) AT TIME ZONE known = local THEN (local AT TIME ZONE known) AT TIME ZONE 'UTC' END AS recorded_at FROM c
""")(
    lambda n: J.import_contexts(n.select("id", F.when(F.col("id") % 13 == 5, "soon").when(F.col("id") % 13 == 7, "2024-02-30T10:00").when(F.col("id") % 13 == 8, "2024-3-05T10:00").otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm")).alias("local_time"), F.element_at(F.array(*map(F.lit, SOME_ZONES)), (F.col("id") % 10 + 1).cast("int")).alias("timezone")), repeated="later").select("id", "error", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"))
)
query("j15_enqueue_imports", "manifests account_requests", """
    SELECT r.request_id, CASE WHEN h.audio_path IS NULL THEN CASE WHEN r.request_id = min(r.request_id) OVER (PARTITION BY r.audio_path) THEN 'insert' ELSE 'duplicate' END WHEN h.owner IS NOT DISTINCT FROM r.owner AND h.source = 'import' THEN 'existing' ELSE 'rejected' END AS action
    FROM (SELECT request_id, CAST(request_id % 400 AS VARCHAR) AS audio_path, 'owner-' || (request_id % 5) AS owner FROM account_requests) r
    LEFT JOIN (SELECT DISTINCT ON (audio_path) audio_path, owner, source FROM manifests ORDER BY audio_path, generation, job_id) h ON h.audio_path = r.audio_path
""")(lambda m, r: J.enqueue_imports(m, r.select("request_id", (F.col("request_id") % 400).cast("string").alias("audio_path"), F.concat(F.lit("owner-"), (F.col("request_id") % 5).cast("string")).alias("owner"))))
# ---- logs and chat ----
query("l1_command_traces", "log_lines", """
    SELECT r.request_id, r.command, r.logged_at AS received_at, d.outcome, d.duration_ms FROM (SELECT * FROM log_lines WHERE message = 'ipc.command.received') r
    LEFT JOIN (SELECT request_id, CASE WHEN message = 'ipc.command.failed' THEN 'failed' ELSE 'completed' END AS outcome, duration_ms FROM log_lines WHERE message <> 'ipc.command.received' AND request_id <> '-') d USING (request_id)
""")(G.command_traces)
query("l1_command_summary", "log_lines", """
    SELECT command, count(*) AS n_received, count(*) FILTER (o = 'failed') AS n_failed, count(*) FILTER (o IS NULL) AS n_unanswered, avg(ms) AS mean_ms FROM (
      SELECT r.command, CASE d.message WHEN 'ipc.command.failed' THEN 'failed' WHEN 'ipc.command.completed' THEN 'completed' END AS o, d.duration_ms AS ms FROM (SELECT * FROM log_lines WHERE message = 'ipc.command.received') r
      LEFT JOIN (SELECT * FROM log_lines WHERE message <> 'ipc.command.received' AND request_id <> '-') d USING (request_id)) GROUP BY command
""")(lambda df: G.command_summary(G.command_traces(df)))
query("l2_http_summary", "http_lines", """
    SELECT operation, host, CASE WHEN status IS NULL THEN 'none' ELSE (status // 100) || 'xx' END AS status_class, count(*) AS n_calls, count(*) FILTER (failure = 'timeout') AS n_timeout, count(*) FILTER (failure = 'connect') AS n_connect, avg(duration_ms) AS mean_ms, quantile_disc(duration_ms, 0.95) AS p95_ms
    FROM http_lines GROUP BY ALL
""")(G.http_summary)
query("l3_problems", "http_lines", "SELECT event_id, level FROM http_lines WHERE level IN ('WARN', 'ERROR')")(lambda h: G.problems(h).select("event_id", "level"))
query("l3_retain", "http_lines", "SELECT event_id FROM http_lines WHERE CAST(logged_at AS DATE) IN (SELECT DISTINCT CAST(logged_at AS DATE) AS d FROM http_lines ORDER BY d DESC LIMIT 14)")(lambda h: G.retain(h).select("event_id"))
query("l4_ai_usage", "usage_lines", """
    SELECT message->>'$.model' AS model, message->>'$.isFallback' = 'true' AS is_fallback, count(*) AS n_calls, CAST(sum(CAST(message->>'$.promptTokens' AS BIGINT)) AS BIGINT) AS prompt_tokens, CAST(sum(CAST(message->>'$.completionTokens' AS BIGINT)) AS BIGINT) AS completion_tokens,
           sum(CAST(message->>'$.estimatedCostUsd' AS DOUBLE)) AS cost_usd, CAST(sum(CAST(message->>'$.continuations' AS BIGINT)) AS BIGINT) AS continuations, CAST(sum(CAST(message->>'$.queueWaitMs' AS BIGINT)) AS BIGINT) AS queue_wait_ms FROM usage_lines GROUP BY ALL
""")(G.ai_usage)
query("l5_chat_requests", "turns", """
    SELECT t.conv_id, t.turn, 2 + count(e.turn) AS n_messages, md5('system:Be brief.' || coalesce(string_agg('|' || e.role || ':' || e.text, '' ORDER BY e.turn), '') || '|user:' || t.text) AS messages_md5
    FROM turns t LEFT JOIN turns e ON e.conv_id = t.conv_id AND e.turn < t.turn WHERE t.role = 'user' GROUP BY t.conv_id, t.turn, t.text
""")(lambda t: G.chat_requests(t, "Be brief.").select("conv_id", "turn", F.size("messages").cast("long").alias("n_messages"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("messages_md5")))
query("l6_assemble_sse", "sse turns", "SELECT conv_id * 1000 + turn AS id, role || ' ' || turn AS content, CAST(NULL AS VARCHAR) AS error FROM turns")(lambda s, _: G.assemble_sse(s))
query("l7_chat_replies", "replies turns", """
    SELECT conv_id * 1000 + turn AS id, CASE WHEN ok THEN 'c' || turn END AS content, CASE WHEN ok THEN fin END AS finish_reason, CASE WHEN ok THEN length(text) ELSE 0 END AS prompt_tokens, CASE WHEN ok THEN turn ELSE 0 END AS completion_tokens, ok AND fin = 'length' AS is_truncated, CASE WHEN NOT ok THEN 'no choice' END AS error
    FROM (SELECT *, turn % 5 <> 4 AS ok, CASE WHEN conv_id % 3 = 0 THEN 'length' ELSE 'stop' END AS fin FROM turns)
""")(lambda r, _: G.parse_replies(r))
query("l8_model_limits", "connections", """
    SELECT model, CASE WHEN n % 4 = 0 THEN 32768 ELSE 1000 * n + 1000 END AS context_tokens, CASE WHEN n % 4 = 0 THEN 8192 ELSE least(coalesce(CASE WHEN n % 3 <> 0 THEN n * 900 END, 16384), 16384) END AS output_tokens
    FROM (SELECT DISTINCT provider AS model, CAST(replace(provider, 'provider-', '') AS BIGINT) AS n FROM connections)
""")(lambda c: G.model_limits(
    c.select(F.col("provider").alias("p"), F.regexp_replace("provider", "provider-", "").cast("long").alias("n")).distinct().where("n % 4 <> 0").select(F.concat(F.lit('{"data":[{"id":"'), "p", F.lit('","context_length":'), (F.col("n") * 1000 + 1000).cast("string"), F.lit(',"top_provider":{"max_completion_tokens":'), F.when(F.col("n") % 3 != 0, (F.col("n") * 900).cast("string")).otherwise("null"), F.lit("}}]}")).alias("json")),
    c.select(F.col("provider").alias("model")).distinct(),
))
# ---- capture quality ----
query("q1_pair_tracks", "quality_windows", "SELECT recording_id, chunk_index, mic_bytes, CASE WHEN chunk_index % 3 = 0 THEN 0 ELSE system_bytes END AS system_bytes FROM quality_windows WHERE mic_bytes > 0 OR chunk_index % 3 <> 0 AND system_bytes > 0")(
    lambda w: Q.pair_tracks(w.where("mic_bytes > 0").withColumn("bytes", F.col("mic_bytes")), w.where("chunk_index % 3 <> 0").withColumn("bytes", F.col("system_bytes")))
)
query("q2_start_trims", "quality_windows", """
    WITH t AS (SELECT recording_id, chunk_index, 'microphone' AS track, mic_bytes AS bytes, 1 AS channels, 700 AS off FROM quality_windows UNION ALL SELECT recording_id, chunk_index, 'system', system_bytes, 2, 0 FROM quality_windows)
    SELECT recording_id, chunk_index, track, CAST(least(bytes, greatest(0, off * 48000 // 1000 * channels * 2 - coalesce(sum(bytes) OVER (PARTITION BY recording_id, track ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS trim_bytes FROM t
""")(lambda w: Q.start_trims(
    w.select("recording_id", "chunk_index", F.explode(F.array(*[F.struct(F.lit(t).alias("track"), F.col(b).alias("bytes"), F.lit(n).alias("channels")) for t, b, n in (("microphone", "mic_bytes", 1), ("system", "system_bytes", 2))])).alias("s")).select("recording_id", "chunk_index", "s.*", F.lit(48000).alias("sample_rate")),
    w.select("recording_id", F.explode(F.array(F.struct(F.lit("microphone").alias("track"), F.lit(100).alias("start_ms")), F.struct(F.lit("system").alias("track"), F.lit(800).alias("start_ms")))).alias("s")).select("recording_id", "s.*").distinct(),
).select("recording_id", "chunk_index", "track", "trim_bytes"))
query("q3_sample_levels", "samples", """
    SELECT recording_id, chunk_index, round(avg(CASE WHEN abs(sample) >= 32700 THEN 1 ELSE 0 END), 6) AS clipped_ratio, round(greatest(CASE WHEN sqrt(avg((sample / 32768.0) ** 2)) > 0 THEN 20 * log10(sqrt(avg((sample / 32768.0) ** 2))) ELSE -120 END, -120), 6) AS rms_dbfs FROM samples GROUP BY ALL
""")(lambda s: Q.sample_levels(s).select("recording_id", "chunk_index", F.round("clipped_ratio", 6).alias("clipped_ratio"), F.round("rms_dbfs", 6).alias("rms_dbfs")))
WINDOWS = "SELECT *, chunk_index * CAST(180000 AS BIGINT) AS start_ms, chunk_index * CAST(180000 AS BIGINT) + greatest(mic_bytes * 1000 // 96000, system_bytes * 1000 // 192000) AS end_ms FROM quality_windows"
timed = lambda w: Q.quality_windows(w.withColumns({"mic_rate": F.lit(48000), "mic_channels": F.lit(1), "system_rate": F.lit(48000), "system_channels": F.lit(2)}))
query("q4_quality_windows", "quality_windows", f"SELECT recording_id, chunk_index, start_ms, end_ms FROM ({WINDOWS})")(lambda w: timed(w).select("recording_id", "chunk_index", "start_ms", "end_ms"))
WARN = """SELECT recording_id, chunk_index, warning FROM (
    SELECT recording_id, chunk_index, CASE WHEN mic_clipped_ratio > 0.03::FLOAT THEN format('mic_clipping: chunk {} has {:.2f}% near-full-scale samples', chunk_index, mic_clipped_ratio::DOUBLE * 100) WHEN mic_clipped_ratio > 0.005::FLOAT THEN format('mic_clipping_advisory: chunk {} has {:.2f}% near-full-scale samples', chunk_index, mic_clipped_ratio::DOUBLE * 100) END AS warning FROM quality_windows
    UNION ALL SELECT recording_id, chunk_index, CASE WHEN mixed_clipped_ratio > 0.01::FLOAT THEN format('mixed_clipping: chunk {} has {:.2f}% near-full-scale output samples', chunk_index, mixed_clipped_ratio::DOUBLE * 100) END FROM quality_windows
    UNION ALL SELECT recording_id, chunk_index, CASE WHEN mic_rms_dbfs > -60 AND system_rms_dbfs > -80 AND abs(mic_rms_dbfs - system_rms_dbfs) > 24 THEN format('track_imbalance: chunk {} microphone/system RMS differs by {:.1f}dB ({:.1f} vs {:.1f}dBFS)', chunk_index, abs(mic_rms_dbfs - system_rms_dbfs)::DOUBLE, mic_rms_dbfs::DOUBLE, system_rms_dbfs::DOUBLE) END FROM quality_windows) WHERE warning IS NOT NULL"""
query("q5_window_warnings", "quality_windows", WARN)(Q.window_warnings)
query("q6_overrun_warnings", "overruns", """
    SELECT recording_id, ms AS dropped_ms, CASE WHEN ms > 250 THEN 'mic_overrun' ELSE 'mic_overrun_advisory' END || ': ' || dropped_bytes || ' input bytes (~' || ms || 'ms) were dropped before durable capture' AS warning
    FROM (SELECT *, CASE WHEN sample_rate = 0 THEN CAST(0 AS BIGINT) ELSE dropped_bytes * 1000 // (sample_rate * channels * 2) END AS ms FROM overruns WHERE dropped_bytes > 0)
""")(Q.overrun_warnings)
query("q7_mic_gaps", "quality_windows", f"""
    SELECT recording_id, chunk_index, CASE WHEN any_mic AND chunk_index = last AND end_ms - start_ms <= 5000 THEN 'mic_missing_advisory' ELSE 'mic_missing' END || ': chunk ' || chunk_index || ' has no microphone samples' AS warning
    FROM (SELECT *, max(chunk_index) OVER (PARTITION BY recording_id) AS last, bool_or(mic_bytes > 0) OVER (PARTITION BY recording_id) AS any_mic FROM ({WINDOWS})) WHERE mic_bytes = 0
""")(lambda w: Q.mic_gaps(timed(w)))
query("q8_capture_review", "quality_windows", f"SELECT recording_id, count(*) AS n_warnings, bool_or(NOT (warning LIKE 'track_imbalance:%' OR warning LIKE 'mic_clipping_advisory:%')) AS requires_review FROM ({WARN}) GROUP BY 1")(lambda w: Q.capture_review(Q.window_warnings(w)))
query("q9_capture_guidance", "quality_windows", f"""
    SELECT recording_id, CASE WHEN a < b THEN 'Lower the microphone gain. Lower the output volume.' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'Lower the output volume. Lower the microphone gain.' WHEN a IS NOT NULL THEN 'Lower the microphone gain.' WHEN b IS NOT NULL THEN 'Lower the output volume.' ELSE 'Check the recording before you use its notes.' END AS guidance
    FROM (SELECT recording_id, min(chunk_index * 2) FILTER (starts_with(warning, 'mic_clipping:')) AS a, min(chunk_index * 2 + 1) FILTER (starts_with(warning, 'mixed_clipping:')) AS b FROM ({WARN}) GROUP BY 1)
""")(lambda w: Q.capture_guidance(Q.window_warnings(w).groupBy("recording_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "warning"))).alias("w")).select("recording_id", F.transform("w", lambda x: x["warning"]).alias("warnings"))))
query("q11_leveler_gain", "loudness", """
    WITH RECURSIVE w AS (SELECT recording_id, track, chunk_index, row_number() OVER (PARTITION BY recording_id, track ORDER BY chunk_index) AS k,
        CASE WHEN lufs IS NULL THEN NULL WHEN track = 'microphone' THEN 10 ** (least(12.0, greatest(-18.0, -22.0 - lufs)) / 20) ELSE 10 ** (least(18.0, greatest(-12.0, -19.0 - lufs)) / 20) END AS wanted FROM loudness),
      g AS (SELECT recording_id, track, chunk_index, k, CASE WHEN wanted IS NULL THEN s ELSE 0.4 * s + 0.6 * wanted END AS gain FROM (SELECT *, 10 ** (CASE WHEN track = 'microphone' THEN -9.0 ELSE 3.0 END / 20) AS s FROM w WHERE k = 1)
        UNION ALL SELECT w.recording_id, w.track, w.chunk_index, w.k, CASE WHEN w.wanted IS NULL THEN g.gain ELSE 0.4 * g.gain + 0.6 * w.wanted END FROM g JOIN w ON w.recording_id = g.recording_id AND w.track = g.track AND w.k = g.k + 1)
    SELECT recording_id, track, chunk_index, round(gain, 6) AS gain FROM g
""".replace("WITH RECURSIVE w AS", "WITH w AS"))(lambda x: Q.leveler_gain(x).withColumn("gain", F.round("gain", 6)))
ORACLES["q11_leveler_gain"] = ORACLES["q11_leveler_gain"].replace("WITH ", "WITH RECURSIVE ", 1)
query("q12_media_facts", "files", r"""
    SELECT file_id, bytes * 1000 // 24000 AS duration_ms, CASE file_id % 5 WHEN 0 THEN 'image' WHEN 2 THEN 'document' WHEN 4 THEN 'document' END AS kind, regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '[^A-Za-z0-9._-]', '_', 'g') AS safe_name, sha256(content) AS sha256 FROM files
""")(Q.media_facts)
query("q13_corpus_scorecard", "overruns quality_windows loudness", """
    SELECT n_recordings, hours, over_30, over_60, longest_min, n_windows, over_12_db, clipping, with_windows, n_attempts, without_run, without_words FROM
      (SELECT count(*) AS n_recordings, round(sum(dropped_bytes * 90) / 3600000, 2) AS hours, count(*) FILTER (dropped_bytes * 90 > 1800000) AS over_30, count(*) FILTER (dropped_bytes * 90 > 3600000) AS over_60, round(max(dropped_bytes * 90) / 60000, 1) AS longest_min FROM overruns),
      (SELECT count(*) AS n_windows, count(*) FILTER (abs(mic_rms_dbfs - system_rms_dbfs) > 12) AS over_12_db, count(*) FILTER (mic_clipped_ratio >= 0.005::FLOAT) AS clipping, count(DISTINCT recording_id) AS with_windows FROM quality_windows),
      (SELECT count(*) AS n_attempts, count(*) FILTER (lufs IS NULL) AS without_run, count(*) FILTER (track <> 'system') AS without_words FROM loudness)
""")(lambda o, w, x: Q.corpus_scorecard(o.withColumn("duration_ms", F.col("dropped_bytes") * 90), w, x.select(F.col("lufs").alias("run_id"), (F.col("track") == "system").alias("has_words"))))
