"""Processing jobs: validation, retries, queues, rerun plans, outcomes, routes, state checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minuteworks.functions.quantiles import with_percentiles
from minuteworks.functions.text import strip
from minuteworks.functions.zones import ZONE, with_zone

MAX_ATTEMPTS = 4
AI_VERSION = 16
TRANSCRIPTION_VERSION = 3
# Messages of failures that pass by themselves.
TRANSIENT = (
    "transcription request failed",
    "chat request failed after retries",
    "all configured chat models failed",
    "error sending request",
    "failed to fetch",
    "model busy",
    "429",
    "408 request timeout",
    "500 internal server error",
    "502 bad gateway",
    "503 service unavailable",
    "504 gateway timeout",
    "timed out",
    "timeout",
    "network",
    "connection",
)
IN_FLIGHT = ("importing", "transcribing", "extracting", "synthesizing", "saving")
# The state changes that a recording may make; a state may also stay.
TRANSITIONS = (
    ("created", "capturing"),
    ("capturing", "finalizing_capture"),
    ("finalizing_capture", "transcribing"),
    ("transcribing", "transcript_draft"),
    ("transcribing", "transcript_review_required"),
    ("transcribing", "degraded"),
    ("transcribing", "failed"),
    ("transcript_draft", "generating_note"),
    ("transcript_draft", "transcript_review_required"),
    ("transcript_review_required", "generating_note"),
    ("transcript_review_required", "failed"),
    ("generating_note", "note_review_required"),
    ("generating_note", "ready"),
    ("generating_note", "degraded"),
    ("generating_note", "failed"),
    ("note_review_required", "ready"),
    ("note_review_required", "generating_note"),
    ("note_review_required", "failed"),
    ("degraded", "transcribing"),
    ("degraded", "generating_note"),
    ("degraded", "failed"),
)


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def attempts() -> Column:
    return F.coalesce("attempt", F.lit(0))


def validate_manifests(df: DataFrame) -> DataFrame:
    """``reject_reason``: the first field that makes a manifest unusable, else null.

    Version 1 needs a job, an audio path and a status.  Version 2 (columns ``recording_id``, ``directory``,
    ``language``, ``timezone``; absent ones count as null) needs a language and a time zone, and lies in the
    directory of its own recording."""
    have = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")
    v1, v2 = F.col("schema_version") == 1, F.col("schema_version") == 2
    reason = F.when(~F.coalesce(v1 | v2, F.lit(False)), "schema_version")
    for name in ("job_id", "audio_path", "status"):
        reason = reason.when(v1 & blank(have(name)), name)
    reason = reason.when(v2 & blank(have("recording_id")), "recording_id").when(v2 & (blank(have("language")) | blank(have("timezone"))), "language_or_timezone")
    reason = reason.when(v2 & have("directory").isNotNull() & (have("directory") != have("recording_id")), "directory")
    return df.withColumn("reject_reason", reason.when(F.col("generation") < 0, "generation"))


def is_transient(error: Column) -> Column:
    lower = F.lower(error)
    found = F.lit(False)
    for pattern in TRANSIENT:
        found = found | lower.contains(pattern)
    return F.coalesce(found, F.lit(False))


def classify_failures(jobs: DataFrame) -> DataFrame:
    kind = F.when(attempts() >= MAX_ATTEMPTS, "terminal").when(is_transient(F.col("error")), "retryable").otherwise("terminal")
    return jobs.withColumn("failure_kind", F.when(F.col("status") == "failed", kind))


def schedule_retries(jobs: DataFrame, now) -> DataFrame:
    """``retry_minutes`` and ``retry_at`` of retryable failures, and ``upload_backoff_s``."""
    minutes = F.least(F.pow(F.lit(2), F.greatest(F.lit(0), F.coalesce("attempt", F.lit(1)) - 1)), F.lit(16)).cast("int")
    retry = classify_failures(jobs).withColumn("retry_minutes", F.when(F.col("failure_kind") == "retryable", minutes))
    at = F.lit(now) + F.make_dt_interval(mins=F.col("retry_minutes"))
    return retry.withColumns({"retry_at": at, "upload_backoff_s": F.least(2 * F.pow(F.lit(2), attempts()), F.lit(60)).cast("int")})


def is_recoverable(now) -> Column:
    """Over classified jobs."""
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= F.lit(now))
    failed = F.coalesce(F.col("failure_kind") == "retryable", F.lit(False)) & due
    running = F.coalesce("repairing_fallback", F.lit(False)) | F.coalesce("upgrading_ai", F.lit(False)) | F.col("status").isin(*IN_FLIGHT)
    return F.when(attempts() >= MAX_ATTEMPTS, False).when(F.col("status").isin("complete", "partial"), False).when(F.col("status") == "failed", failed).otherwise(running)


def recoverable(jobs: DataFrame, now) -> DataFrame:
    return classify_failures(jobs).where(is_recoverable(now))


def import_queue(jobs: DataFrame, now) -> DataFrame:
    """Recoverable imports with their place among their owner's, oldest update first."""
    place = F.row_number().over(Window.partitionBy("owner").orderBy("updated_at", "job_id"))
    return recoverable(jobs.where((F.col("source") == "import") & F.col("owner").isNotNull()), now).withColumn("place", place)


def recording_queue(jobs: DataFrame, user: str, now) -> DataFrame:
    """Recoverable recordings of the owner or of nobody."""
    mine = jobs.where((F.col("source") != "import") & (F.col("owner").isNull() | (F.col("owner") == user)))
    return recoverable(mine, now)


def plan_reruns(jobs: DataFrame, force: bool = False) -> DataFrame:
    """``plan``: forced upgrade, repair, upgrade or none (first match), ``drops_sections``, and
    ``refresh_transcript``."""
    held = F.col("saved_note_id").isNotNull() & (F.coalesce("fallback_version", F.lit(0)) < 1)
    repair = ((F.col("status") == "partial") | F.coalesce("repairing_fallback", F.lit(False))) & held
    upgrade = (F.col("status") == "partial") & (F.coalesce("enhancement_mode", F.lit("")) == "extractive-fallback") & (F.coalesce("ai_pipeline_version", F.lit(0)) < AI_VERSION)
    plan = F.when(F.lit(force), "forced").when(repair, "repair").when(upgrade, "upgrade").otherwise("none")
    refresh = ~blank(F.col("transcript")) & (F.coalesce("transcription_pipeline_version", F.lit(0)) < TRANSCRIPTION_VERSION)
    return jobs.withColumns({"plan": plan, "refresh_transcript": refresh}).withColumn("drops_sections", F.col("plan").isin("forced", "upgrade"))


#: What a job says that finished with a fallback and no message of its own.
FALLBACK_NOTICE = "Some transcript sections were kept as they were"


def apply_outcomes(jobs: DataFrame, outcomes: DataFrame, now) -> DataFrame:
    """Jobs after one outcome each: ``begin``, ``retry_by_user``, ``pause``, ``failure``, ``finish``,
    ``no_speech`` (the transcript is blank: complete, without a note) or ``accept``; jobs without one are
    unchanged.  A failure leaves its kind and, if it may pass, when it is tried again; all other outcomes
    clear both."""
    o = F.col("outcome")
    df = jobs.join(outcomes, "job_id", "left")
    attempt = F.when(o == "begin", attempts() + 1).when(o == "retry_by_user", 1).when(o == "pause", F.greatest(F.lit(0), F.coalesce("attempt", F.lit(1)) - 1)).otherwise(F.col("attempt"))
    finished = F.when(F.col("needs_review"), "partial").otherwise("complete")
    prepared = F.when((F.col("source") == "import") & ~F.coalesce("import_prepared", F.lit(True)), "importing").otherwise("transcribing")
    status = F.when(o == "failure", "failed").when(o == "finish", finished).when(o.isin("accept", "no_speech"), "complete").when(o == "pause", prepared).otherwise(F.col("status"))
    mode = F.when(o == "finish", F.when(F.col("used_fallback"), "extractive-fallback").when(F.col("degraded"), "hybrid").otherwise("ai")).when(o == "accept", "ai").otherwise(F.col("enhancement_mode"))
    version = F.when(o.isin("finish", "accept"), AI_VERSION).otherwise(F.col("ai_pipeline_version"))
    fallback = F.when((o == "finish") & F.col("used_fallback"), 1).when(o == "accept", None).otherwise(F.col("fallback_version"))
    partial = F.coalesce("outcome_error", F.lit(FALLBACK_NOTICE))
    error = F.when(o == "failure", F.col("outcome_error")).when(o == "finish", F.when(F.col("needs_review"), partial)).when(o.isin("accept", "pause", "no_speech"), None).otherwise(F.col("error"))
    tried = F.coalesce("attempt", F.lit(1))
    new_kind = F.when((tried < MAX_ATTEMPTS) & is_transient(F.col("outcome_error")), "retryable").otherwise("terminal")
    kind = F.when(o == "failure", new_kind).when(o.isNull(), F.col("failure_kind"))
    later = F.lit(now) + F.make_dt_interval(mins=F.least(F.pow(F.lit(2), F.greatest(F.lit(0), tried - 1)), F.lit(16)).cast("int"))
    next_at = F.when((o == "failure") & (new_kind == "retryable"), later).when(o.isNull(), F.col("next_attempt_at"))
    silent = o == "no_speech"
    heard = F.when(silent, F.lit(TRANSCRIPTION_VERSION)).otherwise(F.col("transcription_pipeline_version"))
    return df.select(
        "job_id", attempt.cast("int").alias("attempt"), status.alias("status"), mode.alias("enhancement_mode"), version.cast("int").alias("ai_pipeline_version"), fallback.cast("int").alias("fallback_version"), error.alias("error"),
        kind.alias("failure_kind"), next_at.alias("next_attempt_at"), F.when(silent, "").otherwise(F.col("transcript")).alias("transcript"), heard.cast("int").alias("transcription_pipeline_version"),
    )


def note_routes(notes: DataFrame, jobs: DataFrame, recording_tag: str = "recording") -> DataFrame:
    """Where opening a note leads: ``recording`` by its newest job with a transcript, else
    ``retry_processing`` by its newest job, else by the kind of note.  Aggregates, no sorts."""
    best = lambda df, name: df.groupBy("note_id").agg(F.max(F.struct("updated_at", "job_id")).alias(name))
    saved = jobs.where(F.col("saved_note_id").isNotNull()).withColumnRenamed("saved_note_id", "note_id")
    failed = jobs.where(F.col("failure_note_id").isNotNull()).select(F.col("failure_note_id").alias("note_id"), "updated_at", "job_id")
    with_text = best(saved.where(~blank(F.col("transcript"))), "told")
    any_job = best(saved.select("note_id", "updated_at", "job_id").union(failed), "tried")
    rows = notes.select(F.col("id").alias("note_id"), "is_recording").join(with_text, "note_id", "left").join(any_job, "note_id", "left")
    route = F.when(F.col("told").isNotNull(), "recording").when(F.col("tried").isNotNull(), "retry_processing").when(F.col("is_recording"), "missing_recording_source").otherwise("note")
    return rows.select("note_id", route.alias("route"), F.coalesce("told.job_id", "tried.job_id").alias("job_id"))


def publishable(jobs: DataFrame) -> DataFrame:
    flags = ["processing_degraded", "has_failed_section", "transcript_requires_review", "note_was_edited"]
    clean = F.lit(True)
    for f in flags:
        clean = clean & ~F.coalesce(f, F.lit(False))
    return jobs.withColumn("publish", clean)


def illegal_transitions(state_log: DataFrame) -> DataFrame:
    """Consecutive states of a recording that are no allowed change."""
    before = F.lag("state").over(Window.partitionBy("recording_id").orderBy("generation"))
    steps = state_log.withColumn("from_state", before).where("from_state IS NOT NULL AND from_state <> state")
    allowed = steps.sparkSession.createDataFrame(TRANSITIONS, "a string, b string")
    steps = steps.withColumnRenamed("state", "to_state")
    return steps.join(F.broadcast(allowed), (F.col("from_state") == F.col("a")) & (F.col("to_state") == F.col("b")), "left_anti").select("recording_id", "generation", "from_state", "to_state")


def stage_timings(timings: DataFrame) -> DataFrame:
    """Per stage, status and mode: count, mean, median, 95th percentile (both exact) and maximum of
    ``timings_ms``."""
    rows = timings.select("status", "enhancement_mode", F.explode("timings_ms").alias("stage", "ms"))
    by = ["stage", "status", "enhancement_mode"]
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"))
    found = with_percentiles(sums, rows, by, "ms", [0.5, 0.95])
    return found.select(*by, "n", "mean_ms", F.col("percentiles")[0].alias("p50_ms"), F.col("percentiles")[1].alias("p95_ms"), "max_ms")


# For each stage, buckets and the patterns of their messages; the first match wins.
ERROR_BUCKETS = {
    "import": (
        ("source_missing", r"(?i)no such file|not found|original imported file path is missing"),
        ("not_saved", r"(?i)disk full|no space|permission denied|hard link|hard_link|publish"),
        ("bad_audio", r"(?i)decode|codec|corrupt|truncat|invalid|unsupported|empty|audio.*limit"),
    ),
    "processing": (
        ("no_speech", r"(?i)no speech|no usable text|transcription returned empty"),
        ("credentials", r"(?i)api.?key|not configured|unauthorized|status 401|status 403"),
        ("network", r"(?i)network|timed? out|timeout|connection|dns|request failed"),
    ),
    "screenshot": (("screen_permission", r"(?i)screen recording|privacy.*security|could not capture|permission"),),
}


def error_bucket(jobs: DataFrame, stage: Column | str | None = None, buckets=ERROR_BUCKETS) -> DataFrame:
    """``bucket``: a class of message for the user, never the raw text; null without an error.

    ``stage`` (a column or the name of one; without it all rows are in ``processing``) tells whose
    patterns count.  What matches none, and every error of another stage, is ``<stage>_failed``.
    """
    at = F.lit("processing") if stage is None else F.col(stage) if isinstance(stage, str) else stage
    error = F.regexp_replace("error", r"(?i)^Error:\s*", "")
    found = F.when(blank(F.col("error")), None)
    for name, patterns in buckets.items():
        for bucket, pattern in patterns:
            found = found.when((at == name) & error.rlike(pattern), bucket)
    return jobs.withColumn("bucket", found.otherwise(F.concat(at, F.lit("_failed"))))


def import_contexts(df: DataFrame, repeated: str = "earlier") -> DataFrame:
    """``recorded_at`` (UTC) of a local time ``YYYY-MM-DDTHH:MM`` in the row's zone, or ``error``.
    Times that do not exist, by the calendar or the zone's clock, are rejected; unknown zones too.  Of a time
    that the clock shows twice, as it is set back, the ``earlier`` or the ``later`` one is meant."""
    local = F.try_to_timestamp("local_time", F.lit("yyyy-MM-dd'T'HH:mm"))
    df, zone = with_zone(df, F.col("timezone"))
    utc = F.to_utc_timestamp(local, zone)
    if repeated == "later":
        # by the offset of a day later: no clock is set back by more
        day = F.expr("INTERVAL 1 DAY")
        again = local - (F.from_utc_timestamp(utc + day, zone) - (utc + day))
        utc = F.when((again > utc) & (F.from_utc_timestamp(again, zone) == local), again).otherwise(utc)
    shape = F.col("local_time").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d$")
    error = F.when(~shape | local.isNull(), "local_time").when(zone.isNull(), "timezone").when(F.from_utc_timestamp(utc, zone) != local, "local_time")
    return df.withColumns({"error": error, "recorded_at": F.when(error.isNull(), utc)}).drop(ZONE)


def enqueue_imports(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """``request_id, action``: one job per audio path; ``existing`` for the same owner and source,
    ``rejected`` for another, ``insert`` for the batch's first request and ``duplicate`` for others."""
    held = jobs.groupBy("audio_path").agg(F.min_by(F.struct("owner", "source"), F.struct("generation", "job_id")).alias("held"))
    first = requests.groupBy("audio_path").agg(F.min("request_id").alias("first"))
    rows = requests.join(held, "audio_path", "left").join(first, "audio_path")
    same = F.col("held.owner").eqNullSafe(F.col("owner")) & F.col("held.source").eqNullSafe(F.lit("import"))
    action = F.when(F.col("held").isNotNull(), F.when(same, "existing").otherwise("rejected")).when(F.col("request_id") == F.col("first"), "insert").otherwise("duplicate")
    return rows.select("request_id", action.alias("action"))


def apply_generations(current: DataFrame, writes: DataFrame) -> DataFrame:
    """``job_id, seq, outcome`` of writes in order of ``seq`` against stored generations (``current``: job_id,
    generation; a job without a row is absent, which is not the same as generation 0).

    Version 1: the first write of an absent job has to expect 0 and stores 0; every other one has to expect
    what is stored and raises it by one; a missing ``expected`` is 0; the rest are ``conflict``.  Version 2
    (column ``version``, with ``next``, the generation that is written): a write to an absent job is
    ``missing``, and one whose next is not its expected plus one is ``invalid``.

    Each accepted write needs its predecessor accepted, so a job's writes are one row, walked once.
    """

    @F.pandas_udf("array<string>")
    def walked(expected: pd.Series, following: pd.Series, version: pd.Series, stored: pd.Series) -> pd.Series:
        return pd.Series([in_turn(*row) for row in zip(expected, following, version, stored)], dtype=object)

    have = lambda name, default: F.coalesce(F.col(name), default) if name in writes.columns else default
    one = F.struct("seq", F.coalesce("expected", F.lit(0)).cast("long").alias("expected"), have("next", F.lit(-1)).cast("long").alias("next"), have("version", F.lit(1)).cast("int").alias("version"))
    w = writes.groupBy("job_id").agg(F.sort_array(F.collect_list(one)).alias("w"))
    rows = w.join(current.select("job_id", F.col("generation").cast("long").alias("stored")), "job_id", "left")
    every = lambda name: F.transform("w", lambda x: x[name])
    rows = rows.select("job_id", every("seq").alias("seq"), walked(every("expected"), every("next"), every("version"), F.coalesce("stored", F.lit(ABSENT))).alias("outcome"))
    return rows.select("job_id", F.explode(F.arrays_zip("seq", "outcome")).alias("x")).select("job_id", "x.seq", "x.outcome")


ABSENT = -1  # stands for a job that is not stored, as generations are never negative


def in_turn(expected, following, version, stored: int) -> list[str]:
    out = []
    for e, n, v in zip(expected, following, version):
        if v == 2 and stored == ABSENT:
            out.append("missing")
        elif e != max(stored, 0):
            out.append("conflict")
        elif v == 2 and n != e + 1:
            out.append("invalid")
        else:
            out.append("accepted")
            stored += 1
    return out


def reset_imports(jobs: DataFrame) -> DataFrame:
    """Manual reset: imports that failed, or ran out of attempts in flight, start again with none used and
    no error; ``reset`` tells which.  Other jobs are unchanged."""
    exhausted = (attempts() >= MAX_ATTEMPTS) & F.col("status").isin(*IN_FLIGHT)
    reset = F.coalesce((F.col("source") == "import") & ((F.col("status") == "failed") | exhausted), F.lit(False))
    begin = F.when(F.coalesce("import_prepared", F.lit(True)), "transcribing").otherwise("importing")
    values = {"status": begin, "attempt": F.lit(0), "error": F.lit(None), "failure_kind": F.lit(None), "next_attempt_at": F.lit(None)}
    kinds = dict(jobs.dtypes)
    return jobs.withColumn("reset", reset).withColumns({n: F.when(F.col("reset"), v.cast(kinds[n])).otherwise(F.col(n)) for n, v in values.items() if n in kinds})
