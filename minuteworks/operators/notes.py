"""Notes: projections, validation, idempotent inserts, versioned patches, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minuteworks.functions.text import strip

INTERNAL = "internal-"


def active_notes(notes: DataFrame, user: str | None = None) -> DataFrame:
    """Notes that are not deleted, of one user if given; newest first is the caller's sort."""
    kept = notes.where(~F.col("is_deleted"))
    return kept if user is None else kept.where(F.col("user_id") == user)


def visible(tags: Column, prefix: str = INTERNAL) -> Column:
    return F.filter(tags, lambda t: ~t.startswith(prefix))


def visible_tags(notes: DataFrame, prefix: str = INTERNAL) -> DataFrame:
    return notes.withColumn("tags", visible(F.col("tags"), prefix))


def decode_tag_metadata(notes: DataFrame, prefix: str = INTERNAL) -> DataFrame:
    """``recorded_at`` (UTC, null if unreadable) and ``recording_timezone`` of the first such tags."""

    def first(kind: str) -> Column:
        start = f"{prefix}{kind}:"
        found = F.filter("tags", lambda t: t.startswith(start))
        return F.substr(F.try_element_at(found, F.lit(1)), F.lit(len(start) + 1))

    return notes.withColumns({"recorded_at": F.try_to_timestamp(first("recorded-at")), "recording_timezone": first("timezone")})


def merged_tags(existing: Column, requested: Column, prefix: str = INTERNAL) -> Column:
    """Requested public tags as they are, then internal tags that are not among them."""
    public = visible(requested, prefix)
    internal = F.filter(F.coalesce(existing, F.array().cast("array<string>")), lambda t: t.startswith(prefix) & ~F.array_contains(public, t))
    return F.when(requested.isNotNull(), F.concat(public, internal))


def validate_titles(df: DataFrame, most: int = 240) -> DataFrame:
    """``title`` trimmed and ``title_error``: ``empty``, ``too_long`` or null; a null title passes."""
    title = strip("title")
    error = F.when(F.length(title) == 0, "empty").when(F.length(title) > most, "too_long")
    return df.withColumn("title_error", error).withColumn("title", title)


def validate_note_requests(df: DataFrame) -> DataFrame:
    """``request_error``: the first of bad job id, time zone or recording time."""
    job, zone = strip("job_id"), F.col("timezone")
    bad_job = (F.octet_length(job) < 1) | (F.octet_length(job) > 128)
    bad_zone = (F.octet_length(zone) < 1) | (F.octet_length(zone) > 64) | zone.rlike(r"\p{Cntrl}")
    bad_time = ~F.col("recorded_at").rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$") | F.try_to_timestamp("recorded_at").isNull()
    return df.withColumn("request_error", F.when(bad_job, "job_id").when(bad_zone, "timezone").when(bad_time, "recorded_at"))


def insert_once(notes: DataFrame, requests: DataFrame, prefix: str = INTERNAL) -> DataFrame:
    """A row per request: ``request_id, user_id, job_id, note_id, action``.

    A note of the user that already carries the job's tag, deleted or not, is ``existing`` (the lowest
    id); else the first request of the batch is ``insert`` and later ones are ``duplicate``.
    """
    tag = F.concat(F.lit(f"{prefix}job:"), strip("job_id"))
    tagged = notes.select("user_id", "id", F.explode("tags").alias("tag")).where(F.col("tag").startswith(f"{prefix}job:"))
    held = tagged.groupBy("user_id", "tag").agg(F.min("id").alias("note_id"))
    firsts = requests.groupBy("user_id", strip("job_id").alias("job_key")).agg(F.min("request_id").alias("first"))
    named = requests.withColumn("tag", tag).withColumn("job_key", strip("job_id")).join(held, ["user_id", "tag"], "left").join(firsts, ["user_id", "job_key"])
    action = F.when(F.col("note_id").isNotNull(), "existing").when(F.col("request_id") == F.col("first"), "insert").otherwise("duplicate")
    return named.select("request_id", "user_id", F.col("job_key").alias("job_id"), "note_id", action.alias("action"))


def patch_notes(notes: DataFrame, patches: DataFrame, fields=("title", "content", "is_favorite"), prefix: str = INTERNAL) -> DataFrame:
    """A row per patch with ``outcome`` (``updated``, ``conflict``, ``not_found``) and the fields after it."""
    p, n = patches.alias("p"), notes.where(~F.col("is_deleted")).alias("n")
    both = p.join(n, (F.col("p.id") == F.col("n.id")) & (F.col("p.user_id") == F.col("n.user_id")), "left")
    stale = F.col("p.expected_updated_at").isNotNull() & (F.col("p.expected_updated_at") != F.col("n.updated_at"))
    outcome = F.when(F.col("n.id").isNull(), "not_found").when(stale, "conflict").otherwise("updated")
    done = outcome == "updated"
    new = {f: F.when(done, F.coalesce(f"p.{f}", f"n.{f}")).otherwise(F.col(f"n.{f}")) for f in fields}
    tags = F.when(done & F.col("p.tags").isNotNull(), merged_tags(F.col("n.tags"), F.col("p.tags"), prefix)).otherwise(F.col("n.tags"))
    return both.select("p.id", "p.user_id", outcome.alias("outcome"), *(c.alias(f) for f, c in new.items()), tags.alias("tags"))


def soft_delete(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``df`` with ``is_deleted`` set for rows whose key is in ``keys``."""
    marks = keys.select(*on).distinct().withColumn("_hit", F.lit(True))
    return df.join(marks, on, "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_hit", F.lit(False))).drop("_hit")


def toggle_favorite(notes: DataFrame, keys: DataFrame) -> DataFrame:
    """A row per key: ``id, user_id, is_favorite`` after the flip; null where no note is there."""
    live = notes.where(~F.col("is_deleted")).select("id", "user_id", (~F.col("is_favorite")).alias("is_favorite"))
    return keys.join(live, ["id", "user_id"], "left")


def search_notes(notes: DataFrame, query: str, favorite_only: bool = False) -> DataFrame:
    """Unarchived notes whose title, content or a tag contains the trimmed lower-case query."""
    wanted = query.strip().lower()
    live = notes.where(~F.col("is_archived") & ~F.col("is_deleted"))
    if favorite_only:
        live = live.where("is_favorite")
    text = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains(wanted)
    return live.where(text(F.col("title")) | text(F.col("content")) | F.coalesce(F.exists("tags", lambda t: F.lower(t).contains(wanted)), F.lit(False)))


def search_totals(notes: DataFrame, query: str, by: str = "user_id") -> DataFrame:
    """Matched and unarchived notes by user."""
    live = notes.where(~F.col("is_archived") & ~F.col("is_deleted")).groupBy(by).agg(F.count(F.lit(1)).alias("n_unarchived"))
    hits = search_notes(notes, query).groupBy(by).agg(F.count(F.lit(1)).alias("n_matched"))
    return live.join(hits, by, "left").select(by, "n_unarchived", F.coalesce("n_matched", F.lit(0)).alias("n_matched"))


def ranked_search(df: DataFrame, query: str, label: str, keywords: str, order: str, k: int) -> DataFrame:
    """The best ``k`` rows: 0 where the label starts with the query, 1 where one of the words in
    ``keywords`` does, 2 where either contains it; equal scores in the given order."""
    wanted = query.strip().lower()
    name, words = F.lower(label), F.split(F.lower(keywords), r"\s+")
    score = F.when(name.startswith(wanted), 0).when(F.exists(words, lambda w: w.startswith(wanted)), 1).when(F.concat_ws(" ", name, F.lower(keywords)).contains(wanted), 2)
    return df.withColumn("score", score).where("score IS NOT NULL").orderBy("score", order).limit(k)


def newest_first(df: DataFrame, by: str, column: str, id_col: str) -> DataFrame:
    """``rank`` of each row among its group, newest first."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(column), id_col)))
