"""Task boards and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("backlog", "this_week", "today", "done")


def active_tasks(tasks: DataFrame, user: str | None = None) -> DataFrame:
    kept = tasks.where(~F.col("is_deleted"))
    return kept if user is None else kept.where(F.col("user_id") == user)


def patch_tasks(tasks: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """A row per patch: ``id, found`` and each field after ``coalesce(patch, old)``."""
    p, t = patches.alias("p"), active_tasks(tasks).alias("t")
    both = p.join(t, F.col("p.id") == F.col("t.id"), "left")
    return both.select("p.id", F.col("t.id").isNotNull().alias("found"), *(F.when(F.col("t.id").isNotNull(), F.coalesce(f"p.{f}", f"t.{f}")).alias(f) for f in fields))


def toggle_completion(tasks: DataFrame, keys: DataFrame, now) -> DataFrame:
    """``completed_at`` set to ``now`` where it is null and to null where it is not, for the keys."""
    marks = keys.select("id").distinct().withColumn("_hit", F.lit(True))
    done = F.when(F.col("completed_at").isNull(), F.lit(now))
    return tasks.join(marks, "id", "left").withColumn("completed_at", F.when(F.col("_hit"), done).otherwise(F.col("completed_at"))).drop("_hit")


def apply_positions(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """Live tasks after position updates; of several for one id the last by ``seq`` holds."""
    last = updates.groupBy("id").agg(F.max(F.struct("seq", "position", "status")).alias("u"))
    return active_tasks(tasks).join(last, "id", "left").withColumns({"position": F.coalesce("u.position", "position"), "status": F.coalesce("u.status", "status")}).drop("u")


def clear_column(tasks: DataFrame, keys: DataFrame) -> DataFrame:
    """Soft-deletes every task of the (user, status) keys."""
    marks = keys.select("user_id", "status").distinct().withColumn("_hit", F.lit(True))
    return tasks.join(marks, ["user_id", "status"], "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_hit", F.lit(False))).drop("_hit")


def task_board(tasks: DataFrame) -> DataFrame:
    """Tasks of the known statuses with label, done flag and their place in the column."""
    place = F.row_number().over(Window.partitionBy("user_id", "status").orderBy("position", "id"))
    minutes = F.when(F.coalesce("duration_minutes", F.lit(0)) > 0, F.col("duration_minutes")).otherwise(20)
    board = active_tasks(tasks).where(F.col("status").isin(*STATUSES))
    return board.select("id", "user_id", "status", F.format_string("%d Min", minutes).alias("duration_label"), F.col("completed_at").isNotNull().alias("is_done"), place.alias("place"))


def column_progress(tasks: DataFrame) -> DataFrame:
    """Tasks, completed ones and the rounded percentage of each column of each user."""
    rows = active_tasks(tasks).where(F.col("status").isin(*STATUSES)).groupBy("user_id", "status")
    out = rows.agg(F.count(F.lit(1)).alias("n_tasks"), F.count("completed_at").alias("n_done"))
    return out.withColumn("percent", F.round(100 * F.col("n_done") / F.col("n_tasks")).cast("int"))


def move_task(tasks: DataFrame, moves: DataFrame) -> DataFrame:
    """One move per column: the task at ``from_index`` goes to ``to_index``; then 0-based positions.
    Moves that point outside the column change nothing."""
    column = Window.partitionBy("user_id", "status")
    rows = active_tasks(tasks).select("id", "user_id", "status", (F.row_number().over(column.orderBy("position", "id")) - 1).alias("i"), F.count(F.lit(1)).over(column).alias("n"))
    rows = rows.join(moves, ["user_id", "status"], "left")
    a, b, i = F.col("from_index"), F.col("to_index"), F.col("i")
    valid = (a >= 0) & (b >= 0) & (a < F.col("n")) & (b < F.col("n"))
    moved = F.when(i == a, b).when((i > a) & (i <= b), i - 1).when((i < a) & (i >= b), i + 1).otherwise(i)
    return rows.select("id", "user_id", "status", F.when(valid, moved).otherwise(i).cast("int").alias("position"))


def duplicate_accounts(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests whose e-mail or user name is taken: two equi-joins instead of one with OR."""
    by_mail = requests.join(users.select("email").distinct(), "email", "left_semi")
    by_name = requests.join(users.select("username").distinct(), "username", "left_semi")
    return by_mail.select("request_id").union(by_name.select("request_id")).distinct()


def connections(df: DataFrame) -> DataFrame:
    """Connections with login, e-mail and name out of the provider's JSON; tokens and raw JSON left out."""
    data = F.from_json("provider_data", "login string, email string, name string")
    return df.withColumn("_d", data).select("id", "user_id", "provider", "created_at", "_d.login", "_d.email", "_d.name")


def insert_connections(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``id, accepted``: one connection per (user, provider); the first of the batch, if none is there."""
    first = new.groupBy("user_id", "provider").agg(F.min("id").alias("first"))
    held = existing.select("user_id", "provider").distinct().withColumn("_held", F.lit(True))
    rows = new.join(first, ["user_id", "provider"]).join(held, ["user_id", "provider"], "left")
    return rows.select("id", (F.col("_held").isNull() & (F.col("id") == F.col("first"))).alias("accepted"))


def public_users(users: DataFrame) -> DataFrame:
    return users.drop("password")
