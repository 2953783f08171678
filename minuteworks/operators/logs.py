"""Logs, usage and chat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minuteworks.functions.quantiles import with_percentiles


def command_traces(logs: DataFrame) -> DataFrame:
    """``request_id, command, received_at, outcome, duration_ms`` of every received command; null where
    no answer came.  Lines without an id (``-``) take no part: they would be one hot key."""
    known = logs.where("request_id IS NOT NULL AND request_id <> '-'")
    asked = known.where("message = 'ipc.command.received'").select("request_id", "command", F.col("logged_at").alias("received_at"))
    done = known.where("message IN ('ipc.command.completed', 'ipc.command.failed')").select("request_id", F.when(F.col("message") == "ipc.command.failed", "failed").otherwise("completed").alias("outcome"), "duration_ms")
    return asked.join(done, "request_id", "left")


def command_summary(traces: DataFrame) -> DataFrame:
    return traces.groupBy("command").agg(F.count(F.lit(1)).alias("n_received"), F.count_if(F.col("outcome") == "failed").alias("n_failed"), F.count_if(F.col("outcome").isNull()).alias("n_unanswered"), F.avg("duration_ms").alias("mean_ms"))


def http_summary(lines: DataFrame) -> DataFrame:
    """Calls, failures by kind, mean and 95th percentile (exact) by operation, host and class
    of status."""
    kind = F.when(F.col("status").isNull(), "none").otherwise(F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")))
    by = ["operation", "host", "status_class"]
    rows = lines.withColumn("status_class", kind)
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("failure") == "timeout").alias("n_timeout"), F.count_if(F.col("failure") == "connect").alias("n_connect"), F.avg("duration_ms").alias("mean_ms"))
    return with_percentiles(sums, rows, by, "duration_ms", [0.95]).withColumn("p95_ms", F.col("percentiles")[0]).drop("percentiles")


def problems(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("level").isin("WARN", "ERROR"))


def retain(lines: DataFrame, days: int = 14) -> DataFrame:
    """Lines of the newest ``days`` days that have lines.  Days are ranked, not lines: few rows."""
    day = F.to_date("logged_at")
    ranked = lines.select(day.alias("_day")).distinct().withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_day"))))
    return lines.withColumn("day", day).join(F.broadcast(ranked.where(F.col("_rank") <= days)), F.col("day") == F.col("_day"), "left_semi")


USAGE = "model string, promptTokens bigint, completionTokens bigint, estimatedCostUsd double, continuations bigint, queueWaitMs bigint, isFallback boolean"


def ai_usage(lines: DataFrame) -> DataFrame:
    """Sums by model and fallback flag of usage events inside messages; other messages are left out."""
    rows = lines.select(F.from_json("message", USAGE).alias("u")).where("u.model IS NOT NULL").select("u.*")
    return rows.groupBy("model", F.coalesce("isFallback", F.lit(False)).alias("is_fallback")).agg(
        F.count(F.lit(1)).alias("n_calls"), F.sum("promptTokens").alias("prompt_tokens"), F.sum("completionTokens").alias("completion_tokens"),
        F.sum("estimatedCostUsd").alias("cost_usd"), F.sum("continuations").alias("continuations"), F.sum("queueWaitMs").alias("queue_wait_ms"),
    )


def chat_requests(turns: DataFrame, system_prompt: str | None = None) -> DataFrame:
    """``conv_id, turn, messages``: for each user turn the system prompt, all earlier messages in order,
    then the prompt."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    message = F.struct("role", F.col("text").alias("content"))
    history = F.collect_list(message).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content"))) if system_prompt else F.array().cast("array<struct<role:string,content:string>>")
    rows = turns.withColumns({"history": history, "message": message}).where("role = 'user'")
    return rows.select("conv_id", "turn", F.concat(first, "history", F.array("message")).alias("messages"))


def assemble_sse(bodies: DataFrame) -> DataFrame:
    """``id, content, error``: deltas of ``data: `` lines in order; other lines and bad JSON are
    skipped; nothing at all is an error."""
    lines = F.filter(F.split("body", "\n"), lambda x: x.startswith("data: "))
    parts = F.transform(lines, lambda x: F.get_json_object(F.substr(x, F.lit(7)), "$.choices[0].delta.content"))
    content = F.array_join(F.filter(parts, lambda p: p.isNotNull()), "")
    return bodies.select("id", content.alias("content"), F.when(content == "", "empty reply").alias("error"))


REPLY = "choices array<struct<message: struct<content: string>, finish_reason: string>>, usage struct<prompt_tokens: bigint, completion_tokens: bigint, cost: double>"


def parse_replies(df: DataFrame, json_col: str = "json") -> DataFrame:
    """``id, content, finish_reason, prompt_tokens, completion_tokens, is_truncated, error``."""
    rows = df.select("id", F.from_json(json_col, REPLY).alias("r")).withColumn("c", F.try_element_at("r.choices", F.lit(1)))
    return rows.select("id", "c.message.content", "c.finish_reason", F.coalesce("r.usage.prompt_tokens", F.lit(0)).alias("prompt_tokens"), F.coalesce("r.usage.completion_tokens", F.lit(0)).alias("completion_tokens"), F.coalesce(F.col("c.finish_reason") == "length", F.lit(False)).alias("is_truncated"), F.when(F.col("c").isNull(), "no choice").alias("error"))


MODELS = "data array<struct<id: string, context_length: bigint, top_provider: struct<max_completion_tokens: bigint>>>"


def model_limits(metadata: DataFrame, wanted: DataFrame, cap: int = 16_384, fallback: tuple[int, int] = (32_768, 8_192)) -> DataFrame:
    """``model, context_tokens, output_tokens`` of every wanted model; the fallback where it is absent."""
    m = metadata.select(F.explode(F.from_json("json", MODELS)["data"]).alias("m")).where("m.context_length IS NOT NULL").select(F.col("m.id").alias("model"), "m.context_length", F.col("m.top_provider.max_completion_tokens").alias("out"))
    m = m.groupBy("model").agg(F.max(F.struct("context_length", "out")).alias("x"))
    rows = wanted.join(m, "model", "left")
    return rows.select("model", F.coalesce("x.context_length", F.lit(fallback[0])).alias("context_tokens"), F.when(F.col("x").isNull(), fallback[1]).otherwise(F.least(F.coalesce("x.out", F.lit(cap)), F.lit(cap))).alias("output_tokens"))
