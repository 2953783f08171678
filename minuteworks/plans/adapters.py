"""The driver's tables projected onto the model's tables.

Each adapter is one SQL text over ``{table}`` placeholders that Spark and DuckDB both run, so a query
and its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ADAPTERS: dict[str, str] = {
    "notes": """
        SELECT doc_id AS id, source AS user_id, split_part(text, '.', 1) AS title, text AS content,
               split(concat(lang, ',', source, ',internal-job:', CAST(doc_id % 97 AS STRING),
                     CASE WHEN doc_id % 3 = 0 THEN ',internal-recorded-at:2024-03-05T08:30:00Z,internal-timezone:Europe/Oslo' ELSE '' END), ',') AS tags,
               doc_id % 5 = 0 AS is_favorite, doc_id % 7 = 0 AS is_archived, doc_id % 11 = 0 AS is_deleted,
               TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS created_at,
               TIMESTAMP '2024-01-02 00:00:00' + doc_id * INTERVAL '1' MINUTE AS updated_at
        FROM {documents}""",
    "note_patches": """
        SELECT doc_id AS id, source AS user_id,
               CASE WHEN doc_id % 2 = 0 THEN concat('New title ', CAST(doc_id AS STRING)) END AS title,
               CASE WHEN doc_id % 3 = 0 THEN 'New content' END AS content,
               CASE WHEN doc_id % 4 = 0 THEN split('red,red,internal-forged', ',') END AS tags,
               CASE WHEN doc_id % 5 = 1 THEN true END AS is_favorite,
               CASE WHEN doc_id % 6 = 0 THEN TIMESTAMP '2024-01-02 00:00:00' + doc_id * INTERVAL '1' MINUTE
                    WHEN doc_id % 6 = 1 THEN TIMESTAMP '2020-01-01 00:00:00' END AS expected_updated_at
        FROM {documents} WHERE doc_id % 2 = 0 OR doc_id % 3 = 0""",
    "note_requests": """
        SELECT doc_id AS request_id, source AS user_id, concat('job-', CAST(doc_id % 300 AS STRING)) AS job_id,
               CASE WHEN doc_id % 13 = 0 THEN '  ' WHEN doc_id % 17 = 0 THEN text ELSE concat('  ', split_part(text, '.', 1)) END AS title,
               CASE WHEN doc_id % 19 = 0 THEN '' ELSE 'Europe/Oslo' END AS timezone,
               CASE WHEN doc_id % 23 = 0 THEN 'yesterday' ELSE '2024-03-05T08:30:00Z' END AS recorded_at
        FROM {documents}""",
    "tasks": """
        SELECT o_orderkey AS id, CAST(o_custkey AS STRING) AS user_id, concat('Task ', CAST(o_orderkey AS STRING)) AS title,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'backlog' WHEN '2-HIGH' THEN 'this_week' WHEN '3-MEDIUM' THEN 'today' WHEN '4-NOT SPECIFIED' THEN 'done' ELSE 'later' END AS status,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 0 ELSE CAST(o_orderkey % 90 AS INT) END AS duration_minutes,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completed_at,
               o_orderkey % 10 = 0 AS is_deleted,
               CAST(row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) - 1 AS INT) AS position
        FROM {orders}""",
    "task_updates": """
        SELECT o_orderkey - o_orderkey % 2 AS id, CAST(o_orderkey % 50 AS INT) AS position,
               CASE WHEN o_orderkey % 3 = 0 THEN 'today' ELSE 'backlog' END AS status, o_orderkey AS seq
        FROM {orders} WHERE o_orderkey % 5 <> 0""",
    "task_moves": """
        SELECT CAST(o_custkey AS STRING) AS user_id, 'today' AS status, CAST(min(o_orderkey) % 4 AS INT) AS from_index, CAST(max(o_orderkey) % 5 AS INT) AS to_index
        FROM {orders} GROUP BY o_custkey""",
    "users": """
        SELECT CAST(c_custkey AS STRING) AS id, lower(concat(replace(c_name, '#', '.'), '@example.org')) AS email,
               concat('user', CAST(c_custkey % 700 AS STRING)) AS username, c_custkey % 2 = 0 AS is_verified, 'x' AS password
        FROM {customer}""",
    "account_requests": """
        SELECT c_custkey AS request_id, CASE WHEN c_custkey % 3 = 0 THEN lower(concat(replace(c_name, '#', '.'), '@example.org')) ELSE concat('new', CAST(c_custkey AS STRING), '@example.org') END AS email,
               concat('user', CAST(c_custkey AS STRING)) AS username
        FROM {customer}""",
    "connections": """
        SELECT c_custkey AS id, CAST(c_custkey % 200 AS STRING) AS user_id, concat('provider-', CAST(c_nationkey AS STRING)) AS provider,
               concat('{{"login":"', c_name, '","email":null,"name":"N', CAST(c_nationkey AS STRING), '"}}') AS provider_data,
               TIMESTAMP '2024-01-01 00:00:00' + c_custkey * INTERVAL '1' HOUR AS created_at
        FROM {customer}""",
    "manifests": """
        SELECT CAST(user_id AS STRING) AS audio_path, concat('job-', CAST(event_id AS STRING)) AS job_id,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS generation,
               CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('owner-', CAST(event_id % 5 AS STRING)) END AS owner,
               CASE WHEN event_id % 4 = 0 THEN 'import' ELSE 'recording' END AS source,
               CASE event_type WHEN 'click' THEN 'transcribing' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'complete' WHEN 'view' THEN 'partial' ELSE 'saving' END AS status,
               CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 6 AS INT) END AS attempt,
               CASE WHEN event_id % 7 = 0 THEN 'Network unreachable' WHEN event_id % 7 = 1 THEN 'HTTP 429 Too Many Requests' WHEN event_id % 7 = 2 THEN 'API key is invalid' WHEN event_id % 7 = 3 THEN 'No space left on device' WHEN event_id % 7 = 4 THEN 'Microphone permission denied' END AS error,
               CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id % 500 END AS saved_note_id,
               CASE WHEN event_id % 8 = 3 THEN event_id % 500 END AS failure_note_id,
               CASE WHEN event_id % 5 = 0 THEN '  ' WHEN event_id % 5 = 1 THEN NULL ELSE props END AS transcript,
               CASE event_id % 3 WHEN 0 THEN 'ai' WHEN 1 THEN 'hybrid' ELSE 'extractive-fallback' END AS enhancement_mode,
               CASE WHEN event_id % 10 < 8 THEN CAST(12 + event_id % 6 AS INT) END AS ai_pipeline_version,
               CASE WHEN event_id % 10 < 9 THEN CAST(1 + event_id % 4 AS INT) END AS transcription_pipeline_version,
               CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 2 AS INT) END AS fallback_version,
               event_id % 31 = 0 AS repairing_fallback, event_id % 37 = 0 AS upgrading_ai,
               CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN ts + INTERVAL '3' MINUTE END AS next_attempt_at,
               ts AS updated_at, value AS value_ms
        FROM {events}""",
    "state_log": """
        SELECT CAST(user_id AS STRING) AS recording_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS generation,
               CASE event_id % 7 WHEN 0 THEN 'created' WHEN 1 THEN 'capturing' WHEN 2 THEN 'finalizing_capture' WHEN 3 THEN 'transcribing' WHEN 4 THEN 'transcript_draft' WHEN 5 THEN 'generating_note' ELSE 'ready' END AS state
        FROM {events}""",
    "claim_events": """
        SELECT CAST(user_id AS STRING) AS path, CASE WHEN event_id % 29 = 0 THEN ' ' ELSE concat('run-', CAST(event_id % 3 AS STRING)) END AS run_id,
               CASE WHEN event_type IN ('click', 'view') THEN 'claim' ELSE 'release' END AS action, ts, event_id AS seq
        FROM {events}""",
    "log_lines": """
        SELECT event_id AS line_id, ts AS logged_at, 'ipc.command.received' AS message, CAST(event_id AS STRING) AS request_id, event_type AS command, CAST(NULL AS DOUBLE) AS duration_ms FROM {events}
        UNION ALL
        SELECT event_id + 100000000 AS line_id, ts + INTERVAL '1' SECOND AS logged_at, CASE WHEN event_type = 'error' THEN 'ipc.command.failed' ELSE 'ipc.command.completed' END AS message,
               CASE WHEN event_id % 20 = 0 THEN '-' ELSE CAST(event_id AS STRING) END AS request_id, event_type AS command, value AS duration_ms FROM {events} WHERE event_id % 10 <> 0""",
    "http_lines": """
        SELECT event_id, ts AS logged_at, event_type AS operation, concat('host', CAST(user_id % 4 AS STRING)) AS host,
               CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 9 = 0 THEN 503 WHEN event_id % 9 = 1 THEN 404 ELSE 200 END AS status,
               CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'connect' END END AS failure, value AS duration_ms,
               CASE WHEN event_id % 9 = 0 THEN 'ERROR' WHEN event_id % 5 = 0 THEN 'WARN' ELSE 'INFO' END AS level
        FROM {events}""",
    "usage_lines": """
        SELECT event_id, ts AS logged_at, concat('{{"model":"m', CAST(event_id % 3 AS STRING), '","promptTokens":', CAST(event_id % 900 AS STRING), ',"completionTokens":', CAST(event_id % 70 AS STRING),
               ',"estimatedCostUsd":', CAST(event_id % 8 AS STRING), '.25,"continuations":', CAST(event_id % 2 AS STRING), ',"queueWaitMs":', CAST(event_id % 50 AS STRING), ',"isFallback":', CASE WHEN event_id % 4 = 0 THEN 'true' ELSE 'false' END, '}}') AS message
        FROM {events}""",
    "quality_windows": """
        SELECT CAST(l_orderkey AS STRING) AS recording_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS chunk_index,
               CAST(l_discount AS FLOAT) AS mic_clipped_ratio, CAST(l_tax / 4 AS FLOAT) AS mixed_clipped_ratio,
               CAST(-l_quantity AS FLOAT) AS mic_rms_dbfs, CAST(-2 * l_quantity AS FLOAT) AS system_rms_dbfs,
               CASE WHEN l_partkey % 6 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(l_extendedprice) AS BIGINT) * 96 END AS mic_bytes, CAST(floor(l_extendedprice) AS BIGINT) * 150 AS system_bytes
        FROM {lineitem}""",
    "samples": """
        SELECT CAST(l_orderkey AS STRING) AS recording_id, l_linenumber % 2 AS chunk_index, CAST(round(l_extendedprice * 100) AS BIGINT) % 65536 - 32768 AS sample
        FROM {lineitem}""",
    "overruns": """
        SELECT CAST(o_orderkey AS STRING) AS recording_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(o_totalprice / 10) AS BIGINT) END AS dropped_bytes,
               CASE WHEN o_orderkey % 50 = 7 THEN 0 ELSE 48000 END AS sample_rate, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS channels
        FROM {orders}""",
    "loudness": """
        SELECT CAST(o_custkey AS STRING) AS recording_id, CASE WHEN o_orderkey % 2 = 0 THEN 'microphone' ELSE 'system' END AS track,
               o_orderkey AS chunk_index, CASE WHEN o_orderkey % 7 <> 0 THEN -(o_totalprice / 10000) END AS lufs
        FROM {orders}""",
    "files": """
        SELECT page_id AS file_id, concat('C:', chr(92), 'Meet', chr(92), replace(url, '/', '_'), CASE page_id % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.mp3' WHEN 2 THEN '.pdf' WHEN 3 THEN '' ELSE '.docx' END) AS path, page_id * 7919 AS bytes, html AS content
        FROM {pages}""",
    "raw_text": """
        SELECT doc_id AS recording_id, concat(
                 CASE WHEN doc_id % 5 = 0 THEN 'Thank you for watching this video. ' ELSE '' END,
                 CASE WHEN doc_id % 4 = 0 THEN 'Terima kasih. ' ELSE '' END,
                 CASE WHEN doc_id % 6 = 0 THEN 'Version 2.0 is out. Version 2.0 is out. ' ELSE '' END, text,
                 CASE WHEN doc_id % 8 = 0 THEN ' Terima kasih.' ELSE '' END,
                 CASE WHEN doc_id % 9 = 0 THEN concat(chr(10), 'Subscribe!') ELSE '' END) AS text
        FROM {documents}""",
    "glossary": """
        SELECT CAST(p_brand AS STRING) AS recording_id, CASE WHEN p_partkey % 2 = 0 THEN 'recording' ELSE 'default' END AS source, p_partkey AS ord,
               concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN '; ' ELSE ', ' END, upper(p_name), chr(10), p_type, ' ', CAST(p_size AS STRING)) AS raw
        FROM {part}""",
    "turns": "SELECT conv_id, turn, role, text FROM {conversations}",
    "replies": """
        SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 5 = 4 THEN '{{"choices":[]}}' ELSE concat('{{"choices":[{{"message":{{"content":"c', CAST(turn AS STRING), '"}},"finish_reason":"', CASE WHEN conv_id % 3 = 0 THEN 'length' ELSE 'stop' END,
               '"}}],"usage":{{"prompt_tokens":', CAST(length(text) AS STRING), ',"completion_tokens":', CAST(turn AS STRING), '}}}}') END AS json
        FROM {conversations}""",
    "sse": """
        SELECT conv_id * 1000 + turn AS id, concat('data: {{"choices":[{{"delta":{{"content":"', role, ' "}}}}]}}', chr(10), ': keep-alive', chr(10), chr(10), 'data: {{bad', chr(10),
               'data: {{"choices":[{{"delta":{{"content":"', CAST(turn AS STRING), '"}}}}]}}', chr(10), 'data: [DONE]') AS body
        FROM {conversations}""",
    "attempts": """
        SELECT conv_id AS recording_id, CAST(turn AS INT) AS chunk_index, CASE WHEN conv_id % 7 = 0 THEN NULL WHEN turn % 5 = 3 THEN NULL ELSE concat('run-', CAST(turn % 2 AS STRING)) END AS run_id,
               concat('2024-01-01T00:00:', CAST(10 + turn AS STRING), 'Z') AS created_at, concat('attempt-', CAST(turn AS STRING)) AS attempt_name, text, md5(text) AS audio_sha256, turn % 6 = 5 AS failed
        FROM {conversations}""",
    "brand_texts": """
        SELECT p_brand AS recording_id, p_partkey AS ord, p_name AS word FROM {part}""",
    "brand_terms": """
        SELECT DISTINCT p_brand AS recording_id, CASE WHEN p_partkey % 2 = 0 THEN concat(substring(p_name, 1, length(p_name) - 1), 'x') ELSE p_name END AS term FROM {part} WHERE p_partkey % 3 = 0""",
    "reports": """
        SELECT o_orderkey AS recording_id, o_orderkey % 5 <> 0 AS requires_review,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN split('track_imbalance: a;mic_missing_advisory: b', ';') WHEN o_orderkey % 4 = 2 THEN split('mic_missing: c;track_imbalance: a;mixed_clipping: d', ';') ELSE split('mic_overrun: e', ';') END AS warnings
        FROM {orders}""",
    "line_docs": """
        SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat(text, chr(10), text, chr(10), chr(10), chr(10), text) WHEN doc_id % 5 = 1 THEN concat('# Head', chr(10), '# head', chr(10), '# HEAD', chr(10), text) ELSE text END AS text
        FROM {documents}""",
}


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


def adapt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = ADAPTERS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)})


def with_adapters(names: str, body: str) -> str:
    """DuckDB SQL: ``body`` with the named adapters as common table expressions."""
    parts = [f"{n} AS ({ADAPTERS[n].format(**{t: t for t in tables_of(ADAPTERS[n])})})" for n in names.split()]
    return f"WITH {', '.join(parts)} {body}" if not body.lstrip().upper().startswith("WITH ") else f"WITH {', '.join(parts)}, {body.lstrip()[5:]}"
