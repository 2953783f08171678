"""Structured Streaming: chunk windows, live transcripts, hand-offs, claims, command traces.

K1, K2 and K7 are the same expressions in batch and stream; K3, K5 and K6 keep state for each key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from minuteworks.operators.transcripts import clean_transcript, joined, stitch
from minuteworks.sources.scratch import shared_dir

CHUNK_MS, OVERLAP_MS = 180_000, 5_000


def chunk_sums(frames: DataFrame, chunks: Column, wait: str) -> DataFrame:
    """Frames and bytes of each chunk.  A chunk's event time is its end, counted from the start of its own
    recording, so the watermark closes it ``wait`` after that: it comes out once, and its state goes.
    A frame without a recording is a tick: it moves the watermark and is counted nowhere."""
    rows = frames.withColumn("chunk_index", F.explode(chunks))
    ends = F.timestamp_millis(F.unix_millis("started_at") + (F.col("chunk_index") + 1) * CHUNK_MS)
    marked = rows.withColumn("ends_at", ends).withWatermark("ends_at", wait)
    # naming the event time keeps the filter above the watermark, which ticks have to reach
    kept = marked.where(F.col("recording_id").isNotNull() | F.col("ends_at").isNull())
    sums = kept.groupBy("recording_id", "chunk_index", "ends_at").agg(F.count(F.lit(1)).alias("n_frames"), F.sum("bytes").alias("bytes"))
    return sums.select("recording_id", F.col("chunk_index").cast("int").alias("chunk_index"), "n_frames", "bytes")


def chunk_windows(frames: DataFrame, wait: str = "900 seconds") -> DataFrame:
    """Frames and bytes of each 180-second chunk of each recording, from ``recording_id, started_at,
    elapsed_ms, bytes``."""
    return chunk_sums(frames, F.array(F.floor(F.col("elapsed_ms") / CHUNK_MS)), wait)


def overlap_windows(frames: DataFrame, wait: str = "900 seconds") -> DataFrame:
    """The same with the last five seconds of the chunk before in each chunk."""
    chunk = F.floor(F.col("elapsed_ms") / CHUNK_MS)
    return chunk_sums(frames, F.when(F.col("elapsed_ms") % CHUNK_MS >= CHUNK_MS - OVERLAP_MS, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)), wait)


def stitched(parts: dict[int, str]) -> str:
    out: list[str] = []
    tail: list[str] = []
    for k in sorted(parts):
        new = parts[k].split()
        n, tail = joined(tail, new)
        out += new[n:]
    return " ".join(out)


LIVE = "recording_id string, status string, n_parts long, transcript string"


class LiveTranscript(StatefulProcessor):
    """A recording's parts, each under a key of its own, until all are in or its wait is over.

    Each use of state is a call to the JVM, so it is asked only for what it can hold: parts that come all at
    once are never stored."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "chunk_index int", "text string, failed boolean")
        #: parts held, failed ones among them, parts expected (-1: unknown), newest event time, what was sent
        self.facts = handle.getValueState("facts", "n long, failed long, expected long, last long, sent boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, failed, expected, last, sent = self.facts.get() or (0, 0, -1, 0, False)
        held, newest, new = n, last, {}
        for r in sorted(rows, key=lambda r: r.at_ms):
            newest = max(newest, r.at_ms)
            if r.n_expected is not None:
                expected = int(r.n_expected)
            if not sent:
                new[int(r.chunk_index)] = (r.text or "", bool(r.failed))
        for chunk, (_, bad) in new.items():
            if held and self.parts.containsKey((chunk,)):
                failed -= bool(self.parts.getValue((chunk,))[1])
            else:
                n += 1
            failed += bad
        if not sent and 0 <= expected <= n:
            before = {k[0]: v[0] for k, v in self.parts.iterator()} if held and not failed else {}
            text = None if failed else stitched(before | {k: v[0] for k, v in new.items()})
            yield Row(recording_id=key[0], status="failed" if failed else "complete", n_parts=n, transcript=text)
            if held:
                self.parts.clear()
            sent = True  # what was sent is not sent again until the state ends
        else:
            for chunk, part in new.items():
                self.parts.updateValue((chunk,), part)
        # by event time: ``wait`` after the newest part, of what was sent too, so that state ends
        if newest != last:
            if last:
                self.handle.deleteTimer(last + self.wait_ms)
            self.handle.registerTimer(newest + self.wait_ms)
        self.facts.update((n, failed, expected, newest, sent))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, _, _, _, sent = self.facts.get()
        self.facts.clear()
        if not sent:
            self.parts.clear()
            yield Row(recording_id=key[0], status="open", n_parts=n, transcript=None)

    def close(self) -> None:
        pass


def live_transcripts(parts: DataFrame, wait: str = "900 seconds") -> DataFrame:
    """``recording_id, status, n_parts, transcript``: once per recording, ``complete`` when all expected
    parts are in and none failed, ``failed`` when all are in and one did, or ``open`` when ``wait`` of
    event time has passed since the last part.  :func:`rebuilt_in_batch` takes up all but complete ones.

    ``parts``: recording_id, chunk_index, n_expected (null until known), failed, text, ts.  Parts come in
    any order; a later row for a chunk replaces an earlier one.  A part is written to the state store once,
    under its own key, so what a batch writes grows with the batch and not with the recording.
    """
    cleaned = parts.withWatermark("ts", wait).withColumns({"text": clean_transcript(F.col("text")), "at_ms": F.unix_millis("ts")})
    return cleaned.groupBy("recording_id").transformWithState(LiveTranscript(pd.Timedelta(wait) // pd.Timedelta("1ms")), LIVE, "append", "eventTime")


def rebuilt_in_batch(live: DataFrame, parts: DataFrame) -> DataFrame:
    """``recording_id, source, transcript`` of all recordings that have parts: what came out live and still
    has all its parts is kept (``live``); recordings that were given up, that nothing came out of, or that
    got a part after their transcript did are stitched again (``batch``), unless the newest row of a part
    says that it failed.

    ``parts`` is the table of all parts, late ones included.
    """
    newest = parts.groupBy("recording_id", "chunk_index").agg(F.max(F.struct("ts", "failed", "text")).alias("p"))
    newest = newest.select("recording_id", "chunk_index", "p.failed", F.col("p.text").alias("text"))
    known = newest.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_now"), F.max("failed").alias("any_failed"))
    state = known.join(live, "recording_id", "left")
    whole = F.coalesce((F.col("status") == "complete") & (F.col("n_parts") == F.col("n_now")), F.lit(False))
    kept = state.where(whole).select("recording_id", F.lit("live").alias("source"), "transcript")
    again = state.where(~whole & ~F.col("any_failed")).select("recording_id")
    return kept.unionByName(stitch(newest.join(again, "recording_id", "left_semi"), clean_transcript).select("recording_id", F.lit("batch").alias("source"), "transcript"))


MONTH_US = 30 * 86_400_000_000


class Handoffs(StatefulProcessor):
    """What a path was handed off for, and whether it is being processed.

    Each use of state is a call to the JVM, so times are held together, a month of them under one key."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "month long", "times array<long>")
        #: whether the path is being processed, and its newest event time
        self.facts = handle.getValueState("facts", "active boolean, last long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        facts = self.facts.get()
        active, last = facts or (False, 0)
        newest, months, grown = last, {}, set()
        for r in sorted(rows, key=lambda r: (r.at_us, r.seq)):
            newest = max(newest, r.at_us // 1000)
            if r.kind == "finished":
                active = False
                continue
            month = r.handed_us // MONTH_US
            if month not in months:
                times = self.seen.getValue((month,)) if facts and self.seen.containsKey((month,)) else None
                months[month] = set(times[0]) if times else set()
            if r.handed_us in months[month]:
                outcome = "duplicate"
            else:
                months[month].add(r.handed_us)
                grown.add(month)
                outcome, active = "active" if active else "accepted", True
            yield Row(audio_path=key[0], seq=r.seq, handed_us=r.handed_us, outcome=outcome)
        for month in grown:
            self.seen.updateValue((month,), (sorted(months[month]),))
        if newest != last:
            if last:
                self.handle.deleteTimer(last + self.keep_ms)
            self.handle.registerTimer(newest + self.keep_ms)
        self.facts.update((active, newest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        self.facts.clear()
        return iter(())

    def close(self) -> None:
        pass


def dedupe_handoffs(events: DataFrame, keep: str = "7 days") -> DataFrame:
    """``audio_path, seq, handed_at, outcome`` of each hand-off: the first one for a path and time is
    ``accepted``, or goes as ``active`` while an earlier one of the path is not finished; all later ones for
    that path and time are ``duplicate``, whatever became of the first.

    ``events``: audio_path, seq, kind (``handoff`` or ``finished``), handed_at, ts; rows of a micro-batch
    are taken in order of (ts, seq).  What is kept of a path ends when it was quiet for ``keep`` of event
    time, so a path whose end was lost becomes free.
    """
    rows = events.withWatermark("ts", keep).select("audio_path", "seq", "kind", F.unix_micros("handed_at").alias("handed_us"), F.unix_micros("ts").alias("at_us"), "ts")
    told = rows.groupBy("audio_path").transformWithState(Handoffs(pd.Timedelta(keep) // pd.Timedelta("1ms")), "audio_path string, seq long, handed_us long, outcome string", "append", "eventTime")
    return told.select("audio_path", "seq", F.timestamp_micros("handed_us").alias("handed_at"), "outcome")


def claims(events: DataFrame) -> DataFrame:
    """``path, seq, action, run_id, outcome`` of each claim or release: the first claim holds a path
    until its own run releases it; others are ``rejected``, foreign releases ``ignored``, a blank run
    is ``invalid``.  Rows of a micro-batch are taken in order of (ts, seq)."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        holder = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        out = []
        for action, run in zip(pdf["action"], pdf["run_id"]):
            if not (run or "").strip():
                out.append("invalid")
            elif action == "claim":
                out.append("accepted" if holder in (None, run) else "rejected")
                holder = holder or run
            else:
                out.append("released" if holder == run else "ignored")
                holder = None if holder == run else holder
        if holder:
            state.update((holder,))
        elif state.exists:
            state.remove()
        yield pdf[["path", "seq", "action", "run_id"]].assign(outcome=out)

    return events.groupBy("path").applyInPandasWithState(update, "path string, seq long, action string, run_id string, outcome string", "holder string", "append", GroupStateTimeout.NoTimeout)


def command_traces_stream(logs: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """Received commands with their answers within ``wait``; unanswered ones with nulls once the
    watermark has passed."""
    known = logs.where("request_id IS NOT NULL AND request_id <> '-'").withWatermark("logged_at", wait)
    asked = known.where("message = 'ipc.command.received'").select("request_id", "command", F.col("logged_at").alias("received_at"))
    done = known.where("message IN ('ipc.command.completed', 'ipc.command.failed')").select(F.col("request_id").alias("answered_id"), F.when(F.col("message") == "ipc.command.failed", "failed").otherwise("completed").alias("outcome"), F.col("logged_at").alias("answered_at"))
    near = (F.col("request_id") == F.col("answered_id")) & (F.col("answered_at") >= F.col("received_at")) & (F.col("answered_at") <= F.col("received_at") + F.expr(f"INTERVAL {wait}"))
    return asked.join(done, near, "leftOuter").drop("answered_id")


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The state store that typed state needs, for queries that start inside; a query keeps the one that it
    started with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drained(spark: SparkSession, stream: DataFrame, typed: bool = False, closing: Callable[[], None] | None = None) -> DataFrame:
    """Runs a stream in append mode over all that is there now and returns what it wrote, from a folder that
    driver and executors share.  ``typed`` state needs its own store; others use the session's.  ``closing``
    adds the rows that end all waits to a source; the stream takes them up where it stopped."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    with rocksdb_state(spark) if typed else nullcontext():
        for before in (None, closing) if closing else (None,):
            if before:
                before()
            query = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{path}/out").start()
            query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
