"""Streams in several micro-batches: what comes out when, and what state is left."""

from datetime import datetime, timedelta

import pytest

from minuteworks.streaming import live as K

START = datetime(2024, 1, 1, 10)


def run(spark, tmp_path, operator, schema, files):
    """Writes one file for each micro-batch and runs after each; rows of each run, and the rows of state
    that are left in the end."""
    source, out = tmp_path / "in", []
    source.mkdir()
    stream = operator(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        with K.rocksdb_state(spark):
            query = stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
            query.awaitTermination()
        every = [tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()]
        out.append(sorted(set(every) - {r for run in out for r in run}, key=str))
        assert len(every) == sum(map(len, out))  # nothing comes out twice
    state = [op["numRowsTotal"] for op in query.lastProgress["stateOperators"]]
    return out, state


def frame(recording, started, ms, size=1):
    return (recording, started, ms, size)


@pytest.mark.parametrize("operator", [K.chunk_windows, K.overlap_windows])
def test_chunks_close_by_their_own_recording(spark, tmp_path, operator):
    later = START + timedelta(hours=2)
    files = [
        [frame("a", START, ms) for ms in (0, 1000, 176_000, 190_000)],
        [frame("a", START, 400_000), frame("a", START, 100)],  # the second one is late, but within the wait
        [frame("b", later, ms) for ms in (0, 200_000)],  # two hours on: all chunks of a are closed
        [frame("a", START, 50)],  # too late: its chunk is out
        [frame(None, later + timedelta(hours=5), 0)],  # a tick: all of b comes out
    ]
    out, state = run(spark, tmp_path, operator, "recording_id string, started_at timestamp, elapsed_ms long, bytes long", files)
    first = [("a", 0, 4, 4), ("a", 1, 2 if operator is K.overlap_windows else 1, 2 if operator is K.overlap_windows else 1), ("a", 2, 1, 1)]
    assert out == [[], [], first, [], [("b", 0, 1, 1), ("b", 1, 1, 1)]]
    assert state == [0]
    batch = spark.createDataFrame([r for f in files[:2] for r in f], "recording_id string, started_at timestamp, elapsed_ms long, bytes long")
    assert sorted(tuple(r) for r in operator(batch).collect()) == first


def part(recording, chunk, n, text, minute, failed=False):
    return (recording, chunk, n, failed, text, START + timedelta(minutes=minute))


PARTS = "recording_id string, chunk_index int, n_expected long, failed boolean, text string, ts timestamp"


def test_live_transcripts_late_parts_and_the_batch_path(spark, tmp_path):
    files = [
        [part("whole", 1, None, "two three", 1), part("open", 0, 3, "left", 0), part("bad", 0, 1, None, 0, True), part("again", 0, 2, "old words", 0)],
        [part("whole", 0, 2, "one", 2), part("again", 0, 2, "new words", 3), part("late", 0, 1, "first", 3)],
        [part("again", 1, 2, "end here", 4), part("late", 1, 2, "second", 5), part("whole", 0, 2, "not again", 6)],
        [part("tick", 0, 1, "tick", 600)],
    ]
    out, state = run(spark, tmp_path, K.live_transcripts, PARTS, files)
    assert out[0] == [("bad", "failed", 1, None)]
    assert out[1] == [("late", "complete", 1, "first"), ("whole", "complete", 2, "one two three")]
    assert out[2] == [("again", "complete", 2, "new words end here")]
    assert out[3] == [("open", "open", 1, None), ("tick", "complete", 1, "tick")]
    live = spark.createDataFrame([r for run_ in out for r in run_], K.LIVE)
    parts = spark.createDataFrame([r for f in files for r in f] + [part("open", 1, 3, "behind", 700), part("open", 2, 3, "at last", 701), part("unseen", 0, 1, "alone", 0)], PARTS)
    rebuilt = sorted(tuple(r) for r in K.rebuilt_in_batch(live, parts).collect())
    assert rebuilt == [("again", "live", "new words end here"), ("late", "batch", "first second"), ("open", "batch", "left behind at last"), ("tick", "live", "tick"), ("unseen", "batch", "alone"), ("whole", "live", "one two three")]


def test_state_grows_with_the_part(spark, tmp_path):
    """Every batch writes what its own parts take, however long the recording is by then."""
    files = [[part("long", 10 * k + i, 1000, "word " * 200, k) for i in range(10)] for k in range(4)]
    source, written = tmp_path / "in", []
    source.mkdir()
    stream = K.live_transcripts(spark.readStream.schema(PARTS).parquet(str(source)))
    for rows in files:
        spark.createDataFrame(rows, PARTS).coalesce(1).write.mode("append").parquet(str(source))
        with K.rocksdb_state(spark):
            query = stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
            query.awaitTermination()
        written.append(max(op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"]))
    assert max(written) <= 10 + 5  # ten parts, the facts of the recording and its timer


def test_handoffs_over_batches(spark, tmp_path):
    day = lambda d: datetime(2024, 1, d)
    row = lambda path, seq, kind, at: (path, seq, kind, at, START + timedelta(seconds=seq))
    files = [
        [row("a", 1, "handoff", day(1)), row("a", 2, "handoff", day(1)), row("a", 3, "handoff", day(2)), row("b", 4, "finished", None), row("b", 5, "handoff", day(1))],
        [row("a", 6, "handoff", day(1)), row("a", 7, "handoff", day(3)), row("a", 8, "finished", None), row("a", 9, "handoff", day(3)), row("a", 10, "handoff", day(4))],
        [row("a", 12, "finished", None), row("a", 11, "handoff", day(5)), row("b", 13, "handoff", day(2)), row("b", 14, "finished", None)],
        [row("b", 15, "handoff", day(3)), row("a", 16, "handoff", day(6))],
    ]
    out, _ = run(spark, tmp_path, K.dedupe_handoffs, "audio_path string, seq long, kind string, handed_at timestamp, ts timestamp", files)
    assert {r[1]: r[3] for run_ in out for r in run_} == {1: "accepted", 2: "duplicate", 3: "active", 5: "accepted", 6: "duplicate", 7: "active", 9: "duplicate", 10: "accepted", 11: "active", 13: "active", 15: "accepted", 16: "accepted"}


def test_the_last_unanswered_commands_come_out(spark, tmp_path):
    from minuteworks.plans import QUERIES

    rows = spark.range(1, 32).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT)) AS ts", "id AS user_id", "'click' AS event_type", "1.0D AS value", "'' AS props")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = {r.request_id: r.outcome for r in QUERIES["k7_command_traces"](spark, str(tmp_path)).collect()}
    assert found == {str(i): None if i % 10 == 0 else "completed" for i in range(1, 32)}


def updated(spark, tmp_path, operator, schema, rows):
    """Rows of state that one batch writes."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = operator(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    with K.rocksdb_state(spark):
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
        query.awaitTermination()
    return max(op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"])


def test_parts_that_come_all_at_once_are_not_stored(spark, tmp_path):
    assert updated(spark, tmp_path, K.live_transcripts, PARTS, [part("r", i, 50, f"w{i}", 1) for i in range(50)]) <= 5


def test_times_of_handoffs_are_stored_by_the_month(spark, tmp_path):
    rows = [("a", i, "handoff", datetime(2024, 1, 1) + timedelta(days=i), START + timedelta(seconds=i)) for i in range(30)]
    assert updated(spark, tmp_path, K.dedupe_handoffs, "audio_path string, seq long, kind string, handed_at timestamp, ts timestamp", rows) <= 6
