import math
import struct

import pytest

from minuteworks.operators import capture as Q


def pcm(*samples):
    return struct.pack(f"<{len(samples)}h", *samples)


def test_levels(spark):
    sine = pcm(*(int(16384 * math.sin(2 * math.pi * k / 48)) for k in range(4800)))
    rows = [("empty", b""), ("silence", pcm(0, 0)), ("full", pcm(32767, -32768)), ("odd", pcm(16384) + b"\x01"), ("sine", sine)]
    got = {r.recording_id: r for r in Q.pcm_levels(spark.createDataFrame(rows, "recording_id string, content binary")).collect()}
    assert (got["empty"].clipped_ratio, got["empty"].rms_dbfs) == (0.0, -120.0) and got["silence"].rms_dbfs == -120.0
    assert got["full"].clipped_ratio == 1.0 and got["full"].rms_dbfs == pytest.approx(0, abs=0.01)
    assert got["odd"].rms_dbfs == pytest.approx(20 * math.log10(0.5)) and got["sine"].rms_dbfs == pytest.approx(20 * math.log10(0.5 / math.sqrt(2)), abs=0.01)


def test_loudness(spark):
    tone = pcm(*(int(0.1 * 32767 * math.sin(2 * math.pi * 1000 * k / 48000)) for k in range(24000)))
    rows = [("short", tone[:2000]), ("silence", pcm(*[0] * 6000)), ("tone", tone)]
    got = {r.recording_id: r.lufs for r in Q.chunk_loudness(spark.createDataFrame(rows, "recording_id string, content binary")).collect()}
    assert got["short"] is None and got["silence"] is None and got["tone"] == pytest.approx(-23.0, abs=0.3)


def test_window_thresholds(spark):
    kind = "recording_id string, chunk_index int, mic_clipped_ratio float, mixed_clipped_ratio float, mic_rms_dbfs float, system_rms_dbfs float"
    rows = [("a", 0, 0.005, 0.01, -20.0, -44.0), ("b", 0, 0.0051, 0.0, -20.0, -44.5), ("c", 0, 0.031, 0.011, -61.0, -20.0), ("d", 0, 0.03, 0.0, -20.0, -81.0)]
    got = sorted((r.recording_id, r.warning) for r in Q.window_warnings(spark.createDataFrame(rows, kind)).collect())
    assert got == [
        ("b", "mic_clipping_advisory: chunk 0 has 0.51% near-full-scale samples"),
        ("b", "track_imbalance: chunk 0 microphone/system RMS differs by 24.5dB (-20.0 vs -44.5dBFS)"),
        ("c", "mic_clipping: chunk 0 has 3.10% near-full-scale samples"),
        ("c", "mixed_clipping: chunk 0 has 1.10% near-full-scale output samples"),
        ("d", "mic_clipping_advisory: chunk 0 has 3.00% near-full-scale samples"),
    ]


def test_gaps(spark):
    rows = [("mid", 0, 0, 180_000, 1), ("mid", 1, 180_000, 360_000, 0), ("mid", 2, 360_000, 365_000, 0), ("none", 0, 0, 1000, 0), ("long", 0, 0, 10, 5), ("long", 1, 180_000, 185_001, 0)]
    df = spark.createDataFrame(rows, "recording_id string, chunk_index int, start_ms long, end_ms long, mic_bytes long")
    got = sorted((r.recording_id, r.chunk_index, r.warning.split(":")[0]) for r in Q.mic_gaps(df).collect())
    assert got == [("long", 1, "mic_missing"), ("mid", 1, "mic_missing"), ("mid", 2, "mic_missing_advisory"), ("none", 0, "mic_missing")]


def test_gain(spark):
    df = spark.createDataFrame([("r", "microphone", 0, -22.0), ("r", "microphone", 1, None), ("r", "system", 0, -100.0)], "recording_id string, track string, chunk_index int, lufs double")
    got = {(r.track, r.chunk_index): r.gain for r in Q.leveler_gain(df).collect()}
    first = 0.4 * 10 ** (-9 / 20) + 0.6
    assert got[("microphone", 0)] == pytest.approx(first) and got[("microphone", 1)] == pytest.approx(first)
    assert got[("system", 0)] == pytest.approx(0.4 * 10 ** (3 / 20) + 0.6 * 10 ** (18 / 20))


def test_filter_blocks_against_the_recurrence():
    import numpy as np

    from minuteworks.operators import capture as Q

    x = np.random.default_rng(0).normal(size=1000)
    for c in Q.K_WEIGHTING:
        b0, b1, b2, a1, a2 = c
        want, p, q = [], 0.0, 0.0
        for v in x:
            y = b0 * v + p
            p, q = b1 * v - a1 * y + q, b2 * v - a2 * y
            want.append(y)
        assert np.allclose(Q.filtered(x, c), want, rtol=1e-9, atol=1e-12)
    assert len(Q.filtered(x[:0], Q.K_WEIGHTING[0])) == 0


def test_loudness_against_the_recurrence(spark):
    """Whole values of chunks: noise, a quiet one, silence, and one that is too short."""
    import math

    import numpy as np

    from minuteworks.operators import capture as Q

    rng = np.random.default_rng(1)
    chunks = [rng.normal(0, 4000, 6000), rng.normal(0, 30, 9000), np.zeros(6000), rng.normal(0, 4000, 4000), np.concatenate([np.zeros(5000), rng.normal(0, 4000, 1000)])]
    chunks = [np.clip(c, -32768, 32767).astype("<i2") for c in chunks]
    got = {r.chunk_index: r.lufs for r in Q.chunk_loudness(spark.createDataFrame([(k, bytearray(c.tobytes() + b"x")) for k, c in enumerate(chunks)], "chunk_index int, content binary")).collect()}
    for k, c in enumerate(chunks):
        x = [v / 32768 for v in c.tolist()]
        for b0, b1, b2, a1, a2 in Q.K_WEIGHTING:
            out, p, q = [], 0.0, 0.0
            for v in x:
                y = b0 * v + p
                p, q = b1 * v - a1 * y + q, b2 * v - a2 * y
                out.append(y)
            x = out
        active = [v * v for v in x if abs(v) > 3e-4]
        power = sum(active) / len(active) if len(x) >= 4800 and len(active) >= 2400 else 0.0
        want = -0.691 + 10 * math.log10(power) if power > 1e-12 else None
        assert (got[k] is None) == (want is None) and (want is None or abs(got[k] - want) < 1e-9)


def test_start_trims_sort_the_chunks_once(spark):
    chunks = [("a", "microphone", 0, 30), ("a", "microphone", 1, 30), ("a", "microphone", 2, 500), ("a", "system", 0, 100), ("b", "microphone", 0, 70), ("c", "microphone", 0, 9), (None, "system", 0, 5)]
    chunks = spark.createDataFrame(chunks, "recording_id string, track string, chunk_index int, bytes long").selectExpr("*", "1000 AS sample_rate", "1 AS channels")
    starts = spark.createDataFrame([("a", "microphone", 10), ("a", "system", 60), ("b", "microphone", 5), ("d", "system", 1), (None, "system", 1), (None, "microphone", 9)], "recording_id string, track string, start_ms int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = Q.start_trims(chunks, starts)
        got = {tuple(r) for r in out.select("recording_id", "track", "chunk_index", "trim_bytes").collect()}
        plan = out._jdf.queryExecution().sparkPlan().toString()
        final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {("a", "microphone", 0, 30), ("a", "microphone", 1, 30), ("a", "microphone", 2, 40), ("a", "system", 0, 0), ("b", "microphone", 0, 0), ("c", "microphone", 0, 0), (None, "system", 0, 0)}
    assert plan.count("Join") == 1  # offsets need no join of their own
    assert final.count("Sort [") == 3  # chunks, starts by recording, offsets
