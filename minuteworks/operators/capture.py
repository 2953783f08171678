"""Capture quality: levels, windows, warnings, gates, gain, media facts, corpus scorecard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minuteworks.functions import lexicon as L
from minuteworks.functions.text import file_name, starts_with_any

CHUNK_MS = 180_000


def pair_tracks(mic: DataFrame, system: DataFrame) -> DataFrame:
    """Microphone and system chunks by (recording, chunk); pairs in which both are empty are left out."""
    m = mic.select("recording_id", "chunk_index", F.col("bytes").alias("mic_bytes"))
    s = system.select("recording_id", "chunk_index", F.col("bytes").alias("system_bytes"))
    return m.join(s, ["recording_id", "chunk_index"], "full").fillna(0, ["mic_bytes", "system_bytes"]).where("mic_bytes > 0 OR system_bytes > 0")


def start_trims(chunks: DataFrame, starts: DataFrame) -> DataFrame:
    """``trim_bytes`` of each chunk: the stream that started earlier loses whole frames for the
    difference, chunk after chunk until it is spent.  ``starts``: recording, track, ``start_ms``;
    ``chunks``: recording, track, chunk_index, ``bytes, sample_rate, channels``."""
    recording = Window.partitionBy("recording_id")
    two = F.min("track").over(recording) < F.max("track").over(recording)
    offset = starts.select("recording_id", "track", F.when(two, F.max("start_ms").over(recording) - F.col("start_ms")).otherwise(0).alias("offset_ms"))
    # the window comes before the join, which can use its order: chunks are sorted once
    before = F.sum("bytes").over(Window.partitionBy("recording_id", "track").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1))
    rows = chunks.withColumn("_before", F.coalesce(before, F.lit(0))).join(offset.hint("merge"), ["recording_id", "track"], "left").fillna(0, ["offset_ms"])
    whole = F.floor(F.col("offset_ms") * F.col("sample_rate") / 1000) * F.col("channels") * 2
    return rows.withColumn("trim_bytes", F.least(F.col("bytes"), F.greatest(F.lit(0), whole - F.col("_before"))).cast("long")).drop("_before")


def sample_levels(samples: DataFrame) -> DataFrame:
    """Share of samples of 32,700 or more, and RMS in dBFS, by recording and chunk."""
    rms = F.sqrt(F.avg(F.pow(F.col("sample") / 32768.0, F.lit(2))))
    out = samples.groupBy("recording_id", "chunk_index").agg(F.avg((F.abs("sample") >= 32700).cast("int")).alias("clipped_ratio"), rms.alias("rms"))
    return out.select("recording_id", "chunk_index", "clipped_ratio", F.when(F.col("rms") > 0, F.greatest(20 * F.log10("rms"), F.lit(-120.0))).otherwise(-120.0).alias("rms_dbfs"))


def pcm_levels(chunks: DataFrame) -> DataFrame:
    """The same from 16-bit little-endian ``content``; the bytes go no further than this pass."""

    def level(batches):
        for pdf in batches:
            rows = []
            for content in pdf["content"]:
                x = np.frombuffer(content[: len(content) // 2 * 2], "<i2").astype(np.float64)
                power = float((x / 32768) @ (x / 32768)) / len(x) if len(x) else 0.0
                rows.append((float((np.abs(x) >= 32700).mean()) if len(x) else 0.0, max(10 * np.log10(power), -120.0) if power > 0 else -120.0))
            yield pdf.drop(columns="content").assign(clipped_ratio=[r[0] for r in rows], rms_dbfs=[r[1] for r in rows])

    keys = ", ".join(f"{n} {t}" for n, t in chunks.dtypes if n != "content")
    return chunks.mapInPandas(level, f"{keys}, clipped_ratio double, rms_dbfs double")


def quality_windows(chunks: DataFrame) -> DataFrame:
    """``start_ms`` and ``end_ms`` of each chunk from the longer of its two tracks."""
    ms = lambda b, rate, ch: F.when(rate * ch > 0, F.floor(b * 1000 / (rate * ch * 2))).otherwise(0)
    longest = F.greatest(ms(F.col("mic_bytes"), F.col("mic_rate"), F.col("mic_channels")), ms(F.col("system_bytes"), F.col("system_rate"), F.col("system_channels")))
    start = F.col("chunk_index").cast("long") * CHUNK_MS
    return chunks.withColumns({"start_ms": start, "end_ms": (start + longest).cast("long")})


# Thresholds, and the wording of warnings here and below, which stored reports hold and which
# are told apart by what stands before the colon.


def window_warnings(windows: DataFrame) -> DataFrame:
    """``recording_id, chunk_index, warning``: thresholds are compared as 32-bit floats."""
    f = lambda x: F.lit(x).cast("float")
    mic, mixed, a, b = (F.col(c).cast("float") for c in ("mic_clipped_ratio", "mixed_clipped_ratio", "mic_rms_dbfs", "system_rms_dbfs"))
    percent = lambda c: F.format_string("%.2f", c.cast("double") * 100)
    chunk = F.col("chunk_index").cast("string")
    clip = F.when(mic > f(0.03), F.concat(F.lit("mic_clipping: chunk "), chunk, F.lit(" has "), percent(mic), F.lit("% near-full-scale samples"))).when(
        mic > f(0.005), F.concat(F.lit("mic_clipping_advisory: chunk "), chunk, F.lit(" has "), percent(mic), F.lit("% near-full-scale samples"))
    )
    out = F.when(mixed > f(0.01), F.concat(F.lit("mixed_clipping: chunk "), chunk, F.lit(" has "), percent(mixed), F.lit("% near-full-scale output samples")))
    apart = F.abs(a - b)
    one = lambda c: F.format_string("%.1f", c.cast("double"))
    tilt = F.when((a > -60) & (b > -80) & (apart > 24), F.concat(F.lit("track_imbalance: chunk "), chunk, F.lit(" microphone/system RMS differs by "), one(apart), F.lit("dB ("), one(a), F.lit(" vs "), one(b), F.lit("dBFS)")))
    return windows.select("recording_id", "chunk_index", F.explode(F.array_compact(F.array(clip, out, tilt))).alias("warning"))


def overrun_warnings(reports: DataFrame) -> DataFrame:
    """``recording_id, dropped_ms, warning`` of recordings that lost bytes."""
    rate = F.col("sample_rate") * F.col("channels") * 2
    ms = F.when(rate > 0, F.floor(F.col("dropped_bytes") * 1000 / rate)).otherwise(0).cast("long")
    rows = reports.where("dropped_bytes > 0").withColumn("dropped_ms", ms)
    label = F.when(F.col("dropped_ms") > 250, "mic_overrun").otherwise("mic_overrun_advisory")
    text = F.concat(label, F.lit(": "), F.col("dropped_bytes").cast("string"), F.lit(" input bytes (~"), F.col("dropped_ms").cast("string"), F.lit("ms) were dropped before durable capture"))
    return rows.select("recording_id", "dropped_ms", text.alias("warning"))


def mic_gaps(windows: DataFrame) -> DataFrame:
    """``recording_id, chunk_index, warning`` of windows without microphone bytes.  The last window is
    excused if it is short and some window has microphone audio.  Aggregates per recording, so a long
    recording costs no sort."""
    facts = windows.groupBy("recording_id").agg(F.max("chunk_index").alias("last"), F.bool_or(F.col("mic_bytes") > 0).alias("any_mic"))
    gaps = windows.where("mic_bytes = 0").join(facts, "recording_id")
    excused = F.col("any_mic") & (F.col("chunk_index") == F.col("last")) & (F.col("end_ms") - F.col("start_ms") <= 5000)
    return gaps.select("recording_id", "chunk_index", F.concat(F.when(excused, "mic_missing_advisory").otherwise("mic_missing"), F.lit(": chunk "), F.col("chunk_index").cast("string"), F.lit(" has no microphone samples")).alias("warning"))


def is_advisory(warning: Column) -> Column:
    return starts_with_any(warning, L.ADVISORY)


def capture_review(warnings: DataFrame) -> DataFrame:
    """``recording_id, n_warnings, requires_review`` from warning rows."""
    return warnings.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_warnings"), F.bool_or(~is_advisory(F.col("warning"))).alias("requires_review"))


#: Advice for each kind of warning.
ADVICE = {
    "mic_clipping": "Lower the microphone gain.",
    "mixed_clipping": "Lower the output volume.",
    "mic_overrun": "Close other programs while recording.",
    "mic_missing": "Check that the right microphone is selected.",
}
DEFAULT_ADVICE = "Check the recording before you use its notes."


def capture_guidance(reports: DataFrame, advice: dict[str, str] = ADVICE, default: str = DEFAULT_ADVICE) -> DataFrame:
    """``recording_id, guidance``: distinct advice for the warnings that need review, in the order in
    which they are first seen; ``reports`` has ``warnings`` arrays."""
    grave = F.filter("warnings", lambda w: ~is_advisory(w))
    table = F.create_map(*[F.lit(x) for pair in advice.items() for x in pair])
    texts = F.array_distinct(F.transform(grave, lambda w: F.coalesce(F.try_element_at(table, F.substring_index(w, ":", 1)), F.lit(default))))
    return reports.select("recording_id", F.when(F.size(texts) > 0, F.array_join(texts, " ")).otherwise(default).alias("guidance"))


# The two filters of ITU-R BS.1770 at 48 kHz (b0, b1, b2, a1, a2).
K_WEIGHTING = (
    (1.53512485958697, -2.69169618940638, 1.19839281085285, -1.69065929318241, 0.73248077421585),
    (1.0, -2.0, 1.0, -1.99004745483398, 0.99007225036621),
)


def filtered(x: np.ndarray, coefficients, block: int = 128) -> np.ndarray:
    """A second-order filter over blocks of samples: in each block the output is the response to its own
    samples (one matrix product for all blocks) plus the response to the two state values before it, which
    alone run from block to block."""
    b0, b1, b2, a1, a2 = coefficients
    step, feed = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(block):
        powers.append(step @ powers[-1])
    response = np.array([b0, *(powers[k][0] @ feed for k in range(block - 1))])
    lag = np.subtract.outer(np.arange(block), np.arange(block))
    own = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
    to_state = np.stack([powers[block - 1 - k] @ feed for k in range(block)])
    from_state = np.stack([powers[k][0] for k in range(block)])
    rows = np.zeros(-(-len(x) // block) * block)
    rows[: len(x)] = x
    rows = rows.reshape(-1, block)
    given, states, state = rows @ to_state, np.empty((len(rows), 2)), np.zeros(2)
    for k in range(len(rows)):
        states[k] = state
        state = powers[block] @ state + given[k]
    return (rows @ own.T + states @ from_state.T).ravel()[: len(x)]


def weighted(x: np.ndarray) -> np.ndarray:
    for coefficients in K_WEIGHTING:
        x = filtered(x, coefficients)
    return x


def chunk_loudness(chunks: DataFrame) -> DataFrame:
    """``lufs`` of mono 48 kHz ``content``: null under 4,800 samples or 2,400 weighted samples above
    3e-4, or for silence."""

    def measure(batches):
        for pdf in batches:
            out = []
            for content in pdf["content"]:
                w = weighted(np.frombuffer(content[: len(content) // 2 * 2], "<i2") / 32768.0)
                active = w[np.abs(w) > 3e-4]
                power = float(np.mean(active**2)) if len(w) >= 4800 and len(active) >= 2400 else 0.0
                out.append(-0.691 + 10 * np.log10(power) if power > 1e-12 else None)
            yield pdf.drop(columns="content").assign(lufs=pd.array(out, dtype="Float64"))

    keys = ", ".join(f"{n} {t}" for n, t in chunks.dtypes if n != "content")
    return chunks.mapInPandas(measure, f"{keys}, lufs double")


# Target, lowest and highest change, and start in dB for each track.
GAINS = {"microphone": (-22.0, -18.0, 12.0, -9.0), "system": (-19.0, -12.0, 18.0, 3.0)}


def leveler_gain(loudness: DataFrame) -> DataFrame:
    """``recording_id, track, chunk_index, gain``: four tenths of the last gain and six of the wanted
    one, chunk after chunk; a null loudness holds."""
    pick = lambda i: F.when(F.col("track") == "system", GAINS["system"][i]).otherwise(GAINS["microphone"][i])
    # least and greatest skip nulls, so a null loudness is kept apart
    wanted = F.when(F.col("lufs").isNotNull(), F.pow(F.lit(10.0), F.least(pick(2), F.greatest(pick(1), pick(0) - F.col("lufs"))) / 20))
    rows = loudness.groupBy("recording_id", "track").agg(F.sort_array(F.collect_list(F.struct("chunk_index", wanted.alias("wanted")))).alias("w"))

    @F.pandas_udf("array<double>")
    def gains(wanted: pd.Series, start: pd.Series) -> pd.Series:
        return pd.Series([levelled(w, g) for w, g in zip(wanted, start)], dtype=object)

    folded = rows.select("recording_id", "track", F.transform("w", lambda x: x["chunk_index"].cast("bigint")).alias("chunk_index"), gains(F.transform("w", lambda x: x["wanted"]), F.pow(F.lit(10.0), pick(3) / 20)).alias("gain"))
    return folded.select("recording_id", "track", F.explode(F.arrays_zip("chunk_index", "gain")).alias("x")).select("recording_id", "track", "x.chunk_index", "x.gain")


def levelled(wanted, gain: float) -> list[float]:
    out = []
    for w in wanted:
        if w is not None and w == w:
            gain = 0.4 * gain + 0.6 * w
        out.append(gain)
    return out


IMAGES = ("png", "jpg", "jpeg", "webp", "gif")
DOCUMENTS = ("pdf", "md", "txt", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "csv")


def media_facts(files: DataFrame, bytes_per_second: int = 24_000) -> DataFrame:
    """``duration_ms, kind, safe_name, sha256`` of files with ``path, bytes, content``."""
    name = file_name(F.col("path"))
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin(*IMAGES), "image").when(ext.isin(*DOCUMENTS), "document")
    return files.select(
        "file_id", F.floor(F.col("bytes") * 1000 / bytes_per_second).cast("long").alias("duration_ms"), kind.alias("kind"), F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_").alias("safe_name"), F.sha2("content", 256).alias("sha256")
    )


def corpus_scorecard(recordings: DataFrame, windows: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row about the whole corpus; each input is read once."""
    long = lambda m: F.count_if(F.col("duration_ms") > m * 60_000)
    r = recordings.agg(F.count(F.lit(1)).alias("n_recordings"), F.round(F.sum("duration_ms") / 3_600_000, 2).alias("hours"), long(30).alias("over_30"), long(60).alias("over_60"), F.round(F.max("duration_ms") / 60_000, 1).alias("longest_min"))
    apart = F.abs(F.col("mic_rms_dbfs") - F.col("system_rms_dbfs"))
    w = windows.agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(apart > 12).alias("over_12_db"), F.count_if(F.col("mic_clipped_ratio") >= F.lit(0.005).cast("float")).alias("clipping"), F.count_distinct("recording_id").alias("with_windows"))
    a = attempts.agg(F.count(F.lit(1)).alias("n_attempts"), F.count_if(F.col("run_id").isNull()).alias("without_run"), F.count_if(~F.col("has_words")).alias("without_words"))
    one = F.lit(1)
    return r.withColumn("_k", one).join(w.withColumn("_k", one), "_k").join(a.withColumn("_k", one), "_k").drop("_k")
