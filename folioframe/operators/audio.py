"""Audio transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import strip
from ..functions.markdown import file_stem
from ..functions.text import format_timecode

SEGMENTS = "array<struct<start:double,end:double,text:string>>"


def transcript_range(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Segments (audio_id, start, end, text) overlapping windows (audio_id, w_start, w_end) as closed
    intervals; an open end reaches to the end, a window ending before it starts gives nothing."""
    ok = windows.filter(F.col("w_end").isNull() | (F.col("w_end") >= F.col("w_start")))
    return segments.join(ok, "audio_id").filter(
        (F.col("end") >= F.col("w_start")) & (F.col("w_end").isNull() | (F.col("start") <= F.col("w_end"))))


def timestamped_transcript(segments, content) -> Column:
    """``[from-to] text`` lines; the plain content when no segment has text."""
    segments = F.col(segments) if isinstance(segments, str) else segments
    content = F.col(content) if isinstance(content, str) else content
    lines = F.transform(F.filter(segments, lambda s: strip(s["text"]) != ""), lambda s: F.concat(
        F.lit("["), format_timecode(s["start"]), F.lit("-"), format_timecode(s["end"]), F.lit("] "), strip(s["text"])))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(content)


def rtf(seconds, duration) -> Column:
    """Processing time per second of audio, 0 without a duration."""
    s, d = F.col(seconds), F.col(duration)
    return F.when(d > 0, F.try_divide(s, d)).otherwise(F.lit(0.0))


def normalize_asr(results: DataFrame) -> DataFrame:
    """results (audio_id, provider, raw segments with begin/end/text, text, language, duration,
    transcribe_time) -> one schema. One provider counts milliseconds and joins without spaces, one
    seconds and spaces, one has no segments."""
    ms = F.col("provider") == "dashscope"
    segs = F.transform(F.coalesce("segments", F.array().cast(SEGMENTS)), lambda s: F.struct(
        (F.coalesce(s["start"], F.lit(0.0)) / F.when(ms, 1000.0).otherwise(1.0)).alias("start"),
        (F.coalesce(s["end"], F.lit(0.0)) / F.when(ms, 1000.0).otherwise(1.0)).alias("end"), s["text"].alias("text")))
    none = F.col("provider") == "mimo"
    texts = F.transform("segments", lambda s: F.coalesce(s["text"], F.lit("")))
    return results.select(
        "audio_id", "provider", F.when(none, F.array().cast(SEGMENTS)).otherwise(segs).alias("segments"),
        F.when(none, strip("text")).when(ms, F.array_join(texts, "")).otherwise(F.array_join(texts, " ")).alias("transcription"),
        F.when(none & ~F.coalesce(F.col("language").isin("zh", "en"), F.lit(False)), "auto").otherwise(F.col("language")).alias("language"),
        "duration", "transcribe_time", rtf("transcribe_time", "duration").alias("rtf"))


def audio_upsert(existing: DataFrame, batch: DataFrame, extensions: tuple = (".wav", ".mp3", ".m4a", ".flac", ".ogg", ".mp4", ".webm")) -> DataFrame:
    """batch (filename, file_size, duration) against existing (audio_id, filename, …): a file of the same
    stem and a known extension is replaced, its transcript fields cleared; others are new."""
    known = F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1)).isin(list(extensions))
    old = existing.filter(known).select("audio_id", file_stem("filename").alias("stem")).groupBy("stem").agg(F.min("audio_id").alias("audio_id"))
    return batch.withColumn("stem", file_stem("filename")).join(old, "stem", "left").select(
        "audio_id", "filename", "file_size", "duration", F.lit(None).cast("string").alias("transcription"),
        F.lit(None).cast("string").alias("language"), F.when(F.col("audio_id").isNull(), "created").otherwise("replaced").alias("action"))
