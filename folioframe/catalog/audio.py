"""Registered transcript queries (AU)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audio as A
from .registry import query


# every event of a user is a segment of the user's recording
def segments(t):
    start = F.col("event_id").cast("double")
    return t.events.select(F.col("user_id").alias("audio_id"), start.alias("start"), (start + F.col("value")).alias("end"),
                           F.when(F.col("event_type") == "error", " ").otherwise(F.concat(F.lit(" "), "event_type")).alias("text"))


@query("au1_transcript_range", """WITH s AS (SELECT user_id AS a, event_id::DOUBLE AS b, event_id + value AS e FROM events),
w AS (SELECT DISTINCT user_id AS a, user_id * 3.0 AS ws, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN user_id * 30.0 ELSE user_id * 3.0 - 1 END AS we FROM events)
SELECT a AS audio_id, b AS "start" FROM s JOIN w USING (a) WHERE (we IS NULL OR we >= ws) AND e >= ws AND (we IS NULL OR b <= we)""")
def au1(t):
    u = F.col("user_id")
    windows = t.events.select(u.alias("audio_id"), (u * 3.0).alias("w_start"), F.when(u % 3 == 1, u * 30.0).when(u % 3 == 2, u * 3.0 - 1).alias("w_end")).distinct()
    return A.transcript_range(segments(t), windows).select("audio_id", "start")


def stored(t):
    """Each event stores two segments, the second a minute and a half later."""
    start = F.col("event_id").cast("double")
    seg = lambda s, text: F.struct(s.alias("start"), (s + F.col("value")).alias("end"), text.alias("text"))
    kind = F.when(F.col("event_type") == "error", " ").otherwise(F.concat(F.lit(" "), "event_type"))
    return t.events.select("event_id", "event_type", "value", F.array(seg(start, kind), seg(start + 90, kind)).alias("segments"))


def code(x):
    return f"CASE WHEN trunc({x})::BIGINT >= 3600 THEN format('{{:02d}}:{{:02d}}:{{:02d}}', trunc({x})::BIGINT // 3600, trunc({x})::BIGINT // 60 % 60, trunc({x})::BIGINT % 60) ELSE format('{{:02d}}:{{:02d}}', trunc({x})::BIGINT // 60, trunc({x})::BIGINT % 60) END"


@query("au2_timestamped_transcript", f"""SELECT event_id, CASE WHEN event_type = 'error' THEN 'raw' ELSE '[' || {code('event_id')} || '-' || {code('event_id + value')} || '] ' || event_type || chr(10) ||
  '[' || {code('event_id + 90')} || '-' || {code('event_id + 90 + value')} || '] ' || event_type END AS transcript FROM events""")
def au2(t):
    return stored(t).select("event_id", A.timestamped_transcript("segments", F.lit("raw")).alias("transcript"))


@query("au3_normalize_asr", """SELECT event_id AS audio_id, CASE WHEN event_type = 'view' THEN 0 ELSE 2 END AS n_segments, CASE event_type WHEN 'view' THEN 'spoken' WHEN 'click' THEN ' click click' ELSE ' ' || trim(CASE WHEN event_type = 'error' THEN '' ELSE event_type END) || '  ' || trim(CASE WHEN event_type = 'error' THEN '' ELSE event_type END) END AS transcription,
  CASE WHEN event_type = 'view' THEN 'auto' ELSE 'de' END AS language, CASE WHEN event_type = 'click' THEN round(event_id / 1000.0, 6) WHEN event_type <> 'view' THEN event_id::DOUBLE END AS first_start FROM events""")
def au3(t):
    kind = F.when(F.col("event_type") == "view", "mimo").when(F.col("event_type") == "click", "dashscope").otherwise("whisper")
    rows = stored(t).select(F.col("event_id").alias("audio_id"), kind.alias("provider"), "segments", F.lit(" spoken ").alias("text"), F.lit("de").alias("language"),
                            F.col("value").alias("duration"), (F.col("value") / 4).alias("transcribe_time"))
    return A.normalize_asr(rows).select("audio_id", F.size("segments").alias("n_segments"), "transcription", "language",
                                        F.round(F.get("segments", F.lit(0))["start"], 6).alias("first_start"))


@query("au4_rtf", "SELECT event_id AS audio_id, CASE WHEN event_type <> 'error' AND value > 0 THEN round(event_id / value, 6) ELSE 0.0 END AS rtf FROM events")
def au4(t):
    rows = t.events.select(F.col("event_id").alias("audio_id"), F.col("event_id").cast("double").alias("s"), F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("d"))
    return rows.select("audio_id", F.round(A.rtf("s", "d"), 6).alias("rtf"))


@query("au5_audio_upsert", """WITH e AS (SELECT min(p_partkey) AS audio_id, 'a' || p_size AS stem FROM part WHERE p_brand <> 'Brand#11' GROUP BY 2)
SELECT s_suppkey AS item, audio_id, CASE WHEN audio_id IS NULL THEN 'created' ELSE 'replaced' END AS action FROM supplier LEFT JOIN e ON stem = 'a' || s_suppkey""")
def au5(t):
    existing = t.part.select(F.col("p_partkey").alias("audio_id"), F.concat(
        F.lit("a"), F.col("p_size").cast("string"), F.when(F.col("p_brand") == "Brand#11", ".txt").otherwise(".MP3")).alias("filename"))
    batch = t.supplier.select(F.col("s_suppkey").alias("file_size"), F.concat(F.lit("a"), F.col("s_suppkey").cast("string"), F.lit(".wav")).alias("filename"), F.lit(1.0).alias("duration"))
    return A.audio_upsert(existing, batch).select(F.col("file_size").alias("item"), "audio_id", "action")
