"""Registered streaming queries (ST): the tables are read as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sketches import exact_quantiles
from ..streaming import streams as S
from .chunks import UNITS
from .data import markdown
from .ranking import GATE_ROWS
from .registry import query


def stream(t, name):
    return S.file_stream(t.spark, t.dir, f"{name}.parquet", getattr(t, name).schema)


def runs(source):
    return source.select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
                         F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").alias("duration_ms"))


def run_events(t, source):
    kind = F.col("event_type")
    return source.select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("run_id"), F.col("event_id").alias("sequence"),
                         F.when(kind == "purchase", "run_completed").when(kind == "error", "run_failed").when(kind == "signup", "token").otherwise("stage").alias("type"),
                         F.when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("running").alias("status"), F.col("ts").cast("timestamp").alias("ts"))


@query("st1_stream_index", f"""WITH RECURSIVE {UNITS} SELECT 'page:' || doc_id || ':revision:1:chunk:' || chunk_index || CASE WHEN child_index >= 0 THEN ':child:' || child_index ELSE '' END AS chunk_id, md5(unit.text) AS text FROM unit""")
def st1(t):
    pages = stream(t, "documents").select(F.col("doc_id").alias("page_id"), F.lit(1).alias("revision"), F.concat(F.lit("Page "), "source").alias("title"), markdown().alias("content"))
    return S.current_chunks(S.stream_index(pages)).select("chunk_id", F.md5("text").alias("text"))


@query("st2_stream_events", "SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS run_id, event_id AS sequence FROM events WHERE event_type <> 'signup'")
def st2(t):
    # the log is delivered twice
    twice = run_events(t, stream(t, "events")).unionByName(run_events(t, stream(t, "events")))
    return S.run_available(S.stream_events(twice)).select("run_id", "sequence")


# runs of every third user were read up to their first event before; the log is delivered twice
@query("st2_stream_run_log", """WITH e AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS run_id, user_id, event_id, event_type FROM events),
c AS (SELECT run_id, min(event_id) AS cursor FROM e WHERE user_id % 3 = 0 GROUP BY 1), r AS (SELECT e.*, cursor FROM e LEFT JOIN c USING (run_id) WHERE event_type <> 'signup' AND event_id > coalesce(cursor, -1)),
t AS (SELECT run_id, min(event_id) AS ended FROM r WHERE event_type IN ('purchase', 'error') GROUP BY 1)
SELECT run_id, event_id AS sequence FROM r LEFT JOIN t USING (run_id) WHERE ended IS NULL OR event_id <= ended""")
def st2l(t):
    twice = run_events(t, stream(t, "events")).unionByName(run_events(t, stream(t, "events")))
    read = run_events(t, t.events.filter("user_id % 3 = 0")).groupBy("run_id").agg(F.min("sequence").alias("cursor"))
    return S.run_available(S.stream_run_log(twice, read)).select("run_id", "sequence")


@query("st3_stream_run_state", """WITH r AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS run_id, max(event_id) AS last_sequence, arg_max(event_type, event_id) AS t, bool_or(event_type IN ('purchase', 'error')) AS ended,
  min(ts) AS s FROM events GROUP BY 1), m AS (SELECT max(ts) AS w FROM events)
SELECT run_id, last_sequence, CASE WHEN NOT ended AND s + INTERVAL 180 SECONDS < w THEN 'timed_out' WHEN t = 'purchase' THEN 'completed' WHEN t = 'error' THEN 'failed' ELSE 'running' END AS status FROM r, m""")
def st3(t):
    return S.run_available(S.stream_run_state(run_events(t, stream(t, "events"))), "update").select("run_id", "last_sequence", "status")


@query("st4_stream_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 24 HOURS THEN 0 ELSE 1 END AS n FROM events),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e), a AS (SELECT user_id, s, count(*) AS message_count, min(ts) AS started_at, max(ts) AS updated_at FROM g GROUP BY 1, 2)
SELECT user_id AS session_id, message_count, started_at, updated_at FROM a WHERE updated_at + INTERVAL 24 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def st4(t):
    messages = stream(t, "events").select(F.col("user_id").alias("session_id"), F.lit("user").alias("role"), F.col("event_type").alias("content"), F.col("ts").cast("timestamp").alias("ts"))
    return S.run_available(S.stream_sessions(messages)).select("session_id", "message_count", "started_at", "updated_at")


@query("st5_stream_dedupe", "SELECT DISTINCT user_id AS request_id FROM events")
def st5(t):
    feedback = stream(t, "events").select(F.col("user_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return S.run_available(S.stream_dedupe(feedback)).select("request_id")


@query("st6_stream_pending_expiry", """WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), d AS (SELECT user_id, ts AS decided_at, event_type FROM events WHERE event_type IN ('purchase', 'error'))
SELECT event_id AS action_id, coalesce(d.event_type, 'expired') AS outcome, decided_at FROM a LEFT JOIN d ON d.user_id = a.user_id AND decided_at >= ts AND decided_at <= ts + INTERVAL 1 HOUR
WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def st6(t):
    ts = F.col("ts").cast("timestamp")
    actions = stream(t, "events").filter("event_type = 'signup'").select(F.col("event_id").alias("action_id"), F.col("user_id").alias("key"), ts.alias("ts"))
    decisions = stream(t, "events").filter("event_type IN ('purchase', 'error')").select(F.col("user_id").alias("key"), ts.alias("decided_at"), F.col("event_type").alias("decision"))
    sink = S.run_available(S.stream_pending_expiry(actions, decisions))
    # the last day may still be open when the stream ends
    settled = t.events.agg((F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 1 DAY")).alias("_t"))
    return sink.join(F.broadcast(settled)).filter(F.col("ts") < F.col("_t")).select("action_id", "outcome", "decided_at")      # one row


@query("st7_stream_run_metrics", """SELECT date_trunc('hour', ts) AS window_start, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failures, max(value) AS max_ms, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS tokens
FROM events GROUP BY 1 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def st7(t):
    return S.run_available(S.stream_run_metrics(runs(stream(t, "events")))).select("window_start", "runs", "failures", "max_ms", "tokens")


@query("st7_stream_quantiles", """SELECT date_trunc('hour', ts) AS window_start, round(count(*) FILTER (event_type = 'error') / count(*), 9) AS failure_rate, quantile_disc(value, 0.95) AS p95_ms
FROM events GROUP BY 1 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def st7q(t):
    closed = S.run_available(S.stream_run_sketches(runs(stream(t, "events"))))
    rows = runs(t.events).select(F.date_trunc("hour", "ts").alias("window_start"), "duration_ms")
    p95 = exact_quantiles(rows, closed, ["window_start"], "duration_ms", {"p95_ms": 0.95})
    return closed.join(p95, "window_start").select("window_start", F.round(F.col("failures") / F.col("runs"), 9).alias("failure_rate"), "p95_ms")


@query("st8_stream_quality", f"""WITH g AS (SELECT query_id, count(*) FILTER (trim(content) <> '') AS rows, count(DISTINCT page_id) FILTER (trim(content) <> '') AS keys, max(coalesce(rerank_score, score)) FILTER (trim(content) <> '') AS best FROM ({GATE_ROWS}) GROUP BY 1)
SELECT query_id, CASE WHEN rows = 0 OR coalesce(best < 0.35, false) THEN 'insufficient' ELSE 'sufficient' END AS evidence_status, keys AS evidence_source_count FROM g""")
def st8(t):
    rows = stream(t, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.when(F.col("l_returnflag") == "N", "  ").otherwise("x").alias("content"), F.col("l_partkey").alias("page_id"),
        F.when(F.col("l_linestatus") == "F", F.col("l_discount") * 6).alias("rerank_score"), F.when(F.col("l_quantity") > 25, F.col("l_tax") * 6).alias("score"))
    return S.stream_quality(rows).select("query_id", "evidence_status", "evidence_source_count")
