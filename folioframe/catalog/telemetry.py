"""Registered telemetry queries (OB)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches as K
from ..operators import telemetry as O
from ..session import materialize
from .data import CALLS, TIMELINE, model_calls, timeline
from .registry import query


@query("ob1_stage_timings", f"WITH {TIMELINE} SELECT request_id, stage, count(*) AS count, round(sum(round(duration_ms, 3)), 3) AS total_ms, max(round(duration_ms, 3)) AS max_ms FROM tl GROUP BY ALL")
def ob1(t):
    return O.stage_timings(timeline(t)).withColumn("total_ms", F.round("total_ms", 3))


# sketches are stored by stage and hour; a day is merged from them, its quantiles are exact
@query("ob1_stage_quantiles", f"WITH {TIMELINE} SELECT stage, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95 FROM tl GROUP BY ALL")
def ob1q(t):
    rows = timeline(t).select("stage", F.col("ts").cast("timestamp").alias("ts"), "duration_ms")
    kept = materialize(K.hourly_sketches(rows, ["stage"], "ts", "duration_ms"), "sketches")
    days = K.merge_sketches(kept, ["stage"], "1 day").withColumnRenamed("window_start", "day")
    values = rows.withColumn("day", F.date_trunc("day", "ts"))
    exact = K.exact_quantiles(values, days, ["stage", "day"], "duration_ms", {"p50": 0.5, "p95": 0.95})
    return days.select("stage", "day", "n").join(exact, ["stage", "day"])


def json_runs(t):
    """Every event as a run with a JSON timeline of two items; errors leave none."""
    return timeline(t).select(F.col("sequence").alias("request_id"), F.when(F.col("status") != "failed", F.to_json(F.array(
        F.struct("stage", "status", "duration_ms"), F.struct(F.lit("agent.total").alias("stage"), F.lit("completed").alias("status"),
                                                             (F.col("duration_ms") + 1).alias("duration_ms"))))).alias("timeline"))


@query("ob2_timeline_rows", f"""WITH {TIMELINE} SELECT sequence AS request_id, 0 AS pos, stage, round(duration_ms, 4) AS duration_ms FROM tl WHERE status <> 'failed' UNION ALL SELECT sequence, 1, 'agent.total', round(duration_ms + 1, 4) FROM tl WHERE status <> 'failed'
UNION ALL SELECT sequence, NULL, NULL, NULL FROM tl WHERE status = 'failed'""")
def ob2(t):
    return O.timeline_rows(json_runs(t)).select("request_id", "pos", "stage", F.round("duration_ms", 4).alias("duration_ms"))


NORMAL = f"""{TIMELINE}, {CALLS}, nb AS (SELECT *, greatest(0, coalesce(token_budget, 1024)) AS tb FROM calls),
nc AS (SELECT request_id, sequence, operation, prompt_tokens, completion_tokens, total_tokens, tb AS token_budget, greatest(0, tb - completion_tokens) AS token_remaining,
  16000 - tb AS input_budget, greatest(0, 16000 - tb - prompt_tokens) AS input_remaining, 16000 AS context_window_tokens, fallback_used, truncated, duration_ms FROM nb)"""


def normal(t):
    return O.normalized_calls(model_calls(t))


@query("ob5_normalized_calls", f"WITH {NORMAL} SELECT sequence, token_budget, token_remaining, input_budget, input_remaining, context_window_tokens FROM nc")
def ob5(t):
    return normal(t).select("sequence", "token_budget", "token_remaining", "input_budget", "input_remaining", "context_window_tokens")


RATES = {"input": 0.5, "output": 1.5, "fallback_input": 2.0, "fallback_output": 6.0}
COST = "(prompt_tokens * CASE WHEN fallback_used THEN 2.0 ELSE 0.5 END + completion_tokens * CASE WHEN fallback_used THEN 6.0 ELSE 1.5 END) / 1e6"


@query("ob4_call_cost", f"WITH {NORMAL} SELECT sequence, round(({COST})::DOUBLE, 8) AS cost FROM nc")
def ob4(t):
    return normal(t).select("sequence", F.round(O.call_cost("prompt_tokens", "completion_tokens", "fallback_used", RATES), 8).alias("cost"))


USAGE = f"""{NORMAL}, us AS (SELECT request_id, count(*) AS call_count, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(total_tokens)::BIGINT AS total_tokens,
  sum(token_budget)::BIGINT AS output_token_budget, sum(token_remaining)::BIGINT AS output_token_remaining, sum(input_budget)::BIGINT AS input_token_budget, sum(input_remaining)::BIGINT AS input_token_remaining,
  sum(context_window_tokens)::BIGINT AS context_window_tokens, round(sum(round(({COST})::DOUBLE, 8)), 8) AS estimated_cost, bool_or(fallback_used) AS fallback_used, bool_or(truncated) AS truncated FROM nc GROUP BY 1)"""


def usage(t):
    calls = normal(t).withColumn("estimated_cost", F.round(O.call_cost("prompt_tokens", "completion_tokens", "fallback_used", RATES), 8))
    return O.model_usage(calls).withColumn("estimated_cost", F.round("estimated_cost", 8))


@query("ob3_model_usage", f"WITH {USAGE} SELECT * FROM us")
def ob3(t):
    return usage(t)


def runs(t):
    """One row per request of the timeline with totals standing for what a run row stores."""
    return timeline(t).groupBy("request_id", "session_id").agg(
        F.max("ts").alias("updated_at"), F.min("ts").alias("created_at"), F.sum("duration_ms").alias("execution_time_ms"),
        F.sum("k").alias("rag_budget"), F.count("*").alias("n"), F.max_by("stage", "sequence").alias("last_stage"), F.max_by("k", "sequence").alias("last_k"))


RUNS = """rn AS (SELECT request_id, session_id, max(ts) AS updated_at, min(ts) AS created_at, sum(duration_ms) AS execution_time_ms, sum(k)::BIGINT AS rag_budget, count(*) AS n,
  arg_max(stage, sequence) AS last_stage, arg_max(k, sequence) AS last_k FROM tl GROUP BY 1, 2)"""


@query("ob6_token_budget", f"""WITH {USAGE}, {RUNS}, s AS (SELECT *, CASE WHEN last_stage = 'agent.plan' THEN 0 WHEN last_stage = 'llm.answer' THEN 5000 END AS sb FROM rn)
SELECT request_id, CASE WHEN last_stage = 'llm.answer' THEN 5000 ELSE output_token_budget END AS output_budget, CASE WHEN last_stage = 'llm.answer' THEN 17 ELSE completion_tokens END AS output_used,
  input_token_budget AS input_budget, greatest(0, input_token_budget - prompt_tokens) AS input_remaining, rag_budget, n * 30 AS rag_used, greatest(0, rag_budget - n * 30) AS rag_remaining, last_stage = 'llm.answer' AS from_snapshot
FROM s JOIN us USING (request_id)""")
def ob6(t):
    r = runs(t).select("request_id", "rag_budget", (F.col("n") * 30).alias("rag_used"), F.lit(False).alias("rag_truncated"),
                       F.when(F.col("last_stage") == "agent.plan", 0).when(F.col("last_stage") == "llm.answer", 5000).cast("long").alias("stored_output_budget"),
                       F.lit(17).cast("long").alias("stored_output_used"))
    return O.token_budget(r, usage(t)).select("request_id", "output_budget", "output_used", "input_budget", "input_remaining",
                                              "rag_budget", "rag_used", "rag_remaining", "from_snapshot")


@query("ob7_context_usage", f"WITH {TIMELINE} SELECT sequence, CASE WHEN n > 1 THEN stage || '#' || n ELSE stage END AS stage_key FROM (SELECT *, row_number() OVER (PARTITION BY session_id, stage ORDER BY sequence) AS n FROM tl)")
def ob7(t):
    rows = timeline(t).select(F.col("session_id").alias("request_id"), "stage", "sequence")
    return O.context_usage(rows).select("sequence", "stage_key")


def quality_runs(t):
    stored = F.to_json(F.struct(F.lit(0.9).alias("confidence"), F.lit("sufficient").alias("evidence_status"), (F.col("last_k") / 100).alias("evidence_score"),
                                F.col("n").alias("evidence_source_count")))
    return runs(t).select("request_id", F.when(F.col("last_stage") == "llm.answer", stored).alias("answer_quality"),
                          (F.col("rag_budget") / 10).alias("stat_evidence_score"), F.lit(None).cast("long").alias("stat_source_count"))


QUALITY = """ql AS (SELECT request_id, CASE WHEN last_stage = 'llm.answer' THEN 0.9::DOUBLE END AS confidence, CASE WHEN last_stage = 'llm.answer' THEN 'sufficient' ELSE 'not_applicable' END AS evidence_status,
  round(CASE WHEN last_stage = 'llm.answer' THEN last_k / 100 ELSE rag_budget / 10 END, 6) AS evidence_score, CASE WHEN last_stage = 'llm.answer' THEN n ELSE 0 END AS evidence_source_count FROM rn)"""


@query("ob8_answer_quality", f"WITH {TIMELINE}, {RUNS}, {QUALITY} SELECT * FROM ql")
def ob8(t):
    return O.answer_quality(quality_runs(t)).drop("evidence_reason").withColumn("evidence_score", F.round("evidence_score", 6))


@query("ob9_recent_runs", f"""WITH {TIMELINE}, {RUNS} SELECT request_id, coalesce(CASE WHEN session_id % 3 > 0 THEN 'Session ' || session_id END, 'ask ' || last_stage) AS conversation_title, round(execution_time_ms, 4) AS total_ms
FROM rn WHERE (session_id % 3 > 0 AND 'Session ' || session_id ILIKE '%s_on 1%') OR 'ask ' || last_stage ILIKE '%s_on 1%' ORDER BY updated_at DESC, created_at DESC, request_id LIMIT 30""")
def ob9(t):
    r = runs(t).select("request_id", "session_id", F.concat(F.lit("ask "), "last_stage").alias("query"), F.lit("completed").alias("status"), "execution_time_ms",
                       F.lit(None).cast("timestamp").alias("completed_at"), "updated_at", "created_at", F.lit(None).cast("string").alias("error"))
    sessions = t.events.select(F.col("user_id").alias("session_id")).distinct().filter("session_id % 3 > 0").withColumn(
        "title", F.concat(F.lit("Session "), F.col("session_id").cast("string")))
    return O.recent_runs(r, sessions, "S_on 1", 30).select("request_id", "conversation_title", F.round("total_ms", 4).alias("total_ms"))


STATUS = "CASE last_stage WHEN 'agent.evidence' THEN 'failed' WHEN 'agent.plan' THEN 'cancelled' WHEN 'retrieval.bm25' THEN 'timed_out' ELSE 'completed' END"


def run_status_col():
    s = F.col("last_stage")
    return F.when(s == "agent.evidence", "failed").when(s == "agent.plan", "cancelled").when(s == "retrieval.bm25", "timed_out").otherwise("completed")


def error_timeline(t):
    return timeline(t).select("request_id", F.col("sequence").alias("pos"), "stage", F.when(F.col("status") == "failed", F.concat(F.lit("E"), F.col("k").cast("string"))).alias("error_code"))


ERRORS = "er AS (SELECT request_id, max(sequence) AS pos, arg_max(stage, sequence) AS stage, 'E' || arg_max(k, sequence) AS error_code FROM tl WHERE status = 'failed' GROUP BY 1)"


@query("ob10_run_trace", f"""WITH {USAGE}, {RUNS}, {QUALITY}, {ERRORS} SELECT request_id, {STATUS} AS status, CASE {STATUS} WHEN 'completed' THEN 200 WHEN 'cancelled' THEN 499 WHEN 'timed_out' THEN 504 ELSE 500 END::BIGINT AS status_code,
  call_count, us.total_tokens AS total_tokens, evidence_status, error_code AS last_error FROM rn JOIN us USING (request_id) JOIN ql USING (request_id) LEFT JOIN er USING (request_id)""")
def ob10(t):
    r = runs(t).withColumn("status", run_status_col()).select("request_id", "status")
    return O.run_trace(r, usage(t), O.answer_quality(quality_runs(t)), O.trace_error(error_timeline(t))).select(
        "request_id", "status", "status_code", "call_count", "total_tokens", "evidence_status", "last_error")


STAGE_LIST = ["agent.plan", "agent.fast_path", "agent.query_rewrite", "retrieval.embedding", "retrieval.bm25", "retrieval.recall", "retrieval.fusion",
              "retrieval.fetch_chunks", "retrieval.rerank", "agent.crag_grade", "agent.evidence", "agent.generation", "llm.answer", "agent.total", "other"]


def facts_sql(**facts):
    """Facts of a map as ``name=value`` in the order of the names; null values are left out."""
    return "concat_ws(';', " + ", ".join(f"'{k}=' || ({v})::VARCHAR" for k, v in sorted(facts.items())) + ")"


@query("ob11_enrich_timeline", f"""WITH {USAGE}, {RUNS}, {QUALITY}, st AS (SELECT *, [{', '.join(repr(s) for s in STAGE_LIST)}][k % {len(STAGE_LIST)} + 1] AS st FROM tl),
l AS (SELECT request_id, sequence, row_number() OVER (PARTITION BY request_id ORDER BY sequence) AS n FROM st WHERE st = 'llm.answer'),
c AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY sequence) AS i FROM nc)
SELECT st.sequence, st AS stage, CASE WHEN k % 10 = 0 THEN NULL WHEN st = 'agent.plan' THEN {facts_sql(intent="'search'", recording_note="'旧记录未保存计划步骤'")}
  WHEN st = 'agent.fast_path' THEN {facts_sql(mode="'fast_path'", planner_skipped="'true'")}
  WHEN st = 'agent.query_rewrite' THEN {facts_sql(retrieval_query="'q' || rn.n", query_count="2", rewritten_queries="CASE WHEN rn.n % 3 = 0 THEN 'a,b' END", recording_note="CASE WHEN rn.n % 3 <> 0 THEN '旧记录未保存改写文本' END")}
  WHEN st = 'retrieval.embedding' THEN {facts_sql(hits="rn.n + 1")} WHEN st = 'retrieval.bm25' THEN {facts_sql(hits="rn.n")}
  WHEN st = 'retrieval.recall' THEN {facts_sql(query_count="2", bm25_hits="rn.n", embedding_hits="rn.n + 1", fused_candidates="rn.n + 2", reranked_candidates="rn.n + 3", selected_results="rn.n + 4")}
  WHEN st = 'retrieval.fusion' THEN {facts_sql(fused_candidates="rn.n + 2")} WHEN st = 'retrieval.fetch_chunks' THEN {facts_sql(fetched_candidates="rn.n + 3")}
  WHEN st = 'retrieval.rerank' THEN {facts_sql(candidates="rn.n + 3", selected="CASE WHEN rn.n % 2 = 0 THEN rn.n + 5 ELSE rn.n + 4 END", recording_note="'旧记录未保存保留文档明细'")}
  WHEN st = 'agent.crag_grade' THEN {facts_sql(action="'refine'", kept="rn.n")}
  WHEN st = 'agent.evidence' AND evidence_status = 'not_applicable' THEN {facts_sql(recording_note="'旧记录未保存证据门禁结果'")}
  WHEN st = 'agent.evidence' THEN {facts_sql(evidence_status="evidence_status", evidence_source_count="evidence_source_count")}
  WHEN st = 'agent.generation' THEN {facts_sql(answer_generated="CASE WHEN rn.n % 2 = 0 THEN 'true' ELSE 'false' END", source_count="CASE WHEN rn.n % 3 = 0 THEN rn.n END", recording_note="'旧记录未保存引用明细'")}
  WHEN st LIKE 'llm.%' AND c.i IS NOT NULL THEN {facts_sql(operation="c.operation", total_tokens="c.total_tokens", prompt_tokens="c.prompt_tokens", completion_tokens="c.completion_tokens", token_budget="c.token_budget", token_remaining="c.token_remaining", input_budget="c.input_budget", input_remaining="c.input_remaining", model="'m' || c.prompt_tokens", success="CASE WHEN c.truncated THEN 'false' ELSE 'true' END", finish_reason="CASE WHEN c.truncated THEN 'length' END")}
  WHEN st = 'agent.total' THEN {facts_sql(total_ms="rn.n")} ELSE {facts_sql(recording_note="'旧记录仅保存了阶段耗时'")} END AS facts
FROM st JOIN rn USING (request_id) JOIN ql USING (request_id) LEFT JOIN l ON l.sequence = st.sequence LEFT JOIN c ON c.request_id = st.request_id AND c.i = l.n""")
def ob11(t):
    text = lambda c: c.cast("string")
    n = F.col("n")
    stats = {"query_count": F.lit(2), "bm25_hits": n, "embedding_hits": n + 1, "fused_candidates": n + 2, "reranked_candidates": n + 3, "selected_results": n + 4,
             "quality_filtered_candidates": F.when(n % 2 == 0, n + 5), "retrieval_query": F.concat(F.lit("q"), text(n)), "rewritten_queries": F.when(n % 3 == 0, F.lit("a,b"))}
    q = O.answer_quality(quality_runs(t)).select("request_id", F.map_filter(F.create_map(
        F.lit("evidence_status"), F.col("evidence_status"), F.lit("evidence_source_count"), text(F.col("evidence_source_count"))), lambda _, v: v.isNotNull()).alias("quality"))
    r = runs(t).select("request_id", F.lit("search").alias("intent"), text(n).alias("execution_time_ms"),
                       F.map_filter(F.create_map(*[x for k, v in stats.items() for x in (F.lit(k), text(v))]), lambda _, v: v.isNotNull()).alias("stats"),
                       F.create_map(F.lit("action"), F.lit("refine"), F.lit("kept"), text(n)).alias("crag"), (n % 2 == 0).alias("answered"),
                       F.when(n % 3 == 0, n).alias("source_count")).join(q, "request_id")
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGE_LIST]), (F.col("k") % len(STAGE_LIST) + 1).cast("int"))
    rows = timeline(t).select("request_id", "sequence", stage.alias("stage"), (F.col("k") % 10 == 0).alias("has_result"))
    calls = normal(t).drop("duration_ms").withColumns({"model": F.concat(F.lit("m"), text(F.col("prompt_tokens"))), "success": ~F.col("truncated"), "finish_reason": F.when(F.col("truncated"), "length")})
    facts = F.array_join(F.transform(F.array_sort(F.map_entries(F.map_filter("result", lambda _, v: v.isNotNull()))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return O.enrich_timeline(rows, r, calls).select("sequence", "stage", facts.alias("facts"))


@query("ob12_trace_error", f"WITH {TIMELINE}, {ERRORS} SELECT * FROM er")
def ob12(t):
    return O.trace_error(error_timeline(t))


@query("ob13_recent_traces", f"WITH {TIMELINE}, {RUNS} SELECT request_id, updated_at AS completed_at FROM rn WHERE last_stage <> 'agent.plan' ORDER BY updated_at DESC, request_id LIMIT 500")
def ob13(t):
    traces = runs(t).select("request_id", F.col("updated_at").alias("completed_at"), F.when(F.col("last_stage") == "agent.plan", "http").otherwise("agent").alias("trace_type"))
    return O.recent_traces(traces, 1000).select("request_id", "completed_at")


@query("ob14_run_status", """SELECT event_id, CASE WHEN value > 20 OR event_type IN ('view', 'click') THEN 'completed' ELSE 'failed' END AS status FROM events""")
def ob14(t):
    rows = t.events.select("event_id", F.when(F.col("value") > 20, F.col("value")).otherwise(0.0).alias("confidence"),
                           F.when(F.col("event_type") == "view", "sufficient").when(F.col("event_type") == "click", "insufficient").otherwise("x").alias("evidence_status"))
    return rows.select("event_id", O.run_status("confidence", "evidence_status").alias("status"))


@query("ob15_stage_errors", f"WITH {TIMELINE} SELECT sequence, 'AGENT_EXECUTION_ERROR' AS code, 'evidence' AS operation, false AS retryable, 'token failed, password=[REDACTED]' AS message FROM tl WHERE status = 'failed'")
def ob15(t):
    rows = timeline(t).withColumn("message", F.concat(F.lit("token failed, password="), F.col("k").cast("string")))
    return O.stage_errors(rows).select("sequence", "code", "operation", "retryable", "message")


@query("ob15_error_counts", f"WITH {TIMELINE} SELECT 'AGENT_EXECUTION_ERROR' AS code, count(*) AS n FROM tl WHERE status = 'failed'")
def ob15c(t):
    return O.error_counts(O.stage_errors(timeline(t).withColumn("message", F.lit(""))))


@query("ob16_tool_usage", f"""WITH {TIMELINE} SELECT request_id, count(*) AS steps, sum(k * 50)::BIGINT AS tool_used, count(*) * 4000 AS tool_budget, greatest(0, count(*) * 4000 - sum(k * 50))::BIGINT AS tool_remaining,
  bool_or(k > 90) AS truncated, count(*) FILTER (status = 'completed') AS succeeded, bool_and(status = 'completed') AS all_succeeded FROM tl GROUP BY 1""")
def ob16(t):
    return O.tool_usage(timeline(t).select("request_id", (F.col("k") * 50).alias("context_tokens"), (F.col("k") > 90).alias("context_truncated"),
                                           (F.col("status") == "completed").alias("success")))


@query("ob17_evaluate_steps", f"""WITH {TIMELINE}, r AS (SELECT request_id, count(*) FILTER (stage IN ('agent.evidence', 'retrieval.rerank')) AS f, count(*) FILTER (stage = 'agent.plan' OR (stage = 'llm.answer' AND k % 2 = 0)) AS e FROM tl GROUP BY 1)
SELECT request_id, f AS failed_steps, e AS empty_steps, f = 0 AND e = 0 AS successful FROM r""")
def ob17(t):
    s = F.col("stage")
    payload = (F.when(s == "retrieval.rerank", '{"success": false, "error": "x"}').when(s == "agent.plan", '{"results": {"items": []}}')
               .when((s == "llm.answer") & (F.col("k") % 2 == 0), '"  "').otherwise('{"results": [1]}'))
    results = timeline(t).select("request_id", F.col("sequence").alias("step_id"), (F.col("status") == "completed").alias("success"), payload.alias("payload"), F.lit("").alias("error_message"))
    r = runs(t).select("request_id", F.lit(True).alias("success"), F.col("n").alias("completed_steps"), F.col("n").alias("total_steps"))
    return O.evaluate_steps(results, r)


def events(t):
    s = F.col("stage")
    return timeline(t).select("request_id", "sequence", F.when(s == "llm.answer", "run_completed").when(s == "agent.plan", "token").otherwise("stage_completed").alias("type"),
                              F.when(F.col("k") > 20, F.concat(F.lit("answer "), F.col("k").cast("string"))).alias("response"))


@query("ob18_final_response", f"""WITH {TIMELINE}, f AS (SELECT request_id, 'answer ' || arg_max(k, sequence) AS r FROM tl WHERE stage = 'llm.answer' AND k > 20 GROUP BY 1)
SELECT DISTINCT tl.request_id, coalesce(r, 'none') AS response, r IS NOT NULL AS from_event FROM tl LEFT JOIN f USING (request_id)""")
def ob18(t):
    return O.final_response(events(t), runs(t).select("request_id", F.lit("none").alias("response")))


@query("ob19_events_after", f"""WITH {TIMELINE}, {RUNS}, c AS (SELECT request_id, min(sequence) AS cursor FROM tl GROUP BY 1) SELECT tl.request_id, sequence FROM tl JOIN c USING (request_id) WHERE stage <> 'agent.plan' AND sequence > cursor""")
def ob19(t):
    cursors = timeline(t).groupBy("request_id").agg(F.min("sequence").alias("cursor"))
    return O.events_after(events(t), cursors).select("request_id", "sequence")


@query("ob20_active_conflicts", f"WITH {TIMELINE}, {RUNS} SELECT session_id, count(*) FILTER (last_stage IN ('agent.plan', 'llm.answer')) AS active_runs FROM rn GROUP BY 1 HAVING count(*) FILTER (last_stage IN ('agent.plan', 'llm.answer')) > 1")
def ob20(t):
    s = F.col("last_stage")
    return O.active_conflicts(runs(t).withColumn("status", F.when(s == "agent.plan", "pending").when(s == "llm.answer", "running").otherwise("completed")))
