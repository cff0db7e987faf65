"""Run telemetry: timelines, model usage, token budgets, traces, event replay, step outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.text import classify_error, redact
from .skew import ordinal

TIMELINE_ITEM = "array<struct<stage:string,status:string,duration_ms:double,error_code:string,message:string,result:string>>"
# States in which a run has not ended, and notes for records without details.
NON_TERMINAL = ["pending", "running", "cancelling"]
NOTE_DURATION_ONLY = "旧记录仅保存了阶段耗时"
NOTE_NO_PLAN = "旧记录未保存计划步骤"
NOTE_NO_EVIDENCE = "旧记录未保存证据门禁结果"
NOTE_NO_REWRITES = "旧记录未保存改写文本"
NOTE_NO_DOCUMENTS = "旧记录未保存保留文档明细"
NOTE_NO_CITATIONS = "旧记录未保存引用明细"
# What a stage shows of the run's retrieval figures, as shown name and stored name.
STAGE_FIGURES = {
    "agent.query_rewrite": [("retrieval_query", "retrieval_query"), ("rewritten_queries", "rewritten_queries"), ("query_count", "query_count")],
    "retrieval.embedding": [("hits", "embedding_hits")],
    "retrieval.bm25": [("hits", "bm25_hits")],
    "retrieval.fusion": [("fused_candidates", "fused_candidates")],
    "retrieval.fetch_chunks": [("fetched_candidates", "reranked_candidates")],
    "retrieval.rerank": [("candidates", "reranked_candidates")],
}
RECALL_STAGES = ["retrieval.recall", "agent.retrieve"]
RECALL_FIGURES = ["query_count", "bm25_hits", "embedding_hits", "fused_candidates", "reranked_candidates",
                  "selected_results", "context_tokens", "token_budget"]
CALL_FIELDS = ["operation", "model", "total_tokens", "prompt_tokens", "completion_tokens", "duration_ms", "success",
               "finish_reason", "token_budget", "token_remaining", "input_budget", "input_remaining"]


def stage_timings(timeline: DataFrame) -> DataFrame:
    """Per request and stage: count, total and maximum; durations are rounded before they are summed."""
    ms = F.round("duration_ms", 3)
    return timeline.groupBy("request_id", "stage").agg(
        F.count("*").alias("count"), F.sum(ms).alias("total_ms"), F.max(ms).alias("max_ms"))


def timeline_rows(runs: DataFrame, column: str = "timeline") -> DataFrame:
    """One row per item of the JSON timeline, in order; runs without items keep one empty row."""
    return runs.select("request_id", F.posexplode_outer(F.from_json(column, TIMELINE_ITEM)).alias("pos", "i")).select(
        "request_id", "pos", "i.*")


# --- model calls and budgets ----------------------------------------------------------------

def call_cost(prompt, completion, fallback, rates: dict) -> Column:
    """Cost of a call; ``rates`` has input, output, fallback_input and fallback_output per million."""
    prompt, completion, fallback = F.col(prompt), F.col(completion), F.col(fallback)
    rate = lambda k: F.when(fallback, F.lit(float(rates[f"fallback_{k}"]))).otherwise(F.lit(float(rates[k])))
    return (prompt * rate("input") + completion * rate("output")) / 1_000_000


def default_output_budget(operation) -> Column:
    """Output budget that an operation had when a record does not say."""
    op = F.coalesce(F.col(operation), F.lit(""))
    return (F.when(op.isin("agent.plan", "agent.replan"), S.MAX_OUTPUT_TOKENS).when(op.endswith(".hyde"), 200)
            .when((op == "agent.query_rewrite") | op.startswith("agent.query_rewrite."), 300)
            .when(op == "agent.crag_grade", 700).when(op.startswith("agent.crag_refine"), 400)
            .when((op == "agent.generation") | op.startswith("agent.generation."), S.RESPONSE_OUTPUT_TOKENS)
            .otherwise(S.MAX_OUTPUT_TOKENS))


def normalized_calls(calls: DataFrame, window: int = S.CONTEXT_WINDOW) -> DataFrame:
    """Fill missing budgets and derive what remained of them, never below zero."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    budget = F.greatest(F.lit(0), F.coalesce("token_budget", default_output_budget("operation")))
    out = calls.withColumn("token_budget", budget).withColumn(
        "input_budget", F.greatest(F.lit(0), F.coalesce("input_budget", F.greatest(F.lit(0), F.lit(window) - F.col("token_budget")))))
    return out.withColumns({
        "context_window_tokens": F.when(zero("context_window_tokens") == 0, F.lit(window)).otherwise(F.col("context_window_tokens")),
        "token_remaining": F.greatest(F.lit(0), F.col("token_budget") - zero("completion_tokens")),
        "input_remaining": F.greatest(F.lit(0), F.col("input_budget") - zero("prompt_tokens"))})


def model_usage(calls: DataFrame) -> DataFrame:
    """Totals per request of normalised calls (with ``estimated_cost`` when given)."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    cost = F.round(total("estimated_cost"), 8) if "estimated_cost" in calls.columns else F.lit(0.0)
    return calls.groupBy("request_id").agg(
        F.count("*").alias("call_count"), total("prompt_tokens").alias("prompt_tokens"),
        total("completion_tokens").alias("completion_tokens"), total("total_tokens").alias("total_tokens"),
        total("token_budget").alias("output_token_budget"), total("token_remaining").alias("output_token_remaining"),
        total("input_budget").alias("input_token_budget"), total("input_remaining").alias("input_token_remaining"),
        total("context_window_tokens").alias("context_window_tokens"), cost.alias("estimated_cost"),
        F.max("fallback_used").alias("fallback_used"), F.max("truncated").alias("truncated"))


def token_budget(runs: DataFrame, usage: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """Budget, use and rest of output, input and retrieval context per run.

    runs: (request_id, rag_budget, rag_used, rag_truncated, stored_output_budget, stored_output_used).
    A stored snapshot wins unless its output budget is zero while one can be derived.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    j = runs.join(usage, "request_id", "left")
    if tools is not None:
        j = j.join(tools, "request_id", "left")
    derived = zero("output_token_budget")
    stored = F.col("stored_output_budget").isNotNull() & ~((zero("stored_output_budget") <= 0) & (derived > 0))
    out_b = F.when(stored, F.col("stored_output_budget")).otherwise(derived)
    out_u = F.when(stored, F.coalesce("stored_output_used", F.lit(0))).otherwise(zero("completion_tokens"))
    known = F.col("rag_budget").isNotNull() & F.col("rag_used").isNotNull()
    cols = [out_b.alias("output_budget"), out_u.alias("output_used"), F.greatest(F.lit(0), out_b - out_u).alias("output_remaining"),
            zero("input_token_budget").alias("input_budget"), zero("prompt_tokens").alias("input_used"),
            F.greatest(F.lit(0), zero("input_token_budget") - zero("prompt_tokens")).alias("input_remaining"),
            zero("total_tokens").alias("model_total"), zero("call_count").alias("model_calls"),
            zero("context_window_tokens").alias("context_window"), "rag_budget", "rag_used",
            F.when(known, F.greatest(F.lit(0), F.col("rag_budget") - F.col("rag_used"))).alias("rag_remaining"),
            F.coalesce("rag_truncated", F.lit(False)).alias("rag_truncated"), stored.alias("from_snapshot")]
    if tools is not None:
        cols += [zero("tool_budget").alias("tool_budget"), zero("tool_used").alias("tool_used")]
    return j.select("request_id", *cols)


def context_usage(stages: DataFrame, order: str = "sequence") -> DataFrame:
    """Repeated stage names of a request get ``#2``, ``#3`` …"""
    numbered = ordinal(stages, ["request_id", "stage"], order, "_n")
    return numbered.withColumn("stage_key", F.when(F.col("_n") > 1, F.concat(
        F.col("stage"), F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col("stage"))).drop("_n")


def tool_usage(results: DataFrame, per_step: int = 4000) -> DataFrame:
    """Per request: tokens, budget, rest, truncation and success of its tool steps."""
    used, budget = F.sum(F.coalesce("context_tokens", F.lit(0))), F.count("*") * per_step
    return results.groupBy("request_id").agg(
        F.count("*").alias("steps"), used.alias("tool_used"), budget.alias("tool_budget"),
        F.greatest(F.lit(0), budget - used).alias("tool_remaining"), F.max("context_truncated").alias("truncated"),
        F.count_if("success").alias("succeeded"), F.min("success").alias("all_succeeded"))


# --- quality, traces ------------------------------------------------------------------------

def answer_quality(runs: DataFrame) -> DataFrame:
    """Stored quality (JSON in ``answer_quality``), else the neutral default with the run's evidence stats."""
    q = F.from_json("answer_quality", "confidence double, evidence_status string, evidence_score double, "
                                      "evidence_source_count long, evidence_reason string")
    r = runs.withColumn("_q", q)
    has = F.col("answer_quality").isNotNull()
    pick = lambda c, d: F.when(has, F.col(f"_q.{c}")).otherwise(d).alias(c)
    none = F.lit(None)
    return r.select("request_id", pick("confidence", none), pick("evidence_status", F.lit("not_applicable")),
                    pick("evidence_score", F.col("stat_evidence_score")),
                    pick("evidence_source_count", F.coalesce("stat_source_count", F.lit(0))), pick("evidence_reason", none))


def recent_runs(runs: DataFrame, sessions: DataFrame, text: str | None = None, limit: int = 30) -> DataFrame:
    """Newest runs with their conversation title; ``text`` is a LIKE pattern part, wildcards alive."""
    rows = runs.join(sessions.select("session_id", F.col("title").alias("_title")), "session_id", "left")
    wanted = (text or "").strip()
    if wanted:
        like = f"%{wanted}%"
        rows = rows.filter(F.coalesce(F.col("_title").ilike(like), F.lit(False)) | F.coalesce(F.col("query").ilike(like), F.lit(False)))
    head = rows.orderBy(F.col("updated_at").desc(), F.col("created_at").desc(), "request_id").limit(max(1, min(limit, 100)))
    return head.select(
        "request_id", F.coalesce(F.nullif("_title", F.lit("")), F.nullif("query", F.lit("")), F.lit("新对话")).alias("conversation_title"),
        "query", "status", F.coalesce("execution_time_ms", F.lit(0.0)).alias("total_ms"),
        F.coalesce("completed_at", "updated_at", "created_at").alias("completed_at"),
        F.when(F.coalesce(F.col("error"), F.lit("")) != "", "AGENT_EXECUTION_ERROR").alias("error_code"))


def http_code(status) -> Column:
    """Trace code of a run status."""
    s = F.col(status) if isinstance(status, str) else status
    return (F.when(s.isin("completed", "success"), 200).when(s == "cancelled", 499).when(s == "timed_out", 504).otherwise(500))


def run_status(confidence, evidence_status) -> Column:
    """A safely refused answer counts as completed."""
    ok = (F.coalesce(F.col(confidence), F.lit(0.0)) > 0) | F.coalesce(
        F.col(evidence_status).isin("sufficient", "insufficient"), F.lit(False))
    return F.when(ok, "completed").otherwise("failed")


def trace_error(timeline: DataFrame) -> DataFrame:
    """The last timeline item of a request that carries an error code."""
    rest = [c for c in timeline.columns if c not in ("request_id", "pos")]
    bad = timeline.filter(F.coalesce(F.col("error_code"), F.lit("")) != "")
    return bad.groupBy("request_id").agg(F.max_by(F.struct("pos", *rest), "pos").alias("e")).select("request_id", "e.*")


def run_trace(runs: DataFrame, usage: DataFrame, quality: DataFrame, errors: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One wide row per run: status, code, usage, quality, last error."""
    rows = runs if ids is None else runs.join(ids, "request_id", "left_semi")
    return rows.join(usage.select("request_id", "call_count", "total_tokens"), "request_id", "left").join(
        quality, "request_id", "left").join(
        errors.select("request_id", F.col("error_code").alias("last_error")), "request_id", "left").withColumn(
        "status_code", http_code("status"))


def recent_traces(traces: DataFrame, limit: int = 20) -> DataFrame:
    """Newest agent traces, never more than the last 500."""
    return traces.filter("trace_type = 'agent'").orderBy(F.col("completed_at").desc(), "request_id").limit(min(limit, 500))


def stage_errors(timeline: DataFrame) -> DataFrame:
    """Failed items with their classification and a redacted message."""
    return timeline.filter("status = 'failed'").select(
        "request_id", "sequence", "stage", classify_error("stage").alias("e"),
        redact(F.coalesce(F.nullif("message", F.lit("")), F.lit("执行失败")), 500).alias("message")).select(
        "request_id", "sequence", "stage", "e.*", "message")


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("code").agg(F.count("*").alias("n"))


def enrich_timeline(timeline: DataFrame, runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Add ``result`` (map) to timeline items (request_id, sequence, stage, has_result) without one.

    The n-th ``llm.*`` item of a request goes with its n-th model call. runs: (request_id, intent, execution_time_ms,
    stats map<string,string>, quality map<string,string>, crag map<string,string>, answered boolean, source_count).
    Of the calls' fields those are shown that the table has and that are not null.
    """
    none = F.create_map().cast("map<string,string>")
    entry = lambda k, v: F.create_map(F.lit(k), v.cast("string"))
    note = lambda text: entry("recording_note", F.lit(text))
    known = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    llm = ordinal(timeline.filter(F.col("stage").startswith("llm.")).select("request_id", "sequence"), ["request_id"], "sequence", "n")
    fields = [f for f in CALL_FIELDS if f in calls.columns]
    numbered = ordinal(calls, ["request_id"], "sequence", "n").select(
        "request_id", "n", known(F.map_concat(*[entry(f, F.col(f)) for f in fields])).alias("call"))
    paired = llm.join(numbered, ["request_id", "n"], "left").select("request_id", "sequence", "call")
    rows = timeline.join(runs, "request_id", "left").join(paired, ["request_id", "sequence"], "left")
    stage, stat = F.col("stage"), lambda k: F.try_element_at("stats", F.lit(k))
    figures = lambda pairs: known(F.map_concat(*[entry(shown, stat(stored)) for shown, stored in pairs]))
    quality, selected = F.coalesce("quality", none), F.coalesce(stat("quality_filtered_candidates"), stat("selected_results"))
    judged = (F.coalesce(F.try_element_at(quality, F.lit("evidence_status")), F.lit("")) != "not_applicable") | F.try_element_at(
        quality, F.lit("evidence_score")).isNotNull()
    # what a stage shows besides its figures
    more = (F.when(stage == "agent.plan", F.map_concat(entry("intent", F.col("intent")), note(NOTE_NO_PLAN)))
            .when(stage == "agent.fast_path", F.map_concat(entry("mode", F.lit("fast_path")), entry("planner_skipped", F.lit(True))))
            .when((stage == "agent.query_rewrite") & stat("rewritten_queries").isNull(), note(NOTE_NO_REWRITES))
            .when((stage == "retrieval.rerank") & selected.isNotNull(), F.map_concat(entry("selected", selected), note(NOTE_NO_DOCUMENTS)))
            .when(stage == "agent.crag_grade", F.coalesce("crag", none))
            .when(stage == "agent.evidence", F.when(judged, quality).otherwise(note(NOTE_NO_EVIDENCE)))
            .when(stage == "agent.generation", F.map_concat(entry("answer_generated", F.col("answered")), entry("source_count", F.col("source_count")), note(NOTE_NO_CITATIONS)))
            .when(stage.startswith("llm."), F.coalesce("call", none))
            .when(stage == "agent.total", entry("total_ms", F.coalesce(F.col("execution_time_ms").cast("string"), F.lit("0")))))
    own = F.when(stage.isin(RECALL_STAGES), figures([(f, f) for f in RECALL_FIGURES]))
    for name, pairs in STAGE_FIGURES.items():
        own = own.when(stage == name, figures(pairs))
    result = F.map_concat(F.coalesce(own, none), F.coalesce(more, none))
    filled = F.when(F.size(result) > 0, result).otherwise(note(NOTE_DURATION_ONLY))
    return rows.select("request_id", "sequence", "stage", F.when(~F.col("has_result"), filled).alias("result"))


# --- steps, events --------------------------------------------------------------------------

def is_empty_payload(payload) -> Column:
    """NULL, blank text, empty list or object, or an object whose ``results`` / ``items`` is empty."""
    def bare(c):
        return c.isNull() | F.trim(c).isin("", "null", "[]", "{}") | c.rlike(r'\A\s*"\s*"\s*\z')

    def nested(c, deeper):
        keys = F.json_object_keys(c)
        inner = F.when(F.array_contains(keys, "results"), F.get_json_object(c, "$.results"))
        items = F.when(F.array_contains(keys, "items"), F.get_json_object(c, "$.items"))
        empty = (lambda x: bare(x) | deeper(x)) if deeper else bare
        return F.when(F.coalesce(F.array_contains(keys, "results"), F.lit(False)), empty(inner)).when(
            F.coalesce(F.array_contains(keys, "items"), F.lit(False)), empty(items)).otherwise(F.lit(False))

    p = F.col(payload)
    return bare(p) | nested(p, lambda x: nested(x, None))


def evaluate_steps(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Per request: failed and empty step counts and overall success.

    results: (request_id, step_id, success, payload JSON, error_message);
    runs: (request_id, success, completed_steps, total_steps).
    """
    inner_fail = F.coalesce(F.get_json_object("payload", "$.success") == "false", F.lit(False))
    failed = ~F.coalesce(F.col("success"), F.lit(False)) | inner_fail
    empty = ~failed & is_empty_payload("payload")
    per = results.groupBy("request_id").agg(F.count_if(failed).alias("failed_steps"), F.count_if(empty).alias("empty_steps"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return runs.join(per, "request_id", "left").select(
        "request_id", zero("failed_steps").alias("failed_steps"), zero("empty_steps").alias("empty_steps"),
        (F.col("success") & (zero("failed_steps") == 0) & (zero("empty_steps") == 0)
         & (F.col("completed_steps") == F.col("total_steps"))).alias("successful"))


def final_response(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Response of the last ``run_completed`` event, else the run's own response."""
    last = events.filter("type = 'run_completed' AND response IS NOT NULL").groupBy("request_id").agg(
        F.max_by("response", "sequence").alias("_r"))
    return runs.join(last, "request_id", "left").select(
        "request_id", F.coalesce("_r", "response").alias("response"), F.col("_r").isNotNull().alias("from_event"))


def events_after(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events past each run's cursor; token events are not part of the log. Sort on reading."""
    return events.filter("type <> 'token'").join(cursors, "request_id").filter(F.col("sequence") > F.col("cursor")).drop("cursor")


def active_conflicts(runs: DataFrame) -> DataFrame:
    """Sessions with more than one run that has not ended."""
    return runs.groupBy("session_id").agg(
        F.count_if(F.col("status").isin(NON_TERMINAL)).alias("active_runs")).filter("active_runs > 1")
