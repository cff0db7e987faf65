"""Conversation tables: sessions, history, search, expiry, summaries, context assembly.

A session may hold a large share of all messages. Counts and first/last values are aggregates that
reduce before the shuffle, and ordered selections rest on a rank limit that a token budget proves
sufficient, so that Spark cuts each session in the map stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.common import strip
from ..functions.text import contains_literal, conversation_title, search_snippet
from ..functions.tokens import estimate_tokens, message_tokens, truncate_text
from .skew import first_slices


def _by_id(descending: bool = False):
    return Window.partitionBy("session_id").orderBy(F.col("id").desc() if descending else F.col("id"))


def sessions_from_messages(messages: DataFrame) -> DataFrame:
    """session_id, message_count, updated_at, title from the first user message."""
    user = F.when(F.col("role") == "user", F.col("id"))
    return messages.groupBy("session_id").agg(
        F.count("*").alias("message_count"), F.max("created_at").alias("updated_at"),
        F.min("created_at").alias("created_at"),
        conversation_title(F.min_by("content", user)).alias("title"))


def backfill_titles(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Fill titles that are NULL or blank from the first user message; others stay."""
    first = messages.filter("role = 'user'").groupBy("session_id").agg(
        conversation_title(F.min_by("content", "id"), default=None).alias("_first"))
    blank = F.coalesce(strip("title"), F.lit("")) == ""
    return sessions.join(first, "session_id", "left").withColumn(
        "title", F.when(blank, F.coalesce("_first", "title")).otherwise(F.col("title"))).drop("_first")


def history(messages: DataFrame, sessions: DataFrame, limit: int = S.MEMORY_MAX_HISTORY) -> DataFrame:
    """Per session: the summary as a leading system row, then the newest ``limit`` messages after the
    summary cursor in ascending order. sessions: (session_id, summary, summary_message_id)."""
    w = Window.partitionBy("session_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    recent = messages.join(sessions.select("session_id", "summary_message_id"), "session_id", "left").filter(
        F.col("summary_message_id").isNull() | (F.col("id") > F.col("summary_message_id"))).withColumn(
        "_n", F.row_number().over(w)).filter(F.col("_n") <= limit)
    up = Window.partitionBy("session_id").orderBy("created_at", "id")
    rows = recent.select("session_id", F.row_number().over(up).alias("position"), "role", "content")
    lead = sessions.filter(F.coalesce(F.col("summary"), F.lit("")) != "").select(
        "session_id", F.lit(0).alias("position"), F.lit("system").alias("role"), F.col("summary").alias("content"))
    return lead.unionByName(rows)


def search_sessions(sessions: DataFrame, messages: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Newest sessions with a literal hit in the title or in a message; first hit and snippet."""
    hits = messages.filter(contains_literal("content", query)).groupBy("session_id").agg(
        F.min("id").alias("matched_message_id"), F.min_by("content", "id").alias("_text"))
    found = sessions.join(hits, "session_id", "left").filter(
        F.col("matched_message_id").isNotNull() | F.coalesce(contains_literal("title", query), F.lit(False)))
    return found.orderBy(F.col("updated_at").desc(), "session_id").limit(limit).select(
        "session_id", F.coalesce("title", F.lit("新对话")).alias("title"), "message_count", "matched_message_id",
        F.when(F.col("_text").isNotNull(), search_snippet("_text", query, 48, "head")).alias("match_snippet"),
        "updated_at")


def session_messages(messages: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
    """Messages joined to the pending action named in ``extra``; confirmation only while it is open."""
    action_id = F.get_json_object("extra", "$.pending_action_id")
    joined = messages.withColumn("action_id", action_id).join(actions, "action_id", "left")
    open_ = F.coalesce((F.col("status") == "pending") & (F.col("expires_at") > now), F.lit(False))
    return joined.select("session_id", "id", "role", "content", "action_id", open_.alias("confirmation_required"),
                         F.when(open_, F.col("preview")).alias("preview"))


def expired_sessions(sessions: DataFrame, now: Column, ttl_hours: int = S.SESSION_TTL_HOURS) -> DataFrame:
    return sessions.filter(F.col("updated_at") < now - F.expr(f"INTERVAL {ttl_hours} HOURS"))


def cleanup(sessions: DataFrame, messages: DataFrame, doomed: DataFrame) -> dict:
    """Remove sessions and their messages; ``counts`` says how many of each."""
    ids = doomed.select("session_id").distinct()
    gone = sessions.join(ids, "session_id", "left_semi").agg(F.count("*").alias("sessions"))
    lost = messages.join(ids, "session_id", "left_semi").agg(F.count("*").alias("messages"))
    return {"sessions": sessions.join(ids, "session_id", "left_anti"),
            "messages": messages.join(ids, "session_id", "left_anti"),
            "counts": gone.join(F.broadcast(lost))}       # single rows


def session_stats(sessions: DataFrame, messages: DataFrame, now: Column,
                  ttl_hours: int = S.SESSION_TTL_HOURS) -> DataFrame:
    old = F.col("updated_at") < now - F.expr(f"INTERVAL {ttl_hours} HOURS")
    left = sessions.agg(F.count("*").alias("total_sessions"), F.count_if(old).alias("expired_sessions"))
    right = messages.agg(F.count("*").alias("total_messages"))
    return left.join(F.broadcast(right)).withColumn("ttl_hours", F.lit(ttl_hours))       # single rows


def _pending(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages after the summary cursor."""
    return messages.join(sessions.select("session_id", "summary_message_id"), "session_id").filter(
        F.col("summary_message_id").isNull() | (F.col("id") > F.col("summary_message_id")))


def _line(role="role", content="content") -> Column:
    return F.concat(F.coalesce(F.col(role), F.lit("")), F.lit(": "), F.coalesce(F.col(content), F.lit("")))


def summary_due(messages: DataFrame, sessions: DataFrame, threshold: int = S.MEMORY_SUMMARY_THRESHOLD,
                trigger: int = S.MEMORY_SUMMARY_TRIGGER, keep: int = 5) -> DataFrame:
    """(session_id, pending, pending_tokens, due). The estimate of the joined lines is additive in wide
    and other characters, so it is summed without ever joining the texts."""
    line = _line()
    narrow = F.length(F.regexp_replace(line, "[\\u3400-\\u9fff]", ""))
    per = _pending(messages, sessions).groupBy("session_id").agg(
        F.count("*").alias("pending"), F.sum(F.length(line) - narrow).alias("_wide"), F.sum(narrow).alias("_rest"))
    tokens = F.col("_wide") + F.ceil((F.col("_rest") + F.col("pending") - 1) / F.lit(4))
    return per.select("session_id", "pending", tokens.cast("long").alias("pending_tokens"),
                      (((F.col("pending") >= threshold) | (tokens >= trigger)) & (F.col("pending") > keep)).alias("due"))


def summary_selection(messages: DataFrame, sessions: DataFrame, budget: int = S.MEMORY_SUMMARY_INPUT,
                      summary_budget: int = S.MEMORY_SUMMARY_BUDGET, keep: int = 5) -> DataFrame:
    """Oldest messages that fit the summary input, without the last ``keep``; stops at the first miss.

    Every line costs a token at least and the room is 64 tokens or the budget at most, so no more lines
    than that can be taken: the rank limits in front (the last ``keep``, the first lines) are exact.
    """
    pend = _pending(messages, sessions)
    last = pend.select("session_id", "id").withColumn("_n", F.row_number().over(_by_id(True))).filter(
        F.col("_n") <= keep).groupBy("session_id").agg(F.min("id").alias("_cut"))
    lines = pend.join(last, "session_id").filter(F.col("id") < F.col("_cut")).select("session_id", "id", _line().alias("line"))
    head = first_slices(lines, ["session_id"], "id", max(budget, 64)).withColumn("_n", F.row_number().over(_by_id())).filter(
        F.col("_n") <= max(budget, 64))
    prior = truncate_text(F.coalesce(F.nullif("summary", F.lit("")), F.lit("（无）")),
                          F.lit(min(summary_budget, max(128, budget // 4))))
    room = sessions.select("session_id", F.greatest(F.lit(64), F.lit(budget) - estimate_tokens(prior) - 180).alias("room"))
    cost = head.join(room, "session_id").withColumn("cost", estimate_tokens("line"))
    run = cost.withColumn("used", F.sum("cost").over(_by_id()))
    fits = run.filter(F.col("used") <= F.col("room")).select("session_id", "id", "line", "cost", F.lit(False).alias("truncated"))
    # a first line that does not fit is cut when there is room for more than 64 tokens
    cut = run.filter((F.col("_n") == 1) & (F.col("cost") > F.col("room")) & (F.col("room") > 64)).select(
        "session_id", "id", truncate_text("line", F.col("room")).alias("line"), F.col("room").alias("cost"),
        F.lit(True).alias("truncated"))
    return fits.unionByName(cut)


def summary_cursor(selection: DataFrame) -> DataFrame:
    return selection.groupBy("session_id").agg(F.max("id").alias("summary_message_id"), F.count("*").alias("messages"))


def with_message_tokens(messages: DataFrame) -> DataFrame:
    return messages.withColumn("tokens", message_tokens("role", "content"))


# --- context assembly -----------------------------------------------------------------------

def _fit(role: Column, content: Column, budget: Column) -> Column:
    """Content cut to what is left of ``budget`` after overhead and role; NULL when nothing is left."""
    overhead = F.lit(4) + estimate_tokens(role)
    return F.when(budget > overhead, truncate_text(content, (budget - overhead).cast("int")))


def _fit_ordered(rows: DataFrame, budget: str) -> DataFrame:
    """Messages of one segment in order while the budget lasts; the first that is cut ends it."""
    w = Window.partitionBy("request_id").orderBy("pos")
    # a message costs five tokens or more once its role is counted; the budget bounds the number
    ranked = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= F.col(budget)).withColumn(
        "_cost", message_tokens("role", "content"))
    before = F.coalesce(F.sum("_cost").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = ranked.withColumn("_left", F.col(budget) - before)
    first = F.col("_n") == 1
    reach = left.filter((F.col("_left") > 4) | first).withColumn("fitted", _fit(F.col("role"), F.col("content"), F.col("_left")))
    return reach.filter("fitted IS NOT NULL").select(
        "request_id", "pos", "role", F.col("fitted").alias("content"),
        (F.col("fitted") != F.col("content")).alias("cut"))


def _spent(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("request_id").agg(F.sum(message_tokens("role", "content")).alias(name),
                                          F.count("*").alias(f"{name}_n"), F.max("cut").alias(f"{name}_cut"))


def assemble_context(requests: DataFrame, messages: DataFrame, window: int = S.CONTEXT_WINDOW,
                     history_budget: int = S.MEMORY_CONTEXT_BUDGET,
                     summary_budget: int = S.MEMORY_SUMMARY_BUDGET) -> dict:
    """Fit system, summary, current and recent messages into the input budget, in that priority.

    requests: (request_id, output_reserve). messages: (request_id, segment in system / summary /
    recent / current, pos, role, content). Returns ``messages`` in output order and ``stats``.
    """
    req = requests.select("request_id", F.least(F.greatest(F.lit(0), F.col("output_reserve")), F.lit(window)).alias("reserved")
                          ).withColumn("budget", F.lit(window) - F.col("reserved"))

    def segment(name):
        return messages.filter(F.col("segment") == name).select("request_id", "pos", "role", "content")

    system = _fit_ordered(segment("system").join(req.select("request_id", "budget"), "request_id"), "budget")
    state = req.withColumn("_left", F.col("budget")).join(_spent(system, "system_tokens"), "request_id", "left")
    state = state.withColumn("_left", F.col("_left") - F.coalesce("system_tokens", F.lit(0)))

    # the summaries of a request are few; they are merged into one message
    merged = segment("summary").filter("content <> ''").groupBy("request_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda m: m["content"]), "\n\n").alias("content"))
    summary = merged.join(state.select("request_id", F.least(F.lit(summary_budget), "_left").alias("b")), "request_id").withColumn(
        "fitted", _fit(F.lit("system"), F.col("content"), F.col("b"))).filter("fitted IS NOT NULL").select(
        "request_id", F.lit(0).alias("pos"), F.lit("system").alias("role"), F.col("fitted").alias("content"),
        (F.col("fitted") != F.col("content")).alias("cut"))
    state = state.join(_spent(summary, "summary_tokens"), "request_id", "left").withColumn(
        "_left", F.col("_left") - F.coalesce("summary_tokens", F.lit(0)))

    current = _fit_ordered(segment("current").join(
        state.select("request_id", F.col("_left").alias("b")), "request_id"), "b")
    state = state.join(_spent(current, "current_tokens"), "request_id", "left").withColumn(
        "_left", F.col("_left") - F.coalesce("current_tokens", F.lit(0)))

    recent_all = segment("recent")
    back = Window.partitionBy("request_id").orderBy(F.col("pos").desc())
    newest = recent_all.withColumn("_n", F.row_number().over(back)).filter(F.col("_n") <= history_budget).withColumn(
        "_cost", message_tokens("role", "content")).withColumn("_used", F.sum("_cost").over(back)).join(
        state.select("request_id", F.least(F.lit(history_budget), "_left").alias("b")), "request_id")
    whole = newest.filter(F.col("_used") <= F.col("b")).select(
        "request_id", "pos", "role", "content", F.lit(False).alias("cut"))
    part = newest.filter((F.col("_n") == 1) & (F.col("_cost") > F.col("b"))).withColumn(
        "fitted", _fit(F.col("role"), F.col("content"), F.col("b"))).filter("fitted IS NOT NULL").select(
        "request_id", "pos", "role", F.col("fitted").alias("content"), (F.col("fitted") != F.col("content")).alias("cut"))
    recent = whole.unionByName(part)
    total = messages.groupBy("request_id").agg(*[F.count_if(F.col("segment") == s).alias(f"_{s}") for s in
                                                 ("system", "current", "recent")])
    state = state.join(_spent(recent, "recent_tokens"), "request_id", "left").join(total, "request_id", "left")

    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    parts = ("system_tokens", "summary_tokens", "recent_tokens", "current_tokens")
    dropped = zero("_recent") - zero("recent_tokens_n")
    cut = F.lit(False)
    for p in parts:
        cut = cut | F.coalesce(F.col(f"{p}_cut"), F.lit(False))
    cut = (cut | (dropped > 0) | (zero("_system") > zero("system_tokens_n")) | (zero("_current") > zero("current_tokens_n")))
    stats = state.select(
        "request_id", F.lit(window).alias("total_budget"), F.col("budget").alias("input_budget"),
        F.col("reserved").alias("output_reserved_tokens"),
        sum((zero(p) for p in parts), F.lit(0).cast("long")).alias("used_tokens"), *[zero(p).alias(p) for p in parts],
        dropped.alias("dropped_recent_messages"), cut.alias("truncated"))
    order = [(system, 0), (summary, 1), (recent, 2), (current, 3)]
    rows = None
    for df, seg in order:
        tagged = df.select("request_id", F.lit(seg).alias("segment"), "pos", "role", "content")
        rows = tagged if rows is None else rows.unionByName(tagged)
    return {"messages": rows, "stats": stats}
