"""Answer feedback and fetched research sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.common import let, squash, strip
from ..functions.text import clean_external_text, guard_url
from .skew import rank_by_range

# Fixed values
CATEGORIES = {"knowledge_missing": "知识缺失", "content_outdated": "内容过期",
              "citation_error": "引用错误", "answer_irrelevant": "回答不相关"}
FINISHED = ["completed", "success"]
FAILED = ["failed", "cancelled", "timed_out"]


def create_feedback(batch: DataFrame, existing: DataFrame, runs: DataFrame) -> dict:
    """batch (request_id, session_id, category, user_note, pos): one feedback per request, first wins.

    Returns ``accepted``, ``repeated`` (a request already answered) and ``rejects`` with a reason.
    """
    first = batch.groupBy("request_id").agg(F.min_by(F.struct(*[c for c in batch.columns if c != "request_id"]), "pos").alias("b")).select(
        "request_id", "b.*")
    known = existing.select("request_id", F.col("session_id").alias("_old")).dropDuplicates(["request_id"])
    run = runs.select("request_id", "session_id", F.col("status").alias("_run"))
    judged = first.join(known, "request_id", "left").join(run, ["request_id", "session_id"], "left").withColumn("reason", F.when(
        (F.coalesce(strip("request_id"), F.lit("")) == "") | (F.coalesce(strip(F.col("session_id").cast("string")), F.lit("")) == ""), "MISSING_ID")
        .when(~F.coalesce(F.col("category").isin(list(CATEGORIES)), F.lit(False)), "CATEGORY_UNSUPPORTED")
        .when(F.col("_old").isNotNull(), F.when(F.col("_old") == F.col("session_id"), "REPEATED").otherwise("NOT_FOUND"))
        .when(F.col("_run").isNull(), "NOT_FOUND").when(~F.col("_run").isin(FINISHED), "RUN_NOT_COMPLETED"))
    note = F.nullif(F.substring(squash(F.coalesce("user_note", F.lit(""))), 1, 1000), F.lit(""))
    return {"accepted": judged.filter("reason IS NULL").select("request_id", "session_id", "category", note.alias("user_note"),
                                                               F.lit("reported").alias("status")),
            "repeated": judged.filter("reason = 'REPEATED'").select("request_id"),
            "rejects": judged.filter("reason <> 'REPEATED'").select("request_id", "reason")}


def cited_pages(sources: DataFrame) -> DataFrame:
    """(request_id, position, page_id): distinct cited pages in the order of their first citation."""
    first = sources.filter(F.coalesce(F.col("page_id").cast("string"), F.lit("")) != "").groupBy("request_id", "page_id").agg(F.min("pos").alias("_p"))
    return rank_by_range(first, ["request_id"], [F.col("_p"), F.col("page_id")], "position", "cited").select("request_id", "position", "page_id")


def auto_target(feedback: DataFrame, cited: DataFrame) -> DataFrame:
    """Add ``target`` and ``target_error``: a chosen page must be cited; an outdated answer with one
    citation targets that page. feedback: (request_id, category, target_page_id)."""
    per = cited.groupBy("request_id").agg(F.count("*").alias("_n"), F.min("page_id").alias("_one"))
    chosen = cited.select("request_id", F.col("page_id").alias("target_page_id"), F.lit(True).alias("_ok"))
    j = feedback.join(per, "request_id", "left").join(chosen, ["request_id", "target_page_id"], "left")
    asked = F.col("target_page_id").isNotNull()
    return j.select(*feedback.columns, F.when(asked & F.col("_ok").isNull(), "TARGET_NOT_CITED").alias("target_error"),
                    F.when(asked & F.col("_ok").isNotNull(), F.col("target_page_id"))
                    .when(~asked & (F.col("category") == "content_outdated") & (F.col("_n") == 1), F.col("_one")).alias("target"))


def retrieval_snapshot(runs: DataFrame) -> DataFrame:
    """Seven fields from the response JSON, falling back to the run."""
    field = lambda c: F.get_json_object("response", f"$.{c}")
    return runs.select(
        "request_id", F.coalesce(field("sources"), F.lit("[]")).alias("sources"),
        F.coalesce(field("retrieval_stats"), "retrieval_stats", F.lit("{}")).alias("retrieval_stats"),
        F.coalesce(field("timeline"), "timeline", F.lit("[]")).alias("timeline"), field("evidence_status").alias("evidence_status"),
        field("evidence_score").try_cast("double").alias("evidence_score"),
        F.coalesce(field("evidence_source_count").try_cast("long"), F.lit(0)).alias("evidence_source_count"),
        field("evidence_reason").alias("evidence_reason"))


def refresh_retest(feedback: DataFrame, runs: DataFrame) -> DataFrame:
    """Move feedback in state ``retesting`` on once its retest run has ended."""
    run = runs.select(F.col("request_id").alias("retest_request_id"), F.col("status").alias("_s"),
                      F.col("response").alias("_answer"), F.col("error").alias("_error"))
    j = feedback.join(run, "retest_request_id", "left")
    busy = F.col("status") == "retesting"
    done, failed = busy & F.col("_s").isin(FINISHED), busy & F.col("_s").isin(FAILED)
    return j.select("request_id", "retest_request_id",
                    F.when(done, "resolved").when(failed, "retest_failed").otherwise(F.col("status")).alias("status"),
                    F.when(done, F.coalesce("_answer", F.lit(""))).alias("retest_answer"),
                    F.when(failed, F.coalesce(F.nullif("_error", F.lit("")), F.lit("原问题自动复测失败"))).alias("error"))


def before_after(feedback: DataFrame, numbers: tuple = ("evidence_score", "evidence_source_count")) -> DataFrame:
    """Both sides of a retest in one row with the change of the numeric fields (before_x, after_x)."""
    return feedback.select("request_id", "category", "status", *[
        c for n in numbers for c in (F.col(f"before_{n}"), F.col(f"after_{n}"), (F.col(f"after_{n}") - F.col(f"before_{n}")).alias(f"delta_{n}"))])


def latest_index_task(pages: DataFrame, tasks: DataFrame) -> DataFrame:
    """pages (page_id, revision or NULL): newest task of the page and revision; none means failed."""
    t = tasks.select("page_id", F.col("revision").alias("_rev"), "task_id", "status", "created_at")
    j = pages.join(t, "page_id", "left").filter(F.col("revision").isNull() | F.col("_rev").isNull() | (F.col("_rev") == F.col("revision")))
    best = j.groupBy("page_id", "revision").agg(F.max_by(F.struct("task_id", "status"), F.struct("created_at", "task_id")).alias("t"))
    return pages.select("page_id", "revision").alias("p").join(
        best.alias("b"), F.expr("p.page_id = b.page_id AND p.revision <=> b.revision"), "left").select(
        "p.page_id", "p.revision", F.col("b.t.task_id").alias("task_id"), F.coalesce("b.t.status", F.lit("failed")).alias("status"))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    label = F
    for key, text in CATEGORIES.items():
        label = label.when(F.col("category") == key, text)
    return feedback.groupBy(label.otherwise(F.col("category")).alias("category_label"), "status").agg(F.count("*").alias("n"))


# --- research -------------------------------------------------------------------------------

_ITEM_KEYS = ["url", "link", "href", "title", "name", "snippet", "description", "summary", "text", "content"]
_ITEM = "struct<" + ",".join(f"{k}:string" for k in _ITEM_KEYS) + ">"


def _first_text(item, *keys) -> Column:
    return F.coalesce(*[F.nullif(strip(item[k]), F.lit("")) for k in keys])


def search_items(payload) -> Column:
    """array<struct<url,title,snippet>> of a search payload (JSON text); items without url are dropped."""
    p = F.col(payload) if isinstance(payload, str) else payload
    as_list = lambda c: F.from_json(c, f"array<{_ITEM}>")
    lists = [F.when(F.get_json_object(p, f"$.{k}").startswith("["), as_list(F.get_json_object(p, f"$.{k}")))
             for k in ("results", "items", "data", "sources")]
    single = F.when(F.trim(p).startswith("{"), F.array(F.from_json(p, _ITEM)))
    top = F.when(F.trim(p).startswith("["), as_list(p))
    found = F.coalesce(top, *lists, single, F.array().cast(f"array<{_ITEM}>"))
    rows = F.transform(found, lambda i: F.struct(
        _first_text(i, "url", "link", "href").alias("url"),
        F.coalesce(_first_text(i, "title", "name"), _first_text(i, "url", "link", "href")).alias("title"),
        F.coalesce(_first_text(i, "snippet", "description", "summary", "text", "content"), F.lit("")).alias("snippet")))
    return F.filter(rows, lambda r: r["url"].isNotNull())


def fetch_content(payload, depth: int = 2) -> Column:
    """Text of a fetch payload: first text key, else the same inside result / data / page; lists joined."""
    p = F.col(payload) if isinstance(payload, str) else payload

    def of(c, left):
        direct = F.coalesce(*[F.nullif(strip(F.get_json_object(c, f"$.{k}")), F.lit("")) for k in ("content", "text", "markdown", "body")])
        if not left:
            return direct
        nested = [of(F.get_json_object(c, f"$.{k}"), left - 1) for k in ("result", "data", "page")]
        joined = F.array_join(F.filter(F.transform(F.from_json(c, "array<string>"), lambda x: of(x, 0)),
                                       lambda x: F.coalesce(x, F.lit("")) != ""), "\n")
        plain = F.when(~c.rlike(r"\A\s*[\[{]"), F.nullif(c, F.lit("")))
        return F.coalesce(F.when(c.rlike(r"\A\s*\["), joined), direct, *nested, plain)

    return F.coalesce(of(p, depth), F.lit(""))


def collect_candidates(items: DataFrame, max_queries: int = S.RESEARCH_MAX_QUERIES, limit: int = S.RESEARCH_MAX_SOURCES) -> DataFrame:
    """items (run_id, query_no, pos, url, …): first item per guarded URL over the first queries, at most ``limit``."""
    usable = items.filter(F.col("query_no") < max_queries).withColumn("url", guard_url("url")).filter("url IS NOT NULL")
    rest = [c for c in items.columns if c not in ("run_id", "url")]
    first = usable.groupBy("run_id", "url").agg(F.min_by(F.struct(*rest), F.struct("query_no", "pos")).alias("r")).select("run_id", "url", "r.*")
    w = Window.partitionBy("run_id").orderBy("query_no", "pos")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def normalize_sources(raw: DataFrame, limit: int = S.RESEARCH_MAX_SOURCES, max_chars: int = S.RESEARCH_MAX_CHARS) -> DataFrame:
    """raw (run_id, pos, url, title, snippet, content): of the first ``limit`` rows of a run keep new URLs
    with new content inside a running character budget; the overflowing content is cut.

    Whether a cut content is new depends on the rows before it, so the at most ``limit`` rows of a run
    are folded in order as one array.
    """
    w = Window.partitionBy("run_id").orderBy("pos")
    head = raw.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).select(
        "run_id", F.struct("pos", guard_url("url").alias("url"), F.col("title"), F.col("snippet"), clean_external_text(
            F.coalesce(F.nullif("content", F.lit("")), "snippet", F.lit(""))).alias("content")).alias("r"))
    out_type = "array<struct<url:string,title:string,snippet:string,content:string,content_hash:string>>"
    zero = F.struct(F.lit(max_chars).alias("left"), F.array().cast(out_type).alias("out"))

    def step(acc, r):
        def add(cut):
            def keep(digest):
                known = F.exists(acc["out"], lambda o: (o["url"] == r["url"]) | (o["content_hash"] == digest))
                bad = r["url"].isNull() | (acc["left"] <= 0) | (cut == "") | known
                title = F.substring(clean_external_text(F.coalesce(F.nullif(r["title"], F.lit("")), r["url"])), 1, 500)
                snippet = F.substring(clean_external_text(F.coalesce(F.nullif(r["snippet"], F.lit("")), F.substring(cut, 1, 500))), 1, 1000)
                item = F.struct(r["url"].alias("url"), F.coalesce(F.nullif(title, F.lit("")), r["url"]).alias("title"),
                                snippet.alias("snippet"), cut.alias("content"), digest.alias("content_hash"))
                return F.when(bad, acc).otherwise(F.struct((acc["left"] - F.length(cut)).alias("left"),
                                                           F.concat(acc["out"], F.array(item)).alias("out")))
            return let(F.sha2(cut, 256), keep)
        return let(F.substring(r["content"], F.lit(1), acc["left"]), add)

    return head.groupBy("run_id").agg(F.array_sort(F.collect_list("r")).alias("rs")).select(
        "run_id", F.posexplode(F.aggregate("rs", zero, step, lambda a: a["out"])).alias("position", "s")).select(
        "run_id", "position", "s.*")


def clean_queries(values, question, limit: int = S.RESEARCH_MAX_QUERIES) -> Column:
    """Squashed, at most 300 characters, distinct, at most ``limit``; else the question itself."""
    tidy = F.slice(F.array_distinct(F.filter(F.transform(values, lambda v: F.substring(squash(v), 1, 300)), lambda v: v != "")), 1, limit)
    return let(tidy, lambda q: F.when(F.coalesce(F.size(q), F.lit(0)) > 0, q).otherwise(F.array(F.substring(question, 1, 300))))


def research_runs(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """Runs with their sources, one row per source (one row without source fields for a run that has
    none); ``created_at`` gives the order. Kept as rows, so a run may have any number of sources."""
    return runs.join(sources, "run_id", "left")
