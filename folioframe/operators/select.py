"""After fusion: reranking, score filter, token budget, formatting, evidence gate, grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.common import blank_to_null, strip
from ..functions.markdown import clean_link_label
from ..functions.text import audio_provenance, split_tags
from ..functions.tokens import estimate_tokens, truncate_text
from .skew import first_slices, page_by_range, rank_by_range

# rows that a top-n may hold in each task
SHALLOW_ROWS = 10_000


def rerank(candidates: DataFrame, scorer, k: int = S.FINAL_TOP_K, query: str = "query",
           tie: str = "doc_id") -> DataFrame:
    """Score (query, content) with a scorer column function; best ``k`` per query."""
    usable = candidates.filter(F.col(query).isNotNull() & (strip(query) != "") & F.lit(k > 0))
    scored = usable.withColumn("score", scorer(F.col(query), F.col("content")))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def overlap_scorer(query: Column, content: Column) -> Column:
    """Model-free scorer: share of the distinct question tokens found in the content."""
    from ..functions.tokens import tokenize
    q = F.array_distinct(tokenize(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, tokenize(content))).cast("double"),
                                   F.size(q)), F.lit(0.0))


def validate_rerank(results: DataFrame, sizes: DataFrame) -> DataFrame:
    """Violations (query_id, problem, n) of rerank results (query_id, index, score) against the
    candidate counts (query_id, n_candidates)."""
    joined = sizes.join(results, "query_id", "left")
    at, score = F.col("index"), F.col("score")
    bad_score = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    per = joined.groupBy("query_id").agg(
        F.first("n_candidates").alias("n"), F.count("index").alias("rows"),
        F.count_distinct("index").alias("distinct"),
        F.count_if(at.isNotNull() & ((at < 0) | (at >= F.col("n_candidates")))).alias("out_of_range"),
        F.count_if(at.isNotNull() & bad_score).alias("bad_score"))
    rows = F.array(
        F.struct(F.lit("empty").alias("problem"), ((F.col("n") > 0) & (F.col("rows") == 0)).cast("long").alias("n")),
        F.struct(F.lit("duplicate").alias("problem"), (F.col("rows") - F.col("distinct")).alias("n")),
        F.struct(F.lit("out_of_range").alias("problem"), F.col("out_of_range").alias("n")),
        F.struct(F.lit("bad_score").alias("problem"), F.col("bad_score").alias("n")))
    return per.select("query_id", F.inline(rows)).filter("n > 0")


def filter_reranked(rows: DataFrame, top_k: int = S.FINAL_TOP_K, min_score: float = S.RERANK_MIN_SCORE,
                    margin: float = S.RERANK_MARGIN, tie: str = "doc_id") -> DataFrame:
    """Keep scores at or above max(minimum, best - margin); the best row always stays."""
    finite = rows.filter(F.col("score").isNotNull() & ~F.isnan("score")
                         & (F.abs("score") != float("inf")))
    by_query = Window.partitionBy("query_id")
    w = by_query.orderBy(F.col("score").desc(), F.col(tie))
    ranked = finite.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
    best = F.max("score").over(by_query)
    return ranked.withColumn("_best", best).filter(
        (F.col("score") >= F.greatest(F.lit(min_score), F.col("_best") - margin))
        | (F.col("rank") == 1)).drop("_best")


def pack_token_budget(rows: DataFrame, budget: int = S.CONTEXT_BUDGET, keys=("query_id",)) -> DataFrame:
    """In rank order while the budget lasts; the row that overflows is cut and ends the list.

    Every selected row spends at least one token, so at most ``budget`` rows of a query can matter. They are
    found by counts per slice of ranks, so a huge query is cut before anything is sorted.
    """
    w = Window.partitionBy(*keys).orderBy("rank")
    head = first_slices(rows, list(keys), "rank", budget).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= budget)
    costed = head.withColumn("_cost", estimate_tokens("content"))
    before = F.coalesce(F.sum("_cost").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # an empty row ends the list as well
    blanks = F.coalesce(F.sum((F.col("_cost") == 0).cast("int")).over(
        w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    open_ = costed.withColumn("_left", F.lit(budget) - before).withColumn("_blank", blanks).filter(
        (F.col("_left") > 0) & (F.col("_blank") == 0))
    cut = F.when(F.col("_cost") <= F.col("_left"), F.col("content")).otherwise(
        truncate_text("content", F.col("_left").cast("int")))
    out = open_.withColumn("_full", F.length("content")).withColumn("content", cut)
    return out.withColumn("snippet", F.substring("content", 1, 300)).withColumn(
        "context_truncated", F.length("content") < F.col("_full")).withColumn(
        "context_tokens", estimate_tokens("content")).drop("_n", "_cost", "_left", "_full", "_blank")


def _url_quote(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")),
                               F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def format_result(rows: DataFrame, score_name: str = "rerank_score", score: str = "score") -> DataFrame:
    """Citation-ready rows: page, titles, links, snippet, summary, tags, provenance."""
    def meta(name):
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    parsed = F.nullif(F.regexp_extract(F.col("doc_id").cast("string"), r"\Apage:([0-9a-f-]{36}):", 1), F.lit(""))
    page_id = F.coalesce(blank_to_null(meta("page_id").cast("string")), parsed)
    section = clean_link_label(meta("section_title"))
    path = clean_link_label(F.coalesce(meta("section_path"), section))
    titles = [clean_link_label(meta("page_title")), section,
              clean_link_label(F.coalesce(meta("filename"), meta("title"))), page_id]
    title = F.coalesce(*[F.nullif(t, F.lit("")) for t in titles], F.lit("知识库页面"))
    content = F.col("content")
    out = rows.select(
        "query_id", F.col("doc_id").alias("id"), F.col("doc_id").alias("chunk_id"),
        page_id.alias("page_id"), meta("page_revision").alias("page_revision"), title.alias("title"),
        "content", F.substring(content, 1, 300).alias("snippet"),
        F.when(F.length(content) > 200, F.concat(F.substring(content, 1, 200), F.lit("...")))
        .otherwise(content).alias("summary"),
        split_tags(meta("tags")).alias("tags"), F.coalesce(meta("source_type"), F.lit("doc")).alias("source_type"),
        F.coalesce(meta("source_uri"), F.lit("")).alias("source_uri"),
        F.when(page_id.isNotNull(), F.concat(
            F.lit("/api/pages/"), page_id,
            F.when(section != "", F.concat(F.lit("#section="), _url_quote(section))).otherwise(F.lit(""))))
        .alias("source_url"),
        F.coalesce(meta("filename"), F.lit("")).alias("filename"), section.alias("section_title"),
        F.coalesce(F.nullif(path, F.lit("")), section).alias("section_path"),
        F.col(score).alias(score_name), "rank",
        *([F.col("rrf_score")] if "rrf_score" in rows.columns else []),
        audio_provenance(meta("source_uri"), content).alias("_audio"))
    return out.select("*", *[F.col(f"_audio.{c}").alias(c) for c in
                             ("audio_id", "audio_start", "audio_end", "audio_url", "transcript_url")]
                      ).drop("_audio")


def extract_sources(rows: DataFrame) -> DataFrame:
    """The citation projection of formatted results."""
    fields = ["page_id", "page_revision", "title", "rerank_score", "rrf_score", "source_type",
              "source_uri", "source_url", "filename", "section_title", "section_path", "snippet",
              "audio_id", "audio_start", "audio_end", "audio_url", "transcript_url"]
    key = F.coalesce(F.col("chunk_id"), F.col("id"))
    return rows.select("query_id", key.alias("id"), key.alias("chunk_id"),
                       F.col("rerank_score").alias("score"),
                       *[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c)
                         for c in fields])


def ordered_sources(rows: DataFrame) -> DataFrame:
    """One row per source key by descending score (rerank score, else score, else 0)."""
    score = F.coalesce("rerank_score", "score", F.lit(0.0))
    key = F.coalesce(blank_to_null(F.col("chunk_id").cast("string")), blank_to_null(F.col("id").cast("string")),
                     F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"),
                              F.coalesce(blank_to_null("section_path"), blank_to_null("section_title"), F.lit(""))))
    keyed = rows.withColumn("source_key", key).withColumn("sort_score", score)
    best = Window.partitionBy("query_id", "source_key").orderBy(F.col("sort_score").desc(), "pos")
    one = keyed.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    return rank_by_range(one, ["query_id"], [F.col("sort_score").desc(), F.col("pos")], "position", "sources")


def filter_for_summary(rows: DataFrame, min_score: float = S.RERANK_MIN_SCORE) -> DataFrame:
    """Rows at or above the minimum unless that leaves a query without rows."""
    good = F.coalesce(F.col("rerank_score") >= min_score, F.lit(False))
    per = rows.groupBy("query_id").agg(F.max(good.cast("int")).alias("_any"))
    return rows.join(per, "query_id").filter(good | (F.col("_any") == 0)).drop("_any")


def summary_text(rows: DataFrame) -> DataFrame:
    """(query_id, text): the contents in rank order, joined by blank lines (few rows per query)."""
    return rows.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda r: r["content"]), "\n\n").alias("text"))


def paginate(rows: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page and the total. A shallow page is a bounded top-n; a deep one is read from the ranges of the order that hold it."""
    total = rows.agg(F.count("*").alias("total"))
    first = (page - 1) * size
    page_rows = rows.orderBy(*order).offset(first).limit(size) if first + size <= SHALLOW_ROWS else page_by_range(rows, order, first, size)
    return page_rows.join(F.broadcast(total))      # one row


# --- evidence gate and grades -------------------------------------------------------------

def assess_evidence(rows: DataFrame, queries: DataFrame, min_sources: int = S.EVIDENCE_MIN_SOURCES,
                    min_score: float = S.EVIDENCE_MIN_SCORE) -> DataFrame:
    """(query_id, evidence_status, evidence_score, evidence_source_count, evidence_reason).

    A NULL best score passes: only a number can fall below the minimum.
    """
    def text_of(name):
        return F.col(name).cast("string") if name in rows.columns else F.lit(None).cast("string")

    def number_of(name):
        return text_of(name).try_cast("double")

    key = F.coalesce(blank_to_null(text_of("page_id")), blank_to_null(text_of("chunk_id")),
                     blank_to_null(text_of("id")))
    score = F.when(text_of("rerank_score").isNotNull(), number_of("rerank_score")).otherwise(number_of("score"))
    per = rows.filter(F.coalesce(strip("content"), F.lit("")) != "").groupBy("query_id").agg(
        F.count("*").alias("_rows"), F.count_distinct(key).alias("_keys"), F.max(score).alias("_best"))
    sources = F.when(F.col("_keys") > 0, F.col("_keys")).otherwise(F.coalesce("_rows", F.lit(0)))
    low = F.coalesce(F.col("_best") < min_score, F.lit(False))
    reason = (F.when(F.col("_rows").isNull(), "no_content").when(sources < min_sources, "too_few_sources")
              .when(low, "score_below_minimum").otherwise("sufficient"))
    return queries.select("query_id").distinct().join(per, "query_id", "left").select(
        "query_id", F.when(reason == "sufficient", "sufficient").otherwise("insufficient").alias("evidence_status"),
        F.col("_best").alias("evidence_score"), sources.alias("evidence_source_count"),
        reason.alias("evidence_reason"))


def validate_grades(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """(query_id, failed): the scores must cover 0..n-1 exactly once, finite and within [0, 1]."""
    s = F.col("score")
    ok_score = F.coalesce(s.isNotNull() & ~F.isnan(s) & s.between(0.0, 1.0), F.lit(False))
    per = scores.groupBy("query_id").agg(
        F.count("*").alias("_n"), F.count_distinct("doc_index").alias("_d"),
        F.min("doc_index").alias("_lo"), F.max("doc_index").alias("_hi"), F.min(ok_score).alias("_ok"))
    n = F.col("n_documents")
    good = ((F.col("_n") == n) & (F.col("_d") == n) & (F.col("_lo") == 0) & (F.col("_hi") == n - 1)
            & F.col("_ok"))
    return sizes.join(per, "query_id", "left").select(
        "query_id", (~F.coalesce(good, F.lit(False))).alias("failed"))


def verdict(score, upper: float = S.GRADE_UPPER, lower: float = S.GRADE_LOWER) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return (F.when(score >= upper, "support").when(score <= lower, "incorrect").otherwise("limited_support"))


def grade_scores(scores: DataFrame, coverage: DataFrame) -> DataFrame:
    """Overall grade per query from scores (query_id, doc_index, score) and coverage
    (query_id, n_documents, coverage). Invalid scores or coverage fail closed."""
    failed = validate_grades(scores, coverage)
    v = verdict("score")
    per = scores.groupBy("query_id").agg(
        F.count_if(v == "support").alias("support"), F.count_if(v == "limited_support").alias("limited"),
        F.count_if(v == "incorrect").alias("incorrect"), F.max("score").alias("max_score"))
    joined = coverage.join(failed, "query_id").join(per, "query_id", "left")
    cov = F.lower("coverage")
    bad = F.col("failed") | ~F.coalesce(cov.isin("complete", "incomplete", "none"), F.lit(False))
    count = lambda c: F.when(bad, F.lit(0)).otherwise(F.coalesce(F.col(c), F.lit(0)))
    return joined.select(
        "query_id", bad.alias("grading_failed"),
        F.when(bad, "incorrect").when((F.col("support") > 0) & (cov == "complete"), "correct")
        .when((F.col("support") > 0) | (F.col("limited") > 0), "ambiguous").otherwise("incorrect").alias("grade"),
        F.when(~bad, F.col("max_score")).alias("max_score"), count("support").alias("support_count"),
        count("limited").alias("limited_count"), count("incorrect").alias("incorrect_count"))


def accept_by_verdict(scores: DataFrame, grades: DataFrame) -> DataFrame:
    """Rows that survive: correct keeps support, ambiguous support and limited, else nothing."""
    v = F.col("verdict")
    return scores.withColumn("verdict", verdict("score")).join(
        grades.filter(~F.col("grading_failed")).select("query_id", "grade"), "query_id").filter(
        ((F.col("grade") == "correct") & (v == "support"))
        | ((F.col("grade") == "ambiguous") & v.isin("support", "limited_support")))


def recovery_allowed(grades: DataFrame, attempted: str | None = None,
                     floor: float = S.GRADE_RECOVERY_MIN) -> DataFrame:
    tried = F.coalesce(F.col(attempted), F.lit(False)) if attempted else F.lit(False)
    return grades.withColumn("recovery_allowed", (F.col("grade") == "incorrect") & ~F.col("grading_failed")
                             & F.coalesce(F.col("max_score") > floor, F.lit(False)) & ~tried)


def skip_grading(evidence: DataFrame, fast_path: str = "fast_path", min_score: float = S.FAST_PATH_MIN_SCORE,
                 min_sources: int = S.FAST_PATH_MIN_SOURCES) -> DataFrame:
    return evidence.withColumn("skip_grading", F.col(fast_path) & (F.col("evidence_status") == "sufficient")
                               & F.coalesce(F.col("evidence_score") >= min_score, F.lit(False))
                               & (F.col("evidence_source_count") >= min_sources))


def cache_key(fields: dict) -> Column:
    """Fingerprint of a query configuration: hash of its JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)
