"""Retrieval metrics, evidence metrics, latency, dataset audits.

Rankings are rows (method, query_id, doc_id, rank); labels are long qrels (query_id, doc_id, grade).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import WS, casefold, strip
from ..functions.text import has_sensitive_value, stable_id
from ..session import broadcast_if_small, materialize
from .skew import rank_by_range

# Fixed values
ACTIONS = ["answer", "reject", "correct_premise", "external_research"]
ANSWERABLE_TYPES = ["keyword", "semantic_rewrite", "multi_evidence", "similar_concept"]
UNANSWERABLE = "unanswerable"


# --- ranking metrics ----------------------------------------------------------------------

def unique_top_k(rankings: DataFrame, k: int | None = None, keys=("method", "query_id")) -> DataFrame:
    """Keep the first rank of each document and renumber; cut to ``k`` when given."""
    first = rankings.groupBy(*keys, "doc_id").agg(F.min("rank").alias("rank"))
    if k is None:
        return rank_by_range(first.withColumnRenamed("rank", "_first"), list(keys), [F.col("_first"), F.col("doc_id")], "rank", "unique").drop("_first")
    w = Window.partitionBy(*keys).orderBy("rank", "doc_id")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def query_metrics(rankings: DataFrame, qrels: DataFrame, queries: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """Wide row per (method, query): mrr and hit/precision/recall/ndcg at each k.

    ``queries`` holds the (method, query_id[, category …]) rows to report; those without any
    ranking get zeros. One pass over the rankings serves every k.
    """
    ks = sorted(set(ks))
    good = qrels.filter("grade > 0").select("query_id", "doc_id", "grade")
    hits = unique_top_k(rankings).join(good, ["query_id", "doc_id"])     # relevant rows only
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    w = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "doc_id")
    ideal_gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("_i") + 1)
    found = hits.groupBy("method", "query_id").agg(
        F.min("rank").alias("_first"),
        *[F.count_if(F.col("rank") <= k).alias(f"_h{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") <= k, gain)).alias(f"_d{k}") for k in ks])
    # only the best labels are put in order, all are counted
    counted = good.groupBy("query_id").agg(F.count("*").alias("_n"))
    best = good.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= max([1, *ks])).groupBy("query_id").agg(
        *[F.sum(F.when(F.col("_i") <= k, ideal_gain)).alias(f"_x{k}") for k in ks])
    ideal = counted.join(best, "query_id")
    rows = queries.join(found, ["method", "query_id"], "left").join(ideal, "query_id", "left")

    def zero(c):
        return F.coalesce(c, F.lit(0.0))

    out = [zero(1.0 / F.col("_first")).alias("mrr")]
    for k in ks:
        h = F.coalesce(F.col(f"_h{k}"), F.lit(0))
        out += [(h > 0).cast("double").alias(f"hit_{k}"),
                ((h / F.lit(float(k))) if k > 0 else F.lit(0.0)).alias(f"precision_{k}"),
                zero(F.try_divide(h.cast("double"), F.col("_n"))).alias(f"recall_{k}"),
                zero(F.try_divide(F.col(f"_d{k}"), F.col(f"_x{k}"))).alias(f"ndcg_{k}")]
    return rows.select(*queries.columns, *out)


def aggregate_metrics(metrics: DataFrame, names: list, by=("method", "category")) -> DataFrame:
    """Macro means for the method and for (method, category) in one pass (grouping sets)."""
    method, category = by
    return metrics.groupingSets([[F.col(method)], [F.col(method), F.col(category)]],
                                F.col(method), F.col(category)).agg(
        *[F.avg(n).alias(n) for n in names], F.count("*").alias("queries"))


# --- evidence metrics ---------------------------------------------------------------------

def evidence_metrics(retrieved: DataFrame, evidence: DataFrame, queries: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """(method, query_id, k, evidence_recall, evidence_coverage).

    retrieved: (method, query_id, rank, source_id, start, end), not de-duplicated.
    evidence: (query_id, ord, source_id, start, end). The join is on (query, source) with the
    overlap as a residual test; the covered length is what each interval adds beyond the furthest
    end seen before it.
    """
    valid = evidence.filter(F.col("source_id").isNotNull() & (F.col("start") < F.col("end"))).select(
        "query_id", "ord", "source_id", F.col("start").alias("e_start"), F.col("end").alias("e_end"))
    all_ks = F.array(*[F.lit(k) for k in sorted(set(ks))])
    pairs = retrieved.join(valid, ["query_id", "source_id"]).select(
        "method", "query_id", "ord", "rank",
        F.greatest("e_start", "start").alias("l"), F.least("e_end", "end").alias("r")).filter("l < r")
    per_k = pairs.withColumn("k", F.explode(F.filter(all_ks, lambda k: k >= F.col("rank"))))
    w = Window.partitionBy("method", "query_id", "ord", "k").orderBy("l", "r").rowsBetween(
        Window.unboundedPreceding, -1)
    added = per_k.withColumn("_seen", F.max("r").over(w)).withColumn(
        "_add", F.greatest(F.lit(0), F.col("r") - F.greatest("l", F.coalesce("_seen", F.col("l")))))
    hit = added.groupBy("method", "query_id", "k").agg(
        F.count_distinct("ord").alias("_hit"), F.sum("_add").alias("_cov"))
    total = valid.groupBy("query_id").agg(F.count("*").alias("_n"),
                                          F.sum(F.col("e_end") - F.col("e_start")).alias("_len"))
    return queries.select("method", "query_id", F.explode(all_ks).alias("k")).join(
        hit, ["method", "query_id", "k"], "left").join(total, "query_id", "left").select(
        "method", "query_id", "k",
        F.coalesce(F.try_divide(F.col("_hit").cast("double"), "_n"), F.lit(0.0)).alias("evidence_recall"),
        F.coalesce(F.try_divide(F.col("_cov").cast("double"), "_len"), F.lit(0.0)).alias("evidence_coverage"))


# --- latency ------------------------------------------------------------------------------

def _inside_brackets(rows: DataFrame, key: str, value: str, percentiles: dict, accuracy: int, slack: float) -> DataFrame:
    """(key, name, pos, v, _c): counts per distinct value inside each percentile's bracket, and of all below it as v NULL."""
    names = list(percentiles)
    edges = [min(1.0, max(0.0, p + d)) for p in percentiles.values() for d in (-slack, slack)]
    approx = rows.groupBy(key).agg(F.count("*").alias("_n"), F.percentile_approx(value, edges, accuracy).alias("_e"))
    brackets = approx.select(key, F.explode(F.array(*[F.struct(
        F.lit(n).alias("name"), F.greatest(F.lit(1), F.ceil(F.lit(percentiles[n]) * F.col("_n"))).alias("pos"),
        F.col("_e")[2 * i].alias("lo"), F.col("_e")[2 * i + 1].alias("hi")) for i, n in enumerate(names)])).alias("q")).select(
        key, "q.*")
    # one bracket per key and percentile: rows are counted where they lie
    placed = rows.select(key, value).join(broadcast_if_small(brackets), key).filter(F.col(value) <= F.col("hi"))
    # everything below the bracket becomes one entry, so at most the bracket's values are ordered
    return placed.groupBy(key, "name", "pos", F.when(F.col(value) >= F.col("lo"), F.col(value)).alias("v")).agg(F.count("*").alias("_c"))


def nearest_rank(df: DataFrame, key: str, value: str, percentiles: dict, accuracy: int = 10_000, widths: tuple = (2.0, 40.0)) -> DataFrame:
    """Exact nearest-rank percentiles without bringing a group to one task.

    An approximate pass brackets each wanted rank between two values (its rank error is at most one part in ``accuracy``,
    the bracket is ``widths[0]`` times as wide to each side). The rows below a bracket are only counted, those inside are
    counted per distinct value, and only these counts are put in order. Keys whose bracket misses a rank are repeated
    with the next width, at last between their smallest and largest value.
    """
    rows, found = df.filter(F.col(value).isNotNull()), None
    for slack in [*(w / accuracy for w in widths), 1.0]:
        inside = materialize(_inside_brackets(rows, key, value, percentiles, accuracy, slack), "brackets")
        held = inside.groupBy(key, "name").agg(F.first("pos").alias("pos"), F.sum("_c").alias("_all"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("_c"))), F.lit(0)).alias("_less"))
        hit = (F.col("_less") < F.col("pos")) & (F.col("_all") >= F.col("pos"))
        missed = held.groupBy(key).agg(F.count_if(hit).alias("_hits")).filter(F.col("_hits") < len(percentiles)).select(key)
        w = Window.partitionBy(key, "name").orderBy(F.col("v").asc_nulls_first())
        reached = inside.withColumn("_upto", F.sum("_c").over(w)).filter(F.col("v").isNotNull() & (F.col("_upto") >= F.col("pos")))
        picked = reached.groupBy(key, "name").agg(F.min("v").alias("v"))
        if not missed.limit(1).count():
            found = picked if found is None else found.unionByName(picked)
            break
        good = picked.join(broadcast_if_small(missed), key, "left_anti")
        found = good if found is None else found.unionByName(good)
        rows = rows.join(broadcast_if_small(missed), key, "left_semi")
    return found.groupBy(key).pivot("name", list(percentiles)).agg(F.first("v"))


def latency_summary(runs: DataFrame, key: str = "method", value: str = "latency_ms") -> DataFrame:
    """mean, nearest-rank p50 / p95, max per key."""
    basic = runs.groupBy(key).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"),
                                  F.coalesce(F.max(value), F.lit(0.0)).alias("max"))
    pct = nearest_rank(runs, key, value, {"p50": 0.50, "p95": 0.95})
    return basic.join(pct, key, "left").select(
        key, "mean", F.coalesce("p50", F.lit(0.0)).alias("p50"),
        F.coalesce("p95", F.lit(0.0)).alias("p95"), "max")


def evaluate_method(metrics: DataFrame, errors: DataFrame, names: list) -> DataFrame:
    """Per method: macro means over the answerable questions, failures and failure rate.

    ``errors`` is (method, query_id, error); a failed question has an empty ranking, hence zeros.
    """
    failed = errors.filter(F.col("error").isNotNull()).select("method", "query_id").distinct().withColumn(
        "_failed", F.lit(1))
    joined = metrics.join(failed, ["method", "query_id"], "left")
    return joined.groupBy("method").agg(
        *[F.avg(F.when(F.col("_failed").isNull(), F.col(n)).otherwise(0.0)).alias(n) for n in names],
        F.count("_failed").alias("failures"),
        (F.count("_failed") / F.count("*")).alias("failure_rate"), F.count("*").alias("evaluated_queries"))


def workload_counters(corpus: DataFrame, queries: DataFrame, legs_before: DataFrame,
                      legs_after: DataFrame, candidates: DataFrame, text: str = "text") -> DataFrame:
    """One row: texts and characters embedded, rerank calls and characters, collapse counts."""
    parts = [
        corpus.agg(F.count("*").alias("embedding_documents"),
                   F.sum(F.length(text)).alias("embedding_document_characters")),
        queries.agg(F.count("*").alias("embedding_query_calls"),
                    F.sum(F.length("query")).alias("embedding_query_characters")),
        candidates.agg(F.count_distinct("query_id").alias("rerank_calls"), F.count("*").alias("rerank_candidates"),
                       F.sum(F.length("content")).alias("rerank_candidate_characters")),
        legs_before.agg(F.count("*").alias("candidates_before_collapse")),
        legs_after.agg(F.sum("collapsed").alias("duplicates_collapsed")),
    ]
    # every part is a single row
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)


def dataset_summary(docs: DataFrame, queries: DataFrame) -> DataFrame:
    answer = F.col("expected_action") == "answer"
    q = queries.agg(
        F.count("*").alias("queries"), F.count_if(answer).alias("answerable_queries"),
        F.count_if(~answer).alias("unanswerable_queries"))
    cats = queries.select("category").distinct().agg(F.array_join(
        F.sort_array(F.collect_list("category")), ",").alias("categories"))
    origins = queries.select(F.coalesce("label_origin", F.lit("unspecified")).alias("o")).distinct().agg(
        F.array_join(F.sort_array(F.collect_list("o")), ",").alias("label_origins"))
    return docs.agg(F.count("*").alias("documents")).join(F.broadcast(q)).join(
        F.broadcast(cats)).join(F.broadcast(origins))       # single rows


# --- dataset checks: violation tables (rule, key) -------------------------------------------

def _violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _rule(df: DataFrame, rule: str, key) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def _repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1")


def validate_dataset(docs: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Violations of docs(doc_id, text), queries(query_id, query, expected_action,
    reference_answer, n_claims, n_evidence) and qrels(query_id, doc_id, grade)."""
    has = qrels.select("query_id").distinct().withColumn("_has", F.lit(True))
    q = queries.join(has, "query_id", "left")
    answer = F.col("expected_action") == "answer"
    extra = (F.col("_has").isNotNull() | (F.coalesce(strip("reference_answer"), F.lit("")) != "")
             | (F.col("n_claims") > 0) | (F.col("n_evidence") > 0))
    empty_of = lambda df, rule: _rule(df.agg(F.count("*").alias("n")).filter("n = 0"), rule, F.lit(""))
    return _violations(
        empty_of(docs, "corpus_empty"), empty_of(queries, "queries_empty"),
        _rule(_repeated(docs, "doc_id"), "document_duplicate", "doc_id"),
        _rule(docs.filter(F.coalesce(strip("text"), F.lit("")) == ""), "document_blank", "doc_id"),
        _rule(_repeated(queries, "query_id"), "query_duplicate", "query_id"),
        _rule(queries.filter(F.coalesce(strip("query"), F.lit("")) == ""), "query_blank", "query_id"),
        _rule(queries.filter(~F.coalesce(F.col("expected_action").isin(ACTIONS), F.lit(False))),
              "action_unsupported", "query_id"),
        _rule(qrels.filter(F.col("grade").isNull() | (F.col("grade") <= 0)), "grade_not_positive",
              F.concat_ws("/", F.col("query_id").cast("string"), F.col("doc_id").cast("string"))),
        _rule(q.filter(answer & F.col("_has").isNull()), "answerable_without_relevance", "query_id"),
        _rule(q.filter(~answer & extra), "unanswerable_with_labels", "query_id"),
        _rule(qrels.join(docs.select("doc_id").distinct(), "doc_id", "left_anti"), "unknown_document",
              F.concat_ws("/", F.col("query_id").cast("string"), F.col("doc_id").cast("string"))))


def audit_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Violations of manifest rows (path, domain, document_type, positive_question_target) against
    files(path, raw_text)."""
    m = manifest.withColumn("path", strip(F.coalesce("path", F.lit(""))))
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    found = m.join(files.select("path", has_sensitive_value("raw_text").alias("_bad")), "path", "left")
    target = F.col("positive_question_target").try_cast("int")
    # walk the path: a prefix that climbs above the root escapes it
    depth = F.aggregate(F.split("path", "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, p: F.struct(
        (a["d"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("d"),
        F.least(a["low"], a["d"] + F.when(p == "..", -1).otherwise(0)).alias("low")), lambda a: a["low"])
    escapes = (depth < 0) | F.col("path").startswith("/")
    return _violations(
        _rule(m.filter(F.col("path") == ""), "path_blank", "path"),
        _rule(_repeated(m.filter(F.col("path") != ""), "path"), "path_duplicate", "path"),
        _rule(m.filter(escapes), "path_escapes_root", "path"),
        _rule(m.filter((F.col("path") != "") & ~F.lower("path").endswith(".md")), "not_markdown", "path"),
        _rule(found.filter((F.col("path") != "") & F.col("_bad").isNull()), "missing_file", "path"),
        _rule(m.filter(blank("domain") | blank("document_type")), "domain_or_type_blank", "path"),
        _rule(m.filter(F.coalesce(target <= 0, F.lit(True))), "target_not_positive", "path"),
        _rule(found.filter("_bad"), "sensitive_value", "path"))


def manifest_summary(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Per domain: documents, positive targets, characters."""
    return manifest.join(files, "path").groupBy("domain").agg(
        F.count("*").alias("documents"), F.sum(F.col("positive_question_target").cast("int")).alias("targets"),
        F.sum(F.length("raw_text")).alias("chars"))


def audit_sources(manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """Violations of manifest rows (path, raw_sha256, normalized_sha256) against the files as they are now read (``read_sources``).

    A byte that changed shows in the raw hash; the normalised hash changes with what the text says.
    """
    now = sources.select("path", F.col("raw_sha256").alias("_raw"), F.col("normalized_sha256").alias("_norm"), F.lit(True).alias("_there"))
    m = manifest.select("path", "raw_sha256", "normalized_sha256").join(now, "path", "left")
    there = F.col("_there").isNotNull()
    listed = manifest.select("path").distinct()
    return _violations(
        _rule(m.filter(~there), "missing_file", "path"),
        _rule(m.filter(there & F.col("_norm").isNull()), "not_utf8", "path"),
        _rule(m.filter(there & ~F.col("_raw").eqNullSafe(F.col("raw_sha256"))), "raw_hash", "path"),
        _rule(m.filter(F.col("_norm").isNotNull() & ~F.col("_norm").eqNullSafe(F.col("normalized_sha256"))), "normalized_hash", "path"),
        _rule(now.join(listed, "path", "left_anti"), "unlisted_file", "path"))


def audit_quotas(quotas: DataFrame, types: DataFrame, manifest: DataFrame) -> DataFrame:
    """Mismatches (scope, name, declared, counted) between domain quotas (domain, question_type, n),
    declared type totals (question_type, count) and document targets of the manifest."""
    per_type = quotas.groupBy("question_type").agg(F.sum("n").alias("counted"))
    by_type = types.select(F.col("question_type").alias("name"), F.col("count").alias("declared")).join(
        per_type.withColumnRenamed("question_type", "name"), "name", "full_outer").select(
        F.lit("type").alias("scope"), "name", "declared", "counted")
    positive = quotas.filter(F.col("question_type").isin(ANSWERABLE_TYPES)).groupBy(
        F.col("domain").alias("name")).agg(F.sum("n").alias("declared"))
    targets = manifest.groupBy(F.col("domain").alias("name")).agg(
        F.sum(F.col("positive_question_target").cast("long")).alias("counted"))
    by_domain = positive.join(targets, "name", "full_outer").select(
        F.lit("domain").alias("scope"), "name", "declared", "counted")
    unknown = types.filter(~F.col("question_type").isin(ANSWERABLE_TYPES + [UNANSWERABLE])).select(
        F.lit("unknown_type").alias("scope"), F.col("question_type").alias("name"),
        F.col("count").alias("declared"), F.lit(None).cast("long").alias("counted"))
    return by_type.unionByName(by_domain).filter(~F.col("declared").eqNullSafe(F.col("counted"))).unionByName(unknown)


def quota_rollup(quotas: DataFrame) -> DataFrame:
    """Totals per (domain, type), per domain and overall."""
    return quotas.rollup("domain", "question_type").agg(F.sum("n").alias("n"))


def _normal_query(c="query"):
    return casefold(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), rf"{WS}+", ""))


def validate_questions(questions: DataFrame, qrels: DataFrame, evidence: DataFrame, sources: DataFrame,
                       corpus_ids: DataFrame, type_plan: DataFrame, domain_plan: DataFrame) -> DataFrame:
    """Violations (rule, key) of a question set against sources (path, normalized_text,
    normalized_sha256), corpus ids and the type / domain counts of the plan."""
    spans = evidence.join(sources.select(F.col("path").alias("source_id"), "normalized_text", "normalized_sha256"),
                          "source_id", "left")
    quoted = F.substring(F.col("normalized_text"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    key = F.concat_ws("/", F.col("query_id").cast("string"), F.col("ord").cast("string"))

    def counts(col, plan):
        have = questions.groupBy(F.col(col).alias("name")).agg(F.count("*").alias("have"))
        return have.join(plan, "name", "full_outer").filter(~F.col("have").eqNullSafe(F.col("count")))

    return _violations(
        _rule(_repeated(questions, "query_id"), "duplicate_id", "query_id"),
        _rule(_repeated(questions.withColumn("_k", _normal_query()), "_k"), "duplicate_query", F.md5("_k")),
        _rule(qrels.join(corpus_ids.select("doc_id"), "doc_id", "left_anti"), "unknown_chunk",
              F.concat_ws("/", F.col("query_id").cast("string"), F.col("doc_id").cast("string"))),
        _rule(spans.filter(~F.coalesce(F.col("source_sha256") == F.col("normalized_sha256"), F.lit(False))),
              "source_hash", key),
        _rule(spans.filter(~F.coalesce(quoted == F.col("quote"), F.lit(False))), "quote_mismatch", key),
        _rule(counts("question_type", type_plan), "type_quota", "name"),
        _rule(counts("category", domain_plan), "domain_quota", "name"))


def dedupe_negatives(candidates: DataFrame, order: str = "pos") -> DataFrame:
    """Non-blank, supported action, first of each normalised query."""
    keyed = candidates.withColumn("_k", _normal_query()).filter(
        (F.coalesce(strip("query"), F.lit("")) != "") & F.col("expected_action").isin(ACTIONS[1:]))
    return keyed.groupBy("_k").agg(F.min_by(F.struct(order, strip("query").alias("query"), "expected_action"), order)
                                   .alias("r")).select("r.*")


def assemble_gold(selections: DataFrame, spans: DataFrame, questions: DataFrame) -> dict:
    """Gold tables from selected spans (question_key, pos, span_id), spans (span_id, chunk_id, source_id,
    start_char, end_char, quote) and questions (question_key, path, query, question_type, answer):
    ``questions``, ``qrels`` (grade 3), ``evidence`` and ``rejects``."""
    first = selections.groupBy("question_key", "span_id").agg(F.min("pos").alias("pos"))
    known = first.join(spans, "span_id")
    unknown = first.join(spans.select("span_id"), "span_id", "left_anti").select("question_key").distinct()
    chunks = known.groupBy("question_key").agg(F.count_distinct("chunk_id").alias("_chunks"))
    state = questions.join(unknown.withColumn("_unknown", F.lit(True)), "question_key", "left").join(
        chunks, "question_key", "left")
    reason = (F.when((F.coalesce(strip("query"), F.lit("")) == "") | (F.coalesce(strip("answer"), F.lit("")) == ""),
                     "incomplete").when(F.col("_unknown"), "unknown_span")
              .when(F.col("_chunks").isNull(), "no_evidence")
              .when((F.col("question_type") == "multi_evidence") & (F.col("_chunks") < 2), "single_chunk"))
    judged = state.withColumn("reason", reason)
    ok = judged.filter("reason IS NULL").withColumn("query_id", stable_id("q", "path", strip("query")))
    rows = known.join(ok.select("question_key", "query_id"), "question_key")
    w = Window.partitionBy("query_id").orderBy("pos", "span_id")
    return {
        "questions": ok.select("query_id", "path", "query", "question_type", F.col("answer").alias("reference_answer")),
        "qrels": rows.select("query_id", F.col("chunk_id").alias("doc_id")).distinct().withColumn("grade", F.lit(3.0)),
        "evidence": rows.withColumn("ord", F.row_number().over(w)).select(
            "query_id", "ord", "source_id", "start_char", "end_char", "quote"),
        "rejects": judged.filter("reason IS NOT NULL").select("question_key", "reason"),
    }


def gold_claims(gold: dict) -> DataFrame:
    """claims(query_id, ord, claim): the quoted spans of each question, in the order of its evidence."""
    return gold["evidence"].select("query_id", "ord", F.col("quote").alias("claim"))


def bind_sources(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence with the hashes of the file that it quotes, ``source_sha256`` of the normalised text and ``raw_source_sha256`` of the bytes."""
    hashes = sources.select(F.col("path").alias("source_id"), F.col("normalized_sha256").alias("source_sha256"), F.col("raw_sha256").alias("raw_source_sha256"))
    return evidence.join(hashes, "source_id", "left").select(*evidence.columns, "source_sha256", "raw_source_sha256")


def audit_evidence(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Violations of bound evidence against the files as they are now: missing source, changed bytes or text, a quote that is not at its place."""
    now = sources.select(F.col("path").alias("source_id"), "normalized_text", F.col("normalized_sha256").alias("_norm"), F.col("raw_sha256").alias("_raw"))
    # the quote is looked up beside the text, so that texts do not travel behind the join
    rows = evidence.join(now, "source_id", "left").select(
        F.concat_ws("/", F.col("query_id").cast("string"), F.col("ord").cast("string")).alias("key"), F.col("_raw").isNotNull().alias("there"),
        F.col("_raw").eqNullSafe(F.col("raw_source_sha256")).alias("same_bytes"), F.col("_norm").eqNullSafe(F.col("source_sha256")).alias("same_text"),
        F.coalesce(F.substring(F.col("normalized_text"), F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) == F.col("quote"), F.lit(False)).alias("quoted"))
    rules = [("missing_source", ~F.col("there")), ("raw_hash", F.col("there") & ~F.col("same_bytes")),
             ("source_hash", F.col("there") & ~F.col("same_text")), ("quote_mismatch", F.col("there") & ~F.col("quoted"))]
    return rows.select(F.explode(F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules]))).alias("rule"), "key")
