"""Whole searches over a question table: hybrid, multi-rewrite, single leg, filtered, compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.tokens import tokenize
from ..operators import fusion as U
from ..operators import select as P
from ..operators.dense import dense_search
from ..operators.lexical import bm25_search, rank_top
from ..session import broadcast_if_small, materialize


def containing_documents(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id) of the documents (doc_id, text) that contain a passage verbatim.

    A document holding the passage holds its inner words as whole tokens, so the passage is looked
    up by its rarest inner word and only those documents are compared. A passage without an inner
    word is looked up by its first symbols. An empty passage has no documents.
    """
    queries = queries.filter(F.length("query") > 0)
    q_tokens = tokenize("query")
    inner = queries.select("query_id", F.explode(F.array_distinct(F.slice(
        q_tokens, F.lit(2), F.greatest(F.size(q_tokens) - 2, F.lit(0))))).alias("term"))
    wanted = broadcast_if_small(inner.select("term").distinct())
    # words of a document that occur in some passage; nothing but these pairs leaves the map stage
    words = docs.select("doc_id", tokenize("text").alias("_t")).select(
        "doc_id", F.explode_outer(F.array_distinct("_t")).alias("term")).join(wanted, "term", "left_semi")
    df = words.groupBy("term").agg(F.count("*").alias("df"))
    rarest = inner.join(df, "term", "left").groupBy("query_id").agg(
        F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    # both are small next to the documents and known before these are read, so that neither words nor texts are shuffled
    pairs = words.join(broadcast_if_small(materialize(rarest, "rarest-words")), "term").select("query_id", "doc_id").unionByName(_by_first_symbols(
        queries.join(inner.select("query_id").distinct(), "query_id", "left_anti"), docs)).distinct()
    asked = broadcast_if_small(materialize(pairs.join(queries, "query_id"), "passage-candidates"))
    return asked.join(docs, "doc_id").filter(F.contains("text", "query")).select("query_id", "doc_id")


def _gram_at(width: int):
    return lambda i: F.array_join(F.slice("_c", i + 1, F.lit(width)), "")


def _by_first_symbols(queries: DataFrame, docs: DataFrame, n: int = 3) -> DataFrame:
    """(query_id, doc_id) of documents that hold the first ``n`` symbols of a passage (all of a shorter one)."""
    asked = queries.select("query_id", F.substring("query", 1, n).alias("gram"))
    wanted = broadcast_if_small(asked.select("gram").distinct())
    at = F.sequence(F.lit(0), F.size("_c") - 1)
    grams = F.flatten(F.array(*[F.transform(at, _gram_at(w)) for w in range(1, n + 1)]))
    held = docs.select("doc_id", F.split("text", "").alias("_c")).filter(F.size("_c") > 0).select(
        "doc_id", F.explode(F.array_distinct(grams)).alias("gram")).join(wanted, "gram", "left_semi")
    return held.join(asked, "gram").select("query_id", "doc_id")


def recall_many(index: dict, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame,
                k_lexical: int = S.LEXICAL_TOP_K, k_dense: int = S.DENSE_TOP_K) -> DataFrame:
    """Both legs for every distinct question; a leg without hits simply has no rows."""
    return U.legs(bm25=bm25_search(index, queries, k_lexical),
                  embedding=dense_search(vectors, query_vectors, k_dense))


def search_hybrid(ranked: DataFrame, queries: DataFrame, chunks: DataFrame, scorer, k: int = S.FINAL_TOP_K,
                  fuse_top: int = S.RRF_TOP_K) -> DataFrame:
    """Fuse both legs, fetch texts, rerank, filter, format. No parent collapse and no budget."""
    fused = U.single_leg_fallback(ranked, top=fuse_top)
    found = U.candidates(fused, chunks).join(queries.select("query_id", "query"), "query_id")
    best = P.filter_reranked(P.rerank(found, scorer, k), k)
    return P.format_result(best)


def search_multi(ranked: DataFrame, groups: DataFrame, chunks: DataFrame, scorer, k: int = S.FINAL_TOP_K,
                 budget: int = S.CONTEXT_BUDGET, candidates_top: int = S.RERANK_CANDIDATES) -> dict:
    """Several rewrites per question.

    ``ranked`` holds the legs of every rewrite (query_id = rewrite id) with its ``group_id``;
    ``groups`` the standalone question (group_id, query). Every leg is collapsed to parents, all
    lists of a group are fused once, reranked once with the standalone question, filtered and
    packed into the token budget. Returns the stage tables.
    """
    collapsed = U.collapse_to_parents(ranked, keys=("group_id", "query_id", "leg"))
    fused = U.rrf_fuse(collapsed, top=max(k, candidates_top), keys=("group_id",)).withColumnRenamed(
        "group_id", "query_id")
    found = U.candidates(fused, chunks).join(groups.withColumnRenamed("group_id", "query_id"), "query_id")
    kept = P.filter_reranked(P.rerank(found, scorer, k), k)
    formatted = P.format_result(kept)
    return {"collapsed": collapsed, "fused": fused, "candidates": found, "formatted": formatted,
            "selected": P.pack_token_budget(formatted, budget)}


def retrieval_stats(ranked: DataFrame, stages: dict, groups: DataFrame, budget: int = S.CONTEXT_BUDGET) -> DataFrame:
    """One row per question group over the stage tables of ``search_multi``."""
    def per(df, key, *aggs):
        return df.groupBy(F.col(key).alias("group_id")).agg(*aggs)

    parts = [
        per(ranked, "group_id", F.count_distinct("query_id").alias("query_count"),
            F.count_if(F.col("leg") == "bm25").alias("bm25_hits"),
            F.count_if(F.col("leg") == "embedding").alias("embedding_hits")),
        per(stages["fused"], "query_id", F.count("*").alias("fused_candidates")),
        per(stages["candidates"], "query_id", F.count("*").alias("reranked_candidates")),
        per(stages["formatted"], "query_id", F.count("*").alias("quality_filtered_candidates")),
        per(stages["selected"], "query_id", F.count("*").alias("selected_results"),
            F.sum("context_tokens").alias("context_tokens"), F.max(F.col("context_truncated")).alias("_cut")),
    ]
    out = groups.select("group_id")
    for part in parts:
        out = out.join(part, "group_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in
            ("query_count", "bm25_hits", "embedding_hits", "fused_candidates", "reranked_candidates",
             "quality_filtered_candidates", "selected_results", "context_tokens")]
    return out.select("group_id", *zero, F.lit(budget).alias("token_budget"), (
        F.coalesce("_cut", F.lit(False)) | (F.coalesce("selected_results", F.lit(0))
                                            < F.coalesce("quality_filtered_candidates", F.lit(0)))).alias("context_truncated"))


def search_single_leg(ranking: DataFrame, chunks: DataFrame, score_name: str, k: int) -> DataFrame:
    """Formatted results of one leg."""
    found = U.candidates(rank_top(ranking, k), chunks).withColumnsRenamed({"rrf_score": "score", "fused_rank": "rank"})
    return P.format_result(found, score_name)


def search_with_filter(bm25_leg: DataFrame, vectors: DataFrame, query_vectors: DataFrame, predicate: Column,
                       k_dense: int = S.DENSE_TOP_K, strict_ids: DataFrame | None = None, **kw) -> DataFrame:
    """Both legs where the predicate restricts the dense leg only; dates are accepted and ignored.

    ``strict_ids`` (doc_id), when given, restricts the lexical leg as well.
    """
    lexical = bm25_leg if strict_ids is None else bm25_leg.join(strict_ids, "doc_id", "left_semi")
    return U.legs(bm25=lexical, embedding=dense_search(vectors.filter(predicate), query_vectors, k_dense, **kw))


def compare_methods(ranked: DataFrame, k: int = S.FINAL_TOP_K) -> DataFrame:
    """bm25, embedding and hybrid top ``k`` side by side as (method, query_id, doc_id, score, rank)."""
    cols = ["query_id", "doc_id", "score", "rank"]
    single = ranked.filter(F.col("rank") <= k).select(F.col("leg").alias("method"), *cols)
    return single.unionByName(U.rrf_fuse(ranked, top=k).select(F.lit("hybrid").alias("method"), *cols))
