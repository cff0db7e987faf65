"""Okapi BM25 over postings, for a whole table of questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import settings as S
from ..functions.tokens import tokenize, tokenize_eval
from ..session import broadcast_if_small, fits, materialize
from . import index as ix


def query_terms(queries: DataFrame, id_col: str = "query_id", text: str = "query",
                mode: str = "search") -> DataFrame:
    """(query_id, term, qtf); repeated question words count as often as they occur."""
    tokens = tokenize(text) if mode == "search" else tokenize_eval(text)
    return queries.select(F.col(id_col).alias("query_id"), F.explode(tokens).alias("term")).groupBy(
        "query_id", "term").agg(F.count("*").alias("qtf"))


def rank_top(scored: DataFrame, k: int, by: str = "score", keys=("query_id",), tie: str = "doc_id",
             rank: str = "rank") -> DataFrame:
    """Top ``k`` per key by score, ties by id. Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc(), F.col(tie).asc())
    return scored.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def bm25_scores(postings: DataFrame, term_df: DataFrame, stats: DataFrame, terms: DataFrame,
                k1: float = S.BM25_K1, b: float = S.BM25_B, broadcast_rows: int = 500_000,
                salts: int = 16) -> DataFrame:
    """(query_id, doc_id, score) of every document sharing a term with the question.

    A question side whose size was checked is broadcast: the postings stay where they are and the
    sum per (question, document) needs no shuffle. A larger one is joined on (term, salt), the salt
    being taken from the document, so a term found in a third of all documents fills ``salts``
    tasks and not one.
    """
    # the question terms pick their statistics; the vocabulary is never broadcast
    weighted = terms.join(term_df, "term").join(F.broadcast(stats)).withColumn("idf", ix.floored_idf())
    small = fits(terms, broadcast_rows)
    if small:
        joined = postings.join(F.broadcast(weighted), "term")
    else:
        spread = weighted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = postings.withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(salts)).cast("int"))
        joined = salted.join(spread, ["term", "_salt"])
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / norm
    return joined.groupBy("query_id", F.col("chunk_id").alias("doc_id")).agg(
        F.round(F.sum(part), S.SCORE_DECIMALS).alias("score"))


def bm25_search(index: dict, queries: DataFrame, k: int = S.LEXICAL_TOP_K, id_col: str = "query_id",
                text: str = "query", mode: str = "search", **kw) -> DataFrame:
    """rankings(query_id, doc_id, score, rank) with positive scores only; a kept index is searched where it lies."""
    if "store" in index:
        return index["store"].search(queries, k, id_col, text, **kw)
    terms = query_terms(queries, id_col, text, mode)
    scores = bm25_scores(index["postings"], index["term_df"], index["stats"], terms, **kw)
    return rank_top(scores.filter("score > 0"), k)


def bm25_search_eval(index: dict, queries: DataFrame, k: int, id_col: str = "query_id",
                     text: str = "query") -> DataFrame:
    """As ``bm25_search`` on evaluation tokens, zero and negative scores kept.

    Documents without a common term score zero and come before negative scores, in id order. They are
    needed only where fewer than ``k`` scores are zero or more; then the lowest ids are tried, four
    times as many each time, until every such question has enough or all documents were tried.
    """
    terms = query_terms(queries, id_col, text, "eval")
    store = index.get("store")

    def scored(some: DataFrame | None = None) -> DataFrame:
        asked = terms if some is None else terms.join(some, "query_id", "left_semi")
        return store.scores(asked) if store else bm25_scores(index["postings"], index["term_df"], index["stats"], asked)

    top = materialize((store.best(terms, k, 0.0) if store else rank_top(scored().filter("score >= 0"), k)).drop("rank"), "eval-top")
    counts = top.groupBy("query_id").agg(F.count("*").alias("_n"))
    short = materialize(queries.select(F.col(id_col).alias("query_id")).distinct().join(counts, "query_id", "left").select(
        "query_id", F.coalesce("_n", F.lit(0)).alias("_n")).filter(F.col("_n") < k), "eval-short")
    if not short.limit(1).count():
        return rank_top(top, k)
    few = broadcast_if_small(short.select("query_id"))
    below = rank_top(scored(few).filter("score < 0"), k).drop("rank")
    ids, tried = index["doc_ids"].select(F.col("chunk_id").alias("doc_id")), 4 * k
    n_docs = ids.count()
    while True:
        lowest = ids.orderBy("doc_id").limit(tried)
        lowest = broadcast_if_small(lowest)
        seen = scored(few).join(lowest, "doc_id", "left_semi").select("query_id", "doc_id")
        filler = materialize(rank_top(short.join(lowest).join(seen, ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0)), k), "eval-zero")
        have = filler.groupBy("query_id").agg(F.count("*").alias("_zero"))
        if tried >= n_docs or not short.join(have, "query_id", "left").filter(F.col("_n") + F.coalesce("_zero", F.lit(0)) < k).limit(1).count():
            break
        tried *= 4
    return rank_top(top.unionByName(filler.select(*top.columns)).unionByName(below), k)


def lexical_index(chunks: DataFrame, id_col: str = "chunk_id", text: str = "text",
                  mode: str = "search") -> dict:
    """The index tables as lazy DataFrames."""
    postings = ix.build_postings(chunks, id_col, text, mode)
    term_df = ix.document_frequencies(postings)
    ids = chunks.select(F.col(id_col).alias("chunk_id"))
    # one row of constants; the total length is the sum of the term counts, so the text is
    # tokenized only for the postings (their exchange is shared by every use)
    n_docs = ids.agg(F.count("*").alias("n_docs"))
    stats = ix.index_constants(term_df, n_docs)
    return {"postings": postings, "doc_ids": ids, "stats": stats, "term_df": term_df}
