"""Retrieval ablation: four methods over one index, every question at once."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import settings as S
from ..operators import evaluate as E
from ..operators import fusion as U
from ..operators import select as P
from ..operators.dense import cosine_eval
from ..operators.lexical import bm25_search_eval
from ..session import materialize

METHODS = ("bm25", "embedding", "hybrid", "hybrid_reranker")


def collapsed_legs(index, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, k: int = S.FINAL_TOP_K) -> DataFrame:
    """Both legs with parents collapsed. They are a few rows per question and feed all methods, so they are written once to the shared folder."""
    depth_l, depth_d = max(S.LEXICAL_TOP_K, k), max(S.DENSE_TOP_K, k)
    both = U.legs(bm25=bm25_search_eval(index, queries, depth_l),
                  embedding=cosine_eval(vectors, query_vectors, depth_d))
    return materialize(U.collapse_to_parents(both.withColumn("doc_id", F.col("doc_id").cast("string"))), "legs")


def method_rankings(collapsed: DataFrame, queries: DataFrame, chunks: DataFrame, scorer, k: int = S.FINAL_TOP_K) -> dict[str, Callable[[], DataFrame]]:
    """Ranking (query_id, doc_id, rank) of each method, to be built when it is called."""
    cols = ["query_id", "doc_id", "rank"]

    def leg(name: str) -> DataFrame:
        return collapsed.filter((F.col("leg") == name) & (F.col("rank") <= k)).select(*cols)

    def fused() -> DataFrame:
        return U.rrf_fuse(collapsed, top=max(S.RRF_TOP_K, k))

    def reranked() -> DataFrame:
        texts = chunks.withColumn("chunk_id", F.col("chunk_id").cast("string"))
        return P.rerank(U.candidates(fused(), texts).join(queries, "query_id"), scorer, k).select(*cols)

    return {"bm25": lambda: leg("bm25"), "embedding": lambda: leg("embedding"),
            "hybrid": lambda: fused().filter(F.col("rank") <= k).select(*cols), "hybrid_reranker": reranked}


def ablation_rankings(index: dict, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame,
                      chunks: DataFrame, scorer, k: int = S.FINAL_TOP_K) -> DataFrame:
    """rankings(method, query_id, doc_id, rank) of the four methods."""
    ranked = method_rankings(collapsed_legs(index, vectors, queries, query_vectors, k), queries, chunks, scorer, k)
    return reduce(DataFrame.unionByName, [ranked[m]().select(F.lit(m).alias("method"), "query_id", "doc_id", "rank") for m in METHODS])


def method_questions(queries: DataFrame, methods=METHODS) -> DataFrame:
    """(method, query_id, …) rows to report."""
    return queries.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))


def ablation_report(rankings: DataFrame, qrels: DataFrame, queries: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """Macro means per method and per (method, category); category NULL is the method total."""
    per_query = E.query_metrics(rankings, qrels, method_questions(queries), ks)
    names = [c for c in per_query.columns if c == "mrr" or c.split("_")[-1].isdigit()]
    return E.aggregate_metrics(per_query, names)


# --- a whole run, with what failed and how long it took ---------------------------------------

def _timed(work: Callable):
    """(result or None, error or None, milliseconds)."""
    started = time.perf_counter()
    try:
        result, error = work(), None
    except Exception as problem:       # a method that fails is a row of the report, the others go on
        result, error = None, f"{type(problem).__name__}: {str(problem).splitlines()[0] if str(problem) else ''}"
    return result, error, (time.perf_counter() - started) * 1000


def run_methods(prepare: Callable, methods: dict[str, Callable], queries: DataFrame, without_setup: tuple = ()) -> dict:
    """Prepare once, run each method as a job of its own, keep what fails.

    ``prepare()`` gives the context that ``methods`` (name: context -> (query_id, doc_id, rank)) need; those of ``without_setup`` run
    without it. Returns ``rankings``, ``errors`` (method, query_id, error), ``latency`` (method, latency_ms: the time of the
    method's job, which answers all questions at once, by question) and ``setup`` (status, latency_ms, error).
    """
    spark, n = queries.sparkSession, max(queries.count(), 1)
    context, setup_error, setup_ms = _timed(prepare)
    parts, failed, times = [], [], []
    for name, rank in methods.items():
        def work(rank=rank, name=name):
            if setup_error and name not in without_setup:
                raise RuntimeError(setup_error)
            return materialize(rank(context).select("query_id", F.col("doc_id").cast("string").alias("doc_id"), "rank"), f"ranking-{name}")
        ranking, error, ms = _timed(work)
        times.append((name, ms / n))
        if error:
            failed.append((name, error))
        else:
            parts.append(ranking.select(F.lit(name).alias("method"), "query_id", "doc_id", "rank"))
    empty = queries.select(F.lit(None).cast("string").alias("method"), "query_id", F.lit(None).cast("string").alias("doc_id"), F.lit(0).alias("rank")).limit(0)
    messages = spark.createDataFrame(failed, "method string, error string")       # a row a method
    needed = [m for m in methods if m not in without_setup]
    status = "not_required" if not needed else "failed" if setup_error else "succeeded"
    return {"rankings": reduce(DataFrame.unionByName, parts, empty), "errors": queries.select("query_id").join(F.broadcast(messages)),
            "latency": spark.createDataFrame(times, "method string, latency_ms double"),
            "setup": spark.createDataFrame([(status, setup_ms, setup_error)], "status string, latency_ms double, error string")}


def full_report(run: dict, qrels: DataFrame, queries: DataFrame, docs: DataFrame, config: dict, methods: list, ks=(1, 3, 5), workload: DataFrame | None = None) -> dict:
    """The parts of a report: ``methods`` (means, failures, time), ``categories``, ``setup``, ``dataset``, ``configuration``, ``workload``.

    ``queries`` is (query_id, category, expected_action[, label_origin]); the methods are measured on its answerable questions.
    """
    if not methods:
        raise ValueError("a run needs a method")
    if config["top_k"] < max(ks):
        raise ValueError("top_k must reach the largest k of a metric")
    asked = queries.filter("expected_action = 'answer'").select("query_id", "category")
    per_query = E.query_metrics(run["rankings"], qrels, method_questions(asked, methods), ks)
    names = [c for c in per_query.columns if c == "mrr" or c.split("_")[-1].isdigit()]
    errors = run["errors"].join(asked.select("query_id"), "query_id", "left_semi")
    labelled = queries if "label_origin" in queries.columns else queries.withColumn("label_origin", F.lit(None).cast("string"))
    parts = {
        "methods": E.evaluate_method(per_query, errors, names).join(F.broadcast(run["latency"]), "method", "left"),     # a row a method
        "categories": E.aggregate_metrics(per_query, names).filter("category IS NOT NULL"),
        "setup": run["setup"], "dataset": E.dataset_summary(docs, labelled),
        "configuration": queries.sparkSession.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in config.items()], "name string, value string"),
    }
    return parts if workload is None else parts | {"workload": workload}
