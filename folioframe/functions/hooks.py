"""Hooks for models (segmenter, embedder, reranker, grader, rewriter) and SQL functions.

A hook wraps a plain batch function as an Arrow UDF. An embedder or reranker is built once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F




def register_segmenter(spark: SparkSession, fn: Callable[[str], list], name: str = "segment"):
    """``fn(text) -> tokens`` as array<string>, also callable from SQL."""
    @F.pandas_udf("array<string>")
    def segment(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(fn(t)) if t is not None else [])
    spark.udf.register(name, segment)
    return segment


def register_embedder(spark: SparkSession, load: Callable[[], Callable[[list], list]], dims: int, name: str = "embed"):
    """``load()`` returns ``fn(list of texts) -> list of vectors``; wrong counts or sizes are errors."""
    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            vectors = model(texts.tolist())
            if len(vectors) != len(texts) or any(len(v) != dims for v in vectors):
                raise ValueError(f"embedder must return one vector of {dims} numbers per text")
            yield pd.Series(list(vectors))
    spark.udf.register(name, embed)
    return embed


def register_reranker(spark: SparkSession, load: Callable[[], Callable[[list, list], list]], name: str = "rerank_score"):
    """``load()`` returns ``fn(queries, texts) -> scores``."""
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in batches:
            yield pd.Series(model(queries.tolist(), texts.tolist()), dtype="float64")
    spark.udf.register(name, score)
    return score


def grade(rows: DataFrame, fn: Callable[[str, list], dict], max_docs: int = 5, max_chars: int = 600) -> dict:
    """Grade evidence rows (query_id, query, rank, content). ``fn(query, texts)`` returns
    {"scores": [...], "coverage": "..."}; an exception leaves the question without scores, so that the
    checks fail it closed. At most ``max_docs`` rows of a question reach one call."""
    w = Window.partitionBy("query_id").orderBy("rank")
    head = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= max_docs).select(
        "query_id", "query", "_n", F.substring("content", 1, max_chars).alias("content"))
    key = head.schema["query_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        scores, coverage = [], None
        try:
            answer = fn(pdf["query"].iloc[0], pdf["content"].tolist())
            scores, coverage = list(answer["scores"]), str(answer["coverage"])
        except Exception:  # noqa: BLE001 - fail closed
            scores = []
        n, qid = len(pdf), pdf["query_id"].iloc[0]
        out = [(qid, i, float(s), n, coverage) for i, s in enumerate(scores)] or [(qid, None, None, n, coverage)]
        return pd.DataFrame(out, columns=["query_id", "doc_index", "score", "n_documents", "coverage"])

    graded = head.groupBy("query_id").applyInPandas(
        run, f"query_id {key}, doc_index long, score double, n_documents long, coverage string")
    return {"scores": graded.filter("doc_index IS NOT NULL").select("query_id", "doc_index", "score"),
            "coverage": graded.select("query_id", "n_documents", "coverage").distinct()}


def register_rewriter(spark: SparkSession, fn: Callable[[str], list], strategy: str = "fusion", name: str = "rewrite"):
    """``fn(question) -> [standalone, variants…]``: the first is the standalone question, at most three
    variants follow. Strategy ``none`` returns the question; an error or nothing falls back to it."""
    limit = {"none": 0, "hyde": 2, "fusion": 4}[strategy]

    @F.pandas_udf("array<string>")
    def rewrite(questions: pd.Series) -> pd.Series:
        def one(q):
            try:
                found = [x.strip() for x in fn(q) if isinstance(x, str) and x.strip()][:limit] if limit else []
            except Exception:  # noqa: BLE001
                found = []
            return list(dict.fromkeys(found)) or [q]
        return questions.map(one)
    spark.udf.register(name, rewrite)
    return rewrite


def create_chunk_view(pages: DataFrame, name: str = "markdown_chunks", **sizes) -> None:
    """SQL name for the parents and children of a page table; built from column expressions, so a
    filter or projection in the SQL still reaches the scan."""
    from ..operators.chunking import chunk_pages
    chunk_pages(pages, **sizes).createOrReplaceTempView(name)


def create_sql_functions(spark: SparkSession) -> None:
    """``ndcg(grades_in_rank_order, all_grades, k)`` and ``coverage(intervals, start, end)`` for SQL."""
    gain = "aggregate(slice({0}, 1, k), named_struct('s', 0D, 'i', 1), (a, g) -> named_struct('s', a.s + " \
           "CASE WHEN g > 0 THEN (pow(2D, g) - 1) / log2(a.i + 1) ELSE 0D END, 'i', a.i + 1), a -> a.s)"
    ideal = "sort_array(filter(all_grades, g -> g > 0), false)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ndcg(grades ARRAY<DOUBLE>, all_grades ARRAY<DOUBLE>, k INT) RETURNS DOUBLE "
              f"RETURN coalesce(try_divide({gain.format('grades')}, {gain.format(ideal)}), 0D)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION coverage(intervals ARRAY<STRUCT<l: BIGINT, r: BIGINT>>, s BIGINT, e BIGINT) "
              "RETURNS DOUBLE RETURN coalesce(try_divide(CAST(aggregate(array_sort(intervals), named_struct('sum', 0L, 'seen', s), "
              "(a, i) -> named_struct('sum', a.sum + greatest(0L, least(i.r, e) - greatest(i.l, a.seen)), 'seen', greatest(a.seen, least(i.r, e))), "
              "a -> a.sum) AS DOUBLE), CAST(e - s AS DOUBLE)), 0D)")


