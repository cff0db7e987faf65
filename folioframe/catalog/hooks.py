"""Registered hook queries (UDF)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hooks as H
from ..operators import index as I
from ..operators import select as P
from .chunks import UNITS
from .data import markdown, questions
from .registry import query


@query("udf1_register_segmenter", "SELECT doc_id, len(string_split(text, ' '))::BIGINT AS n FROM documents")
def udf1(t):
    segment = H.register_segmenter(t.spark, lambda s: s.split(" "))
    return t.documents.select("doc_id", F.size(segment("text")).alias("n"))


@query("udf2_register_embedder", r"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g'))::DOUBLE AS first FROM documents")
def udf2(t):
    embed = H.register_embedder(t.spark, lambda: (lambda texts: [[float(len(s)), 1.0] for s in texts]), 2)
    return I.embed(t.documents, embed, 2).select("doc_id", F.col("embedding")[0].cast("double").alias("first"))


@query("udf3_register_reranker", """SELECT query_id, doc_id, rank FROM (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rank FROM documents) WHERE rank <= 5""")
def udf3(t):
    score = H.register_reranker(t.spark, lambda: (lambda qs, ds: [float(len(d)) for d in ds]))
    rows = t.documents.select(F.col("source").alias("query_id"), F.lit("q").alias("query"), "doc_id", F.col("text").alias("content"))
    return P.rerank(rows, score).select("query_id", "doc_id", "rank")


@query("udf4_register_grader", """WITH r AS (SELECT source AS q, length(text[1:600]) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)
SELECT q AS query_id, CASE WHEN q = 'src3' THEN 'incorrect' WHEN count(*) FILTER (n >= 420) > 0 THEN 'correct' WHEN count(*) FILTER (n > 180) > 0 THEN 'ambiguous' ELSE 'incorrect' END AS grade, q = 'src3' AS grading_failed FROM r WHERE k <= 5 GROUP BY 1""")
def udf4(t):
    rows = t.documents.select(F.col("source").alias("query_id"), F.col("source").alias("query"), F.col("doc_id").alias("rank"), F.col("text").alias("content"))

    def judge(query_, texts):
        if query_ == "src3":
            raise RuntimeError("model down")
        return {"scores": [len(x) / 600 for x in texts], "coverage": "complete"}

    g = H.grade(rows, judge)
    return P.grade_scores(g["scores"], g["coverage"]).select("query_id", "grade", "grading_failed")


@query("udf5_register_rewriter", "SELECT item_id AS query_id, least(len(list_filter(string_split(text, '.'), lambda x: trim(x) <> '')), 4)::BIGINT AS n FROM benchmark")
def udf5(t):
    rewrite = H.register_rewriter(t.spark, lambda q: q.split("."))
    return questions(t).select("query_id", F.size(rewrite("query")).alias("n"))


@query("udf6_markdown_chunks", f"WITH RECURSIVE {UNITS} SELECT doc_id AS page_id, CASE WHEN child_index < 0 THEN 'parent' ELSE 'child' END AS chunk_level, count(*) AS n FROM unit GROUP BY ALL")
def udf6(t):
    pages = t.documents.select(F.col("doc_id").alias("page_id"), F.lit(1).alias("revision"), F.lit("t").alias("title"), markdown().alias("content"))
    H.create_chunk_view(pages, "markdown_chunks", clean=False)
    return t.spark.sql("SELECT page_id, chunk_level, count(*) AS n FROM markdown_chunks GROUP BY ALL")


@query("udf7_ndcg", """WITH r AS (SELECT l_orderkey AS q, l_linenumber AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS rank,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS best FROM lineitem)
SELECT q AS query_id, round(sum(CASE WHEN rank <= 3 THEN (pow(2, g) - 1) / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN best <= 3 THEN (pow(2, g) - 1) / log2(best + 1) ELSE 0 END), 6) AS ndcg FROM r GROUP BY 1""")
def udf7(t):
    H.create_sql_functions(t.spark)
    t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").createOrReplaceTempView("graded_lines")
    # only the first three of either order enter the lists
    return t.spark.sql("""
      WITH r AS (SELECT l_orderkey AS query_id, CAST(l_linenumber AS DOUBLE) AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS rank FROM graded_lines),
      i AS (SELECT l_orderkey AS query_id, CAST(l_linenumber AS DOUBLE) AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS best FROM graded_lines),
      a AS (SELECT query_id, transform(array_sort(collect_list(struct(rank, g))), x -> x.g) AS got FROM r WHERE rank <= 3 GROUP BY query_id),
      b AS (SELECT query_id, collect_list(g) AS ideal FROM i WHERE best <= 3 GROUP BY query_id)
      SELECT a.query_id, round(ndcg(got, ideal, 3), 6) AS ndcg FROM a JOIN b ON a.query_id = b.query_id""")


@query("udf7_coverage", """WITH s AS (SELECT l_orderkey AS q, unnest(range(greatest(0, l_quantity::BIGINT), least(40, l_quantity::BIGINT + l_linenumber * 3))) AS c FROM lineitem)
SELECT o_orderkey AS query_id, round(count(DISTINCT c) / 40.0, 6)::DOUBLE AS coverage FROM (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem) LEFT JOIN s ON q = o_orderkey GROUP BY 1""")
def udf7c(t):
    H.create_sql_functions(t.spark)
    # spans of one order within a text of 40 characters; equal spans are merged before they are listed
    spans = t.lineitem.select("l_orderkey", F.struct(F.col("l_quantity").cast("long").alias("l"), (F.col("l_quantity").cast("long") + F.col("l_linenumber") * 3).alias("r")).alias("i"))
    spans.groupBy("l_orderkey").agg(F.collect_set("i").alias("spans")).createOrReplaceTempView("order_spans")
    return t.spark.sql("SELECT l_orderkey AS query_id, round(coverage(spans, 0L, 40L), 6) AS coverage FROM order_spans")
