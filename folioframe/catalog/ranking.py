"""Registered retrieval and ranking queries (RT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings as S
from ..operators import dense as D
from ..operators import fusion as U
from ..operators import select as P
from ..operators.skew import first_slices, join_null_safe, ordinal
from ..operators.lexical import bm25_search, bm25_search_eval, lexical_index
from ..plans import search as X
from .data import (BM25, LEGS, LEGS_ON_QSRC, WS, bm25_leg, both_legs, corpus, dense_leg, hashed_vectors, kept_index, question_vectors,
                   questions, sql_estimate, sql_strip, sql_tokens)
from .registry import query
from .texts import EVAL_TOK


@query("rt1_bm25_search", f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bm25")
def rt1(t):
    return bm25_leg(t)


EVAL_BM25 = BM25.replace(sql_tokens("text"), EVAL_TOK)


@query("rt2_bm25_search_eval", f"""WITH {EVAL_BM25} SELECT query_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT item_id AS query_id, d.doc_id, coalesce(s.score, 0.0) AS score FROM benchmark b CROSS JOIN documents d
    LEFT JOIN scored s ON s.query_id = b.item_id AND s.doc_id = d.doc_id)) WHERE rank <= 20""")
def rt2(t):
    return bm25_search_eval(kept_index(t, "eval").index(), questions(t), 20)


@query("rt1_bm25_search_unkept", f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM bm25")
def rt1u(t):
    return bm25_search(lexical_index(corpus(t)), questions(t), 20)


# every document holds the padding words, so the mean inverse frequency is negative and so are scores of them
PADDED = BM25.replace(sql_tokens("text"), EVAL_TOK).replace("FROM documents)", "FROM padded)").replace("FROM documents", "FROM padded")


@query("rt2_negative_scores", f"""WITH padded AS (SELECT doc_id, 'pad pod pud ped pid pyd pat pot pit ' || coalesce(lang, '') || CASE WHEN doc_id % 50 = 0 THEN ' rare' ELSE '' END AS text FROM documents WHERE doc_id % 7 <> 3
  UNION ALL SELECT doc_id, 'zero' FROM documents WHERE doc_id % 7 = 3), {PADDED.replace("SELECT item_id AS query_id, text FROM benchmark", "SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'pad pud' ELSE 'pod rare' END AS text FROM benchmark")}
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT q.query_id, d.doc_id, coalesce(s.score, 0.0) AS score FROM qsrc q CROSS JOIN padded d LEFT JOIN scored s ON s.query_id = q.query_id AND s.doc_id = d.doc_id)) WHERE rank <= 200""")
def rt2n(t):
    text = F.concat(F.lit("pad pod pud ped pid pyd pat pot pit "), F.coalesce("lang", F.lit("")), F.when(F.col("doc_id") % 50 == 0, " rare").otherwise(""))
    padded = t.documents.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 7 == 3, "zero").otherwise(text).alias("text"))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "pad pud").otherwise("pod rare").alias("query"))
    return bm25_search_eval(lexical_index(padded, mode="eval"), asked, 200)


# the mean vector of every label asks for its nearest vectors
CENTROIDS = """cen AS (SELECT label AS query_id, i, avg(x::DOUBLE) AS x FROM (
  SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL),
vec AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM vec GROUP BY vec_id), cn AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM cen GROUP BY query_id),
cs AS (SELECT query_id::BIGINT AS query_id, vec_id AS doc_id, label, round(sum(cen.x * vec.x) / (any_value(cn.n) * any_value(vn.n)), 6) AS score
  FROM cen JOIN vec USING (i) JOIN vn USING (vec_id) JOIN cn USING (query_id) GROUP BY query_id, vec_id, label)"""


def near(where=""):
    return (f"WITH {CENTROIDS} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs {where}) WHERE rank <= 20")


def rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query("rt3_dense_search", near())
def rt3(t):
    return rounded(D.dense_search(t.embeddings, D.label_centroids(t.embeddings), 20, id_col="vec_id"))


@query("rt3_dense_search_blocked", near())
def rt3b(t):
    return rounded(D.dense_search(t.embeddings, D.label_centroids(t.embeddings), 20, id_col="vec_id", wave_bytes=3 * 64 * 8))


@query("rt4_cosine_eval", near())
def rt4(t):
    return rounded(D.cosine_eval(t.embeddings, D.label_centroids(t.embeddings), 20, id_col="vec_id"))


@query("rt5_dense_search_where", near("WHERE label >= 3 AND label <> 7"))
def rt5(t):
    return rounded(D.dense_search_where(t.embeddings, D.label_centroids(t.embeddings),
                                        (F.col("label") >= 3) & (F.col("label") != 7), 20, id_col="vec_id"))


@query("rt3_cell_search")
def rt3c(t):
    return rounded(D.cell_search(D.build_cells(t.embeddings, id_col="vec_id"), D.label_centroids(t.embeddings), 20))


@query("rt6_recall_many", f"WITH {LEGS} SELECT * FROM legs")
def rt6(t):
    return both_legs(t)


@query("rt7_distinct_queries", rf"""WITH s AS (SELECT conv_id AS group_id, turn AS pos, {sql_strip("text")} AS query FROM conversations),
f AS (SELECT group_id, query, min(pos) AS p FROM s WHERE query <> '' GROUP BY ALL)
SELECT group_id, query, pos FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY p) AS pos FROM f) WHERE pos <= 4""")
def rt7(t):
    rows = t.conversations.select(F.col("conv_id").alias("group_id"), F.col("turn").alias("pos"), F.col("text").alias("query"))
    return U.distinct_queries(rows, 4)


def with_children(t, ranked=None):
    """Documents of one source are children of one parent."""
    ranked = both_legs(t) if ranked is None else ranked
    ids = t.documents.select("doc_id", F.concat(F.lit("page:"), F.col("source"), F.lit(":chunk:0:child:"),
                                                F.col("doc_id").cast("string")).alias("child_id"))
    return ranked.join(ids, "doc_id").drop("doc_id").withColumnRenamed("child_id", "doc_id")


COLLAPSED = """coll AS (SELECT query_id, leg, parent AS doc_id, score, row_number() OVER (PARTITION BY query_id, leg ORDER BY r) AS rank, collapsed FROM (
  SELECT query_id, leg, 'page:' || source || ':chunk:0' AS parent, min(rank) AS r, arg_min(score, rank) AS score, count(*) - 1 AS collapsed
  FROM legs JOIN documents USING (doc_id) GROUP BY ALL))"""


@query("rt8_collapse_to_parents", f"WITH {LEGS}, {COLLAPSED} SELECT * FROM coll")
def rt8(t):
    return U.collapse_to_parents(with_children(t))


def fused_sql(src="legs", weight="1.0", top=30, name="fused"):
    return (f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ("
            f"SELECT query_id, doc_id, round(sum({weight} / (60.0 + rank)), 12) AS score FROM {src} GROUP BY ALL)) WHERE rank <= {top})")


@query("rt9_rrf_fuse", f"WITH {LEGS}, {fused_sql()} SELECT query_id, doc_id, round(score, 9) AS score, rank FROM fused")
def rt9(t):
    return U.rrf_fuse(both_legs(t)).withColumn("score", F.round("score", 9))


@query("rt10_rrf_fuse_multi", f"WITH {LEGS}, {fused_sql(weight=chr(40) + 'CASE leg WHEN ' + chr(39) + 'bm25' + chr(39) + ' THEN 0.7 ELSE 1.3 END)')} SELECT query_id, doc_id, round(score, 9) AS score, rank FROM fused")
def rt10(t):
    ranked = both_legs(t)
    weights = ranked.select("leg").distinct().withColumn("weight", F.when(F.col("leg") == "bm25", 0.7).otherwise(1.3))
    return U.rrf_fuse(ranked, weights=weights).withColumn("score", F.round("score", 9))


@query("rt11_rrf_fuse_min_score", f"""WITH {LEGS}, ok AS (SELECT query_id, doc_id, leg, row_number() OVER (PARTITION BY query_id, leg ORDER BY rank) AS rank
  FROM legs WHERE score >= CASE leg WHEN 'bm25' THEN 30.0 ELSE 0.7 END), {fused_sql('ok')} SELECT query_id, doc_id, round(score, 9) AS score, rank FROM fused""")
def rt11(t):
    return U.rrf_fuse_min_score(both_legs(t), {"bm25": 30.0, "embedding": 0.7}).withColumn("score", F.round("score", 9))


@query("rt12_fusion_details", f"""WITH {LEGS}, w AS (SELECT query_id, doc_id, max(rank) FILTER (leg = 'bm25') AS bm25_rank, max(score) FILTER (leg = 'bm25') AS bm25_score,
  max(rank) FILTER (leg = 'embedding') AS embedding_rank, max(score) FILTER (leg = 'embedding') AS embedding_score FROM legs GROUP BY ALL)
SELECT *, round(coalesce(1.0 / (60.0 + bm25_rank), 0.0), 9) AS bm25_contribution, round(coalesce(1.0 / (60.0 + embedding_rank), 0.0), 9) AS embedding_contribution,
  round(coalesce(1.0 / (60.0 + bm25_rank), 0.0) + coalesce(1.0 / (60.0 + embedding_rank), 0.0), 9) AS rrf_score FROM w""")
def rt12(t):
    d = U.fusion_details(both_legs(t))
    return d.withColumns({c: F.round(c, 9) for c in ("bm25_contribution", "embedding_contribution", "rrf_score")})


@query("rt13_single_leg_fallback", f"""WITH {LEGS}, part AS (SELECT * FROM legs WHERE leg = 'embedding' OR score >= 100), n AS (SELECT query_id, count(DISTINCT leg) AS n FROM part GROUP BY ALL),
m AS (SELECT part.* FROM part JOIN n USING (query_id) WHERE n = 2), {fused_sql('m')}
SELECT query_id, doc_id, round(score, 9) AS score, rank FROM fused UNION ALL SELECT query_id, doc_id, score, rank FROM part JOIN n USING (query_id) WHERE n = 1""")
def rt13(t):
    some = both_legs(t).filter("leg = 'embedding' OR score >= 100")
    return U.single_leg_fallback(some).withColumn("score", F.round("score", 9))


def chunk_table(t):
    return t.documents.select(
        F.col("doc_id").alias("chunk_id"), "text", F.concat(F.lit("Section "), "source").alias("section_path"),
        F.when(F.col("lang") == "en", F.concat(F.lit("Page "), "source")).alias("page_title"),
        F.concat_ws(",", "lang", "source").alias("tags"), F.concat(F.lit("p"), F.col("source")).alias("page_id"),
        F.concat(F.lit("Section "), "source").alias("section_title"),
        F.when(F.col("lang") == "fr", F.concat(F.lit("audio:"), F.col("doc_id").cast("string"))).alias("source_uri"))


CAND = """cand AS (SELECT query_id, doc_id, f.rank AS fused_rank, f.score AS rrf_score, text AS content,
  CASE WHEN lang = 'en' THEN 'Page ' || source ELSE 'Section ' || source END AS title, lang, source FROM fused f JOIN documents USING (doc_id))"""


@query("rt14_candidates", f"WITH {LEGS}, {fused_sql()}, {CAND} SELECT query_id, doc_id, fused_rank, title, md5(content) AS content FROM cand")
def rt14(t):
    return U.candidates(U.rrf_fuse(both_legs(t)), chunk_table(t)).select(
        "query_id", "doc_id", "fused_rank", "title", F.md5("content").alias("content"))


SCORE = (f"round(len(list_intersect(list_distinct({sql_tokens('b.text')}), list_distinct({sql_tokens('content')})))::DOUBLE"
         f" / len(list_distinct({sql_tokens('b.text')})), 9)")
RERANK = f"""rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT cand.*, {SCORE} AS score FROM cand JOIN qsrc b USING (query_id))) WHERE rank <= 5)"""
KEEP = """best AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM rr) WHERE rank = 1 OR score >= greatest(0.35, top - 0.2))"""
STAGES = f"{LEGS}, {fused_sql()}, {CAND}, {RERANK}, {KEEP}"


def scorer(q, c):
    return F.round(P.overlap_scorer(q, c), 9)


def reranked(t):
    found = U.candidates(U.rrf_fuse(both_legs(t)), chunk_table(t), keep=("page_title", "section_path", "section_title", "tags", "page_id", "source_uri"))
    return P.rerank(found.join(questions(t), "query_id"), scorer)


@query("rt15_rerank", f"WITH {STAGES} SELECT query_id, doc_id, score, rank FROM rr")
def rt15(t):
    return reranked(t).select("query_id", "doc_id", "score", "rank")


@query("rt16_validate_rerank", """WITH r AS (SELECT l_orderkey AS q, l_linenumber - 1 AS i, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_discount END AS s FROM lineitem),
p AS (SELECT o_orderkey AS q, 5 AS n, count(i) AS rows, count(DISTINCT i) AS d, count(*) FILTER (i < 0 OR i >= 5) AS o, count(*) FILTER (i IS NOT NULL AND s IS NULL) AS b
  FROM orders LEFT JOIN r ON q = o_orderkey GROUP BY 1)
SELECT q AS query_id, 'empty' AS problem, 1::BIGINT AS n FROM p WHERE rows = 0 UNION ALL SELECT q, 'duplicate', rows - d FROM p WHERE rows > d
UNION ALL SELECT q, 'out_of_range', o FROM p WHERE o > 0 UNION ALL SELECT q, 'bad_score', b FROM p WHERE b > 0""")
def rt16(t):
    results = t.lineitem.select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") - 1).alias("index"),
                                F.when(F.col("l_returnflag") != "R", F.col("l_discount")).alias("score"))
    sizes = t.orders.select(F.col("o_orderkey").alias("query_id"), F.lit(5).alias("n_candidates"))
    return P.validate_rerank(results, sizes)


@query("rt17_filter_reranked", """WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, o_totalprice / 500000 AS score FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM r)
SELECT query_id, doc_id, round(score, 9) AS score, rank FROM k WHERE rank <= 5 AND (rank = 1 OR score >= greatest(0.35, top - 0.2))""")
def rt17(t):
    rows = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"),
                           (F.col("o_totalprice") / 500000).alias("score"))
    return P.filter_reranked(rows).withColumn("score", F.round("score", 9))


@query("rt18_pack_token_budget", rf"""WITH r AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, text,
  {sql_estimate('text')} AS c FROM documents),
b AS (SELECT *, 3000 - coalesce(sum(c) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS room FROM r),
k AS (SELECT *, CASE WHEN c <= room THEN text ELSE regexp_replace(text[1:4 * (room - CASE WHEN 13 > room THEN 1 ELSE 13 END)], '{WS}+\z', '') ||
  CASE WHEN 13 > room THEN '...' ELSE chr(10) || '...[内容已按上下文预算截断]' END END AS content FROM b WHERE room > 0)
SELECT query_id, doc_id, rank, md5(content) AS content, {sql_estimate('content')}::BIGINT AS context_tokens, length(content) < length(text) AS context_truncated FROM k""")
def rt18(t):
    ranks = ordinal(t.documents.select(F.col("source").alias("query_id"), "doc_id"), ["query_id"], "doc_id", "rank")
    texts = t.documents.select(F.col("source").alias("query_id"), "doc_id", F.col("text").alias("content"))
    rows = join_null_safe(first_slices(ranks, ["query_id"], "rank", S.CONTEXT_BUDGET), texts, ["query_id", "doc_id"])
    return P.pack_token_budget(rows).select("query_id", "doc_id", "rank", F.md5("content").alias("content"), "context_tokens", "context_truncated")


FORMATTED = """SELECT query_id, doc_id AS id, 'p' || source AS page_id, CASE WHEN lang = 'en' THEN 'Page ' || source ELSE 'Section ' || source END AS title,
  md5(content[1:300]) AS snippet, md5(CASE WHEN length(content) > 200 THEN content[1:200] || '...' ELSE content END) AS summary,
  lang || '|' || source AS tags, '/api/pages/p' || source || '#section=Section%20' || source AS source_url, 'Section ' || source AS section_path,
  CASE WHEN lang = 'fr' THEN '/audio/' || doc_id || '/file#t=0' END AS audio_url, score AS rerank_score, rank FROM best"""


def formatted_view(df):
    return df.select("query_id", "id", "page_id", "title", F.md5("snippet").alias("snippet"), F.md5("summary").alias("summary"),
                     F.array_join("tags", "|").alias("tags"), "source_url", "section_path", "audio_url", "rerank_score", "rank")


@query("rt19_format_result", f"WITH {STAGES} {FORMATTED}")
def rt19(t):
    return formatted_view(P.format_result(P.filter_reranked(reranked(t))))


@query("rt20_search_hybrid", f"WITH {STAGES} SELECT query_id, doc_id AS id, score AS rerank_score, rank FROM best")
def rt20(t):
    return X.search_hybrid(both_legs(t), questions(t), chunk_table(t).select("chunk_id", "text", "section_path"), scorer).select(
        "query_id", "id", "rerank_score", "rank")


# every passage is asked whole and by its first sentence
def rewrites(t):
    q = questions(t)
    return q.select((F.col("query_id") * 2).alias("query_id"), "query").unionByName(
        q.select((F.col("query_id") * 2 + 1).alias("query_id"), F.regexp_extract("query", r"^[^.]*", 0).alias("query")))


REWRITES = "qsrc AS (SELECT item_id * 2 AS query_id, text FROM benchmark UNION ALL SELECT item_id * 2 + 1, regexp_extract(text, '^[^.]*') FROM benchmark)"


def multi(t):
    ranked = both_legs(t, q=rewrites(t)).withColumn("group_id", F.floor(F.col("query_id") / 2))
    groups = questions(t).withColumnRenamed("query_id", "group_id")
    return ranked, groups, X.search_multi(ranked, groups, chunk_table(t).select("chunk_id", "text", "section_path"), scorer)


# collapsing to parents works on text ids, so ties are broken by the id as text
AS_TEXT = ("ORDER BY score DESC, doc_id)", "ORDER BY score DESC, doc_id::VARCHAR)")
MULTI = f"""{REWRITES}, {LEGS_ON_QSRC}, grp AS (SELECT query_id // 2 AS query_id, doc_id, rank FROM legs), {fused_sql('grp', top=12).replace(*AS_TEXT)}, {CAND},
{RERANK.replace('qsrc b', '(SELECT item_id AS query_id, text FROM benchmark) b').replace(*AS_TEXT)}, {KEEP},
bud AS (SELECT *, {sql_estimate('content')} AS c, 3000 - coalesce(sum({sql_estimate('content')}) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS room FROM best),
sel AS (SELECT *, c > room AS cut FROM bud WHERE room > 0)"""


@query("rt21_search_multi", f"WITH {MULTI} SELECT query_id, doc_id::VARCHAR AS id, score AS rerank_score, rank, cut AS context_truncated FROM sel")
def rt21(t):
    return multi(t)[2]["selected"].select("query_id", "id", "rerank_score", "rank", "context_truncated")


@query("rt22_retrieval_stats", f"""WITH {MULTI}, a AS (SELECT query_id // 2 AS g, count(DISTINCT query_id) AS query_count, count(*) FILTER (leg = 'bm25') AS bm25_hits,
  count(*) FILTER (leg = 'embedding') AS embedding_hits FROM legs GROUP BY 1)
SELECT g AS group_id, query_count, bm25_hits, embedding_hits, (SELECT count(*) FROM fused WHERE query_id = g) AS fused_candidates,
  (SELECT count(*) FROM cand WHERE query_id = g) AS reranked_candidates, (SELECT count(*) FROM best WHERE query_id = g) AS quality_filtered_candidates,
  (SELECT count(*) FROM sel WHERE query_id = g) AS selected_results, 3000::BIGINT AS token_budget,
  (SELECT bool_or(cut) FROM sel WHERE query_id = g) OR (SELECT count(*) FROM sel WHERE query_id = g) < (SELECT count(*) FROM best WHERE query_id = g) AS context_truncated FROM a""")
def rt22(t):
    ranked, groups, stages = multi(t)
    return X.retrieval_stats(ranked, stages, groups).drop("context_tokens")


@query("rt23_search_bm25_only", f"WITH {BM25} SELECT query_id, doc_id AS id, score AS bm25_score, rank, 'Section ' || source AS title FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 5")
def rt23(t):
    return X.search_single_leg(bm25_leg(t), chunk_table(t).select("chunk_id", "text", "section_path"), "bm25_score", 5).select(
        "query_id", "id", "bm25_score", "rank", "title")


@query("rt23_search_dense_only", f"WITH {LEGS} SELECT query_id, doc_id AS id, score AS embedding_score, rank FROM dense WHERE rank <= 5")
def rt23d(t):
    return X.search_single_leg(dense_leg(t), chunk_table(t).select("chunk_id", "text"), "embedding_score", 5).select(
        "query_id", "id", "embedding_score", "rank")


@query("rt24_search_with_filter", f"""WITH {LEGS} SELECT query_id, doc_id, score, rank, 'bm25' AS leg FROM bm25 UNION ALL
SELECT query_id, doc_id, score, rank, 'embedding' FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM cosine JOIN documents USING (doc_id) WHERE lang = 'en') WHERE rank <= 20""")
def rt24(t):
    vectors = hashed_vectors(t).join(t.documents.select(F.col("doc_id").alias("chunk_id"), "lang"), "chunk_id")
    return X.search_with_filter(bm25_leg(t), vectors, question_vectors(t), F.col("lang") == "en")


@query("rt25_compare_methods", f"""WITH {LEGS}, {fused_sql(top=5)} SELECT leg AS method, query_id, doc_id, rank FROM legs WHERE rank <= 5
UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM fused""")
def rt25(t):
    return X.compare_methods(both_legs(t)).select("method", "query_id", "doc_id", "rank")


@query("rt25_compare_overlap", f"""WITH {LEGS}, {fused_sql(top=5)}, m AS (SELECT leg AS method, query_id, doc_id FROM legs WHERE rank <= 5 UNION ALL SELECT 'hybrid', query_id, doc_id FROM fused)
SELECT a.query_id, a.method AS method_a, b.method AS method_b, count(*) AS overlap FROM m a JOIN m b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.method < b.method GROUP BY ALL""")
def rt25o(t):
    return U.compare_overlap(X.compare_methods(both_legs(t)))


@query("rt26_merge_legacy", """WITH r AS (SELECT source AS q, doc_id AS pos, text, CASE WHEN lang = 'de' THEN NULL ELSE n_chars / 20000.0 END AS s FROM documents),
f AS (SELECT q, text, min(pos) AS pos, coalesce(arg_min_null(s, pos), 0.0) AS s FROM r GROUP BY q, text)
SELECT q AS question_id, pos, md5(text) AS content, round(s, 9)::DOUBLE AS rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, pos) AS rank FROM f) WHERE rank <= 10""")
def rt26(t):
    rows = t.documents.select(F.col("source").alias("question_id"), F.col("doc_id").alias("pos"), F.col("text").alias("content"),
                              F.when(F.col("lang") != "de", F.col("n_chars") / 20000.0).alias("rerank_score"))
    return U.merge_legacy(rows).withColumn("content", F.md5("content")).withColumn("rerank_score", F.round("rerank_score", 9))


@query("rt27_paginate", """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50""")
def rt27(t):
    return P.paginate(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 3, 25)


@query("rt27_deep_page", """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice, (SELECT count(*) FROM lineitem) AS total FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20 OFFSET 39980""")
def rt27d(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return P.paginate(rows, [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 2000, 20)


@query("rt28_extract_sources", f"WITH {STAGES}, f AS ({FORMATTED}) SELECT query_id, id, id AS chunk_id, page_id, title, rerank_score AS score, source_url, snippet, audio_url FROM f")
def rt28(t):
    rows = P.extract_sources(P.format_result(P.filter_reranked(reranked(t))))
    return rows.select("query_id", "id", "chunk_id", "page_id", "title", "score", "source_url", F.md5("snippet").alias("snippet"), "audio_url")


SRC_ROWS = """r AS (SELECT o_custkey AS query_id, o_orderkey AS pos, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS chunk_id, o_orderstatus AS page_id,
  CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS rerank_score, o_totalprice / 2 AS score FROM orders)"""


def source_rows(t):
    st = F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("pos"), F.when(st != "O", F.col("o_orderpriority")).alias("chunk_id"),
        F.lit(None).cast("string").alias("id"), st.alias("page_id"), F.lit("s").alias("section_path"), F.lit("s").alias("section_title"),
        F.when(st == "F", F.col("o_totalprice")).alias("rerank_score"), (F.col("o_totalprice") / 2).alias("score"))


@query("rt29_ordered_sources", f"""WITH {SRC_ROWS}, k AS (SELECT *, coalesce(chunk_id, page_id || ':s') AS source_key, coalesce(rerank_score, score, 0) AS s FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_key ORDER BY s DESC, pos) AS n FROM k)
SELECT query_id, source_key, pos, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pos) AS position FROM f WHERE n = 1""")
def rt29(t):
    return P.ordered_sources(source_rows(t)).select("query_id", "source_key", "pos", "position")


@query("rt30_filter_for_summary", """WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, o_totalprice / 500000 AS s FROM orders),
m AS (SELECT *, max(s) OVER (PARTITION BY query_id) AS top FROM r) SELECT query_id, doc_id FROM m WHERE s >= 0.35 OR top < 0.35""")
def rt30(t):
    rows = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), (F.col("o_totalprice") / 500000).alias("rerank_score"))
    return P.filter_for_summary(rows).select("query_id", "doc_id")


@query("rt30_summary_text", """SELECT o_custkey AS query_id, string_agg('order ' || o_orderkey || ' ' || o_orderpriority, chr(10) || chr(10) ORDER BY o_orderkey) AS text FROM orders WHERE o_totalprice >= 175000 GROUP BY 1""")
def rt30s(t):
    rows = t.orders.filter("o_totalprice >= 175000").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("rank"),
                                                            F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority").alias("content"))
    return P.summary_text(rows)


GATE_ROWS = """SELECT l_orderkey AS query_id, CASE WHEN l_returnflag = 'N' THEN '  ' ELSE 'x' END AS content, l_partkey AS page_id,
  CASE WHEN l_linestatus = 'F' THEN l_discount * 6 END AS rerank_score, CASE WHEN l_quantity > 25 THEN l_tax * 6 END AS score FROM lineitem"""


def gate_rows(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("query_id"), F.when(F.col("l_returnflag") == "N", "  ").otherwise("x").alias("content"),
        F.col("l_partkey").alias("page_id"), F.when(F.col("l_linestatus") == "F", F.col("l_discount") * 6).alias("rerank_score"),
        F.when(F.col("l_quantity") > 25, F.col("l_tax") * 6).alias("score"))


GATE = f"""g AS (SELECT o_orderkey AS query_id, count(r.query_id) AS rows, count(DISTINCT page_id) AS keys, max(coalesce(rerank_score, score)) AS best FROM orders
  LEFT JOIN ({GATE_ROWS}) r ON r.query_id = o_orderkey AND trim(content) <> '' GROUP BY 1),
ev AS (SELECT query_id, CASE WHEN rows = 0 THEN 'no_content' WHEN coalesce(best < 0.35, false) THEN 'score_below_minimum' ELSE 'sufficient' END AS evidence_reason,
  CASE WHEN rows = 0 OR coalesce(best < 0.35, false) THEN 'insufficient' ELSE 'sufficient' END AS evidence_status, keys AS evidence_source_count, round(best, 6) AS evidence_score FROM g)"""


def gate(t):
    ids = t.orders.select(F.col("o_orderkey").alias("query_id"))
    return P.assess_evidence(gate_rows(t), ids).withColumn("evidence_score", F.round("evidence_score", 6))


@query("rt31_assess_evidence", f"WITH {GATE} SELECT * FROM ev")
def rt31(t):
    return gate(t)


# grades: the lines of an order are its graded documents; the order's status gives the coverage
def grade_inputs(t):
    scores = t.lineitem.select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") - 1).alias("doc_index"),
                               (F.col("l_discount") * 10).alias("score"))
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.max("l_linenumber").alias("n_documents"))
    cover = t.orders.select(F.col("o_orderkey").alias("query_id"), F.when(F.col("o_orderstatus") == "F", "Complete")
                            .when(F.col("o_orderstatus") == "O", "incomplete").otherwise("unsure").alias("coverage"))
    return scores, cover.join(n, "query_id")


GRADES = """sc AS (SELECT l_orderkey AS query_id, l_linenumber - 1 AS i, l_discount * 10 AS s FROM lineitem),
cv AS (SELECT o_orderkey AS query_id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'incomplete' ELSE 'unsure' END AS c, (SELECT 1) AS one FROM orders),
pq AS (SELECT query_id, c, count(*) AS n, count(DISTINCT i) AS d, max(i) + 1 AS nd, min(i) AS lo, bool_and(s BETWEEN 0 AND 1) AS ok, count(*) FILTER (s >= 0.7) AS sup,
  count(*) FILTER (s <= 0.3) AS inc, count(*) FILTER (s > 0.3 AND s < 0.7) AS lim, max(s) AS mx FROM cv JOIN sc USING (query_id) GROUP BY ALL),
ff AS (SELECT *, NOT (n = nd AND d = nd AND lo = 0 AND ok) AS failed FROM pq),
gr AS (SELECT query_id, failed OR c = 'unsure' AS grading_failed, CASE WHEN failed OR c = 'unsure' THEN 'incorrect' WHEN sup > 0 AND c = 'complete' THEN 'correct'
  WHEN sup > 0 OR lim > 0 THEN 'ambiguous' ELSE 'incorrect' END AS grade, CASE WHEN NOT (failed OR c = 'unsure') THEN round(mx, 6) END AS max_score,
  CASE WHEN failed OR c = 'unsure' THEN 0 ELSE sup END AS support_count, CASE WHEN failed OR c = 'unsure' THEN 0 ELSE lim END AS limited_count,
  CASE WHEN failed OR c = 'unsure' THEN 0 ELSE inc END AS incorrect_count FROM ff)"""


def grades(t):
    return P.grade_scores(*grade_inputs(t)).withColumn("max_score", F.round("max_score", 6))


@query("rt32_grade_scores", f"WITH {GRADES} SELECT * FROM gr")
def rt32(t):
    return grades(t)


@query("rt33_validate_grades", f"WITH {GRADES} SELECT query_id, failed FROM ff")
def rt33(t):
    return P.validate_grades(*grade_inputs(t))


@query("rt34_accept_by_verdict", f"""WITH {GRADES} SELECT query_id, i::BIGINT AS doc_index, grade, CASE WHEN s >= 0.7 THEN 'support' ELSE 'limited_support' END AS verdict
FROM sc JOIN gr USING (query_id) WHERE NOT grading_failed AND ((grade = 'correct' AND s >= 0.7) OR (grade = 'ambiguous' AND s > 0.3))""")
def rt34(t):
    return P.accept_by_verdict(grade_inputs(t)[0], grades(t)).select("query_id", "doc_index", "grade", "verdict")


@query("rt35_recovery_allowed", f"WITH {GRADES} SELECT query_id, grade = 'incorrect' AND NOT grading_failed AND max_score > 0.1 AND o_orderpriority <> '1-URGENT' AS recovery_allowed FROM gr JOIN orders ON o_orderkey = query_id")
def rt35(t):
    tried = t.orders.select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderpriority") == "1-URGENT").alias("tried"))
    return P.recovery_allowed(grades(t).join(tried, "query_id"), "tried").select("query_id", "recovery_allowed")


@query("rt36_skip_grading", f"WITH {GATE} SELECT query_id, o_orderstatus = 'F' AND evidence_status = 'sufficient' AND coalesce(evidence_score >= 0.5, false) AND evidence_source_count >= 2 AS skip_grading FROM ev JOIN orders ON o_orderkey = query_id")
def rt36(t):
    fast = t.orders.select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderstatus") == "F").alias("fast_path"))
    return P.skip_grading(gate(t).join(fast, "query_id"), min_score=0.5, min_sources=2).select("query_id", "skip_grading")


@query("rt37_cache_key", """SELECT doc_id, sha256('{"budget":3000,"final_top_k":5,"queries":["' || lang || '","' || source || '"]}') AS cache_key FROM documents""")
def rt37(t):
    key = P.cache_key({"queries": F.array("lang", "source"), "final_top_k": F.lit(S.FINAL_TOP_K), "budget": F.lit(S.CONTEXT_BUDGET)})
    return t.documents.select("doc_id", key.alias("cache_key"))
